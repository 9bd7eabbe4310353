"""Shared pieces: reading tables, written intermediate tables, the word rule."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from pagemill.sources.tables import table

read_table = table

#: A word is a maximal run of anything but these ASCII spaces.
SPACES = "\x20\x09\x0a\x0b\x0c\x0d"
SPACE_RUN = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``, which driver and executors share.

    Where the session names none, a temporary folder is made and set in local mode; on a cluster that is an error, as executors couldn't see it.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="pagemill-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once as Parquet in the shared folder and read back: cuts the lineage and survives lost executors."""
    path = f"{shared_folder(df.sparkSession)}/pagemill/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Remove the files of a table from ``written`` that nothing reads any more."""
    context = df.sparkSession.sparkContext
    for file in df.inputFiles()[:1]:
        folder = context._jvm.org.apache.hadoop.fs.Path(file).getParent()
        folder.getFileSystem(context._jsc.hadoopConfiguration()).delete(folder, True)


#: Bytes of text that a task works at once.
SLICE_BYTES = 4 << 20


def sliced(frames: Iterator[pd.DataFrame], column: str = "text", most: int = SLICE_BYTES) -> Iterator[pd.DataFrame]:
    """``frames`` in pieces of about ``most`` characters of ``column``, or one row: what a task holds doesn't follow from the session's batch size."""
    for f in frames:
        upto = f[column].str.len().fillna(0).cumsum().to_numpy()
        cuts = [0, *(np.nonzero(np.diff(upto // most))[0] + 1).tolist(), len(f)] if len(f) else [0, 0]
        for a, b in zip(cuts, cuts[1:]):
            yield f.iloc[a:b].reset_index(drop=True)


def unused(df: DataFrame, name: str) -> str:
    """``name``, with underscores until no column of ``df`` is called so."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def words(text: Column) -> Column:
    """The words of ``text`` as an array; null gives an empty array."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACES))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACE_RUN))


def bound(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once for each row (a plain reference inside a lambda would be computed for each element)."""
    return F.transform(F.array(value), body)[0]
