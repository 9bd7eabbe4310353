"""Sharding into near-equal byte ranges by sampled splitters.

Rows are ordered by (hash of the text, doc_id, row number). A size-weighted sample of keys gives quantile splitters; rows
are dealt to the ranges between them, and ranges that turn out overfull (one text held by many rows) are split again by samples of
their own, until none is left; the row number makes any range divisible. Within a range rows are numbered and their sizes summed; offsets of the ranges make that a running total over the
table, and the place of a row's middle in the total is its shard. Equal texts lie side by side and keep to one shard unless
their group is larger than ``GROUP_SHARE`` of a shard.

Law ``bytes``: the sizes of the shards are equal up to ``GROUP_SHARE`` and one row; ``grown_shard`` is null.

Defined results: a null text has size 1 and a checksum of 0, like an empty one; repeated rows each get a slot; a null doc_id
sorts first; an empty table gives an empty result; columns other than doc_id and text are not read.
"""

from __future__ import annotations

import math


import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from pagemill.llm.common import written

SHARDS = 8
#: Rows (of 52 bytes) that a range should hold, and the least number of ranges. The driver sees ``SAMPLE_PER_RANGE`` keys for each range.
RANGE_ROWS = 200_000
RANGES = 32
#: Sampled keys for each range.
SAMPLE_PER_RANGE = 16
#: Ranges with more than so many times the mean of rows are split again.
OVERFULL = 3
#: A group of equal texts up to this share of a shard stays together.
GROUP_SHARE = 0.005
NO_ID = -(1 << 63)


def shard_keys(docs: DataFrame) -> DataFrame:
    """(doc_id, size, text_crc32, h, d, r): compact keys; the text is read once and never shuffled. r is any number of the row's own."""
    text = F.coalesce("text", F.lit(""))
    doc_id = F.col("doc_id").cast("long")
    return docs.select(
        doc_id.alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64(text).alias("h"), F.coalesce(doc_id, F.lit(NO_ID)).alias("d"), F.monotonically_increasing_id().alias("r"),
    )


def splitters(sample: list[tuple[int, int, int, float]], ranges: int) -> list[tuple[int, int, int]]:
    """Weighted quantiles of keys (h, d, r). Where a hash gives one splitter only, the splitter stands before the whole group."""
    sample = sorted(sample)
    total, upto, found = sum(x[-1] for x in sample), 0.0, []
    for *key, w in sample:
        while len(found) + 1 < ranges and upto >= total * (len(found) + 1) / ranges:
            found.append(tuple(key))
        upto += w
    found = sorted(set(found))
    many = {a[0] for a, b in zip(found, found[1:]) if a[0] == b[0]}
    return sorted({k if k[0] in many else (k[0], NO_ID, -1) for k in found})


def places(cuts: list[np.ndarray], keys: list[np.ndarray]) -> np.ndarray:
    """How many of the ordered ``cuts`` are at or below each key, column by column."""
    if not cuts:
        return np.zeros(len(keys[0]) if keys else 0, np.int64)
    low, high = np.searchsorted(cuts[0], keys[0], "left"), np.searchsorted(cuts[0], keys[0], "right")
    out, tied = low.copy(), high > low
    for v in np.unique(keys[0][tied]):
        at = np.nonzero(keys[0] == v)[0]
        a, b = low[at[0]], high[at[0]]
        out[at] += places([c[a:b] for c in cuts[1:]], [k[at] for k in keys[1:]]) if len(cuts) > 1 else b - a
    return out


def _range_of(cuts: list[tuple[int, int, int]]):
    columns = [np.array([c[i] for c in cuts], np.int64) for i in range(3)]

    @F.pandas_udf("int")
    def place(h: pd.Series, d: pd.Series, r: pd.Series) -> pd.Series:
        return pd.Series(places(columns, [x.to_numpy(np.int64) for x in (h, d, r)]).astype(np.int32))

    return place("h", "d", "r")


def _chance(salt: int) -> Column:
    """Uniform in [0, 1) for each row, fixed by its key."""
    return F.shiftrightunsigned(F.xxhash64("h", "d", "r", F.lit(salt)), 11) / float(1 << 53)


def sampled_ranges(keys: DataFrame) -> tuple[list[tuple[int, int, int]], dict[int, tuple[int, int]]]:
    """Splitters, and (rows, bytes) of each range. The driver sees a sample and one line for each range of ``RANGE_ROWS`` rows."""
    rows, total = keys.agg(F.count(F.lit(1)), F.coalesce(F.sum("size"), F.lit(0))).first()
    if not rows:
        return [], {}
    ranges = max(RANGES, math.ceil(rows / RANGE_ROWS))
    share = ranges * SAMPLE_PER_RANGE / total
    drawn = keys.where(_chance(1) < F.col("size") * share).select("h", "d", "r", F.greatest(F.col("size").cast("double"), F.lit(1 / share))).collect()
    cuts, salt, mean = splitters([tuple(r) for r in drawn], ranges), 1, max(rows / ranges, 50)
    while True:
        salt += 1
        filled = {r[0]: (r[1], r[2]) for r in keys.groupBy(_range_of(cuts).alias("range")).agg(F.count(F.lit(1)), F.sum("size")).collect()}
        over = {r: n for r, (n, _) in filled.items() if n > OVERFULL * mean}
        if not over:
            return cuts, filled
        inside = keys.withColumn("range", _range_of(cuts)).where(F.col("range").isin(list(over)))
        more = inside.where(_chance(salt) < SAMPLE_PER_RANGE / mean).select("range", "h", "d", "r").collect()
        added = set(cuts)
        for r, n in over.items():
            own = [(h, d, k, 1.0) for q, h, d, k in more if q == r]
            added |= set(splitters(own, math.ceil(n / mean))) if own else set()
        if len(added) > len(cuts):
            cuts = sorted(added)


def shards(docs: DataFrame, n: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of each row of ``docs``."""
    spark = docs.sparkSession
    keys = written(shard_keys(docs), "shard-keys")
    cuts, filled = sampled_ranges(keys)
    offsets, rows_before, bytes_before = [], 0, 0
    for r in sorted(filled):
        offsets.append((r, rows_before, bytes_before))
        rows_before, bytes_before = rows_before + filled[r][0], bytes_before + filled[r][1]
    total = max(1, bytes_before)
    table = spark.createDataFrame(offsets, "range int, rows_before long, bytes_before long")  # one line for each range
    ranged = keys.withColumn("range", _range_of(cuts)).join(F.broadcast(table), "range")
    order = Window.partitionBy("range").orderBy("h", "d", "r")
    upto = F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size") + F.col("bytes_before")
    placed = ranged.withColumn("rank", F.row_number().over(order) - 1 + F.col("rows_before")).withColumn("at", upto)
    group = Window.partitionBy("range", "h")
    placed = placed.withColumn("group_at", F.min("at").over(group)).withColumn("group_bytes", F.sum("size").over(group))
    twice = F.when(F.col("group_bytes") <= GROUP_SHARE * total / n, 2 * F.col("group_at") + F.col("group_bytes")).otherwise(2 * F.col("at") + F.col("size"))
    shard = F.least(F.lit(n - 1), F.floor(twice.cast("decimal(38,0)") * n / F.lit(2 * total).cast("decimal(38,0)"))).cast("int")
    placed = written(placed.select("doc_id", "size", "text_crc32", shard.alias("shard"), "rank"), "shard-places")
    first = placed.groupBy("shard").agg(F.min("rank").alias("first"))
    return placed.join(F.broadcast(first), "shard").select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("rank") - F.col("first")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )
