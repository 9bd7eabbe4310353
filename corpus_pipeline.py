"""From raw documents to packed training sequences, in five stages that each read what the one before has written.

Each stage works on all rows of its predecessor and its decisions take effect: rejected documents go, one document of each
near-duplicate group stays, personal data are replaced, sources are mixed to their weights (a document taken twice is
there twice), and all that is left is packed. All stages but the last return the columns of ``documents``.
"""

from __future__ import annotations

import warnings

from pyspark.sql import DataFrame, SparkSession

from pagemill.llm import mixing, packing, pii, quality, simhash
from pagemill.llm.common import read_table, written
from pagemill.llm.queries import surrogate_key
from pagemill.shipping import ship


def key_of(spark: SparkSession) -> bytes:
    """The surrogates' key; without the setting ``spark.pagemill.surrogate.key`` the open one of the tests, which protects nothing, with a warning."""
    if not spark.conf.get("spark.pagemill.surrogate.key", None):
        warnings.warn("spark.pagemill.surrogate.key is not set: surrogates are made with a public key", stacklevel=2)
    return surrogate_key(spark)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no quality rule rejects."""
    return quality.quality_filter(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates (five-word Jaccard similarity of 0.8 or more) the document with the least doc_id."""
    ship(spark)
    return simhash.one_of_each_group(docs)


def pii_surrogates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with surrogates for personal data."""
    ship(spark)
    return pii.replace_entities(docs, key_of(spark)).select(*docs.columns)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as many times as the mix takes it."""
    return mixing.mix(docs)


def sequence_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places in sequences."""
    ship(spark)
    return packing.packed(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("SimHash near-dedup", near_dedup),
    ("PII surrogates", pii_surrogates),
    ("source mixing", source_mixing),
    ("packing", sequence_packing),
]

#: Fingerprints and token ids have no SQL form; tests hold the run against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over ``documents``."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
