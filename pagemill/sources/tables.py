"""Table sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """The Parquet table ``name`` under ``root``; any path Spark's readers can open will do."""
    return spark.read.parquet(f"{root.rstrip('/')}/{name}.parquet")


def spread_table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """``table``, dealt over all cores if it is read in fewer splits than there are cores: for small tables under long work a row. Larger ones are read as they are."""
    rows, cores = table(spark, root, name), spark.sparkContext.defaultParallelism
    return rows.repartition(cores) if rows.rdd.getNumPartitions() < cores else rows
