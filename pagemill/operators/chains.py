"""Following links from row to row: redirects and host aliases, as a fixed number of joins; references of any length by doubling."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, functions as F

# Statuses that redirect, and most hops.
REDIRECT_STATUSES = (301, 302, 303, 307, 308)
MOST_HOPS = 5


def followed(starts: DataFrame, edges: DataFrame, most: int = MOST_HOPS) -> DataFrame:
    """(start, final, hops, error) from ``starts(start)`` over ``edges(source, target)``.

    ``error`` is ``loop`` where a chain returns to a place, ``too-many`` where it goes on after ``most`` hops, else null. A source
    has one target (the least, if the table names several). Each hop is one equi-join; chains that have ended pass through.
    """
    one = edges.where("source IS NOT NULL").groupBy("source").agg(F.min("target").alias("target"))
    at = starts.select("start", F.col("start").alias("final"), F.lit(0).alias("hops"), F.array("start").alias("seen"), F.lit(None).cast("string").alias("error"))
    for hop in range(most + 1):
        joined = at.join(one, (at["final"] == one["source"]) & at["error"].isNull() & (at["hops"] == hop), "left")
        goes = F.col("target").isNotNull()
        error = F.when(F.col("error").isNotNull(), F.col("error")).when(goes & F.array_contains("seen", F.col("target")), "loop").when(goes & F.lit(hop == most), "too-many")
        moves = goes & error.isNull()
        at = joined.select(
            "start", F.when(moves, F.col("target")).otherwise(F.col("final")).alias("final"), (F.col("hops") + moves.cast("int")).alias("hops"),
            F.when(moves, F.array_append("seen", F.col("target"))).otherwise(F.col("seen")).alias("seen"), error.alias("error"),
        )
    return at.drop("seen")


def redirect_edges(responses: DataFrame) -> DataFrame:
    """(source, target) of the responses that redirect, from ``responses(url, status, location)``."""
    return responses.where(F.col("status").isin(*REDIRECT_STATUSES) & F.col("location").isNotNull()).select(F.col("url").alias("source"), F.col("location").alias("target"))


def blocked_by_alias(hosts: DataFrame, aliases: DataFrame, blocked: Column) -> DataFrame:
    """(start, final, hops, error, is_blocked): where host names lead, and whether that place is blocked. ``blocked`` reads ``final``."""
    return followed(hosts, aliases).withColumn("is_blocked", blocked)


def _checkpointed(rows: DataFrame) -> DataFrame:
    """``rows`` written under spark.checkpoint.dir, with their lineage cut; a temporary folder only where that is unset, in local mode."""
    spark = rows.sparkSession
    if not spark.sparkContext.getCheckpointDir():
        root = spark.conf.get("spark.checkpoint.dir", None)
        if not root and not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(root or tempfile.mkdtemp(prefix="pagemill-"))
    return rows.checkpoint()


def resolved_references(values: DataFrame, group: str = "page_id", key: str = "id", value: str = "value", ref: str = "ref") -> DataFrame:
    """(group, key, value, hops, error) for ``values(group, key, value, ref)``: where ``ref`` names another key of the group, the value at the end of the chain.

    Chains have any length: each round joins the table with itself and doubles how far a row has come, so a chain of n references takes log2(n) rounds; what has
    not ended after more rounds than the largest group has doublings is in a cycle, or leads into one. ``error`` is ``cycle``, ``missing`` where a chain
    leads to a key that isn't there, else null; such rows have a null value. Of several rows with one key the one with the least value counts; rows without
    a key are left out.
    """
    one = values.where(F.col(key).isNotNull()).groupBy(group, key).agg(F.min(F.struct(F.col(value).alias("v"), F.col(ref).alias("r"))).alias("s"))
    state = _checkpointed(one.select(F.col(group).alias("g"), F.col(key).alias("k"), F.when(F.col("s.r").isNull(), F.col("s.v")).alias("v"), F.col("s.r").alias("at"), F.col("s.r").isNotNull().cast("long").alias("hops"), F.lit(None).cast("string").alias("error")))
    largest = state.groupBy("g").count().agg(F.max("count")).first()[0] or 0
    for _ in range(largest.bit_length() + 1):
        if state.where("at IS NOT NULL").isEmpty():
            break
        onward = state.select(F.col("g").alias("g2"), F.col("k").alias("k2"), F.col("v").alias("v2"), F.col("at").alias("at2"), F.col("hops").alias("h2"), F.col("error").alias("e2"), F.lit(True).alias("there"))
        met = state.join(onward, (F.col("g").eqNullSafe(F.col("g2"))) & (F.col("at") == F.col("k2")), "left")
        going = F.col("at").isNotNull()
        state = _checkpointed(met.select(
            "g", "k", F.when(going, F.col("v2")).otherwise(F.col("v")).alias("v"), F.when(going, F.col("at2")).alias("at"), (F.col("hops") + F.when(going, F.coalesce("h2", F.lit(0))).otherwise(0)).alias("hops"),
            F.when(going & F.col("there").isNull(), "missing").when(going, F.col("e2")).otherwise(F.col("error")).alias("error"),
        ))
    error = F.when(F.col("at").isNotNull(), "cycle").otherwise(F.col("error"))
    return state.select(F.col("g").alias(group), F.col("k").alias(key), F.when(error.isNull(), F.col("v")).alias(value), F.when(error.isNull(), F.col("hops")).alias("hops"), error.alias("error"))


#: A line of a payload: an object's number and its JSON text; and a text that only names another object.
OBJECT_LINE, REFERENCE = r"^([0-9a-f]+):(.*)$", r"^\"\$[A-Z@]?([0-9a-f]+)\"$"


def payload_objects(payloads: DataFrame, group: str = "page_id", payload: str = "payload") -> DataFrame:
    """(group, id, value, ref): the objects of payload texts, one a line, as values for ``resolved_references``."""
    line = payloads.select(group, F.explode(F.split(payload, "\n")).alias("line")).where(F.col("line").rlike(OBJECT_LINE))
    value = F.regexp_extract("line", OBJECT_LINE, 2)
    return line.select(group, F.regexp_extract("line", OBJECT_LINE, 1).alias("id"), value.alias("value"), F.nullif(F.regexp_extract(value, REFERENCE, 1), F.lit("")).alias("ref"))
