"""Mixing sources to target weights by hash-threshold histograms, in column expressions only.

Each source gets a target number of words. A document is taken ``base`` times (0, 1 or 2: how often the whole source
fits in its target) and once more if its hash lies under the source's threshold. The threshold comes from histograms: sizes are
summed by source and hash bucket, the buckets that fit whole are settled, and only the boundary bucket is split
by the next bits of the hash, until it holds one hash value. Nothing is sorted by document; the decision of a row is a comparison.

Defined results: a null text has size 0; null is a source of its own, last in order; rows are told apart by doc_id, text and, where both are equal,
a running number, so rows without an id or with a shared one are decided one by one; an empty table gives an empty result; columns
other than doc_id, text and source pass through ``mix`` untouched, whatever their names. The choice depends on doc_id and text only, so reruns agree.
Sources are ranked in one task; they are meant to be collections, up to some millions, not single documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from pagemill.llm.common import WORD, discard, unused, written

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2
#: Bits of the hash, and those that a histogram level resolves.
HASH_BITS = 60
LEVEL_BITS = 12
#: Sources up to which the table of thresholds is broadcast.
BROADCAST_SOURCES = 10_000
#: Repeated keys up to which they are broadcast.
BROADCAST_KEYS = 1_000_000


def text_size(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def unit_hash(doc_id: Column, digest: Column, occurrence: Column) -> Column:
    """60 uniform bits of the row's identity as a long: the MD5 of its id, its text's MD5 and its number among equal rows."""
    whole = F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), digest, F.lit(":"), occurrence.cast("string"))
    return F.conv(F.substring(F.md5(whole), 1, 15), 16, 10).cast("long")


def text_digest(text: Column) -> Column:
    return F.md5(F.coalesce(text, F.lit("")))


def occurrences(rows: DataFrame, key: list[str], name: str) -> DataFrame:
    """``rows`` with the column ``name``: 0, 1, .. among rows with equal ``key`` columns.

    Only rows with a repeated key are moved, and a key that many rows share is numbered partition by partition, so it is in no one task.
    """
    repeated = written(rows.groupBy(*key).count().where("count > 1").select(*key), "repeated-keys")
    n = repeated.count()
    if not n:
        return rows.withColumn(name, F.lit(0).cast("long"))
    part, offset = unused(rows, "part"), unused(rows, "offset")

    def beside(left: DataFrame, right: DataFrame, columns: list[str], how: str) -> DataFrame:
        other = {c: unused(left, f"{c}_other") for c in columns}
        right = right.withColumnsRenamed(other)
        on = [F.col(f"`{c}`").eqNullSafe(F.col(f"`{o}`")) for c, o in other.items()]
        joined = left.join(right, on, how)
        return joined.drop(*other.values()) if how == "inner" else joined

    side = F.broadcast(repeated) if n <= BROADCAST_KEYS else repeated
    many = written(beside(rows, side, key, "left_semi").withColumn(part, F.spark_partition_id()), "repeated-rows")
    counts = many.groupBy(*key, part).count()
    before = F.sum("count").over(Window.partitionBy(*key).orderBy(part).rowsBetween(Window.unboundedPreceding, -1))
    counts = counts.select(*key, part, F.coalesce(before, F.lit(0)).alias(offset))
    place = F.row_number().over(Window.partitionBy(*key, part).orderBy(F.lit(0))) - 1
    done = beside(many.withColumn(name, place), counts, [*key, part], "inner").withColumn(name, (F.col(name) + F.col(offset)).cast("long")).drop(part, offset)
    return beside(rows, side, key, "left_anti").withColumn(name, F.lit(0).cast("long")).unionByName(done)


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """(source, source_size, target) from ``sizes(source, size)``: shares by weight, each at most ``most`` times its source's size.

    Excess over that bound is shared again by weight until none is above: the level at which the shares add up is found by running sums
    over the sources in order of bound per weight.
    """
    sources = sizes.groupBy("source").agg(F.coalesce(F.sum("size"), F.lit(0)).alias("source_size"))
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (place % len(weights) + 1).cast("int"))
    ranked = sources.withColumn("w", weight).withColumn("cap", most * F.col("source_size").cast("double")).withColumn("ratio", F.col("cap") / F.col("w"))
    whole = Window.partitionBy()
    before = Window.orderBy("ratio", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    left = F.sum("w").over(whole) - F.coalesce(F.sum("w").over(before), F.lit(0.0))
    budget = share * F.sum("source_size").over(whole).cast("double") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    level = ranked.withColumn("level", budget / left).withColumn("level", F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "level"))).over(whole)["level"])
    return level.select("source", "source_size", F.coalesce(F.least("cap", F.col("level") * F.col("w")), F.col("cap")).alias("target"))


def thresholds(keys: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, source_size, target, base, below): take ``base`` times, and once more where the hash is under ``below``.

    The last hash value is taken if that brings the source nearer to its target.
    """
    base = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("int")
    state = targets.withColumn("base", base).select("*", (F.col("target") - F.col("base") * F.col("source_size")).alias("rest"))
    state = written(state.select("*", F.lit(0).cast("long").alias("prefix"), F.lit(0.0).alias("below_words"), F.lit(None).cast("long").alias("below")), "mix-state")
    n = state.count()
    small = (lambda df: F.broadcast(df)) if n <= BROADCAST_SOURCES else (lambda df: df)
    bits = 0
    while bits < HASH_BITS and state.where("below IS NULL").limit(1).count():
        width = min(LEVEL_BITS, HASH_BITS - bits)
        open_ = state.where("below IS NULL").select(F.col("source").alias("s"), "prefix")
        inside = keys.join(small(open_), keys["source"].eqNullSafe(open_["s"]) & (F.shiftright("u", HASH_BITS - bits) == F.col("prefix")))
        hist = inside.groupBy("source", F.shiftright("u", HASH_BITS - bits - width).alias("bucket")).agg(F.sum("size").alias("words"), F.min("u").alias("lo"), F.max("u").alias("hi"))
        run = Window.partitionBy("source").orderBy("bucket")
        summed = hist.withColumn("upto", F.sum("words").over(run.rowsBetween(Window.unboundedPreceding, 0)))
        rest = state.where("below IS NULL").select(F.col("source").alias("s"), "rest", "below_words")
        over = summed.join(small(rest), summed["source"].eqNullSafe(rest["s"])).where(F.col("below_words") + F.col("upto") > F.col("rest"))
        edge = over.groupBy("source").agg(F.min_by(F.struct("bucket", "words", "upto", "lo", "hi"), "bucket").alias("e"))
        edge = edge.select(F.col("source").alias("s"), "e.*")
        joined = state.join(small(edge), state["source"].eqNullSafe(edge["s"]), "left")
        start = F.col("below_words") + F.col("upto") - F.col("words")
        settled = F.when(F.col("below").isNotNull(), F.col("below")).when(F.col("bucket").isNull(), F.lit(1 << HASH_BITS))
        settled = settled.when(F.col("lo") == F.col("hi"), F.when(2 * start + F.col("words") <= 2 * F.col("rest"), F.col("hi") + 1).otherwise(F.col("hi")))
        closed = F.col("below").isNotNull() | F.col("bucket").isNull()
        last, state = state, written(
            joined.select(
                "source", "source_size", "target", "base", "rest",
                F.when(closed, F.col("prefix")).otherwise(F.col("bucket")).alias("prefix"),
                F.when(closed, F.col("below_words")).otherwise(start.cast("double")).alias("below_words"),
                settled.alias("below"),
            ),
            "mix-state",
        )
        discard(last)
        bits += width
    return state.select("source", "source_size", "target", "base", F.coalesce("below", F.lit(0)).alias("below"))


def decided(rows: DataFrame, limits: DataFrame, u: Column, times: str) -> DataFrame:
    """``rows`` with the columns of ``limits`` (under names of their own) and ``times``, by their source and hash ``u``."""
    names = {c: unused(rows, f"mix_{c}") for c in limits.columns}
    side = limits.withColumnsRenamed(names)
    side = F.broadcast(side) if limits.count() <= BROADCAST_SOURCES else side
    joined = rows.join(side, F.col("source").eqNullSafe(F.col(names["source"])))
    return joined.withColumn(times, F.col(names["base"]) + (u < F.col(names["below"])).cast("int"))


def _keys(docs: DataFrame) -> DataFrame:
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", text_size(F.col("text")).alias("size"), text_digest(F.col("text")).alias("digest"))
    keys = occurrences(written(own, "mix-rows"), ["doc_id", "digest"], "occurrence")
    return keys.select("doc_id", "source", "size", unit_hash(F.col("doc_id"), F.col("digest"), F.col("occurrence")).alias("u"))


def mix_report(docs: DataFrame, weights=WEIGHTS, share: float = SHARE) -> DataFrame:
    """doc_id, size, source_size, target and taken (words the mix takes) of each row of ``docs(doc_id, text, source)``."""
    keys = written(_keys(docs), "mix-keys")
    limits = thresholds(keys, source_targets(keys, weights, share))
    rows = decided(keys, limits, F.col("u"), "times")
    return rows.select("doc_id", "size", F.col("mix_source_size").alias("source_size"), F.col("mix_target").alias("target"), (F.col("size") * F.col("times")).alias("taken"))


def mix(docs: DataFrame, weights=WEIGHTS, share: float = SHARE) -> DataFrame:
    """The mix itself: each document of ``docs`` as many times as it is taken, with its own columns."""
    keys = written(_keys(docs), "mix-keys")
    limits = thresholds(keys, source_targets(keys, weights, share))
    doc_id, digest, number, times, time = (unused(docs, f"mix_{x}") for x in ("doc_id", "digest", "occurrence", "times", "time"))
    marked = docs.withColumns({doc_id: F.col("doc_id").cast("long"), digest: text_digest(F.col("text"))})
    rows = occurrences(marked, [doc_id, digest], number)
    rows = decided(rows, limits, unit_hash(F.col(doc_id), F.col(digest), F.col(number)), times).where(F.col(times) > 0)
    return rows.withColumn(time, F.explode(F.sequence(F.lit(1), F.col(times)))).select(*[F.col(f"`{c}`") for c in docs.columns])
