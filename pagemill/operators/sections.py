"""Sections of Markdown texts as rows, and putting new ones in their places."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from pagemill.functions import markdown as M

_CUT = "\x1e"


def heading_key(title: Column) -> Column:
    """What headings are compared by: lower case, without marks and punctuation at their ends, runs of spaces as one."""
    return F.btrim(F.regexp_replace(F.lower(F.regexp_replace(title, r"^#{1,6}\s+|[`*_\[\]]", "")), r"[\s:.!?]+", " "))


def section_rows(texts: DataFrame, key: str, text: str) -> DataFrame:
    """(key, n, heading, level, body): the parts of each text that begin with a heading outside fences, in order; n is 0 for what stands before the first. Together the bodies are the text."""
    cut = M.outside_fences(F.col(text), lambda s: F.regexp_replace(F.replace(s, F.lit(_CUT), F.lit("")), r"(?m)^(?=#{1,6}[ \t])", _CUT))
    parts = texts.select(F.col(key), F.posexplode(F.split(cut, _CUT)).alias("n", "body"))
    line = F.when(F.col("n") > 0, F.split_part(F.col("body"), F.lit("\n"), F.lit(1)))
    return parts.select(key, "n", heading_key(line).alias("heading"), F.length(F.regexp_extract(line, r"^#+", 0)).alias("level"), "body")


def upserted(texts: DataFrame, sections: DataFrame, key: str, text: str) -> DataFrame:
    """(key, text) with ``sections(key, title, content)`` put in: in place of the first section with that heading, its own subsections included, else at the end, in order of titles.

    A full outer merge of two tables of sections, and one ordered aggregation back; texts without new sections stay as they are. A null text with new sections consists of these.
    """
    rows = section_rows(texts.where(F.col(text).isNotNull()), key, text)
    new = sections.groupBy(key, heading_key(F.col("title")).alias("heading")).agg(F.min(F.struct("title", "content")).alias("s")).select(key, "heading", F.col("s.title").alias("title"), F.col("s.content").alias("content"))
    order = Window.partitionBy(key).orderBy("n").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    first = F.row_number().over(Window.partitionBy(key, "heading").orderBy("n")) == 1
    marked = rows.withColumn("first", first & (F.col("n") > 0))
    met = marked.join(new.withColumnRenamed("heading", "_h").withColumnRenamed(key, "_k"), F.col(key).eqNullSafe(F.col("_k")) & (F.col("heading") == F.col("_h")) & F.col("first"), "full")
    whole = met.select(F.coalesce(key, "_k").alias(key), "n", "level", "body", "title", "content")
    # a section reaches to the next heading of its level or above: the subsections of a replaced one go with it
    replaced = F.last(F.when(F.col("title").isNotNull() & F.col("n").isNotNull(), F.struct("n", "level")), ignorenulls=True).over(order)
    since = Window.partitionBy(key, "_in.n").orderBy("n").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    highest = F.min(F.when(F.col("n") > F.col("_in.n"), F.col("level"))).over(since)
    fresh = F.concat(F.repeat(F.lit("#"), F.coalesce("level", F.lit(2))), F.lit(" "), F.col("title"), F.lit("\n\n"), F.col("content"), F.lit("\n\n"))
    kept = whole.withColumn("_in", replaced).withColumn("_high", highest).where("_in IS NULL OR n IS NULL OR n = _in.n OR coalesce(_high, 0) <= _in.level")
    piece = F.when(F.col("content").isNull(), F.col("body")).when(F.col("n").isNull(), F.concat(F.lit("\n\n"), F.rtrim(fresh, F.lit("\n")))).otherwise(fresh)
    parts = F.array_sort(F.collect_list(F.struct(F.col("n").isNull().alias("late"), F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("title", F.lit("")).alias("title"), piece.alias("piece"))))
    return kept.groupBy(key).agg(F.array_join(F.transform(parts, lambda x: x["piece"]), "").alias(text))
