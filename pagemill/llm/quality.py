"""Quality rules as a short-circuit cascade, in column expressions only.

Every rule rejects a document or lets it pass. On a bounded sample each rule's cost (time of a
job that evaluates only that rule) and selectivity (share rejected) are measured; rules then run in
descending rejection per cost inside one ``CASE WHEN``, so a document stops at the first rule that rejects
it. The order changes the cost only: a document is kept exactly if no rule rejects it.

Defined results: a null or empty text has no words and is rejected by ``few_words``; repeated rows each get
their own verdict; an empty table gives an empty result; extra columns pass through; ties in the order
keep the order in which the rules are listed.
"""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, functions as F

from pagemill.llm.common import bound, discard, words, written

#: Words in a window whose repetition counts.
WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
MAX_SYMBOL_PERCENT = 20
MAX_DUP_LINE_PERCENT = 30
LEAST_DUP_LINES = 3
MEAN_WORD_CHARS = (2, 15)
#: Rows, about, of the sample on which cost and selectivity are estimated.
SAMPLE_ROWS = 1000
#: Files that the sample is drawn from.
SAMPLE_FILES = 16


def n_words(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def word_chars(text: Column) -> Column:
    return F.length(F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", "")).cast("long")


def n_symbols(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[#*$%&|<>]")).cast("long")


def _word_lines(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))


def n_dup_lines(text: Column) -> Column:
    return bound(_word_lines(text), lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long")


def repeats_lines(text: Column) -> Column:
    """Whether at least ``LEAST_DUP_LINES`` lines with a word, and over ``MAX_DUP_LINE_PERCENT`` of them, equal an earlier line."""
    dup = lambda x: F.size(x) - F.size(F.array_distinct(x))
    return bound(_word_lines(text), lambda x: bound(dup(x), lambda n: (n >= LEAST_DUP_LINES) & (100 * n > MAX_DUP_LINE_PERCENT * F.size(x))))


def _repeat_words(w: Column, window: int) -> Column:
    """Of a words array: windows get a 64-bit hash by doubling (1, 2, 4, 8 words); equal hashes are equal windows of the text.

    A text without equal windows, the usual case, costs one distinct count; else the windows are sorted by hash and
    the union of the repeated ones is measured.
    """
    if window & (window - 1):
        raise ValueError("the window must be a power of two")

    def covered(starts: Column) -> Column:
        step = lambda acc, i: F.struct((acc["n"] + F.least(F.lit(window), i - acc["last"])).alias("n"), i.alias("last"))
        first = F.struct(F.lit(0).alias("n"), F.lit(-window).alias("last"))
        return F.aggregate(starts, first, step, lambda acc: acc["n"])

    def repeated(hashes: Column) -> Column:
        ordered = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        same = lambda s: lambda e, k: F.coalesce(F.get(s, k - 1)["h"] == e["h"], F.lit(False)) | F.coalesce(F.get(s, k + 1)["h"] == e["h"], F.lit(False))
        starts = bound(ordered, lambda s: F.array_sort(F.transform(F.filter(s, same(s)), lambda e: e["i"])))
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(covered(starts))

    def joined(width: int):
        return lambda h: F.transform(h, lambda x, i: F.xxhash64(x, F.get(h, i + width)))

    hashes, width = F.transform(w, lambda x: F.xxhash64(x)), 1
    while width < window:
        hashes, width = bound(hashes, joined(width)), 2 * width
    whole = F.slice(hashes, 1, F.greatest(F.lit(0), F.size(w) - F.lit(window - 1)))
    return F.when(F.size(w) <= window, F.lit(0)).otherwise(bound(whole, repeated)).cast("long")


def n_repeat_words(text: Column, window: int = WINDOW) -> Column:
    """Words that lie in a ``window``-word window found twice or more in the text, the first place included."""
    return bound(words(text), lambda w: _repeat_words(w, window))


def repeats_too_much(text: Column) -> Column:
    return bound(words(text), lambda w: 100 * _repeat_words(w, WINDOW) > MAX_REPEAT_PERCENT * F.size(w))


def word_counts(text: Column) -> Column:
    """struct<n_words, word_chars, n_repeat_words>, with the text split once."""
    chars = lambda w: F.length(F.array_join(w, "")).cast("long")
    return bound(words(text), lambda w: F.struct(F.size(w).cast("long").alias("n_words"), chars(w).alias("word_chars"), _repeat_words(w, WINDOW).alias("n_repeat_words")))


@dataclass(frozen=True)
class Rule:
    """``reject`` maps the text column to a boolean column, true for documents to drop."""

    name: str
    reject: object


RULES = (
    Rule("few_words", lambda t: n_words(t) < MIN_WORDS),
    Rule("symbols", lambda t: 100 * n_symbols(t) > MAX_SYMBOL_PERCENT * n_words(t)),
    Rule("word_length", lambda t: (word_chars(t) < MEAN_WORD_CHARS[0] * n_words(t)) | (word_chars(t) > MEAN_WORD_CHARS[1] * n_words(t))),
    Rule("repeated_lines", repeats_lines),
    Rule("repeated_words", repeats_too_much),
)


def some_files(docs: DataFrame, files: int = SAMPLE_FILES) -> DataFrame:
    """About ``files`` of the table's files, picked by a hash of their paths, of which alone the sample then reads texts; all of a table that isn't files, or has few."""
    many = len(docs.inputFiles())
    if many <= files:
        return docs
    try:
        return docs.where(F.pmod(F.xxhash64("_metadata.file_path"), F.lit(many)) < files)
    except AnalysisException:
        return docs


def measured(docs: DataFrame, rules=RULES, text: str = "text", sample_rows: int = SAMPLE_ROWS) -> list[tuple[Rule, float, float]]:
    """Each rule with its cost (seconds over the sample, beyond a plain scan of it) and the share it rejects.

    The sample is drawn from files all over the table; it decides the order of the rules only.
    """
    part = some_files(docs)
    rows = part.count()
    drawn = part.select(F.col(text).alias("text")).sample(min(1.0, sample_rows / max(1, rows)), seed=1)
    sample = written(drawn.repartition(1), "rule-sample")
    try:
        def run(column: Column) -> tuple[float, tuple]:
            best, row = float("inf"), None
            for _ in range(2):
                began = time.perf_counter()
                row = sample.agg(F.count(F.lit(1)), F.count_if(column)).first()
                best = min(best, time.perf_counter() - began)
            return best, row

        floor, (rows, _) = run(F.octet_length("text") < 0)
        found = []
        for rule in rules:
            cost, (_, rejected) = run(rule.reject(F.col("text")))
            found.append((rule, max(cost - floor, 1e-4), rejected / rows if rows else 0.0))
        return found
    finally:
        discard(sample)


def cascade_order(docs: DataFrame, rules=RULES, text: str = "text", sample_rows: int = SAMPLE_ROWS) -> list[Rule]:
    """``rules`` in descending rejection per cost; among rules that reject nothing, cheaper ones first."""
    found = measured(docs, rules, text, sample_rows)
    return [r for r, _, _ in sorted(found, key=lambda x: (-x[2] / x[1], x[1]))]


def first_rejection(rules: list[Rule], text: Column) -> Column:
    """Name of the first rule, in the given order, that rejects the text; null if none does."""
    out = None
    for rule in rules:
        name = F.lit(rule.name)
        out = F.when(rule.reject(text), name) if out is None else out.when(rule.reject(text), name)
    return out if out is not None else F.lit(None).cast("string")


def quality_filter(docs: DataFrame, rules=RULES, text: str = "text", sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """The documents which no rule rejects, with their own columns."""
    order = cascade_order(docs, rules, text, sample_rows)
    return docs.filter(first_rejection(order, F.col(text)).isNull())


def quality_report(docs: DataFrame, rules=RULES, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """doc_id, the base counts, the base verdict and the cascade's verdict of each row of ``docs(doc_id, text)``."""
    order = cascade_order(docs, [r for r in rules if r.name not in ("few_words", "repeated_words")], "text", sample_rows)
    text = F.col("text")
    counts = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), "text", word_counts(text).alias("c"), n_symbols(text).alias("n_symbols"), _word_lines(text).alias("lines")
    )
    dup = F.size("lines") - F.size(F.array_distinct("lines"))
    failed = (F.col("c.n_words") < MIN_WORDS) | (100 * F.col("c.n_repeat_words") > MAX_REPEAT_PERCENT * F.col("c.n_words"))
    rejected = F.when(failed, F.lit("base")).otherwise(first_rejection(order, text))
    return counts.select(
        "doc_id", "c.n_words", "c.word_chars", "n_symbols", dup.cast("long").alias("n_dup_lines"), "c.n_repeat_words",
        failed.alias("base_failed"), rejected.isNull().alias("kept"),
    )
