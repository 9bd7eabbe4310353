"""Quoted documents against their SQL, and list items that begin with empty paragraphs."""

import re

import duckdb
import pytest

from pagemill.plans import tree_queries as T
from pagemill.plans.page_queries import to_markdown

TEXTS = [
    "plain", None, "", " ", "\n", " \t\r\n ", "\xa0", "\xa0 \n", "x\x1fy", "\x1f", "[!NOTE]", "[!NOTE]\n", "[!NOTE]\nmore", "```\ncode", "a \n\n \t b\r\nc", "&quot &amp; &lt;b> &#65;", "| a | b |", "- x\n- y", "> q", " x　", "é\x0b\x0c\x85", "x" * 100_000,
]


def test_quoted_documents_without_text_and_with_signs(spark, tmp_path):
    """Empty, blank and missing texts, signs that mark cells and notes, ids that repeat or are missing."""
    rows = list(enumerate(TEXTS)) + [(0, "again"), (0, "again"), (None, "no id"), (None, None)]
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    order = lambda r: (str(r[0]), r[1])
    right = sorted(duck.execute(T.SQL["quoted_documents"]).fetchall(), key=order)
    assert sorted(map(tuple, T.quoted_documents(spark, str(tmp_path)).collect()), key=order) == right


ITEMS = {
    "<ul><li><p></p><p>a</p><li><p> </p><li>b</ul>": ("- \n\n    a\n- \n- b", "- a\n- b"),
    "<ul><li><p></p><ul><li>x</ul></ul>": ("- \n  - x", "- - x"), "<ol start=4><li><p></p><p></p>x</ol>": ("4. \n\n    x", "4. x"), "<ul><li>x<p></p><li>y</ul>": ("- x\n- y",) * 2,
    "<blockquote><p></p></blockquote>z": ("z",) * 2, "<p></p><p>z</p>": ("z",) * 2, "<ul><li></ul>z": ("z",) * 2, "<ul><li><blockquote><p></p>q</blockquote></ul>": ("- > q",) * 2,
    "<div class='alert alert-note'>[!TIP]</div><div class='admonition tip'><p>t</p></div><p>[!NOTE]</p><p>z</p>": ("> [!NOTE]\n> [!TIP]\n\n> [!TIP]\n> t\n\n[!NOTE]\n\nz",) * 2,
    "<table><tr><td>a\x1fb</td><td>c</td></tr></table><p>d\x1fe</p>": ("| a b | c |\n| --- | --- |\n\nd\x1fe",) * 2,
}


@pytest.mark.parametrize("empty_items", [True, False])
def test_items_that_begin_with_an_empty_paragraph(spark, empty_items):
    pages = spark.createDataFrame(list(enumerate(ITEMS)), "page_id long, html string")
    got = {r["page_id"]: r["markdown"] for r in to_markdown(pages, "page_id", empty_items=empty_items).collect()}
    assert [got[i] for i in range(len(ITEMS))] == [x[0 if empty_items else 1] for x in ITEMS.values()]


def test_empty_items_of_the_region(spark):
    """The list around a region gives no marks and no empty lines to it."""
    page = "<ul><li><article><p></p><p>" + "words of it " * 20 + "</p><ul><li><p></p><li>b</ul></article></ul>"
    row = to_markdown(spark.createDataFrame([(1, page)], "page_id long, html string"), "page_id", empty_items=True).collect()[0]
    assert row["markdown"].startswith("- \n\n    words") and row["region_markdown"] == ("words of it " * 20).strip() + "\n\n- \n- b"


def test_generated_functions_with_empty_items_are_small(spark):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        frame = to_markdown(spark.createDataFrame([(1, "<p>a")], "page_id long, html string"), "page_id", empty_items=True).select("page_id", "markdown")
        kind = spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("codegen")
        sizes = [int(n) for n in re.findall(r"maxMethodCodeSize:(\d+)", frame._jdf.queryExecution().explainString(kind))]
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert sizes and max(sizes) < 8000
