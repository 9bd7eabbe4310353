"""Tree queries against their SQL on pages whose titles, items and links are cut inside of references."""

import duckdb
import pytest

from pagemill.operators import elements as E
from pagemill.plans import tree_queries as T

PAGE = "<!DOCTYPE html><html><head><title>{0}</title></head><body><nav><ul><li><a href='/x'>{0}</a></li></ul></nav><article><h1>{0}</h1><p><b>{0}</b> and more.<br>{0}<p>{1}</p></article><footer>&copy; e.org</footer></body></html>"
CUTS = [r[:k] for r in ("&amp;", "&quot;", "&lt;") for k in range(1, len(r) + 1)] + ["&ampquot;", "&amp;quot;", "&amp&quot", "&ampx", "&&", "&amp;&quot;&am", "&quotx;"]


@pytest.fixture(scope="module")
def cut(spark, tmp_path_factory):
    """A folder with the pages, and the answer of a query's SQL over them."""
    folder = str(tmp_path_factory.mktemp("cut"))
    words = "Some words of it, and some more. " * 9
    rows = [(i, f"https://e.org/{i}.html", PAGE.format("T &amp; a" + c, words)) for i, c in enumerate(CUTS)]
    spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1).write.parquet(f"{folder}/pages.parquet")
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW pages AS SELECT * FROM '{folder}/pages.parquet/*.parquet'")
    return folder, lambda name: sorted(duck.execute(T.SQL[name]).fetchall())


def answer(spark, folder, name):
    return sorted(map(tuple, T.QUERIES[name](spark, folder).collect()))


def test_references_are_decoded_whole_but_for_ampersands():
    for text, right in {"&quot": "&quot", "&quot;": '"', "&amp": "&", "&amp;": "&", "&ampx;": "&x;", "&amp;lt;": "&lt;", "&ampquot;": "&quot;", "&amp&lt;": "&<", "&#65;&#65 &#x": "A&#65 &#x", "&copy=2 &copy; &bogus; &": "&copy=2 © &bogus; &"}.items():
        assert E.whole_references_and_ampersands(text) == right


def test_code_previews_of_cut_texts(spark, cut):
    folder, right = cut
    assert answer(spark, folder, "code_previews") == right("code_previews")


def test_element_texts_of_cut_texts(spark, cut):
    folder, right = cut
    assert answer(spark, folder, "element_texts") == right("element_texts")


@pytest.mark.parametrize("name", ["nested_noise", "content_scores"])
def test_content_of_cut_texts(spark, cut, name):
    folder, right = cut
    assert answer(spark, folder, name) == right(name)
