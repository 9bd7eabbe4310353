"""Queries for single markup passes, chains, cursors and other small operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from pagemill.functions import passes as P, urls as U
from pagemill.operators import chains
from pagemill.sources.tables import table

KEY = b"page cursor key"

# One fragment for each pass: markup with the page's number, and what is left of it. It stands in the page's own markup, at the end of the article.
_CASES = {
    "noscript_images": ("a<noscript><img src='#.png'></noscript>b", "a<img src='#.png'>b"),
    "lazy_images": ("<img class=x data-src='#.png'>", "<img class=x src='#.png'>"),
    "tab_panels": ("<button role=\"tab\">T#</button><div role=\"tabpanel\" hidden>p#</div>", "<div role=\"tabpanel\">p#</div>"),
    "copy_buttons": ("<pre>x#</pre><button class=\"btn copy\">Copy</button>", "<pre>x#</pre>"),
    "screen_reader_text": ("<span class=\"sr-only\">skip</span>#", "#"),
    "live_regions": ("<div aria-live=\"polite\">loading</div>#", "#"),
    "campaign_links": ("<a href=\"/x?utm_source=s\">ad</a><a href=\"/y\">#</a>", "<a href=\"/y\">#</a>"),
    "heading_anchors": ("<h2>T#<a href=\"#t\">#</a></h2>".replace(">#<", ">¶<"), "<h2>T#</h2>"),
    "inline_buttons": ("press the <button>OK#</button> now", "press the OK# now"),
    "badges": ("<span>a</span><span>#</span>", "<span>a</span> <span>#</span>"),
    "alerts": ("<div class=\"alert alert-warning\">w#</div>", "<blockquote>[!WARNING]<br>w#</blockquote>"),
    "code_lines": ("<span class=\"line\">a#</span><span class=\"line\">b</span>", "<span class=\"line\">a#</span>\n<span class=\"line\">b</span>"),
    "table_cells": ("<table><thead><tr><td>h</td></tr></thead><tr><td>a<br>b<br/>c<br>d<br>e|#</td></tr></table>", "<table><thead><tr><th>h</th></tr></thead><tr><td>a b c d e\\|#</td></tr></table>"),
    "definition_lists": ("<dt>t</dt><dd>#</dd>", "<p><b>t</b></p><p>: #</p>"),
    "toc_removed": ("# A\n\n## Contents\n\n" + "- [x](#x)\n- [y](#y)\n" * 10 + "\ntext #", "# A\n\ntext #"),
    "orphans_promoted": ("intro\n\nGetting Started\n\ntext #", "intro\n\n## Getting Started\n\ntext #"),
    "code_editors": ("<pre aria-hidden=\"true\"><span>x</span></pre><textarea>x#</textarea>", "<pre><code>x#</code></pre>"),
}


_MARK = "\x01"


def _dressed(name: str, side: int) -> str:
    """The fragment with its own number signs out of the way of the page's number."""
    text = _CASES[name][side]
    return text.replace("(#x", "(" + _MARK + "x").replace("(#y", "(" + _MARK + "y").replace('"#t', '"' + _MARK + "t").replace("## ", _MARK * 2 + " ").replace("# A", _MARK + " A")


def _fragment(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    number = F.col("page_id").cast("string")
    before = F.replace(F.replace(F.lit(_dressed(name, 0)), F.lit("#"), number), F.lit(_MARK), F.lit("#"))
    whole = F.replace(F.col("html"), F.lit("</article>"), F.concat(F.lit("\n\n"), before, F.lit("\n</article>")))
    return table(spark, sf_dir, "pages").select("page_id", getattr(P, name)(whole).alias("html"))


def _case(name: str):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _fragment(spark, sf_dir, name)

    query.__name__ = f"pass_{name}"
    return query


def redirects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where pages lead if every page whose number isn't a multiple of four redirects to the next one."""
    pages = table(spark, sf_dir, "pages").select("page_id")
    name = lambda c: F.concat(F.lit("https://e.org/"), c.cast("string"))
    moved = F.when(F.col("page_id") % 97 == 1, F.col("page_id")).otherwise(F.col("page_id") + 1)
    responses = pages.select(name(F.col("page_id")).alias("url"), F.when(F.col("page_id") % 8 == 0, 200).otherwise(302).alias("status"), name(moved).alias("location"))
    return chains.followed(pages.select(name(F.col("page_id")).alias("start")), chains.redirect_edges(responses))


def alias_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hosts whose alias chain ends at a blocked address."""
    pages = table(spark, sf_dir, "pages").select("page_id")
    name = lambda c: F.concat(F.lit("h"), c.cast("string"), F.lit(".org"))
    aliases = pages.where("page_id % 3 = 0").select(name(F.col("page_id")).alias("source"), F.when(F.col("page_id") % 2 == 0, F.lit("10.0.0.1")).otherwise(F.lit("8.8.8.8")).alias("target"))
    found = chains.blocked_by_alias(pages.select(name(F.col("page_id")).alias("start")), aliases, U.block_reason(F.col("final")).isNotNull())
    return found.select("start", "final", "hops", "is_blocked")


def page_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strings decoded from payload scripts."""
    script = F.concat(F.lit('<script>self.__next_f.push([1,"a\\nb \\u00e9'), F.col("page_id").cast("string"), F.lit('"])</script><script>self.__next_f.push([1,"x\\"y"])</script>'))
    return table(spark, sf_dir, "pages").select("page_id", F.explode(P.flight_payloads(F.concat(F.col("html"), script))).alias("payload"))


def log_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    fields = F.create_map(F.lit("user"), F.col("user_id").cast("string"), F.lit("accessToken"), F.lit("x"), F.lit("kind"), F.col("event_type"))
    kept = P.logged(fields)
    return table(spark, sf_dir, "events").select("event_id", F.array_join(F.map_keys(kept), ",").alias("keys"), F.array_join(F.map_values(kept), ",").alias("values"))


def cursors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cursors read back: every fourth one is forged and gives null."""
    made = P.cursor(F.col("event_id").cast("string"), KEY)
    value = F.when(F.col("event_id") % 4 == 0, F.concat(made, F.lit("0"))).otherwise(made)
    return table(spark, sf_dir, "events").select("event_id", P.cursor_anchor(value, KEY).alias("anchor"))


def image_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Image sources: placeholders, proxied ones and where these are on the page's own host."""
    src = F.expr("CASE page_id % 5 WHEN 0 THEN '/img/blank.gif' WHEN 1 THEN 'data:image/png;base64,xx' WHEN 2 THEN concat('/img/', CAST(page_id AS STRING), '.png') WHEN 3 THEN concat('https://i1.wp.com/cdn.org/a/', CAST(page_id AS STRING), '.png?w=1') END")
    rows = table(spark, sf_dir, "pages").select("page_id", src.alias("s"), U.host(F.col("url")).alias("h"))
    return rows.select("page_id", P.placeholder_source(F.col("s")).alias("placeholder"), P.proxied(F.col("s")).alias("proxied"), P.unproxied(F.col("s"), F.col("h")).alias("src"), P.host_like(F.col("h")).alias("host_like"), P.kept_address(F.coalesce("s", F.lit("#top"))).alias("kept"))


QUERIES = {f"pass_{n}": _case(n) for n in _CASES} | {f.__name__: f for f in (redirects, alias_policy, page_payloads, log_fields, cursors, image_sources)}


def _expected(name: str) -> str:
    text = _dressed(name, 1).replace("'", "''")
    new = "replace(replace('" + text.replace("\n", "' || chr(10) || '") + "', '#', page_id::VARCHAR), chr(1), '#')"
    return f"SELECT page_id, replace(html, '</article>', chr(10) || chr(10) || {new} || chr(10) || '</article>') AS html FROM pages"


SQL = {f"pass_{n}": _expected(n) for n in _CASES} | {
    "redirects": """WITH RECURSIVE e AS (SELECT page_id AS s, CASE WHEN page_id % 97 = 1 THEN page_id ELSE page_id + 1 END AS t FROM pages WHERE page_id % 8 <> 0),
        r AS (SELECT page_id AS start, page_id AS f, 0 AS hops, NULL::VARCHAR AS error, [page_id] AS seen, false AS done FROM pages
              UNION ALL SELECT start, CASE WHEN list_contains(seen, t) OR hops = 5 THEN f ELSE t END, CASE WHEN list_contains(seen, t) OR hops = 5 THEN hops ELSE hops + 1 END,
                CASE WHEN list_contains(seen, t) THEN 'loop' WHEN hops = 5 THEN 'too-many' END, list_append(seen, t), list_contains(seen, t) OR hops = 5 FROM r JOIN e ON r.f = e.s WHERE NOT done),
        l AS (SELECT *, row_number() OVER (PARTITION BY start ORDER BY len(seen) DESC) AS k FROM r)
        SELECT 'https://e.org/' || start AS start, 'https://e.org/' || f AS final, hops, error FROM l WHERE k = 1""",
    "alias_policy": "SELECT 'h' || page_id || '.org' AS start, CASE WHEN page_id % 6 = 0 THEN '10.0.0.1' WHEN page_id % 3 = 0 THEN '8.8.8.8' ELSE 'h' || page_id || '.org' END AS final, CASE WHEN page_id % 3 = 0 THEN 1 ELSE 0 END AS hops, page_id % 6 = 0 AS is_blocked FROM pages",
    "page_payloads": "SELECT page_id, unnest(['a' || chr(10) || 'b é' || page_id, 'x\"y']) AS payload FROM pages",
    "log_fields": "SELECT event_id, 'user,kind' AS keys, concat_ws(',', user_id::VARCHAR, event_type) AS values FROM events",
    "cursors": "SELECT event_id, CASE WHEN event_id % 4 <> 0 THEN event_id::VARCHAR END AS anchor FROM events",
    "image_sources": """SELECT page_id, page_id % 5 NOT IN (2, 3) AS placeholder, page_id % 5 = 3 AS proxied, CASE page_id % 5 WHEN 0 THEN '/img/blank.gif' WHEN 1 THEN 'data:image/png;base64,xx' WHEN 2 THEN '/img/' || page_id || '.png'
        WHEN 3 THEN 'https://' || regexp_extract(url, '^https?://([^/?#:]+)', 1) || '/a/' || page_id || '.png' END AS src, true AS host_like, page_id % 5 IN (1, 4) AS kept FROM pages""",
}
