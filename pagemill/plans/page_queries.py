"""Page and text queries: metadata, links, cleaning, Markdown."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from pagemill.functions import encoding as E, html as H, markdown as M, metadata as D, passes as P, urls as U
from pagemill.operators import blocks, content, elements, previews
from pagemill.sources.tables import spread_table, table

FETCHED_AT = "2024-01-31 00:00:00"


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages")


def _with_tags(pages: DataFrame) -> DataFrame:
    """Pages with social tags, icon and dates in their heads, which the plain table lacks."""
    tags = F.concat(
        F.lit('<head><meta property="og:title" content="Page '), F.col("page_id").cast("string"), F.lit(' &amp; more"><meta name="description" content="first"><meta content="second" name="description">'),
        F.when(F.col("page_id") % 2 == 0, F.lit('<meta name="author" content=" Ann ">')).otherwise(F.lit("")),
        F.lit('<link rel="icon" href="/favicon.ico"><meta property="article:published_time" content="2024-01-01">'),
    )
    return pages.withColumn("html", F.replace("html", F.lit("<head>"), tags))


def decoded(pages: DataFrame) -> DataFrame:
    """``pages(page_id, url, body, content_type)`` with ``html``, decoded as the byte order mark, the header, the document or UTF-8 says, and ``body_error``."""
    body, kind = F.col("body"), F.col("content_type")
    fault = F.when(~E.is_text_type(kind), "unsupported_type").when(E.is_binary(body, E.header_charset(kind)) & E.bom_encoding(body).isNull(), "binary_content")
    rows = pages.select("*", E.encoding(body, kind).alias("encoding"), fault.alias("body_error"))
    fine = F.col("body_error").isNull()
    plain = rows.withColumn("_plain", F.when(fine, E.plainly_decoded(body, F.col("encoding"))))
    # only what isn't plain goes through Python
    rest = E.decoded(F.when(fine & F.col("_plain").isNull(), body), F.col("encoding"))
    return plain.select(*pages.columns, "encoding", "body_error", F.coalesce("_plain", rest).alias("html"))


def is_raw_page(html: Column, url: Column) -> Column:
    """Whether a page passes as the Markdown or plain text that it is: by its address, unless it is an HTML document, or by its content."""
    document = F.btrim(html, F.lit(" \t\r\n")).rlike(r"(?i)^(?:<!doctype|<html)")
    structural = html.rlike("(?i)<(?:" + "|".join(M.STRUCTURAL_TAGS) + r")\b")
    return F.coalesce(F.when(U.is_raw_text(url), ~document).otherwise(M.is_raw_text(html) & ~structural), F.lit(False))


def gates(rows: DataFrame) -> DataFrame:
    """``rows(region, body)`` with ``gate_failed``: the first gate that the region of content fails against the page, or null."""
    plain = F.regexp_replace(H.unescaped(F.regexp_replace(F.regexp_replace(F.col("region"), r"(?i)<br\b[^<>]*>|</?(?:p|div|li|h[1-6]|tr)\b[^<>]*>", "\n"), r"<[^<>]*+>", "")), r"\n\s+", "\n")
    sized = rows.select("*", F.length(H.visible_text(F.col("region"))).alias("region_size"), F.length(H.visible_text(F.col("body"))).alias("body_size"), M.has_truncated_sentences(plain).alias("cut"), M.few_empty_sections(F.col("region")).alias("filled"))
    gate = (
        F.when(F.col("region").isNull(), "no-region").when(~M.enough_content(F.col("region_size"), F.col("body_size")), "content-ratio")
        .when(~M.keeps_enough(F.col("region"), F.col("body")), "retention").when(F.col("cut"), "truncated-sentences").when(~F.col("filled"), "empty-sections")
    )
    return sized.select(*rows.columns, gate.alias("gate_failed"))


def content_rows(pages: DataFrame, key: str, payload: tuple[str, ...] = (), rules: content.Rules = content.Rules(), html: str = "html", decode=elements.references.unescape) -> DataFrame:
    """The element rows of each page's content: without noise, scored, with the region chosen."""
    rows = content.judged(elements.element_rows(pages, key, html, payload, decode), rules)
    if rules.previews:
        figures = pages.where(F.col(html).rlike("(?i)<figure") & F.col(html).rlike("(?i)<pre"))
        rows = previews.without(rows, previews.redundant(elements.element_rows(figures, key, html, decode=decode), key), key)
    return content.regions(content.scored(content.cleaned_rows(rows, key, rules), key), key)


def to_markdown(pages: DataFrame, key: str, payload: tuple[str, ...] = (), rules: content.Rules = content.Rules(), html: str = "html", host: str = "CAST(NULL AS STRING)", decode=elements.references.unescape, empty_items: bool = False) -> DataFrame:
    """(key, payload, markdown, region_markdown, body, region) of each page: Markdown and markup of its content, and of the region of main content, if one was found.

    ``empty_items``: whether the mark of a list item that begins with an empty paragraph stands on a line of its own.
    """
    pieces = blocks.pieces(content_rows(pages, key, payload, rules, html, decode), key, host)
    return blocks.pages(blocks.lines(blocks.blocks(pieces, key, payload, empty_items), key, empty_items), key, payload)


def render(pages: DataFrame, fetched_at: str = FETCHED_AT, inline_limit: int = 0, rules: content.Rules = content.Rules()) -> DataFrame:
    """The output record of each page of ``pages(page_id, url, html)``: address, title, metadata, Markdown, size, where the content came from, which gate failed.

    The address is normalized, rewritten to raw content where it can be, and normalized again. A raw page keeps its text, with a line for its
    source. Others become rows of their element trees, which are shuffled once, by page: noise goes at any depth, the region of main content is
    found by name or by score and used if it passes the gates, else the whole body; links are made absolute, and the metadata follow as a footer.
    Texts are decoded as titles are: a character reference without its semicolon stays as it stands. ``inline_limit`` bounds the Markdown's length (0: no bound).
    """
    # a table whose addresses are no URLs is rendered all the same, with the address as it stands
    base = U.with_target(pages.select("page_id", "url", "html")).withColumn("binary", E.looks_binary(F.col("html")))
    raw = base.withColumn("raw", is_raw_page(F.col("html"), F.col("resolved_url")))
    found = raw.select("*", D.limited(D.metadata(F.col("html"), F.col("resolved_url"))).alias("metadata"), H.primary_heading(F.col("html")).alias("heading"), U.host(F.col("resolved_url")).alias("host"))
    # pages are told apart by a number of their own: page_id may repeat or be missing
    page = F.struct("page_id", "url", "resolved_url", "url_error", "binary", "raw", "metadata", "heading", "host", F.when(F.col("raw"), F.col("html")).alias("text"))
    parts = to_markdown(found.select(F.monotonically_increasing_id().alias("page_row"), page.alias("page"), F.when(~F.col("raw"), F.col("html")).alias("markup")), "page_row", ("page",), rules, "markup", "page.host", elements.whole_references)
    judged = gates(parts)
    kind = F.when(F.col("page.raw"), "raw").when(F.col("gate_failed").isNull(), "article").otherwise("document")
    prefers = M.prefers_heading(F.col("page.heading"), F.col("page.metadata.title")) | U.is_repository_root(F.col("page.resolved_url")) & F.col("page.heading").isNotNull()
    title = F.when(F.col("page.raw"), M.raw_title(F.col("page.text"))).when(prefers, F.col("page.heading")).otherwise(F.col("page.metadata.title"))
    chosen = judged.select(
        "page.*", title.alias("title"), kind.alias("source_kind"), F.when(~F.col("page.raw"), F.col("gate_failed")).alias("gate_failed"),
        F.when(F.col("gate_failed").isNull(), F.col("region_markdown")).otherwise(F.col("markdown")).alias("content"),
    )
    text = chosen.withColumn("text", F.when(F.col("raw"), M.with_source(F.col("text"), F.col("resolved_url"))).otherwise(M.cleaned(F.col("content"), keep_empty_headings=True)))
    linked = text.withColumn("text", M.links_resolved(F.col("text"), F.col("resolved_url")))
    headed = linked.withColumn("text", F.when(F.col("raw"), F.col("text")).otherwise(M.titled(M.repository_heading_stripped(F.col("text"), F.col("heading"), F.col("resolved_url")), F.col("title"))))
    footer = M.footer(F.col("title"), F.col("metadata.author"), F.col("resolved_url"), F.lit(fetched_at).cast("timestamp"), F.col("metadata.description"))
    closed = headed.withColumn("text", F.when(F.col("raw"), F.col("text")).otherwise(F.concat(M.without_leading_chrome(M.without_empty_sections(F.col("text"))), F.lit("\n\n"), footer)))
    limited = closed.withColumn("inline", M.inline_limited(F.when(F.col("binary"), F.lit("")).otherwise(F.col("text")), inline_limit))
    return limited.select(
        "page_id", "url", "resolved_url", "title", "metadata", F.col("inline.content").alias("markdown"), F.lit(fetched_at).alias("fetched_at"), "source_kind", "gate_failed",
        F.when(F.col("binary"), "binary_content").otherwise(F.col("url_error")).alias("error"), E.utf16_length(F.col("inline.content")).alias("content_size"), F.col("inline.truncated").alias("truncated"),
    )


def page_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return render(spread_table(spark, sf_dir, "pages")).drop("metadata")


def limited_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same within 1000 characters a page."""
    return render(_pages(spark, sf_dir), inline_limit=1000).select("page_id", "markdown", "content_size", "truncated")


def decoded_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages sent as UTF-8, as UTF-16 with a mark and as UTF-16 by header come back as they were; a fifth come as an image."""
    html, k = F.col("html"), F.col("page_id") % 5
    body = F.when(k == 0, F.encode(html, "UTF-8")).when(k == 1, F.concat(F.lit(b"\xff\xfe"), F.encode(html, "UTF-16LE"))).when(k == 2, F.encode(html, "UTF-16BE")).when(k == 3, F.concat(F.lit(b"\x89PNG"), F.encode(html, "UTF-8"))).otherwise(F.encode(html, "UTF-8"))
    header = F.when(k == 0, "text/html").when(k == 2, "text/html; charset=UTF-16BE").when(k == 4, "image/png")
    rows = decoded(_pages(spark, sf_dir).select("page_id", "url", body.alias("body"), header.alias("content_type")))
    return rows.select("page_id", "html", "body_error")


def source_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where content comes from; a third of the pages are raw Markdown, by content or by address."""
    third = F.col("page_id") % 3
    html = F.when(third == 1, F.concat(F.lit("# Title\n\n"), H.visible_text(F.col("html")))).otherwise(F.col("html"))
    return render(_pages(spark, sf_dir).withColumn("html", html)).groupBy("source_kind", "gate_failed").agg(F.count(F.lit(1)).alias("n"))


def page_title(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pages(spark, sf_dir).select("page_id", D.title_tag(F.col("html")).alias("title"), H.primary_heading(F.col("html")).alias("heading"))


def page_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _with_tags(_pages(spark, sf_dir)).select("page_id", D.limited(D.metadata(F.col("html"), F.col("url"))).alias("m"))
    return rows.select("page_id", *[F.col(f"m.{f}").alias(f) for f in D.FIELDS])


def head_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metadata of the head alone, merged under that of the whole page."""
    url, html = F.col("url"), F.col("html")
    rows = _with_tags(_pages(spark, sf_dir)).select("page_id", D.merged(D.head_metadata(html, url), D.metadata(html, url)).alias("m"))
    return rows.select("page_id", "m.title", "m.description", "m.author")


def head_section(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pages(spark, sf_dir).select("page_id", H.head_section(F.col("html")).alias("head"))


def document_title(spark: SparkSession, sf_dir: str) -> DataFrame:
    url = F.when(F.col("page_id") % 2 == 0, F.concat(F.lit("https://github.com/org/repo"), F.col("page_id").cast("string"))).otherwise(F.col("url"))
    return _pages(spark, sf_dir).select("page_id", D.document_title(F.concat(F.lit("GitHub - x/y: "), F.col("page_id").cast("string")), url).alias("title"))


def title_matches_heading(spark: SparkSession, sf_dir: str) -> DataFrame:
    html = F.col("html")
    title = F.concat(H.primary_heading(html), F.lit(" | Site"))
    return _pages(spark, sf_dir).select("page_id", M.prefers_heading(H.primary_heading(html), title).alias("prefer"), M.prefers_heading(F.lit("no such title"), title).alias("other"))


def tag_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Start tags by name over all pages: the row form of the documents."""
    return H.tokens(_pages(spark, sf_dir)).where("kind = 'start'").groupBy("name").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("page_id").alias("n_pages"))


def token_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.tokens(_pages(spark, sf_dir)).groupBy("page_id", "kind").agg(F.count(F.lit(1)).alias("n"))


def page_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.links(_pages(spark, sf_dir))


def resolved_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The targets of all links as absolute addresses."""
    pages = _pages(spark, sf_dir).select("page_id", "url")
    found = H.links(_pages(spark, sf_dir))
    href = F.concat(F.lit("../x/./"), F.col("pos").cast("string"), F.lit(".html"))
    return found.join(pages, "page_id").select("page_id", "pos", U.resolved(F.col("href"), F.col("url")).alias("target"), U.resolved(href, F.lit("https://a.org/b/c/d.html")).alias("relative"), U.has_campaign(F.coalesce("href", F.lit(""))).alias("campaign"))


def noise_markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pages(spark, sf_dir).select("page_id", H.may_have_noise(F.col("html")).alias("may_have_noise"))


def retention_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    html = F.col("html")
    return _pages(spark, sf_dir).select("page_id", H.tag_count(html, "h[1-6]").alias("headings"), H.tag_count(html, "a").alias("anchors"), H.tag_count(html, "p").alias("paragraphs"), H.tag_count(html, "img").alias("images"))


def visible_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pages(spark, sf_dir).select("page_id", H.visible_text(F.col("html")).alias("text"))


def stripped_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages without scripts, styles, comments and navigation."""
    return _pages(spark, sf_dir).select("page_id", H.without_elements(H.without_comments(F.col("html")), ("script", "style", "nav", "footer")).alias("html"))


def content_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The gates of the region of content against the page; the article of every fourth page has a table left out, that of every fifth is cut to its heading."""
    k = F.col("page_id")
    html = F.when(k % 4 == 0, F.replace("html", F.lit("</body>"), F.lit("<table><tr><td>x</td></tr></table></body>"))).when(k % 5 == 0, F.regexp_replace("html", r"(?s)</h1>(.*)</article>", "</h1><p>short, but long enough to be a region of its own: over one hundred characters of inner markup, to be sure.</p></article><div>$1</div>")).otherwise(F.col("html"))
    rows = _pages(spark, sf_dir).select("page_id", H.cleaned(H.body_section(html)).alias("body")).withColumn("region", H.content_region(F.col("body")))
    return gates(rows).select("page_id", F.col("region").isNotNull().alias("has_region"), "gate_failed")


def truncated_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", M.has_truncated_sentences(F.col("text")).alias("truncated"))


def raw_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which texts are Markdown rather than HTML: half the documents get a heading, a quarter a document type."""
    lead = F.expr("CASE doc_id % 4 WHEN 0 THEN '# Title\n\n' WHEN 1 THEN '<!DOCTYPE html>\n# x\n' WHEN 2 THEN '---\ntitle: T\n---\n' ELSE '' END")
    return table(spark, sf_dir, "documents").select("doc_id", M.is_raw_text(F.concat(lead, F.col("text"))).alias("is_raw"))


def raw_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    lead = F.expr("CASE doc_id % 3 WHEN 0 THEN concat('---\ntitle: \"T', CAST(doc_id AS STRING), '\"\nlang: x\n---\n') WHEN 1 THEN concat('## Part ', CAST(doc_id AS STRING), '\n') ELSE '' END")
    return table(spark, sf_dir, "documents").select("doc_id", M.raw_title(F.concat(lead, F.col("text"))).alias("title"))


def source_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A source line under the first heading of every second document, and on top of the others."""
    text = F.concat(F.when(F.col("doc_id") % 2 == 0, F.lit("intro\n# Head\nbody\n")).otherwise(F.lit("plain\n")), F.replace(F.col("text"), F.lit("#"), F.lit("")))
    return table(spark, sf_dir, "documents").select("doc_id", M.with_source(text, F.concat(F.lit("https://e.org/"), F.col("doc_id").cast("string"))).alias("markdown"))


def footers(spark: SparkSession, sf_dir: str) -> DataFrame:
    author = F.when(F.col("page_id") % 2 == 0, "Ann")
    return _pages(spark, sf_dir).select("page_id", M.footer(D.title_tag(F.col("html")), author, F.col("url"), F.lit(FETCHED_AT).cast("timestamp"), F.lit(None).cast("string")).alias("footer"))


def cleaned_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The clean-up over whole documents dressed with the artefacts that it removes, fenced code untouched."""
    lead = F.lit("Edit this page\n\n# Title [#](#title)\nWas this page helpful?\n\n## Empty\n\n## Next\n\nEnd.Start [a](b)[c](d)\n\n```\nEnd.Start\n```\n\n")
    return table(spark, sf_dir, "documents").select("doc_id", M.cleaned(F.concat(lead, F.col("text"))).alias("markdown"))


def tidied_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole documents, as one line of plain words each, between artefacts: what is around is put right, what is between stays."""
    words = F.regexp_replace("text", r"[^\p{L}\p{N} ]+", " ")
    text = F.concat(F.lit("# Title [#](#t)\nsee` a. b `x [`c](d)[e](f)g\n[Skip to content](#main)\n"), F.lit("w "), words, F.lit("w\n- item\nt\\-u \\[v\\]\n- \\-\na: \"x\"b: \"y\"\n| <b> | c |"))
    return table(spark, sf_dir, "documents").select("doc_id", M.lines_tidied(text).alias("markdown"))


def code_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    code = F.expr("""CASE event_id % 6 WHEN 0 THEN 'def f(x):\n    return None' WHEN 1 THEN 'SELECT a FROM b' WHEN 2 THEN 'npm install x' WHEN 3 THEN '{"a": 1}' WHEN 4 THEN 'const x = 1' ELSE 'plain words' END""")
    names = F.expr("CASE event_id % 3 WHEN 0 THEN 'x language-TS y' WHEN 1 THEN 'plain' END")
    return table(spark, sf_dir, "events").select("event_id", M.language_of_code(code).alias("detected"), M.language_of_class(names, F.lit("go")).alias("declared"))


def inline_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without brackets and fences of their own within 500 characters; of every second one the cut falls into a link or a fence."""
    bare = F.regexp_replace("text", r"[\[\]`~]", "")
    k = F.col("doc_id") % 4
    text = F.when(k == 0, F.concat(F.rpad(bare, 470, "x"), F.lit("[label that goes on](https://e.org/"), bare)).when(k == 1, F.concat(F.lit("```\n"), bare)).otherwise(bare)
    rows = table(spark, sf_dir, "documents").select("doc_id", M.inline_limited(text, 500).alias("i"))
    return rows.select("doc_id", "i.content", "i.content_size", "i.truncated")


def size_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", M.size_label(F.octet_length("text") * 100).alias("label"))


FRAGMENT = '<h2>T</h2><p>a <b>b</b> <em>c</em> <code>d</code></p><ul><li>x</li><li>y<ol><li>one</li><li>two</li></ol></li></ul><pre><code class="language-py">z = 1</code></pre><table><tr><td>A</td><td>B</td></tr><tr><td>1<br>2</td><td>3</td></tr></table><a href="/u">l</a><br>&amp;lt;'
FRAGMENT_MARKDOWN = "## T\n\na **b** _c_ `d`\n\n- x\n- y\n  1. one\n  2. two\n\n```py\nz = 1\n```\n\n| A | B |\n| --- | --- |\n| 1 2 | 3 |\n\n[l](/u)\n&lt;"


def html_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Markdown of a fragment with a table, nested lists, code and emphasis around each page's visible text."""
    html = F.concat(F.lit("<p>"), F.col("t"), F.lit("</p>" + FRAGMENT))
    words = F.regexp_replace(H.visible_text(F.col("html")), r"[^\p{L}\p{N} ]+", "")
    rows = _pages(spark, sf_dir).select("page_id", F.btrim(words).alias("t"))
    return rows.select("page_id", H.markdown(P.table_cells(html)).alias("markdown"))


def help_section(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One part, by its heading, of documents that are put under headings."""
    text = F.concat(F.lit("# About\nx\n# Usage notes\n"), F.replace(F.col("text"), F.lit("#"), F.lit("")), F.lit("\n# End\ny"))
    return table(spark, sf_dir, "documents").select("doc_id", M.section(text, "usage").alias("part"))


QUERIES = {f.__name__: f for f in (page_report, limited_report, decoded_pages, tidied_lines, help_section, source_kinds, page_title, page_metadata, head_metadata, head_section, document_title, title_matches_heading, tag_counts, token_kinds, page_links, resolved_links, noise_markers, retention_counts, visible_text, stripped_pages, content_gates, truncated_sentences, raw_text, raw_titles, source_lines, footers, cleaned_markdown, code_languages, inline_limit, size_labels, html_tables)}

_T = "nullif(trim(replace(replace(replace(replace(replace(regexp_extract(html, '(?is)<title\\b[^>]*>(.*?)</title\\s*>', 1), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&nbsp;', ' '), '&amp;', '&')), '')"
_H = "nullif(trim(regexp_replace(replace(replace(replace(replace(regexp_replace(regexp_extract(html, '(?is)<h1\\b[^>]*>(.*?)</h1\\s*>', 1), '(?s)<[^>]*>', '', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&amp;', '&'), '\\s+', ' ', 'g')), '')"
_BARE = "html"
for _name in ("script", "style", "noscript", "template"):
    _BARE = f"regexp_replace({_BARE}, '(?is)<{_name}\\b[^>]*>.*?</{_name}\\s*>', '', 'g')"
_VISIBLE = _BARE.replace("(html,", "(regexp_replace(html, '(?s)<!--.*?-->', '', 'g'),", 1)
_VISIBLE = f"regexp_replace({_VISIBLE}, '(?s)<[^>]*>', ' ', 'g')"
for _e, _c in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&apos;", "''"), ("&nbsp;", " "), ("&amp;", "&")):
    _VISIBLE = f"replace({_VISIBLE}, '{_e}', '{_c}')"
_STRIPPED = "regexp_replace(html, '(?s)<!--.*?-->', '', 'g')"
for _name in ("script", "style", "nav", "footer"):
    _STRIPPED = f"regexp_replace({_STRIPPED}, '(?is)<{_name}\\b[^>]*>.*?</{_name}\\s*>', '', 'g')"
_COUNT = lambda p: f"len(regexp_extract_all(html, '(?i)<{p}\\b'))::INTEGER"
_ENT = lambda x: f"replace(replace(replace(replace({x}, '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&amp;', '&')"
_LINKS = f"""SELECT page_id, pos::INTEGER AS pos, {_ENT("regexp_replace(regexp_extract(regexp_extract(raw, '(?s)^<[^>]*>'), '(?is)\\shref\\s*=\\s*(\"[^\"]*\"|''[^'']*''|[^\\s>]+)', 1), '^[\"'']|[\"'']$', '', 'g')")} AS href,
    trim(regexp_replace({_ENT("regexp_replace(raw, '(?s)<[^>]*>', '', 'g')")}, '\\s+', ' ', 'g')) AS text
    FROM (SELECT page_id, unnest(l) AS raw, generate_subscripts(l, 1) - 1 AS pos FROM (SELECT page_id, regexp_extract_all(html, '(?is)<a\\b[^>]*>.*?</a\\s*>') AS l FROM pages))"""
_TOKENS = "SELECT page_id, unnest(regexp_extract_all(html, '(?s)<!--.*?-->|<[^>]*>|[^<]+')) AS raw FROM pages"

_SEEN = lambda x: f"length(trim(regexp_replace({_ENT(f"regexp_replace({x}, '<[^>]*>', ' ', 'g')")}, '\\s+', ' ', 'g')))"
_GATES = f"""WITH p AS (PAGES),
    c AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_extract(h, '(?is)<body[^>]*>(.*?)(?:</body>|\\z)', 1), '(?s)<!--.*?-->', '', 'g'), '(?is)<script[^>]*>.*?</script>', '', 'g'), '(?is)<style[^>]*>.*?</style>', '', 'g'),
            '(?is)<nav[^>]*>.*?</nav>', '', 'g'), '(?is)<footer[^>]*>.*?</footer>', '', 'g') AS b FROM p),
    a AS (SELECT page_id, b, regexp_extract(b, '(?is)<article[^>]*>(.*?)</article>', 1) AS x FROM c),
    r AS (SELECT page_id, b, CASE WHEN length(trim(x)) > 100 THEN x END AS r FROM a),
    t AS (SELECT *, list_filter(list_transform(string_split(regexp_replace({_ENT("regexp_replace(regexp_replace(r, '(?i)<br[^>]*>|</?(p|div|li|h[1-6]|tr)([ ][^>]*)?>', chr(10), 'g'), '<[^>]*>', '', 'g')")}, '\\n\\s+', chr(10), 'g'), chr(10)), lambda y: trim(y)), lambda y: length(y) > 20) AS l FROM r),
    g AS (SELECT page_id, b, r, CASE WHEN r IS NULL THEN 'no-region' WHEN {_SEEN('b')} >= 100 AND {_SEEN('r')} < 0.15 * {_SEEN('b')} THEN 'content-ratio' WHEN b LIKE '%<table%' AND r NOT LIKE '%<table%' THEN 'retention'
            WHEN len(l) >= 3 AND len(list_filter(l, lambda y: NOT regexp_matches(y, '[.!?:;"'')\\]`]$'))) > 0.95 * len(l) THEN 'truncated-sentences' END AS gate_failed FROM t)"""

# The report over pages like those of the tables: a region of headings, paragraphs, links, bold text and breaks.
_REPORT = "CASE WHEN gate_failed IS NULL THEN r ELSE b END"
for _pattern, _new in (
    ("(?is)<h1[^<>]*>\\s*(.*?)</h1\\s*>", "chr(10) || chr(10) || '# \\1' || chr(10) || chr(10)"),
    ("(?is)<a\\b[^<>]*?\\shref=[\"'']([^\"'']*)[\"''][^<>]*>(.*?)</a\\s*>", "'[\\2](\\1)'"),
    ("(?is)<b\\b[^<>]*>(.*?)</b\\s*>", "'**\\1**'"), ("(?is)<br\\b[^<>]*>", "chr(10)"), ("(?is)<li\\b[^<>]*>\\s*", "chr(10) || '- '"),
    ("(?is)</?(?:p|div|section|article|main|ul|ol|table|tr|blockquote|header|figure|details|summary)\\b[^<>]*>", "chr(10) || chr(10)"),
    ("(?s)<[^<>]*>", "''"), ("[ \\t]+\\n", "chr(10)"), ("\\n[ \\t]+([^\\s])", "chr(10) || '\\1'"), ("\\n{3,}", "chr(10) || chr(10)"),
):
    _REPORT = f"regexp_replace({_REPORT}, '{_pattern}', {_new}, 'g')"
_REPORT = f"regexp_replace(regexp_replace({_ENT(_REPORT)}, '\\n{{3,}}', chr(10) || chr(10), 'g'), '^\\s+|\\s+$', '', 'g')"
_REPORT = _GATES.replace("PAGES", "SELECT page_id, html AS h FROM pages") + f""",
    m AS (SELECT page_id, gate_failed, {_REPORT} AS m FROM g),
    i AS (SELECT page_id, gate_failed, regexp_replace(array_to_string(list_transform(string_split(m, chr(10)), lambda y: CASE WHEN regexp_matches(y, '^#{{1,6}}\\s') THEN rtrim(regexp_replace(y, '^(#+)\\s+', '\\1 ')) ELSE y END), chr(10)), '([.!?:;])([A-Z])', '\\1 \\2', 'g') AS m FROM m),
    f AS (SELECT page_id, url, {_T} AS title, gate_failed, regexp_replace(m, '^[^\\n#>|`*+0-9\\[\\]()-]{{1,40}}\\n\\s*(#{{1,2}}\\s)', '\\1') AS m, regexp_replace(url, '^(https?://[^/?#]*)([?#]|$)', '\\1/\\2') AS resolved_url FROM i JOIN pages USING (page_id)),
    w AS (SELECT *, CASE WHEN m LIKE '# %' THEN m ELSE '# ' || title || chr(10) || chr(10) || m END || chr(10) || chr(10) || '---' || chr(10) || chr(10) || ' _' || title || '_ | [_Original Source_](' || resolved_url || ') | _01/31/2024_' AS markdown FROM f)
    SELECT page_id, url, resolved_url, title, markdown, '{FETCHED_AT}' AS fetched_at, CASE WHEN gate_failed IS NULL THEN 'article' ELSE 'document' END AS source_kind, gate_failed, NULL::VARCHAR AS error, length(markdown)::INTEGER AS content_size, false AS truncated FROM w"""

SQL = {
    "page_report": _REPORT,
    "page_title": f"SELECT page_id, {_T} AS title, {_H} AS heading FROM pages",
    "page_metadata": "SELECT page_id, 'Page ' || page_id || ' & more' AS title, 'second' AS description, CASE WHEN page_id % 2 = 0 THEN 'Ann' END AS author, NULL::VARCHAR AS image, regexp_extract(url, '^https?://[^/?#]+') || '/favicon.ico' AS favicon, '2024-01-01' AS published_at, NULL::VARCHAR AS modified_at FROM pages",
    "head_metadata": "SELECT page_id, 'Page ' || page_id || ' & more' AS title, 'second' AS description, CASE WHEN page_id % 2 = 0 THEN 'Ann' END AS author FROM pages",
    "head_section": "SELECT page_id, regexp_extract(html, '(?is)^(.*?)(?:</head\\s*>|<body\\b)', 1) AS head FROM pages",
    "document_title": "SELECT page_id, CASE WHEN page_id % 2 = 0 THEN 'org/repo' || page_id ELSE 'GitHub - x/y: ' || page_id END AS title FROM pages",
    "title_matches_heading": f"SELECT page_id, {_H} IS NOT NULL AND NOT regexp_matches({_H}, '[-|:•·–—]') AS prefer, false AS other FROM pages",
    "tag_counts": f"WITH t AS ({_TOKENS}) SELECT lower(regexp_extract(raw, '^<([a-zA-Z][a-zA-Z0-9]*)', 1)) AS name, count(*) AS n, count(DISTINCT page_id) AS n_pages FROM t WHERE raw LIKE '<%' AND raw NOT LIKE '</%' AND raw NOT LIKE '<!%' GROUP BY 1",
    "token_kinds": f"WITH t AS ({_TOKENS}) SELECT page_id, CASE WHEN raw LIKE '<!--%' THEN 'comment' WHEN raw LIKE '<!%' THEN 'doctype' WHEN raw LIKE '</%' THEN 'end' WHEN raw LIKE '<%' THEN 'start' ELSE 'text' END AS kind, count(*) AS n FROM t GROUP BY 1, 2",
    "retention_counts": f"SELECT page_id, {_COUNT('h[1-6]')} AS headings, {_COUNT('a')} AS anchors, {_COUNT('p')} AS paragraphs, {_COUNT('img')} AS images FROM pages",
    "noise_markers": "SELECT page_id, regexp_matches(html, '(?i)<(?:script|style|noscript|iframe|nav|footer|header|form|button|svg)\\b|role=[\"'']?(?:navigation|banner|contentinfo)|aria-hidden|display:\\s*none|position:\\s*fixed|\\bhidden\\b') AS may_have_noise FROM pages",
    "visible_text": f"SELECT page_id, trim(regexp_replace({_VISIBLE}, '\\s+', ' ', 'g')) AS text FROM pages",
    "stripped_pages": f"SELECT page_id, {_STRIPPED} AS html FROM pages",
    "truncated_sentences": "WITH l AS (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x, ' ' || chr(9) || chr(13) || chr(11) || chr(12))), lambda x: length(x) > 20) AS l FROM documents) SELECT doc_id, len(l) >= 3 AND len(list_filter(l, lambda x: NOT regexp_matches(x, '[.!?:;\"'')\\]`]$'))) > 0.95 * len(l) AS truncated FROM l",
    "raw_text": "SELECT doc_id, doc_id % 4 IN (0, 2) OR (doc_id % 4 = 3 AND (regexp_matches(text, '(?m)^#{1,6}\\s') OR regexp_matches(text, '(?m)^[-*+]\\s') OR contains(text, '```'))) AS is_raw FROM documents",
    "source_lines": "SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'intro' || chr(10) || '# Head' || chr(10) || chr(10) || 'Source: https://e.org/' || doc_id || chr(10) || 'body' || chr(10) || replace(text, '#', '') ELSE 'Source: https://e.org/' || doc_id || chr(10) || chr(10) || 'plain' || chr(10) || replace(text, '#', '') END AS markdown FROM documents",
    "footers": f"SELECT page_id, '---' || chr(10) || chr(10) || ' ' || concat_ws(' | ', '_' || {_T} || '_', CASE WHEN page_id % 2 = 0 THEN '_Ann_' END, '[_Original Source_](' || url || ')', '_01/31/2024_') AS footer FROM pages",
    "code_languages": "SELECT event_id, CASE event_id % 6 WHEN 0 THEN 'python' WHEN 1 THEN 'sql' WHEN 2 THEN 'bash' WHEN 3 THEN 'json' WHEN 4 THEN 'javascript' END AS detected, CASE event_id % 3 WHEN 0 THEN 'ts' ELSE 'go' END AS declared FROM events",
    "page_links": _LINKS,
    "resolved_links": f"""WITH l AS (SELECT p.page_id, pos, href, url FROM ({_LINKS}) l JOIN pages p USING (page_id)), o AS (SELECT *, regexp_extract(url, '^https?://[^/?#]+') AS o FROM l)
        SELECT page_id, pos, CASE WHEN regexp_matches(href, '\\s|^[a-zA-Z][a-zA-Z0-9+.-]*:|^#') OR href = '' THEN trim(href) WHEN href LIKE '//%' THEN regexp_extract(url, '^https?:') || href WHEN href LIKE '/%' THEN o || href
          ELSE o || regexp_extract(url, '^https?://[^/?#]+(/(?:[^?#]*/)?)', 1) || href END AS target, 'https://a.org/b/x/' || pos || '.html' AS relative, regexp_matches(href, '[?&]utm_(source|medium|campaign)=') AS campaign FROM o""",
    "source_kinds": _GATES.replace("PAGES", "SELECT page_id, html AS h FROM pages") + """, k AS (SELECT CASE WHEN page_id % 3 = 1 THEN 'raw' WHEN gate_failed IS NULL THEN 'article' ELSE 'document' END AS source_kind, CASE WHEN page_id % 3 <> 1 THEN gate_failed END AS gate_failed FROM g)
        SELECT source_kind, gate_failed, count(*) AS n FROM k GROUP BY ALL""",
    "content_gates": _GATES.replace("PAGES", """SELECT page_id, CASE WHEN page_id % 4 = 0 THEN replace(html, '</body>', '<table><tr><td>x</td></tr></table></body>')
          WHEN page_id % 5 = 0 THEN regexp_replace(html, '(?s)</h1>(.*)</article>', '</h1><p>short, but long enough to be a region of its own: over one hundred characters of inner markup, to be sure.</p></article><div>\\1</div>') ELSE html END AS h FROM pages""") + " SELECT page_id, r IS NOT NULL AS has_region, gate_failed FROM g",
    "raw_titles": "SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'T' || doc_id WHEN 1 THEN 'Part ' || doc_id END AS title FROM documents",
    "inline_limit": """WITH b AS (SELECT doc_id, regexp_replace(text, '[\\[\\]`~]', '', 'g') AS b FROM documents),
        t AS (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN rpad(b, 470, 'x') || '[label that goes on](https://e.org/' || b WHEN 1 THEN '```' || chr(10) || b ELSE b END AS t FROM b),
        m AS (SELECT *, chr(10) || chr(10) || '...[truncated]' AS m FROM t)
        SELECT doc_id, CASE WHEN length(t) <= 500 THEN t WHEN doc_id % 4 = 0 THEN left(t, CASE WHEN substr(t, 470, 1) = '!' THEN 469 ELSE 470 END) || m WHEN doc_id % 4 = 1 THEN left(t, 479) || chr(10) || '```' || chr(10) || m ELSE left(t, 484) || m END AS content,
          length(t)::INTEGER AS content_size, length(t) > 500 AS truncated FROM m""",
    "size_labels": "WITH s AS (SELECT doc_id, strlen(text) * 100 AS n FROM documents) SELECT doc_id, CASE WHEN n < 1024 THEN n || ' B' WHEN n < 10240 THEN printf('%.1f KB', floor(n * 10 / 1024.0 + 0.5) / 10) WHEN n < 1048576 THEN floor(n / 1024.0 + 0.5)::BIGINT || ' KB' ELSE printf('%.1f MB', floor(n * 10 / 1048576.0 + 0.5) / 10) END AS label FROM s",
    "html_tables": "SELECT page_id, trim(regexp_replace(trim(regexp_replace(" + _VISIBLE + ", '\\s+', ' ', 'g')), '[^\\p{L}\\p{N} ]+', '', 'g')) || chr(10) || chr(10) || '" + FRAGMENT_MARKDOWN.replace("\n", "' || chr(10) || '") + "' AS markdown FROM pages",
    "tidied_lines": "SELECT doc_id, '# Title' || chr(10) || chr(10) || 'see `a.b` x [`c](d) [e](f) g' || chr(10) || 'w ' || regexp_replace(text, '[^\\p{L}\\p{N} ]+', ' ', 'g') || 'w' || chr(10) || chr(10) || '- item' || chr(10) || 't - u [v]' || chr(10) || chr(10) || 'a: \"x\"' || chr(10) || chr(10) || 'b: \"y\"' || chr(10) || '| \\<b\\> | c |' AS markdown FROM documents",
    "help_section": "SELECT doc_id, '# Usage notes' || chr(10) || replace(text, '#', '') AS part FROM documents",
    "decoded_pages": "SELECT page_id, CASE WHEN page_id % 5 < 3 THEN html END AS html, CASE page_id % 5 WHEN 3 THEN 'binary_content' WHEN 4 THEN 'unsupported_type' END AS body_error FROM pages",
    "limited_report": f"""WITH r AS (SELECT page_id, markdown, length(markdown) > 1000 AS truncated FROM ({_REPORT})),
        c AS (SELECT page_id, truncated, CASE WHEN truncated THEN regexp_replace(left(markdown, {1000 - len(M.MARKER)}), '!?\\[[^\\]\\[]*(\\](\\([^)]*)?)?$', '') || chr(10) || chr(10) || '...[truncated]' ELSE markdown END AS markdown FROM r)
        SELECT page_id, markdown, length(markdown)::INTEGER AS content_size, truncated FROM c""",
}
