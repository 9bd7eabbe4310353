"""HTML as columns: tags, attributes, sections, noise, visible text and Markdown, by built-in expressions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from pagemill.functions import markdown as markdown_, passes
from pagemill.functions.binding import inside, once

HEAD_SCAN = 50_000

# Elements that never hold page content, and those that hold navigation.
DROPPED_TAGS = ("script", "style", "noscript", "template", "iframe", "object", "svg", "form", "button", "select")
NAVIGATION_TAGS = ("nav", "footer", "aside", "dialog")

_ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&nbsp;", " "), ("&amp;", "&"))


def unescaped(text: Column) -> Column:
    """Text with the named entities that markup needs decoded; ``&amp;`` last, so nothing is decoded twice."""
    for entity, char in _ENTITIES:
        text = F.replace(text, F.lit(entity), F.lit(char))
    return text


def attribute(tag: Column, name: str) -> Column:
    """An attribute's value in a start tag; null without it."""
    found = F.regexp_extract_all(tag, F.lit(rf"(?is)\s{name}\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)"), F.lit(1))
    bare = lambda v: F.when(v.startswith('"') | v.startswith("'"), F.substr(v, F.lit(2), F.length(v) - 2)).otherwise(v)
    return unescaped(once(F.get(found, F.lit(0)), bare))


def start_tags(html: Column, name: str) -> Column:
    """All start tags of one element, in order."""
    return F.regexp_extract_all(html, F.lit(rf"(?is)<{name}\b[^<>]*>"), F.lit(0))


def tag_count(html: Column, pattern: str) -> Column:
    return F.regexp_count(html, F.lit(rf"(?i)<{pattern}\b")).cast("int")


def without_comments(html: Column) -> Column:
    return F.regexp_replace(html, r"(?s)<!--(?:.*?-->|.*+\z)", "")


def without_elements(html: Column, names) -> Column:
    """Without the named elements and all they hold. Navigation may be nested, up to four deep: innermost elements go first."""
    for name in names:
        if name in ("script", "style"):  # without an end these reach to the end of the page
            html = F.regexp_replace(html, rf"(?is)<{name}\b[^<>]*+>(?:.*?</{name}\s*>|.*+\z)", "")
        elif name in NAVIGATION_TAGS:
            for _ in range(4):
                html = F.regexp_replace(html, rf"(?is)<{name}\b[^<>]*+>(?:(?!</?{name}\b).)*+</{name}\s*>", "")
        else:
            for _ in range(2):
                html = F.regexp_replace(html, rf"(?is)<{name}\b[^<>]*+>{inside(name)}</{name}\s*>", "")
    return html


# Words of class names and ids that mark promotion around the content.
PROMO_TOKENS = ("banner", "promo", "announcement", "cta", "advert", "ads", "sponsor", "recommend", "breadcrumb", "pagination", "pager", "taglist", "newsletter", "subscribe", "cookie", "consent", "popup", "modal", "related", "social", "share", "comment", "comments", "discussion")


def without_promotion(html: Column) -> Column:
    """Without flat elements whose class or id has a promotion word of its own."""
    words = "|".join(PROMO_TOKENS)
    return F.regexp_replace(html, rf"(?is)<(div|section|aside|ul|p|span)\b[^<>]*\s(?:class|id)=[\"'](?:[^\"']*[^a-z0-9\"'])?(?:{words})(?:[^a-z0-9\"'][^\"']*)?[\"'][^<>]*>(?:(?!</?\1\b).)*+</\1\s*>", "")


def kept_navigation(html: Column) -> Column:
    """Navigation and footers that hold content, 500 characters or more without many links or a main element, as plain sections."""

    def region(x: Column) -> Column:
        text = F.length(F.btrim(F.regexp_replace(F.regexp_replace(x, r"<[^<>]*+>", " "), r"\s+", " ")))
        links = F.regexp_count(x, F.lit(r"(?i)<a\b"))
        dense = (links >= 10) & (links * 100 >= 0.5 * text * 1.0)
        keep = x.rlike(r"(?i)<(?:article|main|section)\b") | ((text >= 500) & ~dense)
        return F.when(keep, F.regexp_replace(x, r"(?i)^<(?:nav|footer)\b|</(?:nav|footer)\s*>$", "")).otherwise(x)

    def renamed(x: Column) -> Column:
        kept = region(x)
        return F.when(kept == x, x).otherwise(F.concat(F.lit("<div"), kept, F.lit("</div>")))

    pattern = r"(?is)<(nav|footer)\b[^<>]*+>(?:(?!</?\1\b).)*+</\1\s*>"
    return once(html, lambda h: F.when(h.rlike(r"(?i)<(?:nav|footer)\b"), passes.each(h, pattern, renamed)).otherwise(h))


def without_hidden(html: Column) -> Column:
    """Without flat elements that are hidden by attribute or style, unless they are interactive widgets."""
    mark = r"(?:\shidden(?=[\s>=])|aria-hidden\s*=\s*[\"']?true|style\s*=\s*[\"'][^\"']*(?:display\s*:\s*none|visibility\s*:\s*hidden))"
    widget = r"(?![^<>]*\srole=[\"']?(?:tabpanel|dialog|menu|listbox|tree|grid|combobox)\b)"
    return F.regexp_replace(html, rf"(?is)<(div|span|p|section|ul|li|a)\b{widget}[^<>]*{mark}[^<>]*>(?:(?!</?\1\b).)*+</\1\s*>", "")


def may_have_noise(html: Column) -> Column:
    """The cheap test before any removal: a marker of noise in the first or last 50 000 characters."""
    sample = F.concat(F.substring(html, 1, HEAD_SCAN), F.when(F.length(html) > HEAD_SCAN, F.substr(html, -F.least(F.lit(HEAD_SCAN), F.length(html) - HEAD_SCAN))).otherwise(F.lit("")))
    return sample.rlike(r"(?i)<(?:script|style|noscript|iframe|nav|footer|header|form|button|svg)\b|role=[\"']?(?:navigation|banner|contentinfo)|aria-hidden|display:\s*none|position:\s*fixed|\bhidden\b")


def cleaned(html: Column) -> Column:
    """The page without comments, dropped elements, hidden parts, promotion and navigation; navigation that holds content stays."""
    bare = without_hidden(without_elements(without_comments(html), DROPPED_TAGS))
    return without_promotion(without_elements(kept_navigation(bare), NAVIGATION_TAGS))


def visible_text(html: Column) -> Column:
    """Text of the page with dropped elements gone, tags as spaces, and runs of spaces collapsed."""
    bare = without_elements(without_comments(html), ("script", "style", "noscript", "template"))
    return F.btrim(F.regexp_replace(unescaped(F.regexp_replace(bare, r"(?s)<[^<>]*>", " ")), r"\s+", " "))


def head_section(html: Column) -> Column:
    """What stands before the end of the head; null if that isn't in the first 50 000 characters."""
    scanned = F.substring(html, 1, HEAD_SCAN)
    at = F.regexp_instr(scanned, F.lit(r"(?i)</head\s*>|<body\b"))
    return F.when(at > 0, F.substr(html, F.lit(1), at - 1))


def body_section(html: Column) -> Column:
    inner = F.regexp_extract(html, r"(?is)<body\b[^<>]*>(.*?)(?:</body\s*>|\z)", 1)
    return F.when(html.rlike(r"(?i)<body\b"), inner).otherwise(html)


# Where a page's content may be, in order, as tag and attribute; and what else may hold its heading.
REGIONS = (
    ("article", ""), ("main", ""), ("", "role=main"), ("", "id=content"), ("", "id=main-content"), ("", "class=content"), ("", "class=main-content"),
    ("", "class=post-content"), ("", "class=article-content"), ("", "class=entry-content"), ("", "itemprop=articleBody"), ("", "data-content"),
    ("", "class=post-body"), ("", "class=article-body"),
)
HEADING_REGIONS = (("", "class=markdown-body"), ("", "itemprop=text"))
LEAST_REGION = 100


def _region_start(tag: str, attribute_: str) -> str:
    """A start tag of the region as a pattern, its name as group 1."""
    if tag:
        return rf"(?is)<({tag})\b[^<>]*+>"
    name, _, value = attribute_.partition("=")
    if not value:
        return rf"(?is)<([a-z][a-z0-9]*)\b[^<>]*\s{name}(?=[\s>=])[^<>]*>"
    if name == "class":
        return rf"(?is)<([a-z][a-z0-9]*)\b[^<>]*\sclass\s*=\s*(?:[\"'](?:[^\"']*\s)?{value}(?:\s[^\"']*)?[\"']|{value}(?=[\s>]))[^<>]*>"
    return rf"(?is)<([a-z][a-z0-9]*)\b[^<>]*\s{name}\s*=\s*[\"']?{value}[\"']?(?=[\s>])[^<>]*>"


def inner_html(html: Column, start: str) -> Column:
    """What the first element with this start tag holds, up to the end tag at its own depth; null without one.

    Depth is the count of start tags less that of end tags of its name in the pieces before each end tag.
    """

    def inside(rest: Column, name: Column) -> Column:
        # pieces end before an end tag of the name; the element ends at the first piece before which as many have ended as begun
        pieces = F.split(rest, r"(?i)(?=</(?:article|main|div|section)\s*>)")
        return once(F.struct(pieces.alias("p"), name.alias("n")), lambda v: _up_to_own_end(v["p"], v["n"]))

    at = F.regexp_instr(html, F.lit(start))
    tag, name = F.regexp_extract(html, start, 0), F.lower(F.regexp_extract(html, start, 1))
    return F.when(at > 0, once(F.struct(F.substr(html, at + F.length(tag)).alias("rest"), name.alias("name")), lambda v: inside(v["rest"], v["name"])))


def _up_to_own_end(pieces: Column, name: Column) -> Column:
    """The pieces before the end tag that closes an element of ``name`` opened before the first piece."""

    def step(acc: Column, x: Column) -> Column:
        ends = F.lower(F.substring(x, 1, 12)).startswith(F.concat(F.lit("</"), name))
        depth = acc["depth"] - ends.cast("int")
        begins = F.size(F.split(F.lower(x), F.concat(F.lit("<"), name, F.lit("(?![a-z0-9-])")))) - 1
        done = acc["done"] | (depth == 0)
        return F.struct(F.when(done, acc["n"]).otherwise(acc["n"] + 1).alias("n"), (depth + begins).alias("depth"), done.alias("done"))

    start = F.struct(F.lit(0).alias("n"), F.lit(1).alias("depth"), F.lit(False).alias("done"))
    n = F.aggregate(pieces, start, step, lambda acc: acc["n"])
    return F.array_join(F.slice(pieces, 1, F.greatest(n, F.lit(0))), "")


def content_region(html: Column) -> Column:
    """The inside of the first region with over 100 characters, in the order of ``REGIONS``; null if there is none."""

    def found(h: Column) -> Column:
        out = None
        for tag, attribute_ in REGIONS:
            start = _region_start(tag, attribute_)
            value = once(inner_html(h, start), lambda x: F.when(F.length(F.btrim(x, F.lit(" \t\r\n"))) > LEAST_REGION, x))
            test = h.rlike(start)
            out = F.when(test, value) if out is None else F.coalesce(out, F.when(test, value))
        return out

    return once(html, found)


def _heading_text(html: Column, pattern: str) -> Column:
    inner = F.regexp_extract(html, pattern, 1)
    return F.nullif(F.btrim(F.regexp_replace(unescaped(F.regexp_replace(inner, r"(?s)<[^<>]*+>", "")), r"\s+", " ")), F.lit(""))


_MARKED_TITLE = r"(?is)<[a-z][a-z0-9]*\b[^<>]*\sdata-title\s*=\s*[\"']?true[\"']?[^<>]*>([^<]*+)<"
_H1, _H2 = (rf"(?is)<{h}\b[^<>]*+>({inside(h)})</{h}\s*>" for h in ("h1", "h2"))


def primary_heading(html: Column) -> Column:
    """Text of what is marked as title, else of the first h1, else of the first h2 in a region of content; null without one."""

    def found(h: Column) -> Column:
        local = None
        for tag, attribute_ in (*REGIONS, *HEADING_REGIONS):
            start = _region_start(tag, attribute_)
            value = F.when(h.rlike(start), _heading_text(F.substr(h, F.regexp_instr(h, F.lit(start))), _H2))
            local = value if local is None else F.coalesce(local, value)
        return F.coalesce(F.when(h.contains("data-title"), _heading_text(h, _MARKED_TITLE)), _heading_text(h, _H1), F.when(h.rlike(r"(?i)<h2\b"), local))

    return once(html, found)


TABLE = r"(?is)<table\b[^<>]*+>(?:(?!</?table\b).)*+</table\s*>"
LIST = r"(?is)<(ul|ol)\b[^<>]*+>(?:(?!</?[uo]l\b).)*+</\1\s*>"
#: Levels of nested lists that are told apart; deeper ones stay at the last.
LIST_LEVELS = 6
_LEVEL = "\x02"


def tables(html: Column) -> Column:
    """Tables as rows of pipes, with a line of dashes under the first row."""

    def one(table: Column) -> Column:
        cells = lambda row: F.transform(F.regexp_extract_all(row, F.lit(rf"(?is)<t[hd]\b[^<>]*+>({inside('t[hd]')})</t[hd]\s*>"), F.lit(1)), lambda c: F.btrim(c, F.lit(" \t\r\n")))
        line = lambda row: F.concat(F.lit("| "), F.array_join(row, " | "), F.lit(" |"))
        rows = F.filter(F.transform(F.regexp_extract_all(table, F.lit(rf"(?is)<tr\b[^<>]*+>({inside('tr')})</tr\s*>"), F.lit(1)), cells), lambda r: F.size(r) > 0)
        rule = lambda rs: F.concat(F.lit("| "), F.array_join(F.array_repeat(F.lit("---"), F.size(rs[0])), " | "), F.lit(" |"))
        text = lambda rs: F.concat(F.lit("\n\n"), line(rs[0]), F.lit("\n"), rule(rs), F.array_join(F.transform(F.slice(rs, 2, 1_000_000_000), lambda r: F.concat(F.lit("\n"), line(r))), ""), F.lit("\n\n"))
        return once(rows, lambda rs: F.when(F.size(rs) > 0, text(rs)).otherwise(F.lit("")))

    return once(html, lambda h: F.when(h.rlike(r"(?i)<table\b"), passes.each(h, TABLE, one)).otherwise(h))


def lists(html: Column) -> Column:
    """Lists as lines that begin with one mark for each level of nesting (``list_marks_resolved`` makes spaces of them), innermost lists first."""

    def one(x: Column) -> Column:
        ordered = F.lower(F.substring(x, 1, 3)) == "<ol"
        inner = F.regexp_replace(F.regexp_replace(x, r"(?is)^<[uo]l\b[^<>]*+>|</[uo]l\s*>$|</li\s*>", ""), "\n" + _LEVEL, "\n" + _LEVEL + _LEVEL)
        bullet = lambda i: F.when(ordered, F.concat(i.cast("string"), F.lit(". "))).otherwise(F.lit("- "))
        items = F.transform(F.split(inner, r"(?i)<li\b[^<>]*+>\s*"), lambda t, i: F.when(i == 0, F.btrim(t, F.lit(" \t\r\n"))).otherwise(F.concat(F.lit("\n" + _LEVEL), bullet(i), F.rtrim(t, F.lit(" \t\r\n")))))
        return F.array_join(items, "")

    for _ in range(LIST_LEVELS):
        inner = html
        html = once(inner, lambda h: F.when(h.rlike(r"(?i)<[uo]l\b"), passes.each(h, LIST, lambda x: F.concat(one(x), F.lit("\n")))).otherwise(h))
    return html


def list_marks_resolved(text: Column) -> Column:
    return F.replace(F.regexp_replace(text, _LEVEL + "(?=" + _LEVEL + ")", "  "), F.lit(_LEVEL), F.lit(""))


def code_blocks(html: Column) -> Column:
    """``pre`` as fenced blocks: diagrams as such, else with the language of a class, a data-language or the code itself."""

    def one(x: Column) -> Column:
        tags = F.regexp_extract(x, r"(?is)^<pre\b[^<>]*+>\s*+(?:<code\b[^<>]*+>)?+", 0)
        body = F.regexp_replace(F.regexp_replace(x, r"(?is)^<pre\b[^<>]*+>\s*+(?:<code\b[^<>]*+>)?+|\s*+(?:</code\s*>)?\s*</pre\s*>$", ""), r"(?s)<[^<>]*+>", "")
        names = F.concat_ws(" ", F.regexp_extract(tags, r"(?i)^<pre\b[^<>]*\sclass=[\"']([^\"']*+)", 1), F.regexp_extract(tags, r"(?i)<code\b[^<>]*\sclass=[\"']([^\"']*+)", 1))
        data = F.regexp_extract(tags, r"(?i)\sdata-language=[\"']?(\w+)", 1)
        return once(F.struct(body.alias("b"), names.alias("n"), data.alias("d")), fenced)

    def fenced(v: Column) -> Column:
        language = F.when(v["n"].contains("mermaid"), "mermaid").otherwise(F.coalesce(markdown_.language_of_class(v["n"], v["d"]), markdown_.language_of_code(unescaped(v["b"])), F.lit("")))
        return F.concat(F.lit("\n\n```"), language, F.lit("\n"), v["b"], F.lit("\n```\n\n"))

    return once(html, lambda h: F.when(h.rlike(r"(?i)<pre\b"), passes.each(h, r"(?is)<pre\b[^<>]*+>(?:(?!</?pre\b).)*+</pre\s*>", one)).otherwise(h))


def image_text(tag: Column) -> Column:
    """An image in Markdown: its source, a lazy one, or the first of its srcset; text from alt, else from the file's name."""
    src, lazy = attribute(tag, "src"), F.coalesce(*[attribute(tag, n) for n in passes.LAZY_SOURCES])
    first = F.nullif(F.regexp_extract(F.coalesce(attribute(tag, "srcset"), F.lit("")), r"^\s*(\S+)", 1), F.lit(""))
    real = F.when(src.isNotNull() & ~src.startswith("data:") & (src != ""), src)
    chosen = F.coalesce(real, lazy, first, src, F.lit(""))

    def text(v: Column) -> Column:
        file = F.regexp_replace(F.regexp_extract(v["s"], r"([^/?#]+?)(?:\.[A-Za-z0-9]+)?(?:[?#].*)?$", 1), r"[-_]+", " ")
        alt = F.coalesce(F.nullif(v["a"], F.lit("")), F.when(v["s"].startswith("data:"), "").otherwise(file))
        return F.concat(F.lit("!["), alt, F.lit("]("), v["s"], F.lit(")"))

    return once(F.struct(chosen.alias("s"), attribute(tag, "alt").alias("a")), text)


def images(html: Column) -> Column:
    return once(html, lambda h: F.when(h.rlike(r"(?i)<img\b"), passes.each(h, r"(?is)<img\b[^<>]*+>", image_text)).otherwise(h))


# Marks around the text of small elements.
WRAPPED = (("strong|b", "**"), ("em|i", "_"), ("code|kbd", "`"), ("mark", "=="), ("sub", "~"), ("sup", "^"))


def inline_marks(html: Column) -> Column:
    """Links, diagrams in divs, headings, emphasis and blocks as Markdown; what else is left of tags goes."""
    out = F.regexp_replace(html, r"(?is)<div\b[^<>]*class=[\"'][^\"']*\bmermaid\b[^<>]*>((?:(?!</?div\b).)*+)</div\s*>", "\n\n```mermaid\n$1\n```\n\n")
    for n in range(1, 7):
        out = F.regexp_replace(out, rf"(?is)<h{n}\b[^<>]*+>\s*+({inside(f'h{n}')})</h{n}\s*>", "\n\n" + "#" * n + " $1\n\n")
    out = F.regexp_replace(out, rf"(?is)<a\b[^<>]*?\shref=[\"']([^\"']*+)[\"'][^<>]*+>({inside('a')})</a\s*>", "[$2]($1)")
    # code that holds a back-tick takes two
    out = F.regexp_replace(out, r"(?is)<code\b[^<>]*+>([^<`]*+`[^<]*+)</code\s*>", "`` $1 ``")
    for names, mark in WRAPPED:
        out = F.regexp_replace(out, rf"(?is)<({names})\b[^<>]*+>((?:(?!</?\1\b).)*+)</\1\s*>", mark.replace("$", "\\$") + "$2" + mark)
    for pattern, new in (
        (r"(?is)<blockquote\b[^<>]*+>\s*", "\n\n> "),
        (r"(?is)<br\b[^<>]*+>", "\n"),
        (r"(?is)<hr\b[^<>]*+>", "\n\n---\n\n"),
        (r"(?is)<li\b[^<>]*+>\s*", "\n- "),
        (r"(?is)<span\b[^<>]*\sdata-as=[\"']p[\"'][^<>]*>([^<]*+)</span\s*>", "\n\n$1\n\n"),
        (r"(?is)</?(?:p|div|section|article|main|ul|ol|table|tr|blockquote|header|figure|details|summary)\b[^<>]*+>", "\n\n"),
        (r"(?s)<[^<>]*+>", ""),
        (r"(?<![ \t])[ \t]++\n", "\n"),
    ):
        out = F.regexp_replace(out, pattern, new)
    return out


def markdown(html: Column) -> Column:
    """Markdown of a cleaned fragment: code, tables, nested lists, images, headings, links, emphasis, quotes, rules and paragraphs. Code keeps its lines as they are."""
    whole = lists(tables(images(code_blocks(html))))
    out = markdown_.outside_fences(whole, lambda s: list_marks_resolved(F.regexp_replace(F.regexp_replace(inline_marks(s), r"\n[ \t]+(?=\S)", "\n"), r"\n{3,}", "\n\n")))
    return F.regexp_replace(F.regexp_replace(unescaped(out), r"\n{3,}", "\n\n"), r"\A\s++|(?<!\s)\s++\z", "")


def tokens(pages: DataFrame, key: str = "page_id") -> DataFrame:
    """(key, pos, kind, name, raw): the tags, comments and text pieces of each page as rows, for audits."""
    parts = F.regexp_extract_all("html", F.lit(r"(?s)<!--(?:.*?-->|.*+\z)|<[^<>]*>|[^<]+"), F.lit(0))
    rows = pages.select(key, F.posexplode(parts).alias("pos", "raw"))
    raw = F.col("raw")
    kind = F.when(raw.startswith("<!--"), "comment").when(raw.startswith("<!"), "doctype").when(raw.startswith("</"), "end").when(raw.startswith("<"), "start").otherwise("text")
    return rows.select(key, "pos", kind.alias("kind"), F.nullif(F.lower(F.regexp_extract(raw, r"^</?([a-zA-Z][a-zA-Z0-9]*)", 1)), F.lit("")).alias("name"), "raw")


def links(pages: DataFrame, key: str = "page_id") -> DataFrame:
    """(key, pos, href, text): the anchors of each page as rows."""
    anchors = F.regexp_extract_all("html", F.lit(rf"(?is)<a\b[^<>]*>{inside('a')}</a\s*>"), F.lit(0))
    rows = pages.select(key, F.posexplode(anchors).alias("pos", "raw"))
    text = F.btrim(F.regexp_replace(unescaped(F.regexp_replace("raw", r"(?s)<[^<>]*>", "")), r"\s+", " "))
    return rows.select(key, "pos", attribute(F.regexp_extract("raw", r"(?s)^<[^<>]*>", 0), "href").alias("href"), text.alias("text"))
