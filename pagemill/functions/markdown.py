"""Markdown text functions: titles, source lines, footers, gates, clean-up outside fenced code, safe cuts."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from pagemill.functions import passes, urls as U
from pagemill.functions.binding import once

FENCE = r"(?ms)^[ \t]*(`{3,}|~{3,})[^\n]*(?:\n.*?)?(?:^[ \t]*\1[ \t]*$|\z)"
MARKER = "\n\n...[truncated]"
DATE_FORMAT = "MM/dd/yyyy"


def outside_fences(text: Column, change) -> Column:
    """``change`` applied to each stretch outside fenced code; line ends become LF. An open fence reaches to the end."""

    def apart(plain: Column) -> Column:
        fences = F.regexp_extract_all(plain, F.lit(FENCE), F.lit(0))
        stretches = F.split(F.regexp_replace(plain, FENCE, "\x1e"), "\x1e", -1)
        return F.array_join(F.zip_with(stretches, fences, lambda s, f: F.concat(change(F.coalesce(s, F.lit(""))), F.coalesce(f, F.lit("")))), "")

    return once(F.replace(text, F.lit("\r\n"), F.lit("\n")), apart)


# Words and lines that sites put around their content, and the signs of heading permalinks.
SKIP_LABELS = ("skip to content", "skip to main content", "skip to navigation", "skip to main navigation", "skip link", "back to top")
HELPFUL_LINES = ("was this page helpful", "was this page helpful?")
CHROME_LINES = ("edit this page", "toggle table of contents sidebar", "toggle site navigation sidebar", "toggle light / dark / auto color theme", "back to top")
DOC_PREFIXES = ("Defined in:", "Returns:", "Since:", "See also:")
PERMALINK_SIGNS = ("#", "¶", "§", "¤", "🔗")
CHROME_SCAN = 12

#: A line falls into code spans, links and images, and what stands between; every alternative is possessive, so a long line is read once.
PIECES = r"(?<!`)`[^`]++`(?!`)|!?\[[^\[\]]*+\]\((?:[^()]++|\([^()]*+\))*+\)|(?:[^`\[!]++|!(?!\[))++|[`\[!]"
HEADING = r"^#{1,6}\s"
ITEM = r"^(?:[-*+]|\d+\.)\s"


def _begins(value: Column, prefixes) -> Column:
    out = F.lit(False)
    for x in prefixes:
        out = out | value.startswith(x)
    return out


def _names_closed(text: Column) -> Column:
    """Dotted names without white space after the dot."""
    return F.regexp_replace(text, r"(?<=[\w$])\.\s++(?=[A-Za-z_$<])", ".")


def _code(piece: Column, before: Column) -> Column:
    """A code span without padding; padding at its left moves out of it."""
    body = F.substr(piece, F.lit(2), F.length(piece) - 2)
    outside = F.when(F.ltrim(body).eqNullSafe(body) | F.coalesce(before, F.lit("")).rlike(r"(?:^|\s)$"), "").otherwise(" ")
    return F.when(body.rlike("[A-Za-z0-9]"), F.concat(outside, F.lit("`"), _names_closed(F.btrim(body)), F.lit("`"))).otherwise(piece)


def _empty_link(piece: Column) -> Column:
    label = F.regexp_extract(piece, r"^\[([^\[\]]*+)\]\(#", 1)
    return piece.rlike(r"^\[[^\[\]]*+\]\(#") & (F.btrim(F.replace(label, F.lit("\u200b"), F.lit(""))) == "")


def _link(piece: Column) -> Column:
    """A link with escapes of its label put right; an empty one to a place in the page goes."""
    label, rest = F.regexp_extract(piece, r"^!?\[([^\[\]]*+)\]", 1), F.regexp_extract(piece, r"^!?\[[^\[\]]*+\](.*)$", 1)
    plain = label
    for escaped, char in (("\\`", "`"), ("\\<", "<"), ("\\>", ">")):
        plain = F.replace(plain, F.lit(escaped), F.lit(char))
    plain = F.replace(F.replace(_names_closed(plain), F.lit("<"), F.lit("\\<")), F.lit(">"), F.lit("\\>"))
    mark = F.when(piece.startswith("!"), "!").otherwise("")
    return F.when(_empty_link(piece), F.lit("")).otherwise(F.concat(mark, F.lit("["), plain, F.lit("]"), rest))


def _plain(piece: Column) -> Column:
    """Text between spans: a space after a sentence's end, escaped dashes between words as dashes."""
    spaced = F.regexp_replace(piece, r"(?<=[.!?:;])(?=[A-Z])", " ")
    return F.when(piece.contains("\\-"), F.regexp_replace(spaced, r"(?:(?<=[^ ]) *+|^ ++)\\- *+(?=\S)", " - ")).otherwise(spaced)


def _pieces_tidied(line: Column) -> Column:
    """The line's pieces put right, with a space between a link or code span and what touches it."""
    span = lambda p: F.coalesce(p.rlike(r"^(?:`[^`]|!?\[.*\)$)"), F.lit(False))

    def one(p: Column, before: Column) -> Column:
        touching = span(before) & ~F.coalesce(_empty_link(before), F.lit(False)) & ((p.startswith("[") & span(p)) | p.rlike("^[A-Za-z0-9]"))
        new = F.when(p.startswith("`") & (F.length(p) > 2), _code(p, before)).when(span(p), _link(p)).otherwise(_plain(p))
        return F.concat(F.when(touching, " ").otherwise(""), new)

    whole = once(F.regexp_extract_all(line, F.lit(PIECES), F.lit(0)), lambda ps: F.array_join(F.transform(ps, lambda p, i: one(p, F.get(ps, i - 1))), ""))
    for sign in "[].":
        whole = F.replace(whole, F.lit("\\" + sign), F.lit(sign))
    return whole


def _properties_apart(line: Column) -> Column:
    """A property that is glued to the quoted value of the one before starts a paragraph."""
    cut = r"(?<=[\"”])(?=[a-z_][a-z0-9_]{0,30}\??:)"
    apart = lambda p, before: F.when(before.rlike(r"[a-z_]\w{0,30}\??:\s+[\"“][^\"“”]*+[\"”]$"), F.concat(F.lit("\n\n"), p)).otherwise(p)
    return once(F.split(line, cut), lambda ps: F.array_join(F.transform(ps, lambda p, i: apart(p, F.get(ps, i - 1))), ""))


def _heading_tidied(line: Column) -> Column:
    """One space after the marks, none at the end, and no permalink there."""
    last = F.regexp_extract(line, r"\[([^\[\]]*+)\]\(#[^()]*+\)\s*$", 1)
    bare = F.when(last.isin(*PERMALINK_SIGNS), F.regexp_replace(line, r"\[[^\[\]]*+\]\(#[^()]*+\)\s*$", "")).otherwise(line)
    marks = F.regexp_extract(bare, r"^#{1,6}", 0)
    return F.rtrim(F.concat(marks, F.lit(" "), F.ltrim(F.substr(bare, F.length(marks) + 1))))


def _row_escaped(line: Column) -> Column:
    """A table row with its tags escaped."""
    return F.regexp_replace(line, r"<(/?+[A-Za-z][A-Za-z0-9-]*+)>", r"\\<$1\\>")


def _unwanted(line: Column) -> Column:
    """Lines of generated references, skip links and questions about the page."""
    bare = F.btrim(line)
    label, target = F.regexp_extract(bare, r"^\[([^\[\]]*+)\]\(([^()]*+)\)$", 1), F.regexp_extract(bare, r"^\[([^\[\]]*+)\]\(([^()]*+)\)$", 2)
    skip = F.lower(label).isin(*SKIP_LABELS) & target.startswith("#")
    return _begins(F.ltrim(bare, F.lit("*")), DOC_PREFIXES) | skip | ((F.btrim(label) == "") & target.rlike("^https?://")) | F.lower(bare).isin(*HELPFUL_LINES)


def lines_tidied(text: Column) -> Column:
    """Text outside fences, line by line: unwanted lines go, headings, spans, glued properties and rows are put right, nested lists get four spaces a level; then headings and lists get their blank lines."""

    def line(x: Column) -> Column:
        plain = F.replace(x, F.lit("\u00a0"), F.lit(" "))
        return once(plain, lambda p: once(_properties_apart(_pieces_tidied(p)), lambda tidy: judged(p, tidy)))

    def judged(plain: Column, tidy: Column) -> Column:
        indent = F.length(plain) - F.length(F.ltrim(plain))
        nested = plain.rlike(r"^ +(?:[-*+]|\d+\.)\s") & (indent % 2 == 0) & (indent <= 16)
        alone = plain.rlike(r"^(?:[-*+]|\d+\.)[\s\\*+|/-]*$")
        row = plain.rlike(r"^\|.*\|\s*$") & ~plain.rlike(r"^\|\s*[-: ]+\|")
        return F.when(alone, "").when(plain.rlike(HEADING), _heading_tidied(tidy)).when(row, _row_escaped(tidy)).when(nested, F.concat(F.repeat(F.lit(" "), indent), tidy)).otherwise(tidy)

    def spaced(lines: Column) -> Column:
        def gap(x: Column, before: Column) -> Column:
            under_heading = before.rlike(HEADING) & (F.btrim(x) != "")
            new_list = x.rlike(ITEM) & (F.btrim(before) != "") & ~before.rlike(ITEM) & ~before.rlike(r"^[ \t]")
            return F.when(F.coalesce(under_heading | new_list, F.lit(False)), F.concat(F.lit("\n"), x)).otherwise(x)

        return F.array_join(F.transform(lines, lambda x, i: gap(x, F.get(lines, i - 1))), "\n")

    kept = F.filter(F.split(text, "\n"), lambda x: ~_unwanted(x))
    return F.regexp_replace(once(F.transform(kept, line), spaced), r"\n{3,}", "\n\n")


def without_empty_sections(text: Column) -> Column:
    """Without headings that another of the same or a higher level follows at once; the last one stays.

    Blank lines are noted at the line below them, so that a line's follower is its neighbour: time is linear in the lines.
    """
    level = lambda x: F.length(F.regexp_extract(F.ltrim(x), r"^(#{1,6})\s", 1))
    blank = lambda x: F.coalesce(F.btrim(x) == "", F.lit(False))

    def noted(lines: Column) -> Column:
        all_ = F.transform(lines, lambda x, i: F.struct(x.alias("line"), level(x).alias("level"), blank(F.get(lines, i - 1)).alias("gap"), blank(x).alias("blank")))
        return F.filter(all_, lambda x: ~x["blank"])

    def kept(rows: Column) -> Column:
        next_ = lambda i: F.coalesce(F.get(rows, i + 1)["level"], F.lit(0))
        left = F.filter(rows, lambda x, i: ~((x["level"] > 0) & (next_(i) > 0) & (next_(i) <= x["level"])))
        return F.array_join(F.transform(left, lambda x: F.when(x["gap"], F.concat(F.lit("\n"), x["line"])).otherwise(x["line"])), "\n")

    return F.regexp_replace(once(once(F.split(text, "\n"), noted), kept), r"\n{3,}", "\n\n")


def without_leading_chrome(text: Column) -> Column:
    """Page controls among the first twelve lines go, and a short line of plain words above a first heading of level 1 or 2."""
    lines = F.transform(F.split(text, "\n"), lambda x, i: F.when((i < CHROME_SCAN) & F.lower(F.btrim(x)).isin(*CHROME_LINES), F.lit("")).otherwise(x))
    joined = F.regexp_replace(F.array_join(lines, "\n"), r"\n{3,}", "\n\n")

    def crumb(t: Column) -> Column:
        first = F.split_part(t, F.lit("\n"), F.lit(1))
        rest = F.ltrim(F.substr(t, F.length(first) + 1), F.lit(" \t\n"))
        short = (F.length(first) <= 40) & (F.length(first) > 0) & ~first.rlike(r"[#>|`*+\d\[\]()-]")
        return F.when(short & rest.rlike(r"\A#{1,2}\s"), rest).otherwise(t)

    return once(joined, crumb)


def cleaned(text: Column, keep_empty_headings: bool = False) -> Column:
    """The whole clean-up: outside fences contents lists, lone headings and lines, then the page's edges."""
    out = outside_fences(text, lambda s: lines_tidied(passes.orphans_promoted(passes.toc_removed(s))))
    out = F.replace(F.btrim(out, F.lit(" \t\n\r")), F.lit("[Copy](#copy)"), F.lit(""))
    return without_leading_chrome(out if keep_empty_headings else without_empty_sections(out))


def links_resolved(text: Column, page: Column) -> Column:
    """Markdown links and images outside fences with absolute targets, parentheses in targets balanced one deep."""

    def one(p: Column) -> Column:
        head = F.regexp_extract(p, r"^!?\[[^\[\]]*+\]\(", 0)
        target = F.substr(p, F.length(head) + 1, F.length(p) - F.length(head) - 1)
        return F.when(p.rlike(r"^!?\[[^\[\]]*+\]\(.*\)$"), F.concat(head, U.resolved(target, page), F.lit(")"))).otherwise(p)

    pieces = r"(?s)!?\[[^\[\]]*+\]\((?:[^()]++|\([^()]*+\))*+\)|(?:[^\[!]++|!(?!\[))++|[\[!]"
    return outside_fences(text, lambda s: F.when(s.contains("]("), F.array_join(F.transform(F.regexp_extract_all(s, F.lit(pieces), F.lit(0)), one), "")).otherwise(s))


def frontmatter(text: Column) -> Column:
    """map<string,string> of a leading ``---`` block: keys in lower case, the last of equal keys; null without a block."""
    plain = F.replace(text, F.lit("\r\n"), F.lit("\n"))
    block = F.regexp_extract(plain, r"(?s)\A---\n(.*?)---\n", 1)
    lines = F.filter(F.transform(F.split(block, "\n"), F.btrim), lambda x: x.rlike(r"^[^:]+:\s*\S"))
    pair = lambda x: F.struct(F.lower(F.btrim(F.split(x, ":", 2)[0])), F.regexp_replace(F.btrim(F.split(x, ":", 2)[1]), r"^([\"'])(.*)\1$", "$2"))
    latest = F.transform(lines, pair)
    kept = F.filter(latest, lambda x, i: ~F.exists(F.slice(latest, i + 2, F.greatest(F.lit(0), F.size(latest) - i - 1)), lambda y: y["col1"] == x["col1"]))
    return F.when(plain.rlike(r"(?s)\A---\n.*?---\n"), F.map_from_entries(kept))


def raw_title(text: Column) -> Column:
    """Title of raw Markdown: from its block, else the first heading that starts within 500 characters of the body."""
    matter = frontmatter(text)
    plain = F.replace(text, F.lit("\r\n"), F.lit("\n"))
    body = F.regexp_replace(plain, r"(?s)\A---\n.*?---\n", "")
    heading = F.regexp_extract(body, r"(?s)\A(?:.{0,499}?\n)??[ \t]*#{1,6}[ \t]+([^\n]*)", 1)
    return F.coalesce(matter["title"], matter["name"], F.nullif(F.btrim(heading), F.lit("")))


# Tags that are counted to tell HTML from Markdown, and the most that Markdown may have; structural ones that a raw page may not have.
COUNTED_TAGS = ("html", "head", "body", "div", "span", "script", "style", "meta", "link")
MOST_TAGS = 5
STRUCTURAL_TAGS = ("html", "head", "body", "article", "section", "main", "table")


def is_raw_text(text: Column) -> Column:
    """Markdown-like text: no HTML document, and a block, or few tags and a heading, list or fence."""
    trimmed = F.btrim(text, F.lit(" \t\n\r"))
    tags = F.regexp_count(text, F.lit("(?i)<(?:" + "|".join(COUNTED_TAGS) + r")\b"))
    like = text.rlike(r"(?m)^#{1,6}\s") | text.rlike(r"(?m)^[-*+]\s") | text.contains("```")
    return F.coalesce(~trimmed.rlike(r"(?i)^(?:<!doctype|<html)") & (trimmed.rlike(r"(?s)\A---\r?\n.*?---\r?\n") | ((tags <= MOST_TAGS) & like)), F.lit(False))


def with_source(text: Column, url: Column) -> Column:
    """A ``Source:`` line after the first heading, or at the top."""
    line = F.concat(F.lit("Source: "), url)
    head = F.regexp_extract(text, r"(?s)\A(.*?(?:\A|\n)#{1,6}\s[^\n]*\n?)", 1)
    placed = F.when(head != "", F.concat(head, F.lit("\n"), line, F.lit("\n"), F.substr(text, F.length(head) + 1))).otherwise(F.concat(line, F.lit("\n\n"), text))
    return F.when(text.rlike(r"(?im)^source:\s"), text).otherwise(placed)


def footer(title: Column, author: Column, url: Column, fetched_at: Column, description: Column) -> Column:
    """The closing block: title, author, source and date, then the description."""
    part = lambda c: F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit("_"), c, F.lit("_")))
    source = F.when(F.coalesce(url, F.lit("")) != "", F.concat(F.lit("[_Original Source_]("), url, F.lit(")")))
    line = F.concat_ws(" | ", part(title), part(author), source, part(F.date_format(fetched_at, DATE_FORMAT)))
    return F.concat(F.lit("---\n"), F.when(line != "", F.concat(F.lit("\n "), line)).otherwise(F.lit("")), F.when(F.coalesce(description, F.lit("")) != "", F.concat(F.lit("\n "), description)).otherwise(F.lit("")))


def _token(value: Column) -> Column:
    return F.lower(F.btrim(F.regexp_replace(F.coalesce(value, F.lit("")), r"\s+", " ")))


def prefers_heading(heading: Column, title: Column) -> Column:
    """Whether the page's heading makes the better title: it is the title, one part of it, or there is no title."""
    h, t = _token(heading), _token(title)
    return (h != "") & ((t == "") | (t == h) | F.array_contains(F.split(t, r"\s*(?:[-|:•·]|–|—)\s*"), h))


def titled(text: Column, title: Column) -> Column:
    """With ``# title`` on top, unless it starts with a first-level heading or has no title."""
    plain = F.coalesce(title, F.lit("")) == ""
    return once(text, lambda t: F.when(plain | F.ltrim(t).startswith("# "), t).otherwise(F.concat(F.lit("# "), title, F.lit("\n\n"), t)))


def has_truncated_sentences(text: Column) -> Column:
    """Three or more lines of over 20 characters, over 95 % of which end without a closing sign."""
    lines = F.filter(F.transform(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(" \t\r\x0b\x0c"))), lambda x: F.length(x) > 20)
    open_ = F.size(F.filter(lines, lambda x: ~x.rlike(r"[.!?:;\"')\]`]$")))
    return (F.size(lines) >= 3) & (open_ > 0.95 * F.size(lines))


def real_images(html: Column) -> Column:
    """Images but those whose source is inline data."""
    return F.regexp_count(html, F.lit(r"(?i)<img\b")) - F.regexp_count(html, F.lit(r"(?i)<img\b[^<>]*?\ssrc\s*=\s*[\"']?data:"))


# Headings from which the gate holds, and the largest share of them without content.
LEAST_HEADINGS, MOST_EMPTY_SHARE = 5, 0.15


def few_empty_sections(html: Column) -> Column:
    """Whether at most the set share of an article's headings have nothing below them before one of the same or a higher level.

    The article falls into pieces that begin with a heading; an empty piece whose follower isn't deeper is an empty section.
    """
    parts = F.slice(F.split(html, r"(?i)(?=<h[1-6]\b)"), 2, 1_000_000_000)
    rest = lambda x: F.regexp_replace(x, r"(?is)^<h[1-6]\b.*?</h[1-6]\s*>", "")
    holds = lambda x: (F.btrim(F.regexp_replace(rest(x), r"<[^<>]*+>", ""), F.lit(" \t\r\n")) != "") | rest(x).rlike(r"(?i)<(?:img|table|pre|code|ul|ol|figure|blockquote)\b")

    def judged(sections: Column) -> Column:
        shown = F.filter(sections, lambda x: ~x["hidden"])
        deeper = lambda x, i: F.coalesce(F.get(sections, i + 1)["level"] > x["level"], F.lit(False))
        empty = F.size(F.filter(sections, lambda x, i: ~x["hidden"] & ~x["holds"] & ~deeper(x, i)))
        return (F.size(shown) < LEAST_HEADINGS) | (empty <= MOST_EMPTY_SHARE * F.size(shown))

    hidden = lambda x: F.regexp_extract(x, r"(?s)^<[^<>]*+>", 0).rlike(r"screen-reader-text|sr-only|visually-hidden")
    row = lambda x: F.struct(F.substring(x, 3, 1).cast("int").alias("level"), holds(x).alias("holds"), hidden(x).alias("hidden"))
    return once(F.transform(parts, row), judged)


def keeps_enough(article: Column, page: Column) -> Column:
    """Retention gate: of a page's headings, code, tables and images an article keeps at least the set shares."""
    out = F.lit(True)
    # Pattern, least count in the page for the rule to hold, share to keep.
    for pattern, least, share in (("h[1-6]", 1, 0.3), ("pre", 1, 0.15), ("table", 1, 0.5), ("img", 4, 0.2)):
        count = (lambda c: real_images(c)) if pattern == "img" else (lambda c, p=pattern: F.regexp_count(c, F.lit(rf"(?i)<{p}\b")))
        out = out & ((count(page) < least) | (count(article) >= share * count(page)))
    return out


def enough_content(article_length: Column, page_length: Column) -> Column:
    return (page_length < 100) | (article_length >= 0.15 * page_length)


# Languages told by a class name's prefix.
LANGUAGE_PREFIXES = ("language-", "lang-", "highlight-")


def language_of_class(names: Column, data_language: Column) -> Column:
    """Code language of a class attribute, else of data-language; null if neither tells."""
    found = F.regexp_extract(F.coalesce(names, F.lit("")), r"(?i)(?:^|\s)(?:" + "|".join(LANGUAGE_PREFIXES) + r")([\w+#.-]+)", 1)
    words = F.split(F.btrim(F.coalesce(names, F.lit(""))), r"\s+")
    beside = F.get(F.filter(words, lambda x: (F.lower(x) != "hljs") & ~F.lower(x).startswith("hljs-")), F.lit(0))
    data = F.regexp_extract(F.coalesce(data_language, F.lit("")), r"^\s*(\w+)\s*$", 1)
    return F.lower(F.coalesce(F.nullif(found, F.lit("")), F.when(F.array_contains(words, "hljs"), beside), F.nullif(data, F.lit(""))))


def language_of_code(code: Column) -> Column:
    """Code language by the first rule that fits."""
    return (
        F.when(code.rlike(r"\b(?:fn|impl|struct|enum|let mut)\b") & code.rlike(r"[{;]"), "rust").when(code.rlike(r"(?m)^package \w+|\bfunc \w*\("), "go")
        .when(code.rlike(r"className=|jsx"), "jsx").when(code.rlike(r"\b(?:interface|type) \w+|: (?:string|number|boolean)\b"), "typescript")
        .when(code.rlike(r"(?i)\bselect\b.+\bfrom\b|\binsert into\b|\bcreate table\b"), "sql").when(code.rlike(r"(?i)<(?:!doctype|html|div|span|body|head)\b"), "html")
        .when(code.rlike(r"(?m)^\s*(?:def|class) \w+.*:|\b(?:None|True|False)\b|^\s*(?:from \w+ )?import \w+"), "python").when(code.rlike(r"[.#]?[\w-]+\s*\{[^}]*[\w-]+\s*:[^}]*;"), "css")
        .when(code.rlike(r"(?m)^\s*(?:\$ |npm |pip |git |cd |sudo |curl |#!/bin/)"), "bash").when(code.rlike(r"(?m)^[\w-]+:\s*(?:\S.*)?$") & ~code.rlike(r"[{};]"), "yaml")
        .when(code.rlike(r"\b(?:const|let|var|function)\b|=>"), "javascript").when(code.rlike(r"(?s)^\s*[\[{].*[\]}]\s*$"), "json")
    )


def open_fence(text: Column) -> Column:
    """The marks of a fence that is still open at the end; an empty string if none is."""
    return F.regexp_extract(F.regexp_replace(text, r"(?ms)^[ \t]*(`{3,}|~{3,})[^\n]*\n(?:.*?\n)??[ \t]*\1[`~]*[ \t]*$", ""), r"(?m)^[ \t]*(`{3,}|~{3,})[^\n]*$", 1)


def inline_limited(text: Column, limit: int) -> Column:
    """struct<content, content_size, truncated>: at most ``limit`` characters, the marker included; 0 means no limit.

    A cut never ends in an open link; an open fence is closed before the marker.
    """
    if not limit:
        return F.struct(text.alias("content"), F.length(text).alias("content_size"), F.lit(False).alias("truncated"))
    most = max(0, limit - len(MARKER))

    def short(cut: Column) -> Column:
        fence = open_fence(cut)
        closer = F.concat(F.lit("\n"), fence, F.lit("\n"))
        fenced = F.concat(F.substr(cut, F.lit(1), F.greatest(F.lit(0), most - F.length(closer))), closer)
        return F.when(fence != "", fenced).otherwise(F.regexp_replace(cut, r"!?\[[^\]\[]*+(?:\](?:\([^)]*+)?+)?+\z", ""))

    over = F.length(text) > limit
    content = F.when(over, F.substring(F.concat(once(F.substring(text, 1, most), short), F.lit(MARKER)), 1, limit)).otherwise(text)
    return F.struct(content.alias("content"), F.length(text).alias("content_size"), over.alias("truncated"))


def repository_heading_stripped(text: Column, heading: Column, url: Column) -> Column:
    """On a repository's own page, without a leading heading equal to the page's heading."""
    lead = F.regexp_extract(text, r"\A\s*#{1,6}\s+([^\n]+?)\s*(?:\n|\z)", 1)
    return F.when(U.is_repository_root(url) & (_token(lead) != "") & (_token(lead) == _token(heading)), F.regexp_replace(text, r"\A\s*#{1,6}\s+[^\n]+\n*", "")).otherwise(text)


def section(text: Column, topic: str) -> Column:
    """The part of a text under the first top-level heading that begins with ``topic``, heading included; null without one."""
    parts = F.split(text, r"\n(?=# )")
    return F.get(F.filter(parts, lambda x: F.lower(x).startswith(f"# {topic.lower()}")), F.lit(0))


def size_label(size: Column) -> Column:
    kb, mb = size / 1024.0, size / 1048576.0
    return F.when(size < 1024, F.concat(size.cast("string"), F.lit(" B"))).when(size < 10240, F.format_string("%.1f KB", kb)).when(size < 1048576, F.format_string("%.0f KB", kb)).otherwise(F.format_string("%.1f MB", mb))
