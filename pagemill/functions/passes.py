"""Single clean-up passes over page markup, each one replacement in a column expression.

They work on flat elements (no element of the same name inside), which is where such controls occur; order is up to the caller, and
``prepared`` applies them in the order that content extraction needs.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from pagemill.functions.binding import inside, once

# Lazy-loading attributes that hold an image's real address.
LAZY_SOURCES = ("data-src", "data-lazy-src", "data-original")

# Kinds of call-outs and their Markdown alert names.
ALERTS = (("warning", "WARNING"), ("caution", "CAUTION"), ("danger", "CAUTION"), ("important", "IMPORTANT"), ("tip", "TIP"), ("info", "NOTE"), ("note", "NOTE"))


def noscript_images(html: Column) -> Column:
    """Images that only a noscript element holds come out of it."""
    return F.regexp_replace(html, r"(?is)<noscript\b[^<>]*>\s*(<img\b[^<>]*>)\s*</noscript>", "$1")


def lazy_images(html: Column) -> Column:
    """Images without a source of their own get that of a lazy-loading attribute."""
    for name in LAZY_SOURCES:
        html = F.regexp_replace(html, rf"(?is)<img\b(?![^<>]*\ssrc=)([^<>]*?)\s{name}=", "<img$1 src=")
    return html


def placeholder_source(src: Column) -> Column:
    """Whether an image source stands for another: empty, a data address, or a blank or spacer file."""
    return F.coalesce((F.btrim(src) == "") | F.lower(src).startswith("data:") | F.lower(src).rlike(r"(?:^|/)(?:placeholder|blank|spacer|pixel|1x1|transparent)[\w-]*\.(?:gif|png|svg|jpe?g)"), F.lit(True))


# Hosts of the image proxy that puts the origin's host first in the path.
PROXY_HOST = r"^https?://i[0-9]\.wp\.com/"
PROXY_PATH = r"(?i)^https?://i[0-9]\.wp\.com/[^/?#]*\.[^/?#]*(/[^?#]+)"


def proxied(src: Column) -> Column:
    """Whether an image comes through the proxy."""
    return F.coalesce(F.lower(src).rlike(PROXY_HOST), F.lit(False))


def unproxied(src: Column, page_host: Column) -> Column:
    """A proxied image's address at the page's own host; other addresses stay."""
    path = F.regexp_extract(src, PROXY_PATH, 1)
    return F.when(proxied(src) & (path != ""), F.concat(F.lit("https://"), page_host, path)).otherwise(src)


def images_unproxied(html: Column, page_host: Column) -> Column:
    """Images without a srcset at the page's own host instead of the proxy's."""

    def image(tag: Column) -> Column:
        src = F.regexp_extract(tag, r"(?is)\ssrc\s*=\s*[\"']([^\"']*+)[\"']", 1)
        return F.when(proxied(src) & ~tag.rlike(r"(?i)\ssrcset\s*="), F.replace(tag, src, unproxied(src, page_host))).otherwise(tag)

    return once(html, lambda h: F.when(h.contains(".wp.com/"), each(h, r"(?is)<img\b[^<>]*+>", image)).otherwise(h))


def host_like(text: Column) -> Column:
    """Whether a text is a bare host name."""
    return F.coalesce(text.rlike(r"(?i)^[a-z0-9.-]+\.[a-z]{2,}$"), F.lit(False))


# Starts of addresses that are not resolved.
KEPT_PREFIXES = ("#", "javascript:", "mailto:", "tel:", "data:", "blob:")


def kept_address(href: Column) -> Column:
    """Whether an address stays as it is when a page's addresses are made absolute."""
    out, low = F.lit(False), F.lower(F.ltrim(href))
    for prefix in KEPT_PREFIXES:
        out = out | low.startswith(prefix)
    return F.coalesce(out, F.lit(False))


def code_editors(html: Column) -> Column:
    """An editor's hidden highlighted block and its text area become one plain code block."""
    return F.regexp_replace(html, r"(?is)<pre\b[^<>]*aria-hidden=[\"']true[\"'][^<>]*>(?:(?!</?pre\b).)*+</pre\s*>\s*<textarea\b[^<>]*>((?:(?!</?textarea\b).)*+)</textarea\s*>", "<pre><code>$1</code></pre>")


def campaign_links(html: Column) -> Column:
    """Links with campaign parameters go, with their text."""
    return F.regexp_replace(html, r"(?is)<a\b[^<>]*\shref=[\"'][^\"']*[?&](?:amp;)?utm_(?:source|medium|campaign)=[^\"']*[\"'][^<>]*>(?:(?!</?a\b).)*+</a\s*>", "")


def heading_anchors(html: Column) -> Column:
    """Permalink anchors inside headings go; wrapped heading text stays."""
    return F.regexp_replace(html, r"(?is)<a\b[^<>]*\shref=[\"']#[^\"']*[\"'][^<>]*>\s*(?:#|¶|§|&para;|🔗)?\s*</a\s*>", "")


def copy_buttons(html: Column) -> Column:
    return F.regexp_replace(html, r"(?is)<(button|a|div|span)\b[^<>]*class=[\"'][^\"']*\bcopy(?:-?(?:btn|button|code))?\b[^\"']*[\"'][^<>]*>(?:(?!</?\1\b).)*+</\1\s*>", "")


def screen_reader_text(html: Column) -> Column:
    return F.regexp_replace(html, r"(?is)<(span|div|p|a)\b[^<>]*class=[\"'][^\"']*\b(?:sr-only|visually-hidden|screen-reader-text)\b[^\"']*[\"'][^<>]*>(?:(?!</?\1\b).)*+</\1\s*>", "")


def live_regions(html: Column) -> Column:
    """Short announcements for assistive software go."""
    return F.regexp_replace(html, r"(?is)<(div|span|p)\b[^<>]*\saria-live=[^<>]*>([^<]{1,160})</\1\s*>", "")


def tab_panels(html: Column) -> Column:
    """Hidden tab panels become visible; the tabs' own buttons go."""
    shown = F.regexp_replace(html, r"(?is)(<[a-z]+\b[^<>]*\srole=[\"']tabpanel[\"'][^<>]*?)\s(?:hidden|aria-hidden=[\"']true[\"'])(?=[\s>])", "$1")
    return F.regexp_replace(shown, r"(?is)<(button|a|li)\b[^<>]*\srole=[\"']tab[\"'][^<>]*>(?:(?!</?\1\b).)*+</\1\s*>", "")


def inline_buttons(html: Column) -> Column:
    """Buttons inside a line of text leave their text."""
    return F.regexp_replace(html, r"(?is)(?<=[\w,.] )<button\b[^<>]*>([^<]*)</button\s*>", "$1")


def badges(html: Column) -> Column:
    """A space between elements that stand side by side without one."""
    return F.regexp_replace(html, r"(?i)</(span|a|code|kbd|mark)><(span|a|code|kbd|mark)\b", "</$1> <$2")


def alerts(html: Column) -> Column:
    """Call-out boxes become quotes with an alert's name."""
    for kind, name in ALERTS:
        html = F.regexp_replace(html, rf"(?is)<(div|aside|section)\b[^<>]*class=[\"'][^\"']*\b(?:alert|admonition|callout)\b[^\"']*\b(?:alert-)?{kind}\b[^\"']*[\"'][^<>]*>((?:(?!</?\1\b).)*+)</\1\s*>", rf"<blockquote>[!{name}]<br>$2</blockquote>")
    return html


CELL = r"(?is)<(t[hd])\b([^<>]*+)>((?:(?!</?t[hdr]\b|</?table\b).)*+)</t[hd]\s*>"


def each(html: Column, pattern: str, change) -> Column:
    """``html`` with ``change`` applied to each stretch that ``pattern`` matches."""

    def apart(h: Column) -> Column:
        found, between = F.regexp_extract_all(h, F.lit(pattern), F.lit(0)), F.split(h, pattern, -1)
        return F.array_join(F.zip_with(between, found, lambda x, y: F.concat(F.coalesce(x, F.lit("")), F.coalesce(change(y), F.lit("")))), "")

    return once(html, apart)


def table_cells(html: Column) -> Column:
    """Cells on one line: breaks, blocks and line ends in them become spaces, pipes are escaped; cells of a table head are th."""

    def cell(x: Column) -> Column:
        flat = F.regexp_replace(x, r"(?is)<br\b[^<>]*>|</?(?:div|p|ul|li|h[1-6])\b[^<>]*>|\r?\n", " ")
        return F.replace(flat, F.lit("|"), F.lit("\\|"))

    head = lambda x: F.regexp_replace(x, r"(?i)<(/?)td\b", "<$1th")
    return once(html, lambda h: F.when(h.rlike(r"(?i)<t[hd]\b"), each(each(h, CELL, cell), rf"(?is)<thead\b[^<>]*>{inside('thead')}</thead\s*>", head)).otherwise(h))


def definition_lists(html: Column) -> Column:
    """Terms in bold, definitions after a colon."""
    return F.regexp_replace(F.regexp_replace(html, rf"(?is)<dt\b[^<>]*>\s*+({inside('dt')})</dt\s*>", "<p><b>$1</b></p>"), rf"(?is)<dd\b[^<>]*>\s*+({inside('dd')})</dd\s*>", "<p>: $1</p>")


def code_lines(html: Column) -> Column:
    """Highlighted code with one element for each line gets its line breaks."""
    return F.regexp_replace(html, r"(?is)(<span\b[^<>]*class=[\"'](?:line|token-line|code-line)[\"'][^<>]*>[^\n<]*</span>)(?=<span\b[^<>]*class=[\"'](?:line|token-line|code-line))", "$1\n")


PASSES = (noscript_images, lazy_images, tab_panels, code_editors, copy_buttons, screen_reader_text, live_regions, campaign_links, heading_anchors, inline_buttons, badges, alerts, code_lines, table_cells, definition_lists)


def prepared(html: Column) -> Column:
    """All passes, in order."""
    for step in PASSES:
        html = step(html)
    return html


def toc_removed(text: Column) -> Column:
    """A table of contents in Markdown, its heading and its list of in-page links however long, goes."""
    heading = r"(?im)^(?:#{1,6}\s+)?(?:table of contents|contents|on this page)[ \t]*+\n++"
    return F.regexp_replace(text, heading + r"(?:[ \t]*+[-*+] \[[^\]\n]++\]\(#[^)\n]++\)[ \t]*+(?:\n++|\z))++", "")


def orphans_promoted(text: Column) -> Column:
    """A lone ``Note: ..`` line, or a lone line of two to six capitalized words, followed by text becomes a heading."""
    noted = F.regexp_replace(text, r"(?m)(^|\n\n)((?i:example|note|tip|warning|important|caution): \S[^\n]{0,60}[^\n.!?:;,])\n\n(?=\S)", "$1### $2\n\n")
    return F.regexp_replace(noted, r"(^|\n\n)((?:[A-Z][\w'-]*+ ){1,5}[A-Z][\w'-]*+)\n\n(?=[A-Za-z])", "$1## $2\n\n")


def flight_payloads(html: Column) -> Column:
    """array<string>: the strings that a page's own payload scripts push, decoded; malformed ones are skipped."""
    raw = F.regexp_extract_all(html, F.lit(r"self\.__next_f\.push\(\[1,(\"[^\"\\]*+(?:\\.[^\"\\]*+)*+\")\]\)"), F.lit(1))
    return F.filter(F.transform(raw, lambda x: F.get_json_object(F.concat(F.lit('{"v":'), x, F.lit("}")), "$.v")), lambda x: x.isNotNull())


def logged(fields: Column) -> Column:
    """A map of log fields without those whose names speak of secrets."""
    return F.map_filter(fields, lambda k, v: ~F.lower(k).rlike(r"token|secret|password|authorization|cookie|api[_-]?key|credential|session"))


def hmac_sha256(key: bytes, message: Column) -> Column:
    """Keyed digest of a string column as hex, by two plain digests."""
    block = key.ljust(64, b"\0")
    inner = F.sha2(F.concat(F.lit(bytes(b ^ 0x36 for b in block)), message.cast("binary")), 256)
    return F.sha2(F.concat(F.lit(bytes(b ^ 0x5C for b in block)), F.unhex(inner)), 256)


def cursor(anchor: Column, key: bytes) -> Column:
    """A page cursor that names its anchor and can't be forged: URL-safe base64 of the anchor, a dot, a keyed digest."""
    body = F.rtrim(F.translate(F.base64(F.concat(F.lit('{"anchor":"'), anchor, F.lit('"}')).cast("binary")), "+/", "-_"), F.lit("="))
    return F.concat(body, F.lit("."), hmac_sha256(key, body))


def cursor_anchor(value: Column, key: bytes) -> Column:
    """The anchor of a valid cursor, else null."""
    body, mark = F.split_part(value, F.lit("."), F.lit(1)), F.split_part(value, F.lit("."), F.lit(2))
    plain = F.translate(body, "-_", "+/")
    padded = F.rpad(plain, (F.ceil(F.length(plain) / 4) * 4).cast("int"), F.lit("="))
    text = F.try_to_binary(padded, F.lit("base64")).cast("string")
    return F.when(mark == hmac_sha256(key, body), F.get_json_object(text, "$.anchor"))
