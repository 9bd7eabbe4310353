"""Page metadata: from the head's tags to one struct of nullable strings."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from pagemill.functions import html as H, urls as U
from pagemill.functions.binding import inside, once

FIELDS = ("title", "description", "author", "image", "favicon", "published_at", "modified_at")

# Most characters of each field; longer values are dropped, not cut.
LIMITS = {"title": 512, "description": 2048, "author": 512, "image": 2048, "favicon": 2048, "published_at": 64, "modified_at": 64}


def _meta(html: Column, kind: str, name: str) -> Column:
    """Content of the last meta tag of that property or name with any content."""
    tags = F.filter(H.start_tags(html, "meta"), lambda t: t.rlike(rf"(?is)\s{kind}\s*=\s*[\"']?{name}(?=[\"'\s/>])"))
    values = F.filter(F.transform(tags, lambda t: F.btrim(H.attribute(t, "content"))), lambda v: v.isNotNull() & (v != ""))
    return F.try_element_at(values, F.lit(-1))


def title_tag(html: Column) -> Column:
    inner = F.regexp_extract(html, rf"(?is)<title\b[^<>]*>({inside('title')})</title\s*>", 1)
    return F.nullif(F.btrim(H.unescaped(inner), F.lit(" \t\n\r")), F.lit(""))


def document_title(title: Column, url: Column) -> Column:
    """The repository's name on a code host's own page, else the title."""
    s = U.segments(url)
    return F.when(title.startswith("GitHub - ") & U.is_repository_root(url), F.concat_ws("/", F.get(s, F.lit(0)), F.get(s, F.lit(1)))).otherwise(title)


def favicon(html: Column, url: Column) -> Column:
    """The icon link with the best size or type, as an absolute http address."""
    icons = F.filter(H.start_tags(html, "link"), lambda t: t.rlike(r"(?is)\srel\s*=\s*[\"']?(?:shortcut )?icon[\"'\s/>]"))
    tests = (r"(?is)rel\s*=\s*[\"']?icon.*sizes\s*=\s*[\"']?32x32", r"(?is)rel\s*=\s*[\"']?icon.*type\s*=\s*[\"']?image/svg\+xml", r"(?is)rel\s*=\s*[\"']?icon", r"(?is)rel\s*=\s*[\"']?shortcut icon")
    first = lambda pattern: F.get(F.filter(icons, lambda t: t.rlike(pattern)), F.lit(0))
    picks = [first(p) for p in tests]
    found = U.resolved(H.attribute(F.coalesce(*picks), "href"), url)
    return once(found, lambda x: F.when(x.rlike(r"^https?://"), x))


def metadata(html: Column, url: Column) -> Column:
    """The struct of FIELDS: social before card before standard tags."""
    title = F.coalesce(_meta(html, "property", "og:title"), _meta(html, "name", "twitter:title"), title_tag(html))
    about = F.coalesce(_meta(html, "property", "og:description"), _meta(html, "name", "twitter:description"), _meta(html, "name", "description"))
    return F.struct(
        once(title, lambda t: document_title(t, url)).alias("title"), about.alias("description"), _meta(html, "name", "author").alias("author"), _meta(html, "property", "og:image").alias("image"),
        favicon(html, url).alias("favicon"), _meta(html, "property", "article:published_time").alias("published_at"), _meta(html, "property", "article:modified_time").alias("modified_at"),
    )


def head_metadata(html: Column, url: Column) -> Column:
    """Metadata of the head section alone; null without a head."""
    head = H.head_section(html)
    return F.when(head.isNotNull(), metadata(head, url))


def merged(early: Column, late: Column) -> Column:
    """Field by field: late, else early."""
    return F.struct(*[F.coalesce(late[f], early[f]).alias(f) for f in FIELDS])


def limited(found: Column) -> Column:
    """Trimmed fields within LIMITS; empty or over-long ones become null, and all null makes the struct null."""

    def checked(m: Column) -> Column:
        trimmed = {f: F.btrim(m[f]) for f in FIELDS}
        fields = [F.when((F.length(v) > 0) & (F.length(v) <= LIMITS[f]), v).alias(f) for f, v in trimmed.items()]
        return F.struct(*fields)

    return once(once(found, checked), lambda m: F.when(F.coalesce(*[m[f] for f in FIELDS]).isNotNull(), m))
