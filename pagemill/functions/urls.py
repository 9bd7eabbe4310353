"""URL column functions: parts, normalization, redaction, raw-content rewrites, labels, the address policy."""

from __future__ import annotations

import ipaddress
import re
from urllib.parse import quote, unquote_to_bytes

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from pagemill.functions.binding import once

MAX_URL_LENGTH = 2048

# File name endings whose content is plain text.
RAW_TEXT_EXTENSIONS = (".md", ".markdown", ".txt", ".json", ".yaml", ".yml", ".toml", ".xml", ".csv", ".rst", ".adoc", ".org")

# Host suffixes, hosts and networks that must not be fetched.
BLOCKED_SUFFIXES = (".local", ".internal")
METADATA_HOSTS = ("169.254.169.254", "metadata.google.internal", "100.100.100.200", "fd00:ec2:0:0:0:0:0:254")
BLOCKED_V4 = (
    ("0.0.0.0", 8), ("10.0.0.0", 8), ("100.64.0.0", 10), ("127.0.0.0", 8), ("169.254.0.0", 16),
    ("172.16.0.0", 12), ("192.168.0.0", 16), ("224.0.0.0", 4), ("240.0.0.0", 4),
)
BLOCKED_V6 = (
    ("::", 128), ("::1", 128), ("64:ff9b::", 96), ("64:ff9b:1::", 48), ("2001::", 32),
    ("2002::", 16), ("fc00::", 7), ("fe80::", 10), ("ff00::", 8), ("::", 96),
)

_SPLIT = r"^([a-zA-Z][a-zA-Z0-9+.-]*)://(?:([^/?#@]*)@)?(\[[^\[\]/?#@]*\]|[^/?#:]*)(?::([0-9]*))?(/[^?#]*)?(\?[^#]*)?(#.*)?$"


def _part(url: Column, group: int) -> Column:
    return F.regexp_extract(url, _SPLIT, group)


def scheme(url: Column) -> Column:
    return F.lower(_part(url, 1))


def host(url: Column) -> Column:
    return F.lower(_part(url, 3))


def path(url: Column) -> Column:
    return _part(url, 5)


def query(url: Column) -> Column:
    return _part(url, 6)


def fragment(url: Column) -> Column:
    return _part(url, 7)


def origin(url: Column) -> Column:
    """Scheme and host, with a port that isn't the scheme's own."""
    port = _part(url, 4)
    own = ((scheme(url) == "http") & (port == "80")) | ((scheme(url) == "https") & (port == "443")) | (port == "")
    return F.concat(scheme(url), F.lit("://"), host(url), F.when(own, F.lit("")).otherwise(F.concat(F.lit(":"), port)))


def base(url: Column) -> Column:
    """The URL without query and fragment."""
    return F.concat(origin(url), F.when(path(url) == "", F.lit("/")).otherwise(path(url)))


def segments(url: Column) -> Column:
    return F.filter(F.split(path(url), "/"), lambda x: x != "")


def normalized(url: Column) -> Column:
    """struct<url, hostname, error> for ASCII URLs: trimmed, bounded, http or https, no credentials, lower host, no default port.

    ``error`` is null exactly if the URL may be fetched; the other fields are null otherwise. IPv6 addresses stand in brackets; ports that are no numbers are invalid.
    """


    def judged(p: Column) -> Column:
        bare, v6 = F.rtrim(p["host"], F.lit(".")), p["v6"]
        error = (
            F.when(p["url"] == "", "empty").when(F.length(p["url"]) > MAX_URL_LENGTH, "too-long").when(p["scheme"] == "", "invalid")
            .when(~p["scheme"].isin("http", "https"), "unsupported-protocol").when(p["user"] != "", "credentials").when((p["host"] == "") | (p["host"].startswith("[") & v6.isNull()), "invalid")
            .when(p["host"].isin(*METADATA_HOSTS), "cloud-metadata").when(blocked_v4(p["host"]) | blocked_v6_digits(v6), "blocked-ip").when(_any_suffix(bare, BLOCKED_SUFFIXES) | (bare == "localhost"), "blocked-host")
        )
        return F.struct(F.when(error.isNull(), p["whole"]).alias("url"), F.when(error.isNull(), p["host"]).alias("hostname"), error.alias("error"))

    u = F.btrim(F.coalesce(url, F.lit("")))
    v6 = F.when(host(u).startswith("["), v6_digits(F.btrim(host(u), F.lit("[]"))))
    parts = F.struct(u.alias("url"), scheme(u).alias("scheme"), _part(u, 2).alias("user"), host(u).alias("host"), v6.alias("v6"), F.concat(base(u), query(u), fragment(u)).alias("whole"))
    return once(parts, judged)


def _any_suffix(value: Column, suffixes) -> Column:
    out = F.lit(False)
    for s in suffixes:
        out = out | value.endswith(s)
    return out


def redacted(url: Column) -> Column:
    """Without credentials, query and fragment."""
    return F.regexp_replace(F.regexp_replace(url, r"[?#].*$", ""), r"^([a-zA-Z][a-zA-Z0-9+.-]*://)[^/?#@]*@", "$1")


def is_raw(url: Column) -> Column:
    """Whether the URL is already a raw-content address of a code host."""
    low = F.lower(url)
    return low.contains("raw.githubusercontent.com") | low.contains("gist.githubusercontent.com") | low.contains("/-/raw/") | low.rlike(r"bitbucket\.org/[^/]+/[^/]+/raw/")


def is_raw_text(url: Column) -> Column:
    """Whether the URL serves plain text: a raw address, or an ending in RAW_TEXT_EXTENSIONS."""
    ending = F.regexp_extract(F.lower(base(url)), r"(\.[^.]*)$", 1)
    return F.coalesce(is_raw(url) | ending.isin(*RAW_TEXT_EXTENSIONS), F.lit(False))


def raw_rewrite(url: Column) -> Column:
    """struct<url, transformed, platform>: viewer pages of code hosts become their raw-content address; anything else stays."""
    b, mark = base(url), fragment(url)
    gist_raw, gist = r"^https?://gist\.github\.com/([^/]+)/([^/]+)/raw/(.+)$", r"^https?://gist\.github\.com/([^/]+)/([^/]+)$"
    blob = r"^https?://(?:[^/.]+\.)?github\.com/([^/]+)/([^/]+)/blob/([^/]+)/(.+)$"
    lab, bucket = r"^(https?://(?:[^/]+\.)?gitlab\.com/.+)/-/blob/([^/]+/.+)$", r"^(https?://(?:[^/.]+\.)?bitbucket\.org/[^/]+/[^/]+)/src/([^/]+/.+)$"
    name = F.translate(F.regexp_extract(mark, r"^#file-(.+)$", 1), "-", ".")
    to = "https://gist.githubusercontent.com/$1/$2/raw"
    cases = (
        ("github-gist", gist_raw, F.regexp_replace(b, gist_raw, to + "/$3")),
        ("github-gist", gist, F.concat(F.regexp_replace(b, gist, to), F.when(name != "", F.concat(F.lit("/"), name)).otherwise(F.lit("")))),
        ("github", blob, F.regexp_replace(b, blob, "https://raw.githubusercontent.com/$1/$2/$3/$4")),
        ("gitlab", lab, F.regexp_replace(b, lab, "$1/-/raw/$2")),
        ("bitbucket", bucket, F.regexp_replace(b, bucket, "$1/raw/$2")),
    )
    platform, new = F.when(is_raw(url), F.lit(None).cast("string")), F.when(is_raw(url), url)
    for p, pattern, value in cases:
        platform, new = platform.when(b.rlike(pattern), p), new.when(b.rlike(pattern), value)
    return F.struct(new.otherwise(url).alias("url"), platform.isNotNull().alias("transformed"), platform.alias("platform"))


def display_label(url: Column) -> Column:
    """A short label: the host, owner and repository on code hosts, an article's name, or host and last path segment."""
    h, s = F.regexp_replace(host(url), r"^www\.", ""), segments(url)
    last = F.coalesce(F.try_element_at(s, F.lit(-1)), F.lit(""))
    short = F.when(F.length(last) > 20, F.concat(F.substring(last, 1, 17), F.lit("..."))).otherwise(last)
    return (
        F.when(h == "", "unknown").when(F.size(s) == 0, h)
        .when(h.isin("github.com", "gitlab.com", "bitbucket.org") & (F.size(s) >= 2), F.concat_ws("/", h, s[0], F.get(s, F.lit(1))))
        .when(h.endswith("wikipedia.org") & (s[0] == "wiki") & (F.size(s) >= 2), F.concat(F.lit("wikipedia.org/"), F.get(s, F.lit(1))))
        .when(F.size(s) == 1, F.concat(h, F.lit("/"), short)).otherwise(F.concat(h, F.lit("/…/"), short))
    )


def is_repository_root(url: Column) -> Column:
    return host(url).isin("github.com", "www.github.com") & (F.size(segments(url)) == 2)


def resolved(href: Column, page: Column) -> Column:
    """An href as an absolute URL of its page; hrefs with white space, other schemes and bare fragments stay as they are."""

    def against(p: Column) -> Column:
        h = p["href"]
        joined = F.concat(F.when(p["folder"] == "", F.lit("/")).otherwise(p["folder"]), F.regexp_replace(h, r"^(?:\./)+", ""))
        joined = F.regexp_replace(joined, r"/\./", "/")
        # dot segments, innermost first; depth beyond 8 stays
        for _ in range(8):
            joined = F.regexp_replace(joined, r"/(?!\.\./)[^/?#]+/\.\./", "/")
        return (
            F.when(h.rlike(r"\s") | h.rlike(r"^[a-zA-Z][a-zA-Z0-9+.-]*:") | h.startswith("#") | (h == ""), h)
            .when(h.startswith("//"), F.concat(p["scheme"], F.lit(":"), h)).when(h.startswith("/"), F.concat(p["origin"], h))
            .otherwise(F.concat(p["origin"], F.regexp_replace(joined, r"^/(?:\.\./)+", "/")))
        )

    parts = F.struct(F.btrim(href).alias("href"), scheme(page).alias("scheme"), origin(page).alias("origin"), F.regexp_replace(path(page), r"[^/]*$", "").alias("folder"))
    return F.when(href.isNotNull(), once(parts, against))


@F.pandas_udf(T.StringType())
def _idna(name: pd.Series) -> pd.Series:
    def one(x):
        try:
            return None if x is None else ".".join(p.encode("idna").decode() if not p.isascii() else p for p in x.split("."))
        except UnicodeError:
            return None

    return name.map(one)


def ascii_host(name: Column) -> Column:
    """A host name in ASCII: lower case, without trailing dots, labels of other letters in their ASCII form; null where that can't be."""
    return F.nullif(F.lower(_idna(F.rtrim(F.lower(F.btrim(name)), F.lit(".")))), F.lit(""))


# Fixed values of the URL standard: full stops of host names, and characters that no host has.
_STOPS = re.compile("[.\u3002\uff0e\uff61]")
_NO_HOST = re.compile(r"[\x00-\x20#/:<>?@\[\\\]^|%\x7f]")
_WEB = re.compile(r"(https?):[/\\]*([^/\\?#]*)([^?#]*)(.*)", re.I | re.S)
_NUMBER = re.compile(r"0[xX][0-9a-fA-F]*|[0-9]+")
#: What needs a closer look: characters beyond printable ASCII, back slashes, odd slashes, per cent signs before the path, hosts that end in a number.
_ODD = r"[^\x21-\x7e]|\\|^(?i)https?:(?!//[^/])|^[^/?#]*//[^/?#]*[%\[]|^[^/?#]*//(?:[^/?#@]*@)?(?:[^/?#@:]*\.)?(?:0[xX][0-9a-fA-F]*|[0-9]+)\.?(?:[:/?#]|$)"


def _v4_of(labels: list[str]) -> str | None:
    """The dotted form of an address of one to four numbers, octal or hexadecimal too; the last one fills what is left. None if it is none."""
    if len(labels) > 4 or not all(_NUMBER.fullmatch(x) for x in labels):
        return None
    try:
        numbers = [int(x[2:] or "0", 16) if x[:2] in ("0x", "0X") else int(x, 8 if x[0] == "0" else 10) for x in labels]
    except ValueError:
        return None
    if any(n > 255 for n in numbers[:-1]) or numbers[-1] >= 256 ** (5 - len(numbers)):
        return None
    value = sum(n * 256 ** (3 - i) for i, n in enumerate(numbers[:-1])) + numbers[-1]
    return str(ipaddress.IPv4Address(value))


def _v6_of(text: str) -> str | None:
    """An IPv6 address in its shortest form, in brackets; without a zone, which no URL has. None if it is none."""
    try:
        ip = ipaddress.IPv6Address(text)
    except ValueError:
        return None
    if ip.scope_id is not None:
        return None
    mapped = int(ip) & 0xFFFFFFFF
    return f"[::ffff:{mapped >> 16:x}:{mapped & 0xFFFF:x}]" if ip.ipv4_mapped else f"[{ip.compressed}]"


def plain_host(name: str) -> str | None:
    """A URL's host as it is asked for: escapes decoded, letters in ASCII form, numbers as a dotted address; None if it is no host."""
    if name.startswith("["):
        return _v6_of(name[1:-1])
    try:
        labels = [x.lower() if x.isascii() else x.encode("idna").decode().lower() for x in _STOPS.split(unquote_to_bytes(name).decode())]
    except UnicodeError:
        return None
    if any("." in x or _NO_HOST.search(x) for x in labels):
        return None
    bare = labels[:-1] if len(labels) > 1 and not labels[-1] else labels
    return _v4_of(bare) if _NUMBER.fullmatch(bare[-1]) else ".".join(labels)


def _as_read(url: str) -> str:
    text = re.sub(r"[\t\n\r]", "", url.strip("".join(map(chr, range(33)))))
    parts = _WEB.fullmatch(text)
    if not parts:
        return text
    user, at, place = parts[2].rpartition("@")
    name, colon, port = place.partition(":")
    if place.startswith("["):
        name, ended, port = place.partition("]")
        name, colon, port = name + "]" if ended else "/", ":" if port else "", port.removeprefix(":")
    rest = quote(parts[3].replace("\\", "/") + parts[4], safe="".join(map(chr, range(33, 127))))
    return f"{parts[1]}://{user}{at}{plain_host(name) or ''}{colon}{port}{rest}"


@F.pandas_udf(T.StringType())
def _read(url: pd.Series) -> pd.Series:
    return url.map(lambda x: None if x is None else _as_read(x))


def as_read(url: Column) -> Column:
    """A web address as browsers read it, for ``normalized`` to judge: tabs and line ends go, back slashes become slashes, host names of any script become
    ASCII (by IDNA 2003), numbers a dotted address, other characters in paths and queries escapes of UTF-8. A host that can't be is left empty, which is invalid.

    Addresses without any of these stay as they are and never reach Python.
    """
    return F.coalesce(_read(F.when(url.rlike(_ODD), url)), url)


def request_target(url: Column) -> Column:
    """struct<url, original, transformed, error>: the address normalized, rewritten to raw content where it can be, and normalized again then."""
    first = normalized(url)

    def rewritten(n: Column) -> Column:
        return once(raw_rewrite(n["url"]), lambda r: target(n, r))

    def target(n: Column, r: Column) -> Column:
        again = F.when(r["transformed"], normalized(r["url"])["url"]).otherwise(n["url"])
        return F.struct(F.when(n["error"].isNull(), again).alias("url"), n["url"].alias("original"), F.coalesce(n["error"].isNull() & r["transformed"], F.lit(False)).alias("transformed"), n["error"].alias("error"))

    return once(first, rewritten)


def with_target(rows: DataFrame, url: str = "url") -> DataFrame:
    """``rows`` with ``resolved_url`` and ``url_error``: what ``request_target`` gives, by named steps, which keep the plan small, for addresses in any script (``as_read``). An address that is no URL stays as it stands."""
    first = rows.withColumn("_n", normalized(as_read(F.col(url))))
    second = first.withColumn("_r", raw_rewrite(F.col("_n.url")))
    third = second.withColumn("_m", F.when(F.col("_r.transformed"), F.col("_r.url")))
    again = third.withColumn("_a", F.when(F.col("_m").isNotNull(), normalized(F.col("_m"))["url"]).otherwise(F.col("_n.url")))
    return again.select(*rows.columns, F.coalesce(F.when(F.col("_n.error").isNull(), F.col("_a")), F.col(url)).alias("resolved_url"), F.col("_n.error").alias("url_error"))


def host_of_header(value: Column) -> Column:
    """The host name of a Host header: first of a list, without port, brackets, trailing dots; null if none is left."""
    first = F.lower(F.btrim(F.split(value, ",")[0]))
    bare = F.when(first.startswith("["), F.regexp_extract(first, r"^\[([^\]]*)\]", 1)).otherwise(F.regexp_replace(first, r":[0-9]*$", ""))
    return F.nullif(F.rtrim(bare, F.lit(".")), F.lit(""))


def v4_number(ip: Column) -> Column:
    """A dotted IPv4 address as a number; null for anything else. ``::ffff:`` prefixes and zone ids are dropped first."""
    bare = F.regexp_replace(F.regexp_replace(F.lower(F.btrim(ip)), r"%.*$", ""), r"^::ffff:", "")
    fine = bare.rlike(r"^(?:(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])$")
    n = sum((F.split_part(bare, F.lit("."), F.lit(i + 1)).try_cast("long") * 256 ** (3 - i) for i in range(4)), F.lit(0).cast("long"))
    return F.when(fine, n)


def v4_range(network: str, bits: int) -> tuple[int, int]:
    low = 0
    for part in network.split("."):
        low = low * 256 + int(part)
    return low, low + (1 << (32 - bits)) - 1


def blocked_v4(ip: Column) -> Column:
    """Whether the address lies in a blocked IPv4 network: a few comparisons in the projection, no join."""

    def inside(n: Column) -> Column:
        out = F.lit(False)
        for network, bits in BLOCKED_V4:
            low, high = v4_range(network, bits)
            out = out | n.between(low, high)
        return out

    return F.coalesce(F.exists(F.array(v4_number(ip)), inside), F.lit(False))


def block_list(spark: SparkSession) -> DataFrame:
    """(network, low, high): the blocked IPv4 networks as a table of nine rows, for range joins."""
    return spark.createDataFrame([(f"{n}/{b}", *v4_range(n, b)) for n, b in BLOCKED_V4], "network string, low long, high long")


@F.pandas_udf(T.BinaryType())
def _v6_bytes(ip: pd.Series) -> pd.Series:
    def one(x):
        try:
            return ipaddress.IPv6Address((x or "").partition("%")[0].strip("[] ")).packed
        except ValueError:
            return None

    return ip.map(one)


def blocked_v6(ip: Column) -> Column:
    """Whether the address lies in a blocked IPv6 network: byte strings compare like the addresses."""
    n, out = _v6_bytes(ip), F.lit(False)
    for network, bits in BLOCKED_V6:
        net = ipaddress.IPv6Network((network, bits))
        out = out | n.between(F.lit(net.network_address.packed), F.lit(net.broadcast_address.packed))
    return F.coalesce(out, F.lit(False))


def v6_digits(ip: Column) -> Column:
    """An IPv6 address, without brackets or zone, as its 32 hexadecimal digits, which compare like the addresses; null for anything else."""

    def whole(text: Column) -> Column:
        halves = F.split(text, "::")
        groups = lambda half: F.when(F.coalesce(half, F.lit("")) == "", F.array().cast("array<string>")).otherwise(F.split(half, ":"))
        return once(F.struct(groups(halves[0]).alias("left"), groups(F.get(halves, F.lit(1))).alias("right"), F.size(halves).alias("n")), filled)

    def filled(p: Column) -> Column:
        given = F.size(p["left"]) + F.size(p["right"])
        fine = F.when(p["n"] == 1, given == 8).otherwise((p["n"] == 2) & (given <= 7)) & F.forall(F.concat(p["left"], p["right"]), lambda g: g.rlike("^[0-9a-f]{1,4}$"))
        zeros = F.array_repeat(F.lit("0"), F.greatest(8 - given, F.lit(0)))
        return F.when(fine, F.array_join(F.transform(F.concat(p["left"], zeros, p["right"]), lambda g: F.lpad(g, 4, "0")), ""))

    low = F.lower(ip)
    tail = F.regexp_extract(low, r"^.*:([0-9.]*\.[0-9.]*)$", 1)
    number = F.lpad(F.lower(F.hex(v4_number(tail))), 8, "0")
    return once(F.when(tail == "", low).otherwise(F.concat(F.regexp_extract(low, r"^(.*:)[0-9.]*$", 1), F.substring(number, 1, 4), F.lit(":"), F.substring(number, 5, 4))), whole)


def _network_digits(digits: str, bits: int) -> str:
    """Pattern of the first digits that all addresses of a network have."""
    whole, rest = divmod(bits, 4)
    if not rest:
        return digits[:whole]
    low = int(digits[whole], 16)
    return digits[:whole] + "[" + "".join(f"{n:x}" for n in range(low, low + (1 << (4 - rest)))) + "]"


def blocked_v6_digits(digits: Column) -> Column:
    """Whether ``v6_digits`` lie in a blocked network, or hold an IPv4 address (``::ffff:0:0/96``) that does: one pattern of first digits."""
    networks = [_network_digits(ipaddress.IPv6Address(n).packed.hex(), bits) for n, bits in BLOCKED_V6]
    networks += [_network_digits("0" * 20 + "ffff" + ipaddress.IPv4Address(n).packed.hex(), 96 + bits) for n, bits in BLOCKED_V4]
    return F.coalesce(digits.rlike("^(?:" + "|".join(networks) + ")"), F.lit(False))


def block_reason(target: Column) -> Column:
    """cloud-metadata, blocked-ip, blocked-suffix, or null, in this order. IPv6 targets need ``blocked_v6`` beside it."""
    low = F.lower(F.btrim(target))
    return (
        F.when(low.isin(*METADATA_HOSTS) | F.regexp_replace(low, r"^::ffff:", "").isin(*METADATA_HOSTS), "cloud-metadata")
        .when(blocked_v4(low), "blocked-ip").when(_any_suffix(low, BLOCKED_SUFFIXES), "blocked-suffix")
    )


def has_campaign(href: Column) -> Column:
    """Whether a link carries campaign parameters."""
    return href.rlike(r"[?&]utm_(?:source|medium|campaign)=")
