"""Character-set and binary detection on byte columns, and bounded cuts of text."""

from __future__ import annotations

import codecs

import pyarrow as pa
from pyspark.sql import Column, functions as F, types as T

from pagemill.functions.binding import once

SCAN = 8192

# Byte order marks, four-byte ones first.
BOMS = (("FFFE0000", "utf-32le"), ("0000FEFF", "utf-32be"), ("EFBBBF", "utf-8"), ("FFFE", "utf-16le"), ("FEFF", "utf-16be"))

# Leading bytes of binary formats.
SIGNATURES = (
    "25504446", "89504E47", "47494638", "FFD8FF", "52494646", "424D", "49492A00", "4D4D002A",
    "00000100", "504B0304", "1F8B", "425A68", "52617221", "377ABCAF", "7F454C46", "4D5A",
    "CFFAEDFE", "0061736D", "1A45DFA3", "66747970", "464C56", "494433", "FFFB", "FFFA",
    "4F676753", "664C6143", "4D546864", "774F4646", "00010000", "4F54544F", "53514C69",
)

# Application types that hold text.
TEXT_TYPES = (
    "application/json", "application/ld+json", "application/xml", "application/xhtml+xml", "application/javascript",
    "application/ecmascript", "application/x-javascript", "application/x-yaml", "application/yaml", "application/markdown",
)
TEXT_SUFFIXES = ("+json", "+xml", "+yaml", "+text", "+markdown")


def header_charset(content_type: Column) -> Column:
    """The charset parameter of a Content-Type header, in lower case; null without one."""
    raw = F.regexp_extract(F.coalesce(content_type, F.lit("")), r"(?i)charset=\s*[\"']?([^;\"'\s]+)", 1)
    return F.nullif(F.lower(raw), F.lit(""))


def bom_encoding(body: Column) -> Column:
    head, out = F.hex(F.substring(body, 1, 4)), None
    for mark, name in BOMS:
        test = head.startswith(mark)
        out = F.when(test, name) if out is None else out.when(test, name)
    return out


def document_charset(body: Column) -> Column:
    """The first charset that the document's first 8192 bytes declare."""
    head = F.decode(F.substring(body, 1, SCAN), "ISO-8859-1")
    html = F.regexp_extract(head, r"(?i)charset\s*=\s*[\"']?([^\s\"'/>;]+)", 1)
    xml = F.regexp_extract(head, r"(?i)<\?xml[^>]*encoding\s*=\s*[\"']([^\"']+)", 1)
    return F.lower(F.coalesce(F.nullif(html, F.lit("")), F.nullif(xml, F.lit(""))))


def encoding(body: Column, content_type: Column) -> Column:
    """Byte order mark before header before document before utf-8."""
    return F.coalesce(bom_encoding(body), header_charset(content_type), document_charset(body), F.lit("utf-8"))


def has_binary_signature(body: Column) -> Column:
    head, out = F.hex(F.substring(body, 1, 4)), F.lit(False)
    for s in SIGNATURES:
        out = out | head.startswith(s)
    return out


def is_binary(body: Column, declared: Column) -> Column:
    """A known signature; else, unless declared UTF-16 or -32, a zero byte in the first 8192 bytes that aren't valid UTF-8."""
    head = F.substring(body, 1, SCAN)
    zero = F.hex(head).rlike(r"^(?:..)*?00")
    wide = F.lower(F.coalesce(declared, F.lit(""))).rlike(r"^utf-?(?:16|32)")
    return F.coalesce(has_binary_signature(body) | (~wide & zero & F.try_validate_utf8(head.cast("string")).isNull()), F.lit(False))


def looks_binary(text: Column) -> Column:
    """Decoded text with a zero character, or over a tenth replacement characters in its first 2000."""
    head = F.substring(text, 1, 2000)
    lost = F.length(head) - F.length(F.replace(head, F.lit("�"), F.lit("")))
    return F.coalesce((F.instr(text, "\x00") > 0) | (lost > 0.1 * F.length(head)), F.lit(False))


def media_type(content_type: Column) -> Column:
    return F.nullif(F.lower(F.btrim(F.split(content_type, ";")[0])), F.lit(""))


def is_text_type(content_type: Column) -> Column:
    """Whether a response of this type is worked on; an absent type is."""
    m = media_type(content_type)
    known = m.startswith("text/") | m.isin(*TEXT_TYPES)
    for s in TEXT_SUFFIXES:
        known = known | m.endswith(s)
    return F.coalesce(known, F.lit(True))


def without_dangling_tag(text: Column) -> Column:
    """A cut text without a half entity in its last ten characters and without a half tag."""
    return F.regexp_replace(F.regexp_replace(text, r"&[#A-Za-z0-9]{0,9}\z", ""), r"<[A-Za-z/!][^<>]*\z", "")


#: Names of UTF-8, and of UTF-16 with the pattern of its bytes (as characters) where all are there and none is a half of a pair.
UTF8_NAMES = ("utf-8", "utf8")
UTF16 = (("utf-16le", "UTF-16LE", r"(?s)\A(?:.[^\xD8-\xDF])*+\z"), ("utf-16be", "UTF-16BE", r"(?s)\A(?:[^\xD8-\xDF].)*+\z"))


def plainly_decoded(body: Column, name: Column) -> Column:
    """Text of bytes that are valid UTF-8, or UTF-16 within the basic plane, as ``decoded`` gives it, without Python; null for all others."""
    text = F.when(F.coalesce(name, F.lit("utf-8")).isin(*UTF8_NAMES) & F.is_valid_utf8(body.cast("string")), body.cast("string"))
    for label, codec, fine in UTF16:
        text = text.when((name == label) & F.decode(body, "ISO-8859-1").rlike(fine), F.decode(body, codec))
    return once(text, lambda t: F.when(t.startswith("\ufeff"), F.substr(t, F.lit(2))).otherwise(t))


@F.arrow_udf(T.StringType())
def decoded(body: pa.Array, name: pa.Array) -> pa.Array:
    """Text of the bytes in the named encoding, with replacement characters; unknown names mean utf-8. One text at a time is held beside the batch."""
    # Web labels that mean another codec.
    same = {"latin1": "cp1252", "iso-8859-1": "cp1252", "ascii": "cp1252", "us-ascii": "cp1252"}

    def one(b, n):
        if b is None:
            return None
        try:
            codec = codecs.lookup(same.get(n, n) if n else "utf-8").name
        except LookupError:
            codec = "utf-8"
        return b.decode(codec, "replace").removeprefix("\ufeff")

    return pa.array((one(b.as_py(), n.as_py()) for b, n in zip(body, name)), pa.string(), size=len(body))


def cut_to_bytes(text: Column, limit: Column) -> Column:
    """The longest prefix of at most ``limit`` UTF-8 bytes that ends between characters."""

    def cut(p: Column) -> Column:
        b, n = p["b"], p["n"]
        fits = lambda k: ~F.hex(F.substring(b, k + 1, 1)).between("80", "BF")  # noqa: E731  # no byte inside a character comes next
        k = F.when(F.octet_length(b) <= n, F.octet_length(b)).when(fits(n), n).when(fits(n - 1), n - 1).when(fits(n - 2), n - 2).otherwise(n - 3)
        return F.substring(b, F.lit(1), k).cast("string")

    # the first ``limit`` characters have that many bytes at least
    head = F.left(text, limit).cast("binary")
    return F.when(text.isNotNull(), once(F.struct(head.alias("b"), limit.cast("int").alias("n")), cut))


def utf16_length(text: Column) -> Column:
    """Length in UTF-16 units: characters beyond the basic plane count twice."""
    return F.length(text) + F.regexp_count(text, F.lit("[\\x{10000}-\\x{10FFFF}]"))
