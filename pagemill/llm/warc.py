"""WARC archives of pages, with records of equal payloads resolved to revisits.

Headers (digest, size, key, address) are shuffled by digest, never with a payload: of equal payloads of ``LEAST_BYTES`` or more the record
with the smallest key is the response, and the others are revisits, written from headers alone with a reference to it. Payloads
cross the network only where some of them are copies and the list of these is too long to send to all tasks.

Archives are written by Spark's text writer: a record is its headers, its block and two line ends, which serve as the line
separator, in gzip files. They appear when the job commits, so a lost executor leaves no half file. Reading streams each file record by
record, by Content-Length alone, so that a payload may hold anything, and holds one record at a time.

Skew: a digest or a response that holds over a thousandth of all headers is joined by broadcast (there can't be over a thousand), others by a shuffle.

Defined results: a null payload is an empty one; keys may repeat: of rows equal in key, address and payload one is the response; a null key comes after
all others; an address is written with its control characters percent-encoded, a null one is left out; an empty table gives no records; other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from pagemill.llm.common import shared_folder, written

LEAST_BYTES = 100
#: A join key with more than this share of the rows is sent to all tasks instead.
HOT_SHARE = 0.001
END = "\r\n"
RECORD_END = "\r\n\r\n"
DATE = "2024-01-31T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

RECORD_SCHEMA = "record_id string, type string, page_id long, uri string, declared string, refers string, payload_bytes long, payload_digest string"


#: What records are ordered by: key, nulls last, then address.
_FIRST = "struct(page_id IS NULL AS none, page_id AS page_id, coalesce(url, '') AS url)"


def joined(rows: DataFrame, few: DataFrame, key: str, counts: DataFrame, how: str) -> DataFrame:
    """``rows`` joined to ``few``, whose ``key`` is unique. ``counts(key, n)`` says how many rows hold a key: those over ``HOT_SHARE`` of all, at most
    ``1 / HOT_SHARE``, are joined in place, the others by a shuffle. ``how`` is inner or left."""
    total = counts.agg(F.sum("n")).first()[0] or 0
    hot = written(counts.where(F.col("n") > max(1, total * HOT_SHARE)).select(key), "hot-keys")
    near = rows.join(F.broadcast(few.join(F.broadcast(hot), key, "left_semi")), key)
    return near.unionByName(rows.join(F.broadcast(hot), key, "left_anti").join(few, key, how))


def resolved_headers(pages: DataFrame, payload: Column) -> tuple[DataFrame, DataFrame]:
    """What is equal among the headers: (digest, page_id, url, n, bytes) rows and (digest, first) for digests met more than once."""
    text = F.coalesce(payload, F.lit(""))
    heads = pages.select("page_id", "url", F.sha2(text, 256).alias("digest"), F.octet_length(text).cast("long").alias("bytes")).where(F.col("bytes") >= LEAST_BYTES)
    equal = written(heads.groupBy("digest", "page_id", "url", "bytes").agg(F.count(F.lit(1)).alias("n")), "warc-headers")
    copied = written(equal.groupBy("digest").agg(F.min(F.expr(_FIRST)).alias("first"), F.sum("n").alias("copies")).where("copies > 1"), "warc-copied")
    return equal, copied


def record_id(*parts: Column) -> Column:
    """A name-based record identifier."""
    h = F.sha2(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("-")) for p in parts]), 256)
    cut = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4))] + [F.concat(F.lit("8"), F.substring(h, 14, 3)), F.concat(F.lit("a"), F.substring(h, 18, 3)), F.substring(h, 21, 12)]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *cut), F.lit(">"))


def _safe(value: Column) -> Column:
    """A header's value on one line."""
    for char in "\r\n\t\0":
        value = F.replace(value, F.lit(char), F.lit(f"%{ord(char):02X}"))
    return value


def _record(kind: str, head: list[tuple[str, Column]], payload: Column | None) -> Column:
    """A record as text, without the two line ends that follow it."""
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{END}Content-Type: text/html; charset=utf-8{RECORD_END}"))
    block = http if payload is None else F.concat(http, payload)
    fields = [("WARC-Type", F.lit(kind)), *head, ("Content-Type", F.lit("application/http; msgtype=response")), ("Content-Length", F.octet_length(block).cast("string"))]
    lines = [F.when(v.isNotNull(), F.concat(F.lit(f"{END}{n}: "), v)).otherwise("") for n, v in fields]
    return F.concat(F.lit("WARC/1.1"), *lines, F.lit(RECORD_END), block)


def records(pages: DataFrame, payload: Column, date: str = DATE) -> DataFrame:
    """One record for each row of ``pages(page_id, url, ...)`` as text: responses with their payload, revisits of equal ones with headers alone."""
    equal, copied = resolved_headers(pages, payload)
    head = lambda rid, page_id, url, digest: [("WARC-Record-ID", rid), ("WARC-Date", F.lit(date)), ("WARC-Target-URI", _safe(url)), ("WARC-Page-ID", page_id.cast("string")), ("WARC-Payload-Digest", F.concat(F.lit("sha256:"), digest))]

    text = F.coalesce(payload, F.lit(""))
    rows = pages.select("page_id", "url", text.alias("payload"), F.sha2(text, 256).alias("digest"), F.monotonically_increasing_id().cast("string").alias("nr"))
    # short payloads stay responses of their own: their key is equal to no other
    rows = rows.withColumn("key", F.when(F.octet_length("payload") >= LEAST_BYTES, F.col("digest")).otherwise(F.concat(F.lit("short "), F.col("nr"))))
    total = copied.agg(F.sum("copies")).first()[0] or 0
    often = copied.where(F.col("copies") > max(1, total * HOT_SHARE)).select(F.col("digest").alias("key"), F.col("first").alias("hot"))
    here = rows.join(F.broadcast(often), "key", "left").where(f"hot IS NULL OR hot <=> {_FIRST}").drop("hot")
    kept = here.join(copied.select(F.col("digest").alias("key"), "first"), "key", "left").where(f"first IS NULL OR first <=> {_FIRST}")
    # of several rows equal in all that tells them apart one is the response
    ties = equal.join(copied.select("digest", "first"), "digest").where(f"n > 1 AND first <=> {_FIRST}")
    if not ties.isEmpty():
        kept = kept.dropDuplicates(["key", "page_id", "url"])
    full = kept.select(_record("response", head(record_id(F.lit("r"), F.col("key")), F.col("page_id"), F.col("url"), F.col("digest")), F.col("payload")).alias("value"))

    again = joined(equal, copied.select("digest", "first"), "digest", equal.groupBy("digest").agg(F.count(F.lit(1)).alias("n")), "inner")
    copies = again.withColumn("left", F.expr(f"n - CAST(first <=> {_FIRST} AS BIGINT)")).where("left > 0").select("*", F.explode(F.sequence(F.lit(1), F.col("left"))).alias("nr"))
    first_url = F.when(F.col("first.url") != "", F.col("first.url"))
    extra = [("WARC-Refers-To", record_id(F.lit("r"), F.col("digest"))), ("WARC-Refers-To-Target-URI", _safe(first_url)), ("WARC-Refers-To-Date", F.lit(date)), ("WARC-Profile", F.lit(PROFILE))]
    revisits = copies.select(_record("revisit", head(record_id(F.lit("v"), F.col("digest"), F.col("page_id"), F.col("url"), F.col("nr")), F.col("page_id"), F.col("url"), F.col("digest")) + extra, None).alias("value"))
    return full.unionByName(revisits)


def write_archives(pages: DataFrame, payload: Column, folder: str, date: str = DATE) -> None:
    """Write the records of ``pages`` as gzip archives under ``folder``."""
    records(pages, payload, date).write.option("lineSep", RECORD_END).option("compression", "gzip").text(folder)


_LENGTH = re.compile(rb"(?i)\r\nContent-Length: *(\d+)")


def _parsed(head: bytes, block: memoryview) -> tuple:
    fields = {}
    for line in head.split(b"\r\n")[1:]:
        name, _, value = line.partition(b":")
        fields[name.strip().lower().decode()] = value.strip().decode("utf-8", "replace")
    kind, page = fields.get("warc-type"), fields.get("warc-page-id")
    size = found = None
    if kind == "response":
        raw = bytes(block)
        payload = raw[raw.find(b"\r\n\r\n") + 4 :]
        size, found = len(payload), hashlib.sha256(payload).hexdigest()
    declared = (fields.get("warc-payload-digest") or "").partition(":")[2] or None
    return fields.get("warc-record-id"), kind, None if page is None else int(page), fields.get("warc-target-uri"), declared, fields.get("warc-refers-to"), size, found


class _Stream:
    """Pieces of a file, the separator between them put back, as records."""

    def __init__(self):
        self.data, self.need = bytearray(), 0

    def fed(self, piece: bytes) -> Iterator[tuple]:
        self.data += piece
        self.data += b"\r\n\r\n"
        while len(self.data) >= self.need:
            start = len(self.data) - len(self.data.lstrip(b"\r\n"))
            if start:
                del self.data[:start]
            end = self.data.find(b"\r\n\r\n")
            if end < 0 or not self.data.startswith(b"WARC/"):
                if self.data and not b"WARC/".startswith(bytes(self.data[:5])):
                    raise ValueError("an archive doesn't continue with a record")
                self.need = 0
                return
            head = bytes(self.data[:end])
            size = int(_LENGTH.search(head).group(1))
            self.need = end + 4 + size
            if len(self.data) < self.need:
                return
            with memoryview(self.data) as view:
                found = _parsed(head, view[end + 4 : end + 4 + size])
            del self.data[: end + 4 + size]
            self.need = 0
            yield found


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [x.split()[0] for x in RECORD_SCHEMA.split(", ")]
    types = [pa.int64() if x.endswith("long") else pa.string() for x in RECORD_SCHEMA.split(", ")]
    stream = _Stream()
    for batch in batches:
        found = [r for piece in batch.column(0) for r in stream.fed(piece.as_py())]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in found], t) for i, t in enumerate(types)], names)
    if stream.data.strip(b"\r\n"):
        raise ValueError("an archive ends within a record")


def read_archives(spark: SparkSession, folder: str) -> DataFrame:
    """The records of all archives under ``folder``: identifiers, kind, target, declared digest, reference, and size and digest of the payload as read (null for a revisit)."""
    pieces = spark.read.option("lineSep", RECORD_END).text(folder).select(F.col("value").cast("binary").alias("piece"))
    return pieces.mapInArrow(_read, RECORD_SCHEMA)


def resolved(found: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of records that were read: a revisit has the size and digest of the response that it refers to."""
    responses, revisits = found.where("type = 'response'"), found.where("type = 'revisit'").select("page_id", F.col("refers").alias("record_id"))
    targets = revisits.groupBy("record_id").agg(F.count(F.lit(1)).alias("n"))
    full = responses.select("record_id", "payload_bytes", "payload_digest", F.col("page_id").alias("refers_to"))
    back = joined(revisits, full, "record_id", targets, "left").select("page_id", "payload_bytes", "payload_digest", F.lit("revisit").alias("record_type"), "refers_to")
    own = responses.select("page_id", "payload_bytes", "payload_digest", F.col("type").alias("record_type"), F.lit(None).cast("long").alias("refers_to"))
    return own.unionByName(back)


def revisit_report(pages: DataFrame) -> DataFrame:
    """The records of ``pages(page_id, url, html)``, written as archives in the shared folder and read back."""
    spark = pages.sparkSession
    folder = f"{shared_folder(spark)}/pagemill/warc-{uuid.uuid4().hex}"
    write_archives(pages, F.col("html"), folder)
    return resolved(written(read_archives(spark, folder), "warc-records"))
