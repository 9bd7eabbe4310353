"""Exact removal of repeated 100-byte strings by a depth-limited most-significant-digit radix sort of suffixes.

Only suffixes that can tie at full depth are ever moved, and every group of equal windows comes out of the sort on their bytes. The first
digit of a 100-byte window is the hash of its minimizer, the least-hashed 24-byte string in it: equal windows have equal
minimizers at equal offsets, so windows that differ in this digit never meet. Neighbouring windows with the same minimizer place travel
as one run. Hashes decide what travels where, never what is equal.

1. Over each text (one pass, no shuffle) runs are found. Runs of one batch with the same minimizer are sorted by their bytes; a run equal to an
   earlier one is settled.
2. Runs are dealt by minimizer hash, without bytes. A run that is alone under its minimizer is unique and drops out.
3. The other runs get their bytes from the texts and are dealt by minimizer again. Their windows are ordered digit by digit, 8 bytes a
   pass, down to depth 100; windows that stand alone drop out after each pass, and the groups left at full depth are the repeated windows.
4. The removed ranges of a document are merged and cut out of its text. Texts are shuffled once, by document, for steps 3 and 4.

A minimizer that holds more than a quarter of a partition's share of all runs (``hot_minimizers``, from a sample) skips step 2, and its runs
are dealt by (minimizer, salt) first; the windows left of each salt meet in a second sort, dealt by their whole content.

Of equal windows the first (least doc_id, then least start) stays and all others go, judged on the input.

Defined results: a null text is empty; a text under 100 bytes loses nothing; rows that share a doc_id and a text count as one document at the
same place, so a repeated row does not remove itself; rows that share a doc_id only are documents of their own, ordered by a hash of the
text; rows without doc_id come first; an empty table gives an empty result; very long texts are worked in overlapping segments; other
columns are not read, or pass through ``without_repeats`` whatever their names.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from pagemill.llm.common import sliced, written

DEPTH = 100
KMER = 24
#: Bytes worked at once in a task.
SEGMENT = 1 << 20
#: Rows with bytes sorted at once, if no group is larger.
SORTED_ROWS = 1 << 15
#: Runs of a hot minimizer that are dealt and sorted together.
SALT_RUNS = 1 << 13
#: Text that is sampled to find hot minimizers: this much, and more where there are many partitions (about 128 runs for each).
SAMPLE_BYTES = 8 << 20
#: Repeated doc_ids up to which they are broadcast.
BROADCAST_IDS = 1_000_000

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_MIX = np.uint64(0xFF51AFD7ED558CCD)
_MIX2 = np.uint64(0xC4CEB9FE1A85EC53)
_powers: dict[tuple[int, int], np.ndarray] = {}


def _power(base: np.uint64, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1) modulo 2 ** 64."""
    key = (int(base), 0)
    if key not in _powers or len(_powers[key]) < n:
        steps = np.full(max(n, 1 << 16), base, np.uint64)
        steps[0] = 1
        _powers[key] = np.cumprod(steps)
    return _powers[key][:n]


def _inverse(base: np.uint64) -> np.uint64:
    return np.uint64(pow(int(base), -1, 1 << 64))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * _MIX
    x = (x ^ (x >> np.uint64(29))) * _MIX2
    return x ^ (x >> np.uint64(32))


def _prefix(buf: np.ndarray, base: np.uint64) -> np.ndarray:
    out = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * _power(base, len(buf)), out=out[1:])
    return out


def runs(buf: np.ndarray, starts: np.ndarray, lengths: np.ndarray, depth: int = DEPTH, kmer: int = KMER) -> dict[str, np.ndarray]:
    """Runs of windows inside the pieces of ``buf``: first window, count, offset of the minimizer, its hash."""
    use = lengths >= depth
    starts, lengths = starts[use], lengths[use]
    empty = np.zeros(0, np.int64)
    if not len(starts):
        return {"at": empty, "n": empty, "o": empty, "h": empty.view(np.uint64)}
    n = len(buf)
    p = _prefix(buf, _BASE)
    h = _mixed((p[kmer:] - p[:-kmer]) * _power(_inverse(_BASE), n - kmer + 1))
    least = (h & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(h), dtype=np.uint64)
    width, want = 1, depth - kmer + 1
    while 2 * width <= want:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if want > width:
        least = np.minimum(least[: len(least) - (want - width)], least[want - width :])
    counts = lengths - depth + 1
    first = np.cumsum(counts) - counts
    window = np.arange(int(counts.sum())) + np.repeat(starts - first, counts)
    place = (least[window] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    begins = np.concatenate(([True], place[1:] != place[:-1]))
    begins[first] = True
    head = np.nonzero(begins)[0]
    at, many, place = window[head], np.diff(np.append(head, len(window))), place[head]
    return {"at": at, "n": many, "o": place - at, "h": h[place]}


def refined(live: np.ndarray, group: np.ndarray, digit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One pass of the sort: groups split by a digit; what is alone in its group drops out."""
    if not len(live):
        return live, group
    order = np.lexsort((digit, group))
    live, group, digit = live[order], group[order], digit[order]
    new = np.concatenate(([True], (group[1:] != group[:-1]) | (digit[1:] != digit[:-1])))
    number = np.cumsum(new) - 1
    keep = np.bincount(number)[number] > 1
    return live[keep], number[keep]


def _digits(buf: np.ndarray, at: np.ndarray) -> np.ndarray:
    return np.lib.stride_tricks.sliding_window_view(buf, 8)[at].reshape(-1).view(">u8").astype(np.uint64)


def radix_groups(buf: np.ndarray, at: np.ndarray, first: np.ndarray, length: np.ndarray | int = DEPTH) -> tuple[np.ndarray, np.ndarray]:
    """(numbers, group numbers) of the strings buf[at : at + length] that are equal to another one: ``first`` is the first digit, then 8 bytes a pass.

    Strings with equal first digits must have equal lengths, 8 at least.
    """
    length = np.broadcast_to(length, at.shape)
    live, group = refined(np.arange(len(at)), np.zeros(len(at), np.int64), first) if len(at) else (np.zeros(0, np.int64),) * 2
    done, step = [], 0
    while len(live):
        ended = step >= length[live]
        if ended.any():
            done.append((live[ended], group[ended] + (len(done) << 40)))
            live, group = live[~ended], group[~ended]
        if len(live):
            live, group = refined(live, group, _digits(buf, at[live] + np.minimum(step, length[live] - 8)))
            step += 8
    if not done:
        return live, group
    return np.concatenate([x for x, _ in done]), np.concatenate([g for _, g in done])


def later_places(group: np.ndarray, *place: np.ndarray) -> np.ndarray:
    """2 for each row whose place is later than the first of its group, 1 for one at the very place of an earlier row, else 0."""
    order = np.lexsort((*place[::-1], group))
    new = np.concatenate(([True], group[order][1:] != group[order][:-1]))
    head = np.nonzero(new)[0][np.cumsum(new) - 1]
    same = np.ones(len(order), bool)
    for x in place:
        same &= x[order] == x[order][head]
    out = np.empty(len(order), np.int8)
    out[order] = np.where(same, ~new, 2)
    return out


def joined_ranges(doc: np.ndarray, tie: np.ndarray, start: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, ...]:
    """Ranges of window starts, ordered, with touching ones joined."""
    if not len(doc):
        return doc, tie, start, n
    order = np.lexsort((start, tie, doc))
    doc, tie, start, end = doc[order], tie[order], start[order], (start + n)[order]
    cut = np.concatenate(([True], (doc[1:] != doc[:-1]) | (tie[1:] != tie[:-1]) | (start[1:] > end[:-1])))
    at = np.nonzero(cut)[0]
    last = np.append(at[1:], len(doc)) - 1
    return doc[at], tie[at], start[at], end[last] - start[at]


_RUN = "d long, t long, s int, h long, no int, kind int"
#: Kinds of run rows: to be settled by minimizer; a removed range; of a hot minimizer.
OPEN, REMOVED, HOT = 0, 1, 2


def batches(frames: Iterator[pd.DataFrame]) -> Iterator[list[tuple[int, int, int, bytes]]]:
    """(d, t, start, bytes) of overlapping segments of the texts, about ``SEGMENT`` bytes at a time."""
    parts, size = [], 0
    for f in frames:
        for d, t, text in zip(f["d"].tolist(), f["t"].tolist(), f["text"]):
            data = (text or "").encode("utf-8", "replace")
            for at in range(0, len(data) - DEPTH + 1, SEGMENT):
                part = data[at : at + SEGMENT + DEPTH - 1]
                parts.append((d, t, at, part))
                size += len(part)
                if size >= SEGMENT:
                    yield parts
                    parts, size = [], 0
    if parts:
        yield parts


def found_runs(parts: list[tuple[int, int, int, bytes]]) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """(buffer, runs with their d, t and start) of one batch."""
    parts.sort(key=lambda x: x[:3])
    buf = np.frombuffer(b"".join(x[3] for x in parts), np.uint8)
    lengths = np.array([len(x[3]) for x in parts], np.int64)
    starts = np.cumsum(lengths) - lengths
    r = runs(buf, starts, lengths)
    piece = np.searchsorted(starts, r["at"], "right") - 1
    d, t, s = (np.array([x[i] for x in parts], np.int64)[piece] for i in range(3))
    return buf, r | {"d": d, "t": t, "s": s + r["at"] - starts[piece]}


def _find(hot: np.ndarray):
    """Runs of each text. Of the equal runs of a batch the first goes on; the others are a removed range, whose ``no`` is its number of windows."""

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for parts in batches(frames):
            buf, r = found_runs(parts)
            late = equal_runs(buf, r["at"], r["n"], r["o"], r["h"], (r["d"], r["t"], r["s"]))
            go, gone = late == 0, late == 2
            d, t, s, n = joined_ranges(r["d"][gone], r["t"][gone], r["s"][gone], r["n"][gone])
            # settled ranges have nothing to meet: any partition will do
            anywhere = _mixed(d.view(np.uint64) * _BASE + s.view(np.uint64)).view(np.int64)
            h = r["h"].view(np.int64)[go]
            kind = np.where(np.isin(h, hot), HOT, OPEN)
            yield pd.DataFrame(
                {
                    "d": np.concatenate((r["d"][go], d)), "t": np.concatenate((r["t"][go], t)), "s": np.concatenate((r["s"][go], s)).astype(np.int32), "h": np.concatenate((h, anywhere)),
                    "no": np.concatenate(((r["n"][go] << 8) | r["o"][go], n)).astype(np.int32), "kind": np.concatenate((kind, np.full(len(d), REMOVED))).astype(np.int32),
                }
            )

    return work


def hot_minimizers(docs: DataFrame) -> dict[int, int]:
    """Hashes of the minimizers with more than a quarter of a partition's share of the runs, in a sample of the texts: at most four for each partition. The value is
    over how many salts their runs are dealt, one for every ``SALT_RUNS`` that the sample lets expect.

    Any set gives right results, as all tasks use the same.
    """
    partitions = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    share = min(1.0, max(SAMPLE_BYTES, 128 * partitions * 39) / max(1, total))

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for parts in batches(frames):
            h, n = np.unique(found_runs(parts)[1]["h"], return_counts=True)
            yield pd.DataFrame({"h": h.view(np.int64), "n": n})

    chosen = docs.where(F.shiftrightunsigned(F.xxhash64("d", "t", F.lit(9)), 11) < F.lit(int(share * (1 << 53))))
    counts = chosen.mapInPandas(count, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))
    least = max(8, share * total / 39 / (4 * partitions))
    return {r["h"]: max(2, math.ceil(r["n"] / share / SALT_RUNS)) for r in counts.where(F.col("n") > least).orderBy(F.desc("n"), "h").limit(4 * partitions).collect()}


_BYTES = "key long, salt int, d long, t long, s int, n int, o int, data binary"


def _bytes_of(hot: dict[int, int]):
    """Each run with its bytes; those of a hot minimizer with a salt."""

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in sliced(frames):
            rows = []
            for d, t, text, found in zip(f["d"].tolist(), f["t"].tolist(), f["text"], f["runs"]):
                data = (text or "").encode("utf-8", "replace")
                for r in found:
                    s, n, o = r["s"], r["no"] >> 8, r["no"] & 255
                    salt = 1 + ((d * 2654435761 ^ s * 2246822519 ^ t) >> 13) % hot.get(r["h"], 1) if r["kind"] == HOT else 0
                    rows.append((r["h"], salt, d, t, s, n, o, data[s : s + n + DEPTH - 1]))
            yield pd.DataFrame(rows, columns=["key", "salt", "d", "t", "s", "n", "o", "data"]).astype({"key": "int64", "salt": "int32", "d": "int64", "t": "int64", "s": "int32", "n": "int32", "o": "int32"})

    return work


def equal_runs(buf: np.ndarray, at: np.ndarray, n: np.ndarray, o: np.ndarray, first: np.ndarray, place: tuple[np.ndarray, ...]) -> np.ndarray:
    """``later_places`` among runs that are equal in the digit ``first``, in count, offset and bytes; 0 for runs without an equal one."""
    live, group = refined(np.arange(len(at)), np.zeros(len(at), np.int64), first)
    live, group = refined(live, group, (n[live] << 8) | o[live])
    k, group = radix_groups(buf, at[live], group, n[live] + DEPTH - 1)
    late = np.zeros(len(at), np.int8)
    if len(k):
        late[live[k]] = later_places(group, *(x[live[k]] for x in place))
    return late


def _sorted_windows(f: pd.DataFrame) -> Iterator[pd.DataFrame]:
    """The sort of whole groups of (key, salt): removed ranges (without bytes), and of salted runs each window that is left, under its content's key.

    Whole runs are sorted first; of equal ones only the first is then sorted window by window, if others are left beside it.
    """
    n, o, salt, key = (f[x].to_numpy(np.int64) for x in ("n", "o", "salt", "key"))
    data = f["data"].tolist()
    buf = np.frombuffer(b"".join(data) + bytes(8), np.uint8)
    sizes = np.array([len(x) for x in data], np.int64)
    base = np.cumsum(sizes) - sizes
    d, t, s = (f[x].to_numpy(np.int64) for x in ("d", "t", "s"))
    own = np.cumsum(np.concatenate(([False], (key[1:] != key[:-1]) | (salt[1:] != salt[:-1]))))
    whole = equal_runs(buf, base, n, o, own, (d, t, s))
    first = whole == 0
    row = np.nonzero(first & ((np.bincount(own[first], minlength=len(own))[own] > 1) | (salt > 0)))[0]
    many = n[row]
    step = np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many)
    row = np.repeat(row, many)
    live, group = radix_groups(buf, base[row] + step, (own[row] << 8) | (o[row] - step))
    late = np.zeros(len(row), np.int8)
    if len(live):
        late[live] = later_places(group, d[row[live]], t[row[live]], s[row[live]] + step[live])
    gone, parts = whole == 2, late == 2
    out = joined_ranges(*(np.concatenate(x) for x in ((d[gone], d[row[parts]]), (t[gone], t[row[parts]]), (s[gone], s[row[parts]] + step[parts]), (n[gone], np.ones(int(parts.sum()), np.int64)))))
    anywhere = _mixed(out[0].view(np.uint64) * _BASE + out[2].view(np.uint64)).view(np.int64)
    yield pd.DataFrame({"key": anywhere, "salt": np.int32(0), "d": out[0], "t": out[1], "s": out[2].astype(np.int32), "n": out[3].astype(np.int32), "o": np.int32(0), "data": None})
    left = np.nonzero((late == 0) & (salt[row] > 0))[0]
    for k in range(0, len(left), SORTED_ROWS):
        part = left[k : k + SORTED_ROWS]
        i, j = row[part], step[part]
        windows = [data[x][y : y + DEPTH] for x, y in zip(i.tolist(), j.tolist())]
        content = np.array([int.from_bytes(hashlib.blake2b(w, digest_size=8).digest(), "little", signed=True) for w in windows], np.int64)
        yield pd.DataFrame({"key": content, "salt": np.int32(0), "d": d[i], "t": t[i], "s": (s[i] + j).astype(np.int32), "n": np.int32(1), "o": np.int32(0), "data": windows})


def _sort(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """``_sorted_windows`` over rows ordered by key and salt, some whole groups at a time; rows without bytes pass."""
    kept: list[pd.DataFrame] = []
    size = 0
    for f in frames:
        has = f["data"].notna()
        if not has.all():
            yield f[~has]
            f = f[has]
        if not len(f):
            continue
        kept.append(f)
        size += len(f)
        if size >= SORTED_ROWS:
            whole = pd.concat(kept, ignore_index=True)
            last = ((whole["key"] == whole["key"].iloc[-1]) & (whole["salt"] == whole["salt"].iloc[-1])).to_numpy()
            if not last.all():
                yield from _sorted_windows(whole[~last].reset_index(drop=True))
                whole = whole[last]
            kept, size = [whole], len(whole) // 2  # half: a large group isn't joined anew for every frame
    if kept and size:
        yield from _sorted_windows(pd.concat(kept, ignore_index=True))


def _removed(spans, size: int) -> list[tuple[int, int]]:
    """Maximal removed byte ranges from window ranges."""
    out: list[list[int]] = []
    for s, n in sorted((r["s"], r["n"]) for r in spans):
        end = min(s + n + DEPTH - 1, size)
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([s, end])
    return [tuple(x) for x in out]


def _rest(data: bytes, spans) -> tuple[bytes, list[tuple[int, int]]]:
    gone, at, kept = _removed(spans if spans is not None else [], len(data)), 0, []
    for a, b in gone:
        kept.append(data[at:a])
        at = b
    return b"".join([*kept, data[at:]]), gone


def keyed(docs: DataFrame) -> DataFrame:
    """(row, text, d, t): ``row`` holds the columns besides text; documents are ordered by (d, t).

    d is the doc_id, or a number below all of them that follows from the text; t, 0 for most, tells rows apart that share a doc_id.
    """
    text, doc_id = F.col("text"), F.col("doc_id").cast("long")
    h = F.xxhash64(F.coalesce(text, F.lit("")))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"]).alias("row"), text, F.coalesce(doc_id, F.lit(-(1 << 62)) - F.shiftrightunsigned(h, 3)).alias("d"))
    shared = docs.where(doc_id.isNotNull()).groupBy(doc_id.alias("d")).count().where("count > 1").select("d", F.lit(True).alias("shared"))
    shared = written(shared, "shared-ids")
    n = shared.count()
    if not n:
        return rows.withColumn("t", F.lit(0).cast("long"))
    marked = rows.join(F.broadcast(shared) if n <= BROADCAST_IDS else shared, "d", "left")
    return marked.select("row", "text", "d", F.when(F.col("shared"), h).otherwise(F.lit(0)).cast("long").alias("t"))


def meeting_place() -> Column:
    """Where runs look for others of their minimizer; those of a hot one go on without meeting, and are dealt anywhere."""
    return F.when(F.col("kind") == HOT, F.xxhash64("d", "t", "s")).otherwise(F.col("h"))


def removed_windows(docs: DataFrame) -> DataFrame:
    """(d, t, s, n): the starts s .. s + n - 1 of the windows of document (d, t) that also start earlier. ``docs`` is ``keyed``."""
    own = docs.select("d", "t", "text")
    hot = hot_minimizers(own)
    found = own.mapInPandas(_find(np.array(list(hot), np.int64)), _RUN)
    beside = Window.partitionBy(meeting_place()).orderBy("kind")
    met = (F.col("kind") != OPEN) | F.lag("d").over(beside).isNotNull() | F.lead("d").over(beside).isNotNull()
    settled = written(found.withColumn("met", met).where("met").drop("met"), "runs")
    lists = settled.where(F.col("kind") != REMOVED).groupBy("d", "t").agg(F.collect_list(F.struct("s", "h", "no", "kind")).alias("runs"))
    moved = docs.select("row", "text", "d", "t").join(lists, ["d", "t"]).mapInPandas(_bytes_of(hot), _BYTES)
    once = moved.repartition("key", "salt").sortWithinPartitions("key", "salt").mapInPandas(_sort, _BYTES)
    twice = once.repartition("key").sortWithinPartitions("key").mapInPandas(_sort, _BYTES)
    return settled.where(F.col("kind") == REMOVED).select("d", "t", "s", F.col("no").alias("n")).union(twice.select("d", "t", "s", "n"))


def with_spans(docs: DataFrame) -> DataFrame:
    """``keyed`` rows with ``spans``, their removed ranges of windows (null: none). The texts' shuffle by document is the same as in ``removed_windows``."""
    own = keyed(docs)
    lists = removed_windows(own).groupBy("d", "t").agg(F.collect_list(F.struct("s", "n")).alias("spans"))
    return own.select("row", "text", "d", "t").join(lists, ["d", "t"], "left")


def removal_report(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of each row of ``docs(doc_id, text)``."""

    def digest(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for doc_id, text, spans in zip(f["doc_id"].astype("Int64"), f["text"], f["spans"]):
                data = (text or "").encode("utf-8", "replace")
                rest, gone = _rest(data, spans)
                rows.append((doc_id, len(data), len(data) - len(rest), len(gone), hashlib.sha256(rest).hexdigest()))
            out = pd.DataFrame(rows, columns=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])
            yield out.astype({"doc_id": "Int64"})

    joined = with_spans(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    return joined.select("row.doc_id", "text", "spans").mapInPandas(digest, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def without_repeats(docs: DataFrame) -> DataFrame:
    """``docs`` with the repeated bytes cut out of ``text`` (bytes of a cut character become U+FFFD), other columns unchanged."""

    @F.pandas_udf("string")
    def cut(text: pd.Series, spans: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else _rest(t.encode("utf-8", "replace"), s)[0].decode("utf-8", "replace") for t, s in zip(text, spans)])

    new = cut(F.col("text"), F.col("spans"))
    return with_spans(docs).select(*[new.alias("text") if c == "text" else F.col(f"row.`{c}`").alias(c) for c in docs.columns])
