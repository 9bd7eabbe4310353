"""Packing token sequences by Karmarkar-Karp multiway differencing.

A document's ids are cut by rule: whole windows of 2048 ids, then the remainder into its binary parts of 1024, 512 and 256 ids and
a rest below 256, so that hot groups of equal lengths still fill windows. Whole windows are sequences at once. All other pieces
are dealt by hash into groups of about ``GROUP_WINDOWS`` windows, and each group is divided by multiway differencing: the two
partial partitions with the largest imbalance are merged, largest part against smallest, until one is
left; its windows are nearly equal. If a window exceeds the capacity, the window count rises and the division is repeated.

Defined results: a null or empty text has the end id only; repeated rows are packed each; an empty table gives an empty
result; a null doc_id stays null; a very long text only has more whole windows; columns other than doc_id and text are not read.
"""

from __future__ import annotations

import heapq
import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from pagemill.llm.common import sliced, written

CAPACITY = 2048
END_ID = 1
#: Windows in a group that is divided at once.
GROUP_WINDOWS = 128
#: Parts of a remainder; what is left below the last stays one piece.
PARTS = (1024, 512, 256)
#: Words whose ids a worker remembers.
REMEMBERED = 120_000

_ODD_SPACE = re.compile("[\x09-\x0d\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000] ")
_encoders: dict[str, "Encoder"] = {}


class Encoder:
    """Ids of the byte-level BPE file at ``path`` as little-endian 32-bit bytes, as the tokenizers library gives them.

    A text falls into independent parts before each space that follows anything but white space; parts are
    remembered, and new ones are encoded by the same vocabulary's ranks. Texts with other runs of spaces or with a special
    token's string are encoded whole.
    """

    def __init__(self, path: str):
        import tiktoken

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        byte_of = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in plain)}
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        ranks = {bytes(byte_of[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in special}
        pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
        self.coder = tiktoken.Encoding("bytes", pat_str=pattern, mergeable_ranks=ranks, special_tokens=special)
        self.special, self.known = list(special), {}

    def whole(self, text: str) -> bytes:
        return np.array(self.coder.encode(text, allowed_special="all"), "<u4").tobytes()

    def ids(self, text: str) -> bytes:
        parts = text.split(" ")
        if "" in parts or any(s in text for s in self.special) or _ODD_SPACE.search(text):
            return self.whole(text) if text else b""
        known, out = self.known, [np.array(self.coder.encode_ordinary(parts[0]), "<u4").tobytes()]
        for p in parts[1:]:
            found = known.get(p)
            if found is None:
                found = np.array(self.coder.encode_ordinary(" " + p), "<u4").tobytes()
                if len(known) < REMEMBERED and len(p) < 64:
                    known[p] = found
            out.append(found)
        return b"".join(out)


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def cuts(n: int, capacity: int = CAPACITY, parts=PARTS) -> list[int]:
    """Lengths of a document's pieces, in order."""
    out, rest = [capacity] * (n // capacity), n % capacity
    for p in parts:
        out += [p] * (rest // p)
        rest %= p
    return out + [rest] * (rest > 0)


def pieces(docs: DataFrame, path: str | None = None, with_ids: bool = False) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens[, ids]): the pieces of each document."""
    path = path or default_path()

    def compute(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode, end = encoder(path).ids, np.array([END_ID], "<u4").tobytes()
        for f in sliced(frames):
            rows = []
            for doc_id, text in zip(f["doc_id"].astype("Int64").tolist() if f["doc_id"].isna().any() else f["doc_id"].tolist(), f["text"]):
                ids = encode(text or "") + end
                n, at = len(ids) // 4, 0
                for length in cuts(n):
                    part = ids[4 * at : 4 * (at + length)]
                    rows.append((doc_id, at, length, zlib.crc32(part), n, *([np.frombuffer(part, "<u4").astype(np.int32)] if with_ids else [])))
                    at += length
            out = pd.DataFrame(rows, columns=["doc_id", "start", "length", "ids_crc32", "doc_tokens", *["ids"] * with_ids])
            out["doc_id"] = out["doc_id"].astype("Int64")
            yield out

    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long" + (", ids array<int>" if with_ids else "")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(compute, schema)


def differencing(sizes: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(part of each item, sums of the k parts) by Karmarkar-Karp multiway differencing."""
    n = len(sizes)
    sums: list = []
    for s in sizes.tolist():
        a = np.zeros(k, np.int64)
        a[0] = s
        sums.append(a)
    merged: list[tuple[int, int, np.ndarray]] = []
    heap = [(-s, i) for i, s in enumerate(sizes.tolist())] if k > 1 else [(0, i) for i in range(n)]
    heapq.heapify(heap)
    while len(heap) > 1:
        _, i = heapq.heappop(heap)
        _, j = heapq.heappop(heap)
        both = sums[i] + sums[j][::-1]
        order = np.argsort(-both, kind="stable")
        both = both[order]
        sums[i] = sums[j] = None
        merged.append((i, j, order))
        sums.append(both)
        heapq.heappush(heap, (int(both[-1] - both[0]), len(sums) - 1))
    slots: list = [None] * len(sums)
    slots[-1] = np.arange(k)
    for at in range(len(merged) - 1, -1, -1):
        i, j, order = merged[at]
        own = np.empty(k, np.int64)
        own[order] = slots[n + at]
        slots[i], slots[j], slots[n + at] = own, own[::-1], None
    return np.array([s[0] for s in slots[:n]], np.int64), sums[-1]


def windows(sizes: np.ndarray, capacity: int = CAPACITY) -> np.ndarray:
    """The window of each piece: as few near-equal windows as hold, from the least possible count up."""
    k = max(1, -(-int(sizes.sum()) // capacity))
    while True:
        part, sums = differencing(sizes, k)
        if sums.max() <= capacity:
            return part
        k += 1


def pack(found: DataFrame) -> DataFrame:
    """``found`` pieces with sequence_id and offset."""
    found = written(found, "pieces")
    n, loose = found.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.when(F.col("length") < CAPACITY, F.col("length"))), F.lit(0))).first()
    groups = max(1, round(loose / (GROUP_WINDOWS * CAPACITY)), n // (64 * GROUP_WINDOWS))
    names = found.columns

    def place(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values(["length", "doc_id", "start"], ascending=[False, True, True], ignore_index=True)
        full = int((f["length"] == CAPACITY).sum())
        seq = np.empty(len(f), np.int64)
        seq[:full] = np.arange(full)
        if full < len(f):
            seq[full:] = full + windows(f["length"].to_numpy(np.int64)[full:])
        f["sequence_id"] = (int(f["_group"].iloc[0]) << 24) + seq
        f = f.sort_values(["sequence_id", "doc_id", "start"], ignore_index=True)
        f["offset"] = f.groupby("sequence_id")["length"].cumsum() - f["length"]
        return f.drop(columns="_group")

    schema = ", ".join(f"`{x.name}` {x.dataType.simpleString()}" for x in found.schema) + ", sequence_id long, offset long"
    dealt = found.withColumn("_group", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32", F.monotonically_increasing_id()), F.lit(groups)))
    return dealt.groupBy("_group").applyInPandas(place, schema).select(*names, "sequence_id", "offset")


def packed(docs: DataFrame, path: str | None = None, with_ids: bool = False) -> DataFrame:
    """Every piece of every document with its place in a sequence of at most 2048 ids."""
    return pack(pieces(docs, path, with_ids))
