"""Document scores by cross-entropy difference of a target and a background n-gram model.

Both models are interpolated bigram models over one shared vocabulary, all words of the corpus, with the same smoothing. The background model counts
every word of every document; the target model counts every word of the documents marked as target. A document's score is the mean over its
words of target loss minus background loss: lower is nearer to the target.

Counts are exact and grow with the corpus; no table of them is gathered anywhere:

1. Texts are read once into chunks of about ``CHUNK_BYTES``: the chunk's distinct words as hashes, and its words as numbers among them.
2. Each chunk sends the words and pairs that it holds, once each with its counts, to buckets by hash. A bucket adds up what all chunks sent and
   answers each chunk with the corpus counts of the very words and pairs it asked for.
3. Chunks and answers meet by chunk, and every document of the chunk is scored.

A word as frequent as may be is one entry for each chunk, so no bucket is hot. Words and pairs are told apart by 55 bits of hash: among 10^9
different ones about one in 10^7 shares its counts with another.

Defined results: a null or empty text, or one of spaces, has 0 tokens and null losses and score; without any target document the target model
is uniform; repeated rows count and are scored each; an empty table gives an empty result; a null doc_id is scored and matches no label;
very long texts are scored whole, as a chunk of their own; columns other than doc_id, text (and doc_id, quality of the labels) are not read.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from pagemill.llm.common import written

#: Text of a chunk; larger chunks send fewer entries in all, and take about fifteen times their size in a worker.
CHUNK_BYTES = 4 << 20
#: Text for each bucket of counts.
BUCKET_BYTES = 16 << 20
#: Weights of pair, word and uniform probability.
SMOOTHING = (0.6, 0.35, 0.05)
#: Marked rows up to which their ids are broadcast.
BROADCAST_IDS = 1_000_000
#: Words whose hash a worker remembers.
REMEMBERED = 400_000
#: The history of a text's first word.
START = np.uint64(0)
_known: dict[bytes, int] = {}


def word_hashes(text: str | None) -> np.ndarray:
    """64-bit hash of each word, A-Z in lower case."""
    out = []
    for w in (text or "").encode("utf-8", "replace").lower().split():
        h = _known.get(w)
        if h is None:
            h = xxhash.xxh64_intdigest(w)
            if len(_known) < REMEMBERED and len(w) < 64:
                _known[w] = h
        out.append(h)
    return np.array(out, np.uint64)


def word_keys(h: np.ndarray) -> np.ndarray:
    """56-bit keys of words, even and not that of ``START``."""
    return np.maximum((h >> np.uint64(8)) & ~np.uint64(1), np.uint64(2))


def pair_keys(before: np.ndarray, h: np.ndarray) -> np.ndarray:
    """56-bit keys of a word after another one (``START``: after none), odd."""
    x = (before * np.uint64(0x9E3779B97F4A7C15)) ^ (h + (before >> np.uint64(7)))
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return ((x ^ (x >> np.uint64(32))) >> np.uint64(8)) | np.uint64(1)


def packed(values: np.ndarray) -> bytes:
    """64-bit numbers byte plane by byte plane, so that those which are always zero cost nothing."""
    return zlib.compress(np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8).T).tobytes(), 1)


def unpacked(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zlib.decompress(data), np.uint8).reshape(8, -1)
    return np.ascontiguousarray(planes.T).reshape(-1).view("<u8").astype(np.uint64)


def marked(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs(doc_id, text)`` with ``target``: whether the labels give the document quality 1."""
    good = labels.where("quality = 1 AND doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id")).distinct().withColumn("target", F.lit(True))
    good = written(good, "target-ids")
    if good.count() <= BROADCAST_IDS:
        good = F.broadcast(good)
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return own.join(good, "doc_id", "left").withColumn("target", F.coalesce("target", F.lit(False)))


_CHUNK = "chunk long, ids array<long>, counts array<int>, target array<boolean>, words binary, stream binary"


def chunks(rows: DataFrame) -> DataFrame:
    """``rows(doc_id, text, target)`` in chunks: ids, word counts and marks of the documents, the distinct words and the words as numbers."""

    def encode(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        number, size, part = TaskContext.get().partitionId() << 32, 0, []

        def flush() -> pd.DataFrame:
            nonlocal number
            hashes = [h for _, h, _ in part]
            words, stream = np.unique(np.concatenate(hashes), return_inverse=True)
            row = (number, [d for d, _, _ in part], [len(h) for h in hashes], [t for _, _, t in part], packed(words), packed(stream))
            number += 1
            return pd.DataFrame([row], columns=["chunk", "ids", "counts", "target", "words", "stream"])

        for f in frames:
            for d, text, target in zip(f["doc_id"].astype("Int64"), f["text"], f["target"]):
                part.append((None if d is pd.NA else int(d), word_hashes(text), bool(target)))
                size += len(text or "")
                if size >= CHUNK_BYTES:
                    yield flush()
                    size, part = 0, []
        if part:
            yield flush()

    return written(rows.select("doc_id", "text", "target").mapInPandas(encode, _CHUNK), "lm-chunks")


class Chunk:
    """A chunk's words and pairs: ``keys`` in order, ``background`` and ``target`` counts in it, and where each word finds its own entries."""

    def __init__(self, counts, target, words: bytes, stream: bytes):
        h, at = unpacked(words), unpacked(stream).astype(np.int64)
        self.counts = np.asarray(counts, np.int64)
        starts = np.cumsum(self.counts) - self.counts
        before = np.concatenate(([-1], at[:-1]))[: len(at)]
        before[starts[self.counts > 0]] = -1
        flag = np.repeat(np.asarray(target, np.float64), self.counts)
        pair, number = np.unique((before + 1) * max(1, len(h)) + at, return_inverse=True)
        first, second = pair // max(1, len(h)) - 1, pair % max(1, len(h))
        own = word_keys(h)
        keys = np.concatenate(([START], own, pair_keys(np.where(first >= 0, h[first], START) if len(h) else first.astype(np.uint64), h[second])))
        begun = self.counts > 0
        each = [np.concatenate(([n], np.bincount(at, w, len(h)), np.bincount(number, w, len(pair)))) for n, w in ((begun.sum(), None), ((begun & np.asarray(target, bool)).sum(), flag))]
        self.keys, place = np.unique(keys, return_inverse=True)
        self.background, self.target = (np.bincount(place, x, len(self.keys)).astype(np.uint64) for x in each)
        self.word, self.pair = place[1 + at], place[1 + len(h) + number]
        self.history = np.where(before >= 0, place[1 + np.maximum(before, 0)] if len(at) else before, place[0])

    def buckets(self, n: int) -> np.ndarray:
        """The bounds of the keys of each of ``n`` buckets."""
        return np.searchsorted((self.keys >> np.uint64(24)) * np.uint64(n) >> np.uint64(32), np.arange(n + 1, dtype=np.uint64))


def counted(table: DataFrame, buckets: int) -> DataFrame:
    """(chunk, bucket, background, target): the corpus counts of each chunk's keys; rows of chunk -1 have a bucket's words and totals."""

    def ask(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for r in f.itertuples(index=False):
                c, rows = Chunk(r.counts, r.target, r.words, r.stream), []
                bounds = c.buckets(buckets)
                for b, (x, y) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist())):
                    if y > x:
                        rows.append((b, r.chunk, packed(np.diff(c.keys[x:y], prepend=np.uint64(0))), packed(c.background[x:y]), packed(c.target[x:y])))
                yield pd.DataFrame(rows, columns=["bucket", "chunk", "keys", "background", "target"])

    def answer(f: pd.DataFrame) -> pd.DataFrame:
        parts = [np.cumsum(unpacked(k)) for k in f["keys"]]
        keys, place = np.unique(np.concatenate(parts), return_inverse=True)
        both = [np.bincount(place, np.concatenate([unpacked(x) for x in f[side]])).astype(np.uint64) for side in ("background", "target")]
        rows, at = [], 0
        for chunk, part in zip(f["chunk"].tolist(), parts):
            own = place[at : at + len(part)]
            at += len(part)
            rows.append((chunk, packed(both[0][own]), packed(both[1][own]), 0, 0, 0))
        words = (keys & np.uint64(1) == 0) & (keys != START)
        rows.append((-1, None, None, int(words.sum()), int(both[0][words].sum()), int(both[1][words].sum())))
        out = pd.DataFrame(rows, columns=["chunk", "background", "target", "words", "background_total", "target_total"])
        return out.assign(bucket=f["bucket"].iloc[0])[["chunk", "bucket", "background", "target", "words", "background_total", "target_total"]]

    asked = table.select("chunk", "counts", "target", "words", "stream").mapInPandas(ask, "bucket int, chunk long, keys binary, background binary, target binary")
    schema = "chunk long, bucket int, background binary, target binary, words long, background_total long, target_total long"
    return written(asked.groupBy("bucket").applyInPandas(answer, schema), "lm-counts")


def losses(pair: np.ndarray, word: np.ndarray, history: np.ndarray, total: int, vocabulary: int) -> np.ndarray:
    """Negative log probability of each word, from the counts of its pair, itself and its history."""
    a, b, c = SMOOTHING
    single = word / total if total else np.full(len(word), 1 / vocabulary)
    given = np.where(history > 0, pair / np.maximum(history, 1), single)
    return -np.log(a * given + b * single + c / vocabulary)


def scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, n_tokens, target_loss, background_loss and score of each row of ``docs``."""
    rows = marked(docs, labels)
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    table = chunks(rows)
    answers = counted(table, max(1, math.ceil(size / BUCKET_BYTES)))
    total = answers.where("chunk = -1").agg(F.sum("words"), F.sum("background_total"), F.sum("target_total")).first()
    vocabulary, *totals = (int(x or 0) for x in total)
    vocabulary = max(1, vocabulary)

    def compute(own: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
        out = []
        for r in own.itertuples(index=False):
            c, means = Chunk(r.counts, r.target, r.words, r.stream), []
            doc, n = np.repeat(np.arange(len(c.counts)), c.counts), np.maximum(c.counts, 1)
            parts = found.sort_values("bucket")
            for side, every in zip(("background", "target"), totals):
                counts = np.concatenate([unpacked(x) for x in parts[side]]).astype(np.float64)
                means.append(losses(counts[c.pair], counts[c.word], counts[c.history], every, vocabulary))
            sums = [np.bincount(doc, x, len(n)) / n for x in (means[1], means[0], means[1] - means[0])]
            for i, d in enumerate(r.ids):
                out.append((d, int(c.counts[i]), *((float(x[i]) for x in sums) if c.counts[i] else (None,) * 3)))
        done = pd.DataFrame(out, columns=["doc_id", "n_tokens", "target_loss", "background_loss", "score"])
        return done.astype({"doc_id": "Int64", "n_tokens": "int64", "target_loss": "float64", "background_loss": "float64", "score": "float64"})

    side = answers.where("chunk >= 0").select("chunk", "bucket", "background", "target")
    schema = "doc_id long, n_tokens long, target_loss double, background_loss double, score double"
    return table.groupBy("chunk").cogroup(side.groupBy("chunk")).applyInPandas(compute, schema)
