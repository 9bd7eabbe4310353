"""Approximate nearest neighbours by collision-counting hashing, for largest inner product.

Vectors get one extra component that makes all norms equal, so that the largest inner product is the least distance. Every
projection on a random line is one hash function. Vectors are dealt by hash into blocks, once; a block keeps, for each line, its vectors'
projections in a sorted array. A query opens a window around its own projection on every line, and each vector counts the lines on which it
lies in the window. Windows widen by a constant factor (virtual rehashing over the same arrays) until enough vectors reach the collision
threshold; the ``VERIFY`` share of the block with the most collisions is verified with its exact inner product. Each block gives
its best; a query's results are the best over all blocks.

Every row is indexed and nothing is fitted on a sample. The queries are a stated set that is held against all rows, in blocks: they
travel to the blocks in rounds of at most ``QUERY_BYTES``, and the vectors stay where they are. In a block with no more vectors than are verified
anyway the search is exact.

Defined results: vectors that are null, empty, zero, or hold null or non-finite components, rows without an id, and vectors whose
dimension isn't the most common one take no part; rows with the query's own id are not its candidates; a repeated query id is asked
once for each of its rows and keeps the best ``k`` of all; equal vectors tie and the smaller id comes first; an empty table gives an empty result;
columns other than id and vector are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pagemill.llm.common import written
from pyspark.sql import Column, DataFrame, Window, functions as F

#: Results for each query.
K = 20
#: Lines, and the share of them on which a vector must collide.
LINES = 256
THRESHOLD = 0.5
#: Factor by which windows widen.
WIDEN = 1.2
#: First half-width, in standard deviations of the block's projections.
FIRST = 1.0
#: Share of a block that is verified, at least ``K`` times ``LEAST``.
VERIFY = 0.095
LEAST = 25
BLOCK_ROWS = 8192
#: Queries that are broadcast at once.
QUERY_BYTES = 16 << 20
SEED = 7


def usable(vector: Column) -> Column:
    """Whether a vector takes part."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    return F.coalesce((F.size(vector) > 0) & F.forall(vector, finite) & F.exists(vector, lambda x: x != 0), F.lit(False))


def lines(dimension: int, n: int = LINES, seed: int = SEED) -> np.ndarray:
    """The random directions, the same in every task."""
    return np.random.default_rng(seed).standard_normal((dimension, n))


class Block:
    """Sorted projections of a block's vectors, and the search over them."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, norm: float):
        order = np.argsort(ids, kind="stable")
        self.ids, self.vectors, self.norm = ids[order], vectors[order], norm
        extra = np.sqrt(np.maximum(norm * norm - np.einsum("ij,ij->i", self.vectors, self.vectors), 0))
        self.lines = lines(vectors.shape[1] + 1)
        projected = self.vectors @ self.lines[:-1] + extra[:, None] * self.lines[-1]
        rows = np.argsort(projected, axis=0, kind="stable")
        self.sorted = np.take_along_axis(projected, rows, axis=0).T.copy()
        # each vector's place in the sorted array of each line
        self.place = np.empty(self.sorted.shape, np.uint16)
        np.put_along_axis(self.place, rows.T, np.arange(len(self.ids), dtype=np.uint16)[None, :], axis=1)
        self.width = max(float(projected.std(axis=0).mean()), 1e-12)

    def collisions(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """For each vector the number of lines on which its place is in ``low`` .. ``high`` - 1."""
        inside = (self.place - low.astype(np.uint16)[:, None]) < (high - low).astype(np.uint16)[:, None]
        whole = np.zeros(inside.shape[1], np.int64)
        for at in range(0, len(inside), 128):  # sums of bytes
            whole += np.add.reduce(inside[at : at + 128].view(np.uint8), axis=0, dtype=np.uint8)
        return whole

    def candidates(self, at: np.ndarray, need: int):
        """For each row of projections ``at``: (its number, the ``need`` vectors with the most collisions, all of them at the threshold or above)."""
        n, m = len(self.ids), len(self.sorted)
        if n <= need:
            yield from ((i, np.arange(n)) for i in range(len(at)))
            return
        wanted, half, open_ = max(1, math.ceil(THRESHOLD * m)), FIRST * self.width, np.arange(len(at))
        while len(open_):
            a = np.stack([np.searchsorted(s, x - half, "left") for s, x in zip(self.sorted, at[open_].T)], axis=1)
            b = np.stack([np.searchsorted(s, x + half, "right") for s, x in zip(self.sorted, at[open_].T)], axis=1)
            left = []
            for i, q in enumerate(open_.tolist()):
                seen = self.collisions(a[i], b[i])
                least = int(np.partition(seen, n - need)[n - need])
                if least < wanted and (a[i].any() or (b[i] < n).any()):
                    left.append(q)
                    continue
                more = np.nonzero(seen > least)[0]
                yield q, np.sort(np.concatenate((more, np.nonzero(seen == least)[0][: need - len(more)])))
            open_, half = np.array(left, np.int64), half * WIDEN

    def search(self, query_ids: np.ndarray, queries: np.ndarray, k: int, exact: bool = False) -> list[tuple[int, int, float]]:
        need = len(self.ids) if exact else max(LEAST * k, math.ceil(VERIFY * len(self.ids)))
        scaled = queries * (self.norm / np.linalg.norm(queries, axis=1))[:, None]
        out: list[tuple[int, int, float]] = []
        for i, rows in self.candidates(scaled @ self.lines[:-1], need):
            q, vector = int(query_ids[i]), queries[i]
            rows = rows[self.ids[rows] != q]
            if not len(rows):
                continue
            rough = self.vectors[rows] @ vector
            if len(rows) > k:
                edge = np.partition(rough, len(rows) - k)[len(rows) - k]
                rows = rows[rough >= edge - 1e-9 * max(1.0, abs(edge))]
            score = (self.vectors[rows] * vector).sum(axis=1)  # the same sum for equal vectors
            best = np.lexsort((self.ids[rows], -score))[:k]
            out += [(q, int(i), float(s)) for i, s in zip(self.ids[rows[best]], score[best])]
        return out


def nearest(vectors: DataFrame, is_query: Column, k: int = K, id_column: str = "vec_id", vector_column: str = "embedding", exact: bool = False) -> DataFrame:
    """query_id, rank (from 1), vec_id and score of the ``k`` nearest found of each row for which ``is_query`` holds; with ``exact`` every vector is verified, whatever its collisions.

    Queries that don't fit one round of ``QUERY_BYTES`` are asked round after round: the best of each block are written before the next queries reach the driver.
    """
    fit = vectors.where(usable(F.col(vector_column)) & F.col(id_column).isNotNull())
    fit = fit.select(F.col(id_column).cast("long").alias("id"), F.transform(vector_column, lambda x: x.cast("double")).alias("v"), F.coalesce(is_query, F.lit(False)).alias("q"))
    length = F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)
    shapes = fit.groupBy(F.size("v").alias("d")).agg(F.count(F.lit(1)).alias("n"), F.max(length).alias("norm"), F.count_if("q").alias("queries"))
    best = shapes.orderBy(F.desc("n"), "d").first()
    dimension, n, norm, queries = (best["d"], best["n"], math.sqrt(best["norm"]), best["queries"]) if best else (0, 0, 1.0, 0)
    norm *= 1 + 1e-9
    fit = fit.where(F.size("v") == dimension)
    schema = "query_id long, vec_id long, score double"
    if not n or not queries:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    data = fit.select("id", "v").repartition(max(1, math.ceil(n / BLOCK_ROWS)), "id")
    rounds = math.ceil(queries * (8 * dimension + 8) / QUERY_BYTES)

    def asked(number: int) -> DataFrame:
        """The best of each block for the queries of one round, at most ``QUERY_BYTES`` on average."""
        part = fit.where("q").where(F.pmod(F.xxhash64("id", F.lit(2)), F.lit(rounds)) == number).select("id", "v").toPandas()
        shared = vectors.sparkSession.sparkContext.broadcast((part["id"].to_numpy(np.int64), np.stack(part["v"].to_numpy()) if len(part) else np.zeros((0, dimension))))

        def search(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            ids, queries = shared.value

            def found(own: list[pd.DataFrame]) -> pd.DataFrame:
                f = pd.concat(own)
                rows = Block(f["id"].to_numpy(np.int64), np.stack(f["v"].to_numpy()), norm).search(ids, queries, k, exact)
                return pd.DataFrame(rows, columns=["query_id", "vec_id", "score"]).astype({"query_id": "int64", "vec_id": "int64", "score": "float64"})

            kept, size = [], 0
            for f in frames:
                while len(f):
                    part, f = f[: 2 * BLOCK_ROWS - size], f[2 * BLOCK_ROWS - size :]
                    kept.append(part)
                    size += len(part)
                    if size == 2 * BLOCK_ROWS:
                        yield found(kept)
                        kept, size = [], 0
            if kept:
                yield found(kept)

        found = data.mapInPandas(search, schema)
        if rounds == 1:
            return found
        found = written(found, "nearest-round")
        shared.destroy()
        return found

    if rounds > 1:
        data = written(data, "vectors")
    best = asked(0)
    for number in range(1, rounds):
        best = best.unionByName(asked(number))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return best.select("query_id", rank.alias("rank"), "vec_id", "score").where(F.col("rank") <= k)


def brute_force(ids: np.ndarray, vectors: np.ndarray, query_ids: np.ndarray, k: int = K) -> dict[int, list[int]]:
    """The true results, for measuring recall on a small table."""
    out = {}
    for q in query_ids.tolist():
        score = (vectors * vectors[np.nonzero(ids == q)[0][0]]).sum(axis=1)
        order = [int(ids[i]) for i in np.lexsort((ids, -score)) if ids[i] != q]
        out[q] = order[:k]
    return out
