"""k-means over vectors of integers by exponion search.

Vectors lie in blocks, one row each, which stay where they are; a round sends the centroids out and gets sums and counts back. A vector carries
an upper bound on the distance to its centroid and a lower bound on that to all others, moved by as much as centroids move. Where these
overlap, the vector is compared only with the centroids inside a ball around its own, of radius twice its distance plus the distance from
its centroid to the next one: that ball holds its two nearest. Sorted lists of the distances between centroids give the ball's members; its border counts,
and a bound that is only met doesn't exclude, so that ties are found and go to the smaller number.

Distances are compared as exact integers; only bounds are floating point, and are widened by ``SLACK``. Each round's blocks are kept on the executors' disks
and are computed again from the vectors, with the centroids of the rounds so far, where an executor is lost.

Defined results: vectors with another number of components, or with null or non-finite ones, take no part; components are cut to +-2^16 (times 1024), so
that squared distances fit 64 bits; equal vectors and ids each count; a null id hashes as an empty text; fewer vectors than clusters make that many clusters; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame, Window, functions as F

CLUSTERS = 8
ROUNDS = 10
DIM = 64
SCALE = 1024
SEED = 3
#: Vectors in a block: 1 MB of components.
BLOCK_ROWS = 4_096
#: Bounds are wider than rounding needs.
SLACK = 1e-9
MOST = 1 << 26

BLOCK_SCHEMA = "ids binary, nulls binary, x binary, a binary, upper binary, lower binary, sums array<long>, counts array<long>"


def whole_vectors(rows: DataFrame, key: str = "vec_id", vector: str = "embedding", dim: int = DIM) -> DataFrame:
    """(id, v) of the vectors that take part, with integer components."""
    v = F.transform(F.col(vector), lambda x: x.cast("double"))
    good = v.isNotNull() & (F.size(v) == dim) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    scaled = F.transform(v, lambda x: F.floor(F.greatest(F.least(x * SCALE, F.lit(float(MOST))), F.lit(-float(MOST)))).cast("int"))
    return rows.where(good).select(F.col(key).cast("long").alias("id"), scaled.alias("v"))


def first_centroids(vectors: DataFrame, clusters: int = CLUSTERS, seed: int = SEED) -> np.ndarray:
    """The vectors whose ids hash lowest, in that order."""
    rank = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256)
    return np.array([r["v"] for r in vectors.select(rank.alias("rank"), "v").orderBy("rank", "v").limit(clusters).collect()], np.int64).reshape(-1, DIM)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Vectors as blocks that no round has assigned yet."""
    for batch in batches:
        for at in range(0, batch.num_rows, BLOCK_ROWS):
            part = batch.slice(at, BLOCK_ROWS)
            n = part.num_rows
            ids = part.column(0)
            x = part.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.int32)
            far = np.full(n, np.inf)
            values = [ids.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64), ids.is_null().to_numpy(zero_copy_only=False), x, np.zeros(n, np.int32), far, np.zeros(n)]
            yield pa.RecordBatch.from_arrays([pa.array([v.tobytes()], pa.binary()) for v in values] + [pa.array([[]], pa.list_(pa.int64()))] * 2, _NAMES)


_NAMES = [x.split()[0] for x in BLOCK_SCHEMA.split(", ")]


def exact(x: np.ndarray, centroid: np.ndarray) -> np.ndarray:
    """Squared distances of integer rows to a centroid."""
    d = x.astype(np.int64) - centroid
    return np.einsum("ij,ij->i", d, d)


class Exponion:
    """Distances between centroids, sorted from each one outwards."""

    def __init__(self, centroids: np.ndarray):
        self.c = centroids
        d = np.sqrt(np.array([exact(centroids, c) for c in centroids], np.float64).reshape(len(centroids), -1))
        self.order = [np.lexsort((np.arange(len(d)), row)) for row in d]
        self.order = [np.concatenate(([i], o[o != i])) for i, o in enumerate(self.order)]
        self.sorted = [row[o] for row, o in zip(d, self.order)]
        self.near = np.array([s[1] if len(s) > 1 else np.inf for s in self.sorted])

    def assigned(self, x: np.ndarray, a: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        """New cluster and bounds of each row, and how many distances were computed."""
        a, upper, lower = a.copy(), upper.copy(), lower.copy()
        safe = lambda rows: upper[rows] < np.maximum(lower[rows], self.near[a[rows]] / 2)
        open_ = np.nonzero(~safe(slice(None)))[0]
        done = 0
        for c in range(len(self.c)):
            rows = open_[a[open_] == c]
            upper[rows] = np.sqrt(exact(x[rows], self.c[c])) * (1 + SLACK) + SLACK
            done += len(rows)
        open_ = open_[~safe(open_)]
        here = a.copy()
        for c in range(len(self.c)):
            rows = open_[here[open_] == c]
            if not len(rows):
                continue
            radius = (2 * upper[rows] + self.near[c]) * (1 + SLACK) + SLACK
            members = np.searchsorted(self.sorted[c], radius, side="right")
            best, second, who = np.full(len(rows), np.iinfo(np.int64).max), np.full(len(rows), np.iinfo(np.int64).max), np.full(len(rows), len(self.c))
            for place, other in enumerate(self.order[c][: members.max()]):
                at = np.nonzero(members > place)[0]
                d = exact(x[rows[at]], self.c[other])
                done += len(at)
                wins = (d < best[at]) | ((d == best[at]) & (other < who[at]))
                second[at] = np.where(wins, best[at], np.minimum(second[at], d))
                who[at] = np.where(wins, other, who[at])
                best[at] = np.where(wins, d, best[at])
            a[rows] = who
            upper[rows] = np.sqrt(best.astype(np.float64)) * (1 + SLACK) + SLACK
            lower[rows] = np.where(members > 1, np.sqrt(second.astype(np.float64)) * (1 - SLACK) - SLACK, np.inf if len(self.c) == 1 else 0.0)
        return a, upper, lower, done


def _round(centroids: np.ndarray, before: np.ndarray | None):
    """Blocks with bounds moved from the centroids ``before``, assigned to ``centroids``, and their sums by cluster."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = Exponion(centroids)
        moved = np.zeros(len(centroids)) if before is None else np.sqrt([float(exact(c[None], b)[0]) for c, b in zip(centroids, before)]) * (1 + SLACK) + SLACK
        others = np.array([max([m for j, m in enumerate(moved) if j != i], default=0.0) for i in range(len(moved))])
        for batch in batches:
            for row in range(batch.num_rows):
                ids, nulls, x, a, upper, lower = (batch.column(i)[row].as_py() for i in range(6))
                v, a = np.frombuffer(x, np.int32).reshape(-1, DIM), np.frombuffer(a, np.int32)
                upper, lower = np.frombuffer(upper) + moved[a], np.frombuffer(lower) - others[a]
                a, upper, lower, _ = search.assigned(v, a, upper, lower)
                order = np.argsort(a, kind="stable")
                counts = np.bincount(a, minlength=len(centroids))
                sums = np.array([v[part].sum(0, dtype=np.int64) for part in np.split(order, np.cumsum(counts)[:-1])])
                out = [pa.array([b], pa.binary()) for b in (ids, nulls, x, a.astype(np.int32).tobytes(), upper.tobytes(), lower.tobytes())]
                yield pa.RecordBatch.from_arrays(out + [pa.array([s.ravel().tolist()], pa.list_(pa.int64())) for s in (sums, counts)], _NAMES)

    return run


def _rows(centroids: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                ids, nulls, x, a = (batch.column(i)[row].as_py() for i in range(4))
                v, a = np.frombuffer(x, np.int32).reshape(-1, DIM), np.frombuffer(a, np.int32)
                distance = np.zeros(len(a), np.int64)
                for c in np.unique(a):
                    distance[a == c] = exact(v[a == c], centroids[c])
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(ids, np.int64), mask=np.frombuffer(nulls, np.bool_)), pa.array(a), pa.array(distance)], ["id", "cluster", "distance"])

    return run


def totals(blocks: DataFrame, clusters: int) -> tuple[np.ndarray, np.ndarray]:
    """Exact sums and counts of all clusters: one row of numbers, added up by Spark."""
    cells = blocks.select(F.posexplode(F.concat("sums", "counts")).alias("cell", "value")).groupBy("cell").agg(F.sum(F.col("value").cast("decimal(38,0)")).alias("value"))
    values = np.zeros(clusters * (DIM + 1), object)
    for r in cells.collect():
        values[r["cell"]] = int(r["value"])
    return values[: clusters * DIM].reshape(clusters, DIM), values[clusters * DIM :]


def clustered(vectors: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS, seed: int = SEED) -> tuple[DataFrame, np.ndarray]:
    """(id, cluster, distance) of ``vectors(id, v)``, and the final centroids."""
    centroids, before = first_centroids(vectors, clusters, seed), None
    blocks = vectors.mapInArrow(_blocks, BLOCK_SCHEMA)
    if not len(centroids):
        return vectors.select("id", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance")), centroids
    held = None
    for n in range(rounds + 1):
        blocks = blocks.mapInArrow(_round(centroids, before), BLOCK_SCHEMA).persist(StorageLevel.DISK_ONLY)
        if n == rounds:
            break
        sums, counts = totals(blocks, len(centroids))
        if held is not None:
            held.unpersist()
        held, before = blocks, centroids
        centroids = np.array([[int(s) // int(k) for s in row] if k else list(old) for row, k, old in zip(sums, counts, centroids)], np.int64)
    return blocks.mapInArrow(_rows(centroids), "id long, cluster int, distance long"), centroids


def cluster_report(rows: DataFrame) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia and centroid_sha256 of each vector of ``rows(vec_id, embedding)`` that takes part."""
    found, centroids = clustered(whole_vectors(rows))
    inertia = found.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia"))
    names = [(i, hashlib.sha256(",".join(str(int(x)) for x in c).encode()).hexdigest()) for i, c in enumerate(centroids)]
    known = rows.sparkSession.createDataFrame(names, "cluster int, centroid_sha256 string")
    # one row for each cluster
    of_cluster = F.broadcast(inertia.join(known, "cluster").withColumn("inertia", F.sum("cluster_inertia").over(Window.partitionBy(F.lit(0)))))
    return found.join(of_cluster, "cluster").select(F.col("id").alias("vec_id"), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
