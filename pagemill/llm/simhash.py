"""SimHash near-duplicate groups with a vantage-point tree over fingerprints.

1. Every text gets a 64-bit fingerprint from its word shingles (one pass, no shuffle).
2. A vantage-point tree is built on the driver from a uniform sample of distinct fingerprints, ``PER_LEAF`` for each leaf;
   its leaves are shards, as many as the count asks for. A leaf that still gets too many fingerprints is cut into blocks, and its work into cells of two blocks. Each distinct fingerprint has one home leaf, and visits each other leaf that its ball of
   radius ``RADIUS`` overlaps by the triangle inequality; a pair with different homes meets in the later of both.
3. In each shard the tree goes on, in memory, and only pairs the bounds can't exclude are compared, all of them. A shard
   returns a spanning forest of its links, so a tight group of n fingerprints gives n - 1 links, not n * n.
4. Links are joined to components: up to ``FEW_LINKS`` in one task, more by alternating large-star and small-star steps.

Defined results: a null text, an empty text and a text of spaces have fingerprint zero; a text with fewer
words than a shingle is hashed whole; equal texts have equal fingerprints and one component; repeated rows stay,
one row out for each row in; an empty table gives an empty result; a null doc_id never is a component's id (null only
where the whole component has none); columns other than doc_id and text are not read.

The pipeline's stage (``one_of_each_group``) takes five-word shingle sets instead and a wider radius on the same tree, and links
two texts only after the exact Jaccard similarity of their sets, 0.8 or more, is confirmed. Sets of that similarity have sizes
within 0.8 of each other, so each band of sizes has shards of its own and a text visits its own band and the next.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from pagemill.llm.common import discard, unused, written

SHINGLE = 4
SEED = 42
RADIUS = 4
#: Sampled fingerprints for each leaf of the upper tree, and the least number sampled.
PER_LEAF = 16
SAMPLE = 4096
#: Home fingerprints that a shard should hold; the tree's depth follows from it.
SHARD_ROWS = 32768
#: Home fingerprints below which a leaf in memory compares directly.
LEAF = 256
#: Kept documents up to which their ids are broadcast instead of moving the texts.
BROADCAST_IDS = 1_000_000
#: Links up to which components are found in one task.
FEW_LINKS = 200_000
#: Comparisons made at once.
TILE = 1 << 20
#: The pipeline's stage: words of a shingle, the bits within which pairs are looked for before their similarity is confirmed, those
#: within which they must be in both fingerprints together, and the home points (about 300 bytes each) of a shard.
STAGE_SHINGLE = 5
STAGE_RADIUS = 16
STAGE_BOTH = 34
STAGE_SHARD_ROWS = 65_536
#: Classes by which a set's shingles are counted; what two sets share is at most the sum of the lesser counts.
CLASSES = 256
#: Sizes in one band differ by this factor; it is over 1.25, so that similar sets are in the same or in neighbouring bands.
BAND = 1.26
#: Points compared at once with all home points of like size.
BLOCK = 64


def fingerprint(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """The 64-bit fingerprint: a bit is set if over half of the shingles' XXH64 have it."""
    found = (text or "").encode("utf-8", "replace").lower().split()
    if not found:
        return 0
    joined = b" ".join(found)
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    if len(found) > shingle:
        starts, ends = starts[: -shingle + 1 or None], ends[shingle - 1 :]
    else:
        starts, ends = starts[:1], ends[-1:]
    h = xxhash.xxh64_intdigest
    n, ones = len(starts), np.zeros(64, np.int64)
    for at in range(0, n, 1 << 16):
        part = np.fromiter((h(joined[a:b], seed) for a, b in zip(starts[at : at + (1 << 16)].tolist(), ends[at : at + (1 << 16)].tolist())), np.uint64)
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """(doc_id, fp): fp is the fingerprint's bits as a signed long."""

    def compute(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            bits = np.array([fingerprint(t, shingle, seed) for t in f["text"]], np.uint64)
            yield pd.DataFrame({"doc_id": f["doc_id"], "fp": bits.view(np.int64)})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(compute, "doc_id long, fp long")


def _distance(a: np.ndarray, vantage: np.uint64) -> np.ndarray:
    return np.bitwise_count(a ^ vantage)


def _vantage(points: np.ndarray) -> np.uint64:
    """Of a few candidates spread over the points, the one whose distances vary most."""
    few = points[:: max(1, len(points) // 16)][:16]
    return max(few, key=lambda v: float(np.var(_distance(points, v))))


def build_tree(points: np.ndarray, depth: int) -> list:
    """Nested [vantage, mu, inner, outer] with leaf numbers; inner holds distances up to mu. Splits at the median."""
    leaves = iter(range(1 << depth))

    def node(part: np.ndarray, left: int):
        if not left or len(part) < 2:
            return next(leaves)
        v = _vantage(part)
        d = _distance(part, v)
        mu = int(np.sort(d)[(len(d) - 1) // 2])
        if mu == int(d.max()):
            mu -= 1
        if not (d <= mu).any():
            return next(leaves)
        return [int(v), mu, node(part[d <= mu], left - 1), node(part[d > mu], left - 1)]

    return node(points, depth)


def visits(tree, points: np.ndarray, radius: int, guest: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows (point index, leaf, is home): the home leaf of each point and each later leaf that its ball overlaps; as a ``guest`` all of these leaves, none as home."""
    rows, leaves, homes = [], [], []

    def walk(node, at: np.ndarray, home: np.ndarray) -> None:
        if not len(at):
            return
        if not isinstance(node, list):
            rows.append(at), leaves.append(np.full(len(at), node, np.int32)), homes.append(home)
            return
        v, mu, inner, outer = node
        d = _distance(points[at], np.uint64(v)).astype(np.int64)
        near, far = d <= mu + radius, d + radius > mu
        walk(inner, at[near], (home & (d <= mu))[near])
        walk(outer, at[far], (home & (d > mu))[far])

    walk(tree, np.arange(len(points)), np.ones(len(points), bool))
    if not rows:
        return np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, bool)
    row, leaf, home = np.concatenate(rows), np.concatenate(leaves), np.concatenate(homes)
    if guest:
        return row, leaf, np.zeros(len(row), bool)
    own = np.zeros(len(points), np.int32)
    own[row[home]] = leaf[home]
    use = home | (leaf > own[row])
    return row[use], leaf[use], home[use]


def cells(block: np.ndarray, home: np.ndarray, blocks: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, cell, as home) for the rows of a leaf in ``blocks`` blocks: cell i * blocks + j has the home rows of block i, and rows of block j to hold against them.

    Each pair with a home row meets in exactly one cell: two home rows in that of the lower block, or of their common one.
    """
    rows, out, homes = [], [], []
    for b in range(blocks):
        own, guests = np.nonzero((block == b) & home)[0], np.nonzero((block == b) & ~home)[0]
        for x in range(blocks):
            rows += [own, guests]
            out += [np.full(len(own), b * blocks + x), np.full(len(guests), x * blocks + b)]
            homes += [np.ones(len(own), bool), np.zeros(len(guests), bool)]
            if x < b:
                rows.append(own), out.append(np.full(len(own), x * blocks + b)), homes.append(np.zeros(len(own), bool))
    return np.concatenate(rows), np.concatenate(out), np.concatenate(homes)


def routed(f: pd.DataFrame, leaf: np.ndarray, home: np.ndarray, full: dict, keys: list) -> pd.DataFrame:
    """``f`` with shard, cell and home; rows of a full leaf once for each of its cells. ``keys`` are the leaves' names in ``full``."""
    f = f.assign(shard=leaf.astype(np.int32), cell=np.int32(0), home=home)
    heavy = np.array([k in full for k in keys], bool)
    if not heavy.any():
        return f
    out, keys = [f[~heavy]], [k for k, x in zip(keys, heavy) if x]
    rest = f[heavy].reset_index(drop=True)
    for key in set(keys):
        part = rest[np.array([k == key for k in keys])]
        block = (_spread(part["fp"].to_numpy(np.int64)) % np.uint64(full[key])).astype(np.int64)
        row, cell, as_home = cells(block, part["home"].to_numpy(), full[key])
        out.append(part.iloc[row].assign(cell=cell.astype(np.int32), home=as_home))
    return pd.concat(out, ignore_index=True)


def _spread(fp: np.ndarray) -> np.ndarray:
    x = fp.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def among(f: pd.DataFrame, full: dict, key) -> bool:
    """Whether the home rows of a cell are also held against each other."""
    cell = int(f["cell"].iloc[0])
    return key not in full or cell // full[key] == cell % full[key]


def upper_tree(points: DataFrame, total: int, shard_rows: int):
    """The tree of depth log2(total / shard_rows) over a sample of ``points.fp``."""
    depth = max(0, int(np.ceil(np.log2(max(1, total) / shard_rows))))
    if not depth:
        return 0
    sample = [r[0] for r in points.select("fp").distinct().orderBy(F.xxhash64("fp"), "fp").limit(max(SAMPLE, PER_LEAF << depth)).collect()]
    return build_tree(np.array(sample, np.int64).view(np.uint64), depth)


def full_leaves(points: DataFrame, tree, shard_rows: int, band: str | None = None) -> dict:
    """Blocks of each leaf, or (band, leaf), with more than twice ``shard_rows`` home rows: one line for each so many rows."""

    def homes(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            row, leaf, home = visits(tree, f["fp"].to_numpy(np.int64).view(np.uint64), 0)
            row, leaf = row[home], leaf[home]
            yield pd.DataFrame({"shard": leaf, "band": f["band"].to_numpy()[row] if band else np.int32(0)}).value_counts().rename("n").reset_index()

    chosen = points.select("fp", *([band] if band else []))
    counts = chosen.mapInPandas(homes, "shard int, band int, n long").groupBy("shard", "band").agg(F.sum("n").alias("n"))
    heavy = counts.where(F.col("n") > 2 * shard_rows).collect()
    return {((r["band"], r["shard"]) if band else r["shard"]): int(np.ceil(r["n"] / shard_rows)) for r in heavy}


class Forest:
    """Union by least label over local numbers, on arrays of links."""

    def __init__(self, n: int):
        self.label = np.arange(n)

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            x, y = self.label[a], self.label[b]
            use = x != y
            if not use.any():
                return
            a, b, x, y = a[use], b[use], x[use], y[use]
            np.minimum.at(self.label, np.maximum(x, y), np.minimum(x, y))
            while (up := self.label[self.label]).tobytes() != self.label.tobytes():
                self.label = up


def links(points: np.ndarray, n_home: int, radius: int, mutual: bool = True) -> np.ndarray:
    """Label of each point under all links with a home point (the first ``n_home``), those of home points among themselves only if ``mutual``: the least linked number."""
    forest = Forest(len(points))

    def compare(home: np.ndarray, query: np.ndarray) -> None:
        step = max(1, TILE // max(1, len(home)))
        for at in range(0, len(query), step):
            q = query[at : at + step]
            i, j = np.nonzero(np.bitwise_count(points[q][:, None] ^ points[home][None, :]) <= radius)
            forest.link(q[i], home[j])

    def walk(home: np.ndarray, query: np.ndarray) -> None:
        if not len(home) or not len(query):
            return
        if len(home) <= LEAF:
            return compare(home, query)
        v = _vantage(points[home])
        d = _distance(points[home], v)
        mu = int(np.sort(d)[(len(d) - 1) // 2])
        if mu == int(d.max()):
            mu -= 1
        if not (d <= mu).any():
            return compare(home, query)
        e = _distance(points[query], v).astype(np.int64)
        walk(home[d <= mu], query[e <= mu + radius])
        walk(home[d > mu], query[e + radius > mu])

    walk(np.arange(n_home), np.arange(0 if mutual else n_home, len(points)))
    return forest.label


def fingerprint_links(distinct: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(a, b) with a > b: a spanning forest, shard by shard, of all pairs of ``distinct.fp`` within ``radius`` bits."""
    tree = upper_tree(distinct, distinct.count(), SHARD_ROWS)
    full = full_leaves(distinct, tree, SHARD_ROWS)

    def route(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            row, leaf, home = visits(tree, f["fp"].to_numpy(np.int64).view(np.uint64), radius)
            yield routed(f.iloc[row], leaf, home, full, leaf.tolist() if full else [])[["shard", "cell", "home", "fp"]]

    def shard(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values(["home", "fp"], ascending=[False, True])
        fp = f["fp"].to_numpy(np.int64)
        label = links(fp.view(np.uint64), int(f["home"].sum()), radius, among(f, full, int(f["shard"].iloc[0])))
        a, b = fp, fp[label]
        use = a != b
        return pd.DataFrame({"a": np.maximum(a, b)[use], "b": np.minimum(a, b)[use]})

    rows = distinct.select("fp").mapInPandas(route, "shard int, cell int, home boolean, fp long")
    return rows.groupBy("shard", "cell").applyInPandas(shard, "a long, b long")


def _joined(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(node, root) of all links of one task."""
    links_ = [f for f in frames if len(f)]
    if links_:
        ends = pd.concat(links_)[["a", "b"]].to_numpy(np.int64)
        nodes, number = np.unique(ends, return_inverse=True)
        number, forest = number.reshape(-1, 2), Forest(len(nodes))
        forest.link(number[:, 0], number[:, 1])
        yield pd.DataFrame({"node": nodes, "root": nodes[forest.label]})


def connected(links_: DataFrame) -> DataFrame:
    """(node, root) for each node of ``links_(a, b)``: root is the least node reachable. Few links (16 bytes each) are joined in one task, more by large-star and small-star in turn."""
    edges = written(links_.select("a", "b").where("a <> b").distinct(), "links")
    if edges.limit(FEW_LINKS + 1).count() <= FEW_LINKS:
        return edges.coalesce(1).mapInPandas(_joined, "node long, root long")
    state = None
    while True:
        both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # the least neighbours are written, so that both sides of the joins are plain shuffles, whose heavy keys Spark can split
        least = written(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")), "least")
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        low = written(large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")), "links")
        lower = written(low.groupBy("a").agg(F.min("b").alias("m")), "least")
        small = low.join(lower, "a").select(F.explode(F.array(F.struct("b", "m"), F.struct(F.col("a").alias("b"), "m"))).alias("e")).select(F.col("e.b").alias("a"), F.col("e.m").alias("b"))
        last, edges = edges, written(small.where("a <> b").distinct(), "links")
        for old in (last, least, low, lower):
            discard(old)
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == state:
            break
        state = now
    below = edges.groupBy("a").agg(F.min("b").alias("root")).select(F.col("a").alias("node"), "root")
    return below.union(below.select(F.col("root").alias("node"), "root").distinct())


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, seed: int = SEED, radius: int = RADIUS) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id (least doc_id reachable over links) of each row of ``docs``."""
    fp = written(fingerprints(docs, shingle, seed), "fingerprints")
    distinct = written(fp.groupBy("fp").agg(F.min("doc_id").alias("least_id")), "distinct")
    roots = written(connected(fingerprint_links(distinct, radius)), "roots")
    # tables that are written make plain shuffles on both sides of a join, whose heavy keys (a large component, a text with many copies) Spark can split
    linked = written(distinct.join(roots, F.col("fp") == F.col("node")).select("fp", "least_id", "root"), "linked")
    least = written(linked.groupBy("root").agg(F.min("least_id").alias("component_id")), "least")
    of_linked = linked.join(least, "root").select("fp", "component_id")
    single = distinct.join(roots, F.col("fp") == F.col("node"), "left_anti").select("fp", F.col("least_id").alias("component_id"))
    ids = written(single.unionByName(of_linked), "components")
    return fp.join(ids, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def text_key(docs: DataFrame) -> Column:
    """16 bytes that tell texts apart; a null text counts as an empty one."""
    return F.unhex(F.md5(F.coalesce("text", F.lit(""))))


def shingle_set(text: str | None, shingle: int = STAGE_SHINGLE, seed: int = SEED) -> np.ndarray:
    """The distinct shingles' XXH64, sorted; a text with fewer words than a shingle has one, an empty text none."""
    found = (text or "").encode("utf-8", "replace").lower().split()
    if not found:
        return np.zeros(0, np.uint64)
    h = xxhash.xxh64_intdigest
    return np.unique(np.fromiter((h(b" ".join(found[i : i + shingle]), seed) for i in range(max(1, len(found) - shingle + 1))), np.uint64))


def set_fingerprint(found: np.ndarray) -> int:
    """The fingerprint of a shingle set: a bit is set if over half of the hashes have it."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(found), 1 << 16):
        ones += np.unpackbits(found[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(found), bitorder="little").view(np.uint64)[0])


def remixed(found: np.ndarray) -> np.ndarray:
    """Other hashes of the same shingles."""
    x = (found ^ (found >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
    return (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)


def alike(common, n, m):
    """Whether ``common`` shared shingles of ``n`` and ``m`` make a Jaccard similarity of 0.8 or more, in whole numbers."""
    return 5 * common >= 4 * (n + m - common)


def shingle_counts(found: np.ndarray) -> bytes:
    """A byte for each class of shingles: how many the set has, 255 for more."""
    return np.minimum(np.bincount((found & np.uint64(CLASSES - 1)).astype(np.int64), minlength=CLASSES), 255).astype(np.uint8).tobytes()


def hits(f: pd.DataFrame, n_home: int, radius: int, mutual: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(i, j) of each pair within ``radius`` with a home point j, different labels, both fingerprints within ``STAGE_BOTH``, and sizes and counts that allow 0.8.

    Home points come first; they and the others are sorted by size, so that each point meets only sizes within 0.8 of its own.
    """
    fp, second = (f[x].to_numpy(np.int64).view(np.uint64) for x in ("fp", "second"))
    n, label = f["n"].to_numpy(np.int64), f["label"].to_numpy(np.int64)
    counts = np.frombuffer(b"".join(f["counts"]), np.uint8).reshape(-1, CLASSES)
    full = counts.max(axis=1) == 255 if len(f) else np.zeros(0, bool)
    home = n[:n_home]
    for start, stop in ((0, n_home if mutual else 0), (n_home, len(n))):
        for at in range(start, stop, BLOCK):
            end = min(at + BLOCK, stop)
            low, high = np.searchsorted(5 * home, 4 * n[at]), np.searchsorted(4 * home, 5 * n[end - 1], "right")
            high = min(high, end) if start == 0 else high
            near = np.bitwise_count(fp[at:end][:, None] ^ fp[low:high][None, :])
            i, j = np.nonzero(near <= radius)
            both = near[i, j] + np.bitwise_count(second[i + at] ^ second[j + low])
            i, j = i + at, j + low
            use = (both <= STAGE_BOTH) & (label[i] != label[j]) & (5 * np.minimum(n[i], n[j]) >= 4 * np.maximum(n[i], n[j]))
            if start == 0:
                use &= j < i
            i, j = i[use], j[use]
            for k in range(0, len(i), 1 << 13):
                x, y = i[k : k + (1 << 13)], j[k : k + (1 << 13)]
                most = np.minimum(counts[x], counts[y]).sum(axis=1, dtype=np.int64)
                use = alike(most, n[x], n[y]) | full[x] | full[y]
                yield x[use], y[use]


def _first(order: tuple, i: np.ndarray) -> np.ndarray:
    """Places of the first row of each i under ``order``."""
    at = np.lexsort((*order, i))
    return at[np.concatenate(([True], i[at][1:] != i[at][:-1]))] if len(at) else at


def candidates(points: DataFrame, radius: int, few: bool) -> DataFrame:
    """(a, b): the pairs of ``points(sid, fp, second, n, counts, band, label)`` that ``hits`` finds; with ``few`` only the nearest and the busiest partner of each point."""
    bands = max(1, points.select("band").distinct().count())
    tree = upper_tree(points, points.count() // bands, STAGE_SHARD_ROWS)
    full = full_leaves(points, tree, STAGE_SHARD_ROWS, "band")

    def route(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            fp = f["fp"].to_numpy(np.int64).view(np.uint64)
            for up in (0, 1):  # the own band, and the next as a guest
                row, leaf, home = visits(tree, fp, radius, guest=bool(up))
                part = f.iloc[row]
                part = part.assign(band=(part["band"] + up).astype(np.int32))
                yield routed(part, leaf, home, full, list(zip(part["band"].tolist(), leaf.tolist())) if full else [])[["band", "shard", "cell", "home", "sid", "fp", "second", "n", "counts", "label"]]

    def shard(f: pd.DataFrame) -> pd.DataFrame:
        mutual = among(f, full, (int(f["band"].iloc[0]), int(f["shard"].iloc[0])))
        f = f.sort_values(["home", "n", "sid"], ascending=[False, True, True])
        sid, fp, n_home = f["sid"].to_numpy(np.int64), f["fp"].to_numpy(np.int64).view(np.uint64), int(f["home"].sum())
        if few:
            busy = np.zeros(len(sid), np.int64)
            for i, j in hits(f, n_home, radius, mutual):
                busy += np.bincount(i, minlength=len(sid)) + np.bincount(j, minlength=len(sid))
        a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for i, j in hits(f, n_home, radius, mutual):
            if few:
                use = np.unique(np.concatenate((_first((j, -busy[j]), i), _first((j, np.bitwise_count(fp[i] ^ fp[j])), i))))
                i, j = i[use], j[use]
            a.append(sid[i]), b.append(sid[j])
        return pd.DataFrame({"a": np.concatenate(a), "b": np.concatenate(b)})

    rows = points.select("band", "sid", "fp", "second", "n", "counts", "label").mapInPandas(route, "band int, shard int, cell int, home boolean, sid long, fp long, second long, n int, counts binary, label long")
    return written(rows.groupBy("band", "shard", "cell").applyInPandas(shard, "a long, b long"), "candidates")


def confirmed(docs: DataFrame, points: DataFrame, pairs: DataFrame) -> DataFrame:
    """Those of ``pairs(a, b)`` whose shingle sets, read from the texts again, have a Jaccard similarity of 0.8 or more."""
    ends = pairs.select(F.explode(F.array("a", "b")).alias("sid")).distinct().join(points.select("sid", "key"), "sid")
    ends = written(ends, "ends")
    side = F.broadcast(ends) if ends.count() <= BROADCAST_IDS else ends

    def sets(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            f = f.drop_duplicates("sid")
            yield pd.DataFrame({"sid": f["sid"], "found": [shingle_set(t).tobytes() for t in f["text"]]})

    texts = docs.select(text_key(docs).alias("key"), "text").join(side, "key").select("sid", "text")
    found = written(texts.mapInPandas(sets, "sid long, found binary").dropDuplicates(["sid"]), "sets")

    def judge(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            use = []
            for x, y in zip(f["x"], f["y"]):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                use.append(bool(alike(len(np.intersect1d(x, y, assume_unique=True)), len(x), len(y))))
            yield f.loc[use, ["a", "b"]]

    both = pairs.join(found.select(F.col("sid").alias("a"), F.col("found").alias("x")), "a").join(found.select(F.col("sid").alias("b"), F.col("found").alias("y")), "b")
    return written(both.mapInPandas(judge, "a long, b long"), "confirmed")


def members(docs: DataFrame, radius: int = STAGE_RADIUS) -> DataFrame:
    """(doc_id, key, root) of each row of ``docs``: its text's key and its component over pairs of Jaccard similarity 0.8 or more.

    A first round confirms two partners of each text, which joins large groups by few links; a second confirms every pair
    between the components that it leaves, so no pair within ``radius`` is left out.
    """

    def compute(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out, counts = [], []
            for text in f["text"]:
                s = shingle_set(text)
                out.append((xxhash.xxh64_intdigest(s.tobytes()), set_fingerprint(s), set_fingerprint(remixed(s)), len(s)))
                counts.append(shingle_counts(s))
            sid, fp, second, n = (np.array(x, np.uint64) for x in zip(*out)) if out else (np.zeros(0, np.uint64),) * 4
            band = np.floor(np.log(np.maximum(n, 1)) / np.log(BAND)).astype(np.int32)
            yield pd.DataFrame({"doc_id": f["doc_id"], "key": f["key"], "sid": sid.view(np.int64), "fp": fp.view(np.int64), "second": second.view(np.int64), "n": n.astype(np.int32), "counts": counts, "band": band})

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key(docs).alias("key"), "text")
    marks = written(own.mapInPandas(compute, "doc_id long, key binary, sid long, fp long, second long, n int, counts binary, band int"), "sketches")
    # equal shingle sets have one number and differ in nothing else here but the text's key
    points = written(marks.groupBy("sid").agg(F.min(F.struct("key", "fp", "second", "n", "counts", "band")).alias("p")).select("sid", "p.*"), "points")
    sure = confirmed(docs, points, candidates(points.withColumn("label", F.col("sid")), radius, True))
    roots = written(connected(sure), "roots")
    labelled = points.join(roots, F.col("sid") == F.col("node"), "left").withColumn("label", F.coalesce("root", "sid")).drop("node", "root")
    rest = confirmed(docs, points, candidates(labelled, radius, False))
    roots = written(connected(sure.union(rest)), "roots")
    return marks.select("doc_id", "key", "sid").join(roots, F.col("sid") == F.col("node"), "left").select("doc_id", "key", F.coalesce("root", "sid").alias("root"))


def survivors(docs: DataFrame, found: DataFrame) -> DataFrame:
    """One row of ``docs`` for each root of ``found(doc_id, key, root)``: the least doc_id, nulls last, then the least text key.

    A text has one root, so (doc_id, key) names one component; only rows that are equal in both need a last choice between them.
    """
    kept_id, kept_key, key = (unused(docs, x) for x in ("kept_id", "kept_key", "key"))
    rows = found.groupBy("root", "doc_id", "key").agg(F.count(F.lit(1)).alias("rows"))
    best = rows.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key", "rows")).alias("b"))
    kept = written(best.select(F.col("b.doc_id").alias(kept_id), F.col("b.key").alias(kept_key), F.col("b.rows").alias("rows")), "kept")
    n, most = kept.agg(F.count(F.lit(1)), F.max("rows")).first()
    own = docs.withColumn(key, text_key(docs))

    def chosen(side: DataFrame) -> DataFrame:
        side = side.select(kept_id, kept_key)
        return own.join(F.broadcast(side) if n <= BROADCAST_IDS else side, (F.col(key) == F.col(kept_key)) & F.col("doc_id").cast("long").eqNullSafe(F.col(kept_id)), "left_semi")

    one = chosen(kept.where("rows = 1"))
    if n and most > 1:
        one = one.unionByName(chosen(kept.where("rows > 1")).dropDuplicates(["doc_id", key]))
    return one.select(*[F.col(f"`{c}`") for c in docs.columns])


def one_of_each_group(docs: DataFrame, **options) -> DataFrame:
    """One document of each component, with its own columns: that of the least doc_id; one without a doc_id only if the component has none at all."""
    return survivors(docs, members(docs, **options))
