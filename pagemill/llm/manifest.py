"""Merkle manifest of a dataset, with a proof for each row, by fractal traversal.

A leaf is the digest of a row's fields; leaves of a group ascend by key, every two consecutive nodes become the digest of
their digests, and a last node without a partner becomes the digest of its own. The groups' roots, in order of their names, make one tree more.

Places are global numbers: rows are range-partitioned by (group, key, leaf), numbered in their partitions, and the counts of earlier
partitions are added. A tree is climbed in aligned blocks of ``2 ** BLOCK_HEIGHT`` nodes: one row for each block goes up, until one
node is left of each group. On the way down each block is traversed: for every ``STEP`` levels the subtree over the present leaf is kept,
and the next one to its right grows by one leaf a step, so a path is read off at any time and no more than twice
``BLOCK_HEIGHT / STEP`` small subtrees are held. The path of the block itself, one row, is appended to those of its leaves.

What moves: two digests and a few numbers a row, twice; no text. No group, however large, is held by one task.

Defined results: rows with equal keys are ordered by their leaves, so equal rows have equal leaves and neighbouring places; a null group or field
is told from every value; an empty table gives an empty manifest; other columns are not read, but for those named in ``keep``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from pagemill.llm.common import written

BLOCK_HEIGHT = 9
STEP = 3
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(values: list[Column]) -> Column:
    """The digest of a row's fields, each as its UTF-8 byte count, a colon and its value; ``-`` stands for null."""
    texts = [v.cast("string") for v in values]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]), 256)


# A path is a list of steps from a node upwards: "L" or "R" and the digest of the partner on that side, or "-" where there is none.


def above(node: str | None, partner: str | None) -> str | None:
    """The parent of two neighbours; without a right one that of the left one alone, without either none."""
    return None if node is None else digest(node, partner or "")


class Growing:
    """A subtree of ``step`` levels over the ``number``-th run of ``2 ** (floor + step)`` leaves, built leaf by leaf; nodes below its floor are dropped as soon as they are joined."""

    def __init__(self, leaves: list[str], floor: int, step: int, number: int):
        self.leaves, self.floor, self.top = leaves, floor, floor + step
        self.next, self.end = number << self.top, (number + 1) << self.top
        self.pending: list[tuple[int, str | None]] = []
        self.kept: dict[tuple[int, int], str | None] = {}

    def grow(self) -> None:
        if self.next >= self.end:
            return
        level, node = 0, self.leaves[self.next] if self.next < len(self.leaves) else None
        at = self.next
        self.next += 1
        while True:
            if level >= self.floor:
                self.kept[level, at >> level] = node
            if level == self.top or not (self.pending and self.pending[-1][0] == level):
                break
            left = self.pending.pop()[1]
            node, level = above(left, node), level + 1
        if level < self.top:
            self.pending.append((level, node))

    def whole(self) -> "Growing":
        while self.next < self.end:
            self.grow()
        return self


def traversed(leaves: list[str], height: int, step: int = STEP) -> Iterator[list[str]]:
    """The path of each leaf in turn, up to the node ``height`` levels above; ``leaves`` are at most ``2 ** height``."""
    floors = [(f, min(step, height - f)) for f in range(0, height, step)]
    here = [Growing(leaves, f, s, 0).whole() for f, s in floors]
    coming = [Growing(leaves, f, s, 1) for f, s in floors]
    for i in range(len(leaves)):
        path = []
        for tree in here:
            for level in range(tree.floor, tree.top):
                at = i >> level
                partner = tree.kept.get((level, at ^ 1))
                path.append("-" if partner is None else ("L" if at & 1 else "R") + partner)
        yield path
        for n, (floor, s) in enumerate(floors):
            coming[n].grow()
            if (i + 1) % (1 << (floor + s)) == 0:
                here[n] = coming[n]
                coming[n] = Growing(leaves, floor, s, ((i + 1) >> (floor + s)) + 1)


def block_root(leaves: list[str], height: int) -> str:
    """The node ``height`` levels above a block of leaves."""
    for _ in range(height):
        leaves = [digest(*leaves[i : i + 2]) for i in range(0, len(leaves), 2)]
    return leaves[0]


def height_of(n: int) -> int:
    """Levels of a tree over ``n`` leaves."""
    return (n - 1).bit_length()


def placed(rows: DataFrame, group: str, order: list[str]) -> DataFrame:
    """``rows`` with ``idx``, each row's number in its group by ``order``, and ``n``, the group's rows; no group is gathered."""
    ranged = rows.repartitionByRange(group, *order).sortWithinPartitions(group, *order)
    numbered = written(ranged.withColumn("_at", F.monotonically_increasing_id()), "manifest-ranged")
    part = F.shiftright(F.col("_at"), 33).alias("_part")
    counts = numbered.groupBy(group, part).agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(group).orderBy("_part").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    starts = counts.select(F.col(group), F.col("_part"), (F.sum("_n").over(before) - F.col("_n") - F.col("_first")).alias("_shift"), F.sum("_n").over(Window.partitionBy(group)).alias("n"))
    return numbered.withColumn("_part", part).join(starts, [group, "_part"]).select(*rows.columns, (F.col("_at") + F.col("_shift")).alias("idx"), "n")


def _roots(block_height: int):
    def run(block: pa.Table) -> pa.Table:
        n = block["n"][0].as_py()
        found = block_root(block.sort_by("idx")["h"].to_pylist(), min(block_height, height_of(n)))
        return pa.table({"g": block["g"][:1], "idx": block["block"][:1], "n": pa.array([-(-n >> block_height)], pa.int64()), "h": [found]})

    return run


def _paths(block_height: int):
    def run(block: pa.Table, upper: pa.Table) -> pa.Table:
        block = block.sort_by("idx")
        height = min(block_height, height_of(block["n"][0].as_py()))
        rest = upper["path"][0].as_py() if len(upper) else []
        paths = [path + rest for path in traversed(block["h"].to_pylist(), height)] if height else [rest] * len(block)
        return block.drop_columns(["block"]).append_column("path", pa.array(paths, pa.list_(pa.string())))

    return run


def climbed(nodes: DataFrame, block_height: int = BLOCK_HEIGHT) -> tuple[DataFrame, DataFrame]:
    """(g, root) of each group, and ``nodes(g, idx, n, h, ...)`` with ``path``, from each node to its group's root."""
    blocks = lambda level: level.withColumn("block", F.shiftright("idx", block_height)).groupBy("g", "block")
    levels, most = [nodes], nodes.agg(F.max("n")).first()[0] or 0
    while most > 1:
        levels.append(written(blocks(levels[-1]).applyInArrow(_roots(block_height), "g string, idx long, n long, h string"), "manifest-roots"))
        most = -(-most >> block_height)
    roots = levels[-1].select("g", F.col("h").alias("root"))
    found = levels[-1].withColumn("path", F.array().cast("array<string>"))
    for level in reversed(levels[:-1]):
        upper = found.select("g", F.col("idx").alias("block"), "path")
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in level.schema) + ", path array<string>"
        found = blocks(level).cogroup(upper.groupBy("g", "block")).applyInArrow(_paths(block_height), schema)
    return roots, found


def folded(node: Column, path: Column) -> Column:
    """The root that a leaf and a path lead to."""

    def step(acc: Column, s: Column) -> Column:
        partner = F.substring(s, 2, 64)
        return F.sha2(F.when(s.startswith("L"), F.concat(partner, acc)).when(s.startswith("R"), F.concat(acc, partner)).otherwise(acc), 256)

    return F.aggregate(path, node, step)


def proof(path: Column) -> Column:
    """The digests of a path, without sides and empty steps."""
    return F.transform(F.filter(path, lambda s: s != "-"), lambda s: F.substring(s, 2, 64))


def manifest(rows: DataFrame, fields: tuple[str, ...] = FIELDS, group: str = "lang", key: str = "doc_id", keep: dict[str, Column] | None = None, block_height: int = BLOCK_HEIGHT) -> DataFrame:
    """key, leaf, subroot, root, path (from the leaf over its group's root to the root) and the columns of ``keep`` for each row."""
    keep = keep or {}
    name = F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit("-"))  # null before all others
    leaves = rows.select(name.alias("g"), F.col(key).alias("k"), leaf([F.col(f) for f in fields]).alias("h"), *[c.alias(f"keep_{n}") for n, c in keep.items()])
    nodes = written(placed(leaves, "g", ["k", "h"]), "manifest-nodes")
    subroots, paths = climbed(nodes, block_height)
    top = placed(subroots.select(F.lit("all").alias("all"), F.col("g").alias("name"), F.col("root").alias("h")), "all", ["name"])
    root, upper = climbed(written(top.select(F.col("all").alias("g"), "idx", "n", "h", "name"), "manifest-groups"), block_height)
    groups = written(upper.join(root, "g").select(F.col("name").alias("g"), F.col("h").alias("subroot"), "root", F.col("path").alias("upper")), "manifest-upper")
    return paths.join(groups, "g").select(
        F.col("k").alias(key), F.col("h").alias("leaf"), "subroot", "root", F.concat("path", "upper").alias("path"), *[F.col(f"keep_{n}").alias(n) for n in keep]
    )


def verification_report(docs: DataFrame, block_height: int = BLOCK_HEIGHT) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root and verified of each document, where documents whose id's CRC-32 is a multiple of seven were tampered with.

    A document without an id is not tampered with; one without a number of characters stays as it is.
    """
    tampered = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0, F.lit(False))
    other = leaf([F.when(tampered, F.col(f) + 1).otherwise(F.col(f)) if f == "n_chars" else F.col(f) for f in FIELDS])
    found = manifest(docs, keep={"other": F.when(tampered, other)}, block_height=block_height)
    read = found.select("doc_id", "leaf", "subroot", "root", F.sha2(F.array_join(proof(F.col("path")), ""), 256).alias("proof_sha256"), folded(F.coalesce("other", "leaf"), F.col("path")).alias("folded_root"))
    return read.withColumn("verified", F.col("folded_root") == F.col("root"))
