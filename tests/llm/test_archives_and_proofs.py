"""Manifest, archives and clustering against brute force: nulls, ties, repeated rows, clashing columns, empty tables, hot groups."""

import hashlib
import math
import os
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from pagemill.llm import clustering, manifest, simhash, warc

DOCS = "doc_id long, text string, lang string, source string, n_chars long, leaf string, root string, path string, g string, idx long"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


# Manifest


def leaf_of(r, more=0):
    values = [r[0], r[3], r[2], None if r[4] is None else r[4] + more, r[1]]
    return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in values])


def tree(leaves):
    """Root, and the path of each leaf as (side, digest) or None."""
    paths, place, level = [[] for _ in leaves], list(range(len(leaves))), leaves
    while len(level) > 1:
        for i, at in enumerate(place):
            other = at ^ 1
            paths[i].append(("L" if at & 1 else "R", level[other]) if other < len(level) else None)
            place[i] = at >> 1
        level = [h(*level[i : i + 2]) for i in range(0, len(level), 2)]
    return level[0], paths


def manifest_by_hand(rows):
    groups = defaultdict(list)
    for r in rows:
        groups[r[2]].append((r[0] is not None, r[0] or 0, leaf_of(r), r))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    subroots, inner = [], {}
    for g in names:
        groups[g].sort(key=lambda x: x[:3])
        root, paths = tree([x[2] for x in groups[g]])
        subroots.append(root)
        inner[g] = paths
    root, outer = tree(subroots)
    out = []
    for g, sub, up in zip(names, subroots, outer):
        for (_, _, leaf, r), path in zip(groups[g], inner[g]):
            changed = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0
            node = leaf_of(r, 1 if changed else 0)
            for step in path + up:
                node = h(node) if step is None else h(step[1], node) if step[0] == "L" else h(node, step[1])
            out.append((r[0], leaf, sub, root, h(*[s[1] for s in path + up if s]), node, node == root))
    return Counter(out)


def random_rows(n, seed):
    rng = random.Random(seed)
    # one group holds most rows; ids repeat and are missing
    return [
        (rng.choice([None, *range(2 * n)]), rng.choice([None, "", "é text", f"t{i}"]), rng.choice(["en", "en", "en", "de", None, "", "fr", "zü"]), rng.choice([None, "s"]), rng.choice([None, 5, i]), "x", "x", "x", "x", 1)
        for i in range(n)
    ]


@pytest.mark.parametrize("n, height", [(1, 9), (2, 9), (7, 2), (150, 3), (700, 9)])
def test_manifest(spark, n, height):
    rows = random_rows(n, n)
    rows += rows[: n // 3]
    got = manifest.verification_report(spark.createDataFrame(rows, DOCS).repartition(3), height)
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert Counter(tuple(r) for r in got.collect()) == manifest_by_hand(rows)


def test_manifest_of_nothing(spark):
    assert manifest.verification_report(spark.createDataFrame([], DOCS)).collect() == []


def test_manifest_names_its_own_fields(spark):
    rows = spark.createDataFrame([("b", "k1", 1), ("a", "k2", 2)], "part string, key string, x int")
    got = {r["key"]: r for r in manifest.manifest(rows, fields=("key", "x"), group="part", key="key").collect()}
    a, b = h("2:k2", "1:2"), h("2:k1", "1:1")
    assert got["k1"]["leaf"] == b and got["k1"]["path"] == ["L" + a] and got["k2"]["root"] == h(a, b)


@pytest.mark.parametrize("height, step", [(1, 3), (4, 2), (7, 3), (6, 6)])
def test_traversal_holds_few_nodes(height, step):
    leaves = [h(str(i)) for i in range(max(2, (1 << height) - 1))]
    root, paths = tree(leaves)
    want = [["-" if s is None else s[0] + s[1] for s in p] for p in paths]
    assert list(manifest.traversed(leaves, height, step)) == want and manifest.block_root(leaves, height) == root
    grown = manifest.Growing(leaves, 0, min(step, height), 0).whole()
    assert len(grown.kept) <= 2 << step and not grown.pending


# Archives

PAGES = "page_id long, url string, html string, digest string, first string, n long, key string"


def pages_by_hand(rows):
    first = {}
    for r in rows:
        payload = (r[2] or "").encode()
        if len(payload) >= 100:
            order = (r[0] is None, r[0] or 0)
            first[payload] = min(first.get(payload, order), order)
    out, taken = Counter(), Counter()
    for r in rows:
        payload = (r[2] or "").encode()
        order = (r[0] is None, r[0] or 0)
        kind, to = "response", None
        if len(payload) >= 100:
            if first[payload] != order or taken[payload]:
                kind, to = "revisit", None if first[payload][0] else first[payload][1]
            else:
                taken[payload] += 1
        out[(r[0], len(payload), hashlib.sha256(payload).hexdigest(), kind, to)] += 1
    return out


def page_rows():
    rng = random.Random(3)
    x = ["d", "f", 1, "k"]
    odd = ["", None, "short", "é" * 49, "é" * 50, "a" * 99, "a" * 100, "WARC/1.1\r\nContent-Length: 5\r\n\r\n" * 9, "line\r\n\r\n" * 40, "\r\n" * 200, "end" * 40 + "\r\n", "x" * 3_000_000, "\x00\x01" * 80, "😀" * 60 + "\r\n\r\n"]
    rows = [(i, f"https://e.org/{i}", p, *x) for i, p in enumerate(odd * 3)]
    rows += [(1000 + i, f"https://h.org/{i}\r\nX: y", "hot page " * 30, *x) for i in range(300)]  # one digest holds most rows
    rows += [(2000 - i, None, f"unique {i} " * 20, *x) for i in range(40)]
    rows += [(None, "u", "nobody's page " * 20, *x)] * 3 + [(None, None, "null ids and a number " * 20, *x), (7, None, "null ids and a number " * 20, *x)]
    rows += [(3000, "same", "three equal rows " * 20, *x)] * 3 + [(3000, "other", "three equal rows " * 20, *x), (3001, "same", "three equal rows " * 20, *x)]
    rng.shuffle(rows)
    return rows


def test_archives_read_back(spark):
    rows = page_rows()
    got = warc.revisit_report(spark.createDataFrame(rows, PAGES).repartition(5))
    assert got.columns == ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    assert Counter(tuple(r) for r in got.collect()) == pages_by_hand(rows)


def test_archives_are_archives(spark, tmp_path):
    rows = [(2, "https://e.org/2", "p" * 200, *["d", "f", 1, "k"]), (1, "https://e.org/1", "p" * 200, *["d", "f", 1, "k"]), (3, None, "q", *["d", "f", 1, "k"])]
    folder = str(tmp_path / "warc")
    warc.write_archives(spark.createDataFrame(rows, PAGES), F.col("html"), folder)
    import gzip

    whole = b"".join(gzip.open(f"{folder}/{f}").read() for f in sorted(os.listdir(folder)) if f.endswith(".gz"))
    assert whole.count(b"WARC/1.1\r\n") == 3 and whole.count(b"p" * 200) == 1 and whole.endswith(b"\r\n\r\n")
    found = {r["page_id"]: r for r in warc.read_archives(spark, folder).collect()}
    assert len({r["record_id"] for r in found.values()}) == 3 and found[2]["refers"] == found[1]["record_id"]
    assert (found[1]["type"], found[2]["type"], found[2]["payload_bytes"], found[3]["uri"]) == ("response", "revisit", None, None)
    assert all(r["declared"] == hashlib.sha256(("q" if i == 3 else "p" * 200).encode()).hexdigest() for i, r in found.items())


def test_archives_of_nothing(spark):
    assert warc.revisit_report(spark.createDataFrame([], PAGES)).collect() == []


def test_a_cut_archive_is_an_error():
    import pyarrow as pa

    with pytest.raises(ValueError):
        list(warc._read(iter([pa.RecordBatch.from_arrays([pa.array([b"WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 100"])], ["piece"])])))


# Clustering

VECTORS = "vec_id long, embedding array<float>, cluster int, inertia long, id long, x long"


def clusters_by_hand(rows, k=8, rounds=10):
    kept = [(r[0], [math.floor(1024 * float(np.float32(x))) for x in r[1]]) for r in rows if r[1] is not None and len(r[1]) == 64 and all(x is not None and math.isfinite(x) for x in r[1])]
    centroids = [v for _, _, v in sorted((h(f"3:{'' if i is None else i}"), v, v) for i, v in kept)[:k]]
    distance = lambda v, c: sum((a - b) ** 2 for a, b in zip(v, c))

    def assign():
        return [min((distance(v, c), n) for n, c in enumerate(centroids)) for _, v in kept]

    for _ in range(rounds):
        members = defaultdict(list)
        for (_, v), (_, n) in zip(kept, assign()):
            members[n].append(v)
        centroids = [[sum(x) // len(members[n]) for x in zip(*members[n])] if members[n] else c for n, c in enumerate(centroids)]
    final = assign()
    total, of = sum(d for d, _ in final), Counter()
    for d, n in final:
        of[n] += d
    return Counter((i, n, d, of[n], total, h(",".join(map(str, centroids[n])))) for (i, _), (d, n) in zip(kept, final))


def vector_rows(n, seed, spread):
    rng = np.random.default_rng(seed)
    middle = rng.normal(size=(12, 64)) * spread
    rows = [(i, [float(x) for x in (middle[i % 12] + rng.normal(size=64)).astype(np.float32)], 1, 1, 1, 1) for i in range(n)]
    bad = [None, [], [1.0] * 63, [1.0] * 63 + [None], [1.0] * 63 + [float("nan")], [1.0] * 63 + [float("inf")]]
    return rows + [(n + i, v, 1, 1, 1, 1) for i, v in enumerate(bad)]


@pytest.mark.parametrize("case", ["spread", "tight", "grid", "few", "equal", "repeated"])
def test_clusters(spark, case):
    rows = {"spread": lambda: vector_rows(300, 1, 3), "tight": lambda: vector_rows(200, 2, 0), "few": lambda: vector_rows(5, 3, 1), "equal": lambda: [(i, [0.5] * 64, 1, 1, 1, 1) for i in range(30)],
            "grid": lambda: [(i, [float((i >> j) & 1) for j in range(8)] * 8, 1, 1, 1, 1) for i in range(256)], "repeated": lambda: vector_rows(60, 4, 2) * 3 + [(None, [0.25] * 64, 1, 1, 1, 1)] * 2}[case]()
    got = clustering.cluster_report(spark.createDataFrame(rows, VECTORS).repartition(3))
    assert got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert Counter(tuple(r) for r in got.collect()) == clusters_by_hand(rows)


def test_clusters_of_nothing(spark):
    assert clustering.cluster_report(spark.createDataFrame([], VECTORS)).collect() == []


def test_far_components_are_cut(spark):
    rows = [(1, [3e38] * 64, 1, 1, 1, 1), (2, [-3e38] * 64, 1, 1, 1, 1)] * 5
    got = clustering.cluster_report(spark.createDataFrame(rows, VECTORS)).collect()
    assert len(got) == 10 and {r["distance"] for r in got} == {0}


def test_bounds_save_distances():
    rng = np.random.default_rng(0)
    centroids = rng.integers(-5000, 5000, (8, 64))
    x = (centroids[rng.integers(0, 8, 2000)] + rng.integers(-200, 200, (2000, 64))).astype(np.int32)
    search = clustering.Exponion(centroids)
    a, upper, lower, first = search.assigned(x, np.zeros(2000, np.int32), np.full(2000, np.inf), np.zeros(2000))
    again = search.assigned(x, a, upper, lower)
    want = np.array([clustering.exact(x, c) for c in centroids]).T
    assert (a == want.argmin(1)).all() and (again[0] == a).all() and again[3] == 0
    assert (np.sqrt(want.min(1)) <= upper).all() and (np.sqrt(np.sort(want, 1)[:, 1]) >= lower).all()


# Near duplicates with the components of many links


def prose(rng, n):
    return " ".join(rng.choice("the of and to in is was for on with as by at from his that it".split()) + str(rng.randint(0, 99)) for _ in range(n))


@pytest.mark.parametrize("few", [0, 200_000])
def test_components_do_not_depend_on_the_number_of_links(spark, monkeypatch, few):
    """Copies with some words changed, least ids anywhere in the component: both ways to join links give the brute-force components."""
    monkeypatch.setattr(simhash, "FEW_LINKS", few)
    rng = random.Random(11)
    texts = []
    for _ in range(12):
        words = prose(rng, 300).split()
        for _ in range(rng.randint(1, 9)):
            words = list(words)
            words[rng.randrange(300)] = f"new{rng.randint(0, 9)}"
            texts.append(" ".join(words))
    ids = list(range(len(texts)))
    rng.shuffle(ids)
    docs = spark.createDataFrame(list(zip(ids, texts)), "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in simhash.near_duplicates(docs).collect()}
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in ids:
        for j in ids:
            if i < j and bin(int(got[i][0], 16) ^ int(got[j][0], 16)).count("1") <= 4:
                root[max(find(i), find(j))] = min(find(i), find(j))
    assert {i: v[1] for i, v in got.items()} == {i: find(i) for i in ids} and len({find(i) for i in ids}) < len(ids)
