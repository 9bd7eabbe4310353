"""References between objects and sections put in place, against brute force and by hand."""

import random

from pyspark.sql import functions as F

from pagemill.operators import chains, sections, state


def test_references_against_brute_force(spark):
    rng = random.Random(7)
    rows = []
    for page in (1, 2, 3, None):
        for k in range(40):
            kind = rng.random()
            ref = None if kind < 0.3 else str(rng.randint(0, 44))
            rows.append((page, str(k), f"v{page}-{k}", ref))
    rows += [(9, str(k), f"w{k}", str(k + 1) if k < 300 else None) for k in range(301)]  # one long chain
    rows += [(1, None, "no key", None), (1, "0", "zz", "1")]  # the least value of a key counts
    values = spark.createDataFrame(rows, "page_id long, id string, value string, ref string").repartition(3)
    known = {}
    for page, k, v, ref in rows:
        if k is not None and ((page, k) not in known or v < known[page, k][0]):
            known[page, k] = (v, ref)
    want = {}
    for page, k in known:
        seen, at, hops = {k}, k, 0
        while True:
            v, ref = known[page, at]
            if ref is None:
                want[page, k] = (v, hops, None)
                break
            if (page, ref) not in known:
                want[page, k] = (None, None, "missing")
                break
            if ref in seen:
                want[page, k] = (None, None, "cycle")
                break
            seen.add(ref)
            at, hops = ref, hops + 1
    got = {(r["page_id"], r["id"]): (r["value"], r["hops"], r["error"]) for r in chains.resolved_references(values).collect()}
    assert got == want and {e for _, _, e in want.values()} == {None, "missing", "cycle"}
    assert chains.resolved_references(values.limit(0)).collect() == []


def test_objects_of_payloads(spark):
    text = '1:"$2"\n2:{"a":1}\nnot an object\na:"$L1"\nb:"$x y"\n'
    got = {r["id"]: (r["value"], r["ref"]) for r in chains.payload_objects(spark.createDataFrame([(1, text), (2, None)], "page_id long, payload string")).collect()}
    assert got == {"1": ('"$2"', "2"), "2": ('{"a":1}', None), "a": ('"$L1"', "1"), "b": ('"$x y"', None)}


def test_sections_of_texts_are_the_text(spark):
    text = "before\n# A\na\n```\n# no\n```\n## B \nb\n#tag\n# A\nagain"
    rows = sorted((r["n"], r["heading"], r["level"], r["body"]) for r in sections.section_rows(spark.createDataFrame([(1, text)], "k long, t string"), "k", "t").fillna("", ["heading"]).fillna(0, ["level"]).collect())
    assert "".join(r[3] for r in rows) == text and [(r[1], r[2]) for r in rows] == [("", 0), ("a", 1), ("b", 2), ("a", 1)]


def test_sections_are_put_in_place(spark):
    base = "intro\n# A\na\n## A1\na1\n### A11\nx\n## A2\na2\n# B\nb\n## C\nc\n"
    cases = [
        ("A1", "new", "intro\n# A\na\n## A1\n\nnew\n\n## A2\na2\n# B\nb\n## C\nc\n"), ("a", "new", "intro\n# a\n\nnew\n\n# B\nb\n## C\nc\n"), ("c!", "z", "intro\n# A\na\n## A1\na1\n### A11\nx\n## A2\na2\n# B\nb\n## c!\n\nz\n\n"),
        ("D", "d", base + "\n\n## D\n\nd"), ("B", "b2", "intro\n# A\na\n## A1\na1\n### A11\nx\n## A2\na2\n# B\n\nb2\n\n"),
    ]
    texts = spark.createDataFrame([(i, base) for i in range(len(cases) + 1)] + [(50, None), (51, "")], "k long, t string").repartition(2)
    new = spark.createDataFrame([(i, t, c) for i, (t, c, _) in enumerate(cases)] + [(50, "N", "n")], "k long, title string, content string")
    got = {r["k"]: r["t"] for r in sections.upserted(texts, new, "k", "t").collect()}
    assert [got[i] for i in range(len(cases))] == [c[2] for c in cases] and got[len(cases)] == base
    assert got[50].strip() == "## N\n\nn" and got[51] == ""


def test_progress_keeps_the_users_columns(spark):
    rows = spark.createDataFrame([(1, 1, 5, "a"), (1, 2, 4, "b"), (1, 3, 6, "c")], "k int, n int, v int, _before string")
    assert sorted((r["n"], r["_before"]) for r in state.progress(rows, "k", ["n"], "v").collect()) == [(1, "a"), (3, "c")]
    changes = state.status_changes(rows.withColumn("s", F.col("v") > 4), "k", ["n"], "s").collect()
    assert [(r["n"], r["_before"], r["previous"]) for r in changes] == [(1, "a", None), (2, "b", True), (3, "c", False)]
