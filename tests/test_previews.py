"""Redundant previews of figures against a brute-force version over the standard library's parser."""

import html.parser
import random
import re

from pagemill.operators import content as C, elements as E, previews as V
from pagemill.plans.page_queries import content_rows


class Nodes(html.parser.HTMLParser):
    """A plain tree of well-formed markup: [name, attributes, children or texts, place of the start tag]."""

    def __init__(self, text):
        super().__init__(convert_charrefs=True)
        self.top = ["top", {}, [], -1]
        self.open, self.n = [self.top], 0
        self.feed(text)
        self.close()

    def handle_starttag(self, tag, attrs):
        node = [tag, dict(attrs), [], self.n]
        self.n += 1
        self.open[-1][2].append(node)
        if tag not in E.VOID:
            self.open.append(node)

    def handle_endtag(self, tag):
        self.open.pop()

    def handle_data(self, data):
        self.open[-1][2].append(data)


def inside(node):
    """Elements under a node, those of inner figures left out."""
    for child in node[2]:
        if isinstance(child, list) and child[0] != "figure":
            yield child
            yield from inside(child)


def text(node):
    whole = "".join(c if isinstance(c, str) else text(c) for c in node[2] if isinstance(c, str) or c[0] != "figure")
    return re.sub(r"\s+", " ", whole).strip() if node[0] == "*" else whole


def tidy(node):
    return re.sub(r"\s+", " ", text(node)).strip()


def expected(markup):
    """Texts of the panes that go, by figure."""
    tree, gone = Nodes(markup), []

    def figures(node):
        for child in node[2]:
            if isinstance(child, list):
                if child[0] == "figure":
                    yield child
                yield from figures(child)

    for figure in figures(tree.top):
        panes = [c for c in figure[2] if isinstance(c, list) and c[0] != "figure"]
        code = next((p for p in panes if p[0] == "pre" or any(x[0] == "pre" for x in inside(p))), None)
        if code is None or not tidy(code):
            continue
        for p in panes:
            under = list(inside(p))
            if p is code or p[0] == "figcaption" or any(x[0] in V.MORE_THAN_PREVIEW or (x[0] == "a" and "href" in x[1]) for x in under):
                continue
            leaves = {tidy(x) for x in under if x[0] in V.SEGMENTS and not any(isinstance(c, list) for c in x[2])}
            parts = {x for x in leaves if 0 < len(x) <= 60} or ({tidy(p)} if tidy(p) else set())
            if not 1 <= len(parts) <= 12 or any(len(x) > 60 for x in parts):
                continue
            found = [x for x in parts if x in tidy(code)]
            special = any(x[0] in ("svg", "canvas") for x in under) or any(re.fullmatch(V.HOST_FORM.strip("^$").replace("(?i)^", "(?i)"), x) for x in parts)
            if len(found) == len(parts) or (found and special):
                gone.append((p[0], tidy(p)))
    return sorted(gone)


WORDS = ["alpha", "beta  two", "gamma", "x < y".replace("<", "&lt;"), "docs.example.org", "w" * 61, " ", ""]


def pane(rng, depth=0):
    kind = rng.random()
    if kind < 0.55 or depth > 3:
        return f"<{(t := rng.choice(['p', 'span', 'div', 'b']))}>{rng.choice(WORDS)}</{t}>"
    if kind < 0.65:
        return rng.choice(["<svg></svg>", "<br>", "<a>alpha</a>", "<a href='/x'>alpha</a>", "<button>go</button>", "<input>", "beta two", "<!-- c -->", "<canvas></canvas>"])
    if kind < 0.72:
        return figure(rng, depth + 1)
    tag = rng.choice(["div", "section", "div"])
    return f"<{tag}>{''.join(pane(rng, depth + 1) for _ in range(rng.randint(0, 3)))}</{tag}>"


def figure(rng, depth=0):
    code = f"<div><pre>{rng.choice(['alpha beta two', 'gamma  alpha', 'x &lt; y docs.example.org alpha', ''])}</pre></div>"
    parts = [f"<{(t := rng.choice(['div', 'section', 'figcaption']))}>{''.join(pane(rng, depth + 1) for _ in range(rng.randint(0, 3)))}</{t}>" for _ in range(rng.randint(0, 4))]
    parts.insert(rng.randint(0, len(parts)), code if rng.random() < 0.85 else "<p>alpha</p>")
    return f"<figure>{''.join(parts)}</figure>"


def test_equals_brute_force(spark):
    rng = random.Random(11)
    pages = {n: "".join(f"<div>{figure(rng)}</div><p>alpha</p>" for _ in range(rng.randint(1, 4))) for n in range(400)}
    table = spark.createDataFrame(list(pages.items()), "page_id long, html string").repartition(4)
    rows = E.element_rows(table, "page_id")
    starts = rows.where("kind = 'start'").select("page_id", "pos", "name")
    found = V.redundant(rows, "page_id").withColumnRenamed("pane", "pos").join(starts, ["page_id", "pos"]).select("page_id", "name", "pos")
    texts = V.panes(rows, "page_id").select("page_id", "pane", "text").withColumnRenamed("pane", "pos")
    got = {n: [] for n in pages}
    for r in found.join(texts, ["page_id", "pos"]).collect():
        got[r["page_id"]].append((r["name"], r["text"]))
    want = {n: expected(p) for n, p in pages.items()}
    assert {n: sorted(v) for n, v in got.items()} == want
    assert sum(map(len, want.values())) > 100


def test_rows_without_previews(spark):
    one = "<figure><div><p>a b</p></div><div><pre>x a b y</pre></div></figure><p>after</p>"
    pages = spark.createDataFrame([(1, one), (2, None), (3, ""), (4, "<figure>"), (5, one.replace("a b</p>", "a c</p>")), (6, "<figure><pre></pre><p>x</p></figure>"), (7, one + one)], "page_id long, html string")
    rows = E.element_rows(pages, "page_id")
    kept = V.without(rows, V.redundant(rows, "page_id"), "page_id")
    texts = {n: [] for n in range(1, 8)}
    for r in kept.where("kind = 'text'").orderBy("page_id", "pos").collect():
        texts[r["page_id"]].append(r["text"])
    assert texts == {1: ["x a b y", "after"], 2: [], 3: [], 4: [], 5: ["a c", "x a b y", "after"], 6: ["x"], 7: ["x a b y", "after"] * 2}
    # nothing else is lost or changed
    assert kept.columns == rows.columns
    assert kept.where("page_id = 5").count() == rows.where("page_id = 5").count()
    assert kept.where("kind = 'page'").count() == 7
    empty = pages.where("page_id > 99")
    assert content_rows(empty, "page_id", rules=C.Rules(previews=True)).count() == 0


def test_nested_and_unclosed_figures(spark):
    inner = "<figure><p>q</p><div><pre>q r</pre></div></figure>"
    pages = {1: f"<figure><div><p>one</p>{inner}</div><div><pre>one two</pre></div></figure>", 2: "<figure><div><p>one</p>" * 3 + "<pre>one", 3: "<figure>" * 600 + "<p>x"}
    table = spark.createDataFrame(list(pages.items()), "page_id long, html string")
    rows = E.element_rows(table, "page_id")
    found = sorted((r["page_id"], r["pane"]) for r in V.redundant(rows, "page_id").collect())
    places = {(r["page_id"], r["pos"]): r["name"] for r in rows.where("kind = 'start'").collect()}
    assert [(n, places[n, p]) for n, p in found] == [(1, "div"), (1, "p")]


def test_panes_shuffle_no_attributes(spark):
    found = V.panes(E.element_rows(spark.createDataFrame([(1, "<figure><pre>a")], "page_id long, html string"), "page_id"), "page_id")
    kind = spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    plan = found._jdf.queryExecution().explainString(kind)
    sent = [part.split("\n", 1)[0] for part in plan.split(") Exchange\n")[1:]]
    assert sent and not any("attrs#" in x for x in sent)
