"""Element trees, content and Markdown of pages against the standard library's parser and by hand."""

import html as references
import html.parser
import random
import re
import time

import pytest
from pyspark.sql import functions as F

from pagemill.operators import content as C, elements as E
from pagemill.plans.page_queries import content_rows, render, to_markdown

WELL = "div section article span b em ul li p table tr td blockquote code a".split()


class Spans(html.parser.HTMLParser):
    """(name, text inside) of each element of well-formed markup, in order of start tags."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.found, self.open = [], []

    def handle_starttag(self, tag, attrs):
        self.found.append([tag, "", len(self.open), {k: v or "" for k, v in attrs}])
        if tag not in E.VOID:
            self.open.append(self.found[-1])

    def handle_endtag(self, tag):
        if self.open and self.open[-1][0] == tag:
            self.open.pop()

    def handle_data(self, data):
        for x in self.open:
            x[1] += data


def markup(rng, depth=0):
    out = ""
    for _ in range(rng.randint(0, 4)):
        kind = rng.random()
        if kind < 0.4 or depth > 6:
            out += rng.choice(["text, more ", "a &amp; b ", "&copy; &#8212; &eacute;", "x < 1 ", "<!-- c <b> -->", "<br>", "<img alt='a>b' src=x>", " "])
        else:
            tag = rng.choice(["div", "section", "span", "b", "em", "code", "blockquote"])
            out += f"<{tag}{rng.choice(['', ' class=x', ' id=' + chr(34) + 'i>j' + chr(34), ' hidden'])}>{markup(rng, depth + 1)}</{tag.upper() if rng.random() < 0.2 else tag}>"
    return out


def spans(rows):
    """(name, text, depth, attributes) of each element from rows."""
    out = []
    for r in rows:
        if r[1] in ("start", "void"):
            inside = rows[r[0] + 1 : r[9]] if r[1] == "start" else []
            depth = sum(1 for q in rows[: r[0]] if q[1] == "start" and q[9] > r[0])
            out.append([r[2], "".join(q[4] for q in inside if q[1] == "text"), depth, dict(r[5])])
    return out


def test_well_formed_markup_is_read_as_by_the_standard_library():
    rng = random.Random(1)
    for _ in range(300):
        page = markup(rng)
        want = Spans()
        want.feed(page)
        want.close()
        assert spans(E.parsed(page)) == want.found, page


def test_rows_are_balanced_whatever_the_markup():
    rng = random.Random(2)
    pieces = ["<%s>" % t for t in WELL] + ["</%s>" % t for t in WELL] + ["x", "<", "<a href=\"", "'>", "<!--", "-->", "<script>", "</script>", "&amp", "<td", "<br/>", "<p class='a", "<title>", "</p>", "<h1>", "<h2>"]
    for _ in range(500):
        page = "".join(rng.choice(pieces) for _ in range(rng.randint(0, 40)))
        rows = E.parsed(page)
        stack = []
        for n, r in enumerate(rows):
            assert r[0] == n
            if r[1] == "start":
                assert r[7] == (stack[-1] if stack else -1) and r[9] > n and rows[r[9]][6] == n
                stack.append(n)
            elif r[1] == "end":
                assert stack.pop() == r[6] and rows[r[6]][15] == r[15]
        assert not stack
        # all characters but those of tags are there
        assert "".join(r[3] for r in rows if r[1] in ("text", "data")).count("x") == len(re.findall("x", re.sub(r"(?s)<!--.*?(?:-->|$)", "", page))) or "<" in page


UNCLOSED = {
    "script": "<script>", "b": "<p>x<b>", "em": "<em>x", "li": "<li>x", "a": "<a href=x>y", "p": "<p>x", "td": "<table><tr><td>x", "ul": "<ul><li>x", "div": "<div>x", "nav": "<nav>x", "quote": "<blockquote>x", "h2": "<h2>x", "pre": "<pre>x",
    "angle": "<", "quoted": '<a href="', "comment": "<!--", "end": "</div>", "spaces": "<p " + " " * 50, "style": "<style>a", "title": "<title>", "span": "<span class=line>x", "code": "<code>`", "hidden": "<div hidden>x", "cell": "<td>x",
}


@pytest.mark.parametrize("kind", UNCLOSED)
def test_a_megabyte_of_unclosed_tags_is_read_in_seconds(kind):
    page = UNCLOSED[kind] * (1_000_000 // len(UNCLOSED[kind]))
    began = time.perf_counter()
    rows = E.parsed(page)
    assert time.perf_counter() - began < 15
    assert max((len(r[11]) for r in rows), default=0) <= E.DEEPEST


@pytest.fixture(scope="module")
def shown(spark):
    def run(pages, **options):
        rows = spark.createDataFrame(list(enumerate(pages)), "page_id long, html string")
        return {r["page_id"]: r for r in to_markdown(rows, "page_id", **options).collect()}

    return run


def test_markdown_of_fragments(shown):
    cases = {
        "<blockquote><p>q1</p><p>q2</p><blockquote>in<ul><li>a<pre>c1\nc2</pre></li></ul></blockquote></blockquote><p>z": "> q1\n>\n> q2\n>\n> > in\n> >\n> > - a\n> >\n> >     ```\n> >     c1\n> >     c2\n> >     ```\n\nz",
        "<div class='alert alert-warning'>w</div><div class='admonition tip'><p>t</p></div>": "> [!WARNING]\n> w\n\n> [!TIP]\n> t",
        "<p>x <b>unclosed<p>y</p>": "x unclosed\n\ny", "a &copy; &#8212; &#x2014; &eacute; &amp;lt; &notin; &bogus;": "a © — — é &lt; ∉ &bogus;",
        "<a href=/x?a=1&amp;b=2>go</a> <a href='y'>q</a>": "[go](/x?a=1&b=2) [q](y)", "<ol start=3><li>a<li>b<ul><li>c<ul><li>d</ul></ul></ol>": "3. a\n4. b\n  - c\n    - d",
        "<ul>" + "<li>x<ul>" * 12 + "<li>deep": "\n".join("  " * i + "- x" for i in range(12)) + "\n" + "  " * 12 + "- deep",
        "<table><thead><tr><th>h|<th>k<tbody><tr><td>a<table><tr><td>n</td></tr></table></td><td>q<p>r<br>s</p></td></table>": "| h\\| | k |\n| --- | --- |\n| a n | q r s |",
        "<dl><dt>t</dt><dd>d</dd></dl><hr><img data-src='/a-b.png'><p><sub>1</sub><sup>2</sup><mark>m</mark><kbd>k</kbd>": "**t**\n\n: d\n\n---\n\n![a b](/a-b.png)\n\n~1~^2^==m== `k`",
        "<pre class=mermaid>graph</pre><pre><code class='language-rust'>fn a() {}\n\n  b</code></pre><div class=mermaid>g2</div>": "```mermaid\ngraph\n```\n\n```rust\nfn a() {}\n\n  b\n```\n\n```mermaid\ng2\n```",
        "<pre><span class=line>a</span><span class=line>b</span></pre><span>a</span><code>b</code>": "```\na\nb\n```\n\na `b`", "<h2>A<br>b <a href='#x'>#</a></h2>text": "## A b\n\ntext",
        "<p>press the <button>OK</button> now</p><button>gone</button>": "press the OK now", "<noscript><img src=a.png></noscript><noscript>no</noscript>": "![a](a.png)",
        "<pre aria-hidden=true>hi</pre><textarea>x = 1</textarea><textarea>no</textarea>": "```\nx = 1\n```", "<ul><li><p>a</p><p>b</p></li></ul>": "- a\n\n    b", "": "", "<p></p> \n <div></div>": "",
    }
    got = shown(list(cases) + [None])
    assert [got[i]["markdown"] for i in range(len(cases))] == list(cases.values()) and got[len(cases)]["markdown"] == ""


def test_every_named_reference():
    names = [n for n in references.entities.html5 if n.endswith(";")]
    for at in range(0, len(names), 400):
        page = "".join(f"<i>&{n}</i>" for n in names[at : at + 400])
        got = [r[4] for r in E.parsed(page) if r[1] == "text"]
        assert got == [references.unescape("&" + n) for n in names[at : at + 400]]


NOISE = {
    "hidden": "<div hidden><div>no<div>no</div></div>no</div>", "style": "<p style='color:red; display: none'>no<b>no</b></p>", "nav": "<nav>no<nav>no<nav>no<nav>no<nav>no</nav></nav></nav></nav></nav>", "cookie": "<div class='my-cookie-bar'><div><p>no</p></div></div>",
    "promo": "<section id=newsletter><div>no</div></section>", "role": "<div role=navigation><ul><li>no</ul></div>", "header": "<header class='site-header'>no</header>", "fixed": "<div class='fixed'>no</div>", "reader": "<span class=sr-only>no</span>",
    "live": "<div aria-live=polite>no</div>", "utm": "<a href='/x?utm_source=y'>no</a>", "script": "<script>no</script><style>no</style><template><p>no</p></template>", "svg": "<svg><text>no</text></svg>", "form": "<form><p>no</p></form>",
    "copy": "<div class='btn copy'>no</div>", "edit": "<a class='edit-this-page'>no</a>", "tab": "<button role=tab>no</button>", "unclosed": "<div><div hidden>no<p>no<b>no</div></div>", "dialog": "<dialog>no</dialog>", "share": "<ul class='social share'><li>no</ul>",
}
KEPT = {
    "panel": "<div role=tabpanel hidden>yes</div>", "long nav": "<nav><p>" + "yes words of a long text " * 30 + "</p></nav>", "nav with section": "<nav><section>yes</section></nav>", "titled header": "<header class='site-header'><h1>yes</h1></header>", "class word": "<div class='adventure'>yes</div>",
    "promo in main": "<main><div class='banner'>yes</div></main>", "aside in main": "<article><aside>yes</aside></article>", "dialog": "<div role=dialog><h2>yes</h2></div>", "accordion": "<div data-accordion-item hidden>yes</div>",
}


def test_noise_goes_at_any_depth_and_content_stays(shown):
    pages = [f"<body><p>before</p><div><div>{x}</div></div><p>after" for x in (*NOISE.values(), *KEPT.values())]
    got = [r["markdown"] for _, r in sorted(shown(pages).items())]
    for name, text in zip(NOISE, got):
        assert text == "before\n\nafter", name
    for name, text in zip(KEPT, got[len(NOISE) :]):
        assert "yes" in text and text.startswith("before") and text.endswith("after"), name


def test_rules_of_the_user(shown):
    page = ["<p class='mine'>a</p><p id=x>b</p><p data-k=v>c</p><em>d</em><div class=related>e</div><div class=newsletter>f</div><svg>g</svg><div class='sponsor'>h</div>"]
    assert shown(page)[0]["markdown"] == "a\n\nb\n\nc\n\n_d_\n\ne"
    assert shown(page, rules=C.Rules(selectors=(".mine", "#x", "[data-k=v]", "em"), aggressive=True))[0]["markdown"] == ""
    assert shown(page, rules=C.Rules(categories=(), words=("mine",), keep_drawings=True))[0]["markdown"] == "b\n\nc\n\n_d_\n\ne\n\nf\n\ng"


LONG = "Some words of a sentence, long enough to be content, and then some more of them. " * 3


def test_regions_end_with_their_own_element(shown):
    fill = "x" * 120
    pages = [f"<table><tr><td class='content'><p>{fill}</p></td></tr></table><p>OUTSIDE</p>", f"<main><main>{fill}</main>tail</main>after", f"<article>short</article><div id=content>{fill}</div>", f"<span role=main><b>{fill}</b></span>out", "<p>none</p>"]
    got = shown(pages)
    assert [got[i]["region"] for i in range(5)] == [f"<p>{fill}</p>", f"<main>{fill}</main>tail", fill, f"<b>{fill}</b>", None]


def test_scores_find_content_without_names(shown):
    links = "".join(f"<li><a href=/{i}>A link of the menu, number {i}</a></li>" for i in range(30))
    page = f"<body><div class=top><ul>{links}</ul></div><div class=x><div class=story><h2>T</h2><p>{LONG}</p><p>{LONG}</p><div><p>{LONG}</p></div></div></div><div class=foot><p>Short note.</p></div>"
    got = shown([page])[0]
    assert LONG.strip() in got["region_markdown"] and "menu" not in got["region_markdown"] and "Short note" not in got["region_markdown"] and "menu" in got["markdown"]


def test_a_region_by_score_is_as_long_as_one_by_name(shown):
    """Commas alone make no region of a short article whose paragraph is left open."""
    short = "<article><h1>Some, four, words, here and on.</h1><p><b>Some, four, words, here and on.<br></article>"
    got = shown([f"<body>{short}</body>", f"<body>{short.replace('<br>', '<br>' + 'x' * 30)}</body>", f"<body><div><p>Some, four, words, here and on.{'x' * 70}</p></div></body>"])
    assert got[0]["region"] is None and got[1]["region"] is not None and got[2]["region"] is not None


def test_scores_by_hand(spark):
    """Points of paragraphs to parent and grandparent, less the share of links."""
    page = f"<body><div id=a><div id=b><p>{LONG}</p><p>{LONG}<a href=x>{LONG}</a></p></div><p>too short</p></div>"
    rows = C.scored(C.cleaned_rows(E.element_rows(spark.createDataFrame([(1, page)], "page_id long, html string"), "page_id"), "page_id"), "page_id")
    got = {r["id"]: r["score"] for r in rows.where("kind = 'start' AND name = 'div'").selectExpr("attrs['id'] AS id", "score").collect()}
    n = len(LONG.strip())
    points = [1 + LONG.count(",") + min(n // 100, 3), 1 + 2 * LONG.count(",") + min(2 * n // 100, 3)]
    density = n / (3 * n)
    assert got["b"] == pytest.approx(sum(points) * (1 - density)) and got["a"] == pytest.approx(sum(points) / 2 * (1 - n / (3 * n + 9)))


def test_galleries_headings_and_languages_stay(shown):
    page = "<body><div class='photo-gallery'><button>next</button><div hidden><img src=1.png alt=one></div><img src=2.png><p>caption</p></div><header class='layout navbar'><h2>Title</h2></header><pre><code class='lang-go'>x</code></pre>"
    assert shown([page])[0]["markdown"] == "![one](1.png)\n\n![2](2.png)\n\n## Title\n\n```go\nx\n```"


def test_repeated_and_missing_pages_keep_their_rows(spark):
    pages = [(1, "https://e.org/", f"<article><p>{LONG}</p></article>")] * 3 + [(None, None, None)] * 2 + [(2, "https://e.org/", "")]
    got = [(r["page_id"], r["source_kind"]) for r in render(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()]
    assert sorted(got, key=str) == [(1, "article")] * 3 + [(2, "document")] + [(None, "document")] * 2


def test_unclosed_markup_goes_through_the_whole_report(spark):
    pages = [(i, "https://e.org/", UNCLOSED[k] * (30_000 // len(UNCLOSED[k]))) for i, k in enumerate(UNCLOSED) if k not in ("quote",)]
    began = time.perf_counter()
    assert render(spark.createDataFrame(pages, "page_id long, url string, html string")).select(F.length("markdown")).collect()
    assert time.perf_counter() - began < 240


def test_content_rows_have_the_page_once(spark):
    rows = content_rows(spark.createDataFrame([(1, "<p>a", "u"), (2, None, "v")], "page_id long, html string, url string"), "page_id", ("url",))
    assert sorted((r["page_id"], r["url"]) for r in rows.where("kind = 'page'").collect()) == [(1, "u"), (2, "v")]


def explained(frame, mode):
    kind = frame.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString(mode)
    return frame._jdf.queryExecution().explainString(kind)


def test_generated_functions_are_small_enough_to_be_compiled(spark):
    """The JVM interprets functions of over 8 000 bytes for ever."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        pages = spark.createDataFrame([(1, "<article><p>a")], "page_id long, html string")
        sizes = [int(n) for n in re.findall(r"maxMethodCodeSize:(\d+)", explained(to_markdown(pages, "page_id").select("page_id", "markdown"), "codegen"))]
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert sizes and max(sizes) < 8000


def test_windows_over_blocks_carry_no_text_of_other_blocks(spark):
    pages = spark.createDataFrame([(1, "<p>a")], "page_id long, html string")
    carried = re.findall(r"named_struct\('?now, (.{0,150})", explained(to_markdown(pages, "page_id").select("page_id", "markdown"), "extended"))
    assert carried and not any(re.search(r"own, '?own", c) for c in carried)


@pytest.mark.parametrize("before, stays", [("see ", True), ("see \n", True), ("see \r\n", True), ("see", False), ("see! ", False), ("", False), ("x <b>y </b>", False), ("é ", False)])
def test_buttons_in_lines_of_text_stay(spark, before, stays):
    rows = C.cleaned_rows(E.element_rows(spark.createDataFrame([(1, f"<p>{before}<button>go</button>")], "page_id long, html string"), "page_id"), "page_id")
    assert bool(rows.where("kind = 'text' AND text = 'go'").count()) == stays
