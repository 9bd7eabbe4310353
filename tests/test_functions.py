"""Column functions on inline cases, nulls and malformed input included."""

import pytest
from pyspark.sql import functions as F

from pagemill.functions import encoding as E, errors as X, html as H, markdown as M, metadata as D, passes as P, urls as U
from pagemill.operators import state as S
from pagemill.plans import page_queries, url_queries
from pagemill.plans.page_queries import decoded, render


def column(spark, values, function, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")
    return [r["y"] for r in rows.select("i", function(F.col("x")).alias("y")).orderBy("i").collect()]


def test_rewrites(spark):
    urls = ["https://github.com/o/r/blob/main/a/b.md?x#y", "https://gist.github.com/u/1#file-my-notes-md", "https://gitlab.com/a/b/-/blob/main/c.py", "https://bitbucket.org/o/r/src/main/f.txt", "https://example.com/x", "https://raw.githubusercontent.com/o/r/m/a.md", None]
    got = column(spark, urls, lambda u: U.raw_rewrite(u)["url"])
    assert got == ["https://raw.githubusercontent.com/o/r/main/a/b.md", "https://gist.githubusercontent.com/u/1/raw/my.notes.md", "https://gitlab.com/a/b/-/raw/main/c.py", "https://bitbucket.org/o/r/raw/main/f.txt", *urls[4:]]


def test_normalized(spark):
    got = column(spark, ["HTTP://Example.com:80/a", "ftp://x/", "https://u:p@x.org/", "http://127.0.0.1/", "http://a.local/", None, "", "no url"], lambda u: U.normalized(u)["error"])
    assert got == [None, "unsupported-protocol", "credentials", "blocked-ip", "blocked-host", "empty", "empty", "invalid"]


LABELS = ["bücher", "Größe", "пример", "例え", "faß", "ＡＢＣ", "ΑΣΣ", "münchen-ost", "مثال", "한국", "ñandú", "ǅ", "a\u00adb", "é", "e\u0301", "x" * 63, "日本語" * 4]


def test_hosts_are_those_of_the_codec():
    for label in LABELS:
        for name in (label, f"www.{label}.example", f"{label}.{label}"):
            assert U.plain_host(name) == name.encode("idna").decode().lower(), name
    assert U.plain_host("a。b．c｡d") == "a.b.c.d"
    assert [U.plain_host(x) for x in ("a℀b", "ü" * 60, "a⒈b", "a b", "a%2fb", "%ff", "1.2.3.4.5", "256.1.1.1", "1.2.3.256", "09", "4294967296")] == [None] * 11
    assert U.plain_host("ü..de.") == "xn--tda..de."  # empty labels stand, as in browsers


def test_numbers_as_hosts():
    """Every way to write an address gives the same one."""
    import itertools
    import random

    rng = random.Random(3)
    ways = (str, hex, lambda n: f"0X{n:X}", lambda n: f"0{n:o}", lambda n: f"000{n:o}")
    for _ in range(50):
        parts = [rng.choice([0, 1, 9, 127, 255, rng.randrange(256)]) for _ in range(4)]
        whole = ".".join(map(str, parts))
        for size in range(1, 5):
            head, tail = parts[: size - 1], int.from_bytes(bytes(parts[size - 1 :]), "big")
            for way in itertools.product(ways, repeat=min(size, 2)):
                text = ".".join(way[i % len(way)](n) for i, n in enumerate([*head, tail]))
                assert U.plain_host(text) == U.plain_host(text + ".") == whole, text


def test_v6_addresses(spark):
    """Digits and blocks of addresses in every form are those of the standard library; other texts are none."""
    import ipaddress
    import random

    rng = random.Random(8)
    texts = ["::", "::1", "1::", "::ffff:10.1.2.3", "::ffff:8.8.8.8", "::ffff:0a01:0203", "64:ff9b::1.2.3.4", "FE80::1", "1:2:3:4:5:6:7:8", "2001::1", "2001:4860::8888"]
    texts += ["", ":", ":::", "1:2:3:4:5:6:7", "1:2:3:4:5:6:7:8:9", "1::2::3", "1:2:3:4:5:6:7::8", "::12345", "::g", "1.2.3.4", "::1.2.3", "::1.2.3.456", "1:2:3:4:5:6:7:1.2.3.4", ":1:2:3:4:5:6:7", "::1%eth0", "1:", None]
    for _ in range(200):
        ip = ipaddress.IPv6Address(rng.choice([rng.getrandbits(128), rng.getrandbits(16), 0xFFFF << 32 | rng.getrandbits(32), (rng.choice([0xFC00, 0xFE80, 0xFF02, 0x2002, 0x2606]) << 112) | rng.getrandbits(20)]))
        texts += [ip.compressed, ip.exploded, ip.compressed.upper()]

    def parsed(text):
        try:
            return ipaddress.IPv6Address(text) if text and "%" not in text else None
        except ValueError:
            return None

    def blocked(ip):
        if ip is None:
            return False
        v4 = ip.ipv4_mapped is not None and any(ip.ipv4_mapped in ipaddress.IPv4Network(n) for n in U.BLOCKED_V4)
        return v4 or any(ip in ipaddress.IPv6Network(n) for n in U.BLOCKED_V6)

    ips = [parsed(t) for t in texts]
    assert column(spark, texts, U.v6_digits) == [ip and ip.packed.hex() for ip in ips]
    assert column(spark, texts, lambda t: U.blocked_v6_digits(U.v6_digits(t))) == [blocked(ip) for ip in ips]
    urls = [f"http://[{t}]:81/x" for t in texts if t is not None]
    want = ["blocked-ip" if blocked(parsed(t)) else None if parsed(t) else "invalid" for t in texts if t is not None]
    assert column(spark, urls, lambda u: U.normalized(u)["error"]) == want
    assert column(spark, urls, lambda u: U.normalized(U.as_read(u))["error"]) == want
    assert column(spark, ["http://[2606:4700:0:0::1]/a", "https://[2606:4700::1]:443", "http://[2606:4700::1", "http://[2606:4700::1]x/"], lambda u: U.normalized(U.as_read(u))["url"]) == ["http://[2606:4700::1]/a", "https://[2606:4700::1]/", None, None]


def test_addresses_as_read(spark):
    given = ["http://例え.jp", "HTTP:/\\Exa%6Dple.com\\a b?ü#é", "http://u:p@１.1/", "http://[::1]/", "http://a.org:８/", " \thttp://x.org/\n ", "ftp://ü/", "ü", "", None, "http://example.com/a'\"b", "http:///x", "http://0x/"]
    read = ["http://xn--r8jz45g.jp", "HTTP://example.com/a%20b?%C3%BC#%C3%A9", "http://u:p@1.0.0.1/", "http://[::1]/", "http://a.org:８/", "http://x.org/", "ftp://ü/", "ü", "", None, "http://example.com/a'\"b", "http://x", "http://0.0.0.0/"]
    assert column(spark, given, U.as_read) == read
    errors = [None, None, "credentials", "blocked-ip", "invalid", None, "unsupported-protocol", "invalid", "empty", "empty", None, None, "blocked-ip"]
    assert column(spark, given, lambda u: U.normalized(U.as_read(u))["error"]) == errors
    # plain addresses never reach Python
    plain = spark.createDataFrame([("https://example.com:81/a?b#c",), ("http://1e.org/",), ("http://a.b.1c/x.9",)], "x string")
    assert [r[0] for r in plain.select(F.col("x").rlike(U._ODD)).collect()] == [False] * 3


def test_addresses(spark):
    assert column(spark, ["10.1.2.3", "8.8.8.8", "::ffff:192.168.0.1", "fe80::1%eth0", "2606:4700::1", "x", None], lambda c: U.blocked_v4(c) | U.blocked_v6(c)) == [True, False, True, True, False, False, False]
    assert column(spark, ["169.254.169.254", "a.internal", "example.org"], U.block_reason) == ["cloud-metadata", "blocked-suffix", None]


def test_resolved(spark):
    page = F.lit("https://a.org/b/c/d.html?q")
    got = column(spark, ["x.html", "../y", "/z", "//h/p", "#f", "mailto:a@b", "../../../up", "a b"], lambda h: U.resolved(h, page))
    assert got == ["https://a.org/b/c/x.html", "https://a.org/b/y", "https://a.org/z", "https://h/p", "#f", "mailto:a@b", "https://a.org/up", "a b"]


def test_encodings(spark):
    body = [b"\xef\xbb\xbfx", b"\xff\xfea\x00", b'<meta charset="windows-1252">', b"<?xml version='1.0' encoding='utf-16'?>", b"plain", None]
    assert column(spark, body, lambda b: E.encoding(b, F.lit(None).cast("string")), "binary") == ["utf-8", "utf-16le", "windows-1252", "utf-16", "utf-8", "utf-8"]
    assert column(spark, [b"%PDF-1", b"\x1f\x8b", b"text", b"a\x00\xff"], lambda b: E.is_binary(b, F.lit(None).cast("string")), "binary") == [True, True, False, True]
    assert column(spark, [b"caf\xe9", None], lambda b: E.decoded(b, F.lit("latin1")), "binary") == ["café", None]
    assert column(spark, ["ééé", "ab", None], lambda t: E.cut_to_bytes(t, F.lit(3))) == ["é", "ab", None]


def test_metadata(spark):
    html = "<html><head><title> A &amp; B </title><meta name=description content='d'><meta property='og:title' content=\"O\"><link rel=icon href=/f.ico></head><body>x</body></html>"
    rows = spark.createDataFrame([(html, "https://e.org/p"), ("", "https://e.org/"), (None, None), ("<title>" + "x" * 600 + "</title>", "https://e.org/")], "h string, u string")
    got = [r["m"] for r in rows.select(D.limited(D.metadata(F.col("h"), F.col("u"))).alias("m")).collect()]
    assert (got[0]["title"], got[0]["description"], got[0]["favicon"]) == ("O", "d", "https://e.org/f.ico")
    assert got[1] is None and got[2] is None and got[3] is None


def test_titles(spark):
    assert column(spark, ["---\ntitle: 'T'\n---\n# H", "# H\nx", "text\n\n## Two\n", "none", None], M.raw_title) == ["T", "H", "Two", None, None]
    assert column(spark, ["Page | Site", "Page", "Other", None], lambda t: M.prefers_heading(F.lit("page"), t)) == [True, True, False, True]


def test_sections(spark):
    assert column(spark, ["# A\n\n# B\ntext", "# A\n\n## B\ntext", "text\n# End"], M.without_empty_sections) == ["\n# B\ntext", "# A\n\n## B\ntext", "text\n# End"]
    assert column(spark, ["a\n```\nx.Y\n```\nb.C", "```\nopen.X"], lambda t: M.outside_fences(t, F.upper)) == ["A\n```\nx.Y\n```\nB.C", "```\nopen.X"]


def test_limits(spark):
    got = column(spark, ["x" * 300, "short", None], lambda t: M.inline_limited(t, 100))
    assert got[0]["truncated"] and len(got[0]["content"]) <= 100 and got[1]["content"] == "short" and not got[1]["truncated"]
    assert column(spark, [100, 2048, 20480, 3 << 20], M.size_label, "long") == ["100 B", "2.0 KB", "20 KB", "3.0 MB"]


def test_markdown(spark):
    assert column(spark, ["<h1>A</h1><p>b <a href='/c'>d</a></p>", "", None], H.markdown) == ["# A\n\nb [d](/c)", "", None]


def test_render_keeps_rows(spark):
    rows = [(1, "https://e.org/", "<html><body><h1>T</h1><script>x</script><p>y</p></body></html>"), (2, None, None), (3, "https://e.org/", ""), (4, "https://e.org/", "<div><p>unclosed <b>x" * 50), (5, "https://e.org/", "a\x00b")]
    got = {r["page_id"]: r for r in render(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert len(got) == 5 and got[1]["markdown"] == "# T\n\ny\n\n---\n\n _T_ | [_Original Source_](https://e.org/) | _01/31/2024_" and got[5]["error"] == "binary_content"
    assert got[1]["content_size"] == len(got[1]["markdown"])


def test_render_of_raw_and_article_pages(spark):
    long = "Some words of a sentence that is long enough. " * 5
    article = f"<article><h1>T</h1><p>{long}</p><a href='../u'>l</a><ul><li>x<ul><li>y</li></ul></li></ul><table><tr><td>A</td><td>B</td></tr><tr><td>1</td><td>2</td></tr></table></article>"
    rows = [
        (1, "https://github.com/o/r/blob/main/a.md", "# Head\n[l](b.md)\n"), (2, "https://e.org/a/b/c", f"<html><head><title>T</title><meta name=author content=A></head><body><nav><a href=/>n</a></nav>{article}</body></html>"),
        (3, "https://e.org/x", "---\ntitle: Y\n---\ntext"), (4, "ftp://e.org/", "<p>x</p>"),
    ]
    got = {r["page_id"]: r for r in render(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[1]["resolved_url"] == "https://raw.githubusercontent.com/o/r/main/a.md" and got[1]["source_kind"] == "raw" and got[1]["title"] == "Head"
    assert got[1]["markdown"] == "# Head\n\nSource: https://raw.githubusercontent.com/o/r/main/a.md\n[l](https://raw.githubusercontent.com/o/r/main/b.md)\n"
    assert (got[2]["source_kind"], got[2]["title"]) == ("article", "T") and got[3]["title"] == "Y"
    assert got[2]["markdown"] == f"# T\n\n{long.strip()}\n\n[l](https://e.org/a/u)\n\n- x\n    - y\n\n| A | B |\n| --- | --- |\n| 1 | 2 |\n\n---\n\n _T_ | _A_ | [_Original Source_](https://e.org/a/b/c) | _01/31/2024_"
    assert got[4]["error"] == "unsupported-protocol"
    cut = {r["page_id"]: r for r in render(spark.createDataFrame(rows, "page_id long, url string, html string"), inline_limit=60).collect()}
    assert cut[2]["truncated"] and len(cut[2]["markdown"]) <= 60 and cut[2]["markdown"].endswith("...[truncated]") and not cut[3]["truncated"]


def test_regions_and_headings(spark):
    fill = "x" * 120
    nested = f"<div class='page content'><div>{fill}</div><div>in</div></div><div>out</div>"
    pages = [f"<main><main>{fill}</main>tail</main>after", nested, f"<article>short</article><div id=content>{fill}</div>", "<p>none</p>", None]
    assert column(spark, pages, H.content_region) == [f"<main>{fill}</main>tail", f"<div>{fill}</div><div>in</div>", fill, None, None]
    heads = ["<h1> A <b>b</b></h1>", "<p data-title='true'>Marked</p><h1>A</h1>", "<h2>no</h2>", "<h2>no</h2><main><h2>Yes</h2></main>", None]
    assert column(spark, heads, H.primary_heading) == ["A b", "Marked", None, "Yes", None]


def test_line_clean_up(spark):
    cases = {
        "# A [#](#a)": "# A", "##  B  ": "## B", "a.B [x](y)z": "a. B [x](y) z", "[x](y)[z](w)": "[x](y) [z](w)", "see` a. b `x": "see `a.b` x", "``a`b``c": "``a`b``c",
        "- \\|": "", "t\n- i": "t\n\n- i", "# h\nt": "# h\n\nt", "a: \"x\"b: 1": "a: \"x\"\n\nb: 1", "  - n": "    - n", "[\u200b](#x)t": "t", "[a\\<b](u)": "[a\\<b](u)",
        "[Skip link](#c)": "", "Back to top": "Back to top", "Returns: x": "", "| <b> | c |": "| \\<b\\> | c |", "x\\-y": "x - y",
    }
    assert column(spark, list(cases), M.lines_tidied) == list(cases.values())
    assert column(spark, ["Home\n\n# T\nx", "Edit this page\ntext", "## Contents\n" + "- [a](#a)\n" * 20 + "\nend"], lambda t: M.without_leading_chrome(P.toc_removed(t))) == ["# T\nx", "\ntext", "\nend"[1:]]


def test_whole_clean_up(spark):
    dressed = "Edit this page\n\n# Title [#](#title)\nWas this page helpful?\n\n## Empty\n\n## Next\n\nEnd.Start [a](b)[c](d)\n\n```\nEnd.Start\n- \\|\n```\n\nNote: one thing\n\nmore text"
    want = "\n\n# Title\n\n## Next\n\nEnd. Start [a](b) [c](d)\n\n```\nEnd.Start\n- \\|\n```\n\n### Note: one thing\n\nmore text"
    assert column(spark, [dressed, "", None], M.cleaned) == [want, "", None]
    assert column(spark, ["<code>a`b</code> <code>c</code>"], H.markdown) == ["`` a`b `` `c`"]


def test_links_of_markdown(spark):
    page = F.lit("https://a.org/b/c.html")
    got = column(spark, ["[x](d) ![i](/e.png) [w](https://z.org/(q)) [f](#f)\n```\n[k](d)\n```", "no links", None], lambda t: M.links_resolved(t, page))
    assert got == ["[x](https://a.org/b/d) ![i](https://a.org/e.png) [w](https://z.org/(q)) [f](#f)\n```\n[k](d)\n```", "no links", None]


def test_empty_section_gate(spark):
    full, empty = "<h2>a</h2><p>x</p>" * 5, "<h2>a</h2>" * 3 + "<h2>a</h2><p>x</p>" * 3
    assert column(spark, [full, empty, "<h2>a</h2>", "<h1>t</h1>" + full.replace("<h2>", "<h2 class='sr-only'>")], M.few_empty_sections) == [True, False, True, True]
    assert column(spark, ["<img src=a><img src='data:x'><img>"], M.real_images) == [2]


def test_bytes_to_pages(spark):
    rows = [(1, "u", b"\xff\xfeh\x00i\x00", None), (2, "u", b"caf\xe9", "text/html; charset=latin1"), (3, "u", b"\x89PNG", None), (4, "u", b"x", "image/png"), (5, "u", None, None)]
    got = {r["page_id"]: (r["html"], r["body_error"]) for r in decoded(spark.createDataFrame(rows, "page_id long, url string, body binary, content_type string")).collect()}
    assert got == {1: ("hi", None), 2: ("café", None), 3: (None, "binary_content"), 4: (None, "unsupported_type"), 5: (None, None)}


def test_tasks(spark):
    tasks = spark.createDataFrame([("t1", "o", "working"), ("t2", "o", "failed"), ("t3", "p", "working")], "task_id string, owner string, status string")
    asked = spark.createDataFrame([(1, "t1", "o"), (2, "t2", "o"), (3, "t3", "o"), (4, None, None)], "request_id int, task_id string, owner string")
    assert {r["request_id"]: (r["outcome"], r["status"]) for r in S.cancelled(tasks, asked).collect()} == {1: ("cancelled", "cancelled"), 2: ("already failed", "failed"), 3: ("not-found", None), 4: ("not-found", None)}


def test_a_busy_key_is_folded_in_batches(spark):
    rows = spark.range(25_000).select(F.lit(1).cast("long").alias("user_id"), F.col("id").alias("event_id"), F.timestamp_millis(F.col("id") * 500).alias("ts"))
    got = S.rate_limited(rows, limit=3, window_ms=4_500).groupBy("allowed").count().collect()
    assert {r["allowed"]: r["count"] for r in got} == {True: 7500, False: 17500}


LONG = {
    "open tags": "<" * 100_000, "open links": '<a href="' * 12_000, "hidden": "<div hidden>" + "x é😀" * 25_000 + "</div>", "nested": "<nav>" * 300 + "y" * 100_000 + "</nav>" * 300,
    "lists": "<ul><li>" * 60 + "z" * 100_000, "cells": "<table><tr><td>" + "c<br>" * 20_000 + "</td></tr></table>", "code": "<pre>" + "line\n" * 20_000 + "</pre>",
    "payload": '<script>self.__next_f.push([1,"' + "ab\\n" * 25_000 + '"])</script>', "scripts": "<script>" * 12_000, "bold": "<p>x<b>" * 14_000, "anchors": "<a href='x'>y" * 8_000, "comments": "<!-- " * 20_000, "titles": "<title><h1>" * 9_000, "terms": "<dl><dt>x<dd>y" * 7_000, "lines": "Text. More\n\n# H\n- i `c` [l](u)\n" * 3_000, "spaces": "<p>" + " " * 100_000 + "x",
}


@pytest.mark.parametrize("kind", LONG)
def test_long_markup_takes_linear_time(spark, kind):
    """One text of 0.1 MB of each kind goes through everything in seconds, without an overflow."""
    import time

    began = time.perf_counter()
    functions = (P.flight_payloads, P.prepared, H.cleaned, H.markdown, H.visible_text, H.content_region, H.primary_heading, M.cleaned, lambda t: M.inline_limited(t, 50_000))
    frame = spark.createDataFrame([(LONG[kind],)], "x string")
    for f in functions:
        frame.select(f(F.col("x")).alias("y")).collect()
    assert time.perf_counter() - began < 90


def test_rate_limit(spark):
    times = [0, 10, 20, 30, 61, 200]
    rows = spark.createDataFrame([(1, i, t) for i, t in enumerate(times)], "user_id long, event_id long, t long").select("user_id", "event_id", F.timestamp_seconds("t").alias("ts"))
    got = {r["event_id"]: (r["allowed"], r["retry_after"]) for r in S.rate_limited(rows, limit=2, window_ms=60_000).collect()}
    assert got == {0: (True, None), 1: (True, None), 2: (False, 40), 3: (False, 30), 4: (True, None), 5: (True, None)}


def test_references_without_semicolons_stay_in_reports(spark):
    """A page's title that was cut in a reference is the same in the title, the heading and the footer."""
    html = "<html><head><title>A &amp; b&amp</title></head><body><article><h1>A &amp; b&amp</h1><p>&lt;i> &eacute; &#65; &quot &bogus; <a href='/x?a=1&copy=2&amp;b=3'>go</a> " + "more words " * 20 + "</p></article></body></html>"
    page = render(spark.createDataFrame([(1, "https://e.org/", html)], "page_id long, url string, html string")).collect()[0]
    assert page["title"] == "A & b&amp" and page["markdown"].startswith("# A & b&amp\n\n") and " _A & b&amp_ " in page["markdown"]
    assert "<i> é A &quot &bogus; [go](https://e.org/x?a=1&copy=2&b=3) more words" in page["markdown"]


def test_limited_reports_keep_references_without_semicolons(spark, tmp_path):
    html = "<html><head><title>T&amp</title></head><body><article><h1>T&amp</h1><p>" + "more words " * 200 + "</p></article></body></html>"
    spark.createDataFrame([(1, "https://e.org/", html)], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    row = page_queries.limited_report(spark, str(tmp_path)).collect()[0]
    assert row["markdown"].startswith("# T&amp\n\nmore words") and row["content_size"] == 1000 and row["truncated"]


def test_limited_reports_cut_in_references_and_links(spark, tmp_path):
    """Titles cut at each place of a reference, links around the limit and texts on both sides of it, against the query's SQL."""
    import duckdb

    words = "Some words of it. " * 80
    cases = [("T &amp; a" + r[:k], words[:n]) for r in ("&amp;", "&quot;", "&lt;") for k in range(len(r) + 1) for n in (300, 1400)] + [("Plain titles", words[:n]) for n in range(845, 885)]
    cases += [("Plain title", words[:n].strip() + ' <a href="https://e.org/l">label &amp; x</a> c&quo ' + words) for n in range(900, 985, 5)]
    page = "<!DOCTYPE html><html><head><title>{0}</title></head><body><nav><a href='/x'>x</a></nav><article><h1>{0}</h1><p><b>{0} more.<br><p>{1}</p></article><footer>&copy; e.org</footer></body></html>"
    rows = [(i, f"https://e.org/en/{i}.html", page.format(*c)) for i, c in enumerate(cases)]
    spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    right = sorted(duck.execute(page_queries.SQL["limited_report"]).fetchall())
    assert {(1000, False), (1000, True)} <= {r[2:] for r in right}
    assert sorted(map(tuple, page_queries.limited_report(spark, str(tmp_path)).collect())) == right


def test_cuts_to_bytes_run_without_python(spark):
    texts = ["", "a", "é€😀x" * 9, "ab" * 40, "😀" * 30, None]
    rows = spark.createDataFrame([(t, n) for t in texts for n in range(12)], "t string, n int")
    cut = rows.select("t", "n", E.cut_to_bytes(F.col("t"), F.col("n")).alias("c"))
    assert "Python" not in cut._jdf.queryExecution().toString()
    assert all(r["c"] == (None if r["t"] is None else r["t"].encode()[: r["n"]].decode("utf-8", "ignore")) for r in cut.collect())


def test_byte_cut_around_its_limit(spark, tmp_path):
    """Characters of one to four bytes across the 1000th byte, long and absent texts; the query's plan holds no Python."""
    texts = ["", "a" * 1000, "a" * 1001, "é" * 70_000, None] + ["a" * n + c for c in "é€😀" for n in range(995, 1001)]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    cut = url_queries.byte_cut(spark, str(tmp_path))
    assert "Python" not in cut._jdf.queryExecution().toString()
    right = {i: (None, None) if t is None else (len(t.encode()[:1000].decode("utf-8", "ignore").encode()), len(t.encode()) > 1000) for i, t in enumerate(texts)}
    assert {r["doc_id"]: (r["n_bytes"], r["truncated"]) for r in cut.collect()} == right


def test_plain_bodies_are_decoded_without_python(spark):
    """Valid UTF-8 and UTF-16 are read by Spark, all else by Python, with the same text."""
    cases = [("aé€", n) for n in ("utf-8", "utf-16le", "utf-16be", "cp1252")] + [("\ufeffx", n) for n in ("utf-8", "utf-16le", "utf-16be")] + [("😀", n) for n in ("utf-8", "utf-16le", "utf-16be")] + [("x" * 400_000, "utf-16le"), ("", "utf-16be"), ("", "utf-8")]
    raw = [(t.encode(n), n) for t, n in cases] + [(b"a\xff", "utf-8"), (b"a\x00b", "utf-16le"), (b"\xd8\x00\x00a", "utf-16be"), (b"\x00\xdc", "utf-16le"), (b"abc", "no-such"), (b"abc", None), (b"\xef\xbb\xbf\xef\xbb\xbfb", "utf-8"), (None, "utf-8")]
    rows = spark.createDataFrame([(i, bytearray(b) if b is not None else None, n) for i, (b, n) in enumerate(raw)], "i int, b binary, n string")
    got = rows.select("i", E.plainly_decoded(F.col("b"), F.col("n")).alias("plain"), E.decoded("b", "n").alias("text")).orderBy("i").collect()
    assert all(r["plain"] in (None, r["text"]) for r in got)
    assert [r["i"] for r in got if r["plain"] is None] == [3, 8, 9, 13, 14, 15, 16, 17, 20]
    assert [r["text"] for r in got][4:7] == ["x"] * 3 and got[13]["text"] == "a\ufffd" and got[19]["text"] == "\ufeffb"


def test_v6_block_with_large_numbers(spark, tmp_path):
    """Event numbers of more than four digits still make addresses."""
    ids = [5, 9_995, 10_000, 10_001, 10_002, 10_003, 10_004, 99_995, 6_000_000_000, 9_223_372_036_854_775_805]
    spark.createDataFrame([(i,) for i in ids], "event_id long").write.parquet(f"{tmp_path}/events.parquet")
    assert {r["event_id"]: r["blocked"] for r in url_queries.v6_block(spark, str(tmp_path)).collect()} == {i: i % 5 in (0, 2, 3) for i in ids}
    assert column(spark, ["fe80::10000", "fe80::1:0000%x"], U.blocked_v6) == [False, True]


def test_times_are_the_nearest_milliseconds(spark):
    """As ``epoch_ms`` of DuckDB has them; a part of a millisecond changes no second of waiting."""
    micros = [0, 499, 500, 1_499, 1_500, -499, -500, -1_501, 1_705_798_100_911_449, 1_706_371_807_518_904]
    rows = spark.createDataFrame([(1, i, t) for i, t in enumerate(micros)], "user_id long, event_id long, t long").select("user_id", "event_id", F.timestamp_micros("t").alias("ts"))
    got = [r["ms"] for r in rows.orderBy("event_id").select(S.whole_millis(F.col("ts")).alias("ms")).collect()]
    assert got == [0, 0, 1, 1, 2, 0, -1, -2, 1_705_798_100_911, 1_706_371_807_519]
    two = rows.where("event_id IN (0, 2)")
    assert {r["event_id"]: r["retry_after"] for r in S.rate_limited(two, limit=1, window_ms=60_001).collect()} == {0: None, 2: 60}


def test_token_bucket(spark):
    rows = spark.createDataFrame([(1, i, t) for i, t in enumerate([0, 0, 0, 1, 10])], "user_id long, event_id long, t long").select("user_id", "event_id", F.timestamp_seconds("t").alias("ts"))
    got = {r["event_id"]: (r["allowed"], r["dropped_before"]) for r in S.token_bucket(rows, capacity=2, per_second=1.0).collect()}
    assert got == {0: (True, 0), 1: (True, 0), 2: (False, 0), 3: (True, 1), 4: (True, 0)}


def test_errors(spark):
    now = F.lit("2024-01-01 00:00:00").cast("timestamp")
    assert column(spark, ["7", "Mon, 01 Jan 2024 00:01:00 GMT", "Mon, 01 Jan 2001 00:01:00 GMT", "soon", None], lambda h: X.retry_after(h, now)) == [7, 60, 0, 60, 60]
    assert column(spark, [429, 404, 200], lambda s: X.category(F.lit(None).cast("string"), s), "int") == ["rate_limited", "upstream_http", None]
