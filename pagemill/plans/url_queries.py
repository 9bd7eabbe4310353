"""URL, address, error and header queries. Inputs that the tables lack are built from whole tables by expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from pagemill.functions import encoding as E, errors as X, urls as U
from pagemill.sources.tables import table


def url_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = F.col("url")
    return table(spark, sf_dir, "pages").select("page_id", U.scheme(u).alias("scheme"), U.host(u).alias("host"), U.path(u).alias("path"), U.query(u).alias("query"), U.fragment(u).alias("fragment"))


def host_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").groupBy(U.host(F.col("url")).alias("host")).agg(F.count(F.lit(1)).alias("n_pages"), F.sum(F.octet_length("html")).alias("html_bytes"))


def url_redact(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    dressed = F.concat(F.regexp_replace("url", "^(https?://)", "$1user:pw@"), F.lit("?q="), F.col("page_id").cast("string"), F.lit("#top"))
    return pages.select("page_id", U.redacted(dressed).alias("url"))


_RAW_INPUT = """
  CASE page_id % 7
    WHEN 0 THEN concat('https://github.com/org', CAST(page_id AS STRING), '/repo/blob/main/docs/a.md?plain=1')
    WHEN 1 THEN concat('https://gist.github.com/user/', CAST(page_id AS STRING), '#file-my-notes-md')
    WHEN 2 THEN concat('https://gitlab.com/group/sub/project/-/blob/main/', CAST(page_id AS STRING), '/x.txt')
    WHEN 3 THEN concat('https://bitbucket.org/team/repo/src/main/f', CAST(page_id AS STRING), '.json')
    WHEN 4 THEN concat('https://raw.githubusercontent.com/o/r/main/', CAST(page_id AS STRING), '.md')
    WHEN 5 THEN concat('https://gist.github.com/user/', CAST(page_id AS STRING), '/raw/a/b.py')
    ELSE url END
"""


def url_rewrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw-content addresses of viewer pages."""
    rows = table(spark, sf_dir, "pages").select("page_id", F.expr(_RAW_INPUT).alias("u"))
    return rows.select("page_id", U.raw_rewrite(F.col("u")).alias("r")).select("page_id", "r.url", "r.transformed", "r.platform")


def url_raw_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "pages").select("page_id", F.expr(_RAW_INPUT).alias("u"))
    return rows.select("page_id", U.is_raw_text(F.col("u")).alias("is_raw"))


def url_display(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "pages").select("page_id", F.expr(_RAW_INPUT).alias("u"))
    return rows.select("page_id", U.display_label(F.col("u")).alias("label"), U.is_repository_root(F.col("u")).alias("is_root"))


_NORMALIZE_INPUT = """
  CASE page_id % 8
    WHEN 0 THEN concat('  ', replace(url, 'https://', 'HTTPS://'), '  ')
    WHEN 1 THEN concat('ftp://f.org/', CAST(page_id AS STRING))
    WHEN 2 THEN concat('http://Example.COM:80/', CAST(page_id AS STRING))
    WHEN 3 THEN concat('http://user:pw@example.com/', CAST(page_id AS STRING))
    WHEN 4 THEN concat('http://10.0.0.', CAST(page_id % 256 AS STRING), '/x')
    WHEN 5 THEN concat('https://host', CAST(page_id AS STRING), '.internal/')
    WHEN 6 THEN concat('https://example.com:8443?q=', CAST(page_id AS STRING), '#f')
    ELSE '' END
"""


def url_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Normalized URLs, or why they are refused."""
    rows = table(spark, sf_dir, "pages").select("page_id", F.expr(_NORMALIZE_INPUT).alias("u"))
    return rows.select("page_id", U.normalized(F.col("u")).alias("n")).select("page_id", "n.url", "n.hostname", "n.error")


def host_header(spark: SparkSession, sf_dir: str) -> DataFrame:
    value = F.expr("CASE page_id % 4 WHEN 0 THEN concat('Example.COM:', CAST(page_id AS STRING)) WHEN 1 THEN concat('a', CAST(page_id AS STRING), '.org., b.org') WHEN 2 THEN '[::1]:80' ELSE '' END")
    return table(spark, sf_dir, "pages").select("page_id", U.host_of_header(value).alias("host"))


_IP = "concat_ws('.', CAST(event_id * 7919 % 256 AS STRING), CAST(event_id * 104729 % 256 AS STRING), CAST(event_id % 256 AS STRING), CAST(user_id % 256 AS STRING))"


def ip_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocked addresses by comparisons in the projection."""
    return table(spark, sf_dir, "events").select("event_id", F.expr(_IP).alias("ip")).select("event_id", "ip", U.blocked_v4(F.col("ip")).alias("blocked"))


def ip_networks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many addresses lie in each blocked network: a range join with the nine networks."""
    ips = table(spark, sf_dir, "events").select(U.v4_number(F.expr(_IP)).alias("n"))
    nets = F.broadcast(U.block_list(spark))  # nine fixed rows
    return ips.join(nets, F.col("n").between(F.col("low"), F.col("high"))).groupBy("network").agg(F.count(F.lit(1)).alias("n_addresses"))


def target_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why a host or address is refused, before any fetch."""
    target = F.expr("CASE event_id % 4 WHEN 0 THEN '169.254.169.254' WHEN 1 THEN concat('h', CAST(event_id AS STRING), '.local') WHEN 2 THEN concat('::FFFF:10.1.2.', CAST(event_id % 256 AS STRING)) ELSE 'example.org' END")
    return table(spark, sf_dir, "events").select("event_id", U.block_reason(target).alias("reason"))


def header_charset(spark: SparkSession, sf_dir: str) -> DataFrame:
    value = F.expr("CASE page_id % 4 WHEN 0 THEN 'text/html; charset=\"UTF-8\"' WHEN 1 THEN 'text/html;Charset=iso-8859-1; x=1' WHEN 2 THEN 'text/html' END")
    return table(spark, sf_dir, "pages").select("page_id", E.header_charset(value).alias("charset"), E.media_type(value).alias("media_type"), E.is_text_type(value).alias("is_text"))


def body_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encoding of page bytes: mark, header, document, default; and the binary tests."""
    mark = F.expr("CASE page_id % 5 WHEN 0 THEN X'EFBBBF' WHEN 1 THEN X'FFFE' WHEN 2 THEN X'25504446' ELSE X'' END")
    declared = F.expr("CASE WHEN page_id % 5 = 3 THEN 'text/html; charset=windows-1252' END")
    body = F.concat(mark, F.encode("html", "UTF-8"))
    rows = table(spark, sf_dir, "pages").select("page_id", body.alias("b"), declared.alias("d"))
    return rows.select("page_id", E.encoding(F.col("b"), F.col("d")).alias("encoding"), E.has_binary_signature(F.col("b")).alias("is_binary"), F.octet_length("b").alias("n_bytes"))


def byte_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts cut to 1000 bytes between characters, and whether that cut anything."""
    docs = table(spark, sf_dir, "documents")
    cut = E.cut_to_bytes(F.col("text"), F.lit(1000))
    return docs.select("doc_id", F.octet_length(cut).alias("n_bytes"), (F.octet_length("text") > 1000).alias("truncated"))


def dangling_tag(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole pages cut in the middle of what follows them, without the half tag or entity at the end."""
    tail = F.expr("CASE page_id % 3 WHEN 0 THEN '<a href=' WHEN 1 THEN 'x &am' ELSE '<p>done' END")
    return table(spark, sf_dir, "pages").select("page_id", E.without_dangling_tag(F.concat(F.col("html"), tail)).alias("html"))


def binary_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts, a third of them with many lost characters in front and a third with a zero character at the end."""
    text = F.when(F.col("doc_id") % 3 == 0, F.concat(F.repeat(F.lit("�"), 300), F.col("text"))).when(F.col("doc_id") % 3 == 1, F.concat(F.col("text"), F.lit("\x00"))).otherwise(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", E.looks_binary(text).alias("binary"), E.utf16_length(text).alias("utf16_length"))


def request_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The address that is fetched: normalized, rewritten and normalized again."""
    rows = table(spark, sf_dir, "pages").select("page_id", F.expr(_RAW_INPUT).alias("u"))
    return rows.select("page_id", U.request_target(F.col("u")).alias("t")).select("page_id", "t.url", "t.transformed", "t.error")


def ascii_hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hosts of pages under labels of other letters, in ASCII."""
    rows = table(spark, sf_dir, "pages").select("page_id", U.host(F.col("url")).alias("h"))
    name = F.when(F.col("page_id") % 2 == 0, F.concat(F.lit(" Bücher.Größe."), F.col("h"), F.lit(". "))).otherwise(F.concat(F.lit("пример."), F.col("h")))
    return rows.select("page_id", U.ascii_host(name).alias("host"))


_READ_INPUT = r"""CASE page_id % 10
    WHEN 0 THEN concat('http://Bücher.', h, '/a?b') WHEN 1 THEN concat('http://１２７．0。0.１/', page_id) WHEN 2 THEN concat('http://0x7f.1/', page_id)
    WHEN 3 THEN concat('https://2130706433:8080/', page_id) WHEN 4 THEN concat('http:\\\\', h, '\\a\\', page_id) WHEN 5 THEN concat(' http://', replace(h, 'e', '%65'), '/a b/ü?q=é', page_id)
    WHEN 6 THEN concat('http://a℀', h, '/') WHEN 7 THEN concat('http://012.1.2.', page_id % 8, '/') WHEN 8 THEN concat('http://134744072/', page_id)
    ELSE concat('ht\ttp:', h, '\n/x') END"""


def addresses_as_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses with hosts in other scripts, numbers, escapes and back slashes, judged as browsers read them."""
    rows = table(spark, sf_dir, "pages").select("page_id", U.host(F.col("url")).alias("h"))
    return rows.select("page_id", F.expr(_READ_INPUT).alias("u")).select("page_id", U.normalized(U.as_read(F.col("u"))).alias("n")).select("page_id", "n.url", "n.hostname", "n.error")


def v6_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocked IPv6 addresses, written with zones, brackets and capitals. The first kind holds the whole event_id, in four groups: one group has four digits at most."""
    groups = "regexp_replace(lpad(hex(event_id), 16, '0'), '(.{4})(?=.)', '$1:')"
    ip = F.expr(f"CASE event_id % 5 WHEN 0 THEN concat('fe80::', {groups}, '%eth0') WHEN 1 THEN '2606:4700::1111' WHEN 2 THEN concat('[FD00::', CAST(event_id % 1000 AS STRING), ']') WHEN 3 THEN '::1' ELSE concat('2a00:1450::', CAST(event_id % 1000 AS STRING)) END")
    return table(spark, sf_dir, "events").select("event_id", U.blocked_v6(ip).alias("blocked"))


_STATUS = "CASE event_id % 6 WHEN 0 THEN 429 WHEN 1 THEN 504 WHEN 2 THEN 415 WHEN 3 THEN 404 WHEN 4 THEN 200 ELSE 503 END"
_KIND = "CASE event_id % 5 WHEN 0 THEN 'invalid-url' WHEN 1 THEN 'dns' WHEN 2 THEN 'abort' WHEN 3 THEN 'other' END"


def error_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    status, kind = F.expr(_STATUS), F.expr(_KIND)
    return table(spark, sf_dir, "events").select("event_id", X.category(kind, status).alias("category"), X.code(status).alias("code"))


def error_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return error_category(spark, sf_dir).groupBy("category").agg(F.count(F.lit(1)).alias("n"))


def error_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Failures as public JSON: messages by kind, and of the details only those that may be shown."""
    kind = F.element_at(F.array(*[F.lit(k) for k in X.MESSAGES]), (F.col("event_id") % len(X.MESSAGES) + 1).cast("int"))
    text = X.message(kind, F.concat(F.lit("h"), F.col("user_id").cast("string")))
    reason, retry = F.when(F.col("event_id") % 2 == 0, "timeout").otherwise("private detail"), F.when(F.col("event_id") % 3 == 0, 60)
    body = X.payload(text, F.lit("https://e.org/"), F.lit("network"), F.lit(503), retry, F.lit(-1), reason)
    return table(spark, sf_dir, "events").select("event_id", body.alias("payload"))


def retry_after(spark: SparkSession, sf_dir: str) -> DataFrame:
    header = F.expr("CASE event_id % 4 WHEN 0 THEN CAST(event_id % 100 AS STRING) WHEN 1 THEN 'Wed, 31 Jan 2024 00:00:00 GMT' WHEN 2 THEN 'soon' END")
    return table(spark, sf_dir, "events").select("event_id", X.retry_after(header, F.col("ts").cast("timestamp")).alias("seconds"))


def owner_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    uid = F.col("user_id").cast("string")
    third = F.col("event_id") % 3
    key = X.owner_key(F.when(third == 0, uid), F.when(third == 1, uid), F.when(third == 1, F.lit("tok")), F.lit(None).cast("string"))
    return e.select("event_id", key.alias("owner_key"))


def issue_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    issues = F.array(F.col("event_type"), F.lit("url: required"), F.col("event_type"), F.lit(None).cast("string"))
    return table(spark, sf_dir, "events").select("event_id", X.issue_text(issues).alias("message"))


QUERIES = {f.__name__: f for f in (url_parts, host_counts, url_redact, url_rewrite, url_raw_text, url_display, url_normalize, host_header, ip_block, ip_networks, target_policy, header_charset, body_encoding, byte_cut, dangling_tag, binary_text, error_category, error_counts, error_payloads, request_targets, ascii_hosts, addresses_as_read, v6_block, retry_after, owner_keys, issue_text)}

_P = r"'^([a-zA-Z][a-zA-Z0-9+.-]*)://(?:([^/?#@]*)@)?([^/?#:]*)(?::([0-9]*))?([^?#]*)(\?[^#]*)?(#.*)?$'"
_DUCK_RAW = _RAW_INPUT.replace("STRING", "VARCHAR")
_DUCK_NORM = _NORMALIZE_INPUT.replace("STRING", "VARCHAR")
_DUCK_IP = _IP.replace("STRING", "VARCHAR")
_V4 = "split_part(ip, '.', 1)::BIGINT * 16777216 + split_part(ip, '.', 2)::BIGINT * 65536 + split_part(ip, '.', 3)::BIGINT * 256 + split_part(ip, '.', 4)::BIGINT"
_NETS = "(VALUES " + ", ".join(f"('{n}/{b}', {U.v4_range(n, b)[0]}, {U.v4_range(n, b)[1]})" for n, b in U.BLOCKED_V4) + ") AS t(network, low, high)"
_BASE = f"regexp_replace(regexp_replace(u, '[?#].*$', ''), '^(https?://[^/]*)$', '\\1/')"

SQL = {
    "url_parts": f"SELECT page_id, lower(regexp_extract(url, {_P}, 1)) AS scheme, lower(regexp_extract(url, {_P}, 3)) AS host, regexp_extract(url, {_P}, 5) AS path, regexp_extract(url, {_P}, 6) AS query, regexp_extract(url, {_P}, 7) AS fragment FROM pages",
    "host_counts": f"SELECT lower(regexp_extract(url, {_P}, 3)) AS host, count(*) AS n_pages, sum(strlen(html))::BIGINT AS html_bytes FROM pages GROUP BY 1",
    "url_redact": "SELECT page_id, regexp_replace(url, '[?#].*$', '') AS url FROM pages",
    "url_rewrite": f"""WITH i AS (SELECT page_id, url AS original, {_DUCK_RAW} AS u FROM pages), b AS (SELECT *, {_BASE} AS b FROM i)
        SELECT page_id, CASE page_id % 7
          WHEN 0 THEN 'https://raw.githubusercontent.com/org' || page_id || '/repo/main/docs/a.md'
          WHEN 1 THEN 'https://gist.githubusercontent.com/user/' || page_id || '/raw/my.notes.md'
          WHEN 2 THEN replace(b, '/-/blob/', '/-/raw/') WHEN 3 THEN replace(b, '/src/', '/raw/')
          WHEN 5 THEN replace(b, 'gist.github.com', 'gist.githubusercontent.com') ELSE u END AS url,
          page_id % 7 IN (0, 1, 2, 3, 5) AS transformed,
          CASE page_id % 7 WHEN 0 THEN 'github' WHEN 1 THEN 'github-gist' WHEN 2 THEN 'gitlab' WHEN 3 THEN 'bitbucket' WHEN 5 THEN 'github-gist' END AS platform FROM b""",
    "url_raw_text": f"""WITH i AS (SELECT page_id, {_DUCK_RAW} AS u FROM pages)
        SELECT page_id, u LIKE '%raw.githubusercontent.com%' OR regexp_matches(lower({_BASE}), '\\.(md|markdown|txt|json|yaml|yml|toml|xml|csv|rst|adoc|org)$') AS is_raw FROM i""",
    "url_display": f"""WITH i AS (SELECT page_id, {_DUCK_RAW} AS u FROM pages),
        s AS (SELECT page_id, regexp_replace(lower(regexp_extract(u, {_P}, 3)), '^www\\.', '') AS h, list_filter(string_split(regexp_extract(u, {_P}, 5), '/'), lambda x: x <> '') AS s FROM i),
        l AS (SELECT *, CASE WHEN length(s[-1]) > 20 THEN left(s[-1], 17) || '...' ELSE s[-1] END AS short FROM s)
        SELECT page_id, CASE WHEN len(s) = 0 THEN h WHEN h IN ('github.com', 'gitlab.com', 'bitbucket.org') AND len(s) >= 2 THEN h || '/' || s[1] || '/' || s[2]
          WHEN len(s) = 1 THEN h || '/' || short ELSE h || '/…/' || short END AS label, h = 'github.com' AND len(s) = 2 AS is_root FROM l""",
    "url_normalize": f"""WITH i AS (SELECT page_id, trim({_DUCK_NORM}) AS u FROM pages)
        SELECT page_id, CASE page_id % 8 WHEN 0 THEN replace(u, 'HTTPS://', 'https://') WHEN 2 THEN 'http://example.com/' || page_id WHEN 6 THEN 'https://example.com:8443/?q=' || page_id || '#f' END AS url,
          CASE page_id % 8 WHEN 0 THEN lower(regexp_extract(u, {_P}, 3)) WHEN 2 THEN 'example.com' WHEN 6 THEN 'example.com' END AS hostname,
          CASE page_id % 8 WHEN 1 THEN 'unsupported-protocol' WHEN 3 THEN 'credentials' WHEN 4 THEN 'blocked-ip' WHEN 5 THEN 'blocked-host' WHEN 7 THEN 'empty' END AS error FROM i""",
    "host_header": "SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'example.com' WHEN 1 THEN 'a' || page_id || '.org' WHEN 2 THEN '::1' END AS host FROM pages",
    "ip_block": f"WITH i AS (SELECT event_id, {_DUCK_IP} AS ip FROM events), n AS (SELECT *, {_V4} AS n FROM i) SELECT event_id, ip, EXISTS (SELECT 1 FROM {_NETS} WHERE n BETWEEN low AND high) AS blocked FROM n",
    "ip_networks": f"WITH i AS (SELECT {_DUCK_IP} AS ip FROM events), n AS (SELECT {_V4} AS n FROM i) SELECT network, count(*) AS n_addresses FROM n JOIN {_NETS} ON n BETWEEN low AND high GROUP BY network",
    "target_policy": "SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'cloud-metadata' WHEN 1 THEN 'blocked-suffix' WHEN 2 THEN 'blocked-ip' END AS reason FROM events",
    "header_charset": "SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'utf-8' WHEN 1 THEN 'iso-8859-1' END AS charset, CASE WHEN page_id % 4 < 3 THEN 'text/html' END AS media_type, true AS is_text FROM pages",
    "body_encoding": """SELECT page_id, CASE page_id % 5 WHEN 0 THEN 'utf-8' WHEN 1 THEN 'utf-16le' WHEN 3 THEN 'windows-1252'
          ELSE coalesce(nullif(lower(regexp_extract(left(html, 8000), 'charset\\s*=\\s*["'']?([^\\s"''/>;]+)', 1, 'i')), ''), 'utf-8') END AS encoding,
          page_id % 5 = 2 AS is_binary, (strlen(html) + CASE page_id % 5 WHEN 0 THEN 3 WHEN 1 THEN 2 WHEN 2 THEN 4 ELSE 0 END)::INTEGER AS n_bytes FROM pages""",
    "byte_cut": "SELECT doc_id, CASE WHEN strlen(text) <= 1000 THEN strlen(text) WHEN hex(encode(text)[1001:1001]) BETWEEN '80' AND 'BF' THEN 999 ELSE 1000 END::INTEGER AS n_bytes, strlen(text) > 1000 AS truncated FROM documents",
    "dangling_tag": "SELECT page_id, html || CASE page_id % 3 WHEN 0 THEN '' WHEN 1 THEN 'x ' ELSE '<p>done' END AS html FROM pages",
    "binary_text": "SELECT doc_id, doc_id % 3 < 2 AS binary, (length(text) + len(regexp_extract_all(text, '[\\x{10000}-\\x{10FFFF}]')) + CASE doc_id % 3 WHEN 0 THEN 300 WHEN 1 THEN 1 ELSE 0 END)::INTEGER AS utf16_length FROM documents",
    "error_category": f"""WITH i AS (SELECT event_id, {_STATUS} AS s, {_KIND} AS k FROM events)
        SELECT event_id, CASE WHEN k = 'invalid-url' THEN 'validation' WHEN k = 'abort' THEN 'aborted' WHEN k = 'dns' THEN 'network' WHEN s = 429 THEN 'rate_limited' WHEN s = 504 THEN 'timeout'
          WHEN s = 415 THEN 'binary_content' WHEN s >= 400 THEN 'upstream_http' WHEN k IS NOT NULL THEN 'internal' END AS category, CASE WHEN s >= 400 THEN 'HTTP_' || s END AS code FROM i""",
    "retry_after": """SELECT event_id, CASE event_id % 4 WHEN 0 THEN event_id % 100 WHEN 1 THEN greatest(0, floor(epoch(TIMESTAMP '2024-01-31 00:00:00'))::BIGINT - floor(epoch(ts))::BIGINT) ELSE 60 END::BIGINT AS seconds FROM events""",
    "owner_keys": "SELECT event_id, CASE event_id % 3 WHEN 0 THEN sha256(user_id::VARCHAR) WHEN 1 THEN sha256(user_id::VARCHAR || ':tok') ELSE 'default' END AS owner_key FROM events",
    "issue_text": "SELECT event_id, event_type || '; url: required' AS message FROM events",
}
SQL["request_targets"] = f"""WITH r AS ({SQL['url_rewrite']}), i AS (SELECT page_id, {_DUCK_RAW} AS u FROM pages)
    SELECT page_id, CASE WHEN page_id % 7 = 6 THEN regexp_replace(r.url, '^(https?://[^/?#]*)([?#]|$)', '\\1/\\2') ELSE r.url END AS url, transformed, NULL::VARCHAR AS error FROM r JOIN i USING (page_id)"""
SQL["ascii_hosts"] = f"SELECT page_id, CASE WHEN page_id % 2 = 0 THEN 'xn--bcher-kva.xn--grsse-kua.' ELSE 'xn--e1afmkfd.' END || lower(regexp_extract(url, {_P}, 3)) AS host FROM pages"
SQL["v6_block"] = "SELECT event_id, event_id % 5 IN (0, 2, 3) AS blocked FROM events"
SQL["error_payloads"] = "WITH m AS (SELECT event_id, user_id, CASE event_id % 11 " + " ".join("WHEN %d THEN %s" % (i, "'" + t.replace("%s", "h' || user_id || '") + "'") for i, t in enumerate(X.MESSAGES.values())) + """ END AS m FROM events),
    d AS (SELECT *, CASE WHEN event_id % 3 = 0 THEN '"retryAfter":60' END AS a, CASE WHEN event_id % 2 = 0 THEN '"reason":"timeout"' END AS b FROM m)
    SELECT event_id, '{"error":"' || m || '","url":"https://e.org/","category":"network","code":"HTTP_503","statusCode":503' || CASE WHEN a IS NULL AND b IS NULL THEN '' ELSE ',"details":{' || concat_ws(',', a, b) || '}' END || '}' AS payload FROM d"""
SQL["error_counts"] = f"SELECT category, count(*) AS n FROM ({SQL['error_category']}) GROUP BY category"
SQL["addresses_as_read"] = f"""WITH p AS (SELECT page_id, page_id % 10 AS k, lower(regexp_extract(url, {_P}, 3)) AS h FROM pages)
    SELECT page_id, CASE k WHEN 0 THEN 'http://xn--bcher-kva.' || h || '/a?b' WHEN 4 THEN 'http://' || h || '/a/' || page_id WHEN 5 THEN 'http://' || h || '/a%20b/%C3%BC?q=%C3%A9' || page_id
        WHEN 8 THEN 'http://8.8.8.8/' || page_id WHEN 9 THEN 'http://' || h || '/x' END AS url,
      CASE WHEN k IN (4, 5, 9) THEN h WHEN k = 0 THEN 'xn--bcher-kva.' || h WHEN k = 8 THEN '8.8.8.8' END AS hostname,
      CASE WHEN k IN (1, 2, 3, 7) THEN 'blocked-ip' WHEN k = 6 THEN 'invalid' END AS error FROM p"""
