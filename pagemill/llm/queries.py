"""The training-data queries ``opN_<name>`` and ``pipeline``, and the SQL equivalents of those that have one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from pagemill.llm import ann, clustering, lm_scoring, manifest, mixing, packing, pii, quality, sharding, simhash, substring_dedup, token_count, warc
from pagemill.llm.common import read_table
from pagemill.shipping import shipped


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_report(read_table(spark, sf_dir, "documents"))


def op2_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(read_table(spark, sf_dir, "documents"))


def op3_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scoring.scores(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(read_table(spark, sf_dir, "documents"))


def op5_token_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_count.token_counts(read_table(spark, sf_dir, "documents"))


def op6_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_report(read_table(spark, sf_dir, "documents"))


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shards(read_table(spark, sf_dir, "documents"))


def op8_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(read_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op9_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.removal_report(read_table(spark, sf_dir, "documents"))


def surrogate_key(spark: SparkSession) -> bytes:
    """The key of the surrogates, from the setting ``spark.pagemill.surrogate.key``; the queries and tests have an open one where it is unset."""
    return spark.conf.get("spark.pagemill.surrogate.key", "open key for tests").encode()


def op10_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.replacement_report(read_table(spark, sf_dir, "documents"), surrogate_key(spark))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest.verification_report(read_table(spark, sf_dir, "documents"))


def op12_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.revisit_report(read_table(spark, sf_dir, "pages"))


def op13_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustering.cluster_report(read_table(spark, sf_dir, "embeddings"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


OP1_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM documents),
win AS (SELECT doc_id, i, list_slice(w, i, i + 7) AS k FROM d, unnest(range(1, len(w) - 6)) AS t(i)),
dup AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, k) AS c FROM win) WHERE c > 1),
cov AS (SELECT doc_id, count(DISTINCT i + j) AS n FROM dup, unnest(range(0, 8)) AS t(j) GROUP BY doc_id),
c AS (
  SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
         len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
         coalesce(cov.n, 0)::BIGINT AS n_repeat_words, len(lines) AS n_lines
  FROM d LEFT JOIN cov USING (doc_id)),
f AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM c)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT (base_failed OR 100 * n_symbols > 20 * n_words OR word_chars < 2 * n_words OR word_chars > 15 * n_words
            OR (n_dup_lines >= 3 AND 100 * n_dup_lines > 30 * n_lines)) AS kept
FROM f
"""

OP6_SQL = r"""
WITH k AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
                  ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || ':' || md5(coalesce(text, '')) || ':' || (row_number() OVER (PARTITION BY doc_id, md5(coalesce(text, ''))) - 1)), 1, 15))::BIGINT AS u FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS z FROM k GROUP BY source),
w AS (SELECT *, CASE (row_number() OVER (ORDER BY source COLLATE "binary" NULLS LAST) - 1) % 3 WHEN 0 THEN 3.0 WHEN 1 THEN 1.0 ELSE 2.0 END::DOUBLE AS w FROM s),
r AS (SELECT *, 2.0::DOUBLE * z AS cap, 2.0::DOUBLE * z / w AS ratio FROM w),
l AS (SELECT *, (1.5::DOUBLE * sum(z) OVER () - coalesce(sum(cap) OVER b, 0)) / (sum(w) OVER () - coalesce(sum(w) OVER b, 0)) AS level FROM r
      WINDOW b AS (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
m AS (SELECT min_by(level, ratio) FILTER (WHERE level <= ratio) AS level FROM l),
t AS (SELECT l.source, z AS source_size, least(cap, m.level * w) AS target FROM l, m),
b AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS base FROM t),
c AS (SELECT k.doc_id, k.size, b.source_size, b.target, b.base, b.target - b.base * b.source_size AS rest,
             sum(k.size) OVER (PARTITION BY k.source, k.u) AS peers, sum(k.size) OVER (PARTITION BY k.source ORDER BY k.u RANGE UNBOUNDED PRECEDING) AS upto
      FROM k JOIN b ON k.source IS NOT DISTINCT FROM b.source)
SELECT doc_id, size, source_size, target, (size * (base + CASE WHEN 2 * upto - peers <= 2 * rest THEN 1 ELSE 0 END))::BIGINT AS taken FROM c
"""

OP9_SQL = r"""
WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS x FROM documents),
w AS (SELECT doc_id, i, x[i + 1 : i + 100] AS k FROM d, unnest(range(0, greatest(0, octet_length(x) - 99))) AS t(i)),
g AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY k ORDER BY doc_id, i) AS n FROM w) WHERE n > 1),
o AS (SELECT doc_id, i, CASE WHEN i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) <= 100 THEN 0 ELSE 1 END AS o FROM g),
s AS (SELECT doc_id, i, sum(o) OVER (PARTITION BY doc_id ORDER BY i) AS s FROM o),
span AS (SELECT doc_id, min(i) AS a, max(i) + 100 AS b FROM s GROUP BY doc_id, s),
p AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS c FROM span),
k AS (SELECT p.doc_id, string_agg(hex(x[c + 1 : a]), '' ORDER BY a) AS kept, max(b) AS last, sum(b - a) AS removed, count(*) AS n FROM p JOIN d USING (doc_id) GROUP BY p.doc_id)
SELECT d.doc_id, octet_length(x)::BIGINT AS n_bytes, coalesce(removed, 0)::BIGINT AS n_removed, coalesce(n, 0)::BIGINT AS n_spans,
       sha256(unhex(coalesce(kept, '') || hex(x[coalesce(last, 0) + 1 : octet_length(x)]))) AS kept_sha256
FROM d LEFT JOIN k USING (doc_id)
"""

_FIELD = lambda x: f"coalesce(strlen(({x})::VARCHAR) || ':' || ({x}), '-')"
_LEAF = lambda n: "sha256(" + " || ".join(_FIELD(x) for x in ("doc_id", "source", "lang", n, "text")) + ")"
_CRC32 = """xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(doc_id::VARCHAR, ''), lambda c: [ascii(c)::BIGINT, 0, 0, 0, 0, 0, 0, 0]))),
    lambda a, b: CASE WHEN xor(a, b) % 2 = 1 THEN xor(xor(a, b) // 2, 3988292384) ELSE xor(a, b) // 2 END))"""

OP11_SQL = f"""
WITH RECURSIVE d AS (SELECT doc_id, coalesce('=' || lang, '-') AS g, {_LEAF('n_chars')} AS leaf, CASE WHEN {_CRC32} % 7 = 0 THEN {_LEAF('n_chars + 1')} END AS other FROM documents),
l AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id, leaf) - 1 AS i, count(*) OVER (PARTITION BY g) AS n FROM d),
t AS (SELECT g, 0 AS lvl, i, leaf AS h, n FROM l
      UNION ALL SELECT g, lvl + 1, i // 2, sha256(string_agg(h, '' ORDER BY i)), (any_value(n) + 1) // 2 FROM t WHERE n > 1 GROUP BY g, lvl, i // 2),
s AS (SELECT g, h AS subroot, row_number() OVER (ORDER BY g COLLATE "binary") - 1 AS i, count(*) OVER () AS n FROM t WHERE n = 1),
u AS (SELECT 0 AS lvl, i, subroot AS h, n FROM s UNION ALL SELECT lvl + 1, i // 2, sha256(string_agg(h, '' ORDER BY i)), (any_value(n) + 1) // 2 FROM u WHERE n > 1 GROUP BY lvl, i // 2),
size AS (SELECT g, max(lvl) AS top FROM t GROUP BY g),
x AS (SELECT l.g, l.i, unnest(range(0, top)) AS lvl FROM l JOIN size USING (g)),
p AS (SELECT x.g, x.i, list(CASE WHEN b.h IS NULL THEN '-' WHEN (x.i >> x.lvl) % 2 = 1 THEN 'L' || b.h ELSE 'R' || b.h END ORDER BY x.lvl) AS p
      FROM x LEFT JOIN t b ON b.g = x.g AND b.lvl = x.lvl AND b.i = xor(x.i >> x.lvl, 1) GROUP BY x.g, x.i),
y AS (SELECT s.g, s.i, unnest(range(0, (SELECT max(lvl) FROM u))) AS lvl FROM s),
q AS (SELECT y.g, list(CASE WHEN b.h IS NULL THEN '-' WHEN (y.i >> y.lvl) % 2 = 1 THEN 'L' || b.h ELSE 'R' || b.h END ORDER BY y.lvl) AS q
      FROM y LEFT JOIN u b ON b.lvl = y.lvl AND b.i = xor(y.i >> y.lvl, 1) GROUP BY y.g),
f AS (SELECT doc_id, leaf, coalesce(other, leaf) AS start, subroot, (SELECT h FROM u WHERE n = 1) AS root, list_concat(coalesce(p, []), coalesce(q, [])) AS path
      FROM l JOIN s USING (g) LEFT JOIN p ON p.g = l.g AND p.i = l.i LEFT JOIN q ON q.g = l.g),
r AS (SELECT *, list_reduce(list_prepend(start, path), lambda a, b: sha256(CASE b[1] WHEN 'L' THEN b[2:] || a WHEN 'R' THEN a || b[2:] ELSE a END)) AS folded_root FROM f)
SELECT doc_id, leaf, subroot, root, sha256(array_to_string(list_transform(list_filter(path, lambda b: b <> '-'), lambda b: b[2:]), '')) AS proof_sha256, folded_root, folded_root = root AS verified FROM r
"""

OP12_SQL = """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
o AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first, row_number() OVER (PARTITION BY payload_digest ORDER BY page_id) AS n FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN payload_bytes >= 100 AND n > 1 THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND n > 1 THEN first END AS refers_to FROM o
"""


def _assigned(n: int) -> str:
    """One assignment of all vectors to the centroids c{n}."""
    return f"""a{n} AS MATERIALIZED (SELECT v.r, arg_min(c.k, struct_pack(d := list_sum(list_transform(list_zip(v.x, c.x), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT, k := c.k)) AS k,
         min(list_sum(list_transform(list_zip(v.x, c.x), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT) AS d FROM v, c{n} c GROUP BY v.r)"""


def _moved(n: int) -> str:
    """The centroids after assignment a{n}; empty ones stay."""
    return f"""m{n} AS MATERIALIZED (SELECT k, list((s - ((s % q) + q) % q) // q ORDER BY j) AS x FROM (SELECT a.k, j, sum(x[j])::BIGINT AS s, count(*)::BIGINT AS q FROM a{n} a JOIN v USING (r), unnest(range(1, 65)) AS t(j) GROUP BY a.k, j) GROUP BY k),
    c{n + 1} AS MATERIALIZED (SELECT c.k, coalesce(m.x, c.x) AS x FROM c{n} c LEFT JOIN m{n} m USING (k))"""


OP13_SQL = f"""
WITH v AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda y: floor(1024 * y::DOUBLE)::BIGINT) AS x FROM embeddings
           WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda y: isfinite(y))) = 64),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('3:' || vec_id), x) - 1 AS k, x FROM v ORDER BY sha256('3:' || vec_id), x LIMIT 8),
{", ".join(_assigned(n) + ", " + _moved(n) for n in range(10))}, {_assigned(10)}
SELECT vec_id, a.k::INTEGER AS cluster, d AS distance, (sum(d) OVER (PARTITION BY a.k))::BIGINT AS cluster_inertia, (sum(d) OVER ())::BIGINT AS inertia, sha256(array_to_string(c.x, ',')) AS centroid_sha256
FROM a10 a JOIN v USING (r) JOIN c10 c ON a.k = c.k
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_rules": op1_quality_rules,
    "op2_simhash_near_dedup": op2_simhash_near_dedup,
    "op3_lm_scoring": op3_lm_scoring,
    "op4_packing": op4_packing,
    "op5_token_count": op5_token_count,
    "op6_source_mixing": op6_source_mixing,
    "op7_sharding": op7_sharding,
    "op8_nearest_neighbours": op8_nearest_neighbours,
    "op9_suffix_array_dedup": op9_suffix_array_dedup,
    "op10_pii_surrogates": op10_pii_surrogates,
    "op11_merkle_manifest": op11_merkle_manifest,
    "op12_warc_revisits": op12_warc_revisits,
    "op13_centroid_clustering": op13_centroid_clustering,
    "pipeline": pipeline,
}

SQL: dict[str, str] = {"op1_quality_rules": OP1_SQL, "op6_source_mixing": OP6_SQL, "op9_suffix_array_dedup": OP9_SQL, "op11_merkle_manifest": OP11_SQL, "op12_warc_revisits": OP12_SQL, "op13_centroid_clustering": OP13_SQL}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: shipped(query) for name, query in QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
