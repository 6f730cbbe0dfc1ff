"""The numbered operators as queries over the given tables, and their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, ball_tree, byte_dedup, divergence, exact_dedup, html_extract, language_id, media, mixing, near_dedup, packing, substring_dedup, url_filter
from .staging import Stage, table

#: Fixed values of the contract: (action, host, path).
URL_RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)


def op7_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return mixing.mix(docs).select("doc_id", "size", "source_size", "target", "taken")


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return url_filter.judge(pages, URL_RULES, url_filter.link_edges(pages))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("held_out", language_id.held_out())
    model = language_id.train(docs.filter(language_id.learned()))
    return language_id.predict(docs.select("doc_id", "held_out", "text"), model).drop("text")


def op1_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(table(spark, sf_dir, "pages"))


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    stage = Stage(spark, "packing")
    parts = stage.put("pieces", packing.pieces(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json")))
    return packing.pack(parts, stage)


def op4_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.classes(table(spark, sf_dir, "documents"))


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.digests(table(spark, sf_dir, "documents"))


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_dedup.digests(table(spark, sf_dir, "documents"))


def op3_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.stored_and_read(table(spark, sf_dir, "documents"))


def op2_additive_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


def op11_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.dedup(spark, f"{sf_dir}/documents.parquet")


def op12_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ball_tree.cluster(table(spark, sf_dir, "embeddings"))


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


QUERIES = {
    "op13_source_divergence": op13_source_divergence,
    "op12_centroid_clustering": op12_centroid_clustering,
    "op11_exact_dedup": op11_exact_dedup,
    "op2_additive_ann": op2_additive_ann,
    "op3_media_columns": op3_media_columns,
    "op6_suffix_dedup": op6_suffix_dedup,
    "op8_substring_dedup": op8_substring_dedup,
    "op4_near_dedup": op4_near_dedup,
    "op5_best_fit_packing": op5_best_fit_packing,
    "op1_html_extract": op1_html_extract,
    "op10_language_id": op10_language_id,
    "op7_source_mix": op7_source_mix,
    "op9_url_filter": op9_url_filter,
}

def _clustering_sql(k: int = 8, rounds: int = 10) -> str:
    """Rounds written out one after the other: a recursive query can't hold the sums."""
    nearest = lambda c: f"""SELECT v.id, v.q, arg_min(c.c, (list_sum(list_transform(list_zip(v.q, c.q), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT, c.c)) AS c,
         min(list_sum(list_transform(list_zip(v.q, c.q), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT) AS d FROM v, {c} c GROUP BY v.id, v.q"""  # noqa: E731
    parts = [f"""WITH v AS MATERIALIZED (SELECT vec_id AS id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS q FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64),
c0 AS MATERIALIZED (SELECT ROW_NUMBER() OVER (ORDER BY sha256('3:' || id)) - 1 AS c, q FROM v QUALIFY c < {k})"""]
    for i in range(rounds):
        parts.append(f"""a{i} AS MATERIALIZED ({nearest(f'c{i}')}),
s{i} AS (SELECT c, i, sum(x) AS s, count(*) AS n FROM (SELECT c, unnest(q) AS x, unnest(range(64)) AS i FROM a{i}) GROUP BY c, i),
c{i + 1} AS MATERIALIZED (SELECT c.c, COALESCE(m.q, c.q) AS q FROM c{i} c LEFT JOIN (SELECT c, list((floor(s::DOUBLE / n) - (floor(s::DOUBLE / n) * n > s)::INT)::BIGINT ORDER BY i) AS q FROM s{i} GROUP BY c) m USING (c))""")
    return ",\n".join([*parts, f"z AS MATERIALIZED ({nearest(f'c{rounds}')})"]) + f"""
SELECT z.id AS vec_id, z.c::INT AS cluster, z.d AS distance, CAST(SUM(z.d) OVER (PARTITION BY z.c) AS BIGINT) AS cluster_inertia, CAST(SUM(z.d) OVER () AS BIGINT) AS inertia,
       sha256(array_to_string(c.q, ',')) AS centroid_sha256
FROM z JOIN c{rounds} c ON z.c = c.c"""


ORACLE = {
    "op13_source_divergence": r"""
WITH d AS MATERIALIZED (
  SELECT row_number() OVER () AS i, COALESCE(lang, '') AS lang, COALESCE(source, '') AS source,
         regexp_extract_all(translate(COALESCE(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents),
w AS MATERIALIZED (SELECT i, lang, source, term, count(*) AS n FROM (SELECT i, lang, source, unnest(terms) AS term FROM d) GROUP BY ALL),
kept AS MATERIALIZED (SELECT lang, term FROM w GROUP BY ALL HAVING count(*) >= 3),
grp AS (SELECT DISTINCT lang, source FROM d),
cnt AS (SELECT lang, source, term, sum(n) AS n FROM w JOIN kept USING (lang, term) GROUP BY ALL),
full_ AS MATERIALIZED (SELECT g.lang, g.source, k.term, COALESCE(c.n, 0)::HUGEINT AS n FROM grp g JOIN kept k USING (lang) LEFT JOIN cnt c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
own AS MATERIALIZED (SELECT lang, source, term, n, (1 + (1000000000 * (n + 1)) // (sum(n) OVER (PARTITION BY lang, source) + count(*) OVER (PARTITION BY lang, source)))::BIGINT AS p FROM full_),
lng AS MATERIALIZED (SELECT lang, term, (1 + (1000000000 * (n + 1)) // (sum(n) OVER (PARTITION BY lang) + count(*) OVER (PARTITION BY lang)))::BIGINT AS p FROM (SELECT lang, term, sum(n) AS n FROM full_ GROUP BY ALL)),
pairs AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // b.p) AS value FROM own a JOIN own b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
every AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, COALESCE(p.value, 0)::BIGINT AS value FROM grp a JOIN grp b ON a.lang = b.lang AND a.source <> b.source
          LEFT JOIN pairs p ON p.lang = a.lang AND p.source = a.source AND p.item = b.source
          UNION ALL
          SELECT o.lang, o.source, 'term', o.term, (((o.p - l.p) * (o.p - l.p)) // l.p)::BIGINT FROM own o JOIN lng l ON o.lang = l.lang AND o.term = l.term WHERE o.n > 0 AND o.p > l.p)
SELECT lang, source, part, item, value, (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item))::INT AS rank FROM every QUALIFY part = 'pair' OR rank <= 200""",
    "op12_centroid_clustering": _clustering_sql(),
    "op11_exact_dedup": """
SELECT doc_id, MAX(doc_id) OVER same AS keep_id, COUNT(*) OVER same AS group_size, doc_id = MAX(doc_id) OVER same AS kept, sha256(COALESCE(text, '')) AS text_sha256
FROM documents WINDOW same AS (PARTITION BY COALESCE(text, ''))""",
    "op7_source_mix": r"""
WITH d AS (
  SELECT doc_id, source, CAST(COALESCE(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         md5('mix:' || COALESCE(CAST(doc_id AS VARCHAR), 'null')) AS k
  FROM documents),
s AS (SELECT source, CAST(SUM(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, CASE (ROW_NUMBER() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 WHEN 0 THEN 3.0::DOUBLE WHEN 1 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END AS weight FROM s),
c AS (SELECT *, source_size * 2.0::DOUBLE AS cap, source_size * 2.0::DOUBLE / weight AS full_at, SUM(source_size) OVER () * 1.5::DOUBLE AS budget FROM w),
p AS (SELECT *, COALESCE(SUM(cap) OVER (ORDER BY full_at, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS spent,
             SUM(weight) OVER (ORDER BY full_at, source ASC NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open_w FROM c),
x AS (SELECT *, (budget - spent) / open_w AS lv FROM p),
t AS (SELECT source, source_size, LEAST(cap, COALESCE((MAX(CASE WHEN lv <= full_at THEN lv END) OVER ()) * weight, cap)) AS target FROM x),
o AS (SELECT d.doc_id, d.size, t.source_size, t.target, CAST(FLOOR(t.target) AS BIGINT) AS b,
             COALESCE(SUM(d.size) OVER (PARTITION BY d.source ORDER BY d.k, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
e AS (SELECT *, CASE WHEN source_size > 0 THEN b // source_size ELSE 0 END AS n FROM o)
SELECT doc_id, size, source_size, target,
       CAST(n * size + GREATEST(0, LEAST(size, b - n * source_size - before)) AS BIGINT) AS taken
FROM e""",
    "op9_url_filter": r"""
WITH RECURSIVE u AS (
  SELECT page_id, url, html, COALESCE(contains(url, '://'), false) AS ok,
         CASE WHEN contains(url, '://') THEN translate(regexp_extract(url, '^(?s:.*?)://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE '' END AS host,
         CASE WHEN contains(url, '://') THEN regexp_extract(url, '^(?s:.*?)://[^/?#]*([^?#]*)', 1) ELSE '' END AS path,
         CASE WHEN contains(url, '://') THEN regexp_extract(url, '^(?s:.*?)://[^/?#]*([^#]*)', 1) ELSE '' END AS rest
  FROM pages),
k AS (SELECT *, CASE WHEN ok THEN host || rest END AS key FROM u),
raw AS (
  SELECT key AS src, url, unnest(list_concat(
    list_transform(regexp_extract_all(html, '(?i)<link\b[^>]*\brel\s*=\s*["'']?canonical\b[^>]*>'), lambda t: regexp_extract(t, '(?i)\bhref\s*=\s*["'']?([^"''\s>]+)', 1)),
    list_transform(regexp_extract_all(html, '(?i)<meta\b[^>]*\bhttp-equiv\s*=\s*["'']?refresh\b[^>]*>'), lambda t: regexp_extract(t, '(?i)\burl\s*=\s*["'']?([^"''\s>]+)', 1)))) AS t
  FROM k WHERE ok),
full_url AS (
  SELECT src, CASE WHEN contains(t, '://') THEN t
                   WHEN t LIKE '//%' THEN regexp_replace(regexp_extract(url, '^((?s:.*?)://)', 1), '//$', '') || t
                   WHEN t LIKE '/%' THEN regexp_extract(url, '^((?s:.*?)://[^/?#]*)', 1) || t END AS t
  FROM raw),
dst AS (
  SELECT src, translate(regexp_extract(t, '^(?s:.*?)://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')
         || regexp_extract(t, '^(?s:.*?)://[^/?#]*([^#]*)', 1) AS dst
  FROM full_url WHERE t IS NOT NULL),
e AS (SELECT src AS a, dst AS b FROM dst WHERE src <> dst UNION SELECT dst, src FROM dst WHERE src <> dst),
reach(a, b) AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM reach r JOIN e ON r.b = e.a),
rules(action, h, p) AS (VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')),
seen AS (SELECT DISTINCT b AS node, regexp_extract(b, '^[^/?]*') AS nh FROM reach),
node_fit AS (SELECT node, arg_max(action, length(h || p) * 2 + (action = 'allow')::INT) AS action
             FROM seen, rules WHERE (nh = h OR ends_with(nh, '.' || h)) AND starts_with(regexp_extract(substr(node, length(nh) + 1), '^([^?#]*)', 1), p) GROUP BY node),
cls AS (SELECT r.a AS node, bool_or(f.action = 'allow') AS al, bool_or(f.action = 'block') AS bl
        FROM reach r JOIN node_fit f ON r.b = f.node GROUP BY r.a),
fit AS (SELECT page_id, arg_max(h || p, length(h || p) * 2 + (action = 'allow')::INT) AS rule, arg_max(action, length(h || p) * 2 + (action = 'allow')::INT) AS action
        FROM k, rules WHERE ok AND (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY page_id)
SELECT k.page_id, k.host, k.path, fit.rule,
       COALESCE(fit.action, CASE WHEN cls.bl AND NOT COALESCE(cls.al, false) THEN 'block' ELSE 'allow' END) AS verdict
FROM k LEFT JOIN fit USING (page_id) LEFT JOIN cls ON k.key = cls.node""",
}
