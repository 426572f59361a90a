"""Registered queries: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import (
    ann, html_text, middle, mixing, neardup, negatives, packing, pii, quality, repair, tokencount, toxicity, vecdup,
)
from tidemark.session import shared_folder, ship_package

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def wrap(fn: Callable[[SparkSession, str], DataFrame]):
        def run(spark: SparkSession, sf: str) -> DataFrame:
            spark.conf.set("spark.sql.session.timeZone", "UTC")
            ship_package(spark)
            return fn(spark, sf)

        QUERIES[name] = run
        if sql is not None:
            SQL[name] = sql
        return fn

    return wrap


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


@query("op1_best_fit_packing")
def op1_best_fit_packing(spark: SparkSession, sf: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf, "documents"))


@query("op2_crf_toxicity")
def op2_crf_toxicity(spark: SparkSession, sf: str) -> DataFrame:
    return toxicity.toxic_scores(table(spark, sf, "documents"), table(spark, sf, "labels"))


@query("op3_crf_pii")
def op3_crf_pii(spark: SparkSession, sf: str) -> DataFrame:
    return pii.personal_data(table(spark, sf, "documents"))


@query("op4_ordinal_quality")
def op4_ordinal_quality(spark: SparkSession, sf: str) -> DataFrame:
    return quality.graded_texts(table(spark, sf, "documents"), quality.ratings(table(spark, sf, "labels")))


@query("op5_layout_text")
def op5_layout_text(spark: SparkSession, sf: str) -> DataFrame:
    return html_text.visible_text(table(spark, sf, "pages"))


# The same mix in one statement: targets by water filling, expected copies, ranks by odds, two closers.
_MIX_SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size
  FROM documents),
s0 AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
s1 AS (
  SELECT *, [3.0::DOUBLE, 1.0, 2.0][(row_number() OVER (ORDER BY source IS NULL, encode(source)) - 1) % 3 + 1] AS w,
    CAST(2.0 AS DOUBLE) * source_size AS cap
  FROM s0),
s2 AS (
  SELECT *, CAST(1.5 AS DOUBLE) * sum(source_size) OVER () AS total,
    coalesce(sum(cap) OVER (rise ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS capped,
    sum(w) OVER (rise ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open_w
  FROM s1 WINDOW rise AS (ORDER BY cap / w, cap, source IS NULL, encode(source))),
s3 AS (
  SELECT *, max(CASE WHEN (total - capped) / open_w * w <= cap THEN (total - capped) / open_w END) OVER () AS level FROM s2),
src AS (SELECT source, source_size, least(cap, coalesce(level * w, cap)) AS target FROM s3),
t0 AS (
  SELECT d.*, source_size, target, floor((1.0::DOUBLE + size / (size + 200.0::DOUBLE)) * 64) / 64.0::DOUBLE AS tilt
  FROM d JOIN src ON d.source IS NOT DISTINCT FROM src.source),
k0 AS (SELECT source, tilt, CAST(sum(size) AS DOUBLE) AS words, max(target) AS goal FROM t0 GROUP BY source, tilt),
k1 AS (
  SELECT source, tilt, goal,
    coalesce(sum(words) OVER (up ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS held,
    sum(words * tilt) OVER (up ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest
  FROM k0 WINDOW up AS (PARTITION BY source ORDER BY tilt DESC)),
k2 AS (SELECT source, tilt, CASE WHEN rest > 0 THEN (goal - 2.0::DOUBLE * held) / rest ELSE 0 END AS c FROM k1),
k AS (SELECT source, arg_max(c, tilt) AS c FROM k2 WHERE c * tilt <= 2.0::DOUBLE + 1e-9::DOUBLE GROUP BY source),
t1 AS (
  SELECT t0.*, CASE WHEN source_size > 0 THEN least(2.0::DOUBLE, c * tilt) ELSE 0 END AS due
  FROM t0 JOIN k ON t0.source IS NOT DISTINCT FROM k.source),
t2 AS (
  SELECT *, floor(due + 1e-9::DOUBLE) AS whole, greatest(0, due - floor(due + 1e-9::DOUBLE)) AS p,
    (CAST('0x' || substr(md5('17|' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 12) AS BIGINT) + 0.5::DOUBLE) / 281474976710656.0::DOUBLE AS u
  FROM t1),
t3 AS (SELECT *, CASE WHEN p > 1e-9::DOUBLE AND size > 0 THEN (u / (1 - u)) * ((1 - p) / p) END AS q FROM t2),
t4 AS (SELECT *, q / (1 + q) AS ord, sum(whole * size) OVER (PARTITION BY source) AS sure FROM t3),
t5 AS (
  SELECT *, ord IS NOT NULL AND
    sum(size) FILTER (WHERE ord IS NOT NULL) OVER (PARTITION BY source ORDER BY ord NULLS LAST, doc_id, size ROWS UNBOUNDED PRECEDING) <= target - sure AS p0
  FROM t4),
g1 AS (SELECT source, max(target) - sum(size * (whole + p0::INT)) AS gap FROM t5 GROUP BY source),
n1 AS (
  SELECT t5.source, arg_min(doc_id, (abs(size - gap), ord, doc_id)) AS last_id FROM t5 JOIN g1 ON t5.source IS NOT DISTINCT FROM g1.source
  WHERE ord IS NOT NULL AND NOT p0 AND abs(size - gap) < gap GROUP BY t5.source),
t6 AS (
  SELECT t5.*, p0 OR coalesce(t5.doc_id = n1.last_id AND ord IS NOT NULL, false) AS p1
  FROM t5 LEFT JOIN n1 ON t5.source IS NOT DISTINCT FROM n1.source),
g2 AS (SELECT source, max(target) - sum(size * (whole + p1::INT)) AS gap FROM t6 GROUP BY source),
n2 AS (
  SELECT t6.source, arg_min(doc_id, (abs(size - gap), ord, doc_id)) AS last_id FROM t6 JOIN g2 ON t6.source IS NOT DISTINCT FROM g2.source
  WHERE ord IS NOT NULL AND NOT p1 AND abs(size - gap) < gap GROUP BY t6.source),
t7 AS (
  SELECT t6.*, CAST(whole + (p1 OR coalesce(t6.doc_id = n2.last_id AND ord IS NOT NULL, false))::INT AS BIGINT) AS copies
  FROM t6 LEFT JOIN n2 ON t6.source IS NOT DISTINCT FROM n2.source)
SELECT doc_id, size, source_size, round(target, 6) AS target, source, copies, CAST(size * copies AS BIGINT) AS taken FROM t7
"""


@query("op6_pareto_mix", _MIX_SQL)
def op6_pareto_mix(spark: SparkSession, sf: str) -> DataFrame:
    return mixing.pareto_mix(table(spark, sf, "documents"))


@query("op7_repair_shards")
def op7_repair_shards(spark: SparkSession, sf: str) -> DataFrame:
    path = f"{shared_folder(spark).rstrip('/')}/shards-{uuid.uuid4().hex}"
    repair.encode_shards(table(spark, sf, "documents"), path)
    return repair.read_shards(spark, path)


@query("op8_weighted_minhash")
def op8_weighted_minhash(spark: SparkSession, sf: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf, "documents"))


@query("op9_adaptive_scan")
def op9_adaptive_scan(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "embeddings")
    return ann.nearest(rows, rows.where("vec_id % 50 = 0"))


# Every pair of a label, and the closure of the links.
_LINKS_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS x,
    label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
      AND len(list_filter(embedding, lambda e: e IS NULL OR isnan(e) OR isinf(e))) = 0
      AND len(list_filter(embedding, lambda e: e <> 0)) > 0 AS ok
  FROM embeddings),
l AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.x) = len(b.x)
  WHERE a.ok AND b.ok AND list_cosine_similarity(a.x, b.x) >= 0.98),
r AS (SELECT vec_id, vec_id AS seen FROM v UNION SELECT r.vec_id, l.b FROM r JOIN l ON r.seen = l.a)
SELECT r.vec_id, (SELECT count(*) FROM l WHERE l.a = r.vec_id) AS n_links, min(seen) AS component_id, min(seen) = r.vec_id AS kept
FROM r GROUP BY r.vec_id
"""


@query("op10_sorted_projections", _LINKS_SQL)
def op10_sorted_projections(spark: SparkSession, sf: str) -> DataFrame:
    return vecdup.near_vectors(table(spark, sf, "embeddings"))


# The transformation in one statement: units and borders by regular expressions over whole texts.
_MIDDLE_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), 'null')) AS h FROM documents),
u AS (
  SELECT *, regexp_extract_all(text, '(?s)[A-Za-z]+|[^A-Za-z]') AS units,
    [CAST('0x' || substr(h, 8 * i + 1, 8) AS BIGINT) FOR i IN [0, 1, 2, 3]] AS r
  FROM d),
c AS (
  SELECT *, CAST(len(units) AS BIGINT) AS n,
    CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR r[3] % 100 >= 90 THEN 'plain'
      WHEN r[4] % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
  FROM u),
p AS (
  SELECT *, array_to_string(units[1:least(r[1] % (n + 1), r[2] % (n + 1))], '') AS a,
    array_to_string(units[least(r[1] % (n + 1), r[2] % (n + 1)) + 1:greatest(r[1] % (n + 1), r[2] % (n + 1))], '') AS b,
    array_to_string(units[greatest(r[1] % (n + 1), r[2] % (n + 1)) + 1:], '') AS c
  FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN CAST(length(a) AS BIGINT) END AS prefix_chars,
  CASE WHEN form <> 'plain' THEN CAST(length(b) AS BIGINT) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || a || '<S>' || c || '<M>' || b
    ELSE '<S>' || c || '<P>' || a || '<M>' || b END) AS output_sha256,
  sha256(text) AS restored_sha256
FROM p
"""


@query("op11_sorted_middle", _MIDDLE_SQL)
def op11_sorted_middle(spark: SparkSession, sf: str) -> DataFrame:
    return middle.fill_in_middle(table(spark, sf, "documents"))


# Every pair of an anchor and a row, twice.
_NEGATIVES_SQL = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    [CAST(floor(CAST(256 AS DOUBLE) * CAST(x AS DOUBLE)) AS DOUBLE) FOR x IN embedding] AS x
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda e: e IS NULL OR isnan(e) OR isinf(e))) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same, CAST(list_dot_product(a.x, b.x) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.x) = len(b.x) WHERE a.vec_id % 100 = 0),
p AS (
  SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5)
SELECT p.anchor_id, p.positive_id, s.other_id AS negative_id, p.positive_score, s.score AS negative_score,
  CAST(row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.other_id) AS INTEGER) AS rank
FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same
  AND 80 * p.positive_score <= 100 * s.score AND s.score <= p.positive_score
QUALIFY rank <= 5
"""


@query("op12_segment_negatives", _NEGATIVES_SQL)
def op12_segment_negatives(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "embeddings")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.hard_negatives(rows.withColumn("label", moved), F.col("vec_id") % 100 == 0)


@query("op13_transducer_counts")
def op13_transducer_counts(spark: SparkSession, sf: str) -> DataFrame:
    return tokencount.count_tokens(table(spark, sf, "documents"))
