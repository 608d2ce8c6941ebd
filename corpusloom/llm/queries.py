"""The registered queries of this package: each applies an operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm import (
    best_fit,
    bin_slack,
    bpe_concat,
    collision_counting,
    filter_audit,
    jaccard_voronoi,
    line_alignment,
    nb_toxicity,
    pii_votes,
    run_index,
    secret_forest,
    threshold_negatives,
    threshold_topk,
)
from corpusloom.llm.common import table

QUERIES: dict = {}
ORACLES: dict = {}

ORACLES["op7_threshold_topk"] = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
q AS (SELECT * FROM v WHERE vec_id % 50 = 0),
s AS (SELECT q.vec_id AS query_id, v.vec_id, CAST(list_inner_product(CAST(q.e AS DOUBLE[]), CAST(v.e AS DOUBLE[])) AS BIGINT) AS score
  FROM q JOIN v ON q.vec_id <> v.vec_id AND len(q.e) = len(v.e))
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS "rank", vec_id, score FROM s
QUALIFY "rank" <= 5
"""


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_fit.pack(table(spark, sf_dir, "documents"))


@query
def op2_run_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_index.digests(table(spark, sf_dir, "documents"))


@query
def op3_nb_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nb_toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op4_secret_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_forest.digests(table(spark, sf_dir, "documents"))


@query
def op5_collision_counting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collision_counting.search(table(spark, sf_dir, "embeddings"))


@query
def op6_line_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_alignment.digests(table(spark, sf_dir, "documents"))


@query
def op7_threshold_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return threshold_topk.search(table(spark, sf_dir, "embeddings"))


@query
def op8_bpe_concat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_concat.digests(table(spark, sf_dir, "documents"))


@query
def op9_pii_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii_votes.digests(table(spark, sf_dir, "documents"))


@query
def op10_jaccard_voronoi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_voronoi.classes(table(spark, sf_dir, "documents"))


ORACLES["op10_jaccard_voronoi"] = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN CAST([] AS VARCHAR[]) WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
  ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i : i + 4], ' ')) END) AS sh FROM d),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 75 * (a.n + b.n - c)),
r(node, other) AS (SELECT doc_id, doc_id FROM d UNION SELECT r.node, l.y FROM r JOIN l ON l.x = r.other)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, (SELECT min(other) FROM r WHERE r.node = d.doc_id) AS component_id
FROM d LEFT JOIN n ON n.doc_id = d.doc_id
"""


@query
def op11_threshold_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return threshold_negatives.mine(table(spark, sf_dir, "embeddings").withColumn("label", label))


ORACLES["op11_threshold_negatives"] = """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
  list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, r.vec_id, a.label = r.label AS same, CAST(list_inner_product(a.e, r.e) AS BIGINT) AS score
  FROM v a JOIN v r ON a.vec_id <> r.vec_id AND len(a.e) = len(r.e) WHERE a.vec_id % 50 = 0),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) AS INTEGER) AS "rank",
  vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
QUALIFY "rank" <= 3
"""


@query
def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(filter_audit.masks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")))


ORACLES["op12_filter_audit"] = r"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t,
    list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
f AS (SELECT t, min(doc_id) AS first FROM d GROUP BY t),
m AS (SELECT part, len(w) < 200 AS a, 100 * len(list_distinct(w)) < 50 * len(w) AS b,
    100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t) AS c, regexp_matches(t, '[#$%&*|]') AS d, coalesce(doc_id > first, false) AS e,
    doc_id IN (SELECT doc_id FROM labels WHERE quality = 1 AND doc_id IS NOT NULL) AS good,
    doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1 AND doc_id IS NOT NULL) AS toxic
  FROM d JOIN f USING (t)),
g AS (SELECT part, (CASE WHEN a THEN 'A' ELSE '' END) || (CASE WHEN b THEN 'B' ELSE '' END) || (CASE WHEN c THEN 'C' ELSE '' END)
    || (CASE WHEN d THEN 'D' ELSE '' END) || (CASE WHEN e THEN 'E' ELSE '' END) AS fails, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic, count(*) AS n
  FROM m GROUP BY ALL),
l AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
o AS (SELECT p.x || q.x || r.x || s.x || u.x AS filter_order FROM l p JOIN l q ON q.x <> p.x JOIN l r ON r.x NOT IN (p.x, q.x)
  JOIN l s ON s.x NOT IN (p.x, q.x, r.x) JOIN l u ON u.x NOT IN (p.x, q.x, r.x, s.x)),
c AS (SELECT part, filter_order, step, filter_order[step] AS x,
    sum(n) FILTER (before = '' AND NOT contains(fails, filter_order[step])) AS kept,
    sum(n) FILTER (before = '' AND contains(fails, filter_order[step])) AS removed,
    sum(n) FILTER (before <> '' AND contains(fails, filter_order[step])) AS redundant,
    sum(n) FILTER (fails = filter_order[step]) AS unique_fails,
    sum(n) FILTER (good AND before = '' AND contains(fails, filter_order[step])) AS good_lost,
    sum(n) FILTER (toxic AND before = '' AND contains(fails, filter_order[step])) AS toxic_lost
  FROM (SELECT *, regexp_replace(filter_order[1 : step - 1], '[^' || fails || '-]', '', 'g') AS before
    FROM g, o, (SELECT unnest(range(1, 6)) AS step))
  GROUP BY ALL)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(coalesce(kept, 0) AS BIGINT) AS kept, CAST(coalesce(removed, 0) AS BIGINT) AS removed,
  CAST(coalesce(redundant, 0) AS BIGINT) AS redundant, CAST(coalesce(unique_fails, 0) AS BIGINT) AS unique_fails,
  CAST(coalesce(good_lost, 0) AS BIGINT) AS good_lost, CAST(coalesce(toxic_lost, 0) AS BIGINT) AS toxic_lost,
  CAST(coalesce(sum(removed) OVER (PARTITION BY part, x), 0) AS BIGINT) AS shapley
FROM c
"""


@query
def op13_bin_slack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bin_slack.pack(table(spark, sf_dir, "documents"))
