"""Search tags over ``documents``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.values import each
from corpusloom.operators import logs as L
from corpusloom.operators import tags as T
from corpusloom.operators.search import validity_status
from corpusloom.plans.catalog import ctes, load, query
from corpusloom.plans.logs import LOGS, METRICS, ask_logs

# words of the test texts stand in for a dictionary
WORDS = ["the", "tion", "eau", "ment", "und", "ción", "of", "einen", "que", "Lorem"]
CATEGORIES = {"src1": ["one", "first"], "src2": ["two"]}

PHRASE = r"[、。・（）()\[\]「」『』\s]+"
TITLE = "split_part(text, chr(10), 1)"
PHRASES = f"""ti AS (SELECT doc_id, replace(regexp_replace(regexp_replace({TITLE}, '^[0-9-]+_', ''), '^No\\.[0-9-]+\\s*', ''), '_', ' ') AS t FROM documents),
ph AS (SELECT doc_id, [t] || list_filter(string_split_regex(t, '[、。・（）()\\[\\]「」『』\\s]+'), lambda p: length(p) BETWEEN 2 AND 30) AS raw FROM ti),
phrases AS (SELECT doc_id, list_filter(list_transform(raw, lambda v: trim(regexp_replace(v, '\\s+', ' ', 'g'))), lambda v: v <> '' AND NOT regexp_matches(v, '^[^\\p{{L}}\\p{{N}}]+$')) AS p FROM ph)"""
# first occurrence of every value of a list
_FIRST = "list_filter({x}, lambda v, i: list_position({x}, v) = i)"
TAGGED = f"""tg AS (SELECT d.doc_id, d.source, d.lang, d.text, (CASE WHEN contains('doc/' || source || '/x.md', 'src1') THEN ['one', 'first'] ELSE [] END) || (CASE WHEN contains('doc/' || source || '/x.md', 'src2') THEN ['two'] ELSE [] END)
    || [lang] || p || list_filter({WORDS!r}, lambda w: contains({TITLE} || chr(10) || text, w)) AS raw FROM documents d JOIN phrases USING (doc_id)),
tagged AS (SELECT * EXCLUDE (raw), {_FIRST.format(x='raw')} AS tags FROM tg)"""


def children(spark, sf_dir) -> DataFrame:
    d = load(spark, sf_dir, "documents")
    return d.select(
        "doc_id", F.col("doc_id").cast("string").alias("child_id"), F.col("source").alias("corpus_id"), F.split_part("text", F.lit("\n"), F.lit(1)).alias("title"), F.lit("").alias("heading_path"),
        F.concat(F.lit("doc/"), "source", F.lit("/x.md")).alias("source_file"), "text", F.col("lang").alias("document_type"),
    )


def tagged(spark, sf_dir) -> DataFrame:
    return T.rule_tags(children(spark, sf_dir), WORDS, CATEGORIES)


@query("title_phrases", ctes(PHRASES) + f"SELECT doc_id, n, v AS phrase FROM (SELECT doc_id, unnest(u) AS v, generate_subscripts(u, 1) AS n FROM (SELECT doc_id, {_FIRST.format(x='p')} AS u FROM phrases))")
def title_phrases(spark, sf_dir):
    rows = each(load(spark, sf_dir, "documents"), T.title_phrases(F.split_part("text", F.lit("\n"), F.lit(1))), "doc_id", item="phrase", pos="_p")
    return rows.select("doc_id", (F.col("_p") + 1).alias("n"), "phrase")


@query("rule_tags", ctes(PHRASES, TAGGED) + "SELECT doc_id, unnest(tags) AS tag, generate_subscripts(tags, 1) AS n FROM tagged")
def rule_tags(spark, sf_dir):
    rows = each(tagged(spark, sf_dir), "search_tags", "doc_id", item="tag", pos="_p")
    return rows.select("doc_id", "tag", (F.col("_p") + 1).alias("n"))


@query("dictionary_tags", f"SELECT doc_id, array_to_string(list_sort(list(w)), '|') AS tags FROM documents, (SELECT unnest({WORDS!r}) AS w) WHERE contains(text, w) GROUP BY doc_id")
def dictionary_tags(spark, sf_dir):
    terms = spark.createDataFrame([(w,) for w in WORDS], "term string")
    return T.dictionary_tags(load(spark, sf_dir, "documents"), terms, "doc_id").select("doc_id", F.array_join("tags", "|").alias("tags"))


_EDITED = "list_filter(list_transform(string_split_regex(text, '[,、，\\r\\n]'), lambda v: regexp_replace(v, '^\\s+|\\s+$', '', 'g')), lambda v: v <> '')"


@query("normalize_tags", f"WITH r AS (SELECT doc_id, {_EDITED} AS raw FROM documents) SELECT doc_id, array_to_string({_FIRST.format(x='raw')}, '|') AS tags FROM r")
def normalize_tags(spark, sf_dir):
    return load(spark, sf_dir, "documents").select("doc_id", F.array_join(T.edited_tags(F.array("text")), "|").alias("tags"))


@query("tag_search", ctes(PHRASES, TAGGED) + f"SELECT doc_id, len(tags) AS tag_count FROM tagged WHERE source <> '' AND contains(replace(lower(doc_id::VARCHAR || chr(10) || source || chr(10) || {TITLE} || chr(10) || '' || chr(10) || 'doc/' || source || '/x.md' || chr(10) || text || chr(10) || array_to_string(tags, ' ')), 'ß', 'ss'), 'src1')")
def tag_search(spark, sf_dir):
    return T.search_tags(tagged(spark, sf_dir), "SRC1").select("doc_id", "tag_count")


_WEAK = "weak AS (SELECT DISTINCT c AS child_id FROM (SELECT unnest(list_transform(sources, lambda s: s.child_id)) AS c FROM m WHERE source_count > 0 AND max_score < 0.35) WHERE c <> '')"


@query(
    "tag_candidates",
    ctes(PHRASES, TAGGED, LOGS, METRICS, _WEAK)
    + """SELECT 'c' || t.doc_id AS child_id, CASE WHEN w.child_id IS NOT NULL THEN 'used_by_low_confidence_answer' ELSE 'few_tags' END AS candidate_reason FROM tagged t LEFT JOIN weak w ON w.child_id = 'c' || t.doc_id
    WHERE w.child_id IS NOT NULL OR len(tags) <= 2 ORDER BY candidate_reason DESC, child_id LIMIT 150""",
)
def tag_candidates(spark, sf_dir):
    weak = L.weak_answers(ask_logs(spark, sf_dir))
    kids = tagged(spark, sf_dir).withColumn("child_id", F.concat(F.lit("c"), "child_id"))
    return T.tag_candidates(kids, weak, 150).select("child_id", "candidate_reason")


@query(
    "chunk_profile",
    ctes(PHRASES, TAGGED)
    + """SELECT source AS corpus_id, CASE WHEN doc_id % 10 = 4 THEN 'not_started' WHEN doc_id % 10 = 5 THEN 'invalid_period' WHEN doc_id % 10 = 3 THEN 'expired' ELSE 'unbounded' END AS valid_status, count(*) AS row_count,
    count_if(len(tags) > 0)::BIGINT AS tagged_count FROM tagged GROUP BY ALL""",
)
def chunk_profile(spark, sf_dir):
    n = F.col("doc_id") % 10
    start = F.when(n == 4, "2025-01-01").when(n == 5, "unknown").otherwise("")
    end = F.when(n == 3, "2023-12-31").otherwise("")
    return L.chunk_profile(tagged(spark, sf_dir), validity_status(start, end, "2024-06-30"))


@query(
    "index_summary",
    ctes(PHRASES, TAGGED)
    + """SELECT (SELECT count(DISTINCT source) FROM documents) AS parent_chunks, count(*) AS child_chunks, count_if(len(tags) > 0)::BIGINT AS tagged_chunks, round(count_if(len(tags) > 0)::DOUBLE / count(*), 4) AS tag_coverage_rate,
    (SELECT count(*) FROM labels WHERE toxic = 1) AS chunk_warnings, (SELECT count(*) FROM embeddings) AS vector_count, (SELECT count(*) FROM embeddings) <> count(*) AS vector_mismatch FROM tagged""",
)
def index_summary(spark, sf_dir):
    docs = load(spark, sf_dir, "documents")
    report = load(spark, sf_dir, "labels").select(F.when(F.col("toxic") == 1, "x").otherwise("").alias("warnings"))
    return L.index_summary(docs.select("source").distinct(), tagged(spark, sf_dir), load(spark, sf_dir, "embeddings"), report)
