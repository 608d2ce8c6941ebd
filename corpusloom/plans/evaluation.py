"""Evaluation, review batches and the improvement queue.

Predictions: every event is one; the expected source of a question is the opening of its
benchmark passage, looked for in whole documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.operators import answers as A
from corpusloom.operators import chunking as C
from corpusloom.operators import evals as E
from corpusloom.operators import logs as L
from corpusloom.operators import ranking as R
from corpusloom.operators import tags as T
from corpusloom.operators.matching import contained_terms
from corpusloom.plans.answers import TABLES, alias_table, qa_table
from corpusloom.plans.catalog import ctes, load, query
from corpusloom.plans.chunks import CHILD_SQL, page_report
from corpusloom.plans.chunks import _COUNTED as COUNTED
from corpusloom.plans.logs import LOGS, METRICS, ask_logs
from corpusloom.plans.retrieval import _TERMS
from corpusloom.plans.tags import _WEAK as WEAK
from corpusloom.plans.tags import PHRASES, TAGGED, tagged

PREDICTIONS = """pred AS (SELECT event_id, 'q' || user_id AS question_id, CASE event_type WHEN 'click' THEN 'vector' WHEN 'view' THEN 'hybrid' WHEN 'error' THEN '' ELSE 'hybrid_reranker' END AS retrieval_mode,
    CASE WHEN event_type = 'error' AND event_id % 2 = 0 THEN 'error' ELSE 'ok' END AS status, event_id % 3 = 0 AS expected_source_hit, event_id % 5 = 0 AS cache_hit, round(value / 10, 3) AS elapsed_sec,
    event_id % 4 AS source_count, 'answer ' || event_type || CASE WHEN event_id % 6 = 0 THEN ' 確認できません' ELSE '' END AS actual_answer FROM events)"""


def predictions(spark, sf_dir) -> DataFrame:
    e = load(spark, sf_dir, "events")
    n, kind = F.col("event_id"), F.col("event_type")
    mode = F.when(kind == "click", "vector").when(kind == "view", "hybrid").when(kind == "error", "").otherwise("hybrid_reranker")
    return e.select(
        "event_id", F.concat(F.lit("q"), F.col("user_id").cast("string")).alias("question_id"), mode.alias("retrieval_mode"),
        F.when((kind == "error") & (n % 2 == 0), "error").otherwise("ok").alias("status"), (n % 3 == 0).alias("expected_source_hit"), (n % 5 == 0).alias("cache_hit"),
        F.round(F.col("value") / 10, 3).alias("elapsed_sec"), (n % 4).alias("source_count"),
        F.concat(F.lit("answer "), kind, F.when(n % 6 == 0, " 確認できません").otherwise("")).alias("actual_answer"),
    )


_SUM = """count(*) AS total, count_if(status = 'ok')::BIGINT AS ok, count_if(status <> 'ok')::BIGINT AS errors, coalesce(round(count_if(status = 'ok' AND expected_source_hit)::DOUBLE / nullif(count_if(status = 'ok'), 0), 4), 0) AS expected_source_hit_rate,
    coalesce(round(count_if(status = 'ok' AND cache_hit)::DOUBLE / nullif(count_if(status = 'ok'), 0), 4), 0) AS cache_hit_rate, round(coalesce(avg(CASE WHEN status = 'ok' THEN elapsed_sec END), 0), 6) AS avg_elapsed_sec FROM pred"""


@query("prediction_summary", ctes(PREDICTIONS) + f"SELECT 'ALL' AS retrieval_mode, {_SUM} UNION ALL SELECT coalesce(nullif(retrieval_mode, ''), 'unknown'), {_SUM} GROUP BY retrieval_mode")
def prediction_summary(spark, sf_dir):
    return E.prediction_summary(predictions(spark, sf_dir))


_RULE = """rules AS (SELECT event_id, retrieval_mode, expected_source_hit, event_id % 7 = 0 AS is_no_answer, CASE WHEN contains(actual_answer, 'answer') THEN 1 ELSE 0 END + CASE WHEN contains(actual_answer, 'click') THEN 1 ELSE 0 END AS hits,
    CASE WHEN contains(actual_answer, 'view') THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END AS forbidden_score, CASE WHEN event_id % 7 = 0 AND NOT contains(actual_answer, '確認できません') THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END AS no_answer_score FROM pred),
scored AS (SELECT *, hits / 2.0::DOUBLE AS include_score, (hits / 2.0::DOUBLE + forbidden_score + no_answer_score) / 3 AS rule_score FROM rules)"""


def scored(spark, sf_dir) -> DataFrame:
    p = predictions(spark, sf_dir).withColumn("must_include", F.array(F.lit("answer"), F.lit("click"))).withColumn("must_not_include", F.array(F.lit("view")))
    return E.rule_scores(p.withColumn("is_no_answer", F.col("event_id") % 7 == 0))


@query(
    "rule_scores",
    ctes(PREDICTIONS, _RULE)
    + """SELECT event_id, round(include_score, 6) AS include_score, forbidden_score, no_answer_score, round(rule_score, 6) AS rule_score, 2::BIGINT AS must_include_count, hits::BIGINT AS must_include_hit_count,
    CASE WHEN NOT contains(a, 'answer') AND NOT contains(a, 'click') THEN '["answer","click"]' WHEN NOT contains(a, 'answer') THEN '["answer"]' WHEN NOT contains(a, 'click') THEN '["click"]' ELSE '[]' END AS must_include_missing_json,
    CASE WHEN contains(a, 'view') THEN '["view"]' ELSE '[]' END AS must_not_include_hit_json, CASE WHEN is_no_answer THEN contains(a, '確認できません') END AS no_answer_ok
    FROM scored JOIN (SELECT event_id, coalesce(actual_answer, '') AS a FROM pred) USING (event_id)""",
)
def rule_scores(spark, sf_dir):
    return scored(spark, sf_dir).select(
        "event_id", F.round("include_score", 6).alias("include_score"), "forbidden_score", "no_answer_score", F.round("rule_score", 6).alias("rule_score"),
        "must_include_count", "must_include_hit_count", "must_include_missing_json", "must_not_include_hit_json", "no_answer_ok",
    )


_RS = "count(*) AS count, round(avg(rule_score), 6) AS avg_rule_score, round(count_if(expected_source_hit)::DOUBLE / count(*), 4) AS expected_source_hit_rate, count_if(is_no_answer)::BIGINT AS no_answer_count FROM scored"


@query("rule_summary", ctes(PREDICTIONS, _RULE) + f"SELECT 'ALL' AS retrieval_mode, {_RS} UNION ALL SELECT coalesce(nullif(retrieval_mode, ''), 'unknown'), {_RS} GROUP BY retrieval_mode")
def rule_summary(spark, sf_dir):
    return E.rule_summary(scored(spark, sf_dir))


@query("metric_means", ctes(PREDICTIONS, _RULE) + """SELECT 'include_score' AS metric, round(avg(include_score), 6) AS mean, count(include_score) AS n FROM scored UNION ALL SELECT 'rule_score', round(avg(rule_score), 6), count(*) FROM scored
    UNION ALL SELECT 'positive', round(avg(nullif(hits, 0)), 6), count(nullif(hits, 0)) FROM scored""")
def metric_means(spark, sf_dir):
    rows = scored(spark, sf_dir).withColumn("positive", F.nullif(F.col("must_include_hit_count"), F.lit(0)))
    return E.metric_means(rows, ["include_score", "rule_score", "positive"])


@query("manual_summary", "SELECT count(*) AS rows, count(DISTINCT doc_id) AS questions, count(DISTINCT toxic) AS reviewers, round(avg(quality), 6) AS avg_quality FROM labels")
def manual_summary(spark, sf_dir):
    lab = load(spark, sf_dir, "labels").select(F.col("doc_id").alias("question_id"), F.col("toxic").alias("reviewer"), "quality")
    return E.manual_summary(lab, ["quality"])


@query("eval_failures", ctes(PREDICTIONS) + "SELECT event_id, status, source_count FROM pred WHERE status <> 'ok' OR source_count = 0")
def eval_failures(spark, sf_dir):
    return E.eval_failures(predictions(spark, sf_dir)).select("event_id", "status", "source_count")


@query("pending_rows", ctes(PREDICTIONS) + """, done AS (SELECT question_id FROM pred WHERE status = 'ok' AND retrieval_mode IN ('vector', 'hybrid', 'hybrid_reranker') AND cache_hit GROUP BY question_id HAVING count(DISTINCT retrieval_mode) = 3)
    SELECT DISTINCT question_id FROM pred WHERE question_id NOT IN (SELECT question_id FROM done)""")
def pending_rows(spark, sf_dir):
    p = predictions(spark, sf_dir)
    return E.pending_questions(p.select("question_id").distinct(), p.filter("cache_hit"))


@query("eval_batches", ctes(PREDICTIONS) + """, n AS (SELECT event_id, row_number() OVER (ORDER BY question_id || '::' || event_id) - 1 AS r FROM pred WHERE status = 'ok')
    SELECT event_id, r // 10 + 1 AS batch_no, r % 10 + 1 AS batch_pos FROM n""")
def eval_batches(spark, sf_dir):
    p = predictions(spark, sf_dir).filter("status = 'ok'").select("event_id", F.concat("question_id", F.lit("::"), F.col("event_id").cast("string")).alias("prediction_id"))
    return R.batches(p, 10, "prediction_id").select("event_id", "batch_no", "batch_pos")


@query("source_hit", "WITH x AS (SELECT item_id, trim(substr(replace(replace(replace(text, ',', ' '), ';', ' '), '|', ' '), 1, 40)) AS expected FROM benchmark) SELECT item_id, doc_id FROM x, documents WHERE contains(replace(replace(replace(text, ',', ' '), ';', ' '), '|', ' '), expected)")
def source_hit(spark, sf_dir):
    def clear(c):
        return F.translate(c, ",;|", "   ")

    wanted = load(spark, sf_dir, "benchmark").select("item_id", F.trim(F.substring(clear("text"), 1, 40)).alias("term"))
    docs = load(spark, sf_dir, "documents").select("doc_id", clear("text").alias("text"))
    return contained_terms(docs, "doc_id", "text", wanted).join(wanted, "term").select("item_id", "doc_id")


@query(
    "evidence_score",
    ctes(_TERMS)
    + """, d AS (SELECT doc_id::VARCHAR AS child_id, lower(trim(regexp_replace(split_part(text, chr(10), 1), '\\s+', ' ', 'g'))) AS title, lower(lang || ' ' || source) AS heading,
        lower(trim(regexp_replace(split_part(text, chr(10), 1) || chr(10) || lang || ' ' || source || chr(10) || text, '\\s+', ' ', 'g'))) AS body FROM documents),
    v AS (SELECT DISTINCT term FROM terms),
    h AS (SELECT child_id, term, CASE WHEN contains(title, term) THEN 6 WHEN contains(heading, term) THEN 3 ELSE 1 END AS points FROM d, v WHERE contains(body, term)),
    s AS (SELECT item_id AS question_id, child_id, sum(points)::DOUBLE AS score FROM terms JOIN h USING (term) GROUP BY ALL)
    SELECT question_id, child_id, score FROM s QUALIFY row_number() OVER (PARTITION BY question_id ORDER BY score DESC, child_id) = 1""",
)
def evidence_score(spark, sf_dir):
    kids = load(spark, sf_dir, "documents").select(
        F.col("doc_id").cast("string").alias("child_id"), F.split_part("text", F.lit("\n"), F.lit(1)).alias("title"), F.concat_ws(" ", "lang", "source").alias("heading_path"), "text"
    )
    q = load(spark, sf_dir, "benchmark").select(F.col("item_id").alias("question_id"), F.col("text").alias("question"))
    return E.best_scored(q, kids)


# documents as passages of seeded answers, and references of every kind to them; some lead nowhere
_SEEDS = """kids AS MATERIALIZED (SELECT doc_id::VARCHAR AS child_id, source AS corpus_id, (1000 + doc_id % 50)::VARCHAR AS taxanswer_no, 'd' || (doc_id // 20) % 5 || '/' || doc_id % 3 AS document_id,
    printf('%07d-%03d.md', doc_id % 30, doc_id % 30) AS source_file, lower(trim(regexp_replace(split_part(text, chr(10), 1), '\\s+', ' ', 'g'))) AS title, lower(lang || ' ' || source) AS heading,
    lower(trim(regexp_replace(split_part(text, chr(10), 1) || chr(10) || lang || ' ' || source || chr(10) || text, '\\s+', ' ', 'g'))) AS body FROM documents),
refs AS MATERIALIZED (SELECT item_id AS question_id, 1 AS ref_no, CASE item_id % 8 WHEN 0 THEN 'No.' || (1000 + item_id % 50) WHEN 1 THEN printf('%07d-%03d', item_id % 40, item_id % 40) WHEN 2 THEN '質疑応答 d' || item_id % 6 || '/' || item_id % 3
    WHEN 3 THEN '質疑応答 d' || item_id % 6 WHEN 4 THEN '財産評価基本通達 1' WHEN 5 THEN '空き家 の特例' WHEN 6 THEN lower(substr(text, 1, 12)) ELSE '' END AS source_ref FROM benchmark
    UNION ALL SELECT item_id, 2, 'No.' || (1000 + (item_id + 7) % 50) FROM benchmark WHERE item_id % 3 = 0),
cands AS MATERIALIZED (SELECT DISTINCT question_id, source_ref, child_id FROM refs JOIN kids ON (question_id % 8 = 0 OR ref_no = 2) AND taxanswer_no = substr(source_ref, 4)
    UNION SELECT question_id, source_ref, child_id FROM refs JOIN kids ON question_id % 8 = 1 AND ref_no = 1 AND contains(source_file, source_ref)
    UNION SELECT question_id, source_ref, child_id FROM refs JOIN kids ON question_id % 8 = 2 AND ref_no = 1 AND corpus_id = 'src3' AND '質疑応答 ' || document_id = source_ref
    UNION SELECT question_id, source_ref, child_id FROM refs JOIN kids ON question_id % 8 = 3 AND ref_no = 1 AND corpus_id = 'src3' AND '質疑応答 ' || split_part(document_id, '/', 1) = source_ref
    UNION SELECT question_id, source_ref, child_id FROM refs JOIN kids ON question_id % 8 = 4 AND ref_no = 1 AND corpus_id = 'src0'
    UNION SELECT question_id, source_ref, child_id FROM refs JOIN kids ON question_id % 8 = 5 AND ref_no = 1 AND corpus_id = 'src5' AND (contains(body, '空き家') OR taxanswer_no = '1005')
    UNION SELECT question_id, source_ref, child_id FROM refs JOIN kids ON question_id % 8 = 6 AND ref_no = 1 AND contains(body, source_ref))"""
_RULES = {"labels": {"財産評価基本通達": "src0"}, "case_corpus": "src3", "topics": {"空き家": ("src5", "1005")}}


def seed_children(spark, sf_dir) -> DataFrame:
    d = F.col("doc_id")
    number = F.format_string("%07d-%03d.md", d % 30, d % 30)
    return load(spark, sf_dir, "documents").select(
        d.cast("string").alias("child_id"), F.col("source").alias("corpus_id"), (1000 + d % 50).cast("string").alias("taxanswer_no"),
        F.concat(F.lit("d"), (F.floor(d / 20) % 5).cast("string"), F.lit("/"), (d % 3).cast("string")).alias("document_id"), number.alias("source_file"),
        F.split_part("text", F.lit("\n"), F.lit(1)).alias("title"), F.concat_ws(" ", "lang", "source").alias("heading_path"), "text",
    )


def seed_refs(spark, sf_dir) -> DataFrame:
    n = F.col("item_id")

    def text(*parts) -> object:
        return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])

    kind = n % 8
    ref = (
        F.when(kind == 0, text("No.", 1000 + n % 50)).when(kind == 1, F.format_string("%07d-%03d", n % 40, n % 40)).when(kind == 2, text("質疑応答 d", n % 6, "/", n % 3))
        .when(kind == 3, text("質疑応答 d", n % 6)).when(kind == 4, "財産評価基本通達 1").when(kind == 5, "空き家 の特例").when(kind == 6, F.lower(F.substring("text", 1, 12))).otherwise("")
    )
    b = load(spark, sf_dir, "benchmark")
    one = b.select(n.alias("question_id"), F.lit(1).alias("ref_no"), ref.alias("source_ref"))
    return one.unionByName(b.filter(n % 3 == 0).select(n.alias("question_id"), F.lit(2).alias("ref_no"), text("No.", 1000 + (n + 7) % 50).alias("source_ref")))


@query("evidence_candidates", ctes(_SEEDS) + "SELECT question_id, source_ref, child_id FROM cands")
def evidence_candidates(spark, sf_dir):
    return E.evidence_candidates(seed_refs(spark, sf_dir), seed_children(spark, sf_dir), **_RULES)


@query(
    "seed_evidence",
    ctes(_TERMS, _SEEDS)
    + """, hints AS (SELECT DISTINCT question_id, source_ref, 'src' || question_id % 20 AS hint FROM refs UNION SELECT DISTINCT question_id, source_ref, lower(split_part(text, ' ', 1)) FROM refs JOIN benchmark ON item_id = question_id
        UNION SELECT item_id, 'fallback', 'src' || item_id % 20 FROM benchmark),
    tp AS MATERIALIZED (SELECT item_id AS question_id, child_id, sum(CASE WHEN contains(title, term) THEN 6 WHEN contains(heading, term) THEN 3 ELSE 1 END)::DOUBLE AS s FROM terms JOIN kids ON contains(body, term) GROUP BY ALL),
    hp AS MATERIALIZED (SELECT question_id, source_ref, child_id, sum(CASE WHEN contains(title, hint) THEN 80 WHEN contains(heading, hint) THEN 55 ELSE 25 END)::DOUBLE AS s FROM hints JOIN kids ON contains(body, hint) GROUP BY ALL),
    best AS (SELECT c.*, coalesce(tp.s, 0) + coalesce(hp.s, 0) AS score FROM cands c LEFT JOIN tp USING (question_id, child_id) LEFT JOIN hp USING (question_id, source_ref, child_id)
        QUALIFY row_number() OVER (PARTITION BY question_id, source_ref ORDER BY score DESC, child_id) = 1),
    found AS (SELECT question_id, ref_no, source_ref, child_id, score FROM best JOIN refs USING (question_id, source_ref) QUALIFY row_number() OVER (PARTITION BY question_id, child_id ORDER BY ref_no, source_ref) = 1),
    rest AS (SELECT item_id AS question_id, 0 AS ref_no, 'fallback' AS source_ref, kids.child_id, coalesce(tp.s, 0) + coalesce(hp.s, 0) AS score FROM benchmark JOIN kids ON item_id % 4 <> 3 OR corpus_id IN ('src1', 'src2')
        LEFT JOIN tp ON tp.question_id = item_id AND tp.child_id = kids.child_id LEFT JOIN hp ON hp.question_id = item_id AND hp.source_ref = 'fallback' AND hp.child_id = kids.child_id
        WHERE item_id NOT IN (SELECT question_id FROM found) QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, kids.child_id) = 1)
    SELECT question_id, ref_no::BIGINT AS ref_no, source_ref, child_id, score FROM found UNION ALL SELECT question_id, ref_no::BIGINT, source_ref, child_id, score FROM rest""",
)
def seed_evidence(spark, sf_dir):
    b, refs = load(spark, sf_dir, "benchmark"), seed_refs(spark, sf_dir)
    n = F.col("item_id")
    source = F.concat(F.lit("src"), (F.col("question_id") % 20).cast("string"))
    q = b.select(n.alias("question_id"), F.col("text").alias("question"), F.when(n % 4 == 3, F.array(F.lit("src1"), F.lit("src2"))).alias("corpus_ids"))
    hints = refs.select("question_id", "source_ref", source.alias("hint"))
    words = refs.join(q, "question_id").select("question_id", "source_ref", F.split_part("question", F.lit(" "), F.lit(1)).alias("hint"))
    last = q.select("question_id", F.lit("fallback").alias("source_ref"), source.alias("hint"))
    return E.seed_evidence(q, refs, hints.unionByName(words).unionByName(last), seed_children(spark, sf_dir), **_RULES)


@query("retrieval_query", """WITH t AS (SELECT conv_id, turn, role, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS t FROM conversations WHERE role IN ('user', 'assistant')),
    l AS (SELECT * FROM t WHERE t <> '' QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 4),
    h AS (SELECT conv_id, string_agg(CASE role WHEN 'user' THEN 'ユーザー' ELSE 'アシスタント' END || ': ' || t, chr(10) ORDER BY turn) AS h FROM l GROUP BY conv_id),
    q AS (SELECT DISTINCT conv_id, 'What about ' || conv_id || '?' AS question FROM conversations)
    SELECT conv_id, CASE WHEN h IS NULL THEN question ELSE h || chr(10) || 'ユーザー: ' || question END AS retrieval_query FROM q LEFT JOIN h USING (conv_id)""")
def retrieval_query(spark, sf_dir):
    c = load(spark, sf_dir, "conversations")
    q = c.select("conv_id").distinct().withColumn("question", F.concat(F.lit("What about "), F.col("conv_id").cast("string"), F.lit("?")))
    return E.retrieval_query(c, q).select("conv_id", "retrieval_query")


# ---------------------------------------------------------------- citations

SOURCES = """ans AS (SELECT event_id AS answer_id, [struct_pack(title := 'Guide number ' || user_id, file := 'files/guide_' || event_id % 50 || '.md'), struct_pack(title := 'Guide number ' || CASE WHEN event_id % 3 = 0 THEN user_id // 10 ELSE user_id + event_id % 2 END, file := 'files/other_' || user_id % 9 || '.md')] AS sources FROM events),
tm AS (SELECT answer_id, i AS source_no, unnest([sources[i].title, regexp_extract(sources[i].file, '([^/]*)$', 1), regexp_replace(regexp_extract(sources[i].file, '([^/]*)$', 1), '\\.[^.]*$', '')]) AS term FROM ans, (SELECT unnest([1, 2]) AS i)),
nm AS (SELECT answer_id, source_no, term, regexp_replace(lower(term), '[\\s\\-_/#:：,，、。．.・･「」『』【】\\[\\]()（）<>＜＞"''`*]+', '', 'g') AS norm FROM tm)"""


def cited_answers(spark, sf_dir) -> DataFrame:
    e = load(spark, sf_dir, "events")

    def source(title, file):
        none = F.lit(None).cast("string")
        return F.struct(
            none.alias("corpus_id"), F.concat(F.lit("Guide number "), title.cast("string")).alias("title"), none.alias("heading_path"), none.alias("document_id"),
            none.alias("taxanswer_no"), F.concat(F.lit("files/"), file, F.lit(".md")).alias("source_file"), none.alias("source_url"),
        )

    u, n = F.col("user_id"), F.col("event_id")
    sources = F.array(
        source(u, F.concat(F.lit("guide_"), (n % 50).cast("string"))), source(F.when(n % 3 == 0, F.floor(u / 10)).otherwise(u + n % 2), F.concat(F.lit("other_"), (u % 9).cast("string")))
    )
    answer = F.concat(F.lit("See [根拠"), (n % 4).cast("string"), F.lit("] and Guide number "), u.cast("string"))
    return e.select(n.alias("answer_id"), answer.alias("answer"), sources.alias("sources"))


@query(
    "unique_terms",
    ctes(SOURCES) + """SELECT answer_id, norm, min(source_no)::BIGINT AS source_no FROM nm WHERE length(norm) >= 5 OR regexp_matches(norm, '^\\d{4,}$') GROUP BY answer_id, norm HAVING count(DISTINCT source_no) = 1""",
)
def unique_terms(spark, sf_dir):
    return E.unique_terms(cited_answers(spark, sf_dir)).select("answer_id", "norm", "source_no")


# the longer of two titles of which one holds the other takes the place of both
CITED = """ua AS (SELECT answer_id, norm, min(source_no)::BIGINT AS source_no, any_value(term) AS term FROM nm WHERE length(norm) >= 5 OR regexp_matches(norm, '^\\d{4,}$') GROUP BY answer_id, norm HAVING count(DISTINCT source_no) = 1),
tx AS (SELECT event_id AS answer_id, 'See [根拠' || event_id % 4 || '] and Guide number ' || user_id AS answer FROM events),
hit AS (SELECT ua.* FROM ua JOIN tx USING (answer_id) WHERE contains(answer, term)),
direct AS (SELECT answer_id, source_no FROM hit h WHERE NOT EXISTS (SELECT 1 FROM hit l WHERE l.answer_id = h.answer_id AND length(l.term) > length(h.term) AND contains(l.term, h.term))),
numbered AS (SELECT event_id AS answer_id, event_id % 4 AS source_no FROM events WHERE event_id % 4 BETWEEN 1 AND 2)"""


@query("numbered_references", "SELECT event_id AS answer_id, event_id % 4 AS source_no FROM events WHERE event_id % 4 BETWEEN 1 AND 2")
def numbered_references(spark, sf_dir):
    return E.numbered_references(cited_answers(spark, sf_dir))


@query("direct_references", ctes(SOURCES, CITED) + "SELECT answer_id, source_no FROM direct")
def direct_references(spark, sf_dir):
    return E.direct_references(cited_answers(spark, sf_dir))


@query(
    "citation_coverage",
    ctes(SOURCES, CITED) + """SELECT answer_id, 2::BIGINT AS source_count, count(source_no) AS cited, count(source_no) / 2 AS coverage
    FROM (SELECT event_id AS answer_id FROM events) LEFT JOIN (SELECT * FROM direct UNION SELECT * FROM numbered) USING (answer_id) GROUP BY answer_id""",
)
def citation_coverage(spark, sf_dir):
    return E.citation_coverage(cited_answers(spark, sf_dir))


# ---------------------------------------------------------------- improvement queue

TASKS = """tasks AS (SELECT 'high' AS priority, 'hallucination_report' AS task_type, 'Document ' || doc_id AS question, 1::BIGINT AS count, '2024-01-01'::VARCHAR AS last_seen_at FROM labels WHERE toxic = 1
    UNION ALL SELECT 'medium', 'frequent_question', question, count(*), NULL FROM logs GROUP BY question HAVING count(*) >= 2
    UNION ALL SELECT 'high', 'eval_failed', '', count(*), NULL FROM pred WHERE status <> 'ok' OR source_count = 0
    UNION ALL SELECT 'high', 'qa_alias_missing', '', count(*), NULL FROM qa WHERE status = 'approved' AND NOT EXISTS (SELECT 1 FROM aliases a WHERE a.qa_id = qa.id AND alias_type = 'original' AND a.status = 'active') HAVING count(*) > 0
    UNION ALL SELECT 'low', 'qa_alias_missing', '', count(*), NULL FROM qa WHERE status = 'approved' AND NOT EXISTS (SELECT 1 FROM aliases a WHERE a.qa_id = qa.id AND alias_type = 'llm_paraphrase' AND a.status = 'active') HAVING count(*) > 0
    UNION ALL SELECT 'high', 'no_hit', question, 1, created_at::VARCHAR FROM (SELECT * FROM m WHERE source_count = 0 ORDER BY id DESC LIMIT 20)
    UNION ALL SELECT 'medium', 'low_confidence', question, 1, created_at::VARCHAR FROM (SELECT * FROM m WHERE source_count > 0 AND max_score < 0.35 ORDER BY max_score, id DESC LIMIT 20)
    UNION ALL SELECT 'medium', 'near_cache_miss', question, 1, created_at::VARCHAR FROM (SELECT * FROM m WHERE NOT cache_hit AND cache_miss_reason = 'margin_too_small' ORDER BY id DESC LIMIT 20)
    UNION ALL SELECT 'medium', 'index_warning', '', 1, NULL FROM rep WHERE warnings <> ''
    UNION ALL SELECT 'high', 'index_warning', '', 1, NULL WHERE (SELECT count(*) FROM documents) <> (SELECT count(*) FROM embeddings)
    UNION ALL SELECT 'low', 'search_tag_candidate', '', n, NULL FROM cand)"""
TASK_CANDIDATES = """cand AS (SELECT len(tags) AS n FROM tagged t LEFT JOIN weak w ON w.child_id = 'c' || t.doc_id WHERE w.child_id IS NOT NULL OR len(tags) <= 2
    ORDER BY CASE WHEN w.child_id IS NOT NULL THEN 'used_by_low_confidence_answer' ELSE 'few_tags' END DESC, 'c' || t.doc_id LIMIT 150)"""
QUEUE = ",\n".join([CHILD_SQL.rstrip(), COUNTED, PHRASES, TAGGED, LOGS, METRICS, WEAK, PREDICTIONS, TABLES, TASK_CANDIDATES, TASKS]) + "\n"


def tasks(spark, sf_dir) -> DataFrame:
    logs = ask_logs(spark, sf_dir)
    reports = load(spark, sf_dir, "labels").filter("toxic = 1").select(F.concat(F.lit("Document "), F.col("doc_id").cast("string")).alias("question"), F.lit("2024-01-01").alias("created_at"))
    qa, aliases = qa_table(spark, sf_dir), alias_table(spark, sf_dir)
    warned = page_report(spark, sf_dir).filter("warnings <> ''")
    kids = tagged(spark, sf_dir).withColumn("child_id", F.concat(F.lit("c"), "child_id"))
    candidates = T.tag_candidates(kids, L.weak_answers(logs), 150).withColumn("tag_count", F.size("search_tags"))
    rows = [load(spark, sf_dir, t).agg(F.count("*").alias("n")).select("n").scalar() for t in ("documents", "embeddings")]
    index = spark.range(1).select((rows[0] != rows[1]).alias("vector_mismatch"))
    return E.improvement_tasks(
        reports, L.no_hits(logs), L.low_confidence(logs), L.near_misses(logs), logs.groupBy("question").agg(F.count("*").alias("hits")), warned, index,
        E.eval_failures(predictions(spark, sf_dir)), A.missing_alias(qa, aliases, "original"), A.missing_alias(qa, aliases, "llm_paraphrase"), candidates,
    )


@query("improvement_tasks", QUEUE + "SELECT priority, task_type, question, count, last_seen_at FROM tasks")
def improvement_tasks(spark, sf_dir):
    return tasks(spark, sf_dir).select("priority", "task_type", "question", "count", "last_seen_at")


@query("task_order", QUEUE + """SELECT priority, task_type, question, count FROM tasks ORDER BY CASE priority WHEN 'high' THEN 0 WHEN 'medium' THEN 1 ELSE 2 END, count DESC, coalesce(last_seen_at, ''), task_type, question LIMIT 40""")
def task_order(spark, sf_dir):
    return R.priority_order(tasks(spark, sf_dir), 40).select("priority", "task_type", "question", "count")
