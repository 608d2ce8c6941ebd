"""Question-log analytics over ``events``.

Every event is one logged question.  The number in ``props`` decides which sources the
answer used; some metrics are left out of their columns so that the fallbacks work.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.text import preview, split_multi
from corpusloom.functions.values import json_strings
from corpusloom.operators import chunking as C
from corpusloom.operators import logs as L
from corpusloom.operators.ranking import recent
from corpusloom.operators.search import score_band
from corpusloom.plans.catalog import ctes, load, query
from corpusloom.plans.chunks import _COUNTED, CHILD_SQL, page_report

AS_OF = "2024-01-31 00:00:00"

LOGS = """raw_logs AS (SELECT event_id AS id, ts AS created_at, 'u' || user_id AS session_id, regexp_extract(props, '(\\d+)', 1)::BIGINT AS k, event_type, value FROM events),
src AS (SELECT *, list_transform(range(0, k % 4), lambda i: struct_pack(corpus_id := 'corpus' || (k + i) % 5, parent_id := 'p' || (k + i) // 10,
    child_id := CASE WHEN k % 9 = 0 THEN '' ELSE 'c' || (k + i) END, source_file := 'doc/' || (k + i) % 25 || '.md', heading_path := 'h' || (k + i) % 7,
    title := 't' || (k + i) % 11, score := round(value / 200.0 / (i + 1), 6))) AS sources FROM raw_logs),
logs AS (SELECT id, created_at, session_id, event_type || ' question ' || k % 40 AS question, 'answer ' || k AS answer, ['corpus' || k % 5] AS corpus_ids, sources,
    '{"answer_source": "' || CASE WHEN event_type = 'signup' THEN 'approved_qa_cache' ELSE 'rag' END || '", "cache_candidate_similarity": "' || round(k / 100.0, 2)
      || '", "cache_miss_reason": "' || CASE WHEN k % 3 = 0 THEN 'margin_too_small' ELSE 'no_match' END || '"}' AS debug,
    CASE WHEN event_type = 'click' THEN 'rag' WHEN event_type = 'purchase' THEN 'approved_qa_cache' END AS answer_source,
    CASE WHEN event_type = 'view' THEN k % 2 = 0 END AS cache_hit, CASE WHEN k % 5 = 0 THEN k % 4 END AS source_count,
    CASE WHEN k % 3 = 1 THEN round(value / 200.0, 6) END AS max_score, floor(value * 10)::BIGINT AS latency_ms,
    CASE WHEN event_type = 'error' THEN 'timeout' ELSE '' END AS error_type FROM src)"""
METRICS = """m1 AS (SELECT * REPLACE (coalesce(nullif(answer_source, ''), json_extract_string(debug, '$.answer_source'), 'rag') AS answer_source, coalesce(source_count, len(sources)) AS source_count,
    round(coalesce(max_score, list_max(list_transform(sources, lambda s: s.score)), 0.0), 6) AS max_score), json_extract_string(debug, '$.cache_candidate_similarity')::DOUBLE AS cache_candidate_similarity,
    json_extract_string(debug, '$.cache_miss_reason') AS cache_miss_reason FROM logs),
m AS (SELECT * REPLACE (coalesce(cache_hit, answer_source = 'approved_qa_cache') AS cache_hit) FROM m1)"""
HITS = """hits AS (SELECT id, created_at, unnest(sources) AS s FROM m WHERE source_count > 0),
keyed AS (SELECT *, CASE WHEN s.child_id <> '' THEN s.corpus_id || '|' || s.parent_id || '|' || s.child_id ELSE s.corpus_id || '|' || s.source_file || '|' || s.heading_path END AS source_key FROM hits)"""


def since(hours: int) -> str:
    return f"created_at >= TIMESTAMP '{AS_OF}' - INTERVAL {hours} HOUR"


def ask_logs(spark, sf_dir) -> DataFrame:
    e = load(spark, sf_dir, "events").withColumn("k", F.get_json_object("props", "$.k").cast("bigint"))
    k, kind, value = F.col("k"), F.col("event_type"), F.col("value")

    def name(prefix: str, number) -> F.Column:
        return F.concat(F.lit(prefix), number.cast("bigint").cast("string"))

    def source(i):
        n = k + i
        return F.struct(
            name("corpus", n % 5).alias("corpus_id"), name("p", F.floor(n / 10)).alias("parent_id"),
            F.when(k % 9 == 0, "").otherwise(name("c", n)).alias("child_id"), F.concat(name("doc/", n % 25), F.lit(".md")).alias("source_file"),
            name("h", n % 7).alias("heading_path"), name("t", n % 11).alias("title"), F.round(value / 200.0 / (i + 1), 6).alias("score"),
        )

    some = F.transform(F.sequence(F.lit(0).cast("bigint"), k % 4 - 1), source)
    sources = F.when(k % 4 > 0, some).otherwise(F.slice(F.transform(F.array(F.lit(0).cast("bigint")), source), 1, 0))
    debug = F.to_json(
        F.struct(
            F.when(kind == "signup", "approved_qa_cache").otherwise("rag").alias("answer_source"), F.round(k / 100.0, 2).cast("string").alias("cache_candidate_similarity"),
            F.when(k % 3 == 0, "margin_too_small").otherwise("no_match").alias("cache_miss_reason"),
        )
    )
    return e.select(
        F.col("event_id").alias("id"), F.col("ts").alias("created_at"), name("u", F.col("user_id")).alias("session_id"),
        F.concat(kind, F.lit(" question "), (k % 40).cast("string")).alias("question"), name("answer ", k).alias("answer"), F.array(name("corpus", k % 5)).alias("corpus_ids"),
        sources.alias("sources"), debug.alias("debug"), F.when(kind == "click", "rag").when(kind == "purchase", "approved_qa_cache").alias("answer_source"),
        F.when(kind == "view", k % 2 == 0).alias("cache_hit"), F.when(k % 5 == 0, k % 4).cast("int").alias("source_count"),
        F.when(k % 3 == 1, F.round(value / 200.0, 6)).alias("max_score"), F.floor(value * 10).cast("int").alias("latency_ms"),
        F.when(kind == "error", "timeout").otherwise("").alias("error_type"),
    )


ID_LIST = "id, session_id, question, answer_source, cache_hit, source_count::BIGINT AS source_count, max_score"
IDS = ["id", "session_id", "question", "answer_source", "cache_hit", "source_count", "max_score"]


@query("log_metrics", ctes(LOGS, METRICS) + f"SELECT {ID_LIST}, cache_candidate_similarity, cache_miss_reason FROM m")
def log_metrics(spark, sf_dir):
    return L.log_metrics(ask_logs(spark, sf_dir)).select(*IDS, "cache_candidate_similarity", "cache_miss_reason")


@query("quality_state", ctes(LOGS, METRICS) + "SELECT id, CASE WHEN source_count = 0 THEN 'no_sources' WHEN max_score < 0.35 THEN 'low_confidence' ELSE 'normal' END AS quality_state FROM m")
def quality_state(spark, sf_dir):
    return L.log_metrics(ask_logs(spark, sf_dir)).select("id", L.quality_state().alias("quality_state"))


@query("score_bands", ctes(LOGS) + "SELECT id, CASE WHEN max_score IS NULL THEN 'support' WHEN max_score >= 0.75 THEN 'high' WHEN max_score >= 0.55 THEN 'medium' WHEN max_score >= 0.35 THEN 'support' ELSE 'review' END AS band FROM logs")
def score_bands(spark, sf_dir):
    return ask_logs(spark, sf_dir).select("id", score_band("max_score").alias("band"))


@query(
    "log_overview",
    ctes(LOGS)
    + """SELECT count(*) AS total_questions, count(DISTINCT session_id) AS unique_sessions, count_if(len(sources) > 0)::BIGINT AS logs_with_sources, count_if(coalesce(cache_hit, false))::BIGINT AS qa_cache_hits,
    count_if(answer_source IS NULL OR answer_source = 'rag')::BIGINT AS rag_answers, count_if(error_type <> '')::BIGINT AS error_count, round(avg(max_score), 6) AS avg_max_score,
    strftime(min(created_at), '%Y-%m-%d %H:%M:%S') AS first_log_at, strftime(max(created_at), '%Y-%m-%d %H:%M:%S') AS last_log_at FROM logs""",
)
def log_overview(spark, sf_dir):
    return L.overview(ask_logs(spark, sf_dir))


@query(
    "log_windows",
    ctes(LOGS)
    + f"""SELECT count_if({since(24)})::BIGINT AS last_24h_questions, count_if({since(168)})::BIGINT AS last_7d_questions, count_if({since(240)})::BIGINT AS window_questions,
    count(DISTINCT CASE WHEN {since(240)} THEN session_id END) AS window_sessions, count_if({since(240)} AND cache_hit)::BIGINT AS window_cache_hits,
    count_if({since(240)} AND (answer_source IS NULL OR answer_source = 'rag'))::BIGINT AS window_rag_answers FROM logs""",
)
def log_windows(spark, sf_dir):
    names = ["last_24h_questions", "last_7d_questions", "window_questions", "window_sessions", "window_cache_hits", "window_rag_answers"]
    return L.overview(ask_logs(spark, sf_dir), AS_OF, 10).select(*names)


_SPINE = f"spine AS (SELECT unnest(generate_series(DATE '{AS_OF[:10]}' - INTERVAL 13 DAY, DATE '{AS_OF[:10]}', INTERVAL 1 DAY))::DATE AS d)"


@query(
    "daily_counts",
    ctes(LOGS, _SPINE) + f"""SELECT strftime(d, '%Y-%m-%d') AS date, coalesce(n, 0) AS questions FROM spine LEFT JOIN
    (SELECT created_at::DATE AS d, count(*) AS n FROM logs WHERE {since(14 * 24)} GROUP BY 1) USING (d)""",
)
def daily_counts(spark, sf_dir):
    return L.daily_counts(ask_logs(spark, sf_dir), AS_OF, 14)


@query("hourly_counts", ctes(LOGS) + f"SELECT strftime(date_trunc('hour', created_at), '%Y-%m-%d %H:%M:%S') AS hour, count(*) AS questions FROM logs WHERE {since(24)} GROUP BY 1")
def hourly_counts(spark, sf_dir):
    return L.hourly_counts(ask_logs(spark, sf_dir), AS_OF)


@query(
    "daily_quality",
    ctes(LOGS, METRICS, _SPINE)
    + f"""SELECT strftime(d, '%Y-%m-%d') AS date, coalesce(n, 0) AS questions, coalesce(a, 0)::BIGINT AS no_hit, coalesce(b, 0)::BIGINT AS low_confidence FROM spine LEFT JOIN
    (SELECT created_at::DATE AS d, count(*) AS n, count_if(source_count = 0) AS a, count_if(source_count <> 0 AND max_score < 0.35) AS b FROM m WHERE {since(14 * 24)} GROUP BY 1) USING (d)""",
)
def daily_quality(spark, sf_dir):
    return L.daily_quality(ask_logs(spark, sf_dir), AS_OF, 14)


@query(
    "chunk_hits",
    ctes(LOGS, METRICS, HITS)
    + """, st AS (SELECT source_key, count(*) AS hits, round(avg(s.score), 6) AS avg_score, round(max(s.score), 6) AS max_score, strftime(max(created_at), '%Y-%m-%d %H:%M:%S') AS last_hit_at,
        arg_max(s, id) AS d, list_sort(list(id), 'DESC')[1:5] AS ids FROM keyed GROUP BY source_key)
    SELECT row_number() OVER (ORDER BY hits DESC, source_key) AS rank, source_key, hits, avg_score, max_score, last_hit_at, d.corpus_id AS corpus_id, d.parent_id AS parent_id, d.child_id AS child_id,
        d.title AS title, d.heading_path AS heading_path, d.source_file AS source_file, array_to_string(ids, ',') AS sample_log_ids FROM st ORDER BY hits DESC, source_key LIMIT 20""",
)
def chunk_hits(spark, sf_dir):
    return L.chunk_hits(ask_logs(spark, sf_dir)).withColumn("sample_log_ids", F.array_join(F.col("sample_log_ids").cast("array<string>"), ","))


@query(
    "file_hits",
    ctes(LOGS, METRICS, HITS)
    + """, st AS (SELECT coalesce(nullif(s.source_file, ''), nullif(s.corpus_id, ''), 'unknown') AS file_key, count(*) AS hits, strftime(max(created_at), '%Y-%m-%d %H:%M:%S') AS last_hit_at FROM keyed GROUP BY 1)
    SELECT row_number() OVER (ORDER BY hits DESC, file_key) AS rank, file_key, hits, last_hit_at FROM st ORDER BY hits DESC, file_key LIMIT 20""",
)
def file_hits(spark, sf_dir):
    return L.file_hits(ask_logs(spark, sf_dir))


@query("top_questions", ctes(LOGS) + "SELECT trim(question) AS question, count(*) AS hits FROM logs GROUP BY 1 ORDER BY hits DESC, question LIMIT 20")
def top_questions(spark, sf_dir):
    return L.top_questions(ask_logs(spark, sf_dir))


@query("low_confidence", ctes(LOGS, METRICS) + f"SELECT {ID_LIST} FROM m WHERE source_count > 0 AND max_score < 0.35 ORDER BY max_score, id DESC LIMIT 20")
def low_confidence(spark, sf_dir):
    return L.low_confidence(ask_logs(spark, sf_dir)).select(*IDS)


@query("no_hits", ctes(LOGS, METRICS) + f"SELECT {ID_LIST} FROM m WHERE source_count = 0 ORDER BY id DESC LIMIT 20")
def no_hits(spark, sf_dir):
    return L.no_hits(ask_logs(spark, sf_dir)).select(*IDS)


@query("near_misses", ctes(LOGS, METRICS) + f"SELECT {ID_LIST}, cache_candidate_similarity FROM m WHERE NOT cache_hit AND cache_miss_reason = 'margin_too_small' ORDER BY id DESC LIMIT 20")
def near_misses(spark, sf_dir):
    return L.near_misses(ask_logs(spark, sf_dir)).select(*IDS, "cache_candidate_similarity")


@query(
    "log_search",
    ctes(LOGS, METRICS)
    + f"""SELECT {ID_LIST}, CASE WHEN max_score < 0.35 THEN 'low_confidence' ELSE 'normal' END AS quality_state, question AS question_preview FROM m
    WHERE {since(20 * 24)} AND contains(lower(question || chr(10) || answer || chr(10) || array_to_string(corpus_ids, ' ') || chr(10) || array_to_string(list_transform(sources, lambda s: s.heading_path), chr(10))), 'question 1')
      AND (list_contains(corpus_ids, 'corpus3') OR list_contains(list_transform(sources, lambda s: s.corpus_id), 'corpus3')) AND source_count > 0 AND max_score >= 0.1 ORDER BY id DESC LIMIT 200""",
)
def log_search(spark, sf_dir):
    rows = L.search_logs(ask_logs(spark, sf_dir), AS_OF, days=20, limit=200, query="Question 1", corpus_id="corpus3", source_state="with_sources", min_score=0.1)
    return rows.select(*IDS, "quality_state", "question_preview")


@query(
    "latency_percentiles",
    ctes(LOGS, METRICS) + "SELECT answer_source, count(*) AS n, round(quantile_cont(latency_ms, 0.5), 6) AS p50_ms, round(quantile_cont(latency_ms, 0.95), 6) AS p95_ms FROM m GROUP BY answer_source",
)
def latency_percentiles(spark, sf_dir):
    return L.latency_percentiles(L.log_metrics(ask_logs(spark, sf_dir)))


_KPI = f"""k AS (SELECT count(*) AS questions_in_window, count(DISTINCT session_id) AS sessions_in_window, count_if(source_count = 0)::BIGINT AS no_hit_count,
    count_if(source_count <> 0 AND max_score < 0.35)::BIGINT AS low_confidence_count, count_if(cache_hit)::BIGINT AS qa_cache_hits, count_if(answer_source = 'rag')::BIGINT AS rag_answers,
    count_if(error_type <> '')::BIGINT AS error_count FROM m WHERE {since(168)}),
kpi AS (SELECT *, round(no_hit_count::DOUBLE / questions_in_window, 4) AS no_hit_rate, round(low_confidence_count::DOUBLE / questions_in_window, 4) AS low_confidence_rate,
    round(qa_cache_hits::DOUBLE / questions_in_window, 4) AS qa_cache_hit_rate, round(rag_answers::DOUBLE / questions_in_window, 4) AS rag_answer_rate FROM k)"""


@query("ops_kpis", ctes(LOGS, METRICS, _KPI) + "SELECT * FROM kpi")
def ops_kpis(spark, sf_dir):
    return L.ops_kpis(ask_logs(spark, sf_dir), AS_OF)


_ALERTS = """a AS (SELECT unnest(list_filter([CASE WHEN (SELECT count(*) FROM labels WHERE toxic = 1) > 0 THEN 'error:open_reports' END, CASE WHEN no_hit_rate >= 0.1 THEN 'warning:no_hit_rate' END,
    CASE WHEN low_confidence_rate >= 0.2 THEN 'warning:low_confidence_rate' END, CASE WHEN (SELECT count(*) FROM rep WHERE warnings <> '') > 0 THEN 'warning:chunk_warnings' END, CASE WHEN (SELECT count(*) FROM documents) <> (SELECT count(*) FROM embeddings) THEN 'error:vector_mismatch' END], lambda x: x IS NOT NULL)) AS x FROM kpi)"""

_STATE = ",\n".join([CHILD_SQL.rstrip(), _COUNTED, LOGS, METRICS, _KPI, _ALERTS]) + "\n"


def kpis_with_state(spark, sf_dir) -> DataFrame:
    def n(name: str, test: str = "true"):
        return load(spark, sf_dir, name).agg(F.count_if(F.expr(test)).alias("n")).select("n").scalar()

    warned = page_report(spark, sf_dir).agg(F.count_if(F.col("warnings") != "").alias("n")).select("n").scalar()
    return L.ops_kpis(ask_logs(spark, sf_dir), AS_OF).select(
        "*", n("labels", "toxic = 1").alias("open_reports"), warned.alias("chunk_warnings"), (n("documents") != n("embeddings")).alias("vector_mismatch")
    )


@query("ops_alerts", _STATE + "SELECT split_part(x, ':', 1) AS level, split_part(x, ':', 2) AS alert FROM a")
def ops_alerts(spark, sf_dir):
    return L.ops_alerts(kpis_with_state(spark, sf_dir))


@query("health_status", _STATE + "SELECT CASE WHEN count_if(starts_with(x, 'error')) > 0 THEN 'error' WHEN count(*) > 0 THEN 'warning' ELSE 'OK' END AS status, count(*) AS alerts FROM a")
def health_status(spark, sf_dir):
    return L.health_status(L.ops_alerts(kpis_with_state(spark, sf_dir)))


@query("recent", ctes(LOGS) + "SELECT id, session_id, question FROM logs ORDER BY id DESC LIMIT 50")
def recent_logs(spark, sf_dir):
    return recent(ask_logs(spark, sf_dir)).select("id", "session_id", "question")


@query(
    "preview",
    """WITH t AS (SELECT doc_id, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS t, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS c FROM documents)
    SELECT doc_id, CASE WHEN length(t) <= 240 THEN t ELSE substr(t, 1, 240) || '...[省略]' END AS preview, substr(c, 1, 400) AS compacted FROM t""",
)
def preview_query(spark, sf_dir):
    from corpusloom.functions.text import compact

    return load(spark, sf_dir, "documents").select("doc_id", preview("text").alias("preview"), compact("text").alias("compacted"))


@query(
    "split_multi",
    """SELECT doc_id, unnest(p) AS part, generate_subscripts(p, 1) AS n FROM (SELECT doc_id, list_filter(list_transform(string_split_regex(text, '[|;,]'),
    lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: x <> '') AS p FROM documents)""",
)
def split_multi_query(spark, sf_dir):
    from corpusloom.functions.values import each

    rows = each(load(spark, sf_dir, "documents"), split_multi("text"), "doc_id", item="part", pos="_p")
    return rows.select("doc_id", "part", (F.col("_p") + 1).alias("n"))


@query(
    "json_decode",
    """SELECT event_id, json_extract_string(props, '$.k')::BIGINT AS k, '' AS tags, event_type || ',' || (user_id % 7) AS listed FROM events""",
)
def json_decode(spark, sf_dir):
    e = load(spark, sf_dir, "events")
    stored = F.to_json(F.array("event_type", (F.col("user_id") % 7).cast("string")))
    k = F.from_json("props", "k bigint")["k"]
    return e.select("event_id", k.alias("k"), F.array_join(json_strings("props"), ",").alias("tags"), F.array_join(json_strings(stored), ",").alias("listed"))
