"""Question-log analytics: search, metrics, dashboards.

``ask_logs`` rows carry (id, created_at, session_id, question, answer, corpus_ids,
sources, debug, answer_source, cache_hit, source_count, max_score, latency_ms,
error_type, cache_candidate_similarity, cache_miss_reason ...).  Times are compared
with an explicit ``as_of``, never with the clock.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions.text import blank_to_null, col, preview, strip, text_or_empty
from corpusloom.functions.unicode import casefold
from corpusloom.functions.values import positive, ratio
from corpusloom.session import materialized

# Miss reasons that count as near misses; source fields kept in the log.
NEAR_MISS = ["below_accept_threshold", "margin_too_small", "llm_judge_rejected"]
LOG_FIELDS = [
    "corpus_id",
    "parent_id",
    "child_id",
    "source_file",
    "source_url",
    "title",
    "heading_path",
    "taxanswer_no",
    "document_type",
    "document_id",
    "score",
]
DEBUG_TEXT_KEYS = ["contexts", "context", "prompt", "messages", "parent_context", "retrieved_contexts"]
CACHE_SOURCE = "approved_qa_cache"
LOW_SCORE = 0.35


def _debug(key: str) -> Column:
    return blank_to_null(F.get_json_object("debug", f"$.{key}"))


def cutoff(as_of: str, hours: int) -> Column:
    return F.to_timestamp_ntz(F.lit(as_of)) - F.expr(f"INTERVAL {hours} HOURS")


def _at() -> Column:
    return F.col("created_at").cast("timestamp_ntz")


# ---------------------------------------------------------------- rows


def log_metrics(logs: DataFrame) -> DataFrame:
    """Fill metrics from the column, else the debug JSON, else the sources themselves."""
    best = F.coalesce(F.array_max(F.transform("sources", lambda s: F.coalesce(s["score"], F.lit(0.0)))), F.lit(0.0))
    answer_source = F.coalesce(blank_to_null("answer_source"), _debug("answer_source"), F.lit("rag"))
    out = (
        logs.withColumn("answer_source", answer_source)
        .withColumn("cache_hit", F.coalesce(F.col("cache_hit"), F.col("answer_source") == CACHE_SOURCE))
        .withColumn("source_count", F.coalesce("source_count", F.size(F.coalesce("sources", F.array()))))
        .withColumn("max_score", F.round(F.coalesce("max_score", best), 6))
    )
    for name, kind in (
        ("qa_cache_id", "bigint"), ("cache_similarity", "double"), ("cache_candidate_qa_id", "bigint"),
        ("cache_candidate_alias_id", "bigint"), ("cache_candidate_similarity", "double"), ("cache_miss_reason", "string"), ("cache_match_method", "string"),
    ):
        own = F.col(name) if name in logs.columns else F.lit(None).cast(kind)
        own = blank_to_null(own) if kind == "string" else own
        out = out.withColumn(name, F.coalesce(own, _debug(name).try_cast(kind)))
    return out


def quality_state(source_count="source_count", max_score="max_score", low_score: float = LOW_SCORE) -> Column:
    return F.when(col(source_count) == 0, "no_sources").when(col(max_score) < low_score, "low_confidence").otherwise("normal")


def compact_sources(sources, limit: int = 500, fields: list[str] = LOG_FIELDS) -> Column:
    """Sources reduced to log fields plus text previews."""
    return F.transform(
        sources,
        lambda s: F.struct(
            *[s[f].alias(f) for f in fields],
            preview(F.coalesce(blank_to_null(s["child_text"]), s["text"]), limit).alias("child_text_preview"),
            preview(s["parent_text"], limit).alias("parent_text_preview"),
        ),
    )


def compact_debug(debug: Column, limit: int = 500) -> Column:
    """Debug map with its long text values previewed."""
    return F.transform_values(debug, lambda k, v: F.when(k.isin(DEBUG_TEXT_KEYS), preview(v, limit)).otherwise(v))


def search_logs(
    logs: DataFrame, as_of: str, days: int = 30, limit: int = 100, query: str | None = None, corpus_id: str | None = None,
    source_state: str = "all", low_score: float = LOW_SCORE, answer_source: str | None = None, qa_cache_id: int | None = None,
    session_id: str | None = None, log_id: int | None = None, min_score: float | None = None, max_score: float | None = None,
) -> DataFrame:
    """Newest matching logs.  Every filter applies before the limit."""
    rows = log_metrics(logs.filter(_at() >= cutoff(as_of, 24 * positive(days))))
    tests: list[Column] = []
    if log_id is not None:
        tests.append(F.col("id") == log_id)
    if session_id:
        tests.append(F.col("session_id") == session_id)
    if answer_source:
        tests.append(F.col("answer_source") == answer_source)
    if qa_cache_id is not None:
        tests.append(F.col("qa_cache_id") == qa_cache_id)
    if min_score is not None:
        tests.append(F.col("max_score") >= min_score)
    if max_score is not None:
        tests.append(F.col("max_score") <= max_score)
    if query and query.strip():
        headings = F.array_join(F.transform("sources", lambda s: F.coalesce(blank_to_null(s["heading_path"]), s["source_file"], F.lit(""))), "\n")
        hay = F.concat_ws("\n", text_or_empty("question"), text_or_empty("answer"), F.array_join("corpus_ids", " "), headings)
        tests.append(F.contains(casefold(hay), F.lit(query.strip().casefold())))
    if corpus_id:
        tests.append(F.array_contains("corpus_ids", corpus_id) | F.exists("sources", lambda s: s["corpus_id"] == corpus_id))
    state = {
        "with_sources": F.col("source_count") > 0,
        "no_sources": F.col("source_count") <= 0,
        "low_confidence": (F.col("source_count") > 0) & (F.col("max_score") < low_score),
    }.get(source_state)
    for test in tests + ([state] if state is not None else []):
        rows = rows.filter(test)
    return (
        rows.withColumn("quality_state", quality_state(low_score=low_score))
        .withColumn("question_preview", preview("question", 180))
        .withColumn("answer_preview", preview("answer", 260))
        .orderBy(F.col("id").desc())
        .limit(positive(limit))
    )


# ---------------------------------------------------------------- aggregates


def overview(logs: DataFrame, as_of: str | None = None, days: int = 7, exact_sessions: bool = True) -> DataFrame:
    """One row of totals; with ``as_of`` also the counts of the last 24 hours, 7 and n days."""
    distinct = F.count_distinct if exact_sessions else F.approx_count_distinct
    rag = F.col("answer_source").isNull() | (F.col("answer_source") == "rag")
    hit = F.coalesce(F.col("cache_hit"), F.lit(False))
    out = [
        F.count("*").alias("total_questions"),
        distinct("session_id").alias("unique_sessions"),
        F.count_if(F.size("sources") > 0).alias("logs_with_sources"),
        F.count_if(hit).alias("qa_cache_hits"),
        F.count_if(rag).alias("rag_answers"),
        F.count_if(F.coalesce("error_type", F.lit("")) != "").alias("error_count"),
        F.round(F.coalesce(F.avg("max_score"), F.lit(0.0)), 6).alias("avg_max_score"),
        F.min("created_at").alias("first_log_at"),
        F.max("created_at").alias("last_log_at"),
    ]
    if as_of is not None:
        inside = _at() >= cutoff(as_of, 24 * days)
        out += [
            F.count_if(_at() >= cutoff(as_of, 24)).alias("last_24h_questions"),
            F.count_if(_at() >= cutoff(as_of, 168)).alias("last_7d_questions"),
            F.count_if(inside).alias("window_questions"),
            distinct(F.when(inside, F.col("session_id"))).alias("window_sessions"),
            F.count_if(inside & hit).alias("window_cache_hits"),
            F.count_if(inside & rag).alias("window_rag_answers"),
        ]
    return logs.agg(*out)


def day_spine(spark, as_of: str, days: int) -> DataFrame:
    """The last ``days`` dates up to ``as_of``."""
    last = F.to_date(F.lit(as_of))
    return spark.range(1).select(F.explode(F.sequence(F.date_sub(last, days - 1), last)).alias("date"))


def daily_counts(logs: DataFrame, as_of: str, days: int = 7) -> DataFrame:
    """Questions per day, zero for days without logs."""
    inside = logs.filter(_at() >= cutoff(as_of, 24 * days)).groupBy(F.to_date("created_at").alias("date")).agg(F.count("*").alias("questions"))
    return day_spine(logs.sparkSession, as_of, days).join(inside, "date", "left").fillna(0, ["questions"])


def hourly_counts(logs: DataFrame, as_of: str, hours: int = 24) -> DataFrame:
    inside = logs.filter(_at() >= cutoff(as_of, hours))
    return inside.groupBy(F.date_trunc("hour", "created_at").alias("hour")).agg(F.count("*").alias("questions"))


def daily_quality(logs: DataFrame, as_of: str, days: int = 7, low_score: float = LOW_SCORE) -> DataFrame:
    """Per day: questions, no-hit and low-confidence answers; gap-filled."""
    rows = log_metrics(logs.filter(_at() >= cutoff(as_of, 24 * days)))
    state = quality_state(low_score=low_score)
    counted = rows.groupBy(F.to_date("created_at").alias("date")).agg(
        F.count("*").alias("questions"),
        F.count_if(state == "no_sources").alias("no_hit"),
        F.count_if(state == "low_confidence").alias("low_confidence"),
    )
    return day_spine(logs.sparkSession, as_of, days).join(counted, "date", "left").fillna(0, ["questions", "no_hit", "low_confidence"])


def source_key(s: Column) -> Column:
    """Corpus, parent and child of a source, else corpus, file and heading."""
    child = F.concat_ws("|", text_or_empty(s["corpus_id"]), text_or_empty(s["parent_id"]), text_or_empty(s["child_id"]))
    file = F.concat_ws("|", text_or_empty(s["corpus_id"]), text_or_empty(s["source_file"]), text_or_empty(s["heading_path"]))
    return F.when(text_or_empty(s["child_id"]) != "", child).otherwise(file)


def source_hits(logs: DataFrame) -> DataFrame:
    """One row per log and source."""
    rows = log_metrics(logs).filter("source_count > 0")
    return rows.select("id", "created_at", F.explode("sources").alias("s")).withColumn("source_key", source_key(F.col("s")))


def chunk_hits(logs: DataFrame, top_n: int = 20, samples: int = 5) -> DataFrame:
    """Most used chunks: hits, average and best score, last hit, newest sample log ids.

    The logs are read once.  A task reduces each of its chunks to one row with its newest ids, so a chunk
    that appears in a third of all logs brings ``samples`` ids per task together, not all of them.
    """
    score = F.coalesce(F.col("s.score"), F.lit(0.0))
    detail = F.struct("s.corpus_id", "s.parent_id", "s.child_id", "s.title", "s.heading_path", "s.source_file")
    hits = source_hits(logs).select("source_key", "id", "created_at", score.alias("_score"), detail.alias("_d"), F.spark_partition_id().alias("_task"))

    def newest(ids: Column) -> Column:
        return F.slice(F.sort_array(ids, False), 1, positive(samples))

    per_task = hits.groupBy("source_key", "_task").agg(
        F.count("*").alias("hits"), F.sum("_score").alias("_sum"), F.max("_score").alias("_max"), F.max("created_at").alias("last_hit_at"),
        newest(F.collect_list("id")).alias("_ids"), F.max_by("_d", "id").alias("_d"), F.max("id").alias("_id"),
    )
    stats = per_task.groupBy("source_key").agg(
        F.sum("hits").alias("hits"),
        F.round(F.sum("_sum") / F.sum("hits"), 6).alias("avg_score"),
        F.round(F.greatest(F.max("_max"), F.lit(0.0)), 6).alias("max_score"),
        F.max("last_hit_at").alias("last_hit_at"),
        F.max_by("_d", "_id").alias("_d"),
        newest(F.flatten(F.collect_list("_ids"))).alias("sample_log_ids"),
    )
    ranked = stats.orderBy(F.col("hits").desc(), "source_key").limit(positive(top_n))
    ranked = ranked.withColumn("rank", F.row_number().over(Window.orderBy(F.col("hits").desc(), "source_key")))  # top_n rows
    return ranked.select("rank", "source_key", "hits", "avg_score", "max_score", "last_hit_at", "_d.*", "sample_log_ids")


def file_hits(logs: DataFrame, top_n: int = 20) -> DataFrame:
    s = F.col("s")
    key = F.coalesce(blank_to_null(s["source_file"]), *([blank_to_null(s["source_url"])] if "source_url" in logs.schema["sources"].dataType.elementType.names else []), blank_to_null(s["corpus_id"]), F.lit("unknown"))
    stats = source_hits(logs).groupBy(key.alias("file_key")).agg(F.count("*").alias("hits"), F.max("created_at").alias("last_hit_at"))
    ranked = stats.orderBy(F.col("hits").desc(), "file_key").limit(positive(top_n))
    return ranked.withColumn("rank", F.row_number().over(Window.orderBy(F.col("hits").desc(), "file_key")))  # top_n rows


def top_questions(logs: DataFrame, top_n: int = 20) -> DataFrame:
    q = strip(text_or_empty("question"))
    return (
        logs.select(q.alias("question")).filter("question <> ''").groupBy("question").agg(F.count("*").alias("hits"))
        .orderBy(F.col("hits").desc(), "question").limit(positive(top_n))
    )


def weak_answers(logs: DataFrame, low_score: float = LOW_SCORE) -> DataFrame:
    """Answered with sources but a low best score."""
    return log_metrics(logs).filter((F.col("source_count") > 0) & (F.col("max_score") < low_score))


def low_confidence(logs: DataFrame, top_n: int = 20, low_score: float = LOW_SCORE) -> DataFrame:
    """The weakest answers, worst first."""
    return weak_answers(logs, low_score).orderBy("max_score", F.col("id").desc()).limit(top_n)


def no_hits(logs: DataFrame, top_n: int = 20) -> DataFrame:
    return log_metrics(logs).filter("source_count = 0").orderBy(F.col("id").desc()).limit(top_n)


def near_misses(logs: DataFrame, top_n: int = 20) -> DataFrame:
    """Unanswered by the cache although a candidate came close."""
    rows = log_metrics(logs).filter(~F.col("cache_hit") & F.col("cache_candidate_similarity").isNotNull() & F.col("cache_miss_reason").isin(NEAR_MISS))
    return rows.orderBy(F.col("id").desc()).limit(top_n)


def newest(logs: DataFrame, sample_limit: int | None) -> DataFrame:
    """The newest rows when a sample is wanted, otherwise all."""
    return logs if sample_limit is None else logs.orderBy(F.col("id").desc()).limit(sample_limit)


#: Ranges into which one round divides the values that may still hold a rank.
RANGES = 1024
#: Values of one range that may be put in order in one task.
FEW = 10_000


def exact_percentiles(rows: DataFrame, key: str, value: str, probs: list[float], ranges: int = RANGES, few: int = FEW) -> DataFrame:
    """(key, prob, percentile): exact, interpolated between neighbouring ranks, of groups of any size.

    A group's values are counted by equal ranges between its ends; the range that holds the wanted rank
    is divided again until it holds few values or equal ones, which alone are put in order.  Counts combine
    map-side, so no task holds a group.  Each round reads ``rows`` once.  Only finite values count.
    """
    finite = F.col("_v").isNotNull() & ~F.isnan("_v") & (F.abs("_v") < float("inf"))
    values = rows.select(F.col(key).alias("_k"), F.col(value).cast("double").alias("_v")).filter(finite)
    sizes = values.groupBy(F.col("_k").alias("_g")).agg(F.count("*").alias("_n"), F.min("_v").alias("lo"), F.max("_v").alias("hi"))
    place = F.col("prob") * (F.col("_n") - 1)
    wanted = sizes.select("_g", "_n", "lo", "hi", F.explode(F.array(*[F.lit(float(p)) for p in probs])).alias("prob"))
    ends = F.explode(F.array_distinct(F.array(F.floor(place), F.ceil(place)))).alias("rank")
    # below: how many values are smaller than lo; n: how many lie from lo to hi
    searched = materialized(wanted.select("_g", "prob", ends, "lo", "hi", F.lit(0).cast("long").alias("below"), F.col("_n").alias("n")))
    settled = (F.col("lo") == F.col("hi")) | (F.col("n") <= few)

    def inside(some: DataFrame) -> DataFrame:
        return values.join(some, F.col("_k").eqNullSafe(F.col("_g")) & F.col("_v").between(F.col("lo"), F.col("hi"))).drop("_k")

    done, searched = searched.filter(settled), searched.filter(~settled)
    while not searched.isEmpty():
        # halves: the difference of two doubles may be too large for one
        share = (F.col("_v") / 2 - F.col("lo") / 2) / (F.col("hi") / 2 - F.col("lo") / 2)
        part = F.least(F.floor(share * ranges), F.lit(ranges - 1))
        counted = inside(searched).groupBy("_g", "prob", "rank", "below", part.alias("_b")).agg(F.count("*").alias("n"), F.min("_v").alias("lo"), F.max("_v").alias("hi"))
        before = F.sum("n").over(Window.partitionBy("_g", "prob", "rank").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1))
        summed = counted.withColumn("below", F.col("below") + F.coalesce(before, F.lit(0)))
        held = summed.filter((F.col("rank") >= F.col("below")) & (F.col("rank") < F.col("below") + F.col("n")))
        narrowed = materialized(held.select("_g", "prob", "rank", "lo", "hi", "below", "n"))
        done, searched = done.unionByName(narrowed.filter(settled)), narrowed.filter(~settled)
    ordered = inside(done.filter("lo < hi")).withColumn("_i", F.row_number().over(Window.partitionBy("_g", "prob", "rank").orderBy("_v")))
    found = ordered.filter(F.col("_i") == F.col("rank") - F.col("below") + 1).select("_g", "prob", "rank", F.col("_v").alias("value"))
    found = found.unionByName(done.filter("lo = hi").select("_g", "prob", "rank", F.col("lo").alias("value")))
    both = found.groupBy(F.col("_g").alias("_k"), "prob").agg(F.min_by("value", "rank").alias("a"), F.max_by("value", "rank").alias("b"), F.min("rank").alias("r"))
    joined = both.join(sizes.select("_g", "_n"), F.col("_k").eqNullSafe(F.col("_g")))
    fraction = F.col("prob") * (F.col("_n") - 1) - F.col("r")
    return joined.select(F.col("_k").alias(key), "prob", (F.col("a") + (F.col("b") - F.col("a")) * fraction).alias("percentile"))


def latency_percentiles(logs: DataFrame, exact: bool = True) -> DataFrame:
    """p50 and p95 latency per answer source."""
    counts = logs.groupBy("answer_source")
    if not exact:
        stats = counts.agg(F.count("*").alias("n"), F.percentile_approx("latency_ms", [0.5, 0.95]).cast("array<double>").alias("_p"))
        return stats.select("answer_source", "n", F.round(F.col("_p")[0], 6).alias("p50_ms"), F.round(F.col("_p")[1], 6).alias("p95_ms"))
    cuts = exact_percentiles(logs, "answer_source", "latency_ms", [0.5, 0.95])
    wide = cuts.groupBy(F.col("answer_source").alias("_s")).agg(
        F.round(F.max(F.when(F.col("prob") == 0.5, F.col("percentile"))), 6).alias("p50_ms"), F.round(F.max(F.when(F.col("prob") == 0.95, F.col("percentile"))), 6).alias("p95_ms")
    )
    joined = counts.agg(F.count("*").alias("n")).join(wide, F.col("answer_source").eqNullSafe(F.col("_s")), "left")
    return joined.select("answer_source", "n", "p50_ms", "p95_ms")


# ---------------------------------------------------------------- health


def status_counts(rows: DataFrame, *keys: str, limit: int | None = None) -> DataFrame:
    out = rows.groupBy(*keys).agg(F.count("*").alias("count")).orderBy(F.col("count").desc(), *keys)
    return out if limit is None else out.limit(limit)


def report_summary(reports: DataFrame, limit: int = 10, key: str = "report_id", status: str = "status", open_status: str = "open") -> DataFrame:
    """(part, rank, report_id, status, count): ``total``, one row per ``status``, and the newest ``recent`` and ``open`` reports.

    The two lists are cut to ``limit`` rows, newest (largest id) first.
    """
    none, n = F.lit(None), positive(limit)
    counted = status_counts(reports, status)
    total = counted.agg(F.coalesce(F.sum("count"), F.lit(0)).alias("count")).select(F.lit("total").alias("part"), F.lit(1).alias("rank"), none.cast("string").alias("status"), "count")
    by_count = Window.orderBy(F.col("count").desc(), F.col(status))  # a row per status
    states = counted.select(F.lit("status").alias("part"), F.row_number().over(by_count).alias("rank"), F.col(status).alias("status"), "count")

    def newest_of(part: str, rows: DataFrame) -> DataFrame:
        few = rows.select(key, F.col(status).alias("status")).orderBy(F.col(key).desc()).limit(n)
        return few.select(F.lit(part).alias("part"), F.row_number().over(Window.orderBy(F.col(key).desc())).alias("rank"), F.col(key).alias("report_id"), "status")  # limit rows

    parts = [total, states, newest_of("recent", reports), newest_of("open", reports.filter(F.col(status) == open_status))]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    return out.select("part", "rank", "report_id", "status", "count")


def chunk_profile(children: DataFrame, status: Column) -> DataFrame:
    """Rows, tagged rows and counts by validity per corpus."""
    return children.groupBy(F.coalesce("corpus_id", F.lit("unknown")).alias("corpus_id"), status.alias("valid_status")).agg(
        F.count("*").alias("row_count"), F.count_if(F.size("search_tags") > 0).alias("tagged_count")
    )


def index_summary(parents: DataFrame, children: DataFrame, index: DataFrame, report: DataFrame) -> DataFrame:
    """One row: chunk counts, tag coverage, warned documents and vector/child mismatch."""
    kids = children.agg(F.count("*").alias("child_chunks"), F.count_if(F.size("search_tags") > 0).alias("tagged_chunks"))
    n_parents = parents.agg(F.count("*").alias("n")).select("n").scalar()
    n_vectors = index.agg(F.count("*").alias("n")).select("n").scalar()
    warned = report.agg(F.count_if(F.col("warnings") != "").alias("n")).select("n").scalar()
    return kids.select(
        n_parents.alias("parent_chunks"), "child_chunks", "tagged_chunks", ratio("tagged_chunks", "child_chunks").alias("tag_coverage_rate"),
        warned.alias("chunk_warnings"), n_vectors.alias("vector_count"), (n_vectors != F.col("child_chunks")).alias("vector_mismatch"),
    )


def ops_kpis(logs: DataFrame, as_of: str, days: int = 7, low_score: float = LOW_SCORE) -> DataFrame:
    """One row of operating figures for the last ``days``."""
    inside = logs.filter(_at() >= cutoff(as_of, 24 * days))
    rows = log_metrics(inside)
    state = quality_state(low_score=low_score)
    raw_rag = F.col("answer_source") == "rag"
    agg = rows.agg(
        F.count("*").alias("questions_in_window"),
        F.count_distinct("session_id").alias("sessions_in_window"),
        F.count_if(state == "no_sources").alias("no_hit_count"),
        F.count_if(state == "low_confidence").alias("low_confidence_count"),
        F.count_if("cache_hit").alias("qa_cache_hits"),
        F.count_if(raw_rag).alias("rag_answers"),
        F.count_if(F.coalesce("error_type", F.lit("")) != "").alias("error_count"),
    )
    q = "questions_in_window"
    return agg.select(
        "*", ratio("no_hit_count", q).alias("no_hit_rate"), ratio("low_confidence_count", q).alias("low_confidence_rate"),
        ratio("qa_cache_hits", q).alias("qa_cache_hit_rate"), ratio("rag_answers", q).alias("rag_answer_rate"),
    )


def ops_alerts(kpis: DataFrame) -> DataFrame:
    """Alert rows (level, alert) from a KPI row with open_reports, chunk_warnings and vector_mismatch."""
    seen = F.col("questions_in_window") > 0
    checks = [
        (F.col("open_reports") > 0, "error", "open_reports"),
        (seen & (F.col("no_hit_rate") >= 0.1), "warning", "no_hit_rate"),
        (seen & (F.col("low_confidence_rate") >= 0.2), "warning", "low_confidence_rate"),
        (F.col("chunk_warnings") > 0, "warning", "chunk_warnings"),
        (F.col("vector_mismatch"), "error", "vector_mismatch"),
    ]
    rows = F.array_compact(F.array(*[F.when(t, F.struct(F.lit(level).alias("level"), F.lit(name).alias("alert"))) for t, level, name in checks]))
    return kpis.select(F.inline(rows))


def health_status(alerts: DataFrame) -> DataFrame:
    """One row: error, warning or OK."""
    worst = F.max(F.when(F.col("level") == "error", 2).when(F.col("level") == "warning", 1).otherwise(0))
    return alerts.agg(F.coalesce(worst, F.lit(0)).alias("_w"), F.count("*").alias("alerts")).select(
        F.when(F.col("_w") == 2, "error").when(F.col("_w") == 1, "warning").otherwise("OK").alias("status"), "alerts"
    )
