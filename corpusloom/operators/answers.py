"""Approved answers: matching questions to them and applying changes to their tables.

``qa`` rows: (id, status, question, answer, embedding, evidence, corpus_version,
index_version, approved_by, source_report_id, memo, needs_alias_review, updated_at ...).
``aliases`` rows: (id, qa_id, status, alias_text, normalized_text, alias_type,
embedding, generator_model, memo, risk_flags, updated_at ...).
Changes are pure functions from the current snapshot and a change batch to the next
snapshot; times are passed in.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions.text import blank_to_null, clean_markup, col, normalize_question, number_references, strip, text_or_empty
from corpusloom.functions.values import fenced_json, json_strings, positive
from corpusloom.operators.dense import alias_index, vector_topk, vector_topk_groups
from corpusloom.operators.ranking import match_margin, ordinal

# Allowed states and kinds.
QA_STATUSES = ["approved", "disabled"]
ALIAS_STATUSES = ["active", "disabled"]
ALIAS_TYPES = ["original", "admin_alias", "llm_paraphrase", "normalized"]
REPORT_STATUSES = ["open", "resolved", "ignored"]
GENERATED = "llm_paraphrase"
# Words that narrow a question in scope or time, and the topic pair to keep apart.
NARROWING_WORDS = ["個別", "具体的", "ケース", "判断", "令和", "年度", "改正"]
INHERITANCE, GIFT = "相続税", "贈与税"
CONFLICT_FLAG = "alias_conflict_across_qa"
CHANGED_NOTE = "disabled because parent QA content changed"


@dataclass(frozen=True)
class Matching:
    """Thresholds and versions of the lookup."""

    accept: float = 0.88
    gray: float = 0.82
    margin: float = 0.03
    judge_min: float = 0.82
    corpus_version: str = "default"
    index_version: str = "default"
    empty_evidence_passes: bool = False


# ---------------------------------------------------------------- lookup


def evidence_matches(evidence, corpus_ids, empty_evidence_passes: bool = False) -> Column:
    """Whether an evidence list touches the requested corpora (NULL: any)."""
    wanted, rows = col(corpus_ids), col(evidence)
    own = F.array_compact(F.transform(rows, lambda e: blank_to_null(e["corpus_id"])))
    empty = F.coalesce(F.size(rows), F.lit(0)) == 0
    overlap = F.coalesce(F.arrays_overlap(own, wanted), F.lit(False))
    passes = F.when(empty, F.lit(empty_evidence_passes)).otherwise(overlap)
    return F.when(wanted.isNull(), F.lit(True)).when(F.size(wanted) == 0, F.lit(False)).otherwise(passes)


def active_aliases(qa: DataFrame, aliases: DataFrame, include_disabled_qa: bool = False, include_disabled_aliases: bool = False) -> DataFrame:
    """Active aliases with their approved QA."""
    a = aliases if include_disabled_aliases else aliases.filter("status = 'active'")
    q = qa if include_disabled_qa else qa.filter("status = 'approved'")
    left = a.select(
        F.col("id").alias("alias_id"), "qa_id", "alias_text", "normalized_text", "alias_type", F.col("status").alias("alias_status"), "embedding",
        *([F.col("risk_flags")] if "risk_flags" in a.columns else []),
    )
    right = q.select(F.col("id").alias("qa_id"), F.col("status").alias("qa_status"), "question", "answer", "evidence", "corpus_version", "index_version")
    return left.join(right, "qa_id")


def in_version(rows: DataFrame, rules: Matching) -> DataFrame:
    return rows.filter((F.col("corpus_version") == rules.corpus_version) & (F.col("index_version") == rules.index_version))


def exact_matches(questions: DataFrame, snapshot: DataFrame) -> DataFrame:
    """Questions whose normalised text equals an alias: first alias per QA, number of QAs.

    One QA is a hit, several are a conflict.
    """
    wanted = questions.withColumn("_norm", normalize_question("question")).filter("_norm <> ''")
    alias = snapshot.select("alias_id", "qa_id", "normalized_text", "evidence")
    pairs = wanted.join(alias, wanted["_norm"] == alias["normalized_text"])
    if "corpus_ids" in questions.columns:
        pairs = pairs.filter(evidence_matches("evidence", "corpus_ids"))
    # one row per (query, QA) before looking at the query as a whole
    per_qa = pairs.groupBy("query_id", "qa_id").agg(F.min("alias_id").alias("alias_id"), F.first("normalized_text").alias("normalized_text"))
    per_query = per_qa.groupBy("query_id").agg(
        F.count("*").alias("qa_count"), F.min_by("qa_id", "alias_id").alias("qa_id"), F.min("alias_id").alias("alias_id"), F.first("normalized_text").alias("normalized_text")
    )
    return per_query.withColumn("decision", F.when(F.col("qa_count") == 1, "hit").otherwise("gray")).withColumn(
        "miss_reason", F.when(F.col("qa_count") > 1, "alias_conflict")
    )


def semantic_candidates(questions: DataFrame, snapshot: DataFrame, top_n: int = 10) -> DataFrame:
    """(query_id, qa_id, alias_id, similarity, rank): best alias per QA, QAs ranked.

    ``snapshot`` is an :func:`active_aliases` result; ``questions`` has (query_id,
    embedding[, corpus_ids]).  A QA counts for a question only if its evidence touches
    the requested corpora.
    """
    usable = alias_index(snapshot)
    index = usable.select(
        F.col("alias_id").alias("child_id"), F.col("qa_id").alias("group_id"), "embedding",
        F.array_distinct(F.array_compact(F.transform(F.coalesce("evidence", F.array().cast(usable.schema["evidence"].dataType)), lambda e: e["corpus_id"]))).alias("corpus_id"),
    )
    hits = vector_topk_groups(index, questions, top_n, "cosine")
    return hits.select("query_id", F.col("group_id").alias("qa_id"), F.col("child_id").alias("alias_id"), F.col("score").alias("similarity"), "rank")


def decide(candidates: DataFrame, rules: Matching = Matching()) -> DataFrame:
    """Best candidate per query with margin, decision and miss reason.

    The margin is tested before the accept band, so a best row between both thresholds
    with a small margin reports ``margin_too_small``.
    """
    best = match_margin(candidates.drop("rank"), "query_id", "similarity", "qa_id")
    s, m = F.col("similarity"), F.col("margin")
    reason = (
        F.when(s < rules.gray, "below_gray_threshold")
        .when((s >= rules.accept) & (m >= rules.margin), F.lit(None))
        .when(m < rules.margin, "margin_too_small")
        .otherwise("below_accept_threshold")
    )
    decision = F.when(reason.isNull(), "hit").when(reason == "below_gray_threshold", "miss").otherwise("gray")
    return best.withColumn("decision", decision).withColumn("miss_reason", reason)


def match_questions(questions: DataFrame, qa: DataFrame, aliases: DataFrame, rules: Matching = Matching(), top_n: int = 10) -> DataFrame:
    """Exact text matches first, the others by similarity: one decision row per question."""
    snapshot = in_version(active_aliases(qa, aliases), rules)
    exact = exact_matches(questions, snapshot).select(
        "query_id", "qa_id", "alias_id", F.lit(1.0).alias("similarity"), F.lit(1.0).alias("margin"), "decision", "miss_reason",
        F.lit("normalized_exact").alias("match_method"),
    )
    rest = questions.join(exact.select("query_id"), "query_id", "left_anti")
    semantic = decide(semantic_candidates(rest, snapshot, top_n), rules).join(snapshot.select("alias_id", "alias_type"), "alias_id").select(
        "query_id", "qa_id", "alias_id", "similarity", "margin", "decision", "miss_reason",
        F.when(F.col("alias_type") == "original", "original_semantic").otherwise("alias_semantic").alias("match_method"),
    )
    return exact.unionByName(semantic)


def candidate_rows(candidates: DataFrame, snapshot: DataFrame, rules: Matching = Matching()) -> DataFrame:
    """Candidates with texts, rounded scores, margin of the best and the would-hit flag."""
    best = match_margin(candidates.drop("rank"), "query_id", "similarity", "qa_id").select("query_id", F.col("margin").alias("_m"))
    rows = candidates.join(best, "query_id").join(snapshot.drop("qa_id", "embedding"), "alias_id")
    first = F.col("rank") == 1
    method = F.when(F.col("alias_type") == "original", "original_semantic").otherwise("alias_semantic")
    return rows.select(
        "query_id", "rank", "qa_id", "alias_id", "alias_text", "alias_type", "question", "answer",
        F.size(F.coalesce("evidence", F.array())).alias("evidence_count"),
        F.round("similarity", 6).alias("similarity"),
        F.when(first, F.round("_m", 6)).otherwise(0.0).alias("margin"),
        method.alias("match_method"),
        (first & (F.col("similarity") >= rules.accept) & (F.col("_m") >= rules.margin)).alias("would_hit"),
    )


def similar_approved(candidates: DataFrame, threshold: float = 0.0, top_n: int = 5) -> DataFrame:
    """Ranked candidates at or above the threshold, the first ``top_n``."""
    return candidates.filter((F.col("similarity") >= max(0.0, threshold)) & (F.col("rank") <= positive(top_n)))


def simple_lookup(questions: DataFrame, qa: DataFrame, threshold: float = 0.88, rules: Matching = Matching()) -> DataFrame:
    """Best approved QA of the version by cosine similarity, accepted at the threshold."""
    index = in_version(qa.filter("status = 'approved'"), rules).select(F.col("id").alias("child_id"), "embedding")
    best = vector_topk(index, questions, 1, "cosine")
    return best.filter(F.col("score") >= threshold).select("query_id", F.col("child_id").alias("qa_id"), F.col("score").alias("similarity"))


def judge_eligibility(matches: DataFrame, rules: Matching = Matching()) -> DataFrame:
    """Which gray rows may be judged, and why the others may not."""
    reason = (
        F.when(F.col("decision") != "gray", F.coalesce("miss_reason", F.lit("not_gray")))
        .when(F.col("miss_reason") != "below_accept_threshold", F.col("miss_reason"))
        .when(F.col("similarity") < rules.judge_min, "below_intent_judge_gray_min")
        .when(F.col("margin") < rules.margin, "margin_too_small")
    )
    return matches.withColumn("can_judge", reason.isNull()).withColumn("skip_reason", reason)


def apply_verdicts(matches: DataFrame, verdicts: DataFrame, rules: Matching = Matching()) -> DataFrame:
    """Apply (query_id, same_intent) verdicts to eligible rows."""
    joined = judge_eligibility(matches, rules).join(verdicts, "query_id", "left")
    yes = F.col("can_judge") & F.coalesce("same_intent", F.lit(False))
    no = F.col("can_judge") & F.col("same_intent").isNotNull() & ~F.col("same_intent")
    return (
        joined.withColumn("decision", F.when(yes, "llm_judge_hit").when(no, "llm_judge_reject").otherwise(F.col("decision")))
        .withColumn("miss_reason", F.when(yes, F.lit(None)).when(no, "llm_judge_rejected").otherwise(F.col("miss_reason")))
        .withColumn("match_method", F.when(yes, "llm_intent_judge").otherwise(F.col("match_method")))
    )


def cache_log_fields(matches: DataFrame) -> DataFrame:
    """What a question's log row keeps of its lookup."""
    return matches.select(
        "query_id", F.col("qa_id").alias("cache_candidate_qa_id"), F.col("alias_id").alias("cache_candidate_alias_id"),
        F.col("similarity").alias("cache_candidate_similarity"), F.col("miss_reason").alias("cache_miss_reason"), F.col("match_method").alias("cache_match_method"),
    )


def evidence_sources(qa: DataFrame, key: str = "id") -> DataFrame:
    """Stored evidence as source rows; rows lacking corpus, parent, child or text are dropped."""
    rows = qa.select(F.col(key), F.posexplode("evidence").alias("_p", "e"))
    out = rows.select(
        F.col(key), (F.col("_p") + 1).alias("source_no"), text_or_empty(F.col("e.corpus_id")).alias("corpus_id"), text_or_empty(F.col("e.parent_id")).alias("parent_id"),
        F.coalesce(blank_to_null(F.col("e.child_id")), F.concat(F.lit("approved_evidence_"), (F.col("_p") + 1).cast("string"))).alias("child_id"),
        F.col("e.title").alias("title"), clean_markup(F.col("e.child_text")).alias("child_text"), F.coalesce(F.col("e.score"), F.lit(1.0)).alias("score"),
    )
    return out.filter("corpus_id <> '' and parent_id <> '' and child_id <> '' and child_text <> ''")


def route_questions(questions: DataFrame, matches: DataFrame, qa: DataFrame, contexts: DataFrame) -> DataFrame:
    """Answer source per question: approved answer, retrieved contexts, or none."""
    hits = matches.filter(F.col("decision").isin("hit", "llm_judge_hit")).select("query_id", "qa_id", "similarity", "match_method")
    answered = questions.join(hits, "query_id").join(qa.select(F.col("id").alias("qa_id"), "answer"), "qa_id").select(
        "query_id", F.lit("approved_qa_cache").alias("answer_source"), "answer", "qa_id", F.lit(0).cast("bigint").alias("context_count")
    )
    counts = contexts.groupBy("query_id").agg(F.count("*").alias("context_count"))
    open_ = questions.join(hits.select("query_id"), "query_id", "left_anti").join(counts, "query_id", "left").fillna(0, ["context_count"])
    routed = open_.select(
        "query_id", F.when(F.col("context_count") > 0, "rag").otherwise("no_context").alias("answer_source"), F.lit(None).cast("string").alias("answer"),
        F.lit(None).cast("bigint").alias("qa_id"), "context_count",
    )
    return answered.unionByName(routed)


# ---------------------------------------------------------------- alias checks


def missing_alias(qa: DataFrame, aliases: DataFrame, alias_type: str, only_approved: bool = True) -> DataFrame:
    """QAs without an active alias of the type."""
    have = aliases.filter((F.col("alias_type") == alias_type) & (F.col("status") == "active")).select(F.col("qa_id").alias("id")).distinct()
    rows = qa.filter("status = 'approved'") if only_approved else qa
    return rows.join(have, "id", "left_anti")


def qa_health(qa: DataFrame, aliases: DataFrame, rules: Matching = Matching()) -> DataFrame:
    """One row: approved QAs in and out of version, without evidence, without aliases."""
    approved = qa.filter("status = 'approved'")
    current = (F.col("corpus_version") == rules.corpus_version) & (F.col("index_version") == rules.index_version)
    types = aliases.filter("status = 'active'").select(F.col("qa_id").alias("id"), "alias_type").distinct()
    has = types.groupBy("id").agg(F.bool_or(F.col("alias_type") == "original").alias("_o"), F.bool_or(F.col("alias_type") == GENERATED).alias("_g"))
    return approved.join(has, "id", "left").agg(
        F.count("*").alias("approved_qa"),
        F.count_if(current).alias("current_version_qa"),
        F.count_if(~current).alias("version_excluded_qa"),
        F.count_if(F.coalesce(F.size("evidence"), F.lit(0)) <= 0).alias("evidence_missing_qa"),
        F.count_if(~F.coalesce("_o", F.lit(False))).alias("original_missing_qa"),
        F.count_if(~F.coalesce("_g", F.lit(False))).alias("llm_missing_qa"),
    )


def alias_conflicts(aliases: DataFrame, limit: int | None = 100) -> DataFrame:
    """Normalised texts active for several QAs, with ids and wordings.

    Ids and wordings are made distinct per text before they are listed.
    """
    active = aliases.filter((F.col("status") == "active") & (F.coalesce("normalized_text", F.lit("")) != ""))
    shared = active.groupBy("normalized_text").agg(F.count_distinct("qa_id").alias("qa_count")).filter("qa_count > 1")
    listed = active.join(shared, "normalized_text").groupBy("normalized_text", "qa_count").agg(
        F.array_join(F.transform(F.sort_array(F.collect_set("qa_id")), lambda i: i.cast("string")), ",").alias("qa_ids"),
        F.array_join(F.sort_array(F.collect_set("alias_text")), " | ").alias("alias_texts"),
    )
    return listed if limit is None else listed.orderBy(F.col("qa_count").desc(), "normalized_text").limit(positive(limit))


def conflict_rows(aliases: DataFrame) -> DataFrame:
    """Active aliases whose normalised text is active for another QA too."""
    active = aliases.filter((F.col("status") == "active") & (F.coalesce("normalized_text", F.lit("")) != ""))
    span = active.groupBy("normalized_text").agg(F.min("qa_id").alias("_lo"), F.max("qa_id").alias("_hi")).filter("_lo <> _hi").select("normalized_text")
    return active.join(span, "normalized_text", "left_semi")


def risk_flags(question, alias_text, evidence_text=None) -> Column:
    """Mechanical warnings for an alias: topic swapped, other article number, narrowed scope."""
    q, a = text_or_empty(question), text_or_empty(alias_text)

    def has(text: Column, word: str) -> Column:
        return F.contains(text, F.lit(word))

    def any_word(text: Column) -> Column:
        return F.exists(F.array(*[F.lit(w) for w in NARROWING_WORDS]), lambda w: F.contains(text, w))

    own = number_references(F.concat_ws("\n", q, text_or_empty(evidence_text)) if evidence_text is not None else q)
    other = number_references(a)
    flags = [
        (has(q, INHERITANCE) & has(a, GIFT) & ~has(q, GIFT), "tax_type_changed_to_gift_tax"),
        (has(q, GIFT) & has(a, INHERITANCE) & ~has(q, INHERITANCE), "tax_type_changed_to_inheritance_tax"),
        ((F.size(own) > 0) & (F.size(other) > 0) & ~F.arrays_overlap(own, other), "taxanswer_no_changed"),
        (any_word(a) & ~any_word(q), "scope_or_time_condition_added"),
    ]
    return F.array_compact(F.array(*[F.when(test, F.lit(name)) for test, name in flags]))


def _evidence_numbers(qa: DataFrame) -> Column:
    """The evidence texts in which article numbers count: number and title."""
    held = qa.schema["evidence"].dataType.elementType.names
    fields = [f for f in ("taxanswer_no", "title") if f in held]
    return F.array_join(F.transform("evidence", lambda e: F.concat_ws("\n", *[e[f] for f in fields])), "\n")


def filter_alias_candidates(candidates: DataFrame, qa: DataFrame, aliases: DataFrame, max_aliases: int | None = None, max_length: int | None = None) -> DataFrame:
    """Usable new wordings per QA: not the question, not known, distinct; if wanted only short ones and the first few.

    ``candidates`` has (qa_id, position, alias_text).
    """
    text = strip(text_or_empty("alias_text"))
    rows = candidates.withColumn("alias_text", text).filter("alias_text <> ''")
    rows = rows if max_length is None else rows.filter(F.length("alias_text") <= max_length)
    rows = rows.withColumn("normalized_text", normalize_question("alias_text")).filter("normalized_text <> ''")
    own = qa.select(F.col("id").alias("qa_id"), normalize_question("question").alias("normalized_text"))
    known = aliases.select("qa_id", "normalized_text").unionByName(own)
    fresh = rows.join(known, ["qa_id", "normalized_text"], "left_anti")
    first = fresh.withColumn("_n", F.row_number().over(Window.partitionBy("qa_id", "normalized_text").orderBy("position"))).filter("_n = 1").drop("_n")
    if max_aliases is None:
        return first
    return first.withColumn("_r", F.row_number().over(Window.partitionBy("qa_id").orderBy("position"))).filter(F.col("_r") <= max_aliases).drop("_r")


def parse_alias_reply(reply) -> Column:
    """Alias texts of a model reply: the ``aliases`` list of its JSON object, else its lines."""
    raw = strip(text_or_empty(reply))
    inner = F.coalesce(blank_to_null(F.regexp_extract(raw, r"(?is)```(?:json)?\s*(.*?)```", 1)), raw)
    text = fenced_json(inner)
    # from each brace on: the first that begins a readable object counts
    starts = F.filter(F.sequence(F.lit(1), F.greatest(F.length(text), F.lit(1))), lambda i: F.substring(text, i, F.lit(1)) == "{")
    found = F.filter(F.transform(starts, lambda i: F.get_json_object(F.substring(text, i, F.length(text)), "$")), lambda o: o.startswith("{"))
    listed = F.get_json_object(F.get(found, F.lit(0)), "$.aliases")
    bullet = r"(?U)^\s*[-*・\d.)）]+\s*"
    lines_ = F.transform(F.split(raw, "\r?\n", -1), lambda l: F.btrim(F.btrim(strip(F.regexp_replace(l, bullet, "")), F.lit('"')), F.lit("'")))
    return F.when(listed.isNotNull() & listed.startswith("["), json_strings(listed)).otherwise(F.filter(lines_, lambda l: l != ""))


# ---------------------------------------------------------------- change batches


def _next_ids(rows: DataFrame, current: DataFrame, order: list[str]) -> DataFrame:
    """Number new rows in batch order after the largest existing id."""
    top = current.agg(F.coalesce(F.max("id"), F.lit(0)).alias("m")).select("m").scalar()
    return ordinal(rows, [], order, "_n").withColumn("id", (top + F.col("_n")).cast("bigint")).drop("_n")


def _fit(rows: DataFrame, like: DataFrame) -> DataFrame:
    """Columns and types of a table, NULL where absent."""
    return rows.select(
        *[(F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in like.schema.fields]
    )


def active_key(aliases: DataFrame) -> DataFrame:
    return aliases.filter("status = 'active'").select("qa_id", "normalized_text", "alias_type").distinct()


def original_aliases(qa: DataFrame, now: str) -> DataFrame:
    """The ``original`` alias of each QA."""
    return qa.select(
        F.col("id").alias("qa_id"), F.lit("active").alias("status"), F.col("question").alias("alias_text"), normalize_question("question").alias("normalized_text"),
        F.lit("original").alias("alias_type"), "embedding", F.lit(now).alias("created_at"), F.lit(now).alias("updated_at"), F.lit("").alias("memo"),
    )


def backfill_original_aliases(qa: DataFrame, aliases: DataFrame, now: str) -> DataFrame:
    """Original aliases to insert for QAs that have none (QAs without a vector are skipped)."""
    missing = missing_alias(qa, aliases, "original", only_approved=False).filter(F.size("embedding") > 0)
    return _fit(_next_ids(original_aliases(missing, now), aliases, ["qa_id"]), aliases)


def backfill_counts(qa: DataFrame, aliases: DataFrame, rules: Matching = Matching()) -> DataFrame:
    """Dry run: targets of the version, inserts and skips."""
    target = in_version(qa.filter("status = 'approved'"), rules)
    missing = missing_alias(target, aliases, "original")
    counts = missing.agg(F.count_if(F.size("embedding") > 0).alias("would_insert"), F.count_if(F.coalesce(F.size("embedding"), F.lit(0)) <= 0).alias("skipped"))
    return counts.withColumn("target_count", target.agg(F.count("*").alias("n")).select("n").scalar())


def create_qa(qa: DataFrame, aliases: DataFrame, reports: DataFrame, new: DataFrame, now: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Insert (change_no, question, answer, embedding, evidence ...) rows with their original
    aliases and resolve the source reports: the three next snapshots."""
    rows = _next_ids(new, qa, ["change_no"]).withColumn("status", F.lit("approved")).withColumn("created_at", F.lit(now)).withColumn("updated_at", F.lit(now))
    added = _fit(rows, qa)
    alias_rows = _fit(_next_ids(original_aliases(rows, now), aliases, ["qa_id"]), aliases)
    solved = rows.filter("source_report_id is not null").groupBy(F.col("source_report_id").alias("_rid")).agg(F.max("id").alias("_qa"))
    r = reports.join(solved, reports["id"] == solved["_rid"], "left")
    hit = F.col("_qa").isNotNull()
    resolved = {
        "status": F.when(hit, F.lit("resolved")).otherwise(F.col("status")),
        "resolved_qa_id": F.coalesce("_qa", "resolved_qa_id"),
        "resolution_type": F.when(hit, F.coalesce("resolution_type", F.lit("qa_created"))).otherwise(F.col("resolution_type")),
        "resolved_at": F.when(hit, F.lit(now)).otherwise(F.col("resolved_at")),
        "updated_at": F.when(hit, F.lit(now)).otherwise(F.col("updated_at")),
    }
    next_reports = _fit(r.withColumns({k: v for k, v in resolved.items() if k in reports.columns}).drop("_rid", "_qa"), reports)
    return qa.unionByName(added), aliases.unionByName(alias_rows), next_reports


def apply_qa_changes(qa: DataFrame, aliases: DataFrame, changes: DataFrame, now: str) -> tuple[DataFrame, DataFrame]:
    """Update QAs by id; a content change disables generated aliases and asks for a review.

    ``changes`` has id and the new values of the QA columns; rows for unknown ids have
    no effect.  Returns the next QA and alias snapshots.
    """
    fields = [c for c in changes.columns if c != "id"]
    new = changes.select("id", F.lit(True).alias("_hit"), *[F.col(c).alias(f"_n_{c}") for c in fields])
    joined = qa.join(new, "id", "left")
    changed = F.lit(False)
    for c in ("question", "answer", "evidence"):
        if c in fields:
            changed = changed | ~F.col(c).eqNullSafe(F.col(f"_n_{c}"))
    changed = F.coalesce(F.col("_hit"), F.lit(False)) & changed
    staged = joined.withColumn("_changed", changed)
    updates = {c: F.when(F.col("_hit"), F.col(f"_n_{c}")).otherwise(F.col(c)) for c in fields if c in qa.columns}
    updates["updated_at"] = F.when(F.col("_hit"), F.lit(now)).otherwise(F.col("updated_at"))
    updates["needs_alias_review"] = F.when(F.col("_hit"), F.col("_changed")).otherwise(F.col("needs_alias_review"))
    next_qa = _fit(staged.withColumns(updates), qa)

    touched = staged.filter("_hit").select(
        F.col("id").alias("qa_id"), "_changed", *(["_n_question"] if "question" in fields else []), *(["_n_embedding"] if "embedding" in fields else [])
    )
    a = aliases.join(touched, "qa_id", "left")
    off = F.coalesce("_changed", F.lit(False)) & (F.col("alias_type") == GENERATED) & (F.col("status") == "active")
    own = F.col("_changed").isNotNull() & (F.col("alias_type") == "original") & (F.col("status") == "active")
    note = F.when(F.coalesce("memo", F.lit("")) == "", F.lit(CHANGED_NOTE)).otherwise(F.concat("memo", F.lit(" / " + CHANGED_NOTE)))
    alias_updates = {
        "memo": F.when(off, note).otherwise(F.col("memo")),
        "updated_at": F.when(off | own, F.lit(now)).otherwise(F.col("updated_at")),
        "status": F.when(off, F.lit("disabled")).otherwise(F.col("status")),
    }
    if "question" in fields:
        alias_updates["alias_text"] = F.when(own, F.col("_n_question")).otherwise(F.col("alias_text"))
        alias_updates["normalized_text"] = F.when(own, normalize_question("_n_question")).otherwise(F.col("normalized_text"))
    if "embedding" in fields:
        alias_updates["embedding"] = F.when(own, F.col("_n_embedding")).otherwise(F.col("embedding"))
    return next_qa, _fit(a.withColumns(alias_updates), aliases)


def disable_rows(rows: DataFrame, requests: DataFrame, now: str) -> DataFrame:
    """Disable rows by id; a non-blank memo replaces the old one."""
    joined = rows.join(requests.select("id", F.coalesce("memo", F.lit("")).alias("_memo")), "id", "left")
    hit = F.col("_memo").isNotNull()
    return _fit(
        joined.withColumns(
            {
                "status": F.when(hit, F.lit("disabled")).otherwise(F.col("status")),
                "memo": F.when(hit & (F.col("_memo") != ""), F.col("_memo")).otherwise(F.col("memo")),
                "updated_at": F.when(hit, F.lit(now)).otherwise(F.col("updated_at")),
            }
        ),
        rows,
    )


def disable_alias_type(aliases: DataFrame, qa_ids: DataFrame, alias_type: str, now: str, memo: str = "") -> DataFrame:
    """Disable a QA's active aliases of one type."""
    if alias_type not in ALIAS_TYPES:
        raise ValueError("invalid alias_type")
    hit = aliases.filter((F.col("alias_type") == alias_type) & (F.col("status") == "active")).join(qa_ids.select("qa_id"), "qa_id", "left_semi")
    return disable_rows(aliases, hit.select("id", F.lit(memo).alias("memo")), now)


def _conflicting(rows: DataFrame, aliases: DataFrame) -> DataFrame:
    """Add ``_conflict``: the normalised text is active for another QA."""
    span = aliases.filter("status = 'active'").groupBy("normalized_text").agg(F.min("qa_id").alias("_lo"), F.max("qa_id").alias("_hi"))
    joined = rows.join(span, "normalized_text", "left")
    return joined.withColumn("_conflict", F.coalesce((F.col("_lo") != F.col("qa_id")) | (F.col("_hi") != F.col("qa_id")), F.lit(False))).drop("_lo", "_hi")


def add_aliases(qa: DataFrame, aliases: DataFrame, new: DataFrame, now: str, default_status: str = "active", generated_status: str = "active") -> tuple[DataFrame, DataFrame]:
    """Add aliases in batch order: (rows to insert, outcome rows).

    ``new`` has (qa_id, position, alias_text, alias_type, status, embedding[, force_active_conflict]).
    Invalid rows become errors; a text active for another QA is stored disabled unless
    forced; an active duplicate of (qa, text, type) is skipped.  Earlier rows of the
    batch count as existing.
    """
    kind = F.coalesce("alias_type", F.lit("admin_alias"))
    rows = new.withColumn("alias_type", kind).withColumn("alias_text", strip(text_or_empty("alias_text")))
    wanted = F.coalesce(blank_to_null("status"), F.when(F.col("alias_type") == GENERATED, F.lit(generated_status)).otherwise(F.lit(default_status)))
    rows = rows.withColumn("status", wanted).withColumn("normalized_text", normalize_question("alias_text"))
    rows = rows.join(qa.select(F.col("id").alias("qa_id"), F.col("question").alias("_question"), _evidence_numbers(qa).alias("_evidence")), "qa_id", "left")
    error = (
        F.when(F.col("_question").isNull(), "approved QA not found")
        .when(~F.col("alias_type").isin(ALIAS_TYPES), "invalid alias_type")
        .when(~F.col("status").isin(ALIAS_STATUSES), "invalid status")
        .when(F.col("embedding").isNull(), "embedding required")
    )
    rows = rows.withColumn("_error", error).withColumn("_empty", F.col("alias_text") == "")
    rows = _conflicting(rows, aliases)
    valid = F.col("_error").isNull() & ~F.col("_empty")
    # earlier rows of this batch: an active text first used by another QA also conflicts
    force = F.coalesce(F.col("force_active_conflict"), F.lit(False)) if "force_active_conflict" in new.columns else F.lit(False)
    claims = valid & (F.col("status") == "active") & (~F.col("_conflict") | force)
    order = Window.partitionBy("normalized_text").orderBy("position").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_first_qa", F.first(F.when(claims, F.col("qa_id")), True).over(order))
    conflict = F.col("_conflict") | F.coalesce(F.col("_first_qa") != F.col("qa_id"), F.lit(False))
    rows = rows.withColumn("_conflict", conflict)
    flags = F.array_union(risk_flags("_question", "alias_text", "_evidence"), F.when(F.col("_conflict") & (F.col("status") == "active") & ~force, F.array(F.lit(CONFLICT_FLAG))).otherwise(F.array().cast("array<string>")))
    rows = rows.withColumn("risk_flags", flags).withColumn("status", F.when(F.col("_conflict") & ~force, F.lit("disabled")).otherwise(F.col("status")))
    key = ["qa_id", "normalized_text", "alias_type"]
    held = active_key(aliases).withColumn("_held", F.lit(True))
    rows = rows.join(held, key, "left")
    live = valid & (F.col("status") == "active")
    rows = rows.withColumn("_nth", F.count_if(live).over(Window.partitionBy(*key).orderBy("position").rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    duplicate = live & (F.coalesce("_held", F.lit(False)) | (F.col("_nth") > 1))
    outcome = F.when(F.col("_error").isNotNull(), "error").when(F.col("_empty") | duplicate, "skipped").otherwise("created")
    reason = F.coalesce("_error", F.when(F.col("_empty"), "empty").when(duplicate, "duplicate"))
    judged = rows.withColumn("outcome", outcome).withColumn("reason", reason).withColumn("warning", F.when(valid & F.col("_conflict"), F.lit(CONFLICT_FLAG)))
    results = judged.select("qa_id", "position", "alias_text", "normalized_text", "alias_type", "status", "risk_flags", "outcome", "reason", "warning")
    insert = judged.filter("outcome = 'created'").withColumn("created_at", F.lit(now)).withColumn("updated_at", F.lit(now))
    return _fit(_next_ids(insert, aliases, ["qa_id", "position"]), aliases), results


def replace_generated_aliases(qa: DataFrame, aliases: DataFrame, new: DataFrame, now: str, memo: str = "replace generated aliases", generated_status: str = "active") -> DataFrame:
    """Next alias snapshot: a QA's generated aliases are replaced if it has any valid new row."""
    rows = new.withColumn("alias_text", strip(text_or_empty("alias_text"))).filter((F.col("alias_text") != "") & F.col("embedding").isNotNull())
    rows = rows.join(qa.select(F.col("id").alias("qa_id"), F.col("question").alias("_question"), _evidence_numbers(qa).alias("_evidence")), "qa_id")
    rows = rows.withColumn("normalized_text", normalize_question("alias_text"))
    rows = _conflicting(rows, aliases)
    flags = F.array_union(risk_flags("_question", "alias_text", "_evidence"), F.when(F.col("_conflict"), F.array(F.lit(CONFLICT_FLAG))).otherwise(F.array().cast("array<string>")))
    prepared = (
        rows.withColumn("risk_flags", flags)
        .withColumn("status", F.when(F.col("_conflict"), F.lit("disabled")).otherwise(F.lit(generated_status)))
        .withColumn("alias_type", F.lit(GENERATED)).withColumn("memo", F.lit(memo)).withColumn("created_at", F.lit(now)).withColumn("updated_at", F.lit(now))
    )
    kept = disable_alias_type(aliases, prepared.select("qa_id").distinct(), GENERATED, now, memo)
    return kept.unionByName(_fit(_next_ids(prepared, aliases, ["qa_id", "position"]), aliases))


def update_aliases(qa: DataFrame, aliases: DataFrame, changes: DataFrame, now: str) -> DataFrame:
    """Update alias text, status, vector or memo by id; an active text of another QA is demoted.

    A changed text needs a new vector; such rows without one are left as they are.
    """
    c = changes.select("id", F.lit(True).alias("_hit"), *[F.col(n).alias(f"_n_{n}") for n in ("alias_text", "status", "embedding", "memo")])
    joined = aliases.join(c, "id", "left").join(qa.select(F.col("id").alias("qa_id"), F.col("question").alias("_question"), _evidence_numbers(qa).alias("_evidence")), "qa_id", "left")
    text = strip(F.coalesce("_n_alias_text", "alias_text"))
    moved = joined.withColumn("_text", text).withColumn("_text_changed", F.col("_text") != F.col("alias_text"))
    ok = F.coalesce("_hit", F.lit(False)) & (F.col("_text") != "") & (~F.col("_text_changed") | F.col("_n_embedding").isNotNull())
    moved = moved.withColumn("_ok", ok).withColumn("_norm", normalize_question("_text"))
    span = aliases.filter("status = 'active'").groupBy(F.col("normalized_text").alias("_norm")).agg(F.min("qa_id").alias("_lo"), F.max("qa_id").alias("_hi"))
    moved = moved.join(span, "_norm", "left")
    status = F.coalesce("_n_status", "status")
    conflict = (status == "active") & F.coalesce((F.col("_lo") != F.col("qa_id")) | (F.col("_hi") != F.col("qa_id")), F.lit(False))
    flags = F.when(F.col("_text_changed"), risk_flags("_question", "_text", "_evidence")).otherwise(F.coalesce("risk_flags", F.array().cast("array<string>")))
    flags = F.when(conflict, F.array_union(flags, F.array(F.lit(CONFLICT_FLAG)))).otherwise(flags)

    def new(value: Column, name: str) -> Column:
        return F.when(F.col("_ok"), value).otherwise(F.col(name))

    return _fit(
        moved.withColumns(
            {
                "risk_flags": new(flags, "risk_flags"),
                "status": new(F.when(conflict, F.lit("disabled")).otherwise(status), "status"),
                "normalized_text": new(F.col("_norm"), "normalized_text"),
                "embedding": new(F.coalesce("_n_embedding", "embedding"), "embedding"),
                "memo": new(F.coalesce(blank_to_null("_n_memo"), F.col("memo")), "memo"),
                "updated_at": new(F.lit(now), "updated_at"),
                "alias_text": new(F.col("_text"), "alias_text"),
            }
        ),
        aliases,
    )


def alias_list_order(aliases: DataFrame) -> DataFrame:
    """Active first, then type and id, within each QA."""
    return aliases.orderBy("qa_id", (F.col("status") == "active").desc(), "alias_type", "id")


def update_reports(reports: DataFrame, changes: DataFrame, now: str) -> DataFrame:
    """Report changes by id: the resolution time is set once and cleared on reopening;
    absent fields keep their value, a blank memo keeps the old one."""
    fields = ["status", "issue_type", "resolution_type", "admin_memo", "linked_child_id", "resolved_qa_id"]
    given = [f for f in fields if f in changes.columns]
    joined = reports.join(changes.select("id", F.lit(True).alias("_hit"), *[F.col(f).alias(f"_n_{f}") for f in given]), "id", "left")
    hit = F.coalesce("_hit", F.lit(False))
    status = F.coalesce(F.col("_n_status"), F.col("status"), F.lit("open")) if "status" in given else F.coalesce("status", F.lit("open"))
    updates = {f: F.when(hit, F.coalesce(F.col(f"_n_{f}"), F.col(f))).otherwise(F.col(f)) for f in given if f not in ("status", "admin_memo")}
    if "admin_memo" in given:
        updates["admin_memo"] = F.when(hit, F.coalesce(blank_to_null("_n_admin_memo"), F.col("admin_memo"), F.lit(""))).otherwise(F.col("admin_memo"))
    resolved = F.when(status == "open", F.lit(None).cast("string")).when(status.isin("resolved", "ignored"), F.coalesce("resolved_at", F.lit(now))).otherwise(F.col("resolved_at"))
    updates["resolved_at"] = F.when(hit, resolved).otherwise(F.col("resolved_at"))
    updates["updated_at"] = F.when(hit, F.lit(now)).otherwise(F.col("updated_at"))
    updates["status"] = F.when(hit, status).otherwise(F.col("status"))
    return _fit(joined.withColumns(updates), reports)


# ---------------------------------------------------------------- seeds


def importable_seeds(seeds: DataFrame, accept_candidates: bool = False) -> DataFrame:
    """Seeds with evidence and an accepted status; the status words are fixed values."""
    status = F.col("approval_status").isin(["approved", "candidate_needs_admin_review"] if accept_candidates else ["approved"])
    return seeds.filter((F.coalesce(F.size("evidence"), F.lit(0)) > 0) & status)


def seed_counts(seeds: DataFrame, accept_candidates: bool = False) -> DataFrame:
    ok = F.col("approval_status").isin(["approved", "candidate_needs_admin_review"] if accept_candidates else ["approved"])
    bare = F.coalesce(F.size("evidence"), F.lit(0)) <= 0
    return seeds.agg(
        F.count("*").alias("loaded"), F.count_if(bare).alias("missing_evidence"), F.count_if(~bare & ~F.coalesce(ok, F.lit(False))).alias("skipped_status"),
        F.count_if(~bare & ok).alias("selected"),
    )


def not_registered(seeds: DataFrame, qa: DataFrame) -> DataFrame:
    """Seeds whose question is not yet approved for the same versions."""
    keys = ["question", "corpus_version", "index_version"]
    return seeds.join(qa.filter("status = 'approved'").select(*keys), keys, "left_anti")
