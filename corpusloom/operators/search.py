"""Retrieval: dense and lexical lists fused, reranked, filtered and compared by mode."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions.text import blank_to_null, clean_markup, col, search_text, strip, text_or_empty
from corpusloom.functions.values import positive, release_slug
from corpusloom.operators.dense import vector_topk
from corpusloom.operators.dense_index import VectorIndex, indexed_vectors
from corpusloom.operators.lexical import Okapi, bm25_topk, normalize_lexical, query_terms, tokenize
from corpusloom.operators.lexical_index import LexicalIndex, indexed_topk
from corpusloom.operators.matching import contained_terms
from corpusloom.operators.ranking import dedupe_first, diversify, rerank_filter, topk

# Score bands of answer sources and of the admin view.
BANDS = [(0.75, "high"), (0.55, "medium"), (0.35, "support")]
ADMIN_BANDS = [(0.75, "high"), (0.45, "medium")]


@dataclass(frozen=True)
class Retrieval:
    """Depths, weights and switches of a search."""

    top_k_dense: int = 20
    top_k_bm25: int = 20
    top_k_final: int = 8
    dense_weight: float = 0.65
    bm25_weight: float = 0.35
    dense_overfetch: int = 3
    metric: str = "l2"
    lexical_prefilter: bool = False
    reranker_top_k: int = 8
    reranker_min_score: float = 0.0
    reranker_min_keep: int = 1
    reranker_max_keep: int = 8
    reranker_dedupe_parent: bool = False

    @property
    def weights(self) -> tuple[float, float]:
        total = self.dense_weight + self.bm25_weight
        return (self.dense_weight / total, self.bm25_weight / total) if total > 0 else (0.65, 0.35)


# ---------------------------------------------------------------- predicates


def validity_status(valid_from, valid_until, as_of) -> Column:
    """Status of a validity period on a date: invalid_period, not_started, expired, unbounded or current."""
    start_raw, end_raw = strip(text_or_empty(valid_from)), strip(text_or_empty(valid_until))
    day = F.to_date(F.lit(as_of)) if isinstance(as_of, str) else as_of
    start, end = F.try_to_date(start_raw, "yyyy-MM-dd"), F.try_to_date(end_raw, "yyyy-MM-dd")
    unreadable = ((start_raw != "") & start.isNull()) | ((end_raw != "") & end.isNull())
    return (
        F.when(unreadable | F.coalesce(start > end, F.lit(False)), "invalid_period")
        .when(F.coalesce(start > day, F.lit(False)), "not_started")
        .when(F.coalesce(end < day, F.lit(False)), "expired")
        .when((start_raw == "") & (end_raw == ""), "unbounded")
        .otherwise("current")
    )


def is_current(valid_from, valid_until, as_of) -> Column:
    return validity_status(valid_from, valid_until, as_of).isin("current", "unbounded")


def corpus_filter(rows: DataFrame, corpus_ids: list[str] | None, corpus: str = "corpus_id") -> DataFrame:
    """NULL keeps all rows, an empty list none, otherwise the listed corpora."""
    if corpus_ids is None:
        return rows
    return rows.filter(F.col(corpus).isin(corpus_ids)) if corpus_ids else rows.filter(F.lit(False))


def enabled_corpora(rows: DataFrame, corpora: DataFrame, corpus: str = "corpus_id") -> DataFrame:
    """Rows of enabled corpora (missing flag counts as enabled)."""
    on = corpora.filter(F.coalesce("enabled", F.lit(True))).select(F.col("corpus_id").alias(corpus)).distinct()
    return rows.join(on, corpus, "left_semi")


def score_band(score, bands: list[tuple[float, str]] = BANDS, low: str = "review", missing: str = "support") -> Column:
    s = col(score)
    out = F.when(s.isNull(), missing)
    for floor, name in bands:
        out = out.when(s >= floor, name)
    return out.otherwise(low)


def admin_score_band(score) -> Column:
    s = col(score)
    return F.when(s.isNull(), "none").when(s >= 0.75, "high").when(s >= 0.45, "medium").when(s > 0, "low").otherwise("none")


# ---------------------------------------------------------------- retrieval lists


def with_search_text(children: DataFrame, use_tags: bool = True, extra: list[str] | None = None) -> DataFrame:
    """Add the cleaned indexing text composed of title, heading path, text and tags."""
    tags = "search_tags" if use_tags and "search_tags" in children.columns else None
    return children.withColumn("search_text", clean_markup(search_text("title", "heading_path", "text", tags, extra)))


def embedding_text(children: DataFrame) -> DataFrame:
    """Stored search text if there is one, otherwise the composed one; cleaned."""
    tags = "search_tags" if "search_tags" in children.columns else None
    composed = search_text("title", "heading_path", "text", tags)
    stored = blank_to_null("search_text") if "search_text" in children.columns else F.lit(None).cast("string")
    return children.withColumn("embedding_text", clean_markup(F.coalesce(stored, composed)))


def nearest(index: DataFrame | VectorIndex, queries: DataFrame, k: int, metric: str = "l2") -> DataFrame:
    """The k nearest index rows of each query; a stored index answers in its own metric."""
    return indexed_vectors(index, queries, k) if isinstance(index, VectorIndex) else vector_topk(index, queries, k, metric)


def dense_list(index: DataFrame | VectorIndex, queries: DataFrame, settings: Retrieval = Retrieval(), current: DataFrame | None = None) -> DataFrame:
    """(query_id, child_id, dense_score): over-fetched, then restricted to current children."""
    depth = max(settings.top_k_dense * settings.dense_overfetch, settings.top_k_dense)
    hits = nearest(index, queries, depth, settings.metric).select("query_id", "child_id", F.col("score").alias("dense_score"))
    return hits if current is None else hits.join(current.select("child_id"), "child_id", "left_semi")


def lexical_list(
    children: DataFrame, queries: DataFrame, settings: Retrieval = Retrieval(), okapi: Okapi = Okapi(), keep: Column | None = None, index: LexicalIndex | None = None
) -> DataFrame:
    """(query_id, child_id, bm25_score): the lexical cut, normalised, then filtered.

    ``index`` is the stored index of all ``children``; a filter before the cut needs one of its own rows.
    """
    source = children.filter(keep) if keep is not None and settings.lexical_prefilter else children
    if index is None:
        found = bm25_topk(tokenize(source), query_terms(queries), settings.top_k_bm25, okapi)
    elif source is children:
        found = indexed_topk(index, query_terms(queries), settings.top_k_bm25, okapi)
    else:
        raise ValueError("a stored index cannot be filtered before the cut; store one of the filtered passages")
    return normalize_lexical(found, children, keep).select("query_id", "child_id", "bm25_score")


def fuse(dense: DataFrame, lexical: DataFrame, settings: Retrieval = Retrieval()) -> DataFrame:
    """Full outer union of both lists with the weighted score (missing side counts 0)."""
    dense_weight, bm25_weight = settings.weights
    both = dense.join(lexical, ["query_id", "child_id"], "full").fillna(0.0, ["dense_score", "bm25_score"])
    return both.withColumn("score", F.lit(dense_weight) * F.col("dense_score") + F.lit(bm25_weight) * F.col("bm25_score"))


def attach_children(hits: DataFrame, children: DataFrame, columns: list[str]) -> DataFrame:
    return hits.join(children.select("child_id", *columns), "child_id")


def attach_parent_text(hits: DataFrame, parents: DataFrame) -> DataFrame:
    """Parent text of each hit, empty when the parent is unknown."""
    side = parents.select("parent_id", F.col("text").alias("_ptext"))
    return hits.join(side, "parent_id", "left").withColumn("parent_text", clean_markup(F.coalesce("_ptext", F.lit("")))).drop("_ptext")


def hybrid(fused: DataFrame, k: int, diversified: bool = True) -> DataFrame:
    """Top k of the fused list; ``fused`` needs parent_id when diversified."""
    if not diversified:
        return topk(fused, k)
    # the walk needs the whole ranked list, which the two cuts bound per query
    ranked = fused.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.round("score", 9).desc(), "child_id")))
    return diversify(ranked, k)


def vector_only(index: DataFrame | VectorIndex, queries: DataFrame, current: DataFrame, k: int, metric: str = "l2") -> DataFrame:
    """Over-fetch 3k, drop rows that are not current, keep k; rank is the position before the filter."""
    hits = nearest(index, queries, max(3 * k, k), metric).withColumnRenamed("rank", "retrieval_rank")
    kept = hits.join(current.select("child_id"), "child_id", "left_semi")
    w = Window.partitionBy("query_id").orderBy("retrieval_rank")
    return kept.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= k).drop("_n")


def rerank_merge(ranked: DataFrame, scores: DataFrame, k: int, reranker_top_k: int = 8) -> DataFrame:
    """Re-sort the head of each list by external scores; the tail keeps its order.

    ``scores`` has (query_id, child_id, rerank_score).  Head rows without a score keep
    their hybrid score; queries without any score keep their order.
    """
    head = F.col("rank") <= max(k, reranker_top_k)
    joined = ranked.join(scores.select("query_id", "child_id", F.col("rerank_score").alias("_s")), ["query_id", "child_id"], "left")
    per_query = Window.partitionBy("query_id")
    staged = (
        joined.withColumn("_tail", ~head)
        .withColumn("rerank_score", F.when(head, F.col("_s")))
        .withColumn("_any", F.max(F.col("rerank_score").isNotNull()).over(per_query))
        .withColumn("hybrid_score", F.when(F.col("_any") & head, F.col("score")))
        .withColumn("score", F.coalesce("rerank_score", "score"))
    )
    order = [F.col("_tail"), F.when(~F.col("_tail") & F.col("_any"), F.round("score", 9)).desc_nulls_last(), F.col("rank")]
    return staged.withColumn("_r", F.row_number().over(per_query.orderBy(*order))).drop("rank", "_s", "_tail", "_any").withColumnRenamed("_r", "rank")


def search(fused: DataFrame, scores: DataFrame | None, k: int, settings: Retrieval = Retrieval()) -> DataFrame:
    """Wide hybrid list, rerank, filters (or diversification without scores), final rank."""
    wide = max(k, settings.reranker_top_k, settings.top_k_dense + settings.top_k_bm25)
    ranked = topk(fused, wide)
    if scores is None:
        return diversify(ranked, k).withColumn("retrieval_mode", F.lit("hybrid"))
    merged = rerank_merge(ranked, scores, k, settings.reranker_top_k)
    kept = rerank_filter(
        merged, k, settings.reranker_min_score, settings.reranker_min_keep, settings.reranker_max_keep, settings.reranker_dedupe_parent
    )
    return kept.withColumn("retrieval_mode", F.lit("hybrid_reranker"))


def compare_modes(vector: DataFrame, hybrid_rows: DataFrame, reranked: DataFrame) -> DataFrame:
    """One table of (retrieval_mode, query_id, rank, child_id, score)."""

    def labelled(rows: DataFrame, mode: str, rank: str = "rank") -> DataFrame:
        return rows.select(F.lit(mode).alias("retrieval_mode"), "query_id", F.col(rank).alias("rank"), "child_id", "score")

    return (
        labelled(vector, "vector", "retrieval_rank")
        .unionByName(labelled(hybrid_rows, "hybrid"))
        .unionByName(labelled(reranked, "hybrid_reranker"))
    )


# ---------------------------------------------------------------- companions


def match_forms(rows: DataFrame, forms: DataFrame, key: str, haystack: str) -> DataFrame:
    """(key, form_name): forms whose name occurs in the text."""
    return contained_terms(rows, key, haystack, forms, "form_name").withColumnRenamed("term", "form_name")


def form_rows(matches: DataFrame, forms: DataFrame, order: str = "form_no") -> DataFrame:
    """Catalogue columns of the matched forms: the first catalogue row of each name."""
    return matches.join(dedupe_first(forms, "form_name", [order]), "form_name")


def related_chunks(
    seeds: DataFrame, children: DataFrame, limit: int = 4, query: str = "query_id", group: str = "meeting_id", corpus_ids: str | None = None
) -> DataFrame:
    """Other passages of the seeds' meetings, scored by shared agenda, topic and new source type.

    ``corpus_ids`` names a seed column with the corpora that its query may see (NULL: all); children
    then have a ``corpus_id``.

    A passage's score depends only on its meeting, agenda, topic, source type and corpus.  Of each such
    class a query can use ``limit`` passages besides its own seeds, so the classes are cut to that first and a
    query meets classes, not all passages of a meeting.
    """
    with_meeting = seeds.filter(F.coalesce(F.col(group), F.lit("")) != "")
    # seeds are a query's final rows (a handful), so these sets stay small
    allowed = [F.first(corpus_ids).alias("_allowed")] if corpus_ids else []
    sets = with_meeting.groupBy(query).agg(
        F.collect_set("agenda").alias("_agendas"), F.collect_set("topic").alias("_topics"), F.collect_set("source_type").alias("_types"),
        F.collect_set("child_id").alias("_seen"), *allowed,
    )
    most = with_meeting.groupBy(query).agg(F.count_distinct("child_id").alias("n")).agg(F.max("n")).first()[0] or 0
    classes = [group, "agenda", "topic", "source_type", *(["corpus_id"] if corpus_ids else [])]
    first = Window.partitionBy(*classes).orderBy("child_id")
    useful = children.withColumn("_n", F.row_number().over(first)).filter(F.col("_n") <= positive(limit) + most).drop("_n")
    meetings = with_meeting.select(query, group).distinct().join(sets, query)
    pairs = meetings.join(useful, group).filter(~F.array_contains("_seen", F.col("child_id")))
    if corpus_ids:
        pairs = pairs.filter(F.col("_allowed").isNull() | F.coalesce(F.array_contains("_allowed", F.col("corpus_id")), F.lit(False))).drop("_allowed")
    agenda = (F.coalesce("agenda", F.lit("")) != "") & F.array_contains("_agendas", F.col("agenda"))
    topic = (F.coalesce("topic", F.lit("")) != "") & F.array_contains("_topics", F.col("topic"))
    kind = (F.coalesce("source_type", F.lit("")) != "") & ~F.array_contains("_types", F.col("source_type"))

    def points(test: Column, value: float) -> Column:
        return F.when(F.coalesce(test, F.lit(False)), F.lit(value)).otherwise(F.lit(0.0))

    def reason(test: Column, name: str) -> Column:
        return F.when(F.coalesce(test, F.lit(False)), F.lit(name))

    scored = pairs.withColumn("score", F.lit(0.10) + points(agenda, 0.25) + points(topic, 0.25) + points(kind, 0.20)).withColumn(
        "auxiliary_reason",
        F.concat_ws(",", F.lit("same_meeting_id"), reason(agenda, "same_agenda"), reason(topic, "same_topic"), reason(kind, "different_source_type")),
    )
    return topk(scored, limit, query).drop("_agendas", "_topics", "_types", "_seen")


def with_related(final: DataFrame, related: DataFrame) -> DataFrame:
    """Search rows followed by their auxiliary rows."""
    marked = related.withColumn("auxiliary_context", F.lit(True))
    return final.withColumn("auxiliary_context", F.lit(False)).unionByName(marked, allowMissingColumns=True)


# ---------------------------------------------------------------- releases


def release_id(corpus_version, index_version) -> Column:
    return F.concat_ws("_", release_slug(corpus_version), release_slug(index_version))


def begin_release(releases: DataFrame, release: DataFrame) -> DataFrame:
    """Add (corpus_version, index_version, collection_name ...) rows in state ``building``.

    A release with the same id is replaced.
    """
    new = release.withColumn("release_id", release_id("corpus_version", "index_version")).withColumn("status", F.lit("building"))
    kept = releases.join(F.broadcast(new.select("release_id")), "release_id", "left_anti")
    return kept.unionByName(new, allowMissingColumns=True)


def finish_release(releases: DataFrame, target: str, row_count: int | None = None, embedding_size: int | None = None, error: str | None = None) -> DataFrame:
    """``building`` becomes ``staging``, or ``failed`` when an error is given."""
    hit = F.col("release_id") == target
    out = releases.withColumn("status", F.when(hit, F.lit("failed" if error else "staging")).otherwise(F.col("status")))
    for name, value in (("row_count", row_count), ("embedding_size", embedding_size), ("error", error)):
        if value is not None or (name == "error" and error is None):
            out = out.withColumn(name, F.when(hit, F.lit(value).cast(out.schema[name].dataType)).otherwise(F.col(name)))
    return out


def activate_release(releases: DataFrame, target: str) -> DataFrame:
    """A staging (or active) release becomes active, the previously active one archived."""
    hit = F.col("release_id") == target
    allowed = releases.agg(F.coalesce(F.bool_or(hit & F.col("status").isin("staging", "active")), F.lit(False)).alias("ok")).select("ok").scalar()
    moved = F.when(hit, F.lit("active")).when(F.col("status") == "active", F.lit("archived")).otherwise(F.col("status"))
    return releases.withColumn("status", F.when(allowed, moved).otherwise(F.col("status")))


def archive_release(releases: DataFrame, target: str) -> DataFrame:
    """Archive a release unless it is the active one."""
    hit = (F.col("release_id") == target) & (F.col("status") != "active")
    return releases.withColumn("status", F.when(hit, F.lit("archived")).otherwise(F.col("status")))


def active_rows(index: DataFrame, releases: DataFrame) -> DataFrame:
    """Index rows of the active release; the semi join prunes release partitions."""
    return index.join(F.broadcast(releases.filter("status = 'active'").select("release_id")), "release_id", "left_semi")
