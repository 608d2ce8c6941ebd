"""Top-k, diversification, budgets and numbering.

``row_number() <= k`` filters are planned with a per-task group limit before the
shuffle, so a query that owns a third of all rows still sends k rows per task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions.text import col
from corpusloom.functions.values import positive
from corpusloom.session import cut_lineage

CUT_MARK = "\n...[省略]"
SCORE_DIGITS = 9


def _order(score: str, tie: str) -> list[Column]:
    # rounding makes equal scores equal whatever order they were summed in
    return [F.round(F.col(score), SCORE_DIGITS).desc(), F.col(tie).asc()]


def topk(rows: DataFrame, k: int, query: str = "query_id", score: str = "score", tie: str = "child_id", rank: str = "rank") -> DataFrame:
    """The k best rows of each query, numbered from 1."""
    w = Window.partitionBy(query).orderBy(*_order(score, tie))
    return rows.withColumn(rank, F.row_number().over(w)).filter(F.col(rank) <= k)


def diversify(ranked: DataFrame, k: int, query: str = "query_id", parent: str = "parent_id", rank: str = "rank") -> DataFrame:
    """Drop repeats of a parent once ``max(3, k // 2)`` rows are out, then keep k.

    A row survives if it is among the first ``max(3, k//2)`` or is the first of its
    parent; with those rows removed, the first k by rank are exactly what a
    row-by-row walk keeps.
    """
    free = max(3, k // 2)
    first = F.row_number().over(Window.partitionBy(query, parent).orderBy(rank))
    kept = ranked.withColumn("_first", first).filter((F.col(rank) <= free) | (F.col("_first") == 1)).drop("_first")
    renumbered = kept.withColumn("_r", F.row_number().over(Window.partitionBy(query).orderBy(rank))).filter(F.col("_r") <= k)
    return renumbered.drop(rank).withColumnRenamed("_r", rank)


def parent_dedupe(ranked: DataFrame, query: str = "query_id", parent: str = "parent_id", rank: str = "rank") -> DataFrame:
    """First row of each parent per query; rows without a parent all stay."""
    named = ranked.filter(F.coalesce(F.col(parent), F.lit("")) != "")
    other = ranked.filter(F.coalesce(F.col(parent), F.lit("")) == "")
    w = Window.partitionBy(query, parent).orderBy(rank)
    return named.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n").unionByName(other)


def rerank_filter(
    ranked: DataFrame, top_k: int, min_score: float = 0.0, min_keep: int = 1, max_keep: int = 8, dedupe_parent: bool = False,
    query: str = "query_id", parent: str = "parent_id", tie: str = "child_id", score: str = "rerank_score",
) -> DataFrame:
    """Score threshold with a guaranteed minimum, optional parent de-duplication and cap.

    Rows fall into three classes: chosen candidates, other rows that bring a new
    parent, the rest.  The classes are filled in order up to the query's limit.
    Queries without any reranked row are diversified instead.
    """
    target = max(1, min(top_k, max_keep) if max_keep > 0 else top_k)
    floor = min(max(1, min_keep), target)
    per_query = Window.partitionBy(query)
    # the final cut keeps at most `target` rows; candidates beyond the reranked head never enter
    scored = ranked.filter(F.col(score).isNotNull())
    order = [F.col(score).desc(), F.col("rank").asc(), F.col(tie).asc()]
    s = scored.withColumn("_passed", F.col(score) >= min_score).withColumn("_n_passed", F.count_if("_passed").over(per_query))
    s = s.withColumn("_cand", F.col("_passed") | (F.col("_n_passed") < floor))
    if dedupe_parent:
        own = F.when(F.coalesce(F.col(parent), F.lit("")) == "", F.concat(F.lit("\x00"), F.col(tie))).otherwise(F.col(parent))
        s = s.withColumn("_own", own)
        # candidates come first inside a parent, so a parent's first row is a candidate whenever it has one
        s = s.withColumn("_nth", F.row_number().over(Window.partitionBy(query, "_own").orderBy((~F.col("_cand")).cast("int"), *order)))
        s = s.withColumn("_class", F.when(F.col("_cand") & (F.col("_nth") == 1), 1).when(F.col("_nth") == 1, 2).otherwise(3))
    else:
        s = s.withColumn("_class", F.when(F.col("_cand"), 1).otherwise(3))
    s = s.withColumn("_n1", F.count_if(F.col("_class") == 1).over(per_query))
    limit = F.when(F.col("_n1") >= target, F.lit(target)).otherwise(F.greatest(F.col("_n1"), F.lit(floor)))
    s = s.withColumn("_pos", F.row_number().over(Window.partitionBy(query).orderBy("_class", *order))).filter(F.col("_pos") <= limit)
    chosen = s.drop("rank", "_passed", "_n_passed", "_cand", "_class", "_n1", "_own", "_nth").withColumnRenamed("_pos", "rank")
    unscored = ranked.join(scored.select(query).distinct(), query, "left_anti")
    return chosen.unionByName(diversify(unscored, top_k, query, parent), allowMissingColumns=True)


def context_budget(ranked: DataFrame, budget: int, text: str = "parent_text", query: str = "query_id", rank: str = "rank") -> DataFrame:
    """Fill a per-query character budget in rank order; the overflowing text is cut and marked."""
    if budget <= 0:
        return ranked
    w = Window.partitionBy(query).orderBy(rank).rowsBetween(Window.unboundedPreceding, -1)
    t = F.coalesce(F.col(text), F.lit(""))
    prior = F.coalesce(F.sum(F.length(t)).over(w), F.lit(0))
    staged = ranked.withColumn("_prior", prior)
    left = F.lit(budget) - F.col("_prior")
    cut = (
        F.when(left <= 0, F.lit(""))
        .when(F.length(t) <= left, t)
        .otherwise(F.concat(F.substr(t, F.lit(1), left.cast("int")), F.lit(CUT_MARK)))
    )
    return staged.withColumn(text, cut).drop("_prior")


def match_margin(ranked: DataFrame, query: str = "query_id", score: str = "similarity", tie: str = "qa_id") -> DataFrame:
    """Best row of each query and its lead over the second (1.0 when alone)."""
    two = topk(ranked, 2, query, score, tie, "_r")
    after = F.lead(score).over(Window.partitionBy(query).orderBy("_r"))
    return two.withColumn("margin", F.coalesce(F.col(score) - after, F.lit(1.0))).filter("_r = 1").drop("_r")


def dedupe_first(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """First row of each non-empty key in ``order``."""
    kept = rows.filter(F.coalesce(F.col(key).cast("string"), F.lit("")) != "")
    return kept.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(*order))).filter("_n = 1").drop("_n")


def latest(rows: DataFrame, keys: list[str], version: list[Column]) -> DataFrame:
    """Last written row of each key (keyed replace)."""
    w = Window.partitionBy(*keys).orderBy(*version)
    return rows.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def recent(rows: DataFrame, order: str = "id", limit: int = 50) -> DataFrame:
    """Newest rows first."""
    return rows.orderBy(F.col(order).desc()).limit(positive(limit))


def ordinal(rows: DataFrame, keys: list[str], order: list[str], name: str) -> DataFrame:
    """1-based position of each row inside its key group (or overall), safe for hot groups.

    Rows are range-partitioned on key and order, numbered inside each partition and
    shifted by the number of earlier rows of the same key.  The ranged rows are
    checkpointed so that both uses see the same partition borders.
    """
    ranged = cut_lineage(rows.repartitionByRange(*keys, *order).withColumn("_part", F.spark_partition_id()))
    sizes = ranged.groupBy(*keys, "_part").agg(F.count("*").alias("_size"))
    # at most one row per key and partition
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    shifts = sizes.withColumn("_shift", F.coalesce(F.sum("_size").over(before), F.lit(0))).drop("_size")
    local = F.row_number().over(Window.partitionBy(*keys, "_part").orderBy(*order))
    numbered = ranged.withColumn("_local", local)
    on = [numbered["_part"] == shifts["_part"]] + [numbered[k].eqNullSafe(shifts[k]) for k in keys]
    return numbered.join(shifts, on).select(*[numbered[c] for c in rows.columns], (F.col("_local") + F.col("_shift")).alias(name))


def batches(rows: DataFrame, size: int, order: str) -> DataFrame:
    """Add ``batch_no`` (1-based) and ``batch_pos`` for fixed-size batches in ``order``."""
    numbered = ordinal(rows, [], [order], "_n")
    return (
        numbered.withColumn("batch_no", (F.floor((F.col("_n") - 1) / size) + 1).cast("long"))
        .withColumn("batch_pos", ((F.col("_n") - 1) % size + 1).cast("long"))
        .drop("_n")
    )


def batch_manifest(batched: DataFrame) -> DataFrame:
    return batched.groupBy("batch_no").agg(F.count("*").alias("rows"))


def priority_order(rows: DataFrame, limit: int, priority: str = "priority", count: str = "count", seen: str = "last_seen_at") -> DataFrame:
    """High before medium before low, larger counts first, then oldest; cut to ``limit``."""
    rank = F.when(col(priority) == "high", 0).when(col(priority) == "medium", 1).when(col(priority) == "low", 2).otherwise(3)
    order = [rank, F.col(count).desc(), F.coalesce(F.col(seen).cast("string"), F.lit(""))]
    rest = [F.col(c) for c in ("task_type", "question") if c in rows.columns]
    return rows.orderBy(*order, *rest).limit(positive(limit))
