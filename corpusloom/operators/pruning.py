"""Exact top k over blocks of rows, reading only blocks whose bound can reach the k-th score.

The best-bounded blocks of each query are scored first.  Their k-th score is a floor: blocks whose
bound is below it cannot hold a row of the result and are never read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.operators.ranking import SCORE_DIGITS, topk
from corpusloom.session import materialized

SEEDS = 1
#: Rounded scores and sums in another order may differ from the bound by this much.
SLACK = 10.0**-SCORE_DIGITS

Evaluate = Callable[[DataFrame], DataFrame]
Cut = Callable[[DataFrame], DataFrame]


def _steps(bounds: DataFrame, evaluate: Evaluate, k: int, seeds: int, cut: Cut | None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(scored seed rows, seed pairs, other pairs that must be read)."""
    bounds = materialized(bounds)
    some = topk(bounds, seeds, score="bound", tie="block").select("query_id", "block")
    first = materialized(cut(evaluate(some)) if cut else topk(evaluate(some), k).drop("rank"))
    floor = first.groupBy("query_id").agg(F.min("score").alias("_floor"), F.count("*").alias("_n")).filter(F.col("_n") >= k)
    # a query with fewer than k rows so far has no floor
    other = bounds.join(some, ["query_id", "block"], "left_anti").join(floor, "query_id", "left")
    reach = F.col("_floor").isNull() | (F.col("bound") >= F.col("_floor") - F.lit(SLACK) * (1 + F.abs("_floor")))
    return first, some, other.filter(reach).select("query_id", "block")


def pruned_rows(bounds: DataFrame, evaluate: Evaluate, k: int, seeds: int = SEEDS, cut: Cut | None = None) -> DataFrame:
    """Rows among which the k best of each query are.

    ``bounds`` has (query_id, block, bound); ``evaluate`` turns (query_id, block) pairs into
    (query_id, child_id, score ...) of the best rows in them.  ``cut`` keeps what can still matter of
    the first rows and must leave at least k (distinct groups) per query where there are as many.
    """
    first, _, rest = _steps(bounds, evaluate, k, seeds, cut)
    return first.unionByName(evaluate(rest))


def pruned_share(bounds: DataFrame, evaluate: Evaluate, k: int, seeds: int = SEEDS, cut: Cut | None = None) -> DataFrame:
    """One row: (query, block) pairs in all, and how many of them are read."""
    _, some, rest = _steps(bounds, evaluate, k, seeds, cut)
    read = some.unionByName(rest).agg(F.count("*").alias("pairs_read"))
    return bounds.agg(F.count("*").alias("pairs")).join(read)
