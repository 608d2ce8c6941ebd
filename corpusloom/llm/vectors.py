"""Queries against index rows in blocks, for the two vector searches."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BLOCK_ROWS = 8192
QUERY_ROWS = 4096


def usable(vectors: DataFrame, nonzero: bool) -> DataFrame:
    """vec_id, v (array of double), width: rows with an id and a vector without null or non-finite components.

    ``nonzero`` also leaves out empty vectors and those of zeros only.
    """
    v = F.col("embedding").cast("array<double>")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    out = vectors.where(F.col("vec_id").isNotNull() & v.isNotNull() & ~bad)
    if nonzero:
        out = out.where(F.exists(v, lambda x: x != 0))
    return out.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v"), F.size("embedding").alias("width"))


def block_search(
    rows: DataFrame,
    every: int,
    k: int,
    score: str,
    search: Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray, int], list[tuple[np.ndarray, np.ndarray]]],
    block_rows: int = BLOCK_ROWS,
    query_rows: int = QUERY_ROWS,
) -> DataFrame:
    """The k best rows for each row whose vec_id is divisible by ``every``.

    Index rows and queries are dealt by hash of their ids into blocks of bounded size; each query block
    meets each index block in one task, which returns k rows per query: (ids, scores) per query from
    ``search(index_ids, index, query_ids, queries, k)``.  Vectors of another width never meet.
    """
    sizes = rows.agg(F.count("*"), F.count_if(F.col("vec_id") % every == 0)).first()
    index_blocks = max(1, -(-sizes[0] // block_rows))
    query_blocks = max(1, -(-sizes[1] // query_rows))
    index = rows.select(
        "width", F.pmod(F.xxhash64("vec_id"), F.lit(index_blocks)).alias("ib"), _numbers(query_blocks).alias("qb"), "vec_id", "v"
    )
    # equal rows are one query
    asked = rows.where(F.col("vec_id") % every == 0).dropDuplicates(["vec_id", "v"])
    queries = asked.select(
        "width", _numbers(index_blocks).alias("ib"), F.pmod(F.xxhash64("vec_id", "v"), F.lit(query_blocks)).alias("qb"), "vec_id", "v", F.xxhash64("v").alias("name")
    )
    schema = rows.sparkSession.createDataFrame([], f"query_id long, name long, vec_id long, score {score}").schema

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        from corpusloom.llm.common import batch_of

        if not left.num_rows or not right.num_rows:
            return pa.Table.from_batches([batch_of(schema, {n: [] for n in schema.names})])
        ids, vs = left.column("vec_id").to_numpy(), _matrix(left)
        asked, qs, names = right.column("vec_id").to_numpy(), _matrix(right), right.column("name").to_numpy()
        found = search(ids, vs, asked, qs, k)
        counts = [len(a) for a, _ in found]
        columns = {"query_id": np.repeat(asked, counts), "name": np.repeat(names, counts), "vec_id": np.concatenate([a for a, _ in found]), "score": np.concatenate([b for _, b in found])}
        return pa.Table.from_batches([batch_of(schema, columns)])

    keys = ["width", "ib", "qb"]
    near = index.groupBy(*keys).cogroup(queries.groupBy(*keys)).applyInArrow(meet, schema)
    best = Window.partitionBy("query_id", "name").orderBy(F.desc("score"), "vec_id")
    ranked = near.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def _matrix(table: pa.Table) -> np.ndarray:
    column = table.column("v").combine_chunks()
    width = len(column[0].as_py()) if len(column) else 0
    return column.flatten().to_numpy(zero_copy_only=False).reshape(table.num_rows, width)


def top(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k largest scores, ties to smaller ids."""
    if len(ids) > 4 * k:
        kth = np.partition(scores, len(scores) - k)[len(scores) - k]
        some = np.flatnonzero(scores >= kth)
        return some[np.lexsort((ids[some], -scores[some]))[:k]]
    return np.lexsort((ids, -scores))[:k]


def _numbers(n: int):
    return F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
