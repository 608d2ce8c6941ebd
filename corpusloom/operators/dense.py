"""Exact nearest vectors for batches of queries.

A query batch within the checked bound is broadcast and scored block by block where
the index rows are; a larger one is cut into blocks that meet index blocks through a
shuffle on the block pair, so no task ever holds more than two blocks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.values import bind
from corpusloom.operators.blocks import RunningTop, best_groups, best_rows, matrix_of
from corpusloom.operators.ranking import SCORE_DIGITS, topk

MAX_BROADCAST_VALUES = 2_000_000  # 16 MB of float64: every task sends k rows of each query on
BLOCK_ROWS = 4096
INDEX_BLOCK_ROWS = 65_536  # index rows that meet a block of queries in one task, at most
SCORE_CELLS = 4_000_000  # cells of one score block
TILE = 2048  # rows and queries of one matrix product
MAX_SINGLE = 1e15  # larger numbers are multiplied in double precision
TINY = 1e-30  # more than what single precision loses of the smallest numbers
METRICS = ("l2", "cosine", "dot")


def norm(vector) -> Column:
    return F.sqrt(F.aggregate(vector, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))


def dot(a, b) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a, b) -> Column:
    """Cosine similarity; 0 for missing, empty, zero or unequal-length vectors."""
    scale = norm(a) * norm(b)
    usable = (F.size(a) > 0) & (F.size(a) == F.size(b)) & (scale > 0)
    return F.coalesce(F.when(usable, dot(a, b) / scale), F.lit(0.0))


def unit_vector(vector) -> Column:
    """Vector of length one, NULL when empty or zero."""
    return bind(norm(vector), lambda n: F.when((F.size(vector) > 0) & (n > 0), F.transform(vector, lambda x: x.cast("double") / n)))


def _scores(index: np.ndarray, queries: np.ndarray, metric: str) -> np.ndarray:
    product = index @ queries.T
    if metric == "dot":
        return product
    if metric == "l2":
        distance = (index**2).sum(1)[:, None] + (queries**2).sum(1)[None, :] - 2 * product
        return 1.0 / (1.0 + np.maximum(distance, 0.0))
    scale = np.linalg.norm(index, axis=1)[:, None] * np.linalg.norm(queries, axis=1)[None, :]
    return np.divide(product, scale, out=np.zeros_like(product), where=scale > 0)


def permitted(corpora: pa.Array | None, allowed: list | None) -> np.ndarray | None:
    """(row, query) filter matrix: a row passes if one of its corpora is in the query's list.

    A NULL list allows every row; rows hold one corpus or a list of them.
    """
    parts = _rights(corpora, allowed)
    return None if parts is None else parts[0] @ parts[1].T > 0


def _rights(corpora: pa.Array | None, allowed: list | None) -> tuple[np.ndarray, np.ndarray] | None:
    """(row, name) and (query, name) matrices: a row may be seen by a query with which it shares a name.

    One name more stands for queries that may see every row.
    """
    if corpora is None or allowed is None or all(a is None for a in allowed):
        return None
    rows = len(corpora)
    if pa.types.is_list(corpora.type):
        owner = np.repeat(np.arange(rows), np.asarray(pc.fill_null(pc.list_value_length(corpora), 0)))
        flat = corpora.flatten()
    else:
        owner, flat = np.arange(rows), corpora
    names = pc.unique(flat)
    position = {n: i for i, n in enumerate(names.to_pylist())}
    holds = np.zeros((rows, len(names) + 1))
    holds[owner, np.asarray(pc.index_in(flat, value_set=names), dtype=np.int64)] = 1
    holds[:, -1] = 1
    wanted = np.zeros((len(allowed), len(names) + 1))
    for q, some in enumerate(allowed):
        wanted[q, [-1] if some is None else [position[c] for c in some if c in position and c is not None]] = 1
    return holds, wanted


def _pair_scores(index: np.ndarray, queries: np.ndarray, metric: str) -> np.ndarray:
    """Score of each index row with the query at its place."""
    product = np.einsum("ij,ij->i", index, queries)
    if metric == "dot":
        return product
    a, b = np.einsum("ij,ij->i", index, index), np.einsum("ij,ij->i", queries, queries)
    if metric == "l2":
        return 1.0 / (1.0 + np.maximum(a + b - 2 * product, 0.0))
    scale = np.sqrt(a) * np.sqrt(b)
    return np.divide(product, scale, out=np.zeros_like(product), where=scale > 0)


def _keyed(index: np.ndarray, queries: np.ndarray, metric: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Vectors whose product orders as the scores do (minus the squared distance for l2), and what
    rounding may change of a query's products.

    The products only tell which cells to score, so they are in single precision where the numbers allow it.
    """
    a, b = np.linalg.norm(index, axis=1, keepdims=True), np.linalg.norm(queries, axis=1, keepdims=True)
    if metric == "cosine":
        index, queries = (np.divide(v, n, out=np.zeros_like(v), where=n > 0) for v, n in ((index, a), (queries, b)))
        a, b = np.minimum(a, 1), np.minimum(b, 1)
    elif metric == "l2":
        index, queries = np.hstack([index, a**2, np.ones_like(a)]), np.hstack([2 * queries, -np.ones_like(b), -(b**2)])
    slack = (a.max() + b[:, 0]) ** 2
    if max(np.abs(index).max(), np.abs(queries).max()) < MAX_SINGLE:
        return index.astype(np.float32), queries.astype(np.float32), (index.shape[1] + 8) * 2.0**-23 * slack + TINY
    return index, queries, 1e-12 * slack


def _limits(scores: np.ndarray, slack: np.ndarray, metric: str) -> np.ndarray:
    """The product below which a row's rounded score is lower than ``scores``."""
    least = scores - 1.5 * 10.0**-SCORE_DIGITS
    if metric == "l2":
        least = np.where(least > 0, 1.0 - 1.0 / np.where(least > 0, least, 1.0), -np.inf)
    return least - slack


def _tiled_top(index: np.ndarray, queries: np.ndarray, metric: str, k: int, rights: tuple | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, query, score) of the k best rows of each query; rows must be in id order.

    Rows and queries meet in tiles.  What a query has found so far is a floor, and only the cells above it
    are scored and sorted, so almost all cells cost their product and one comparison.
    """
    a, b, slack = _keyed(index, queries, metric)
    lowest = np.finfo(a.dtype).min
    found = []
    for q0 in range(0, len(queries), TILE):
        some, near = b[q0 : q0 + TILE], slack[q0 : q0 + TILE]
        floor = np.full(len(some), -np.inf)
        query, row, score = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
        for r0 in range(0, len(index), TILE):
            keys = some @ a[r0 : r0 + TILE].T
            width = keys.shape[1]
            least = floor.copy()
            open_ = np.flatnonzero(np.isneginf(floor))
            if len(open_):
                part = keys[open_]
                if rights is not None:
                    part[rights[1][q0 + open_] @ rights[0][r0 : r0 + TILE].T <= 0] = -np.inf
                    keys[open_] = part
                if width > k:
                    kth = np.partition(part, width - k, axis=1)[:, width - k]
                    reached = 1.0 / (1.0 + np.maximum(-kth, 0.0)) if metric == "l2" else kth
                    least[open_] = _limits(reached, 2 * near[open_], metric)
            least = np.nextafter(np.clip(least, lowest, None).astype(keys.dtype), lowest)
            q, r = np.divmod(np.flatnonzero(keys >= least[:, None]), width)
            r += r0
            if rights is not None:
                seen = np.einsum("ij,ij->i", rights[0][r], rights[1][q0 + q]) > 0
                q, r = q[seen], r[seen]
            if not len(q):
                continue
            query, row = np.concatenate([query, q]), np.concatenate([row, r])
            score = np.concatenate([score, _pair_scores(index[r], queries[q0 + q], metric)])
            ranked = np.round(score, SCORE_DIGITS)
            order = np.lexsort((row, -ranked, query))
            place = np.arange(len(order)) - np.searchsorted(query[order], np.arange(len(some)))[query[order]]
            order, place = order[place < k], place[place < k]
            query, row, score, ranked = query[order], row[order], score[order], ranked[order]
            full = place == k - 1
            floor[query[full]] = _limits(ranked[full], near[query[full]], metric)
        found.append((row, query + q0, score))
    return tuple(np.concatenate(c) for c in zip(*found))


def _column(batch, name: str) -> pa.Array | None:
    if name not in batch.schema.names:
        return None
    c = batch.column(name)
    return c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c


def _block_top(index, queries: np.ndarray, allowed, metric: str, k: int, top: RunningTop) -> None:
    width = queries.shape[1]
    sized = pc.equal(pc.list_value_length(_column(index, "embedding")), width)
    index = index.filter(pc.fill_null(sized, False))
    if index.num_rows == 0:
        return
    grouped = "group_id" in index.schema.names
    keys = [("group_id", "ascending"), ("child_id", "ascending")] if grouped else [("child_id", "ascending")]
    index = index.take(pc.sort_indices(index, sort_keys=keys))
    if not grouped:
        vectors = matrix_of(_column(index, "embedding"), width)
        if np.isfinite(vectors).all() and np.isfinite(queries).all():
            row, query, score = _tiled_top(vectors, queries, metric, k, _rights(_column(index, "corpus_id"), allowed))
            top.add(_column(index, "child_id").take(pa.array(row)), query, score)
            return
    step = max(64, SCORE_CELLS // max(len(queries), 1))
    for start in range(0, index.num_rows, step):
        part = index.slice(start, step)
        scores = _scores(matrix_of(_column(part, "embedding"), width), queries, metric)
        present = permitted(_column(part, "corpus_id"), allowed)
        if grouped:
            codes = np.asarray(_column(part, "group_id").dictionary_encode().indices)
            first = np.flatnonzero(np.append(True, codes[1:] != codes[:-1]))
            row, query = best_groups(scores, present, k, first)
            top.add(_column(part, "child_id").take(pa.array(row)), query, scores[row, query], _column(part, "group_id").take(pa.array(row)))
        else:
            row, query = best_rows(scores, present, k)
            top.add(_column(part, "child_id").take(pa.array(row)), query, scores[row, query])


def _result(top: RunningTop, query_ids: pa.Array, schema: pa.Schema) -> pa.RecordBatch | None:
    if top.ids is None or not len(top.ids):
        return None
    columns = [query_ids.take(pa.array(top.query)), top.ids, pa.array(np.round(top.score, SCORE_DIGITS))]
    if top.groups is not None:
        columns.insert(2, top.groups)
    return pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, schema)], schema=schema)


def _arrow_type(name: str) -> pa.DataType:
    return {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string(), "double": pa.float64()}[name]


def _schema(ddl: str) -> pa.Schema:
    return pa.schema([(name, _arrow_type(kind)) for name, kind in (part.split() for part in ddl.split(", "))])


def _partial_topk(index: DataFrame, queries: DataFrame, k: int, metric: str, max_values: int, block_rows: int) -> DataFrame:
    """Top rows per task; the caller makes the final cut."""
    if metric not in METRICS:
        raise ValueError(f"metric must be one of {METRICS}")
    keep = [c for c in ("child_id", "group_id", "embedding", "corpus_id") if c in index.columns]
    wanted = [c for c in ("query_id", "embedding", "corpus_ids") if c in queries.columns]
    types = dict(index.dtypes)
    ddl = f"query_id {dict(queries.dtypes)['query_id']}, child_id {types['child_id']}"
    ddl += f", group_id {types['group_id']}" if "group_id" in keep else ""
    ddl += ", score double"
    names = F.coalesce(F.sum(F.size("corpus_ids")), F.lit(0)) if "corpus_ids" in queries.columns else F.lit(0)
    size = queries.agg(F.count("*").alias("n"), (F.coalesce(F.sum(F.size("embedding")), F.lit(0)) + names).alias("values")).first()
    if not size["n"]:
        return index.sparkSession.createDataFrame([], ddl)
    if size["values"] <= max_values:
        return _broadcast_topk(index.select(*keep), queries.select(*wanted), k, metric, ddl)
    return _blocked_topk(index.select(*keep), queries.select(*wanted), k, metric, size["n"], ddl, block_rows)


def vector_topk(
    index: DataFrame, queries: DataFrame, k: int, metric: str = "l2", max_values: int = MAX_BROADCAST_VALUES, block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """(query_id, child_id, score, rank): k best index rows of each query vector.

    ``index`` has (child_id, embedding[, corpus_id]), ``queries`` has (query_id,
    embedding[, corpus_ids]).  ``l2`` scores are ``1 / (1 + squared distance)``.
    A query meets the index rows of its own vector length.  Runs one small job to learn
    the batch size.
    """
    return topk(_partial_topk(index.drop("group_id"), queries, k, metric, max_values, block_rows), k)


def vector_topk_groups(
    index: DataFrame, queries: DataFrame, k: int, metric: str = "cosine", max_values: int = MAX_BROADCAST_VALUES, block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """(query_id, group_id, child_id, score, rank): the k best groups of each query by their best row.

    ``index`` has (child_id, group_id, embedding[, corpus_id]).  Each task reduces its
    rows to groups first, so a group of any size costs one row per query and task.
    """
    partial = _partial_topk(index, queries, k, metric, max_values, block_rows)
    best = topk(partial, 1, ["query_id", "group_id"], "score", "child_id").drop("rank")
    return topk(best, k, "query_id", "score", "group_id")


def _by_width(batch: pa.Table) -> list[tuple[pa.Array, np.ndarray, list | None]]:
    """(ids, vectors, permitted corpora) of the queries of each vector length."""
    lengths = pc.list_value_length(_column(batch, "embedding"))
    out = []
    for width in sorted(w for w in pc.unique(lengths).to_pylist() if w):
        part = batch.filter(pc.fill_null(pc.equal(lengths, width), False))
        allowed = part.column("corpus_ids").to_pylist() if "corpus_ids" in part.schema.names else None
        out.append((_column(part, "query_id"), matrix_of(_column(part, "embedding"), width), allowed))
    return out


def _broadcast_topk(index: DataFrame, queries: DataFrame, k: int, metric: str, ddl: str) -> DataFrame:
    # bounded by the check in _partial_topk
    parts = _by_width(queries.toArrow())
    schema = _schema(ddl)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tops = [RunningTop(len(ids), k) for ids, _, _ in parts]
        for rows in batches:
            for top, (_, vectors, allowed) in zip(tops, parts):
                _block_top(rows, vectors, allowed, metric, k, top)
        for top, (ids, _, _) in zip(tops, parts):
            out = _result(top, ids, schema)
            if out is not None:
                yield out

    return index.mapInArrow(score, ddl)


def _blocked_topk(index: DataFrame, queries: DataFrame, k: int, metric: str, n_queries: int, ddl: str, block_rows: int) -> DataFrame:
    # long index blocks: a query sends k rows on per block, and is copied once per block
    long = INDEX_BLOCK_ROWS if block_rows == BLOCK_ROWS else block_rows
    n_index = max(1, index.count())
    i_blocks = math.ceil(n_index / long)
    # query blocks of at most `long` / 4 rows, and enough of them to spread the pairs over the tasks
    spread = math.ceil(4 * index.sparkSession.sparkContext.defaultParallelism / i_blocks)
    q_blocks = min(math.ceil(n_queries / min(block_rows, TILE)), max(math.ceil(4 * n_queries / long), spread))
    schema = _schema(ddl)

    def grid(n: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    left = index.withColumn("_i", F.pmod(F.xxhash64("child_id"), F.lit(i_blocks)).cast("int")).withColumn("_j", grid(q_blocks))
    # columns of its own: with queries from the table of the index, both sides would share theirs
    right = queries.select(*[F.col(c).alias(f"_{c}") for c in queries.columns])
    right = right.withColumn("_qj", F.pmod(F.xxhash64("_query_id"), F.lit(q_blocks)).cast("int")).withColumn("_qi", grid(i_blocks))
    names = queries.columns

    def score(a: pa.Table, b: pa.Table) -> pa.Table:
        if a.num_rows == 0 or b.num_rows == 0:
            return schema.empty_table()
        found, rows = [], a.combine_chunks()
        b = b.select([f"_{c}" for c in names]).rename_columns(names)
        for ids, vectors, allowed in _by_width(b):
            top = RunningTop(len(ids), k)
            _block_top(rows, vectors, allowed, metric, k, top)
            found.append(_result(top, ids, schema))
        return pa.Table.from_batches([f for f in found if f is not None], schema=schema)

    return left.groupBy("_i", "_j").cogroup(right.groupBy("_qi", "_qj")).applyInArrow(score, ddl)


def alias_index(aliases: DataFrame) -> DataFrame:
    """Usable alias vectors, scaled to length one.

    Empty and zero vectors are dropped; the first usable row by alias id sets the
    dimension and rows of another size are dropped.
    """
    usable = aliases.withColumn("embedding", unit_vector("embedding")).filter(F.col("embedding").isNotNull())
    width = usable.agg(F.min_by(F.size("embedding"), "alias_id").alias("w")).select("w").scalar()
    return usable.filter(F.size("embedding") == width)


def alias_index_stats(aliases: DataFrame) -> DataFrame:
    """One row: loaded, invalid and wrong-size counts and the dimension."""
    sized = aliases.withColumn("_size", F.when(norm("embedding") > 0, F.size("embedding")))
    width = sized.filter("_size is not null").agg(F.min_by("_size", "alias_id").alias("w")).select("w").scalar()
    return sized.agg(
        F.count_if(F.col("_size") == width).alias("loaded_count"),
        F.count_if(F.col("_size").isNull()).alias("invalid_embedding_count"),
        F.count_if(F.col("_size") != width).alias("dimension_mismatch_count"),
        F.max(width).alias("embedding_dimension"),
    )


def index_stats(index: DataFrame) -> DataFrame:
    """Rows and embedding sizes per release and corpus."""
    return index.groupBy("release_id", "corpus_id").agg(
        F.count("*").alias("row_count"), F.min(F.size("embedding")).alias("min_size"), F.max(F.size("embedding")).alias("max_size")
    )
