"""A stored vector index for exact search that reads only blocks which can matter.

Centres are drawn from a bounded sample.  Every vector goes to its nearest centre; the vectors of a cell
are sorted by their distance to the centre and cut into blocks, so a block is a ring around its centre.
The triangle inequality bounds how near a query can be to any vector of a ring.  Blocks that cannot reach
the query's k-th score are not read.  Centres only order the rows: any choice of them gives the exact
result.  Vectors of a width that the sample lacks get the origin as their only centre.

A batch first meets one ring per query, whose k-th score is the query's floor.  Then sets of queries meet
shards of neighbouring rings: a query goes to the shards of which a ring reaches its floor, and a set of
queries of neighbouring cells and a shard are one group, so a vector is copied once per set or shard.

Layout below ``folder/release_id=...``: ``vectors`` (bucket=...), ``rings``, ``centres``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.operators.blocks import RunningTop, matrix_of
from corpusloom.operators.dense import METRICS, _block_top, _by_width, _column, _result, _schema
from corpusloom.operators.pruning import SLACK
from corpusloom.operators.ranking import topk
from corpusloom.session import materialized

#: Vectors of which the centres are made; also bounds what reaches the driver.
SAMPLE = 20_000
#: Cells per width; they travel with the tasks.
CENTRES = 256
ROUNDS = 5
BLOCK_ROWS = 1024
BUCKETS = 64
#: Index rows and queries that meet in one group of the search, at most (a ring and equal query cells are not cut).
SHARD_ROWS = 65_536
QUERY_ROWS = 16_384
#: Where more of a group's pairs of query and ring must be read, all of them are, in one product.
DENSE = 0.5


@dataclass(frozen=True)
class VectorIndex:
    vectors: DataFrame
    rings: DataFrame
    centres: DataFrame


def _home(folder: str, release: str) -> str:
    return f"{folder.rstrip('/')}/release_id={release}"


def _unit(v: np.ndarray) -> np.ndarray:
    size = np.linalg.norm(v, axis=1, keepdims=True)
    return np.divide(v, size, out=np.zeros_like(v), where=size > 0)


def centres_of(sample: np.ndarray, k: int, rounds: int = ROUNDS) -> np.ndarray:
    """k means of the sample, started from evenly spaced rows."""
    centres = np.unique(sample, axis=0)
    centres = centres[np.linspace(0, len(centres) - 1, min(k, len(centres))).astype(int)]
    for _ in range(rounds):
        cell = _nearest(sample, centres)[0]
        sums = np.zeros_like(centres)
        np.add.at(sums, cell, sample)
        count = np.bincount(cell, minlength=len(centres))
        centres = np.where(count[:, None] > 0, sums / np.maximum(count, 1)[:, None], centres)
    return centres


def _distances(v: np.ndarray, centres: np.ndarray) -> np.ndarray:
    squares = (v**2).sum(1)[:, None] + (centres**2).sum(1)[None, :] - 2 * v @ centres.T
    return np.sqrt(np.maximum(squares, 0.0))


def _nearest(v: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    distances = _distances(v, centres)
    cell = distances.argmin(axis=1)
    return cell, distances[np.arange(len(v)), cell]


def write_vector_index(
    index: DataFrame, folder: str, release: str, metric: str = "cosine", centres: int = CENTRES, sample: int = SAMPLE, block_rows: int = BLOCK_ROWS, buckets: int = BUCKETS
) -> VectorIndex:
    """Store ``index`` (child_id, embedding[, group_id][, corpus_id]) for one metric; replaces that release only.

    Rows without a vector are not stored.
    """
    if metric not in METRICS:
        raise ValueError(f"metric must be one of {METRICS}")
    spark, home = index.sparkSession, _home(folder, release)
    rows = index.filter(F.size("embedding") > 0)
    # a bounded sample, the same for the same rows
    drawn = rows.select("embedding", F.xxhash64("child_id").alias("_h")).orderBy("_h").limit(sample).select("embedding").toArrow()
    known: dict[int, np.ndarray] = {}
    for width in pc.unique(pc.list_value_length(drawn.column("embedding"))).to_pylist():
        part = drawn.filter(pc.equal(pc.list_value_length(drawn.column("embedding")), width))
        vectors = matrix_of(part.column("embedding").combine_chunks(), width)
        known[width] = centres_of(_unit(vectors) if metric == "cosine" else vectors, centres)
    saved = [(w, i, [float(x) for x in c], metric) for w, cs in known.items() for i, c in enumerate(cs)]
    spark.createDataFrame(saved, "width int, cell int, centre array<double>, metric string").coalesce(1).write.mode("overwrite").parquet(f"{home}/centres")

    columns = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields]
    placed = rows.mapInArrow(_place(known, metric), ", ".join([*columns, "width int", "cell int", "distance double"]))
    # rings: neighbours by distance stand together; a cell of any size is spread by range
    tie = F.col("child_id")
    ranged = materialized(placed).repartitionByRange("width", "cell", "distance", tie).sortWithinPartitions("width", "cell", "distance", tie)
    cut = ranged.mapInArrow(_rings(block_rows), ", ".join([*columns, "width int", "cell int", "distance double", "block long"]))
    stored = materialized(cut).withColumn("bucket", F.pmod(F.xxhash64("block"), F.lit(buckets)).cast("int"))
    stored.repartition(buckets, "bucket").sortWithinPartitions("bucket", "block").write.mode("overwrite").partitionBy("bucket").parquet(f"{home}/vectors")
    rings = stored.groupBy("width", "cell", "block", "bucket").agg(F.min("distance").alias("near"), F.max("distance").alias("far"), F.count("*").alias("n"))
    rings.write.mode("overwrite").parquet(f"{home}/rings")
    return _read(spark, home, stored.schema)


def _read(spark: SparkSession, home: str, schema=None) -> VectorIndex:
    vectors = spark.read.schema(schema).parquet(f"{home}/vectors") if schema else spark.read.parquet(f"{home}/vectors")
    return VectorIndex(vectors, spark.read.parquet(f"{home}/rings"), spark.read.parquet(f"{home}/centres"))


def read_vector_index(spark: SparkSession, folder: str, release: str) -> VectorIndex:
    return _read(spark, _home(folder, release))


def indexed_vectors(index: VectorIndex, queries: DataFrame, k: int) -> DataFrame:
    """(query_id, child_id, score, rank): as ``vector_topk``, from the stored index and in its metric."""
    return topk(_found(index, queries, k, False), k)


def indexed_groups(index: VectorIndex, queries: DataFrame, k: int) -> DataFrame:
    """(query_id, group_id, child_id, score, rank): as ``vector_topk_groups``."""
    rows = _found(index, queries, k, True)
    return topk(topk(rows, 1, ["query_id", "group_id"], "score", "child_id").drop("rank"), k, "query_id", "score", "group_id")


def read_share(index: VectorIndex, queries: DataFrame, k: int) -> DataFrame:
    """One row: (query, ring) pairs in all, and how many of them are read after the queries' first rings."""
    spark = queries.sparkSession
    lengths = queries.filter(F.size("embedding") > 0).groupBy(F.size("embedding").alias("width")).agg(F.count("*").alias("q"))
    pairs = lengths.join(index.rings.groupBy("width").agg(F.count("*").alias("r")), "width").agg(F.coalesce(F.sum(F.col("q") * F.col("r")), F.lit(0)).alias("pairs"))
    met = _found(index, queries, k, False, counted=True)
    read = spark.createDataFrame([(0,)], "pairs_read long") if met is None else met.agg(F.coalesce(F.sum("pairs_read"), F.lit(0)).alias("pairs_read"))
    return pairs.crossJoin(read)


@dataclass(frozen=True)
class _Rings:
    """The rings of one width in their stored order: one entry per ``block_rows`` vectors or cell."""

    block: np.ndarray
    cell: np.ndarray
    near: np.ndarray
    far: np.ndarray
    shard: np.ndarray


def _map_of(index: VectorIndex) -> tuple[str, dict[int, np.ndarray], dict[int, _Rings], list[tuple[int, int, int]]]:
    """Metric, centres and rings by width, and (block, bucket, shard) of every ring."""
    saved = index.centres.toArrow()  # at most CENTRES per width of the sample
    metric = saved.column("metric")[0].as_py() if saved.num_rows else "cosine"
    known = {}
    for width in pc.unique(saved.column("width")).to_pylist():
        part = saved.filter(pc.equal(saved.column("width"), width)).sort_by("cell")
        known[width] = matrix_of(part.column("centre").combine_chunks(), width)
    # a thousandth of the rows of the index, without vectors
    saved = index.rings.toArrow().sort_by([("width", "ascending"), ("cell", "ascending"), ("block", "ascending")])
    column = {n: saved.column(n).to_numpy() for n in saved.schema.names}
    shard = (np.cumsum(column["n"]) - column["n"]) // SHARD_ROWS
    rings = {}
    for width in np.unique(column["width"]).tolist():
        at = column["width"] == width
        rings[width] = _Rings(*[column[n][at] for n in ("block", "cell", "near", "far")], shard[at])
    return metric, known, rings, list(zip(column["block"].tolist(), column["bucket"].tolist(), shard.tolist()))


def _gap(to_centre: np.ndarray, near: np.ndarray, far: np.ndarray) -> np.ndarray:
    """The least distance of a query to the vectors of a ring; not a number where one of them is none."""
    # what is left of a rounding error in the distances
    return np.maximum(np.maximum(np.maximum(to_centre - far, near - to_centre), 0.0) - 1e-7 * (1 + to_centre), 0.0)


def _reach(vectors: np.ndarray, limit: np.ndarray, centres: np.ndarray, cell: np.ndarray, near: np.ndarray, far: np.ndarray, metric: str) -> np.ndarray:
    """(query, ring) pairs whose bound is not below the query's limit."""
    to_centre = _distances(_unit(vectors) if metric == "cosine" else vectors, centres)[:, cell]
    bound = _bound(metric, _gap(to_centre, near, far), to_centre, far, np.linalg.norm(vectors, axis=1)[:, None])
    return ~(bound < limit[:, None])


def _first_rings(known: dict, rings: dict[int, _Rings], metric: str):
    """Rows of queries with their cell and their best-bounded ring; of equal bounds the one with the nearest centre."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            widths, cells, first = np.zeros(batch.num_rows, np.int32), np.zeros(batch.num_rows, np.int32), np.full(batch.num_rows, -1)
            for at, width, vectors, centres in _cells(batch.column("embedding"), known, metric):
                widths[at], cells[at] = width, _nearest(vectors, centres)[0]
                if width not in rings:
                    continue
                r = rings[width]
                for start in range(0, len(at), 512):
                    part = vectors[start : start + 512]
                    to_centre = _distances(part, centres)[:, r.cell]
                    bound = _bound(metric, _gap(to_centre, r.near, r.far), to_centre, r.far, np.linalg.norm(part, axis=1)[:, None])
                    best = np.where(bound == bound.max(axis=1, keepdims=True), to_centre, np.inf).argmin(axis=1)
                    first[at[start : start + 512]] = r.block[best]
            yield pa.RecordBatch.from_pydict({**{n: batch.column(n) for n in batch.schema.names}, "width": pa.array(widths), "cell": pa.array(cells), "first": pa.array(first)})

    return run


def _shards_of(known: dict, rings: dict[int, _Rings], metric: str):
    """Rows of queries with the shards of which a ring reaches ``limit`` (null: all of its width)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            found = np.empty(batch.num_rows, object)
            limit = pc.fill_null(batch.column("limit"), -np.inf).to_numpy(zero_copy_only=False)
            lengths = np.asarray(pc.list_value_length(batch.column("embedding")))
            for width in np.unique(lengths).tolist():
                at, r = np.flatnonzero(lengths == width), rings[width]
                vectors = matrix_of(batch.column("embedding").take(pa.array(at)), width)
                shards, starts = np.unique(r.shard, return_index=True)
                for start in range(0, len(at), 512):
                    some = at[start : start + 512]
                    hit = _reach(vectors[start : start + 512], limit[some], known.get(width, np.zeros((1, width))), r.cell, r.near, r.far, metric)
                    for i, row in zip(some, np.logical_or.reduceat(hit, starts, axis=1)):
                        found[i] = shards[row].tolist()
            yield pa.RecordBatch.from_pydict({**{n: batch.column(n) for n in batch.schema.names}, "shards": pa.array(found.tolist(), pa.list_(pa.int64()))})

    return run


def _sets(cells: list[tuple[int, int, int]], rows: int) -> list[tuple[int, int, int, int]]:
    """(width, cell, first set, sets) for (width, cell, queries): neighbouring cells share a set of about ``rows`` queries, larger ones have several."""
    out, at, held = [], 0, 0
    for width, cell, n in sorted(cells):
        parts = -(-n // rows)
        if held and held + n > rows:
            at, held = at + 1, 0
        out.append((width, cell, at, parts))
        at, held = (at + parts, 0) if parts > 1 else (at, held + n)
    return out


def _found(index: VectorIndex, queries: DataFrame, k: int, grouped: bool, counted: bool = False) -> DataFrame | None:
    """Rows among which the k best (groups) of each query are; with ``counted``, pairs_read per group in their place.

    None instead of counts where no query meets anything.
    """
    spark = queries.sparkSession
    metric, known, rings, places = _map_of(index)
    kind, types = dict(queries.dtypes)["query_id"], dict(index.vectors.dtypes)
    ddl = f"query_id {kind}, child_id {types['child_id']}, " + (f"group_id {types['group_id']}, " if grouped else "") + "score double"
    schema = _schema(ddl)
    columns = [c for c in ("child_id", *(["group_id"] if grouped else []), "embedding", "corpus_id") if c in types]
    wanted = [c for c in ("query_id", "embedding", "corpus_ids") if c in queries.columns]
    carried = [f"`{f.name}` {f.dataType.simpleString()}" for f in queries.select(*wanted).schema.fields]

    asked = queries.filter(F.size("embedding") > 0).select(*wanted)
    asked = materialized(asked.mapInArrow(_first_rings(known, rings, metric), ", ".join([*carried, "width int", "cell int", "first long"]))).filter("first >= 0")
    cells = [tuple(r) for r in asked.groupBy("width", "cell").agg(F.count("*")).collect()]  # at most CENTRES per width of the sample
    if not cells:
        return None if counted else spark.createDataFrame([], ddl)
    mark = F.xxhash64("query_id")

    def top_of(rows: pa.Table, part: pa.Table) -> list[pa.RecordBatch]:
        found = []
        for ids, vectors, allowed in _by_width(part):
            top = RunningTop(len(ids), k)
            _block_top(rows, vectors, allowed, metric, k, top)
            found.append(_result(top, ids, schema))
        return [f for f in found if f is not None]

    # the first ring of each query; a ring that many queries ask for first is copied for parts of them
    def seed(a: pa.Table, b: pa.Table) -> pa.Table:
        found = top_of(a.combine_chunks(), b) if a.num_rows and b.num_rows else []
        return pa.Table.from_batches(found, schema=schema)

    parts = asked.groupBy("first").agg(F.ceil(F.count("*") / QUERY_ROWS).cast("int").alias("_parts"))
    buckets = spark.createDataFrame(places, "block long, bucket int, shard long")
    rows = index.vectors.select("bucket", "block", "cell", "distance", *columns)
    ahead = parts.join(buckets, F.col("first") == F.col("block")).select("block", "bucket", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)).alias("_part"))
    left = rows.join(F.broadcast(ahead), ["bucket", "block"]).select("block", "_part", *columns)
    right = asked.join(F.broadcast(parts), "first").select(F.col("first").alias("_block"), F.pmod(mark, F.col("_parts")).cast("int").alias("_own"), *[F.col(c).alias(f"_{c}") for c in wanted])

    def named(fn):
        names = [f"_{c}" for c in wanted]

        def run(a: pa.Table, b: pa.Table) -> pa.Table:
            rest = [n for n in b.schema.names if n not in names]
            return fn(a, b.select([*names, *rest]).rename_columns([*wanted, *rest]))

        return run

    first = left.groupBy("block", "_part").cogroup(right.groupBy("_block", "_own")).applyInArrow(named(seed), ddl)
    # a query with fewer than k rows so far has no floor
    least = F.min("score")
    floor = first.groupBy("query_id").agg(F.when((F.count("*") >= k) & ~F.isnan(least), least - F.lit(SLACK) * (1 + F.abs(least))).alias("limit"))
    limited = asked.join(floor.withColumnRenamed("query_id", "_id"), F.col("query_id") == F.col("_id"), "left").select(*asked.columns, "limit")
    routed = limited.mapInArrow(_shards_of(known, rings, metric), ", ".join([*carried, "width int", "cell int", "first long", "limit double", "shards array<long>"]))

    total = sum(n for _, _, n in cells)
    shards = len({shard for _, _, shard in places})
    # sets small enough to spread the pairs over the tasks
    spread = -(-4 * spark.sparkContext.defaultParallelism // shards)
    sets = spark.createDataFrame(_sets(cells, max(1, min(QUERY_ROWS, -(-total // spread)))), "width int, cell int, _start int, _sets int")
    routed = materialized(routed.join(F.broadcast(sets), ["width", "cell"]).withColumn("_set", F.col("_start") + F.pmod(mark, F.col("_sets")).cast("int")))
    right = routed.select(F.explode("shards").alias("_shard"), F.col("_set").alias("_own"), "limit", *[F.col(c).alias(f"_{c}") for c in wanted])
    met = routed.select(F.explode("shards").alias("shard"), "_set").distinct()
    left = rows.join(F.broadcast(buckets.join(met, "shard")), ["bucket", "block"]).select("shard", "_set", "block", "cell", "distance", *columns)

    def search(a: pa.Table, b: pa.Table) -> pa.Table:
        found, read = [], 0
        a = a.combine_chunks().sort_by("block") if a.num_rows and b.num_rows else a.slice(0, 0)
        widths, lengths = pc.list_value_length(_column(a, "embedding")), pc.list_value_length(_column(b, "embedding"))
        for width in pc.unique(lengths).to_pylist():
            some, part = a.filter(pc.equal(widths, width)).combine_chunks(), b.filter(pc.equal(lengths, width)).combine_chunks()
            if not some.num_rows:
                continue
            starts = np.unique(_column(some, "block").to_numpy(), return_index=True)[1]
            stops = np.append(starts[1:], some.num_rows)
            distance = _column(some, "distance").to_numpy()
            hull = np.minimum.reduceat(distance, starts), np.maximum.reduceat(distance, starts)
            limit = pc.fill_null(_column(part, "limit"), -np.inf).to_numpy(zero_copy_only=False)
            hit = _reach(matrix_of(_column(part, "embedding"), width), limit, known.get(width, np.zeros((1, width))), _column(some, "cell").to_numpy()[starts], *hull, metric)
            dense = hit.mean() > DENSE
            read += hit.size if dense else int(hit.sum())
            if counted:
                continue
            if dense:
                found += top_of(some, part)
                continue
            for start, stop, who in zip(starts, stops, hit.T):
                if who.any():
                    found += top_of(some.slice(start, stop - start), part.filter(pa.array(who)))
        if counted:
            return pa.table({"pairs_read": pa.array([read], pa.int64())})
        return pa.Table.from_batches(found, schema=schema)

    pairs = left.groupBy("shard", "_set").cogroup(right.groupBy("_shard", "_own"))
    return pairs.applyInArrow(named(search), "pairs_read long" if counted else ddl)


def _bound(metric: str, gap: np.ndarray, to_centre: np.ndarray, far: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The best score of a vector at least ``gap`` away from the query."""
    if metric == "l2":
        return 1.0 / (1.0 + gap * gap)
    if metric == "cosine":  # distances are between unit vectors
        return 1.0 - gap * gap / 2.0
    # |x| is at most the query's length plus its distance to x through the centre
    return size * (size + to_centre + far)


def _cells(column: pa.Array, known: dict[int, np.ndarray], metric: str):
    """(rows, vectors, centres) of each width."""
    lengths = pc.list_value_length(column)
    for width in pc.unique(lengths).to_pylist():
        at = np.flatnonzero(np.asarray(pc.equal(lengths, width)))
        vectors = matrix_of(column.take(pa.array(at)), width)
        yield at, width, _unit(vectors) if metric == "cosine" else vectors, known.get(width, np.zeros((1, width)))


def _place(known: dict[int, np.ndarray], metric: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            widths, cells, away = np.zeros(batch.num_rows, np.int32), np.zeros(batch.num_rows, np.int32), np.zeros(batch.num_rows)
            for at, width, vectors, centres in _cells(batch.column("embedding"), known, metric):
                widths[at] = width
                cells[at], away[at] = _nearest(vectors, centres)
            columns = {n: batch.column(n) for n in batch.schema.names}
            yield pa.RecordBatch.from_pydict({**columns, "width": pa.array(widths), "cell": pa.array(cells), "distance": pa.array(away)})

    return run


def _rings(block_rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number, held, last = TaskContext.get().partitionId() << 32, 0, None
        for batch in batches:
            if not batch.num_rows:
                continue
            blocks = np.zeros(batch.num_rows, np.int64)
            for i, cell in enumerate(zip(batch.column("width").to_pylist(), batch.column("cell").to_pylist())):
                if held == block_rows or (cell != last and held):
                    number, held = number + 1, 0
                blocks[i], held, last = number, held + 1, cell
            yield pa.RecordBatch.from_pydict({**{n: batch.column(n) for n in batch.schema.names}, "block": pa.array(blocks)})

    return run
