"""Hard negatives by the threshold algorithm over sorted per-dimension lists.

Components become floor(256 * x).  A row's score for an anchor is their integer inner product; higher
scores come first, ties go to the smaller vec_id.  An anchor's positives are its best rows of the same
label.  Each of them opens a window of scores, ``low`` to ``high`` per cent of its own score, from which
the best rows of other labels are its hard negatives.

Rows are dealt by hash into blocks of bounded size, anchors likewise, and each block of rows meets each
block of anchors in one task.  There the rows are sorted by every dimension.  An anchor reads the lists in
step, each from the end at which its own component gives the largest products, and scores what turns up
by random access.  No row that was not met can score more than the threshold, the sum of the products at
the current depth.  The first pass (rows of the anchor's label) ends when the threshold is strictly below
the k-th score.  The second pass (rows of other labels) ends when it is strictly below the k-th score of
each window; a window that holds fewer rows needs it below the window's lower end.  Strictly, because a
tie could still go to a smaller vec_id.

Rows without vec_id or label take no part, nor do those whose vector is null or holds null or non-finite
components.  Zero and empty vectors do (their scores are 0).  Vectors of different widths never meet.
Repeated rows are candidates each, but one anchor; rows that share the anchor's vec_id are never its
positives or negatives; rows of one vec_id with different content are anchors each.  An empty table gives
no rows.  Other columns are not read.  Scores must fit a long; larger ones are an error.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.llm.common import batch_of, written

BLOCK_ROWS = 4096
ANCHOR_ROWS = 16384
FIRST_DEPTH = 16

_KEYS = ["width", "ib", "ab"]


def mine(
    vectors: DataFrame,
    every: int = 50,
    positives: int = 5,
    negatives: int = 3,
    low: int = 50,
    high: int = 95,
    block_rows: int = BLOCK_ROWS,
    anchor_rows: int = ANCHOR_ROWS,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    ``vectors`` has vec_id, embedding and label.  Anchors are rows whose vec_id is divisible by ``every``.
    """
    rows = usable(vectors)
    anchors = rows.where(F.col("vec_id") % every == 0).dropDuplicates(["vec_id", "label", "v"])
    renamed = {"vec_id": "anchor_id", "label": "wanted", "v": "q", "width": "width"}
    anchors = anchors.select(*(F.col(a).alias(b) for a, b in renamed.items()), F.xxhash64("label", "v").alias("name"))
    sizes = rows.agg(F.count("*"), F.count_if(F.col("vec_id") % every == 0)).first()
    index_blocks = max(1, -(-sizes[0] // block_rows))
    anchor_blocks = max(1, -(-sizes[1] // anchor_rows))
    index = rows.withColumn("ib", F.pmod(F.xxhash64("vec_id"), F.lit(index_blocks))).withColumn("ab", _numbers(anchor_blocks))

    def dealt(some: DataFrame) -> DataFrame:
        return some.withColumn("ib", _numbers(index_blocks)).withColumn("ab", F.pmod(F.xxhash64("anchor_id", "name"), F.lit(anchor_blocks)))

    near = _meet(index, dealt(anchors), "anchor_id long, name long, positive_id long, positive_score long", _positives(positives))
    best = Window.partitionBy("anchor_id", "name").orderBy(F.desc("positive_score"), "positive_id")
    pairs = near.withColumn("place", F.row_number().over(best)).where(F.col("place") <= positives)
    pairs = written(pairs, "positives")
    # a score of 50 to 95 per cent of a negative one does not exist: those positives have no window
    windows = pairs.where(F.col("positive_score") >= 0).groupBy("anchor_id", "name").agg(
        F.sort_array(F.collect_list(F.struct("place", "positive_id", "positive_score"))).alias("windows")
    )
    found = _meet(
        index,
        dealt(anchors.join(windows, ["anchor_id", "name"])),
        "anchor_id long, name long, place int, positive_id long, positive_score long, negative_id long, negative_score long",
        _negatives(negatives, low, high),
    )
    best = Window.partitionBy("anchor_id", "name", "place").orderBy(F.desc("negative_score"), "negative_id")
    ranked = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= negatives)
    return ranked.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, label, v (array of double) and width of the rows that take part."""
    v = F.col("embedding").cast("array<double>")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    kept = vectors.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & v.isNotNull() & ~bad)
    return kept.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), v.alias("v"), F.size("embedding").alias("width"))


class Lists:
    """Rows of one block, sorted by each dimension."""

    def __init__(self, rows: np.ndarray):
        self.rows = rows
        self.order = np.argsort(rows, axis=0, kind="stable").T
        self.values = np.take_along_axis(rows.T, self.order, axis=1)

    def search(self, q: np.ndarray, kept: np.ndarray, done: Callable[[np.ndarray, int], bool], first_depth: int = FIRST_DEPTH):
        """Places and scores of the rows among ``kept`` that were met, and the number of rows met.

        The lists are read in step, twice as deep each time, until ``done(scores, threshold)`` or no row is left.
        """
        n = len(self.rows)
        used = np.flatnonzero(q)
        down, up = used[q[used] > 0], used[q[used] < 0]
        met = np.zeros(n, bool)
        places, scores = [], []
        read, depth = 0, min(first_depth, n)
        while n:
            fresh = np.zeros(n, bool)
            fresh[self.order[down, n - depth : n - read]] = True
            fresh[self.order[up, read:depth]] = True
            if not len(used):
                fresh[:] = True  # all scores are 0: no list tells rows apart
            fresh &= ~met
            met |= fresh
            more = np.flatnonzero(fresh & kept)
            places.append(more)
            scores.append((self.rows[more] @ q).astype(np.int64))
            if depth == n or met.all():
                break
            threshold = (self.values[down, n - depth] * q[down]).sum() + (self.values[up, depth - 1] * q[up]).sum()
            scores = [np.concatenate(scores)]
            if done(scores[0], threshold):
                break
            read, depth = depth, min(2 * depth, n)
        if not places:
            return np.array([], np.int64), np.array([], np.int64), 0
        return np.concatenate(places), np.concatenate(scores), int(met.sum())


def kth(scores: np.ndarray, k: int):
    """The k-th largest score, None if there are fewer."""
    return np.partition(scores, len(scores) - k)[len(scores) - k] if len(scores) >= k else None


def windows_done(scores: np.ndarray, threshold, windows: list[tuple[int, int]], k: int) -> bool:
    """Whether rows below ``threshold`` can add nothing to any window (least and largest score)."""
    if threshold >= min(high for _, high in windows):
        return False
    for low, high in windows:
        level = kth(scores[(scores >= low) & (scores <= high)], k)
        if threshold >= (low if level is None else level):
            return False
    return True


def _best(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k largest scores, ties to smaller ids."""
    level = kth(scores, k)
    some = np.arange(len(scores)) if level is None else np.flatnonzero(scores >= level)
    return some[np.lexsort((ids[some], -scores[some]))[:k]]


def _positives(k: int):
    def search(ids, labels, rows, asked: pa.Table, anchors: np.ndarray):
        own, names = asked.column("anchor_id").to_numpy(), asked.column("name").to_numpy()
        wanted = asked.column("wanted").to_numpy()
        for label in np.unique(wanted):
            here = np.flatnonzero(labels == label)
            lists = Lists(rows[here])
            for a in np.flatnonzero(wanted == label):
                done = lambda scores, bound: len(scores) >= k and kth(scores, k) > bound
                places, scores, _ = lists.search(anchors[a], ids[here] != own[a], done)
                found = ids[here][places]
                for i in _best(found, scores, k):
                    yield own[a], names[a], found[i], int(scores[i])

    return search


def _negatives(k: int, low: int, high: int):
    def search(ids, labels, rows, asked: pa.Table, anchors: np.ndarray):
        own, names = asked.column("anchor_id").to_numpy(), asked.column("name").to_numpy()
        lists = Lists(rows)
        for a, (label, positives) in enumerate(zip(asked.column("wanted").to_pylist(), asked.column("windows").to_pylist())):
            # whole scores s with low * p <= 100 * s <= high * p
            windows = [(-(-low * p["positive_score"] // 100), high * p["positive_score"] // 100) for p in positives]
            ranges = [w for w in windows if w[0] <= w[1]]
            if not ranges:
                continue
            kept = (labels != label) & (ids != own[a])
            places, scores, _ = lists.search(anchors[a], kept, lambda scores, bound: windows_done(scores, bound, ranges, k))
            found = ids[places]
            for p, (least, most) in zip(positives, windows):
                inside = np.flatnonzero((scores >= least) & (scores <= most))
                for i in inside[_best(found[inside], scores[inside], k)]:
                    yield own[a], names[a], p["place"], p["positive_id"], p["positive_score"], found[i], int(scores[i])

    return search


def _meet(index: DataFrame, anchors: DataFrame, ddl: str, search) -> DataFrame:
    schema = index.sparkSession.createDataFrame([], ddl).schema

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        found = []
        if left.num_rows and right.num_rows:
            rows, asked = whole_numbers(_matrix(left, "v"), _matrix(right, "q"))
            found = list(search(left.column("vec_id").to_numpy(), left.column("label").to_numpy(), rows, right, asked))
        columns = dict(zip(schema.names, zip(*found))) if found else {n: [] for n in schema.names}
        return pa.Table.from_batches([batch_of(schema, columns)])

    return index.groupBy(*_KEYS).cogroup(anchors.groupBy(*_KEYS)).applyInArrow(meet, schema)


def whole_numbers(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """floor(256 * x) of both, in the cheapest type in which all inner products are exact."""
    a, b = np.floor(256 * a), np.floor(256 * b)
    if a.size and b.size and np.abs(a).max() * np.abs(b).max() * a.shape[1] >= 2**53:
        to_int = np.frompyfunc(int, 1, 1)
        return to_int(a), to_int(b)
    return a, b


def _matrix(table: pa.Table, name: str) -> np.ndarray:
    column = table.column(name).combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(table.num_rows, table.column("width")[0].as_py())


def _numbers(n: int) -> Column:
    return F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
