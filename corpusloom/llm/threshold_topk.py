"""Exact top-k inner products by the threshold algorithm over sorted per-dimension lists.

Components become floor(256 * x).  Every block of the index sorts its rows by each dimension.  A query
reads all lists in step, from the end at which its own component gives the largest products, and scores
each row that turns up by random access.  No row that was not met yet can score more than the sum of the
products at the current depth; the block is done when that bound is below the k-th score (a tie could
still go to a smaller id).  The depth doubles from step to step, so rows are scored in bulk.

Rows whose vector is null or holds null or non-finite components take no part, nor do rows without an
id; zero vectors do.  A row with the query's own vec_id is taken for the query itself.  Components must
stay below 2^27 in size after scaling, so that the products of any usual width fit a long; larger ones
are an error.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from corpusloom.llm.vectors import block_search, top, usable

FIRST_DEPTH = 16
LIMIT = 1 << 27


def search(vectors: DataFrame, every: int = 50, k: int = 5) -> DataFrame:
    """query_id, rank, vec_id, score (integer inner product) of the k best rows for each query row."""
    return block_search(usable(vectors, nonzero=False), every, k, "long", search_block)


def whole_numbers(v: np.ndarray) -> np.ndarray:
    scaled = np.floor(256 * v)
    if scaled.size and np.abs(scaled).max() >= LIMIT:
        raise ValueError(f"a vector component is {LIMIT // 256} or more in size")
    return scaled.astype(np.int64)


def search_block(ids, index, asked, queries, k):
    index, queries = whole_numbers(index), whole_numbers(queries)
    n, width = index.shape
    by_value = np.ascontiguousarray(np.argsort(index, axis=0, kind="stable").T).astype(np.int32)
    sorted_values = np.take_along_axis(index.T, by_value, axis=1)
    out = []
    for own, q in zip(asked, queries):
        # dimensions in which the query is 0 add nothing and need no list
        used = np.flatnonzero(q)
        up = used[q[used] < 0]
        down = used[q[used] > 0]
        met = np.zeros(n, bool)
        places, scores = np.array([], np.int64), np.array([], np.int64)
        depth, read = min(FIRST_DEPTH, n), 0
        while True:
            fresh = np.zeros(n, bool)
            fresh[by_value[up, read:depth].ravel()] = True
            fresh[by_value[down, n - depth : n - read].ravel()] = True
            if not len(used):
                fresh[:] = True
            more = np.flatnonzero(fresh & ~met)
            met[more] = True
            more = more[ids[more] != own]
            places = np.concatenate([places, more])
            scores = np.concatenate([scores, index[more] @ q])
            if depth == n or not len(used):
                break
            bound = int((sorted_values[up, depth - 1] * q[up]).sum() + (sorted_values[down, n - depth] * q[down]).sum())
            if len(scores) >= k and np.partition(scores, -k)[-k] > bound:
                break
            read, depth = depth, min(2 * depth, n)
        best = top(ids[places], scores, k)
        out.append((ids[places[best]], scores[best]))
    return out
