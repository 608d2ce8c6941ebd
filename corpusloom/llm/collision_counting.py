"""Approximate nearest neighbours by collision-counting hashing.

Every block of the index holds, for each of ``projections`` random directions, its vectors sorted by
their projection.  A query's window around its own projection widens from radius to radius (virtual
rehashing: the arrays stay, only the window grows).  A vector that lies in the windows of ``threshold``
of the directions is verified with its exact cosine.  The search of a block ends when the k-th verified
vector is nearer than the radius, or when the windows hold everything: no number of candidates is capped.

Vectors are compared on the unit sphere.  Rows whose vector is null, zero, empty or holds null or
non-finite components take no part, nor do rows without an id.  A row with the query's own vec_id is
taken for the query itself.  Equal scores go to the smaller vec_id.
"""

from __future__ import annotations

from functools import partial

import numpy as np
from pyspark.sql import DataFrame

from corpusloom.llm.vectors import block_search, top, usable

PROJECTIONS = 64
#: Window width at radius 1; a vector at that distance falls into a window with probability 0.71.
WIDTH = 2.1
#: Share of the projections in which a vector must collide.
THRESHOLD = 0.6
FIRST_RADIUS = 0.25
GROWTH = 1.25


def search(vectors: DataFrame, every: int = 50, k: int = 5, projections: int = PROJECTIONS, threshold: float = THRESHOLD, seed: int = 7) -> DataFrame:
    """query_id, rank, vec_id, score (cosine) of the k nearest rows found for each query row."""
    rows = usable(vectors, nonzero=True)
    found = partial(search_block, projections=projections, threshold=threshold, seed=seed)
    return block_search(rows, every, k, "double", found)


def cosines(v: np.ndarray, norms: np.ndarray, q: np.ndarray, q_norm: float) -> np.ndarray:
    """Row by row, so that equal vectors have equal scores wherever they stand."""
    return (v * q).sum(axis=1) / (norms * q_norm)


def lengths(v: np.ndarray) -> np.ndarray:
    """Euclidean lengths that neither overflow nor vanish."""
    largest = np.abs(v).max(axis=1, keepdims=True)
    scaled = v / largest
    return np.sqrt((scaled * scaled).sum(axis=1)) * largest[:, 0]


def search_block(ids, index, asked, queries, k, projections, threshold, seed):
    n, width = index.shape
    # components near the ends of the range of doubles are brought to size; cosines do not change
    index = _sized(index)
    queries = _sized(queries)
    norms, q_norms = lengths(index), lengths(queries)
    directions = np.random.default_rng(seed).standard_normal((width, projections))
    projected = (index / norms[:, None]) @ directions
    order = np.ascontiguousarray(np.argsort(projected, axis=0, kind="stable").T).astype(np.int32)
    line = np.take_along_axis(projected.T, order, axis=1)
    centres = (queries / q_norms[:, None]) @ directions
    need = int(np.ceil(threshold * projections))

    count = len(asked)
    low = np.empty((projections, count), np.int64)
    for j in range(projections):
        low[j] = np.searchsorted(line[j], centres[:, j])
    high = low.copy()
    hits = [np.zeros(n, np.int32) for _ in range(count)]
    seen = [np.zeros(n, bool) for _ in range(count)]
    scores: list = [np.array([])] * count
    places: list = [np.array([], np.int64)] * count
    open_ = list(range(count))
    radius = FIRST_RADIUS
    while open_:
        half = WIDTH * radius / 2
        left, right = low.copy(), high.copy()
        for j in range(projections):
            left[j, open_] = np.searchsorted(line[j], centres[open_, j] - half, side="left")
            right[j, open_] = np.searchsorted(line[j], centres[open_, j] + half, side="right")
        still = []
        for q in open_:
            new = [order[j, left[j, q] : low[j, q]] for j in range(projections)]
            new += [order[j, high[j, q] : right[j, q]] for j in range(projections)]
            hits[q] += np.bincount(np.concatenate(new), minlength=n).astype(np.int32)
            more = np.flatnonzero((hits[q] >= need) & ~seen[q])
            if len(more):
                seen[q][more] = True
                more = more[ids[more] != asked[q]]
                places[q] = np.concatenate([places[q], more])
                scores[q] = np.concatenate([scores[q], cosines(index[more], norms[more], queries[q], q_norms[q])])
            whole = bool((left[:, q] == 0).all() and (right[:, q] == n).all())
            if not whole:
                done = len(scores[q]) >= k and 2 - 2 * np.partition(scores[q], -k)[-k] <= radius * radius
                if not done:
                    still.append(q)
        low, high, open_ = left, right, still
        radius *= GROWTH
    out = []
    for q in range(count):
        best = top(ids[places[q]], scores[q], k)
        out.append((ids[places[q][best]], scores[q][best]))
    return out


def _sized(v: np.ndarray) -> np.ndarray:
    largest = np.abs(v).max(axis=1, keepdims=True)
    odd = (largest > 1e100) | (largest < 1e-100)
    return np.where(odd, v / largest, v) if odd.any() else v
