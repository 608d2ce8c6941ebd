"""Arrow helpers for exact scoring of row blocks against a query batch.

Scores of a block are one matrix product; only the best k rows per query leave a
task.  Ties are decided by row id, so copies of one text cannot inflate a block's
output and every partitioning gives the same answer.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

DIGITS = 9


def best_rows(scores: np.ndarray, present: np.ndarray | None, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, query) positions of the k best rows of each column; rows must be in id order."""
    ranked = -np.round(scores, DIGITS)
    if present is not None:
        ranked = np.where(present, ranked, np.inf)
    if len(ranked) > 4 * k:
        # narrow to values that can still be in the top k before the stable sort
        limit = np.partition(ranked, k - 1, axis=0)[k - 1]
        few = (ranked <= limit).any(axis=1)
        keep = np.flatnonzero(few)
        ranked = ranked[keep]
    else:
        keep = np.arange(len(ranked))
    order = np.argsort(ranked, axis=0, kind="stable")[:k]
    finite = np.isfinite(np.take_along_axis(ranked, order, axis=0))
    place, query = np.nonzero(finite)
    return keep[order[place, query]], query


def best_groups(scores: np.ndarray, present: np.ndarray | None, k: int, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Like :func:`best_rows` for the best row of each group; ``starts`` are the first rows of
    the groups, rows are in (group, id) order."""
    ranked = np.round(scores, DIGITS)
    if present is not None:
        ranked = np.where(present, ranked, -np.inf)
    peaks = np.maximum.reduceat(ranked, starts, axis=0)
    group, query = best_rows(peaks, np.isfinite(peaks), k)
    ends = np.append(starts[1:], len(scores))
    rows = [starts[g] + int(np.argmax(ranked[starts[g] : ends[g], q])) for g, q in zip(group, query)]
    return np.array(rows, dtype=np.int64), query


class RunningTop:
    """Best k (id, score) pairs per query over the blocks of one task.

    With groups, k counts distinct groups and each keeps its best row.
    """

    def __init__(self, queries: int, k: int):
        self.queries, self.k = queries, k
        self.ids: pa.Array | None = None
        self.groups: pa.Array | None = None
        self.query = np.empty(0, np.int64)
        self.score = np.empty(0)

    def add(self, ids: pa.Array, query: np.ndarray, score: np.ndarray, groups: pa.Array | None = None) -> None:
        if self.ids is not None:
            ids = pa.concat_arrays([self.ids, ids.cast(self.ids.type)])
            query, score = np.concatenate([self.query, query]), np.concatenate([self.score, score])
            if groups is not None:
                groups = pa.concat_arrays([self.groups, groups.cast(self.groups.type)])
        table = pa.table({"q": query, "s": -np.round(score, DIGITS), "g": ids if groups is None else groups, "i": ids})
        order = np.asarray(pc.sort_indices(table, sort_keys=[(c, "ascending") for c in ("q", "s", "g", "i")]))
        if groups is not None:
            codes = np.asarray(groups.dictionary_encode().indices)
            _, first = np.unique(np.stack([query[order], codes[order]]), axis=1, return_index=True)
            order = order[np.sort(first)]
        sorted_q = query[order]
        starts = np.searchsorted(sorted_q, np.arange(self.queries))
        keep = order[np.arange(len(order)) - starts[sorted_q] < self.k]
        self.ids, self.query, self.score = ids.take(pa.array(keep)), query[keep], score[keep]
        self.groups = None if groups is None else groups.take(pa.array(keep))


def matrix_of(column: pa.Array, width: int) -> np.ndarray:
    """Fixed-width list column as a float64 matrix."""
    flat = column.flatten() if not isinstance(column, pa.FixedSizeListArray) else column.values
    return np.asarray(flat.cast(pa.float64())).reshape(-1, width)

