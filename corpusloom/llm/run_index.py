"""Exact substring dedup with run-length compressed Burrows-Wheeler indexes.

Every byte that a ``length``-byte string covers is removed if that string also starts in a document with a
smaller doc_id.  All windows of that length that may be equal share a key (see ``windows``), so that the
index is cut by keys: no index needs to know the whole corpus, and no match is lost.

1. Texts are put into blocks of a few megabytes, written once.
2. Every block sends its distinct keys, dealt by key; those that two blocks have come back to both.
3. A block brings the pieces (neighbouring windows of one key) with such keys, and those it has twice
   itself.  Copies within the block are settled there: only the earliest document of each string is sent.
4. Each group of keys builds an index of its distinct strings: the Burrows-Wheeler transform as runs,
   with the suffix samples at run ends, and the smallest document of each group of suffixes that agree
   on ``length`` bytes.  A string that alone has its key matches its own copies only and stays out.
   The strings are streamed through the index by backward steps; each window's interval tells how
   long it matches and which document has it first.  Long matches with an earlier one are marked.
5. Marks come back to the blocks, where bytes are removed and counted.

A key with more than ``hot`` pieces sends its windows singly, by the hash of the whole window, so that
no group of strings outgrows a task; equal windows then meet as equal strings.  What a block sends for a
string is one row whatever number of copies it has.

Null and empty texts have no bytes.  Rows with a null doc_id stay as they are.  Rows with equal doc_ids
never remove from each other; each gets its own result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import batch_of, documents, from_planes, groups, planes, text_bytes, written
from corpusloom.llm.shingles import mix
from corpusloom.llm.windows import _grams, pieces

LENGTH = 50
BLOCK_BYTES = 1 << 21
#: Text per group of keys.
GROUP_BYTES = 1 << 22
HOT = 20_000


# ------------------------------------------------------------------ the index


def _dense(values: np.ndarray) -> np.ndarray:
    """Places of the values among the distinct ones."""
    order = np.argsort(values)
    sorted_ = values[order]
    rank = np.empty(len(values), np.uint64)
    rank[order] = np.cumsum(np.concatenate([[0], sorted_[1:] != sorted_[:-1]]))
    return rank


class RunIndex:
    """Run-length compressed BWT of some strings, each ended by its own end mark."""

    def __init__(self, strings: list[bytes], documents: np.ndarray, length: int):
        sizes = np.array([len(s) + 1 for s in strings])
        text = np.frombuffer(b"\0".join(strings) + b"\0", np.uint8).astype(np.uint64) + np.uint64(1)
        self.ends = np.cumsum(sizes) - 1
        text[self.ends] = 0
        self.text, n = text, len(text)
        left = np.repeat(self.ends, sizes) - np.arange(n)
        rank, short = self._ranks(text, left, length, int(sizes.max()))
        order = np.argsort(rank, kind="stable")
        before = np.where(order > 0, text[order - 1], np.uint64(0))
        starts = np.flatnonzero(np.concatenate([[True], before[1:] != before[:-1]]))
        self.run_symbol, self.run_start = before[starts].astype(np.int64), starts
        self.run_end_samples = order[np.append(starts[1:], n) - 1]
        lengths = np.diff(np.append(starts, n))
        # runs by symbol: a rank query is one binary search
        by_symbol = np.lexsort((starts, self.run_symbol))
        self.keys = self.run_symbol[by_symbol] * (n + 1) + starts[by_symbol]
        self.symbols, self.firsts, self.lengths = self.run_symbol[by_symbol], starts[by_symbol], lengths[by_symbol]
        self.before = np.cumsum(self.lengths) - self.lengths
        self.total = np.concatenate([[0], np.cumsum(np.bincount(text.astype(np.int64), minlength=258))])
        self.n = n
        # groups of suffixes that agree on ``length`` bytes, and the smallest document of each
        heads = np.concatenate([[True], (short[order][1:] != short[order][:-1])])
        self.heads = np.flatnonzero(heads)
        owner = np.repeat(documents, sizes)
        self.least = np.minimum.reduceat(owner[order], self.heads)

    @staticmethod
    def _ranks(text, left, length, longest):
        """Ranks of all suffixes, and numbers that are equal for suffixes with equal first ``length`` symbols."""
        n, size = len(text), 7
        key = np.zeros(n, np.uint64)
        for k in range(size):
            part = np.zeros(n, np.uint64)
            part[: n - k] = text[k:]
            key = key << np.uint64(9) | np.where(left >= k, part, np.uint64(0))
        rank = _dense(key)
        # the first symbols stand in the high bits
        short = key >> np.uint64(9 * (size - length)) if length <= size else None

        def pair(rank, step):
            then = np.zeros(n, np.uint64)
            then[: n - step] = rank[step:] + np.uint64(1)
            return _dense(rank * np.uint64(n + 2) + np.where(left >= step, then, np.uint64(0)))

        while size < longest or short is None:
            if short is None and size < length <= 2 * size:
                short = pair(rank, length - size)
            rank, size = pair(rank, size), 2 * size
        return rank, short

    def occurrences(self, symbol: np.ndarray, row: np.ndarray) -> np.ndarray:
        """How often ``symbol`` stands in the transform before ``row``."""
        j = np.searchsorted(self.keys, symbol * (self.n + 1) + row, side="left") - 1
        j = np.maximum(j, 0)
        within = self.before[j] - self.total[symbol] + np.minimum(row - self.firsts[j], self.lengths[j])
        return np.where((self.symbols[j] == symbol) & (self.firsts[j] < row), within, 0)

    def stream(self, length: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(string, window start, first document) of every window, all strings in step from their ends."""
        starts = np.concatenate([[0], self.ends[:-1] + 1])
        size = self.ends - starts
        low, high = np.zeros(len(size), np.int64), np.full(len(size), self.n, np.int64)
        active = np.arange(len(size))
        for t in range(int(size.max())):
            active = active[size[active] > t]
            symbol = self.text[self.ends[active] - 1 - t].astype(np.int64)
            low[active] = self.total[symbol] + self.occurrences(symbol, low[active])
            high[active] = self.total[symbol] + self.occurrences(symbol, high[active])
            if t + 1 >= length:
                if (low[active] >= high[active]).any():
                    raise AssertionError("a string of the index does not match itself")
                group = np.searchsorted(self.heads, low[active], side="right") - 1
                yield active, size[active] - 1 - t, self.least[group]


# ------------------------------------------------------------------ blocks


_BLOCK = "block long, ids binary, sizes binary, text binary"


def blocks(docs: DataFrame, block_bytes: int) -> DataFrame:
    schema = docs.sparkSession.createDataFrame([], _BLOCK).schema

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        pack = zstandard.ZstdCompressor(level=3)
        for part in groups(batches, block_bytes):
            texts = part.column("text").cast(pa.binary()).to_pylist()
            ids = part.column("doc_id").to_numpy().astype(np.int64)
            sizes = np.array([len(t) for t in texts], np.int64)
            yield batch_of(schema, {"block": [number], "ids": [planes(ids)], "sizes": [planes(sizes)], "text": [pack.compress(b"".join(texts))]})
            number += 1

    return docs.mapInArrow(emit, schema)


def _opened(row: dict) -> tuple[np.ndarray, np.ndarray, bytes]:
    return from_planes(row["ids"], np.int64), np.cumsum(from_planes(row["sizes"], np.int64)), zstandard.decompress(row["text"])


def _deltas(sorted_keys: np.ndarray) -> bytes:
    return planes(np.diff(sorted_keys, prepend=np.uint64(0)))


def _from_deltas(data: bytes) -> np.ndarray:
    return np.cumsum(from_planes(data, np.uint64), dtype=np.uint64)


def _cut(keys: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Groups of sorted keys by their high bits: (group, first place) with a closing place."""
    group = (keys >> np.uint64(64 - bits)).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]])) if len(group) else np.zeros(0, np.int64)
    return group[first], np.append(first, len(keys))


def shared_keys(stored: DataFrame, length: int, bits: int, hot: int) -> DataFrame:
    """block, keys, hot: the keys of each block that another block has as well."""
    spark = stored.sparkSession
    sent = spark.createDataFrame([], "part long, block long, keys binary, counts binary").schema
    back = spark.createDataFrame([], "block long, keys binary, hot binary").schema

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                _, stops, text = _opened(row)
                key = pieces(np.frombuffer(text, np.uint8), stops, length)[0]
                key, count = np.unique(key, return_counts=True)
                part, at = _cut(key, bits)
                out = {"part": part, "block": [row["block"]] * len(part), "keys": [], "counts": []}
                for a, b in zip(at[:-1], at[1:]):
                    out["keys"].append(_deltas(key[a:b]))
                    out["counts"].append(planes(np.minimum(count[a:b], 65535).astype(np.uint16)))
                yield batch_of(sent, out)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _parts(batches):
            lists = [_from_deltas(r["keys"]) for r in rows]
            key = np.concatenate(lists)
            found, inverse, blocks_ = np.unique(key, return_inverse=True, return_counts=True)
            total = np.bincount(inverse, weights=np.concatenate([from_planes(r["counts"], np.uint16) for r in rows]))
            shared, many = (blocks_ > 1)[inverse], (total > hot)[inverse]
            at, out = 0, {n: [] for n in back.names}
            for row, keys in zip(rows, lists):
                some = shared[at : at + len(keys)] | many[at : at + len(keys)]
                if some.any():
                    out["block"].append(row["block"])
                    out["keys"].append(_deltas(keys[some]))
                    out["hot"].append(many[at : at + len(keys)][some].astype(np.uint8).tobytes())
                at += len(keys)
            yield batch_of(back, out)

    dealt = stored.mapInArrow(emit, sent).repartition("part").sortWithinPartitions("part")
    return dealt.mapInArrow(meet, back)


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[list[dict]]:
    """Rows that stand together and have one part."""
    held: list[dict] = []
    for batch in batches:
        for row in batch.to_pylist():
            if held and row["part"] != held[0]["part"]:
                yield held
                held = []
            held.append(row)
    if held:
        yield held


def _intervals(starts: np.ndarray, windows: np.ndarray, length: int) -> tuple[bytes, bytes]:
    return planes(starts.astype(np.int64)), planes((windows + length - 1).astype(np.int64))


_SENT = "part long, block long, places binary, documents binary, sizes binary, strings binary, keys binary"
_MARKS = "block long, starts binary, sizes binary"


def _candidates(row: dict, shared: list[dict], length: int, bits: int) -> Iterator[dict]:
    """What a block sends: settled marks (part -1), and the strings of each part."""
    ids, stops, text = _opened(row)
    key, doc, start, windows = pieces(np.frombuffer(text, np.uint8), stops, length)
    known = np.concatenate([_from_deltas(r["keys"]) for r in shared]) if shared else np.zeros(0, np.uint64)
    hot = np.concatenate([np.frombuffer(r["hot"], np.uint8) for r in shared]).astype(bool) if shared else np.zeros(0, bool)
    distinct, inverse, count = np.unique(key, return_inverse=True, return_counts=True)
    some = np.flatnonzero(np.isin(distinct, known)[inverse] | (count > 1)[inverse])
    single = some[np.isin(key[some], known[hot])]
    some = some[~np.isin(key[some], known[hot])]
    key, doc, start, windows = _singly(text, key, doc, start, windows, some, single, length)
    ids = ids[doc]
    # the earliest document of each string; its later copies in this block are settled
    first: dict[bytes, int] = {}
    strings = [text[s : s + n + length - 1] for s, n in zip(start.tolist(), windows.tolist())]
    for s, d in zip(strings, ids.tolist()):
        if first.get(s, d) >= d:
            first[s] = d
    earliest = np.array([first[s] for s in strings], np.int64)
    later = ids > earliest
    if later.any():
        starts, sizes = _intervals(start[later], windows[later], length)
        yield {"part": -1, "block": row["block"], "places": starts, "documents": b"", "sizes": sizes, "strings": b"", "keys": b""}
    send = np.flatnonzero(~later)
    send = send[np.argsort(key[send], kind="stable")]
    part, at = _cut(key[send], bits)
    pack = zstandard.ZstdCompressor(level=3)
    for p, a, b in zip(part.tolist(), at[:-1], at[1:]):
        here = send[a:b]
        yield {
            "part": p,
            "block": row["block"],
            "places": planes(start[here]),
            "documents": planes(ids[here]),
            "sizes": planes(windows[here].astype(np.uint16)),
            "strings": pack.compress(b"".join([strings[i] for i in here])),
            "keys": _deltas(key[here]),
        }


def _singly(text, key, doc, start, windows, some, single, length):
    """Pieces ``some`` as they are, and every window of the pieces ``single`` by its own hash."""
    if not len(single):
        return key[some], doc[some], start[some], windows[some]
    n = windows[single]
    at = np.repeat(start[single], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    own = np.frombuffer(b"".join([text[s : s + length] for s in at.tolist()]), np.uint8)
    hashes = mix(_grams(own, length)[::length] ^ np.uint64(0x5851F42D4C957F2D))
    return (
        np.concatenate([key[some], hashes]),
        np.concatenate([doc[some], np.repeat(doc[single], n)]),
        np.concatenate([start[some], at]),
        np.concatenate([windows[some], np.ones(len(at), np.int64)]),
    )


def _marked(rows: list[dict], length: int) -> Iterator[dict]:
    """Marks of one group of keys: through the index, or at once for copies of whole strings."""
    strings: list[bytes] = []
    for r in rows:
        data = zstandard.decompress(r["strings"])
        ends = np.cumsum(from_planes(r["sizes"], np.uint16).astype(np.int64) + length - 1).tolist()
        strings += [data[a:b] for a, b in zip([0, *ends[:-1]], ends)]
    key = np.concatenate([_from_deltas(r["keys"]) for r in rows])
    owner = np.concatenate([from_planes(r["documents"], np.int64) for r in rows])
    place = np.concatenate([from_planes(r["places"], np.int64) for r in rows])
    windows = np.array([len(s) - length + 1 for s in strings])
    block = np.repeat(np.arange(len(rows)), [len(r["sizes"]) // 2 for r in rows])
    number: dict[bytes, int] = {}
    which = np.array([number.setdefault(s, len(number)) for s in strings])
    least = np.full(len(number), np.iinfo(np.int64).max)
    np.minimum.at(least, which, owner)
    of_key = np.zeros(len(number), np.uint64)
    of_key[which] = key
    copied = owner > least[which]
    found = [(block[copied], place[copied], windows[copied])]
    # strings that share their key with others
    distinct, inverse, count = np.unique(of_key, return_inverse=True, return_counts=True)
    within = np.flatnonzero((count > 1)[inverse])
    if len(within):
        names = list(number)
        index = RunIndex([names[i] for i in within], least[within], length)
        string, at = [], []
        for s, start, document in index.stream(length):
            earlier = document < least[within[s]]
            string.append(within[s[earlier]])
            at.append(start[earlier])
        string, at = np.concatenate(string), np.concatenate(at)
        # every occurrence of these strings in their earliest document
        order = np.argsort(string, kind="stable")
        string, at = string[order], at[order]
        here = np.flatnonzero(~copied)
        low, high = np.searchsorted(string, which[here]), np.searchsorted(string, which[here], side="right")
        n = high - low
        hit = np.repeat(low, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        found.append((np.repeat(block[here], n), np.repeat(place[here], n) + at[hit], np.ones(len(hit), np.int64)))
    b, p, w = (np.concatenate(c) for c in zip(*found))
    order = np.argsort(b, kind="stable")
    b, p, w = b[order], p[order], w[order]
    for i, r in enumerate(rows):
        a, z = np.searchsorted(b, i), np.searchsorted(b, i, side="right")
        if z > a:
            starts, sizes = _joined(p[a:z], w[a:z], length)
            yield {"block": r["block"], "starts": starts, "sizes": sizes}


def _joined(place: np.ndarray, windows: np.ndarray, length: int) -> tuple[bytes, bytes]:
    """Windows that follow one another as one interval."""
    order = np.argsort(place, kind="stable")
    place, windows = place[order], windows[order]
    reach = np.maximum.accumulate(place + windows)
    new = np.concatenate([[True], place[1:] > reach[:-1]])
    first = np.flatnonzero(new)
    ends = reach[np.append(first[1:], len(place)) - 1]
    return _intervals(place[first], ends - place[first], length)


def _removed(row: dict, marks: list[dict]) -> Iterator[tuple[int, bytes, np.ndarray]]:
    """(doc_id, bytes, removed or not) of each document of a block."""
    ids, stops, text = _opened(row)
    change = np.zeros(len(text) + 1, np.int32)
    for m in marks:
        start, size = from_planes(m["starts"], np.int64), from_planes(m["sizes"], np.int64)
        np.add.at(change, start, 1)
        np.add.at(change, start + size, -1)
    gone = np.cumsum(change[:-1]) > 0
    for d, a, b in zip(ids.tolist(), [0, *stops[:-1].tolist()], stops.tolist()):
        yield d, text[a:b], gone[a:b]


# ------------------------------------------------------------------ the operator


def dedup(docs: DataFrame, length: int = LENGTH, hot: int = HOT, block_bytes: int = BLOCK_BYTES, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """doc_id, kept (binary: the remaining bytes), n_bytes, n_removed, n_spans of every row."""
    return _run(docs, length, hot, block_bytes, group_bytes, "doc_id long, kept binary, n_bytes long, n_removed long, n_spans long", bytes)


def digests(docs: DataFrame, length: int = LENGTH, hot: int = HOT, block_bytes: int = BLOCK_BYTES, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """doc_id, kept_sha256, n_bytes, n_removed, n_spans of every row."""
    return _run(docs, length, hot, block_bytes, group_bytes, "doc_id long, kept_sha256 string, n_bytes long, n_removed long, n_spans long", lambda b: hashlib.sha256(b).hexdigest())


def _run(docs, length, hot, block_bytes, group_bytes, ddl, shown) -> DataFrame:
    rows = documents(docs)
    spark = rows.sparkSession
    bits = max(3, int(np.ceil(np.log2(max(1, text_bytes(rows) / group_bytes)))))
    stored = written(blocks(rows.where("doc_id IS NOT NULL"), block_bytes), "blocks")
    shared = written(shared_keys(stored, length, bits, hot), "keys")
    result = spark.createDataFrame([], ddl).schema
    sent = spark.createDataFrame([], _SENT).schema
    marks = spark.createDataFrame([], _MARKS).schema

    def output(found: list[tuple]) -> dict:
        out: dict = {n: [] for n in result.names}
        for d, text, gone in found:
            spans = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum()) if len(gone) else 0
            kept = text if not spans else np.frombuffer(text, np.uint8)[~gone].tobytes()
            for n, v in zip(result.names, (d, shown(kept), len(text), int(gone.sum()), spans)):
                out[n].append(v)
        return out

    def gather(left: pa.Table, right: pa.Table) -> pa.Table:
        out = [batch_of(sent, {n: [r[n]] for n in sent.names}) for row in left.to_pylist() for r in _candidates(row, right.to_pylist(), length, bits)]
        return pa.Table.from_batches(out or [batch_of(sent, {n: [] for n in sent.names})])

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _parts(batches):
            if part[0]["part"] < 0:
                out = [{"block": r["block"], "starts": r["places"], "sizes": r["sizes"]} for r in part]
            else:
                out = list(_marked(part, length))
            if out:
                yield batch_of(marks, {n: [r[n] for r in out] for n in marks.names})

    def finish(left: pa.Table, right: pa.Table) -> pa.Table:
        some = right.to_pylist()
        return pa.Table.from_batches([batch_of(result, output(list(_removed(row, some)))) for row in left.to_pylist()] or [batch_of(result, {n: [] for n in result.names})])

    whole = stored.groupBy("block")
    candidates = whole.cogroup(shared.groupBy("block")).applyInArrow(gather, sent)
    # settled marks of different blocks need not meet
    spread = F.when(F.col("part") < 0, F.col("block")).otherwise(0)
    marked = candidates.repartition("part", spread).sortWithinPartitions("part", "block").mapInArrow(mark, marks)
    done = whole.cogroup(marked.groupBy("block")).applyInArrow(finish, result)

    def untouched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or b"" for t in batch.column(1).cast(pa.binary()).to_pylist()]
            yield batch_of(result, output([(None, t, np.zeros(len(t), bool)) for t in texts]))

    return done.unionByName(rows.where("doc_id IS NULL").mapInArrow(untouched, result))
