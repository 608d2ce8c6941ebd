"""Best-fit packing by hierarchical residual packing.

Every partition packs its pieces best-fit, longest first.  Bins with at most ``slack`` free places are
done and leave the job; the others become items of the next round, in which the bins of ``fan_in``
partitions meet in one and are packed best-fit again as wholes.  Rounds end when one task may hold what
is left (``task_items``) or nothing was gained.  A task never holds more than ``task_items`` items, and
a bin's members never exceed its capacity in number, since every piece has a token at least.

Null and empty texts are one piece of one token (the end token).  Rows may repeat; each is packed.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.bpe_concat import default_path, worker
from corpusloom.llm.common import documents, in_batches, release, written

CAPACITY = 4096
END_ID = 1
SLACK = 4
FAN_IN = 8
TASK_ITEMS = 200_000

_MEMBERS = "members array<struct<doc_id:long,piece:int,start:long,length:long,ids_crc32:long>>"
_BINS = f"bin long, fill long, done boolean, {_MEMBERS}"


def best_fit(sizes: list[int], capacity: int) -> list[list[int]]:
    """Item numbers of each bin: longest items first, each into the fullest bin that has room.

    Bins are held by free room; bit r of ``open_`` says whether a bin with r free places exists.
    """
    rooms: list[list[int]] = [[] for _ in range(capacity + 1)]
    bins: list[list[int]] = []
    open_ = 0
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        size = sizes[i]
        fitting = open_ >> size
        if fitting:
            room = size + (fitting & -fitting).bit_length() - 1
            b = rooms[room].pop()
            if not rooms[room]:
                open_ ^= 1 << room
            bins[b].append(i)
        else:
            room, b = capacity, len(bins)
            bins.append([i])
        left = room - size
        if left:
            rooms[left].append(b)
            open_ |= 1 << left
    return bins


def pieces_of(docs: list, texts: list[str], path: str, capacity: int, end_id: int) -> list[tuple]:
    """(doc_id, piece, start, length, crc32 of the ids) of each piece of some texts."""
    end = np.array([end_id], "<u4").tobytes()
    out = []
    for doc, ids in zip(docs, worker(path).encode(texts)):
        ids += end
        for piece, at in enumerate(range(0, len(ids), 4 * capacity)):
            part = ids[at : at + 4 * capacity]
            out.append((doc, piece, at // 4, len(part) // 4, zlib.crc32(part)))
    return out


def pack(
    docs: DataFrame,
    path: str | None = None,
    capacity: int = CAPACITY,
    end_id: int = END_ID,
    slack: int = SLACK,
    fan_in: int = FAN_IN,
    task_items: int = TASK_ITEMS,
    keep_worker: bool = True,
) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece of every document.

    ``keep_worker`` leaves tokenizer and words to the worker's next task; without it each task makes them
    anew and gives their memory back.
    """
    path = path or default_path()
    rows = documents(docs)
    spark = rows.sparkSession
    schema = spark.createDataFrame([], _BINS).schema

    def out(bins: list[tuple[int, list]], base: int) -> Iterator[pa.RecordBatch]:
        columns = {
            "bin": [base + k for k in range(len(bins))],
            "fill": [f for f, _ in bins],
            "done": [capacity - f <= slack for f, _ in bins],
            "members": [[dict(zip(("doc_id", "piece", "start", "length", "ids_crc32"), m)) for m in members] for _, members in bins],
        }
        if bins:
            yield from in_batches(schema, columns, 2000)

    def partition_base() -> int:
        from pyspark import TaskContext

        return TaskContext.get().partitionId() << 32

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, items = partition_base(), []

        def flush():
            packed = best_fit([x[3] for x in items], capacity)
            return [(sum(items[i][3] for i in b), [items[i] for i in b]) for b in packed]

        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for i in range(0, len(texts), 500):
                items += pieces_of(ids[i : i + 500], texts[i : i + 500], path, capacity, end_id)
                if len(items) >= task_items:
                    bins, items = flush(), []
                    yield from out(bins, base)
                    base += len(bins)
        yield from out(flush(), base)
        if not keep_worker:
            worker.cache_clear()
            release()

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, items = partition_base(), []

        def flush():
            packed = best_fit([f for f, _ in items], capacity)
            return [(sum(items[i][0] for i in b), [m for i in b for m in items[i][1]]) for b in packed]

        for batch in batches:
            fills, members = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            items += [(f, [tuple(m.values()) for m in ms]) for f, ms in zip(fills, members)]
            if len(items) >= task_items:
                bins, items = flush(), []
                yield from out(bins, base)
                base += len(bins)
        yield from out(flush(), base)

    bins = written(rows.mapInArrow(first, schema), "bins")
    finished, level = [], 0
    tasks = bins.select(F.shiftright("bin", 32)).distinct().count()
    while True:
        finished.append(bins.where("done").withColumn("level", F.lit(level)))
        open_bins = bins.where(~F.col("done"))
        left = open_bins.count()
        least = -(-left // task_items)
        if left <= 1 or tasks <= least:
            finished.append(open_bins.withColumn("level", F.lit(level)))
            break
        tasks, level = max(least, -(-tasks // fan_in)), level + 1
        # bins go round by their number: groups of like size, whatever the bins hold
        group = F.pmod(F.xxhash64("bin"), F.lit(tasks)).cast("int")
        bins = written(open_bins.repartition(tasks, group).select("fill", "members").mapInArrow(again, schema), "bins")
    packed = finished[0]
    for more in finished[1:]:
        packed = packed.unionByName(more)
    return _places(packed, schema)


def _places(packed: DataFrame, schema) -> DataFrame:
    """A row per piece; a bin's pieces stand one after another."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sequence, members = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            table = {n: [] for n in names}
            for s, ms in zip(sequence, members):
                at = 0
                for m in ms:
                    for n, v in m.items():
                        table[n].append(v)
                    table["sequence_id"].append(s)
                    table["offset"].append(at)
                    at += m["length"]
            if table["piece"]:
                yield from in_batches(result, table)

    result = packed.sparkSession.createDataFrame(
        [], "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    ).schema
    names = result.names
    # 2^40 bins a level are more than any table needs
    sequence = F.col("level").cast("long") * (1 << 58) + F.col("bin")
    return packed.select(sequence.alias("sequence_id"), "members").mapInArrow(rows, result)
