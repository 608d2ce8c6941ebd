"""How filters of a corpus interact, over every order in which they could be applied.

Every document gets a mask of the filters that it fails.  A mask decides what happens to the document at
each step of each order: 120 orders of five filters have 600 steps.  All outcomes of a mask are laid side
by side in the fields of one wide integer, so that adding a document to all counters of its part is one
addition.  Tasks add up the integers of their documents, part by part; their sums meet in a tree, part by
part, and are unpacked at its root.  A field has 64 bits and gains at most 1 per document, so no table
can make one overflow into the next.

Defined results: null texts and null parts count as empty.  A document is good (toxic) when any label row
of its doc_id says so.  A repeat is a text that a row with a smaller doc_id also has; rows that repeat with
one doc_id are no repeats of each other, and rows without doc_id neither are repeats nor make any.
Repeated rows count each.  An empty table gives no rows.  Long texts are read whole.  Other columns
are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import batch_of, documents, written

#: Counters of a step, in the order of their fields.
COUNTERS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")
FIELD_BITS = 64
#: Sums of a part that one task holds before it passes them on.
TASK_PARTS = 500
#: Sums of a part meet in so many groups before they meet in one.
FAN_IN = 64

_SPACE = r"[\x20\x09-\x0D]+"
_CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def text_filters() -> dict[str, Column]:
    """Failure conditions on ``text`` and its ``words``."""
    size, text = F.size("words"), F.col("text")
    return {
        "A": size < 200,
        "B": F.size(F.array_distinct("words")) * 100 < size * 50,
        "C": (F.length(text) - F.length(F.translate(text, _CAPITALS, ""))) * 100 > F.length(text) * 3,
        "D": text.rlike("[#$%&*|]"),
    }


def masks(docs: DataFrame, labels: DataFrame, part: str = "lang", filters: dict[str, Column] | None = None) -> DataFrame:
    """part, mask, good, toxic of every document.

    Bit i of the mask is the i-th filter; the bit after the last one is the repeated text.
    """
    filters = text_filters() if filters is None else filters
    words = F.filter(F.split("text", _SPACE), lambda w: w != "")
    rows = documents(docs, part).withColumn("words", words)
    failed = sum((F.coalesce(c, F.lit(False)).cast("int") * (1 << i) for i, c in enumerate(filters.values())), F.lit(0))
    # narrow rows, written once: the texts are read once, and equal texts meet by their digest
    narrow = rows.select("doc_id", F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), failed.alias("mask"), F.unhex(F.sha2("text", 256)).alias("digest"))
    narrow = written(narrow, "masks")
    first = narrow.groupBy("digest").agg(F.min("doc_id").alias("first"))
    marks = labels.where(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(
        F.coalesce(F.max(F.col("quality") == 1), F.lit(False)).alias("good"), F.coalesce(F.max(F.col("toxic") == 1), F.lit(False)).alias("toxic")
    )
    repeat = F.coalesce(F.col("doc_id") > F.col("first"), F.lit(False)).cast("int") * (1 << len(filters))
    joined = narrow.join(first, "digest", "left").select("doc_id", "part", (F.col("mask") + repeat).alias("mask")).join(marks, "doc_id", "left")
    return joined.select("part", "mask", F.coalesce("good", F.lit(False)).alias("good"), F.coalesce("toxic", F.lit(False)).alias("toxic"))


def orders(letters: str) -> list[str]:
    return ["".join(p) for p in permutations(letters)]


def outcomes(letters: str, mask: int, good: bool, toxic: bool) -> np.ndarray:
    """What one document adds to each counter (columns) at each step of each order (rows)."""
    out = []
    for order in orders(letters):
        gone = False
        for letter in order:
            bit = 1 << letters.index(letter)
            fails = bool(mask & bit)
            removed = fails and not gone
            redundant = fails and gone
            gone = gone or fails
            out.append((not gone, removed, redundant, mask == bit, removed and good, removed and toxic))
    return np.array(out, np.uint64)


@lru_cache(maxsize=1024)
def wide(letters: str, mask: int, good: bool, toxic: bool) -> int:
    """``outcomes`` as one integer."""
    return int.from_bytes(outcomes(letters, mask, good, toxic).astype("<u8").tobytes(), "little")


def unpacked(letters: str, total: int) -> np.ndarray:
    """The counters of a sum of wide integers: steps x counters."""
    steps = len(orders(letters)) * len(letters)
    data = total.to_bytes(steps * len(COUNTERS) * FIELD_BITS // 8, "little")
    return np.frombuffer(data, "<u8").reshape(steps, len(COUNTERS)).astype(np.int64)


def audit(masked: DataFrame, letters: str = "ABCDE", fan_in: int = FAN_IN) -> DataFrame:
    """part, filter_order, step, the counters and shapley, for every step of every order of the filters."""
    spark = masked.sparkSession
    sums = spark.createDataFrame([], "part string, slot long, total binary").schema
    result = spark.createDataFrame([], "part string, filter_order string, step int, " + ", ".join(f"{c} long" for c in (*COUNTERS, "shapley"))).schema

    def packed(part: str, slot: int, total: int) -> tuple:
        return part, slot, total.to_bytes((total.bit_length() + 7) // 8, "little")

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        slot, totals = TaskContext.get().partitionId() % fan_in, {}

        def flush():
            rows = [packed(part, slot, total) for part, total in totals.items()]
            totals.clear()
            return batch_of(sums, dict(zip(sums.names, zip(*rows))))

        for batch in batches:
            counted = pa.Table.from_batches([batch]).group_by(batch.schema.names).aggregate([([], "count_all")]).to_pylist()
            for r in counted:
                part = r["part"]
                totals[part] = totals.get(part, 0) + r["count_all"] * wide(letters, r["mask"], r["good"], r["toxic"])
                if len(totals) > TASK_PARTS:
                    yield flush()
        if totals:
            yield flush()

    def together(table: pa.Table) -> int:
        return sum(int.from_bytes(t, "little") for t in table.column("total").to_pylist())

    def meet(table: pa.Table) -> pa.Table:
        row = packed(table.column("part")[0].as_py(), 0, together(table))
        return pa.Table.from_batches([batch_of(sums, {n: [v] for n, v in zip(sums.names, row)})])

    def report(table: pa.Table) -> pa.Table:
        counts = unpacked(letters, together(table))
        names = [o for o in orders(letters) for _ in letters]
        filters = np.array(list("".join(orders(letters))))
        removed = {x: int(counts[filters == x, COUNTERS.index("removed")].sum()) for x in letters}
        columns = {
            "part": [table.column("part")[0].as_py()] * len(names),
            "filter_order": names,
            "step": list(range(1, len(letters) + 1)) * (len(names) // len(letters)),
            **{c: counts[:, i] for i, c in enumerate(COUNTERS)},
            "shapley": [removed[x] for x in filters],
        }
        return pa.Table.from_batches([batch_of(result, columns)])

    partial = masked.mapInArrow(add, sums).groupBy("part", "slot").applyInArrow(meet, sums)
    return partial.groupBy("part").applyInArrow(report, result)
