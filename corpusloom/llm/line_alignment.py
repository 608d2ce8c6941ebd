"""Line dedup by pairwise alignment.

Overlapping documents are found through shared line hashes.  A line occurrence is named by its hash
and by how often the document had it before, so that every name is unique within its document, as
patience diff wants its anchors.  Each name has a holder, the earliest document (smallest doc_id) with it;
a later document pairs with the holders of all its names, however frequent.  A caller may ask for pairs
that are founded on a line that at most ``rare_df`` documents have (a document without such a line pairs
through its rarest shared one); by default there is no bound.  The names that a pair shares are aligned by patience:
in the order of the later document, the longest run of names whose places also rise in the holder.
Aligned lines are deleted from the later document; neighbours in both are one block.

With ``whole`` (the registered query), the names that a document shares but that are not
aligned with their holder go on: among the documents where such a name is left, the earliest is its next
holder, and so forth until no name is left in two documents.  Later copies of a document with moved
sections so lose all that the first such document has.

A document thus meets as many others as it has shared lines at most, and a frequent line brings one
partner, its holder, to every document: no pairs within a group are made.  What meets in one task are
the shared lines of one document.

Lines are compared without outer white space.  Lines of fewer than ``min_chars`` characters are no
anchors; they go with the anchor before them (at the start, with the first one) if the lines around it
agree as well.  With ``whole``, short lines between two anchors that hold ``min_chars`` characters together
are named themselves: from each of them and up to each of them, the shortest run with so many characters
is an anchor, so that any passage with so many characters is found wherever it stands.  Holders are judged on the input, not on what is left of it.

Null and empty texts have no lines to delete.  Rows with a null doc_id stay as they are.  Rows with equal
doc_ids never delete from each other; each gets its own result.
"""

from __future__ import annotations

import hashlib
import math
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import batch_of, documents, free_names, groups, release, rewritten, written

#: No bound: results do not depend on how many documents share a line.
RARE_DF = math.inf
MIN_CHARS = 20


def units(text: str, min_chars: int) -> tuple[list[str], list[tuple[int, int, int]]]:
    """Lines, and (first line, end line, anchor line) of each anchor with the short lines around it."""
    lines = text.split("\n")
    anchors = [i for i, line in enumerate(lines) if len(line) >= min_chars and len(line.strip()) >= min_chars]
    ends = [*anchors[1:], len(lines)]
    return lines, [(0 if k == 0 else a, e, a) for k, (a, e) in enumerate(zip(anchors, ends))]


def runs(text: str, min_chars: int) -> tuple[list[str], list[tuple[int, int, int, int]]]:
    """Lines, and (first line, end line, anchor from, anchor to) of each anchor, runs of short lines among them."""
    lines = text.split("\n")
    chars = [len(line.strip()) for line in lines]
    edges = [-1, *(i for i, c in enumerate(chars) if c >= min_chars), len(lines)]
    out, first = [], 0
    for a, b in zip(edges, edges[1:]):
        full = [i for i in range(a + 1, b) if chars[i]]
        named = sum(chars[i] for i in full) >= min_chars
        if a >= 0:
            out.append((first, full[0] if named else b, a, a + 1))
        if named:
            for k, j in _shortest([chars[i] for i in full], min_chars):
                out.append((0 if a < 0 and k == 0 else full[k], full[j] if j < len(full) else b, full[k], full[j - 1] + 1))
        first = 0 if a < 0 and not named else b
    return lines, out


def _shortest(chars: list[int], least: int) -> list[tuple[int, int]]:
    """(from, to) of the shortest runs that start or end at each number and come to ``least``."""
    spans, total, j = set(), 0, 0
    for k, c in enumerate(chars):
        while j < len(chars) and total < least:
            total += chars[j]
            j += 1
        if total < least:
            break
        spans.add((k, j))
        total -= c
    total = k = 0
    for j, c in enumerate(chars):
        total += c
        while total - chars[k] >= least:
            total -= chars[k]
            k += 1
        if total >= least:
            spans.add((k, j + 1))
    return sorted(spans)


def _units(text: str, min_chars: int, whole: bool) -> tuple[list[str], list[tuple[int, int, int, int]]]:
    if whole:
        return runs(text, min_chars)
    lines, found = units(text, min_chars)
    return lines, [(first, end, at, at + 1) for first, end, at in found]


def rising(places: list[int]) -> list[int]:
    """Numbers of a longest strictly rising run of ``places`` (patience sorting)."""
    tops: list[int] = []
    holds: list[int] = []
    back = [-1] * len(places)
    for i, p in enumerate(places):
        k = bisect_left(tops, p)
        if k == len(tops):
            tops.append(p)
            holds.append(i)
        else:
            tops[k], holds[k] = p, i
        back[i] = holds[k - 1] if k else -1
    out, i = [], holds[-1] if holds else -1
    while i >= 0:
        out.append(i)
        i = back[i]
    return out[::-1]


def align(shared: list[tuple[int, ...]], rare_df: float) -> list[tuple[int, bool]]:
    """(unit, whether its short lines go too) to delete, from (holder, df, own place, its place, own and its surroundings, name)."""
    shared = sorted(set(shared), key=lambda r: (r[0], r[2]))
    rarest = min(r[1] for r in shared)
    bound = max(rare_df, rarest)
    by_holder: dict[int, list] = {}
    for r in shared:
        by_holder.setdefault(r[0], []).append(r)
    out = {}
    for rows in by_holder.values():
        if min(r[1] for r in rows) <= bound:
            for i in rising([r[3] for r in rows]):
                out[rows[i][2]] = rows[i][4] == rows[i][5]
    return sorted(out.items())


def _hash(s: str) -> int:
    return xxhash.xxh3_64_intdigest(s.encode("utf-8", "surrogatepass"))


def _within(name: int, around: int) -> int:
    """Name of an anchor together with its surroundings, as a signed long."""
    return (name * 31 + around * 0x9E3779B97F4A7C15 + (1 << 63)) % (1 << 64) - (1 << 63)


def line_names(docs: DataFrame, min_chars: int, whole: bool = False) -> DataFrame:
    """name, doc_id, row, place, around: every anchor of every document that has an id."""
    schema = docs.sparkSession.createDataFrame([], "name long, doc_id long, row long, place int, around int").schema

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in groups(batches, 1 << 21):
            name, nth, count, place, around = [], [], [], [], []
            for text in part.column("text").to_pylist():
                lines, found = _units(text, min_chars, whole)
                seen: dict[int, int] = {}
                for k, (first, end, at, to) in enumerate(found):
                    h = _hash("\n".join(line.strip() for line in lines[at:to]))
                    n = seen.get(h, 0)
                    seen[h] = n + 1
                    name.append(h)
                    nth.append(n)
                    place.append(k)
                    around.append(_hash("\n".join(lines[first:at]) + "\r" + "\n".join(lines[to:end])) >> 33 if end - first > to - at else 0)
                count.append(len(found))
            names = np.array(name, np.uint64) + np.array(nth, np.uint64) * np.uint64(0x9E3779B97F4A7C15)
            columns = {
                "name": names.view(np.int64),
                "doc_id": np.repeat(part.column("doc_id").to_numpy(), count),
                "row": np.repeat(part.column("row").to_numpy(), count),
                "place": np.array(place, np.int32),
                "around": np.array(around, np.int32),
            }
            for i in range(0, len(names), 50_000):
                yield batch_of(schema, {k: v[i : i + 50_000] for k, v in columns.items()})
        release()

    return docs.where("doc_id IS NOT NULL").mapInArrow(emit, schema)


def _aligned(names: DataFrame, rare_df: float) -> DataFrame:
    """doc_id, row, gone (units to delete; negative numbers leave the short lines) and the shared names that are left, one row per document."""
    packed = F.shiftleft(F.col("place").cast("long"), 32).bitwiseOR(F.col("around").cast("long"))
    holders = names.groupBy("name").agg(F.min("doc_id").alias("holder"), F.max("doc_id").alias("last"), F.count("*").alias("df"), F.min_by(packed, "doc_id").alias("at"))
    # as a table of its own, so that the join below can split a hot name
    holders = written(holders.where("last > holder").drop("last"), "holders")
    shared = names.join(holders, "name").where("doc_id > holder").select("doc_id", "row", "holder", "df", "place", "around", "at", "name")
    schema = names.sparkSession.createDataFrame([], "doc_id long, row long, gone array<int>, left array<struct<name:long,place:int,around:int>>").schema

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: dict = {n: [] for n in schema.names}
        key, held = None, []

        def close():
            if held:
                found = align(held, rare_df)
                gone = [k + 1 if whole else -k - 1 for k, whole in found]
                taken = {k for k, _ in found}
                left = [{"name": r[6], "place": r[2], "around": r[4]} for r in sorted(set(held)) if r[2] not in taken]
                # short lines that the holder does not have go on to documents with the same ones
                partly = {k for k, whole in found if not whole}
                left += [{"name": _within(r[6], r[4]), "place": r[2], "around": r[4]} for r in sorted(set(held)) if r[2] in partly and r[4]]
                for n, v in zip(schema.names, (*key, gone, left)):
                    out[n].append(v)

        for batch in batches:
            for doc, row, holder, df, place, around, at, name in zip(*(c.to_pylist() for c in batch.columns)):
                if (doc, row) != key:
                    close()
                    key, held = (doc, row), []
                held.append((holder, df, place, at >> 32, around, at & 0xFFFFFFFF, name))
            if len(out["row"]) >= 2000:
                yield batch_of(schema, out)
                out = {n: [] for n in schema.names}
        close()
        if out["row"]:
            yield batch_of(schema, out)

    return shared.repartition("doc_id", "row").sortWithinPartitions("doc_id", "row").mapInArrow(each, schema)


def deletions(docs: DataFrame, rare_df: float = RARE_DF, min_chars: int = MIN_CHARS, whole: bool = False) -> DataFrame:
    """doc_id, row (hash of the text), gone (units to delete; negative numbers leave the short lines), one row per document."""
    found = _aligned(line_names(_rows(docs), min_chars, whole), rare_df)
    if not whole:
        return found.drop("left")
    parts = []
    while True:
        found = written(found, "aligned")
        parts.append(found.select("doc_id", "row", "gone"))
        left = found.where("size(left) > 0")
        if left.isEmpty():
            break
        # the first document where a name is left keeps it, so every round settles one document of each name at least
        found = _aligned(left.select("doc_id", "row", F.explode("left").alias("l")).select("doc_id", "row", "l.*"), rare_df)
    gone = parts[0]
    for p in parts[1:]:
        gone = gone.unionByName(p)
    return gone.groupBy("doc_id", "row").agg(F.flatten(F.collect_list("gone")).alias("gone")) if len(parts) > 1 else gone


def _rows(docs: DataFrame) -> DataFrame:
    return documents(docs).withColumn("row", F.xxhash64("text"))


def remaining(text: str, gone: list[int] | None, min_chars: int, whole: bool = False) -> tuple[str, int, int, int]:
    """What is left of a text, its lines, the deleted lines and blocks."""
    if not text:
        return text, 0, 0, 0
    lines, found = _units(text, min_chars, whole)
    drop = np.zeros(len(lines), bool)
    for g in gone or []:
        first, end, at, to = found[abs(g) - 1]
        drop[at:to] = True
        if g > 0:
            drop[first:end] = True
    blocks = int(drop[0]) + int((drop[1:] & ~drop[:-1]).sum())
    return "\n".join(line for line, d in zip(lines, drop) if not d), len(lines), int(drop.sum()), blocks


def dedup(docs: DataFrame, rare_df: float = RARE_DF, min_chars: int = MIN_CHARS, whole: bool = False) -> DataFrame:
    """doc_id, kept (text), n_lines, n_removed, n_blocks of every row."""
    return _map(docs, rare_df, min_chars, whole, "doc_id long, kept string, n_lines long, n_removed long, n_blocks long", lambda kept: kept)


def digests(docs: DataFrame, rare_df: float = RARE_DF, min_chars: int = MIN_CHARS, whole: bool = True) -> DataFrame:
    """doc_id, kept_sha256, n_lines, n_removed, n_blocks of every row."""
    return _map(docs, rare_df, min_chars, whole, "doc_id long, kept_sha256 string, n_lines long, n_removed long, n_blocks long", lambda kept: hashlib.sha256(kept.encode("utf-8", "replace")).hexdigest())


def _map(docs: DataFrame, rare_df: float, min_chars: int, whole: bool, ddl: str, shown) -> DataFrame:
    rows = _rows(docs)
    # merged at all sizes: a plan that broadcasts small deletions does not say how a large table runs
    joined = rows.join(deletions(docs, rare_df, min_chars, whole).hint("merge"), ["doc_id", "row"], "left").select("doc_id", "text", "gone")
    schema = rows.sparkSession.createDataFrame([], ddl).schema

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in groups(batches, 1 << 22):
            out = [remaining(t, g, min_chars, whole) for t, g in zip(part.column("text").to_pylist(), part.column("gone").to_pylist())]
            values = [part.column("doc_id").to_pylist(), [shown(o[0]) for o in out], *([o[k] for o in out] for k in (1, 2, 3))]
            yield batch_of(schema, dict(zip(schema.names, values)))

    return joined.mapInArrow(apply, schema)


def without_repeats(docs: DataFrame, rare_df: float = RARE_DF, min_chars: int = MIN_CHARS, whole: bool = True) -> DataFrame:
    """``docs`` with all columns, less the lines that earlier documents have; documents left blank go."""
    doc, row, gone_ = free_names(docs, "_doc", "_row", "_gone")
    gone = deletions(docs, rare_df, min_chars, whole).select(F.col("doc_id").alias(doc), F.col("row").alias(row), F.col("gone").alias(gone_))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    joined = docs.join(gone.hint("merge"), (F.col("doc_id").cast("long") == F.col(doc)) & (F.xxhash64(text) == F.col(row)), "left")

    def change(texts: list[str], part: pa.Table) -> list[str | None]:
        out: list[str | None] = []
        for text, units_ in zip(texts, part.column(gone_).to_pylist()):
            kept = remaining(text, units_, min_chars, whole)[0] if units_ else text
            out.append(None if units_ and not kept.strip() else kept)
        return out

    return rewritten(joined, change, (doc, row, gone_))
