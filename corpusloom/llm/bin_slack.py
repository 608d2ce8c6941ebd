"""Packing by minimum bin slack.

A task keeps a pool of pieces, counted by length.  A sequence starts with the longest piece; which of the
remaining lengths fill it closest to capacity, and how many of each, a subset-sum dynamic programme
finds: bit s of an integer says whether a total of s can be reached, each length (longest first) shifts
it by its copies, and the counts are read back from the last length to the first.  While the pool is
large a sequence nearly always comes out full.  Where it cannot, a piece is cut to fill the rest, once
the pool is full; pieces that are left when a task ends meet those of other tasks in groups of bounded
size and are packed in the same way, with cuts.  What a group has left at its end, less than a sequence,
is cut into sequences whose lengths are powers of two, which need no padding.

Documents longer than the capacity give whole sequences of their own first; only their ends are packed.

Null and empty texts are one end token.  Rows may repeat; each is packed.  Pieces of equal length are
taken newest first, which changes no length.  An empty table gives no rows.  Long texts are encoded
whole.  Other columns are not read.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import documents, in_batches, written

CAPACITY = 2048
END_ID = 1
#: Pieces in a task's pool: packing starts at this number and stops at half of it.
POOL = 4096
#: Pieces that a task may leave to the second round.
LEFT = 64
#: Pieces that meet in one group of the second round.
GROUP = 512

# The word pattern of this kind of tokenizer, and the characters on whose classes both
# libraries agree.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_BEYOND = re.compile("[^\x00-\u0557\u2000-\u208e\u3000-\u9fff]")

_PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class ByteBpe:
    """The tokenizer of one file.

    tiktoken encodes what it encodes alike: where ids follow the order of the merges and the last merge of
    every token by rank is the listed one (tests/llm hold this for the default file), merging by rank equals
    merging by list.  Texts with added tokens or rare characters go through the library itself, and so
    does everything for files of another kind.
    """

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.library = Tokenizer.from_str(json.dumps(spec | {"truncation": None, "padding": None}))
        self.apart = tuple(a["content"] for a in spec["added_tokens"])
        ranks = ranks_of(spec)
        self.fast = tiktoken.Encoding("ranks", pat_str=WORDS, mergeable_ranks=ranks, special_tokens={}) if ranks else None

    def encode(self, text: str) -> bytes:
        """Little-endian unsigned 32-bit ids."""
        if self.fast is None or any(s in text for s in self.apart) or _BEYOND.search(text):
            return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        return self.fast.encode_to_numpy(text, disallowed_special=()).astype("<u4", copy=False).tobytes()


def ranks_of(spec: dict) -> dict[bytes, int] | None:
    """Bytes and rank of each token of a byte-level file whose ids follow its merges; None for other files."""
    plain = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}
    model, before = spec["model"], spec["pre_tokenizer"]
    if spec["normalizer"] or not before or any(before.get(k) != v for k, v in plain.items()):
        return None
    if any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges")):
        return None
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    code = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in shown)}
    vocab = model["vocab"]
    merged = [vocab.get("".join(m if isinstance(m, list) else m.split(" "))) for m in model["merges"]]
    if merged != list(range(256, 256 + len(merged))) or len(vocab) != 256 + len(merged):
        return None
    return {bytes(code[c] for c in token): i for token, i in vocab.items()}


@lru_cache(maxsize=1)
def worker(path: str) -> ByteBpe:
    return ByteBpe(path)


def fill(have: int, counts: list[int], room: int) -> tuple[int, list[tuple[int, int]]]:
    """The largest total of at most ``room``, and (length, number) of the pieces that make it up.

    Bit L of ``have`` says whether pieces of length L are there, ``counts`` how many.
    """
    mask = (1 << (room + 1)) - 1
    reach, steps = 1, []
    lengths = have & mask
    while lengths and not reach >> room & 1:
        length = lengths.bit_length() - 1
        lengths ^= 1 << length
        steps.append((length, reach))
        copies, step = min(counts[length], room // length), 1
        while copies:
            step = min(step, copies)
            reach |= reach << step * length & mask
            copies -= step
            step *= 2
    total = rest = reach.bit_length() - 1
    chosen = []
    for length, before in reversed(steps):
        number = 0
        while not before >> rest & 1:
            rest -= length
            number += 1
        if number:
            chosen.append((length, number))
    return total, chosen


class Pool:
    """Pieces by length; a piece is (doc_id, start, ids, tokens of its document)."""

    def __init__(self):
        self.counts: list[int] = []
        self.pieces: list[list[tuple]] = []
        self.have = self.number = self.tokens = 0

    def add(self, piece: tuple) -> None:
        length = len(piece[2]) // 4
        while len(self.pieces) <= length:
            self.pieces.append([])
            self.counts.append(0)
        self.pieces[length].append(piece)
        self.counts[length] += 1
        self.have |= 1 << length
        self.number += 1
        self.tokens += length

    def take(self, length: int) -> tuple:
        self.counts[length] -= 1
        if not self.counts[length]:
            self.have ^= 1 << length
        self.number -= 1
        self.tokens -= length
        return self.pieces[length].pop()

    def take_cut(self, length: int) -> tuple:
        """The first ``length`` tokens of the longest piece; the rest goes back."""
        doc, start, ids, whole = self.take(self.have.bit_length() - 1)
        if len(ids) > 4 * length:
            self.add((doc, start + length, ids[4 * length :], whole))
        return doc, start, ids[: 4 * length], whole

    def sequence(self, capacity: int, cut: bool) -> list[tuple] | None:
        """The pieces of a full sequence; None if there is none without a cut and ``cut`` is not set."""
        longest = self.have.bit_length() - 1
        if longest >= capacity:
            return [self.take_cut(capacity)] if cut or longest == capacity else None
        seed = self.take(longest)
        total, chosen = fill(self.have, self.counts, capacity - longest)
        slack = capacity - longest - total
        if slack and not cut:
            self.add(seed)
            return None
        out = [seed] + [self.take(length) for length, number in chosen for _ in range(number)]
        # a piece that fits into the slack would have been chosen
        return out + [self.take_cut(slack)] if slack else out

    def emptied(self, capacity: int) -> Iterator[list[tuple]]:
        """Full sequences, then those whose lengths are powers of two."""
        while self.tokens:
            yield self.sequence(capacity if self.tokens >= capacity else 1 << (self.tokens.bit_length() - 1), cut=True)


def pack(
    docs: DataFrame,
    path: str | None = None,
    capacity: int = CAPACITY,
    end_id: int = END_ID,
    pool_pieces: int = POOL,
    left_pieces: int = LEFT,
    group_pieces: int = GROUP,
) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset of every piece of every document."""
    path = path or default_path()
    spark = docs.sparkSession
    result = spark.createDataFrame([], _PIECES).schema
    with_ids = spark.createDataFrame([], _PIECES + ", ids binary").schema
    end = np.array([end_id], "<u4").tobytes()

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, pool, bpe = _Rows(with_ids, 0), Pool(), worker(path)
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for doc, text in zip(ids, texts):
                raw = bpe.encode(text) + end
                whole, start = len(raw) // 4, 0
                while whole - start > capacity:
                    out.sequence([(doc, start, raw[4 * start : 4 * (start + capacity)], whole)])
                    start += capacity
                pool.add((doc, start, raw[4 * start :], whole))
                if pool.number >= pool_pieces:
                    while pool.number > pool_pieces // 2 and pool.tokens >= capacity:
                        out.sequence(pool.sequence(capacity, False) or pool.sequence(capacity, True))
                yield from out.batches(2000)
        while pool.tokens >= capacity and (full := pool.sequence(capacity, False) or pool.number > left_pieces and pool.sequence(capacity, True)):
            out.sequence(full)
            yield from out.batches(2000)
        for length in range(len(pool.pieces)):
            for piece in pool.pieces[length]:
                out.left(piece)
        yield from out.batches(1)

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, pool = _Rows(result, 1 << 60), Pool()
        for batch in batches:
            for doc, start, whole, ids in zip(*(batch.column(c).to_pylist() for c in range(4))):
                pool.add((doc, start, ids, whole))
        for full in pool.emptied(capacity):
            out.sequence(full)
            yield from out.batches(2000)
        yield from out.batches(1)

    packed = written(documents(docs).mapInArrow(first, with_ids), "packed")
    left = packed.where(F.col("sequence_id").isNull()).select("doc_id", "start", "doc_tokens", "ids")
    groups = max(1, -(-left.count() // group_pieces))
    ends = left.repartition(groups, F.pmod(F.xxhash64("doc_id", "start"), F.lit(groups))).mapInArrow(again, result)
    return packed.where(F.col("sequence_id").isNotNull()).drop("ids").unionByName(ends)


class _Rows:
    """Rows of finished sequences, and of pieces that are left, until they are sent on."""

    def __init__(self, schema, base: int):
        from pyspark import TaskContext

        self.schema, self.next = schema, base + (TaskContext.get().partitionId() << 32)
        self.columns: dict[str, list] = {n: [] for n in schema.names}

    def _row(self, piece: tuple, sequence: int | None, offset: int | None, ids: bytes | None) -> None:
        doc, start, raw, whole = piece
        for name, value in zip(self.schema.names, (doc, start, len(raw) // 4, zlib.crc32(raw), whole, sequence, offset, ids)):
            self.columns[name].append(value)

    def sequence(self, pieces: list[tuple]) -> None:
        offset = 0
        for piece in pieces:
            self._row(piece, self.next, offset, None)
            offset += len(piece[2]) // 4
        self.next += 1

    def left(self, piece: tuple) -> None:
        self._row(piece, None, None, piece[2])

    def batches(self, least: int) -> Iterator[pa.RecordBatch]:
        if len(self.columns["doc_id"]) >= least:
            yield from in_batches(self.schema, self.columns, 2000)
            self.columns = {n: [] for n in self.schema.names}
