"""BPE encoding and decoding by tree concatenation.

A text longer than ``leaf_chars`` is halved until its parts are short enough; the parts are rows of
their own, so that one long text is encoded by many tasks.  Joined parts are made right at every node
of the tree: a window around the join is encoded anew and grows until it holds, on either side, a token
that the part also has at the same place.  A BPE encoding is valid when every pair of neighbouring
tokens is, so the tokens left of such a token, those of the window, and those right of the other one
make up the encoding of the joined text.

Within a part, words are encoded once and kept in a bounded table.  A white-space character always ends
a word of this tokenizer, so the encoding of a text is that of its words put together.

Null and empty texts have no tokens and decode to the empty text.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import batch_of, documents

LEAF_CHARS = 16_384
#: Words kept per worker; the later half goes when it is full (frequent words come early).
KEPT_WORDS = 600_000
#: Characters for which lower-casing a text equals what the tokenizer does character by character.
_RARE = re.compile("[^\x00-į]")
#: Separators for str.split() that are no white space for the tokenizer.
_ODD_SPACE = ("\x1c", "\x1d", "\x1e", "\x1f")


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class WordBpe:
    """The tokenizer of one file, for one worker process."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.whole = Tokenizer.from_str(json.dumps(spec | {"truncation": None, "padding": None}))
        # only its merges: words come as the byte characters of the vocabulary, parted by spaces
        self.merges = Tokenizer.from_str(
            json.dumps(spec | {"truncation": None, "padding": None, "normalizer": None, "pre_tokenizer": {"type": "WhitespaceSplit"}, "added_tokens": []})
        )
        vocab = self.whole.get_vocab(with_added_tokens=True)
        size = max(vocab.values()) + 1
        # texts with one of these are encoded as a whole
        self.apart = (*_ODD_SPACE, *(a["content"] for a in spec["added_tokens"]))
        self.tokens = np.empty(size, object)
        self.ends = np.zeros(size, bool)
        self.lengths = np.zeros(size, np.int64)
        for token, i in vocab.items():
            self.tokens[i] = token
            self.ends[i] = token.endswith("</w>")
            self.lengths[i] = len(token) - 4 * token.endswith("</w>")
        self.decimals = np.array([str(i) for i in range(size)], object)
        pattern = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.pattern = regex.compile(pattern)
        self.bytes = _byte_characters()
        self.words: dict[str, bytes] = {}

    # ------------------------------------------------------------ texts

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        cut: list[list[str] | None] = []
        got: list = []
        get = self.words.get
        missing: set[str] = set()
        for text in texts:
            if any(s in text for s in self.apart):
                cut.append(None)
                got.append(np.array(self.whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes())
                continue
            words = (text.lower() if text.isascii() or not _RARE.search(text) else text).split()
            ids = list(map(get, words))
            cut.append(words)
            got.append(ids)
            if None in ids:
                missing.update(w for w, x in zip(words, ids) if x is None)
        if missing:
            new = self._encode_words(list(missing))
            for k, words in enumerate(cut):
                if words is not None and None in got[k]:
                    got[k] = [new[w] if x is None else x for w, x in zip(words, got[k])]
            self.words.update(new)
            if len(self.words) > KEPT_WORDS:
                self.words = dict(list(self.words.items())[: KEPT_WORDS // 2])
        return [x if isinstance(x, bytes) else b"".join(x) for x in got]

    def _encode_words(self, words: list[str]) -> dict[str, bytes]:
        out: dict[str, bytes] = {}
        plain, cores = [], {}
        for w in words:
            if _RARE.search(w):
                out[w] = np.array(self.whole.encode(w, add_special_tokens=False).ids, "<u4").tobytes()
            else:
                parts = [w.lower()] if w.isalpha() else self.pattern.findall(w.lower())
                plain.append((w, parts))
                cores.update((p, self.words.get(p)) for p in parts)
        order = [c for c, ids in cores.items() if ids is None]
        for at in range(0, len(order), 2000):
            some = order[at : at + 2000]
            text = " ".join(c.encode().decode("latin-1").translate(self.bytes) for c in some)
            ids = np.array(self.merges.encode(text, add_special_tokens=False).ids, "<u4")
            stops = np.flatnonzero(self.ends[ids]) + 1
            raw, start = ids.tobytes(), 0
            for core, stop in zip(some, stops.tolist(), strict=True):
                cores[core] = raw[4 * start : 4 * stop]
                start = stop
        out.update((w, b"".join([cores[p] for p in parts])) for w, parts in plain)
        return out

    def decode(self, ids: np.ndarray) -> str:
        """The tokens of the ids, joined by spaces: this tokenizer file names no decoder."""
        return " ".join(self.tokens[ids].tolist())

    def decimal(self, ids: np.ndarray) -> str:
        return " ".join(self.decimals[ids].tolist())

    # ------------------------------------------------------------ joins

    def size(self, text: str) -> int:
        """Normalized bytes of ``text`` without white space, which is what its tokens cover."""
        return len("".join(self.whole.normalizer.normalize_str(text).split(" ")).encode())

    def join(self, left: str, a: np.ndarray, right: str, b: np.ndarray, window: int = 64) -> np.ndarray:
        """Ids of ``left + right`` from those of both sides."""
        if not left or not right:
            return b if not left else a
        while window < len(left) or window < len(right):
            head, tail = left[-window:], right[:window]
            ids = np.frombuffer(self.encode([head + tail])[0], "<u4")
            at = np.concatenate([[0], np.cumsum(self.lengths[ids])]) - self.size(head)
            before = np.concatenate([[0], -np.cumsum(self.lengths[a[::-1][: len(ids)]])])[::-1]
            known = a[len(a) - (len(before) - 1) :]
            after = np.concatenate([[0], np.cumsum(self.lengths[b[: len(ids)]])])
            t = self._common(ids, at, known, before, left=True) if window < len(left) else (-1, -1)
            u = self._common(ids, at, b[: len(ids)], after, left=False) if window < len(right) else (len(ids), len(b))
            if t is not None and u is not None and t[0] < u[0]:
                first = a[: len(a) - len(known) + t[1] + 1] if window < len(left) else a[:0]
                last = b[u[1] + 1 :] if window < len(right) else b[:0]
                return np.concatenate([first, ids[t[0] + 1 : u[0] + 1], last])
            window *= 2
        return np.frombuffer(self.encode([left + right])[0], "<u4")

    def _common(self, ids, at, known, places, left: bool) -> tuple[int, int] | None:
        """A token on one side of the join that both encodings have at the same place, word ends first."""
        mine = {int(p): k for k, p in enumerate(places[:-1])}
        found = []
        for i in range(len(ids)):
            if (at[i + 1] > 0) if left else (at[i] < 0):
                continue
            k = mine.get(int(at[i]))
            # the window's outermost tokens may come from a cut word
            if k is not None and known[k] == ids[i] and (i > 0 if left else i < len(ids) - 1):
                found.append((bool(self.ends[ids[i]]), i, k))
        if not found:
            return None
        ended = [x for x in found if x[0]] or found
        pick = ended[len(ended) // 2]
        return pick[1], pick[2]

    def encode_tree(self, parts: list[str], coded: list[np.ndarray]) -> np.ndarray:
        """Joins neighbouring parts level by level."""
        while len(parts) > 1:
            texts, ids = [], []
            for i in range(0, len(parts), 2):
                if i + 1 < len(parts):
                    ids.append(self.join(parts[i], coded[i], parts[i + 1], coded[i + 1]))
                    texts.append(parts[i] + parts[i + 1])
                else:
                    ids.append(coded[i])
                    texts.append(parts[i])
            parts, coded = texts, ids
        return coded[0] if coded else np.array([], "<u4")


def _byte_characters() -> dict[int, str]:
    """The printable character that byte-level vocabularies use for each byte."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(rest)}


@lru_cache(maxsize=4)
def worker(path: str) -> WordBpe:
    return WordBpe(path)


def halves(text: str, leaf_chars: int) -> list[str]:
    """``text`` halved until no part is longer than ``leaf_chars``; no cut before a combining character."""
    if len(text) <= leaf_chars:
        return [text]
    cut = len(text) // 2
    while cut < len(text) and (unicodedata.combining(text[cut]) or "ᅠ" <= text[cut] <= "ᇿ"):
        cut += 1
    if cut == len(text):
        return [text]
    return halves(text[:cut], leaf_chars) + halves(text[cut:], leaf_chars)


def encode(docs: DataFrame, path: str | None = None, leaf_chars: int = LEAF_CHARS) -> DataFrame:
    """doc_id, ids (binary, little-endian unsigned 32-bit) and decoded text of every row.

    Rows may repeat; each gets its own result.
    """
    return _map_ids(docs, path, leaf_chars, "doc_id long, ids binary, decoded string", _plain)


def digests(docs: DataFrame, path: str | None = None, leaf_chars: int = LEAF_CHARS) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row."""
    return _map_ids(docs, path, leaf_chars, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", _digest)


def _plain(bpe: WordBpe, doc, ids: np.ndarray) -> dict:
    return {"doc_id": doc, "ids": ids.tobytes(), "decoded": bpe.decode(ids)}


def _digest(bpe: WordBpe, doc, ids: np.ndarray) -> dict:
    return {
        "doc_id": doc,
        "n_tokens": len(ids),
        "ids_sha256": hashlib.sha256(bpe.decimal(ids).encode()).hexdigest(),
        "decoded_sha256": hashlib.sha256(bpe.decode(ids).encode()).hexdigest(),
    }


def _map_ids(docs: DataFrame, path, leaf_chars, ddl: str, make) -> DataFrame:
    path = path or default_path()
    rows = documents(docs)
    long = F.length("text") > leaf_chars
    schema = rows.sparkSession.createDataFrame([], ddl).schema
    names = schema.names

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = worker(path)
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for i in range(0, len(texts), 500):
                coded = bpe.encode(texts[i : i + 500])
                out = [make(bpe, d, np.frombuffer(c, "<u4")) for d, c in zip(ids[i : i + 500], coded)]
                yield batch_of(schema, {n: [r[n] for r in out] for n in names})

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, doc, text in zip(*(c.to_pylist() for c in batch.columns)):
                parts = halves(text, leaf_chars)
                yield batch_of(leaf, {"row": [row] * len(parts), "doc_id": [doc] * len(parts), "part": range(len(parts)), "text": parts})

    def leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = worker(path)
        for batch in batches:
            table = batch.to_pydict()
            table["ids"] = [x for i in range(0, batch.num_rows, 100) for x in bpe.encode(table["text"][i : i + 100])]
            yield batch_of(coded, table)

    def joined(table: pa.Table) -> pa.Table:
        bpe = worker(path)
        rows = sorted(table.to_pylist(), key=lambda r: r["part"])
        copies = sum(r["part"] == 0 for r in rows)
        rows = rows[::copies]
        ids = bpe.encode_tree([r["text"] for r in rows], [np.frombuffer(r["ids"], "<u4") for r in rows])
        out = make(bpe, rows[0]["doc_id"], ids)
        return pa.Table.from_batches([batch_of(schema, {n: [out[n]] * copies for n in names})])

    spark = rows.sparkSession
    leaf = spark.createDataFrame([], "row string, doc_id long, part int, text string").schema
    coded = spark.createDataFrame([], "row string, doc_id long, part int, text string, ids binary").schema
    # a row's name comes from its content, so that a task run again gives the same; equal rows share a group
    name = F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.sha2("text", 256))
    named = rows.where(long).select(name.alias("row"), "doc_id", "text")
    parts = named.mapInArrow(split, leaf).repartition("row", "part").mapInArrow(leaves, coded)
    merged = parts.groupBy("row").applyInArrow(joined, schema)
    short = rows.where(~long).mapInArrow(whole, schema)
    return short.unionByName(merged)

