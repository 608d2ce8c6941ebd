"""Secret scanning with a random forest that removes false positives.

Candidates are runs of 12 or more of ``A-Za-z0-9+/_-`` that hold a digit or 16 capitals, the values assigned to a name
(``name = value``, 8 or more characters), and PEM blocks.  A value assigned to a secret name within a longer
value (``https://host?token=...``) is a candidate besides that one.  Each gets its features: length, how its
character transitions compare with those of the corpus, how much of it dictionary words cover (the
frequent words of the corpus), whether it stands in a path or address, and its neighbouring words.  A
random forest trained on labelled findings decides which candidates are secrets.

Findings may be given (doc_id, start, end, secret); else they are labelled by strict rules, which speak
only where a format leaves no doubt: issued key prefixes and values assigned to secret names are secrets;
plain numbers, UUIDs, named checksums and dictionary words are not.  Everything between is left to the
forest.  At most ``sample`` findings (smallest hashes) are used for fitting.  If the findings hold only
one class or none, a candidate is a secret when the rules say so.

Null and empty texts have no candidates.  Rows may repeat; each gets its own result.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import batch_of, documents, groups, in_batches, release, rewritten, written

SAMPLE = 20_000
TREES = 24
DEPTH = 6
DICTIONARY = 20_000
#: Words a task counts before it passes the sums on; any number gives the same result.
TABLE = 400_000
MASK = "[SECRET]"

_TOKEN = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-")
#: What a run of token characters must hold to be a candidate: a digit, or 16 capitals.
_SEED = re.compile(r"[0-9]|[A-Z]{16}")
_ASSIGN = re.compile(r"[=:]")
_NAME = re.compile(r"([A-Za-z][A-Za-z0-9_.-]{1,40})[\"']?[ \t]{0,3}$")
_VALUE = re.compile(r"[=:]?[ \t]{0,3}[\"']?([^\s\"'<>,;]{8,})")
#: The next assignment of a query string.
_FOLLOWING = re.compile(r"&(?=[A-Za-z][A-Za-z0-9_.-]{0,40}=)")
_PEM = re.compile(r"-----BEGIN [A-Z ]*PRIVATE KEY-----.*?(?:-----END [A-Z ]*PRIVATE KEY-----|\Z)", re.S)
_ISSUED = re.compile(r"(?:AKIA|ASIA)[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36,}|xox[abprs]-[A-Za-z0-9-]{10,}|sk_(?:live|test)_[A-Za-z0-9]{16,}|AIza[0-9A-Za-z_-]{35}|-----BEGIN .*", re.S)
_SECRET_NAME = re.compile(r"passw|pwd|secret|token|api[_.-]?key|access[_.-]?key|auth|credential|private", re.I)
_UUID = re.compile(r"[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}")
_SUM_WORDS = frozenset("commit sha sha1 sha256 md5 checksum digest rev revision hash etag version isbn build order invoice uuid guid phone tel card".split())
_KEY_WORDS = frozenset("password passwd pwd secret token key apikey api auth bearer credential credentials login access private aws".split())
_WORD = re.compile(r"[^\W\d_]+")
#: Character classes whose transitions are counted: letters singly, digits and the rest as one each.
_CLASSES = {c: i for i, c in enumerate("abcdefghijklmnopqrstuvwxyz")}
FEATURES = 22


def candidates(text: str) -> list[tuple[int, int, str]]:
    """(start, end, assigned name) of each candidate; assigned values come first.

    Candidates do not overlap, but that values assigned to secret names also stand within longer values.
    """
    out = [(m.start(), m.end(), "pem") for m in _PEM.finditer(text)] if "-----BEGIN" in text else []
    taken = list(out)
    inner, outer, done = [], 0, 0  # where the last assigned value and the last one within it end
    for m in _ASSIGN.finditer(text):
        # a sign that ends the value before can assign what follows it
        if m.end() < outer and not (m.end() + 1 == outer and text[m.end()] in "=:"):
            name = _NAME.search(text, max(done, m.start() - 48), m.start()) if m.start() >= done else None
            if name and _SECRET_NAME.search(name.group(1)) and (value := _VALUE.match(text, m.end(), outer)):
                following = _FOLLOWING.search(text, value.start(1), value.end(1))
                done = following.start() if following else value.end(1)
                if done - value.start(1) >= 8:
                    inner.append((value.start(1), done, name.group(1)))
            continue
        name = _NAME.search(text, max(0, m.start() - 48), m.start())
        value = _VALUE.match(text, m.end()) if name else None
        if value and not any(s < value.end(1) and value.start(1) < e for s, e, _ in taken[-2:]):
            token = value.group(1)
            # words assigned to other names are prose
            if _SECRET_NAME.search(name.group(1)) or any(c.isdigit() for c in token):
                taken.append((value.start(1), value.end(1), name.group(1)))
                outer, done = value.end(1), value.start(1)
    spans = sorted(taken)
    starts = [s for s, _, _ in spans]
    last = 0
    for m in _SEED.finditer(text):
        if m.start() < last:
            continue
        s, e = m.span()
        while s > last and text[s - 1] in _TOKEN:
            s -= 1
        while e < len(text) and text[e] in _TOKEN:
            e += 1
        last = e
        if e - s >= 12:
            k = int(np.searchsorted(starts, e)) if starts else 0
            if not any(a < e and s < b for a, b, _ in spans[max(0, k - 2) : k + 1]):
                out.append((s, e, ""))
    return sorted(set(out + taken + inner))


def entropy(s: str) -> float:
    n = len(s)
    return -sum(c / n * math.log2(c / n) for c in Counter(s).values())


class Corpus:
    """Frequent words and log probabilities of letter transitions."""

    def __init__(self, words: set[str], pairs: np.ndarray):
        self.words = words
        self.pairs = np.log((pairs + 1) / (pairs + 1).sum(axis=1, keepdims=True))

    def covered(self, s: str) -> float:
        """Share of the characters that dictionary words of four or more letters cover, longest first."""
        s, i, n = s.lower(), 0, 0
        while i < len(s):
            for j in range(min(len(s), i + 12), i + 3, -1):
                if s[i:j] in self.words:
                    n, i = n + j - i, j
                    break
            else:
                i += 1
        return n / max(1, len(s))

    def likely(self, s: str) -> float:
        """Mean log probability of the transitions between letters, digits and other characters."""
        kinds = [_CLASSES.get(c, 26 if c.isdigit() else 27) for c in s.lower()]
        return float(np.mean([self.pairs[a, b] for a, b in zip(kinds, kinds[1:])])) if len(kinds) > 1 else 0.0


def features(text: str, start: int, end: int, name: str, corpus: Corpus) -> list[float]:
    s = text[start:end]
    n = len(s)
    kinds = ["d" if c.isdigit() else "u" if c.isupper() else "l" if c.islower() else "o" for c in s]
    before = [w.lower() for w in _WORD.findall(text[max(0, start - 60) : start])][-3:]
    after = [w.lower() for w in _WORD.findall(text[end : end + 40])][:2]
    left, right = text[max(0, start - 1) : start], text[end : end + 1]
    return [
        min(n, 200),
        entropy(s),
        *(kinds.count(k) / len(kinds) for k in "dulo"),
        sum(a != b for a, b in zip(kinds, kinds[1:])) / len(kinds),
        corpus.likely(s),
        corpus.covered(s),
        len(set(s)) / n,
        float(all(c in "0123456789abcdefABCDEF" for c in s)),
        float("/" in s or left in ("/", "\\")),
        float("://" in text[max(0, start - 80) : start].rpartition(" ")[2] or "://" in s),
        float(left in ("'", '"')),
        float(right in ("'", '"')),
        float(left in ("=", ":")),
        float(bool(name)),
        float(bool(_SECRET_NAME.search(name))),
        float(any(w in _KEY_WORDS for w in before)),
        float(any(w in _SUM_WORDS for w in before)),
        float(any(w in corpus.words for w in before)),
        float(any(w in corpus.words for w in after)),
    ]


def rule(text: str, start: int, end: int, name: str, corpus: Corpus) -> int | None:
    """1 or 0 where a format leaves no doubt."""
    s = text[start:end]
    if _ISSUED.fullmatch(s):
        return 1
    before = [w.lower() for w in _WORD.findall(text[max(0, start - 60) : start])][-3:]
    mixed = any(c.isdigit() for c in s) and any(c.isalpha() for c in s)
    if name and _SECRET_NAME.search(name):
        return 1 if mixed and len(s) >= 12 and entropy(s) >= 2.8 else None
    if not any(c.isalpha() for c in s) or _UUID.fullmatch(s) or any(w in _SUM_WORDS for w in before):
        return 0
    return 0 if corpus.covered(s) >= 0.7 else None


# ------------------------------------------------------------------ corpus statistics


def corpus_of(docs: DataFrame, size: int = DICTIONARY) -> Corpus:
    """Letter transitions of all documents and their most frequent words of 4 to 12 letters.

    Tasks pass on every word with its count (sums so far when their table is full); those that all documents
    together have less than three times are no dictionary words.
    """
    rows = documents(docs)
    schema = rows.sparkSession.createDataFrame([], "word string, a int, b int, n long").schema

    def sums(words: Counter) -> Iterator[pa.RecordBatch]:
        n = len(words)
        yield from in_batches(schema, {"word": list(words), "a": [None] * n, "b": [None] * n, "n": list(words.values())})

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes = np.full(256, 27, np.uint8)
        for c, i in _CLASSES.items():
            classes[ord(c)] = classes[ord(c.upper())] = i
        classes[48:58] = 26
        pairs, words = np.zeros(28 * 28, np.int64), Counter()
        for part in groups(batches, 1 << 19):
            # every text between line ends, however the texts are grouped
            text = "\n".join(["", *part.column("text").to_pylist(), ""])
            k = classes[np.frombuffer(text.encode("utf-8", "replace"), np.uint8)].astype(np.int64)
            pairs += np.bincount(k[:-1] * 28 + k[1:], minlength=28 * 28)
            words.update(w for w in text.lower().split() if 3 < len(w) < 13 and w.isalpha())
            if len(words) > TABLE:
                yield from sums(words)
                words = Counter()
        yield from sums(words)
        at = np.flatnonzero(pairs)
        yield batch_of(schema, {"word": [None] * len(at), "a": at // 28, "b": at % 28, "n": pairs[at]})
        del words
        release()

    counted = written(rows.mapInArrow(count, schema).groupBy("word", "a", "b").agg(F.sum("n").alias("n")), "words")
    top = counted.where("word IS NOT NULL AND n > 2").orderBy(F.desc("n"), "word").limit(size).collect()
    pairs = np.zeros((28, 28))
    for r in counted.where("word IS NULL").collect():
        pairs[r.a, r.b] = r.n
    return Corpus({r.word for r in top}, pairs)


# ------------------------------------------------------------------ the forest


class Forest:
    """Trees as arrays; ``None`` instead of a forest leaves the decision to the rules."""

    def __init__(self, trees: list[list[tuple]]):
        self.trees = trees

    def score(self, x: list[float]) -> float:
        total = 0.0
        for nodes in self.trees:
            feature, threshold, left, right, value = nodes[0]
            while feature >= 0:
                feature, threshold, left, right, value = nodes[left if x[feature] <= threshold else right]
            total += value
        return total / len(self.trees)


def _nodes(root) -> list[tuple]:
    """(feature, threshold, left, right, share of secrets) of each node of a fitted tree."""
    out: list = []

    def walk(node) -> int:
        at = len(out)
        out.append(None)
        if node.getClass().getSimpleName() == "InternalNode":
            split = node.split()
            out[at] = (split.featureIndex(), split.threshold(), walk(node.leftChild()), walk(node.rightChild()), 0.0)
        else:
            stats = node.impurityStats().stats()
            n = list(stats)
            out[at] = (-1, 0.0, 0, 0, n[1] / max(sum(n), 1e-9))
        return at

    walk(root)
    return out


def fit_forest(findings: DataFrame, sample: int = SAMPLE, trees: int = TREES, depth: int = DEPTH) -> Forest | None:
    """A forest from findings (secret, x), or None if only one class is there."""
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.functions import array_to_vector

    order = [F.xxhash64("doc_id", "start", "end"), "doc_id", "start", "end", "x"]
    taken = findings.orderBy(*order).limit(sample)
    data = taken.select(F.col("secret").cast("double").alias("label"), array_to_vector("x").alias("features"))
    data = written(data, "findings")
    classes = {r.label for r in data.select("label").distinct().collect()}
    if classes != {0.0, 1.0}:
        return None
    model = RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=11, maxBins=64).fit(data)
    return Forest([_nodes(t._call_java("rootNode")) for t in model.trees])


def train(docs: DataFrame, findings: DataFrame | None = None, sample: int = SAMPLE) -> tuple[Corpus, Forest | None]:
    """Corpus statistics and the forest, from given findings or those that the rules label."""
    corpus = corpus_of(docs)
    rows = documents(docs)
    schema = rows.sparkSession.createDataFrame([], "doc_id long, start int, end int, secret int, x array<double>").schema
    given = findings is not None
    if given:
        marked = findings.where("doc_id IS NOT NULL AND secret IS NOT NULL").groupBy("doc_id").agg(F.collect_set(F.struct("start", "end", "secret")).alias("marked"))
        rows = rows.join(marked, "doc_id").select("doc_id", "text", "marked")

    def labelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            known = [{(m["start"], m["end"]): m["secret"] for m in ms} for ms in batch.column(2).to_pylist()] if given else [None] * batch.num_rows
            for doc, text, marks in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), known):
                for s, e, name in candidates(text):
                    y = marks.get((s, e)) if given else rule(text, s, e, name, corpus)
                    if y is not None:
                        out.append((doc, s, e, int(y), features(text, s, e, name, corpus)))
            if out:
                yield batch_of(schema, dict(zip(schema.names, zip(*out))))
        release()

    return corpus, fit_forest(written(rows.mapInArrow(labelled, schema), "labelled"), sample)


def decide(text: str, corpus: Corpus, forest: Forest | None) -> list[tuple[int, int, float]]:
    """(start, end, score) of every candidate."""
    out = []
    for s, e, name in candidates(text):
        if forest is None:
            score = float(rule(text, s, e, name, corpus) or 0)
        else:
            score = forest.score(features(text, s, e, name, corpus))
        out.append((s, e, score))
    return out


def masked(text: str, spans: list[tuple[int, int]]) -> str:
    parts, at = [], 0
    for s, e in spans:
        if s < at:
            continue
        parts += [text[at:s], MASK]
        at = e
    return "".join(parts) + text[at:]


def find(docs: DataFrame, findings: DataFrame | None = None, threshold: float = 0.5, sample: int = SAMPLE) -> DataFrame:
    """doc_id, n_candidates, secrets (array of start, end, score) and the masked text of every row."""
    corpus, forest = train(docs, findings, sample)
    return _map(docs, corpus, forest, threshold, "doc_id long, n_candidates long, secrets array<struct<start:int,end:int,score:double>>, masked string", _plain)


def digests(docs: DataFrame, findings: DataFrame | None = None, threshold: float = 0.5, sample: int = SAMPLE) -> DataFrame:
    """doc_id, n_candidates, n_secrets, spans (start:end joined by commas), masked_sha256 of every row."""
    corpus, forest = train(docs, findings, sample)
    return _map(docs, corpus, forest, threshold, "doc_id long, n_candidates long, n_secrets long, spans string, masked_sha256 string", _digest)


def _plain(doc, text, found, kept) -> dict:
    return {"doc_id": doc, "n_candidates": len(found), "secrets": [dict(zip(("start", "end", "score"), c)) for c in kept], "masked": masked(text, [c[:2] for c in kept])}


def _digest(doc, text, found, kept) -> dict:
    sha = hashlib.sha256(masked(text, [c[:2] for c in kept]).encode("utf-8", "replace")).hexdigest()
    return {"doc_id": doc, "n_candidates": len(found), "n_secrets": len(kept), "spans": ",".join(f"{s}:{e}" for s, e, _ in kept), "masked_sha256": sha}


def _map(docs, corpus, forest, threshold, ddl, make) -> DataFrame:
    rows = documents(docs)
    schema = rows.sparkSession.createDataFrame([], ddl).schema

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in groups(batches, 1 << 22):
            out = []
            for doc, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist()):
                found = decide(text, corpus, forest)
                out.append(make(doc, text, found, [c for c in found if c[2] >= threshold]))
            yield batch_of(schema, {n: [r[n] for r in out] for n in schema.names})

    return rows.mapInArrow(apply, schema)


def without_secrets(docs: DataFrame, findings: DataFrame | None = None, threshold: float = 0.5) -> DataFrame:
    """``docs`` with all columns and every secret masked."""
    corpus, forest = train(docs, findings)

    def change(texts: list[str], _) -> list[str]:
        return [masked(t, [c[:2] for c in decide(t, corpus, forest) if c[2] >= threshold]) for t in texts]

    return rewritten(docs, change)
