"""Toxicity by a linear classifier on character n-grams scaled by naive Bayes log-count ratios.

Features are the 4- and 5-grams of the bytes of the lower-cased text, present or not, hashed into
2^21 buckets.  A bucket's value is the log ratio of its smoothed document frequencies in toxic and other
documents; a logistic regression learns a weight for each of these values.

Fitting uses at most ``sample`` labelled documents (those with the smallest hashes of their doc_id) and
the ``buckets`` features whose frequencies differ most between the classes (likelihood ratio).  Scoring
is one pass over whole texts.

Labels may hold nulls (left out) and repeated doc_ids (toxic if any row says so).  Null and empty texts
are scored by the intercept alone.  Without labels, or with labels of one class, all scores are the
smoothed share of toxic labels.  Rows may repeat; each gets its own result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import batch_of, documents, groups, release, rewritten

BITS = 21
NGRAMS = ((4, 0x9E3779B97F4A7C15), (5, 0xC2B2AE3D27D4EB4F))
SAMPLE = 20_000
BUCKETS = 8_000
LEAST_DOCS = 5
LEAST_RATIO = 10.0
FOLDS = 5
#: Bytes of text whose n-grams are held at a time; a longer text is held alone.
HELD = 1 << 18


def held_out(doc_id: str = "doc_id"):
    """Documents that are never learned from."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % FOLDS == 0, F.lit(False))


def hashed(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each n: buckets of all n-grams of the texts, and the number of the text of each."""
    data = [f" {t.lower()} ".encode("utf-8", "replace") for t in texts]
    ends = np.cumsum([len(d) for d in data])
    x = np.frombuffer(b"".join(data), np.uint8).astype(np.uint32)
    if len(x) < 8:
        x = np.concatenate([x, np.zeros(8, np.uint32)])
    two = x[:-1] | x[1:] << np.uint32(8)
    four = two[:-2] | two[2:] << np.uint32(16)
    for n, odd in NGRAMS:
        gram = four.astype(np.uint64)
        if n == 5:
            gram = gram[:-1] | x[4:].astype(np.uint64) << np.uint64(32)
        yield (gram * np.uint64(odd)) >> np.uint64(64 - BITS), n, ends


def present(texts: list[str], table: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """(text number, bucket), each once, of the buckets that ``table`` marks (all without a table)."""
    docs, found = [], []
    for buckets, n, ends in hashed(texts):
        at = np.arange(len(buckets)) if table is None else np.flatnonzero(table[buckets])
        doc = np.searchsorted(ends, at, side="right")
        inside = doc < len(texts)
        at, doc = at[inside], doc[inside]
        # n-grams do not reach into the next text
        inside = at + n <= ends[doc]
        docs.append(doc[inside])
        found.append(buckets[at[inside]])
    keys = np.unique(np.concatenate(docs).astype(np.uint64) << np.uint64(BITS) | np.concatenate(found))
    return (keys >> np.uint64(BITS)).astype(np.int64), (keys & np.uint64((1 << BITS) - 1)).astype(np.int64)


class Model:
    """Weights by bucket and the intercept."""

    def __init__(self, buckets: np.ndarray, weights: np.ndarray, intercept: float):
        self.buckets, self.weights, self.intercept = buckets, weights, intercept

    def table(self) -> np.ndarray:
        out = np.zeros(1 << BITS, np.float32)
        out[self.buckets] = self.weights
        return out

    def scores(self, texts: list[str], table: np.ndarray) -> np.ndarray:
        z = np.full(len(texts), float(self.intercept))
        ends = np.cumsum([len(t) for t in texts])
        at = 0
        while at < len(texts):
            stop = int(np.searchsorted(ends, (ends[at - 1] if at else 0) + HELD, side="right"))
            stop = max(stop, at + 1)
            doc, bucket = present(texts[at:stop], table)
            z[at:stop] += np.bincount(doc, weights=table[bucket], minlength=stop - at)
            at = stop
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, buckets: int = BUCKETS) -> Model:
    """A model from the labelled documents that are not held out."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out())
    known = known.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    # the bound makes this small enough to send everywhere
    taken = F.broadcast(known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample))
    rows = documents(docs).join(taken, "doc_id").select("toxic", "text")
    sizes = {r.toxic: r["count"] for r in rows.groupBy("toxic").count().collect()}
    toxic, other = sizes.get(1, 0), sizes.get(0, 0)
    empty = Model(np.array([], np.int64), np.array([]), float(np.log((toxic + 0.5) / (other + 1))))
    if not toxic or not other:
        return empty
    counts = rows.sparkSession.createDataFrame([], "bucket long, toxic long, other long").schema

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros((2, 1 << BITS), np.int32)
        for part in groups(batches, HELD):
            label = part.column("toxic").to_numpy()
            doc, bucket = present(part.column("text").to_pylist(), None)
            for c in (0, 1):
                np.add.at(seen[c], bucket[label[doc] == c], 1)
        some = np.flatnonzero(seen.any(axis=0))
        for i in range(0, len(some), 50_000):
            b = some[i : i + 50_000]
            yield batch_of(counts, {"bucket": b, "toxic": seen[1][b], "other": seen[0][b]})
        del seen
        release()

    both = rows.mapInArrow(count, counts).groupBy("bucket").agg(F.sum("toxic").alias("p"), F.sum("other").alias("q"))
    share, all_ = toxic / (toxic + other), toxic + other

    def part_of(n, expected):
        return F.when(n > 0, n * F.log(n / expected)).otherwise(0.0)

    df = F.col("p") + F.col("q")
    ratio = 2 * (part_of(F.col("p"), df * share) + part_of(F.col("q"), df * (1 - share)))
    ratio += 2 * (part_of(toxic - F.col("p"), (all_ - df) * share) + part_of(other - F.col("q"), (all_ - df) * (1 - share)))
    best = both.where(df >= LEAST_DOCS).withColumn("g", ratio).where(F.col("g") >= LEAST_RATIO)
    best = best.orderBy(F.desc("g"), "bucket").limit(buckets).select("bucket", "p", "q").collect()
    if not best:
        return empty
    chosen = np.array([r.bucket for r in best])
    values = np.log((np.array([r.p for r in best]) + 1) / (toxic + 2)) - np.log((np.array([r.q for r in best]) + 1) / (other + 2))
    weights, intercept = _regression(rows, chosen, values, float(np.log(toxic / other)))
    return Model(chosen, weights, intercept)


def _regression(rows: DataFrame, chosen: np.ndarray, values: np.ndarray, intercept: float) -> tuple[np.ndarray, float]:
    """Weights of the chosen buckets in the score, from the bounded sample."""
    schema = rows.sparkSession.createDataFrame([], "toxic int, found binary").schema

    def sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = np.zeros(1 << BITS, np.int32)
        place[chosen] = np.arange(1, len(chosen) + 1)
        for part in groups(batches, HELD):
            doc, bucket = present(part.column("text").to_pylist(), place)
            cuts = np.searchsorted(doc, np.arange(1, part.num_rows))
            found = [c.tobytes() for c in np.split(place[bucket] - 1, cuts)]
            yield batch_of(schema, {"toxic": part.column("toxic").to_pylist(), "found": found})
        release()

    fetched = rows.mapInArrow(sparse, schema).collect()
    y = np.array([r.toxic for r in fetched], float)
    lists = [np.frombuffer(r.found, np.int32) for r in fetched]
    column = np.concatenate(lists)
    row = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
    w, b = logistic(row, column, values, y, intercept)
    return w * values, b


def logistic(row, column, values, y, intercept, rounds: int = 100, ridge: float = 1e-4) -> tuple[np.ndarray, float]:
    """Logistic regression on present features times ``values``, by Adam on all rows."""
    n, w, b = len(y), np.zeros(len(values)), intercept
    first, second = np.zeros(len(values) + 1), np.zeros(len(values) + 1)
    for t in range(1, rounds + 1):
        z = np.bincount(row, weights=(values * w)[column], minlength=n) + b
        error = (1 / (1 + np.exp(-np.clip(z, -500, 500))) - y) / n
        grad = np.append(values * np.bincount(column, weights=error[row], minlength=len(values)) + ridge * w, error.sum())
        first = 0.9 * first + 0.1 * grad
        second = 0.99 * second + 0.01 * grad * grad
        step = 0.05 / (1 + t / 50) * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.99**t)) + 1e-8)
        w, b = w - step[:-1], b - step[-1]
    return w, float(b)


def score(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, buckets: int = BUCKETS) -> DataFrame:
    """doc_id, held_out, score (0 to 1), predicted (1 from a score of 0.5) of every row."""
    marked = scored(docs, fit(docs, labels, sample, buckets))
    return marked.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, text (null becomes empty) and score of every row."""
    rows = documents(docs)
    schema = rows.sparkSession.createDataFrame([], "doc_id long, text string, score double").schema

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = model.table()
        for part in groups(batches, 1 << 20):
            texts = part.column("text").to_pylist()
            yield batch_of(schema, {"doc_id": part.column("doc_id").to_pylist(), "text": texts, "score": model.scores(texts, table)})

    return rows.mapInArrow(apply, schema)


def without_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs``, with all columns, that score below ``threshold``."""
    model = fit(docs, labels)
    tables: list[np.ndarray] = []

    def change(texts: list[str], _) -> list[str | None]:
        if not tables:
            tables.append(model.table())
        return [None if s >= threshold else t for t, s in zip(texts, model.scores(texts, tables[0]))]

    return rewritten(docs, change)
