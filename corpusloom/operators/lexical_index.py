"""A stored BM25 index: written once per release, asked by many batches.

Passages are taken in input order into shards.  A block holds the postings of one term in one shard, with
its largest term frequency and smallest passage length, which bound the gain of the term anywhere in the
shard.  Blocks are stored in buckets of terms, so a batch reads the buckets of its own terms; the sum of a
query's block bounds says how much a shard can score at most, and shards that cannot reach the k-th score
are not read.  All postings of a passage are in its shard, so scores are complete.

Layout below ``folder/release_id=...``: ``blocks`` (bucket=...), ``shards``, ``lexicon``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions.text import TOKEN_PATTERN, WHITESPACE_CHARS, text_or_empty
from corpusloom.operators.blocks import best_rows
from corpusloom.operators.lexical import Okapi, corpus_stats, inverse_frequencies
from corpusloom.operators.pruning import pruned_rows, pruned_share
from corpusloom.operators.ranking import SCORE_DIGITS, topk
from corpusloom.session import materialized

SHARD_PASSAGES = 2048
BUCKETS = 64
GAIN_CELLS = 1_000_000  # cells of one matrix of gains
_BLOCKS = "shard long, term string, n int, max_tf int, min_dl int, places array<int>, tfs array<int>, bucket int"


@dataclass(frozen=True)
class LexicalIndex:
    """Tables of one release."""

    blocks: DataFrame
    shards: DataFrame
    lexicon: DataFrame


def _bucket(term: str, buckets: Column) -> Column:
    return F.pmod(F.xxhash64(term), buckets).cast("int")


def _home(folder: str, release: str) -> str:
    return f"{folder.rstrip('/')}/release_id={release}"


def write_lexical_index(tokenized: DataFrame, folder: str, release: str, shard_passages: int = SHARD_PASSAGES, buckets: int = BUCKETS) -> LexicalIndex:
    """Store the index of ``tokenized`` (child_id, tokens, dl) as one release; replaces that release only.

    The passages are read once.  Passages that follow one another share a shard, so documents and
    corpora stay together.
    """
    rows = tokenized.select("child_id", "tokens", F.col("dl").cast("int").alias("dl"))
    return _write(rows, _sharder(shard_passages), folder, release, buckets)


def write_text_index(passages: DataFrame, folder: str, release: str, text: str = "search_text", shard_passages: int = SHARD_PASSAGES, buckets: int = BUCKETS) -> LexicalIndex:
    """As ``write_lexical_index`` of the ``retrieval_tokens`` of a text column of ``passages``.

    Tokens are numbered from the code points of a shard's texts and never become rows or arrays of text.
    """
    rows = passages.select("child_id", F.lower(text_or_empty(F.col(text))).alias("low"))
    return _write(rows, _sharder(shard_passages), folder, release, buckets)


def _write(rows: DataFrame, sharder, folder: str, release: str, buckets: int) -> LexicalIndex:
    spark, home = rows.sparkSession, _home(folder, release)
    id_type = dict(rows.dtypes)["child_id"]
    ddl = f"shard long, term string, n int, max_tf int, min_dl int, places array<int>, tfs array<int>, child_ids array<{id_type}>, dls array<int>"
    # one map-only job decides the shards; both tables come from what it wrote
    staged = materialized(rows.mapInArrow(sharder, ddl))
    blocks = staged.filter("term is not null").select("shard", "term", "n", "max_tf", "min_dl", "places", "tfs", _bucket("term", F.lit(buckets)).alias("bucket"))
    placed = blocks.repartition(buckets, "bucket").sortWithinPartitions("bucket", "term", "shard")
    placed.write.mode("overwrite").partitionBy("bucket").parquet(f"{home}/blocks")
    staged.filter("term is null").select("shard", "child_ids", "dls").write.mode("overwrite").parquet(f"{home}/shards")
    stored = spark.read.schema(_BLOCKS).parquet(f"{home}/blocks")
    counts = stored.groupBy("term").agg(F.sum("n").alias("df")).select("term", "df", F.lit(None).cast("long").alias("total_length"), F.lit(buckets).alias("buckets"))
    sizes = spark.read.parquet(f"{home}/shards").agg(F.sum(F.size("child_ids")).alias("df"), F.sum(F.aggregate("dls", F.lit(0).cast("long"), lambda a, x: a + x)).alias("total_length"))
    total = sizes.filter("df > 0").select(F.lit(None).cast("string").alias("term"), "df", "total_length", F.lit(buckets).alias("buckets"))
    counts.unionByName(total).write.mode("overwrite").parquet(f"{home}/lexicon")
    return read_lexical_index(spark, folder, release)


def read_lexical_index(spark: SparkSession, folder: str, release: str) -> LexicalIndex:
    home = _home(folder, release)
    return LexicalIndex(spark.read.schema(_BLOCKS).parquet(f"{home}/blocks"), spark.read.parquet(f"{home}/shards"), spark.read.parquet(f"{home}/lexicon"))


def indexed_topk(index: LexicalIndex, terms: DataFrame, k: int, okapi: Okapi = Okapi()) -> DataFrame:
    """(query_id, child_id, score, rank): as ``bm25_topk``, from the stored index."""
    return topk(pruned_rows(*_search(index, terms, k, okapi)), k)


def read_share(index: LexicalIndex, terms: DataFrame, k: int, okapi: Okapi = Okapi()) -> DataFrame:
    """One row: (query, shard) pairs that share a term, and how many of them are read."""
    return pruned_share(*_search(index, terms, k, okapi))


def _search(index: LexicalIndex, terms: DataFrame, k: int, okapi: Okapi):
    avgdl = corpus_stats(index.lexicon).select("avgdl").scalar()
    buckets = index.lexicon.filter("term is null").select("buckets").scalar()
    weights = terms.join(inverse_frequencies(index.lexicon, okapi).select("term", "idf"), "term")
    batch = materialized(weights.select("query_id", "term", (F.col("qtf") * F.col("idf")).alias("w"), avgdl.alias("avgdl"), _bucket("term", buckets).alias("bucket")))

    def gain(tf: Column, dl: Column, mean: Column) -> Column:
        return tf * (okapi.k1 + 1) / (tf + okapi.k1 * (1 - okapi.b + okapi.b * dl / mean))

    # the bucket prunes partitions
    heads = index.blocks.select("bucket", "term", "shard", "max_tf", "min_dl")
    top_gain = F.greatest("w", F.lit(0.0)) * gain(F.col("max_tf"), F.col("min_dl"), F.col("avgdl"))
    bounds = batch.join(heads, ["bucket", "term"]).groupBy("query_id", F.col("shard").alias("block")).agg(F.sum(top_gain).alias("bound"))
    packed = batch.groupBy("query_id").agg(F.collect_list(F.struct("term", "w")).alias("terms"), F.first("avgdl").alias("avgdl"))
    id_type = index.shards.schema["child_ids"].dataType.elementType.simpleString()
    ddl = f"query_id {dict(terms.dtypes)['query_id']}, child_id {id_type}, score double"

    words = batch.select("bucket", "term").distinct()
    id_list = index.shards.schema["child_ids"].dataType
    none = F.lit(None).cast("array<int>")

    def evaluate(pairs: DataFrame) -> DataFrame:
        pairs = pairs.withColumnRenamed("block", "shard")
        needed = pairs.select("shard").distinct()
        rows = index.blocks.join(words, ["bucket", "term"], "left_semi").join(needed, "shard", "left_semi")
        rows = rows.select("shard", "term", "places", "tfs", F.lit(None).cast(id_list).alias("child_ids"), none.alias("dls"))
        heads = index.shards.join(needed, "shard", "left_semi")
        heads = heads.select("shard", F.lit(None).cast("string").alias("term"), none.alias("places"), none.alias("tfs"), "child_ids", "dls")
        asked = pairs.join(packed, "query_id")
        return rows.unionByName(heads).groupBy("shard").cogroup(asked.groupBy("shard")).applyInArrow(_scorer(k, okapi, ddl, terms.sparkSession), ddl)

    return bounds, evaluate, k


def _lists(values: np.ndarray, starts: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.append(starts, len(values)), pa.int32()), pa.array(values, kind))


def _coded_tokens(rows: pa.Table) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(terms, number of each token's term, its passage)."""
    tokens = rows.column("tokens").combine_chunks()
    coded = tokens.flatten().dictionary_encode()
    owner = np.repeat(np.arange(rows.num_rows), np.asarray(pc.fill_null(pc.list_value_length(tokens), 0)))
    return coded.dictionary.cast(pa.string()), np.asarray(coded.indices).astype(np.int64), owner


_WORD = re.compile(TOKEN_PATTERN)
_POINT = 1 << 21  # more than the largest code point


def _coded_text(rows: pa.Table) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """As ``_coded_tokens`` for the lower-cased texts: words by their pattern, pairs from code points."""
    texts = rows.column("low").to_pylist()
    sizes = np.array([len(t) for t in texts])
    points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    owner = np.repeat(np.arange(len(texts)), sizes)
    pairs, own = points[:-1] * _POINT + points[1:], owner[:-1]
    space = np.isin(points, [ord(c) for c in WHITESPACE_CHARS])
    kept = (own == owner[1:]) & ~(space[:-1] & space[1:])
    seen, pair_code = np.unique(pairs[kept], return_inverse=True)
    names = np.stack(np.divmod(seen, _POINT), axis=1).astype("<u4").tobytes().decode("utf-32-le", "surrogatepass")
    words: dict[str, int] = {}
    found = [[words.setdefault(w, len(words)) for w in _WORD.findall(t)] for t in texts]
    # a word of two characters is the term of a pair
    terms = pa.array([names[i : i + 2] for i in range(0, len(names), 2)] + list(words), pa.string()).dictionary_encode()
    merged = np.asarray(terms.indices).astype(np.int64)
    word_code = np.array([c for f in found for c in f], np.int64) + len(seen)
    code = merged[np.concatenate([pair_code, word_code])]
    return terms.dictionary, code, np.concatenate([own[kept], np.repeat(np.arange(len(texts)), [len(f) for f in found])])


def _sharder(size: int):
    def shard(rows: pa.Table, number: int) -> Iterator[pa.RecordBatch]:
        rows = rows.take(pc.sort_indices(rows.column("child_id"))).combine_chunks()
        ids = rows.column("child_id").combine_chunks()
        names, token, owner = (_coded_text if "low" in rows.schema.names else _coded_tokens)(rows)
        dl = np.asarray(rows.column("dl")) if "dl" in rows.schema.names else np.bincount(owner, minlength=len(ids))
        cells, tf = np.unique(token * len(ids) + owner, return_counts=True)
        code, place = np.divmod(cells, len(ids))
        starts = np.flatnonzero(np.append(True, code[1:] != code[:-1])) if len(code) else np.array([], np.int64)
        n = len(starts)
        kind = pa.list_(ids.type)
        if n:
            yield pa.RecordBatch.from_pydict(
                {
                    "shard": pa.array(np.full(n, number), pa.int64()),
                    "term": names.take(pa.array(code[starts])),
                    "n": pa.array(np.diff(np.append(starts, len(code))), pa.int32()),
                    "max_tf": pa.array(np.maximum.reduceat(tf, starts), pa.int32()),
                    "min_dl": pa.array(np.minimum.reduceat(dl[place], starts), pa.int32()),
                    "places": _lists(place, starts, pa.int32()),
                    "tfs": _lists(tf, starts, pa.int32()),
                    "child_ids": pa.nulls(n, kind),
                    "dls": pa.nulls(n, pa.list_(pa.int32())),
                }
            )
        alone = {name: pa.nulls(1, t) for name, t in (("term", pa.string()), ("n", pa.int32()), ("max_tf", pa.int32()), ("min_dl", pa.int32()), ("places", pa.list_(pa.int32())), ("tfs", pa.list_(pa.int32())))}
        one = np.array([0])
        yield pa.RecordBatch.from_pydict({"shard": pa.array([number], pa.int64()), **alone, "child_ids": pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids), "dls": _lists(dl, one, pa.int32())})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        held, number = None, TaskContext.get().partitionId() << 32
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            held = rows if held is None else pa.concat_tables([held, rows])
            while held.num_rows >= size:
                yield from shard(held.slice(0, size), number)
                held, number = held.slice(size), number + 1
        if held is not None and held.num_rows:
            yield from shard(held, number)

    return run


def _scorer(k: int, okapi: Okapi, ddl: str, spark: SparkSession):
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = to_arrow_schema(spark.createDataFrame([], ddl).schema)

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return schema.empty_table()
        head = left.filter(pc.is_null(left.column("term")))
        ids = head.column("child_ids").combine_chunks().flatten()
        dl = np.asarray(head.column("dls").combine_chunks().flatten(), dtype=np.float64)
        blocks = left.filter(pc.is_valid(left.column("term"))).combine_chunks()
        if not blocks.num_rows:
            return schema.empty_table()
        lists = blocks.column("places").combine_chunks()
        place = np.asarray(lists.flatten())
        tf = np.asarray(blocks.column("tfs").combine_chunks().flatten(), dtype=np.float64)
        sizes = np.asarray(pc.list_value_length(lists)).astype(np.int64)
        mean = right.column("avgdl")[0].as_py()
        gain = tf * (okapi.k1 + 1) / (tf + okapi.k1 * (1 - okapi.b + okapi.b * dl[place] / mean))
        asked = right.column("terms").combine_chunks()
        words = asked.flatten()
        # terms in one order for all shards, so that equal passages get equal sums
        vocabulary = pc.unique(words.field("term"))
        vocabulary = vocabulary.take(pc.sort_indices(vocabulary))
        weights = np.zeros((right.num_rows, len(vocabulary)))
        asks = np.repeat(np.arange(right.num_rows), np.asarray(pc.list_value_length(asked)))
        weights[asks, np.asarray(pc.index_in(words.field("term"), value_set=vocabulary))] = np.asarray(words.field("w"))
        wanted = np.zeros(weights.shape, bool)
        wanted[asks, np.asarray(pc.index_in(words.field("term"), value_set=vocabulary))] = True
        code = np.asarray(pc.fill_null(pc.index_in(blocks.column("term").combine_chunks(), value_set=vocabulary), -1)).astype(np.int64)
        code = np.repeat(code, sizes)
        total = np.zeros((right.num_rows, len(ids)))
        # a term of weight 0 still makes a match
        signed = bool((weights[wanted] <= 0).any())
        matches = np.zeros(total.shape) if signed else total
        step = max(1, GAIN_CELLS // max(len(ids), 1))
        order = np.argsort(code, kind="stable")
        for first in range(0, len(vocabulary), step):
            some = order[slice(*np.searchsorted(code[order], (first, first + step)))]
            if not len(some):
                continue
            gains = np.zeros((min(step, len(vocabulary) - first), len(ids)))
            gains[code[some] - first, place[some]] = gain[some]
            total += weights[:, first : first + step] @ gains
            if signed:
                matches += wanted[:, first : first + step] @ (gains > 0).astype(np.float64)
        queries, rows, scores = [], [], []
        for q in range(right.num_rows):
            row, _ = best_rows(total[q][:, None], matches[q][:, None] > 0, k)
            queries.append(np.full(len(row), q))
            rows.append(row)
            scores.append(total[q, row])
        if not queries:
            return schema.empty_table()
        columns = [right.column("query_id").take(pa.array(np.concatenate(queries))), ids.take(pa.array(np.concatenate(rows))), pa.array(np.round(np.concatenate(scores), SCORE_DIGITS))]
        return pa.Table.from_arrays([c.combine_chunks().cast(f.type) if isinstance(c, pa.ChunkedArray) else c.cast(f.type) for c, f in zip(columns, schema)], schema=schema)

    return score
