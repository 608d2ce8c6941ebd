"""BM25 (Okapi) over child passages for batches of queries.

Term and passage counts come from one map-side-combined aggregation (the lexicon).
Scoring has two exact plans with the same result:

* the query batch is small enough (checked): its term matrix is broadcast and every
  task scores its own passages in blocks, so no posting is shuffled;
* otherwise postings restricted to query terms are joined on the term, with frequent
  terms salted, and summed per (query, passage).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions.text import retrieval_tokens
from corpusloom.operators.blocks import RunningTop, best_rows
from corpusloom.operators.ranking import SCORE_DIGITS, topk
from corpusloom.session import cut_lineage


@dataclass(frozen=True)
class Okapi:
    """Okapi constants; negative idf becomes ``epsilon`` times the mean idf."""

    k1: float = 1.5
    b: float = 0.75
    epsilon: float = 0.25


MAX_BROADCAST_CELLS = 32_000_000  # distinct query terms x queries: 256 MB of float64
SALTS = 16
BLOCK_CELLS = 8_000_000


def tokenize(children: DataFrame, child: str = "child_id", text: str = "search_text", tokenizer: Callable[[Column], Column] = retrieval_tokens) -> DataFrame:
    """(child_id, tokens, dl).  ``tokenizer`` is replaceable."""
    return children.select(F.col(child).alias("child_id"), tokenizer(F.col(text)).alias("tokens")).withColumn("dl", F.size("tokens"))


def postings(tokenized: DataFrame) -> DataFrame:
    """(child_id, dl, term, tf)."""
    return tokenized.select("child_id", "dl", F.explode("tokens").alias("term")).groupBy("child_id", "dl", "term").agg(F.count("*").alias("tf"))


def build_lexicon(tokenized: DataFrame) -> DataFrame:
    """(term, df, total_length) in one pass; the row without a term holds the number of
    passages and their summed length.

    Every passage adds each of its terms once.  Counts combine map-side, so a term found
    everywhere shuffles one row per task.
    """
    marked = F.concat(F.array_distinct("tokens"), F.array(F.lit(None).cast("string")))
    return tokenized.select("dl", F.explode(marked).alias("term")).groupBy("term").agg(F.count("*").alias("df"), F.sum("dl").alias("total_length"))


def corpus_stats(lexicon: DataFrame) -> DataFrame:
    """One row: number of passages and mean length."""
    return lexicon.filter("term is null").select(F.col("df").alias("n"), (F.col("total_length") / F.col("df")).alias("avgdl"))


def inverse_frequencies(lexicon: DataFrame, okapi: Okapi = Okapi()) -> DataFrame:
    """(term, df, idf)."""
    n = corpus_stats(lexicon).select("n").scalar()
    raw = lexicon.filter("term is not null").select("term", "df", (F.log(n - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)).alias("idf"))
    mean = raw.agg(F.avg("idf").alias("m")).select("m").scalar()
    return raw.withColumn("idf", F.when(F.col("idf") < 0, mean * okapi.epsilon).otherwise(F.col("idf")))


def query_terms(queries: DataFrame, query: str = "query_id", text: str = "question", tokenizer: Callable[[Column], Column] = retrieval_tokens) -> DataFrame:
    """(query_id, term, qtf): repeated query tokens count repeatedly."""
    words = queries.select(F.col(query).alias("query_id"), F.explode(tokenizer(F.col(text))).alias("term"))
    return words.groupBy("query_id", "term").agg(F.count("*").alias("qtf"))


def _block_scorer(terms: list[str], query_ids: pa.Array, weights: np.ndarray, asked: np.ndarray, avgdl: float, okapi: Okapi, k: int, schema: pa.Schema):
    vocabulary = pa.array(terms, pa.string())
    rows_per_block = max(64, BLOCK_CELLS // max(len(terms), 1))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        top = RunningTop(len(query_ids), k)
        for batch in batches:
            for start in range(0, batch.num_rows, rows_per_block):
                part = batch.slice(start, rows_per_block)
                part = part.take(pc.sort_indices(part.column("child_id")))
                tokens = part.column("tokens")
                owner = np.repeat(np.arange(part.num_rows), np.asarray(pc.list_value_length(tokens)))
                found = pc.index_in(tokens.flatten().cast(pa.string()), value_set=vocabulary)
                hit = np.asarray(pc.is_valid(found))
                cell = owner[hit] * len(terms) + np.asarray(found.drop_null(), dtype=np.int64)
                tf = np.bincount(cell, minlength=part.num_rows * len(terms)).reshape(part.num_rows, len(terms))
                length = np.asarray(part.column("dl"), dtype=np.float64)[:, None]
                gain = tf * (okapi.k1 + 1) / (tf + okapi.k1 * (1 - okapi.b + okapi.b * length / avgdl))
                scores = gain @ weights
                # a term of weight 0 still makes a match
                present = (np.minimum(tf, 1) @ asked) > 0
                row, query = best_rows(scores, present, k)
                top.add(part.column("child_id").take(pa.array(row)), query, scores[row, query])
        if top.ids is not None and len(top.ids):
            columns = [query_ids.take(pa.array(top.query)), top.ids, pa.array(np.round(top.score, SCORE_DIGITS))]
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, schema)], schema=schema)

    return score


def bm25_topk(
    tokenized: DataFrame, terms: DataFrame, k: int, okapi: Okapi = Okapi(), lexicon: DataFrame | None = None, max_cells: int = MAX_BROADCAST_CELLS
) -> DataFrame:
    """(query_id, child_id, score, rank): the k best passages of each query.

    Passages sharing no term with a query are not returned for it.  ``lexicon`` is a
    stored :func:`build_lexicon` table; without one it is built and checkpointed here, so
    that the passages are read twice (once to count, once to score) and no more.
    """
    lexicon = cut_lineage(build_lexicon(tokenized)) if lexicon is None else lexicon
    stats = corpus_stats(lexicon)
    batch = terms.join(inverse_frequencies(lexicon, okapi).select("term", "idf"), "term")
    size = terms.agg(F.count_distinct("term").alias("v"), F.count_distinct("query_id").alias("q")).first()
    if size["v"] * size["q"] > max_cells:
        return topk(bm25_scores_by_join(tokenized, batch, stats, okapi), k)
    return topk(_bm25_broadcast(tokenized, batch, stats, okapi, k), k)


def _bm25_broadcast(tokenized: DataFrame, batch: DataFrame, stats: DataFrame, okapi: Okapi, k: int) -> DataFrame:
    spark = tokenized.sparkSession
    # bounded by the check in bm25_topk
    rows = batch.select("query_id", "term", (F.col("qtf") * F.col("idf")).alias("w")).toArrow()
    id_type = rows.schema.field("query_id").type
    schema = pa.schema(
        [("query_id", id_type), ("child_id", pa.int64() if dict(tokenized.dtypes)["child_id"] in ("bigint", "int") else pa.string()), ("score", pa.float64())]
    )
    ddl = f"query_id {dict(batch.dtypes)['query_id']}, child_id {dict(tokenized.dtypes)['child_id']}, score double"
    query_ids = pc.unique(rows.column("query_id"))
    words = pc.unique(rows.column("term"))
    measured = stats.first()
    if rows.num_rows == 0 or measured is None:
        return spark.createDataFrame([], ddl)
    weights = np.zeros((len(words), len(query_ids)))
    asked = np.zeros(weights.shape)
    cell = np.asarray(pc.index_in(rows.column("term"), value_set=words)), np.asarray(pc.index_in(rows.column("query_id"), value_set=query_ids))
    weights[cell], asked[cell] = np.asarray(rows.column("w")), 1
    avgdl = float(measured["avgdl"])
    scorer = _block_scorer(words.to_pylist(), query_ids, weights, asked, avgdl, okapi, k, schema)
    return tokenized.select("child_id", "tokens", "dl").mapInArrow(scorer, ddl)


def bm25_scores_by_join(tokenized: DataFrame, batch: DataFrame, stats: DataFrame, okapi: Okapi = Okapi(), salts: int = SALTS) -> DataFrame:
    """(query_id, child_id, score) for every pair sharing a term, for query batches of any size."""
    avgdl = stats.select("avgdl").scalar()
    wanted = batch.select("term").distinct()
    hits = postings(tokenized).join(wanted, "term", "left_semi")
    gain = F.col("tf") * (okapi.k1 + 1) / (F.col("tf") + okapi.k1 * (1 - okapi.b + okapi.b * F.col("dl") / avgdl))
    # a frequent term's postings spread over `salts` tasks; its few query rows are repeated
    left = hits.select("child_id", "term", gain.alias("_gain"), F.pmod(F.xxhash64("child_id"), F.lit(salts)).alias("_salt"))
    right = batch.select("query_id", "term", (F.col("qtf") * F.col("idf")).alias("_w"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(salts - 1).cast("bigint"))).alias("_salt"))
    joined = left.join(right, ["term", "_salt"])
    return joined.groupBy("query_id", "child_id").agg(F.round(F.sum(F.col("_gain") * F.col("_w")), SCORE_DIGITS).alias("score"))


def normalize_lexical(ranked: DataFrame, children: DataFrame | None = None, keep: Column | None = None) -> DataFrame:
    """Divide by the query's best score; queries whose best is not positive lose all rows.

    Corpus and validity filters (``keep`` over ``children`` columns) apply after the
    lexical cut, so narrow filters can leave fewer rows than the cut allowed.
    """
    best = F.max("score").over(Window.partitionBy("query_id"))
    scaled = ranked.withColumn("_best", best).filter("_best > 0").withColumn("bm25_score", F.col("score") / F.col("_best")).drop("_best")
    if children is None or keep is None:
        return scaled
    return scaled.join(children.filter(keep).select("child_id"), "child_id", "left_semi")
