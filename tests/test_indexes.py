"""Stored indexes: equal to the plans without one, and read in part only."""

import random
import tempfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.operators import dense as V
from corpusloom.operators import dense_index as DI
from corpusloom.operators import lexical as X
from corpusloom.operators import lexical_index as LI


def rows(df, *names):
    return sorted(tuple(r[n] for n in names) for r in df.collect())


def same(a, b):
    assert [r[:3] for r in a] == [r[:3] for r in b]
    assert np.allclose([r[3] for r in a], [r[3] for r in b])


def texts(seed=3, n=300):
    rng = random.Random(seed)
    common = ["alpha", "beta", "gamma", "delta", "相続", "税", "no"]
    # later passages have words of their own, so that shards differ
    out = [" ".join(rng.choice(common + [f"w{i // 40}x{j}" for j in range(6)]) for _ in range(rng.randrange(3, 30))) for i in range(n)]
    return out + ["alpha beta same"] * 40 + ["", " "]


@pytest.fixture(scope="module")
def lexical(spark):
    kids = spark.createDataFrame([(f"c{i:03d}", t) for i, t in enumerate(texts())], "child_id string, search_text string").repartitionByRange(3, "child_id")
    return X.tokenize(kids)


ASKED = [(1, "alpha beta beta"), (2, "相続税"), (3, "zzzz"), (4, ""), (5, "w3x1 w3x2 alpha"), (6, "w7x0"), (7, None)]


def test_stored_bm25_equals_both_plans(spark, lexical):
    terms = X.query_terms(spark.createDataFrame(ASKED, "query_id long, question string"))
    folder = tempfile.mkdtemp(prefix="spark-")
    LI.write_lexical_index(lexical, folder, "v1", shard_passages=16, buckets=4)
    index = LI.read_lexical_index(spark, folder, "v1")
    names = ("query_id", "rank", "child_id", "score")
    for okapi in (X.Okapi(), X.Okapi(k1=0.9, b=0.3)):
        got = rows(LI.indexed_topk(index, terms, 7, okapi), *names)
        same(got, rows(X.bm25_topk(lexical, terms, 7, okapi), *names))
        same(got, rows(X.bm25_topk(lexical, terms, 7, okapi, max_cells=0), *names))
    assert {r[0] for r in got} == {1, 2, 5, 6}
    share = LI.read_share(index, X.query_terms(spark.createDataFrame([(5, "w3x1 w3x2"), (6, "w7x0 alpha")], "query_id long, question string")), 3).first()
    assert share.pairs_read < share.pairs / 2
    want = {(r.term, r.df) for r in X.build_lexicon(lexical).collect()}
    assert {(r.term, r.df) for r in index.lexicon.collect()} == want


def test_stored_bm25_replaces_only_its_release(spark, lexical):
    folder = tempfile.mkdtemp(prefix="spark-")
    terms = X.query_terms(spark.createDataFrame(ASKED, "query_id long, question string"))
    LI.write_lexical_index(lexical, folder, "v1", buckets=2)
    LI.write_lexical_index(lexical.limit(0), folder, "v2", buckets=2)
    LI.write_lexical_index(lexical.filter(F.col("child_id") < "c100"), folder, "v2", buckets=3)
    one, two = (LI.indexed_topk(LI.read_lexical_index(spark, folder, v), terms, 500) for v in ("v1", "v2"))
    assert one.count() == X.bm25_topk(lexical, terms, 500).count()
    assert {r.child_id for r in two.collect()} <= {f"c{i:03d}" for i in range(100)}


def test_empty_stored_index(spark, lexical):
    folder = tempfile.mkdtemp(prefix="spark-")
    index = LI.write_lexical_index(lexical.limit(0), folder, "none")
    assert LI.indexed_topk(index, X.query_terms(spark.createDataFrame(ASKED, "query_id long, question string")), 5).count() == 0


def test_plan_reads_no_passages(spark, lexical):
    folder = tempfile.mkdtemp(prefix="spark-")
    index = LI.write_lexical_index(lexical, folder, "v1")
    found = LI.indexed_topk(index, X.query_terms(spark.createDataFrame(ASKED, "query_id long, question string")), 5)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "search_text" not in plan and "tokens" not in plan


def vectors(spark, clustered=True, seed=2, n=700):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, 8)) * 4
    v = centres[rng.integers(0, 12, n)] + (0.15 if clustered else 4.0) * rng.normal(size=(n, 8))
    v[100:200] = v[100]  # a large group of equal vectors
    v[5] = 0
    data = [(i, i % 9, [float(x) for x in row], f"c{i % 3}") for i, row in enumerate(v)]
    data += [(5000, 1, [1.0, 2.0], "c0"), (5001, 1, [2.0, 1.0], "c1"), (5002, 2, None, "c0"), (5003, 2, [], "c0")]
    index = spark.createDataFrame(data, "child_id long, group_id long, embedding array<float>, corpus_id string")
    asked = [(i, data[i * 17][2], None if i % 2 else ["c1", "c2"]) for i in range(20)] + [(90, [1.0, 1.0], None), (91, None, None), (92, [0.0] * 8, None), (93, [1.0] * 3, None)]
    return index, spark.createDataFrame(asked, "query_id long, embedding array<float>, corpus_ids array<string>")


@pytest.mark.parametrize("metric", V.METRICS)
def test_stored_vectors_equal_the_full_scan(spark, metric):
    index, q = vectors(spark)
    folder = tempfile.mkdtemp(prefix="spark-")
    DI.write_vector_index(index, folder, "v1", metric, centres=10, block_rows=32, buckets=4)
    stored = DI.read_vector_index(spark, folder, "v1")
    names = ("query_id", "rank", "child_id", "score")
    same(rows(DI.indexed_vectors(stored, q, 6), *names), rows(V.vector_topk(index.drop("group_id"), q, 6, metric), *names))
    names = ("query_id", "rank", "group_id", "score", "child_id")
    a, b = rows(DI.indexed_groups(stored, q, 4), *names), rows(V.vector_topk_groups(index, q, 4, metric), *names)
    assert [(r[:3], r[4]) for r in a] == [(r[:3], r[4]) for r in b]
    if metric != "dot":
        share = DI.read_share(stored, q.filter("query_id < 50"), 3).first()
        assert share.pairs_read < share.pairs / 2


def test_widths_outside_the_sample_and_empty_index(spark):
    index, q = vectors(spark)
    folder = tempfile.mkdtemp(prefix="spark-")
    stored = DI.write_vector_index(index, folder, "v1", "l2", sample=3, centres=2, buckets=2)
    names = ("query_id", "rank", "child_id", "score")
    same(rows(DI.indexed_vectors(stored, q, 6), *names), rows(V.vector_topk(index.drop("group_id"), q, 6, "l2"), *names))
    none = DI.write_vector_index(index.limit(0), folder, "v2", "l2")
    assert DI.indexed_vectors(none, q, 3).count() == 0


@pytest.mark.parametrize("metric", V.METRICS)
def test_tiles_give_the_rows_of_one_product(metric, monkeypatch):
    monkeypatch.setattr(V, "TILE", 7)
    rng = np.random.default_rng(5)
    index = rng.integers(-2, 3, (90, 3)).astype(float)  # many copies and ties, some zero vectors
    queries = np.vstack([index[:40], rng.normal(size=(10, 3)), np.zeros((1, 3))])
    names = np.eye(4)[rng.integers(0, 4, 90)], (rng.random((51, 4)) < 0.3).astype(float)
    exact = np.array([V._pair_scores(index, np.repeat(q[None], 90, axis=0), metric) for q in queries]).T
    for k in (1, 5, 100):
        for rights in (None, names):
            row, query, score = V._tiled_top(index, queries, metric, k, rights)
            want = V.best_rows(exact, None if rights is None else rights[0] @ rights[1].T > 0, k)
            assert set(zip(row, query)) == set(zip(*want))
            assert np.allclose(score, exact[row, query])


def test_a_batch_of_queries_is_ranked_once(spark, monkeypatch):
    # ranking all queries again every 64 index rows made time grow faster than the pairs
    calls = []
    top = V.RunningTop(600, 3)
    monkeypatch.setattr(top, "add", lambda ids, query, score: calls.append(len(ids)))
    monkeypatch.setattr(V, "SCORE_CELLS", 1000)
    rng = np.random.default_rng(6)
    rows = rng.normal(size=(500, 4))
    batch = V.pa.table({"child_id": np.arange(500), "embedding": rows.tolist()})
    V._block_top(batch, rng.normal(size=(600, 4)), None, "cosine", 3, top)
    assert calls == [1800]


def test_blocks_of_queries_from_the_table_of_the_index(spark):
    # both sides of the block join shared the embedding column, which failed
    rng = np.random.default_rng(7)
    e = spark.createDataFrame([(i, rng.normal(size=4).tolist(), i % 3) for i in range(120)], "vec_id long, embedding array<float>, label int")
    index = e.select(F.col("vec_id").alias("child_id"), "embedding", F.col("label").cast("string").alias("corpus_id"))
    allowed = F.transform(F.sequence(F.lit(0), F.col("label")), lambda n: n.cast("string"))
    q = e.select(F.col("vec_id").alias("query_id"), "embedding", allowed.alias("corpus_ids"))
    names = ("query_id", "rank", "child_id", "score")
    want = rows(V.vector_topk(index, q, 4, "cosine"), *names)
    same(rows(V.vector_topk(index, q, 4, "cosine", max_values=1), *names), want)
    same(rows(V.vector_topk(index, q, 4, "cosine", max_values=1, block_rows=16), *names), want)


def test_text_index_equals_the_index_of_tokens(spark):
    odd = ["a  b", "ab ab\t\nab", "　　税 相続", "x\U0001f600y \U0001f600", "İ_9", "", None, " ", "\x1c\x1d q", "a\x85\xa0b", "\x00 \x00"]
    kids = spark.createDataFrame([(f"c{i:03d}", t) for i, t in enumerate(odd + texts(n=30))], "child_id string, search_text string").repartitionByRange(2, "child_id")
    one = LI.write_lexical_index(X.tokenize(kids), tempfile.mkdtemp(prefix="spark-"), "v", shard_passages=16, buckets=2)
    two = LI.write_text_index(kids, tempfile.mkdtemp(prefix="spark-"), "v", shard_passages=16, buckets=2)
    for table, names in (("blocks", ("shard", "term", "n", "max_tf", "min_dl", "places", "tfs")), ("shards", ("shard", "child_ids", "dls"))):
        assert rows(getattr(one, table), *names) == rows(getattr(two, table), *names)
    lexicon = [sorted(map(str, t.lexicon.select("term", "df", "total_length").collect())) for t in (one, two)]
    assert lexicon[0] == lexicon[1] and len(lexicon[0]) > 50


def test_a_search_writes_no_row_per_query_and_ring(spark, monkeypatch):
    from corpusloom.operators import pruning

    index, q = vectors(spark)
    stored = DI.write_vector_index(index, tempfile.mkdtemp(prefix="spark-"), "v1", "cosine", centres=10, block_rows=8, buckets=4)
    sizes, keep = [], DI.materialized

    def counted(df):
        out = keep(df)
        sizes.append(out.count())
        return out

    monkeypatch.setattr(DI, "materialized", counted)
    monkeypatch.setattr(pruning, "materialized", counted)
    monkeypatch.setattr(DI, "SHARD_ROWS", 100, raising=False)
    monkeypatch.setattr(DI, "QUERY_ROWS", 3, raising=False)
    names = ("query_id", "rank", "child_id", "score")
    same(rows(DI.indexed_vectors(stored, q, 6), *names), rows(V.vector_topk(index.drop("group_id"), q, 6, "cosine"), *names))
    assert max(sizes) <= q.count() * 6
