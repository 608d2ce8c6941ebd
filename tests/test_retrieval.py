import random

import numpy as np
from pyspark.sql import functions as F

from corpusloom.operators import dense as V
from corpusloom.operators import lexical as X
from corpusloom.operators import matching as T
from corpusloom.operators import ranking as R
from corpusloom.operators import search as S


def rows(df, *names):
    return sorted(tuple(r[n] for n in names) for r in df.collect())


def test_bm25_plans_agree(spark):
    rng = random.Random(3)
    words = ["alpha", "beta", "gamma", "delta", "相続", "税", "no"]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randrange(3, 30))) for _ in range(60)] + ["alpha beta same"] * 20
    kids = spark.createDataFrame([(f"c{i:03d}", t) for i, t in enumerate(texts)], "child_id string, search_text string")
    q = spark.createDataFrame([(1, "alpha beta beta"), (2, "相続税"), (3, "zzzz"), (4, "")], "query_id long, question string")
    tok, terms = X.tokenize(kids), X.query_terms(q)
    small = rows(X.bm25_topk(tok, terms, 7), "query_id", "rank", "child_id", "score")
    large = rows(X.bm25_topk(tok, terms, 7, max_cells=0), "query_id", "rank", "child_id", "score")
    assert [r[:3] for r in small] == [r[:3] for r in large]
    assert np.allclose([r[3] for r in small], [r[3] for r in large])
    assert {r[0] for r in small} <= {1, 2, 3}


def test_vector_plans_agree_and_filter_before_the_cut(spark):
    rng = np.random.default_rng(4)
    vectors = np.round(rng.normal(size=(50, 8)), 3)
    vectors[10:20] = vectors[10]  # copies tie; ids decide
    index = spark.createDataFrame([(i, [float(x) for x in v], f"c{i % 3}") for i, v in enumerate(vectors)], "child_id long, embedding array<float>, corpus_id string")
    q = spark.createDataFrame(
        [(i, [float(x) for x in vectors[i * 5]], None if i % 2 else ["c1"]) for i in range(6)], "query_id long, embedding array<float>, corpus_ids array<string>"
    )
    for metric in V.METRICS:
        a = rows(V.vector_topk(index, q, 5, metric), "query_id", "rank", "child_id", "score")
        b = rows(V.vector_topk(index, q, 5, metric, max_values=0, block_rows=7), "query_id", "rank", "child_id", "score")
        assert a == b and len(a) == 30
    own = rows(V.vector_topk(index, q, 5, "cosine"), "query_id", "child_id")
    assert all(c % 3 == 1 for query, c in own if query % 2 == 0)


def test_vector_groups_against_brute_force(spark):
    rng = np.random.default_rng(5)
    v = rng.normal(size=(60, 4)).astype(np.float32)
    group = [0] * 30 + [i % 7 for i in range(30)]  # one group holds half of the rows
    index = spark.createDataFrame([(i, group[i], v[i].tolist()) for i in range(60)], "child_id long, group_id long, embedding array<float>")
    q = spark.createDataFrame([(i, v[i + 20].tolist()) for i in range(8)], "query_id long, embedding array<float>")
    want = []
    for i in range(8):
        sims = v.astype(float) @ v[i + 20].astype(float) / (np.linalg.norm(v.astype(float), axis=1) * np.linalg.norm(v[i + 20].astype(float)))
        best = {}
        for c, s in enumerate(np.round(sims, 9)):
            if group[c] not in best or s > best[group[c]][0]:
                best[group[c]] = (s, c)
        for rank, (g, (s, c)) in enumerate(sorted(best.items(), key=lambda e: (-e[1][0], e[0]))[:3], 1):
            want.append((i, rank, g, c))
    for options in ({}, {"max_values": 0, "block_rows": 9}):
        assert rows(V.vector_topk_groups(index, q, 3, **options), "query_id", "rank", "group_id", "child_id") == sorted(want)


def test_containment_equals_a_loop(spark):
    rng = random.Random(8)
    letters = "ab相 \n"
    texts = [(1, "abcabcd x"), (2, "zz相続税zz"), (3, ""), (4, None), (None, "abcd"), (1, "second q row")]
    texts += [(i, "".join(rng.choices(letters, k=rng.choice([0, 5, 40, 400])))) for i in range(10, 60)]
    names = ["a", "bc", "abc", "abcd", "相続", "相続税zz", "q", "", None, "abcdabcd", "𠮷野家", "zz相"] + ["".join(rng.choices(letters, k=rng.randint(1, 9))) for _ in range(60)]
    df = spark.createDataFrame(texts, "k long, t string")
    terms = spark.createDataFrame([(n,) for n in names], "term string")
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    want = sorted({(k, n) for k, t in texts for n in names if n and n in (t or "")}, key=key)
    for sample in (2000, 3):
        assert sorted(((r.k, r.term) for r in T.contained_terms(df, "k", "t", terms, sample=sample).collect()), key=key) == want


def test_terms_are_keyed_by_their_rarest_part(spark):
    texts = spark.createDataFrame([(i, "the common words of all" + (" rare" if i == 3 else "")) for i in range(30)], "_key long, _text string")
    got = T.keyed_terms(texts, spark.createDataFrame([("the common",), ("of all rare",)], "term string")).collect()
    assert {r.term: r.gram for r in got}["of all rare"] in {" rar", "rare", "l ra", "ll r"}
    plan = T.contained_terms(texts, "_key", "_text", spark.createDataFrame([("abcdef",)], "term string"))._jdf.queryExecution().toString()
    assert "Arrow" not in plan and "Python" not in plan


def diversify_loop(items, k):
    out, seen = [], set()
    for c, p in items:
        if p in seen and len(out) >= max(3, k // 2):
            continue
        out.append(c)
        seen.add(p)
        if len(out) >= k:
            break
    return out


def filter_loop(items, top_k, min_score, min_keep, max_keep, dedupe):
    target = max(1, min(top_k, max_keep))
    floor = min(max(1, min_keep), target)
    ordered = sorted(items, key=lambda r: -r[2])
    passed = [r for r in ordered if r[2] >= min_score]
    cand = passed if len(passed) >= floor else ordered
    if dedupe:
        seen, kept = set(), []
        for r in cand:
            if r[1] and r[1] in seen:
                continue
            kept.append(r)
            seen.add(r[1])
        cand = kept
    final = cand[:target]
    for again in (False, True):
        for r in ordered:
            if len(final) >= floor:
                break
            if r in final or (dedupe and not again and r[1] and r[1] in {f[1] for f in final}):
                continue
            final.append(r)
    return [r[0] for r in final]


def test_ranking_against_loops(spark):
    rng = random.Random(6)
    data, groups = [], {}
    for q in range(120):
        n = rng.randrange(1, 12)
        scores = rng.sample(range(100), n)
        items = [(f"c{q}_{i}", rng.choice(["p1", "p2", "p3", "p4"]), s / 100) for i, s in enumerate(scores)]
        groups[q] = items
        data += [(q, c, p, i + 1, s, len(c) * 7) for i, (c, p, s) in enumerate(items)]
    df = spark.createDataFrame(data, "query_id long, child_id string, parent_id string, rank int, rerank_score double, size int").cache()

    def by_query(out):
        found = {q: [] for q in groups}
        for r in sorted(out.collect(), key=lambda r: r["rank"]):
            found[r.query_id].append(r.child_id)
        return found

    assert by_query(R.diversify(df, 6)) == {q: diversify_loop([(c, p) for c, p, _ in items], 6) for q, items in groups.items()}
    for options in ((5, 0.5, 2, 4, True), (8, 0.9, 3, 3, True), (4, 0.4, 1, 8, False)):
        assert by_query(R.rerank_filter(df, *options)) == {q: filter_loop(items, *options) for q, items in groups.items()}, options


def test_context_budget_loop(spark):
    rng = random.Random(7)
    texts = {(q, r): "x" * rng.randrange(0, 9) for q in range(40) for r in range(1, 6)}
    df = spark.createDataFrame([(q, r, t) for (q, r), t in texts.items()], "query_id long, rank int, parent_text string")
    got = {(r.query_id, r["rank"]): r.parent_text for r in R.context_budget(df, 12).collect()}
    for q in range(40):
        left = 12
        for r in range(1, 6):
            t = texts[q, r]
            want = "" if left <= 0 else t if len(t) <= left else t[:left] + R.CUT_MARK
            left = max(0, left - len(want))
            assert got[q, r] == want


def test_ordinal_with_a_hot_key(spark):
    df = spark.range(3000).select(F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), (F.col("id") % 40).cast("string"))).alias("k"), F.col("id").alias("o"))
    got = R.ordinal(df, ["k"], ["o"], "n").collect()
    seen: dict[str, list[int]] = {}
    for r in sorted(got, key=lambda r: r.o):
        seen.setdefault(r.k, []).append(r.n)
    assert all(v == list(range(1, len(v) + 1)) for v in seen.values()) and len(got) == 3000


def test_releases(spark):
    schema = "release_id string, status string, collection_name string, corpus_version string, index_version string, row_count long, embedding_size int, error string"
    table = spark.createDataFrame([("c_1", "active", "x", "c", "1", 5, 4, None)], schema)
    new = spark.createDataFrame([("c", "2", "y")], "corpus_version string, index_version string, collection_name string")
    table = S.begin_release(table, new)
    blocked = {r.release_id: r.status for r in S.activate_release(table, "c_2").collect()}
    assert blocked == {"c_1": "active", "c_2": "building"}
    table = S.finish_release(table, "c_2", 9, 4)
    table = S.activate_release(table, "c_2")
    assert {r.release_id: (r.status, r.row_count) for r in table.collect()} == {"c_1": ("archived", 5), "c_2": ("active", 9)}
    assert {r.release_id: r.status for r in S.archive_release(table, "c_2").collect()}["c_2"] == "active"
    index = spark.createDataFrame([("a", "c_1"), ("b", "c_2")], "child_id string, release_id string")
    assert [r.child_id for r in S.active_rows(index, table).collect()] == ["b"]


def test_lexical_hits_and_the_fused_list_are_stored(spark, monkeypatch):
    from corpusloom.plans import load_all
    from corpusloom.plans import retrieval as P

    folder = "/root/testdata/sf0.001"
    source = P.lexical(spark, folder, 8).inputFiles()
    assert source and not any("bucket=" in f or "/passages-" in f for f in source)
    made = []
    once = P.fused
    monkeypatch.setattr(P, "fused", lambda *a: made.append(1) or once(*a))
    load_all()[0]["compare_modes"](spark, folder)
    assert len(made) == 1
