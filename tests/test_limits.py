"""Nothing is cut, clamped or lost between plans."""

import pytest
from pyspark.sql import functions as F

from corpusloom.functions import text as X
from corpusloom.operators import answers as A
from corpusloom.operators import dense as V
from corpusloom.operators import evals as E
from corpusloom.operators import lexical as L
from corpusloom.operators import logs, pages, ranking, tags


def one(spark, *columns):
    return tuple(spark.range(1).select(*columns).first())


def rows(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def test_bm25_plans_agree_on_terms_of_weight_zero(spark):
    # "even" is in half of the passages, so that its weight is 0
    kids = spark.createDataFrame([("a", "even x1"), ("b", "even y2"), ("c", "z3 q4"), ("d", "w5 v6")], "child_id string, search_text string")
    q = spark.createDataFrame([(1, "even")], "query_id long, question string")
    word = lambda c: F.filter(F.split(F.lower(X.text_or_empty(c)), " "), lambda w: w != "")
    tok, terms = L.tokenize(kids, tokenizer=word), L.query_terms(q, tokenizer=word)
    small = rows(L.bm25_topk(tok, terms, 5), "query_id", "child_id", "score")
    assert small == rows(L.bm25_topk(tok, terms, 5, max_cells=0), "query_id", "child_id", "score")
    assert [r[1] for r in small] == ["a", "b"]


def test_vector_plans_agree_on_mixed_widths(spark):
    index = spark.createDataFrame([(i, [float(i)] * (2 + i % 2)) for i in range(12)], "child_id long, embedding array<float>")
    q = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0, 3.0]), (3, [5.0]), (4, [])], "query_id long, embedding array<float>")
    small = rows(V.vector_topk(index, q, 3), "query_id", "rank", "child_id", "score")
    assert small == rows(V.vector_topk(index, q, 3, max_values=0, block_rows=4), "query_id", "rank", "child_id", "score")
    assert [r[0] for r in small] == [1, 1, 1, 2, 2, 2]


def test_long_texts_and_numbers(spark):
    tokens = one(spark, X.retrieval_tokens(F.lit("ab" * 3000)))[0]
    assert len(tokens) == 1 + 5999
    keys = ["a9", "a10", "a" + "9" * 25, "a1" + "0" * 25, "a2" + "0" * 25]
    got = one(spark, *[X.natural_sort_key(F.lit(k)) for k in keys])
    assert list(got) == sorted(got) and len(set(got)) == 5


def test_links_in_headings_and_deep_paths(spark):
    html = '<h2>A &amp; B</h2><a href="/1">one</a><h3>See <a href="/2">two</a></h3><a href="/3">three</a><h2>C</h2><a href="/4">four</a>'
    got = pages.page_links(spark.createDataFrame([(1, "http://h/x", html)], "page_id long, url string, html string"))
    assert [(r.url, r.text, r.h2, r.h3) for r in got.orderBy("position").collect()] == [
        ("http://h/1", "one", "A & B", ""), ("http://h/2", "two", "A & B", ""), ("http://h/3", "three", "A & B", "See two"), ("http://h/4", "four", "C", ""),
    ]
    base = F.lit("http://h/a/b/c/d/e/f/g.htm")
    cases = {"../../../../../../x.htm": "http://h/x.htm", "../" * 9 + "y": "http://h/y", "./z/../w": "http://h/a/b/c/d/e/f/w", "..": "http://h/a/b/c/d/e/", "v.htm?p=../q": "http://h/a/b/c/d/e/f/v.htm?p=../q"}
    assert dict(zip(cases, one(spark, *[pages.resolve_url(base, F.lit(h)) for h in cases]))) == cases


def test_captions_are_one_line(spark):
    assert one(spark, pages.html_to_markdown(F.lit('<p>x<img src="a"\n alt="two\n words">y</p>')))[0] == "x\n[画像: two words]\ny"


def test_walk_goes_to_its_end(spark):
    edges = spark.createDataFrame([(str(i), str(i + 1)) for i in range(6)], "src string, dst string")
    starts = spark.createDataFrame([("0",)], "url string")
    assert pages.reachable_pages(edges, starts).count() == 7
    with pytest.raises(ValueError):
        pages.reachable_pages(edges, starts, max_rounds=3)


def test_numbers_are_obeyed_or_refused(spark):
    df = spark.range(700).withColumn("priority", F.lit("low")).withColumn("count", F.lit(1)).withColumn("last_seen_at", F.lit(""))
    assert ranking.recent(df, limit=600).count() == 600
    assert ranking.priority_order(df, 3).count() == 3
    for bad in (lambda: ranking.recent(df, limit=0), lambda: logs.top_questions(spark.createDataFrame([("q",)], "question string"), 0)):
        with pytest.raises(ValueError):
            bad()
    assert len(one(spark, tags.normalize_tags(F.transform(F.sequence(F.lit(1), F.lit(60)), lambda i: i.cast("string"))))[0]) == 60


def test_first_readable_object_of_a_reply(spark):
    replies = {'note {x} then {"aliases": ["a", "b"]}': ["a", "b"], '{"aliases": ["c"]} and {"aliases": ["d"]}': ["c"], "- e\n- f": ["e", "f"], "": []}
    assert dict(zip(replies, map(list, one(spark, *[A.parse_alias_reply(F.lit(r)) for r in replies])))) == replies


def test_longest_reference_takes_its_text(spark):
    schema = "answer_id long, answer string, sources array<struct<title:string,heading_path:string,document_id:string,tsutatsu_name:string,taxanswer_no:string,source_file:string,source_url:string>>"
    src = lambda title, name=None, url=None: (title, None, None, name, None, None, url)
    df = spark.createDataFrame(
        [(1, "See Guide number 12", [src("Guide number 1"), src("Guide number 12")]), (2, "Guide number 12 and Guide number 1.", [src("Guide number 1"), src("Guide number 12")]),
         (3, "by the basic circular", [src("t", "basic circular")]), (4, "at https://h.example/a/page-77.htm", [src("t", None, "https://h.example/a/page-77.htm")])], schema,
    )
    assert rows(E.direct_references(df), "answer_id", "source_no") == [(1, 2), (2, 1), (2, 2), (3, 1), (4, 1)]
