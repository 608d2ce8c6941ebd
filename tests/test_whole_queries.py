"""Queries against their SQL on small tables with the cases that the test tables hold only at size."""

import duckdb
import pytest

import oracle
from corpusloom.operators import evals as E
from corpusloom.plans import load_all
from corpusloom.plans.catalog import load
from corpusloom.plans.chunks import page_report


@pytest.fixture
def check(spark, tmp_path):
    """Compare a query with its SQL on the given tables."""

    def run(name, **tables):
        con = duckdb.connect()
        for table, rows in tables.items():
            rows.coalesce(1).write.parquet(f"{tmp_path}/{table}.parquet")
            con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{tmp_path}/{table}.parquet/*.parquet'")
        queries, oracles = load_all()
        return oracle.compare(spark, con, queries[name], oracles[name], str(tmp_path))

    return run


def test_filter_aliases_long_wordings_and_line_ends(spark, check):
    words = "some words of a longer question, and then again some more of them to make it long enough " * 3
    texts = {2: "a short one\n", 62: words, 66: words[:148] + "\n", 87: words[:119] + "\n", 7: words[5:]}
    b = spark.createDataFrame([(i, t) for i, t in texts.items()], "item_id long, text string")
    e = spark.createDataFrame([(i, [1.0, float(i)]) for i in range(40)], "vec_id long, embedding array<float>")
    assert check("filter_aliases", benchmark=b, embeddings=e) == ""


def test_heading_sections_simple_long_sections(spark, check):
    def page(n, *sizes):
        return n, f"u{n}", "<html><body><h1>Title</h1>" + "".join(f"<p>{'word and ' * s}end {i}</p>" for i, s in enumerate(sizes)) + "</body></html>"

    pages = spark.createDataFrame([page(1, 3, 5, 4000, 6, 7, 8, 9, 10, 11), page(2, 4000), page(3, 2, 3)], "page_id long, url string, html string")
    assert check("heading_sections_simple", pages=pages) == ""


def test_evidence_candidates_spaces_of_a_reference_count(spark):
    kids = spark.createDataFrame([("a", "one two"), ("b", "one two three"), ("c", "one twofold")], "child_id string, text string").selectExpr(
        "child_id", "'' AS corpus_id", "'' AS taxanswer_no", "'' AS document_id", "'' AS source_file", "'' AS title", "'' AS heading_path", "text")
    refs = spark.createDataFrame([(1, "one two "), (2, "one two"), (3, "  ")], "question_id long, source_ref string")
    found = {(r["question_id"], r["child_id"]) for r in E.evidence_candidates(refs, kids).collect()}
    assert found == {(1, "b"), (2, "a"), (2, "b"), (2, "c")}


def test_page_report_is_stored_and_pages_are_spread(spark, tmp_path):
    pages = spark.range(64).selectExpr("id AS page_id", "'u' AS url", "concat('<html><body><h1>T</h1><p>word ', id, '</p></body></html>') AS html")
    pages.repartition(16).write.parquet(f"{tmp_path}/pages.parquet")
    files = page_report(spark, str(tmp_path)).inputFiles()
    assert files and not any("pages.parquet" in f for f in files)
    scanned = spark.read.parquet(f"{tmp_path}/pages.parquet").rdd.getNumPartitions()
    cores = spark.sparkContext.defaultParallelism
    assert load(spark, str(tmp_path), "pages").rdd.getNumPartitions() == (4 * scanned if scanned >= cores else cores)


def test_best_passages_by_points_equal_the_joined_scores(spark, monkeypatch):
    monkeypatch.setattr(E, "ASKS", 2)
    text = "ab abc averyveryverylongwordindeed 相続税 x\U0001f600y "
    kids = spark.createDataFrame(
        [(f"k{i:02}", text[i % 7 :] if i % 3 else "", f"h {i}", text[i : 3 * i] + text[: i % 5] * 3) for i in range(40)] + [("n", None, None, None)],
        "child_id string, title string, heading_path string, text string")
    asked = ["averyveryverylongwordindeed averyveryverylongwordx", "相続税 ab", "zz qq", "h 3 abc", "\U0001f600y x"]
    q = spark.createDataFrame(list(enumerate(asked)), "question_id long, question string")
    want = {tuple(r) for r in E.best_evidence(E.evidence_scores(q, kids)).select("question_id", "child_id", "score").collect()}
    got = {tuple(r) for r in E.best_scored(q, kids).select("question_id", "child_id", "score").collect()}
    assert got == want and len(want) == 4


PAGE_TEXT = "html_to_markdown clean_text page_title doc_title trim_main frontmatter heading_sections heading_sections_simple blocks merge_small parent_sections child_chunks child_rows chunk_report"


@pytest.mark.parametrize("name", PAGE_TEXT.split())
def test_references_cut_off_before_their_semicolon(spark, check, name):
    cuts = ["token = &quot", "token = &quo", "a&amp;&amp", "a &copy b &middot c", "&amp;quot x &amp;quot; &ampquot;"]
    body = "<h1>{0}</h1><p>" + "words of it " * 90 + "{0}</p><p>{0} &quot;end&quot; &copy; &middot;</p>"
    pages = spark.createDataFrame(
        [(i, f"u{i}", f"<html><head><title>{t}</title></head><body>{body.format(t)}</body></html>") for i, t in enumerate(cuts)], "page_id long, url string, html string")
    assert check(name, pages=pages) == ""
