from pyspark.sql import functions as F

from corpusloom import schemas as Z
from corpusloom.operators import answers as A
from corpusloom.operators import evals as E
from corpusloom.operators import tags as T

NOW = "2024-05-01T00:00:00"


def qa_rows(spark, rows):
    names = Z.APPROVED_QA.fieldNames()
    full = [tuple({**dict.fromkeys(names), "status": "approved", "corpus_version": "default", "index_version": "default", "memo": "", **r}[n] for n in names) for r in rows]
    return spark.createDataFrame(full, Z.APPROVED_QA)


def alias_rows(spark, rows):
    names = Z.ALIASES.fieldNames()
    full = [tuple({**dict.fromkeys(names), "status": "active", "alias_type": "original", "memo": "", "risk_flags": [], **r}[n] for n in names) for r in rows]
    return spark.createDataFrame(full, Z.ALIASES)


EV = [("c1", "p", "k", "t", None, None, "text", 1.0)]


def tables(spark):
    qa = qa_rows(
        spark,
        [
            {"id": 1, "question": "相続税とは", "answer": "A1", "embedding": [1.0, 0.0], "evidence": EV},
            {"id": 2, "question": "贈与税とは", "answer": "A2", "embedding": [0.0, 1.0], "evidence": []},
            {"id": 3, "question": "古い質問", "answer": "A3", "embedding": [1.0, 1.0], "evidence": EV, "corpus_version": "old"},
            {"id": 4, "question": "停止", "answer": "A4", "embedding": [1.0, 0.5], "evidence": EV, "status": "disabled"},
        ],
    )
    aliases = alias_rows(
        spark,
        [
            {"id": 10, "qa_id": 1, "alias_text": "相続税とは", "normalized_text": "相続税とは", "embedding": [1.0, 0.0]},
            {"id": 11, "qa_id": 1, "alias_text": "共通", "normalized_text": "共通", "alias_type": "llm_paraphrase", "embedding": [0.9, 0.1]},
            {"id": 12, "qa_id": 2, "alias_text": "共通", "normalized_text": "共通", "alias_type": "admin_alias", "embedding": [0.0, 0.0]},
            {"id": 13, "qa_id": 2, "alias_text": "wrong", "normalized_text": "wrong", "alias_type": "admin_alias", "embedding": [1.0, 2.0, 3.0]},
            {"id": 14, "qa_id": 4, "alias_text": "停止", "normalized_text": "停止", "embedding": [1.0, 0.5]},
        ],
    )
    return qa, aliases


def test_matching(spark):
    qa, aliases = tables(spark)
    asked = spark.createDataFrame(
        [(1, " 相続税とは ", [0.0, 1.0]), (2, "共通", [0.0, 1.0]), (3, "other", [1.0, 0.2]), (4, "other", [0.1, 1.0])], "query_id long, question string, embedding array<double>"
    )
    got = {r.query_id: (r.qa_id, r.decision, r.miss_reason, r.match_method) for r in A.match_questions(asked, qa, aliases).collect()}
    assert got[1] == (1, "hit", None, "normalized_exact")
    assert got[2][1:] == ("gray", "alias_conflict", "normalized_exact")
    assert got[3] == (1, "hit", None, "alias_semantic")
    assert got[4][1:3] == ("miss", "below_gray_threshold")
    limited = asked.withColumn("corpus_ids", F.array(F.lit("c9")))
    assert {r.query_id for r in A.match_questions(limited, qa, aliases).collect()} == set()


def test_evidence_rule_variants(spark):
    df = spark.createDataFrame([([("c1",)], ["c1"]), ([], ["c1"]), ([("c1",)], None), ([("c1",)], [])], "evidence array<struct<corpus_id:string>>, corpus_ids array<string>")
    assert [r[0] for r in df.select(A.evidence_matches("evidence", "corpus_ids")).collect()] == [True, False, True, False]
    assert [r[0] for r in df.select(A.evidence_matches("evidence", "corpus_ids", True)).collect()] == [True, True, True, False]


def test_verdicts(spark):
    rows = spark.createDataFrame(
        [(1, 1, 1, 0.85, 0.1, "gray", "below_accept_threshold", "m"), (2, 1, 1, 0.9, 0.01, "gray", "margin_too_small", "m"), (3, 1, 1, 0.84, 0.2, "gray", "below_accept_threshold", "m")],
        "query_id long, qa_id long, alias_id long, similarity double, margin double, decision string, miss_reason string, match_method string",
    )
    verdicts = spark.createDataFrame([(1, True), (2, True), (3, False)], "query_id long, same_intent boolean")
    got = {r.query_id: (r.decision, r.miss_reason, r.match_method, r.skip_reason) for r in A.apply_verdicts(rows, verdicts).collect()}
    assert got == {1: ("llm_judge_hit", None, "llm_intent_judge", None), 2: ("gray", "margin_too_small", "m", "margin_too_small"), 3: ("llm_judge_reject", "llm_judge_rejected", "m", None)}


def test_add_aliases(spark):
    qa, aliases = tables(spark)
    v = [1.0, 0.0]
    new = spark.createDataFrame(
        [(1, 1, "新しい質問", "admin_alias", None, v), (1, 2, "新しい 質問", "admin_alias", "active", v), (1, 3, "共通", "admin_alias", "active", v), (1, 4, "x", "bad", None, v), (1, 5, " ", "admin_alias", None, v),
         (1, 6, "no vector", "admin_alias", None, None), (2, 7, "新しい質問", "admin_alias", None, v), (1, 8, "新しい質問", "admin_alias", None, v), (9, 9, "y", "admin_alias", None, v)],
        "qa_id long, position int, alias_text string, alias_type string, status string, embedding array<float>",
    )
    insert, results = A.add_aliases(qa, aliases, new, NOW)
    got = {r.position: (r.outcome, r.reason, r.status, r.warning) for r in results.collect()}
    assert got[1] == ("created", None, "active", None) and got[2][0] == "created"
    assert got[3][:1] + got[3][2:] == ("created", "disabled", A.CONFLICT_FLAG)
    assert got[4][:2] == ("error", "invalid alias_type") and got[5][:2] == ("skipped", "empty") and got[6][:2] == ("error", "embedding required")
    assert got[7][0] == "created" and got[7][2:] == ("disabled", A.CONFLICT_FLAG)
    assert got[8][:2] == ("skipped", "duplicate") and got[9][:2] == ("error", "approved QA not found")
    assert sorted(r.id for r in insert.collect()) == [15, 16, 17, 18]


def test_replace_update_disable(spark):
    qa, aliases = tables(spark)
    new = spark.createDataFrame([(1, 1, "別の聞き方", [1.0, 0.0]), (2, 1, " ", [1.0, 0.0])], "qa_id long, position int, alias_text string, embedding array<float>")
    out = {r.id: r for r in A.replace_generated_aliases(qa, aliases, new, NOW).collect()}
    assert out[11].status == "disabled" and out[15].alias_text == "別の聞き方" and out[15].alias_type == "llm_paraphrase" and len(out) == 6
    changes = spark.createDataFrame([(13, "共通", "active", [1.0, 1.0], "m"), (10, "changed", None, None, None)], "id long, alias_text string, status string, embedding array<float>, memo string")
    got = {r.id: r for r in A.update_aliases(qa, aliases, changes, NOW).collect()}
    assert got[13].status == "disabled" and A.CONFLICT_FLAG in got[13].risk_flags and got[13].memo == "m"
    assert got[10].alias_text == "相続税とは"  # a new text without a vector is refused
    off = spark.createDataFrame([(1, "why"), (2, "")], "id long, memo string")
    after = {r.id: (r.status, r.memo) for r in A.disable_rows(qa, off, NOW).collect()}
    assert after[1] == ("disabled", "why") and after[2] == ("disabled", "") and after[3][0] == "approved"
    assert [r.id for r in A.alias_list_order(aliases).filter("qa_id = 1").collect()] == [11, 10]


def test_create_qa_resolves_reports(spark):
    qa, aliases = tables(spark)
    names = Z.REPORTS.fieldNames()
    reports = spark.createDataFrame([tuple({**dict.fromkeys(names), "id": i, "status": "open"}[n] for n in names) for i in (1, 2)], Z.REPORTS)
    new = spark.createDataFrame([(1, "新質問", "ans", [1.0, 1.0], 2, "default", "default")], "change_no int, question string, answer string, embedding array<float>, source_report_id long, corpus_version string, index_version string")
    qa2, aliases2, reports2 = A.create_qa(qa, aliases, reports, new, NOW)
    assert qa2.filter("id = 5").first().question == "新質問" and aliases2.filter("id = 15").first().qa_id == 5
    assert {r.id: (r.status, r.resolved_qa_id, r.resolution_type) for r in reports2.collect()} == {1: ("open", None, None), 2: ("resolved", 5, "qa_created")}
    step = spark.createDataFrame([(2, "open", "note"), (1, "ignored", "")], "id long, status string, admin_memo string")
    final = {r.id: (r.status, r.resolved_at, r.admin_memo) for r in A.update_reports(reports2, step, "later").collect()}
    assert final == {2: ("open", None, "note"), 1: ("ignored", "later", "")}


def test_risk_flags(spark):
    def flags(q, a):
        return spark.range(1).select(A.risk_flags(F.lit(q), F.lit(a))).first()[0]

    assert flags("相続税のNo.4102", "贈与税のNo.4103") == ["tax_type_changed_to_gift_tax", "taxanswer_no_changed"]
    assert flags("相続税", "相続税の令和の扱い") == ["scope_or_time_condition_added"]
    assert flags("贈与税", "相続税") == ["tax_type_changed_to_inheritance_tax"]
    assert flags("相続税", "相続税とは") == []
    reply = spark.range(1).select(
        A.parse_alias_reply(F.lit('text ```json\n{"aliases": ["a", "b"]}\n```')), A.parse_alias_reply(F.lit('- one\n2. "two"\n')), T.parse_model_tags(F.lit('```json\n["x", " x ", "y"]\n```')), T.parse_model_tags(F.lit("oops"))
    ).first()
    assert [list(r) for r in reply] == [["a", "b"], ["one", "two"], ["x", "y"], []]


def test_seeds(spark):
    seeds = spark.createDataFrame(
        [("s1", "approved", EV), ("s2", "candidate_needs_admin_review", EV), ("s3", "approved", []), ("s4", "rejected", EV)],
        "seed_id string, approval_status string, evidence array<struct<corpus_id:string,parent_id:string,child_id:string,title:string,heading_path:string,source_file:string,child_text:string,score:double>>",
    )
    assert [r.seed_id for r in A.importable_seeds(seeds).collect()] == ["s1"]
    assert tuple(A.seed_counts(seeds, True).first()) == (4, 1, 1, 2)
    sources = A.evidence_sources(seeds.withColumn("id", F.lit(1)).filter("seed_id = 's1'")).first()
    assert (sources.child_id, sources.child_text, sources.score) == ("k", "text", 1.0)


def test_seed_evidence(spark):
    kids = spark.createDataFrame(
        [("k1", "nta_taxanswer_asset_tax", "相続税の基礎控除", "", "本文", "a.md", "4152", "x"), ("k2", "nta_sozoku_shitsugi", "事例", "見出し", "路線価", "1234567-001.md", "", "01/02"), ("k3", "nta_sozoku_shitsugi", "事例", "", "倍率", "b.md", "", "01/03"),
         ("k4", "nta_sozoku_kihon_tsutatsu", "通達", "", "本文", "c.md", "", "y")],
        "child_id string, corpus_id string, title string, heading_path string, text string, source_file string, taxanswer_no string, document_id string",
    )
    refs = spark.createDataFrame([("q", r) for r in ("No.4152", "1234567-001", "質疑応答 01/02", "質疑応答 01", "相続税法基本通達 3条", "倍率", "")], "question_id string, source_ref string")
    got = {}
    for r in E.evidence_candidates(refs, kids).collect():
        got.setdefault(r.source_ref, set()).add(r.child_id)
    assert got == {"No.4152": {"k1"}, "1234567-001": {"k2"}, "質疑応答 01/02": {"k2"}, "質疑応答 01": {"k2", "k3"}, "相続税法基本通達 3条": {"k4"}, "倍率": {"k3"}}


def test_citations(spark):
    schema = "answer_id long, answer string, sources array<struct<corpus_id:string,title:string,heading_path:string,document_id:string,taxanswer_no:string,source_file:string,source_url:string>>"

    def src(title, no=None):
        return ("c", title, None, None, no, f"f/{title}.md", None)

    two = [src("相続税の申告の手引き", "4205"), src("贈与税の申告の手引き", "4402")]
    df = spark.createDataFrame(
        [(1, "結論です[根拠1]。根拠２、３を参照", two), (2, "（②）と[9]", two), (3, "出典：贈与税の申告の手引き\n以上", two), (4, "なし", two), (5, "No.4205 のとおり", two), (6, "同じ題名の手引き資料", [src("同じ題名の手引き資料"), src("同じ題名の手引き資料")])], schema
    )
    numbered = {}
    for r in E.numbered_references(df).collect():
        numbered.setdefault(r.answer_id, set()).add(r.source_no)
    assert numbered == {1: {1, 2}, 2: {2}}
    assert [(r.answer_id, r.source_no) for r in E.title_references(E.quoted_titles(df), df).collect() if r.answer_id == 3] == [(3, 2)]
    direct = {(r.answer_id, r.source_no) for r in E.direct_references(df).collect()}
    assert (5, 1) in direct and not any(a == 6 for a, _ in direct)
    coverage = {r.answer_id: (r.cited, r.coverage) for r in E.citation_coverage(df).collect()}
    assert coverage[1] == (2, 1.0) and coverage[4] == (0, 0.0) and coverage[6] == (0, 0.0)


def test_golden_and_predictions(spark):
    golden = spark.createDataFrame(
        [("g1", "q one", "no_answer", [("a\\b\\c.md", "H", None)], ["x"]), (None, "q two", None, [], None)],
        "id string, input string, answer_type string, expected_sources array<struct<source_path:string,heading:string,evidence_quote:string>>, must_include array<string>",
    ).withColumn("row_no", F.monotonically_increasing_id())
    rows = {r.question: r for r in E.normalize_golden(golden).collect()}
    assert rows["q one"].expected_sources == "a\\b\\c.md | c.md | c | H" and rows["q one"].is_no_answer and rows["q one"].must_include_json == '["x"]'
    assert rows["q two"].question_id == "Q0002" and rows["q two"].must_include_json == "[]"


def test_tag_resume(spark):
    kids = spark.createDataFrame([("a", "t", "h", "x"), ("b", "t", "h", "y"), ("c", "t", "h", "z")], "child_id string, title string, heading_path string, text string")
    done = T.with_tags(kids.filter("child_id = 'a'"), F.array(F.lit("old"))).withColumn("tag_error", F.lit(None).cast("string"))

    def client(rows):
        return rows.select("child_id", F.lit('["n1","n1","n2"]').alias("reply"), F.when(F.col("child_id") == "c", "timeout").alias("tag_error"))

    got = {r.child_id: (r.search_tags, r.tag_error) for r in T.resume_tags(kids, done, client).collect()}
    assert got == {"a": (["old"], None), "b": (["n1", "n2"], None), "c": ([], "timeout")}
    codes = spark.range(1).select(T.code_tags(F.lit("TaxAnswer No.: ４１０２ と コード 12 と No.33-1"))).first()[0]
    assert codes == ["4102", "No.4102", "コード4102", "33-1", "No.33-1", "コード33-1"]


def test_terms_are_made_only_for_answers_that_quote_titles(spark):
    # every term of every answer was made and shuffled, for titles that few answers quote
    source = "struct<corpus_id:string,title:string,heading_path:string,document_id:string,taxanswer_no:string,source_file:string,source_url:string>"
    sources = [(None, f"Guide number {i}", None, None, None, f"files/g{i}.md", None) for i in (1, 2)]
    answers = spark.createDataFrame([(1, "根拠：Guide number 2", sources), (2, "none", sources)], f"answer_id long, answer string, sources array<{source}>")
    found = E.title_references(E.quoted_titles(answers), answers)
    assert [tuple(r) for r in found.collect()] == [(1, "Guide number 2", 2)]
    assert "LeftSemi" in found._jdf.queryExecution().optimizedPlan().toString()
    # the title stands for itself and for the heading: one term of the source
    terms = E.unique_terms(answers)
    assert "array_distinct" in terms._jdf.queryExecution().optimizedPlan().toString()
    assert {(r.answer_id, r.term, r.source_no) for r in terms.collect()} >= {(a, f"Guide number {i}", i) for a in (1, 2) for i in (1, 2)}
