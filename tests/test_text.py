import tracemalloc
from datetime import date

import pyarrow as pa
from pyspark.sql import functions as F

from corpusloom.functions import text as X
from corpusloom.functions import unicode
from corpusloom.functions import values as V
from corpusloom.operators import documents as D
from corpusloom.operators import pages as P
from corpusloom.operators.search import validity_status


def one(spark, *columns):
    return tuple(spark.range(1).select(*columns).first())


def test_normal_forms(spark):
    q, key, refs = one(
        spark, X.normalize_question(F.lit("　Ｎｏ． 4102 の　相続税 ーー ですか ？ STRASSE ß")), X.reference_key(F.lit("「Ａ－b」 (1)")),
        X.number_references(F.lit("No.4102とコード 123、タックス アンサー1234 NO4102")),
    )
    assert q == "no4102 の 相続税 - ですか?strasse ss"
    assert key == "ab1"
    assert sorted(refs) == ["123", "1234", "4102"]


def test_clean_markup(spark):
    raw = "<!-- note -->## 親チャンク候補: Head  \nA<br/>B &lt;b&gt; <i>x</i>\n\n\n\nEnd"
    assert one(spark, X.clean_markup(F.lit(raw)))[0] == "## Head\nA\nB <b> x\n\nEnd"
    assert one(spark, X.clean_markup_items(F.array(F.lit("<b>a</b>&amp;"), F.lit("c"))))[0] == ["a&", "c"]


def test_values(spark):
    out = one(
        spark, V.safe_int(F.lit("x"), 7), V.safe_int(F.lit(" 3 "), 0, 5), V.safe_float(F.lit("1.5")), V.ratio(F.lit(1), F.lit(0)), V.null_if_blank(F.lit('"なし"')),
        V.release_slug(F.lit(" a//b__c ")), V.name_uuid(F.lit("abc")), V.json_strings(F.lit("not json")), V.fenced_json(F.lit('```json\n["a"]\n```')), X.truncate(F.lit("abcdef"), 3),
    )
    import uuid

    assert out == (7, 5, 1.5, 0.0, None, "a_b_c", str(uuid.uuid5(uuid.NAMESPACE_URL, "abc")), [], '["a"]', "abc\n...[truncated 3 chars]")


def test_front_matter_dialects(spark):
    raw = '---\ntitle: "A \\"q\\""\nkey: 1\nkey: 2\nnote\n---\n\nBody'
    df = spark.createDataFrame([(raw,), ("no header",), ("---\nopen: 1\nnever closed",)], "text string")
    rows = D.parse_front_matter(df).collect()
    assert rows[0].meta == {"title": 'A "q"', "key": "2"} and rows[0].text == "Body"
    assert rows[1].meta == {} and rows[1].text == "no header"
    assert rows[2].meta == {} and rows[2].text.startswith("---")
    strict = spark.createDataFrame([("<!-- c -->\n\n---\na: 'x: y'\n# skip: 1\n---\nrest",)], "text string")
    row = D.parse_front_matter(strict, dialect="strict").first()
    assert row.meta == {"a": "x: y"} and row.text == "rest"
    js = spark.createDataFrame([('---\na: "x\\u3042"\nn: 5\nt: plain\n---\nz',)], "text string")
    assert D.parse_front_matter(js, dialect="json").first().meta == {"a": "xあ", "n": "5", "t": "plain"}


def test_render_front_matter_round_trip(spark):
    df = spark.createDataFrame([({"zeta": "1", "title": 'a "b" \\', "source_url": "u"}, "\nBody")], "meta map<string,string>, body string")
    out = df.select(D.render_front_matter("meta", "body").alias("text"))
    assert out.first().text.startswith('---\ntitle: "a \\"b\\" \\\\"\nsource_url: "u"\nzeta: "1"\n---\n\nBody')
    assert D.parse_front_matter(out).first().meta["title"] == 'a "b" \\'


def test_register_documents(spark):
    schema = "corpus_id string, filename string, title string, document_id string, document_type string, valid_from string, valid_until string, registered_by string, markdown_text string"
    rows = D.register_documents(
        spark.createDataFrame([("c", None, "My Title", None, None, "2024-01-01", None, None, "---\na: 1\n---\nText\n"), ("", "x.md", None, None, None, "bad", "2024-01-01", None, "")], schema)
    ).collect()
    assert (rows[0].filename, rows[0].document_id, rows[0].document_type, rows[0].text, rows[0].errors) == ("my_title.md", "my_title", "manual", "Text", [])
    assert rows[1].errors == ["corpus_id is required", "markdown_text is required", "valid_from must be YYYY-MM-DD"]


def test_upsert_corpora(spark):
    schema = "corpus_id string, markdown_dir string, display_name string, description string, enabled boolean, priority int"
    old = spark.createDataFrame([("a", "dir/a", "A", "d", False, 5)], schema)
    new = spark.createDataFrame([("a", None, "A2", None, None, None), ("B b", None, None, None, None, None)], schema)
    rows = {r.corpus_id: r for r in D.upsert_corpora(old, new).collect()}
    assert tuple(rows["a"])[1:] == ("dir/a", "A2", "d", False, 5)
    assert tuple(rows["B b"])[1:] == ("data/markdown/b_b", "B b", "", True, 100)


def test_pdf_titles(spark):
    def title(first, meta=None):
        return one(spark, P.infer_document_title(F.lit(first), F.lit(meta), F.lit("fallback")))[0]

    assert title("x", "Good title") == "Good title"
    assert title("12\n\n- 相続税の取扱い\nについて（情報）\nmore", "0012345-678") == "相続税の取扱いについて（情報）"
    assert title("国 税 庁\nrest", "scan.pdf") == "fallback"
    assert title("First\nSecond\n\nThird") == "FirstSecond"


def test_page_parts(spark):
    html = '<h1>T &amp; x</h1><img src="a" alt="pic"><table><tr><th>A</th><td>b</td></tr></table><ul><li>one</li></ul><script>no()</script><p>お問い合わせ先</p><p>after</p>'
    md = one(spark, P.html_to_markdown(F.lit(html)))[0]
    assert md.splitlines()[0] == "# T & x" and "[画像: pic]" in md and "A | b |" in md and "- one" in md and "no()" not in md
    trimmed = one(spark, P.trim_main(F.lit("nav\n" + md)))[0]
    assert trimmed.startswith("# T & x") and "after" not in trimmed
    assert one(spark, P.law_basis_date(F.lit("x [令和5年4月1日現在法令等] y")))[0] == "令和5年4月1日現在法令等"
    assert one(spark, P.as_of_date_note(F.lit("令和５年４月１日現在")))[0] == "令和５年４月１日現在"


def test_resolve_url(spark):
    base = F.lit("https://h.example/a/b/c.htm?q=1")
    cases = {"d.htm": "https://h.example/a/b/d.htm", "/x": "https://h.example/x", "../y.htm#z": "https://h.example/a/y.htm", "//o.example/k": "https://o.example/k", "http://e.example/": "http://e.example/", "#t": "https://h.example/a/b/c.htm?q=1"}
    got = one(spark, *[P.resolve_url(base, F.lit(h)) for h in cases])
    assert dict(zip(cases, got)) == cases


def test_validity(spark):
    def status(a, b):
        return one(spark, validity_status(F.lit(a), F.lit(b), "2024-06-30"))[0]

    assert [status("", None), status("2024-07-01", ""), status("", "2024-06-29"), status("2024-06-30", "2024-06-30"), status("x", ""), status("2024-02-01", "2024-01-01")] == [
        "unbounded", "not_started", "expired", "current", "invalid_period", "invalid_period",
    ]
    assert date(2024, 6, 30)


def test_a_batch_of_pages_is_decoded_in_parts():
    # all texts of a batch, and all results, were Python objects at once
    values = pa.array([None, "", "&amp;amp;\n&lt;"] + [f"{i} &amp; " + "x" * 4000 for i in range(3000)])
    tracemalloc.start()
    found = unicode._each(values, unicode._unescape_lines)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 6e6 < values.nbytes / 2
    assert found.to_pylist() == [None if v is None else unicode._unescape_lines(v) for v in values.to_pylist()]
    assert unicode._each(pa.array([], pa.string()), str).type == pa.string()


def test_white_space_in_lines_and_tags_in_mixed_case(spark):
    spaces = X.WHITESPACE_CHARS.replace("\n", "")
    text = "".join(f"{c}a{c}{c}b{c}\n{c}\n" for c in spaces) + "​\xe9᠎ \n"
    rows = F.transform(F.split(F.lit(text), "\n", -1), X.squeeze)
    assert one(spark, X.squeeze_lines(F.lit(text))) == one(spark, X.strip(F.array_join(rows, "\n")))
    ends = "a\r\nb\rc\n\rd\x0b\ne\x0cf\x1cg\x1dh\x1ei\x1fj\x85k l m\r\r\nn"
    assert one(spark, X.unix_newlines(F.lit(ends)))[0] == "a\nb\nc\n\nd\n\ne\nf\ng\nh\ni\x1fj\nk\nl\nm\n\nn"
    html = "<H2 x>T</h2><uL><Li>p<lI a>q</LI></ul><tR><tD>1</Td><TH>2</tH></tr>\r\rx\r\n\n\ny<iMg aLt='z'>"
    assert one(spark, P.html_to_markdown(F.lit(html)))[0] == "## T\n\n- p\n- q\n\n1 | 2 |\n\nx\n\ny\n[画像: z]"


def test_references_that_a_semicolon_ends():
    raw = "&quot &quot; &amp &amp; &lt;b&gt; &#65; &#x42; &#67 &notit; &copy2 &CounterClockwiseContourIntegral;"
    assert unicode._decode_ended(raw) == '&quot " & & <b> A B &#67 &notit; &copy2 ∳'
    assert unicode._unescape_lines("&amp;quot\n&amp;quot;", unicode._decode_ended) == '&quot\n"'
