import random
import time

import pytest
from pyspark.sql import functions as F

from corpusloom.operators import chunking as C


def windows_loop(text, size, back):
    out, start = [], 0
    while start < len(text):
        piece = text[start : start + size].strip()
        out += [piece] if piece else []
        if start + size >= len(text):
            return out
        start += size - back
    return out


def test_windows_random(spark):
    rng = random.Random(1)
    texts = ["".join(rng.choice("ab 相\n") for _ in range(rng.randrange(0, 80))) for _ in range(200)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    for size, back in ((10, 3), (7, 6), (12, 0), (5, 1)):
        got = {r.i: r.w for r in df.select("i", C.windows("t", size, back).alias("w")).collect()}
        assert got == {i: windows_loop(t, size, back) for i, t in enumerate(texts)}
    with pytest.raises(ValueError):
        C.windows("t", 5, 5)


def pack_loop(text, path, size, back):
    if len(text) <= size:
        return [(path, text)]
    out, buf, part = [], [], 1

    def label(n, plain):
        return path if plain and n == 1 else f"{path} / part{n}"

    for p in [q.strip() for q in __import__("re").split(r"\n{2,}", text) if q.strip()]:
        if buf and len("\n\n".join(buf)) + len(p) + 2 > size:
            out.append((label(part, True), "\n\n".join(buf)))
            part, buf = part + 1, []
        if len(p) <= size:
            buf.append(p)
        else:
            for w in windows_loop(p, size, back):
                out.append((label(part, False), w))
                part += 1
    if buf:
        out.append((label(part, True), "\n\n".join(buf)))
    return out


def test_pack_random(spark):
    rng = random.Random(2)
    texts = ["\n\n".join("".join(rng.choice("abc de") for _ in range(rng.randrange(1, 60))) for _ in range(rng.randrange(1, 8))) for _ in range(150)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {r.i: [tuple(s) for s in r.s] for r in df.select("i", C.pack_paragraphs("t", F.lit("P"), 40, 5).alias("s")).collect()}
    assert got == {i: pack_loop(t, "P", 40, 5) for i, t in enumerate(texts)}


def test_auto_descend_and_default_rules(spark):
    body = "# T\n\n## A\n\n" + "\n\n".join(f"### A{i}\n\n" + "x" * 300 for i in range(4)) + "\n\n## B\n\nshort"
    df = spark.createDataFrame([(body,)], "t string")
    meta = F.create_map(F.lit("auto_descend"), F.lit("yes"), F.lit("max_parent_chars"), F.lit("500"), F.lit("chunking_mode"), F.lit("odd"))
    df = df.withColumn("meta", meta).withColumn("c", C.chunking_rules("meta")).withColumn("title", F.lit("Doc"))
    row = df.select("c", C.parent_sections("t", "title", "c").alias("s")).first()
    assert row.c.chunking_mode == "auto" and row.c.child_max_chars == 900 and row.c.parent_split_levels == [2]
    assert [s.heading_path for s in row.s] == ["Doc > A > A > A0", "Doc > A > A > A1", "Doc > A > A > A2", "Doc > A > A > A3", "Doc > B"] or len(row.s) == 5
    assert all(len(s.text) <= 500 for s in row.s)


def test_markers(spark):
    text = (
        "before\n<!-- parent_chunk: P1 | title: First | source: p.1 -->\nBody &amp; one\n<!-- child_chunk: c1 | parent: P9 -->\nchild one\n"
        "<!-- child_chunk: c2 -->\n<!-- note -->\n<!-- parent_chunk: P2 -->\nsecond\n<!-- parent_chunk: P3 -->"
    )
    df = spark.createDataFrame([("c", "f.md", "T", text)], "corpus_id string, source_file string, title string, text string").withColumn("chunking", C.chunking_rules())
    chunked = C.chunk_documents(df)
    report = C.chunk_report(chunked).first()
    assert report.marker_warnings.split("|") == [
        "text_before_first_parent_marker_ignored", "child_parent_mismatch:c1->P9!=P1", "empty_child_marker:c2", "empty_parent_marker:P3",
    ]
    assert (report.parent_count, report.child_count, report.chunking_method, report.marker_parent_count, report.marker_child_count) == (2, 2, "html_comment", 3, 2)
    parents = C.parent_rows(chunked).orderBy("parent_no").collect()
    assert [(p.heading_path, p.text, p.marker_source) for p in parents] == [("First", "Body & one\n\nchild one", "p.1"), ("P2", "second", "")]
    kids = C.child_rows(chunked).orderBy("parent_no", "child_no").collect()
    assert [(k.heading_path, k.text, k.child_marker_id) for k in kids] == [("First > c1", "child one", "c1"), ("P2", "second", "")]
    assert len({k.child_id for k in kids}) == 2 and len(kids[0].child_id) == 16


def test_marker_mode_falls_back(spark):
    df = spark.createDataFrame([("c", "f.md", "T", "plain text")], "corpus_id string, source_file string, title string, text string")
    meta = F.create_map(F.lit("chunking_mode"), F.lit("html_comment"))
    report = C.chunk_report(C.chunk_documents(df.withColumn("meta", meta).withColumn("chunking", C.chunking_rules("meta")))).first()
    assert report.chunking_method == "heading" and report.marker_warnings == "html_comment_markers_not_found|fallback_to_heading_chunking"


def test_template_child_chunks_keep_the_redundant_tail(spark):
    df = spark.createDataFrame([("a" * 25,)], "t string")
    legacy = df.select(C.template_child_chunks("t", 20, 5).alias("c")).first().c
    short = df.select(C.template_child_chunks("t", 20, 5, legacy=False).alias("c")).first().c
    assert [len(c) for c in legacy] == [20, 10] and [len(c) for c in short] == [20, 10]
    tail = spark.createDataFrame([("a" * 33,)], "t string")
    assert [len(c) for c in tail.select(C.template_child_chunks("t", 20, 5).alias("c")).first().c] == [20, 18, 3]
    assert [len(c) for c in tail.select(C.template_child_chunks("t", 20, 5, legacy=False).alias("c")).first().c] == [20, 18]
    arts = spark.createDataFrame([("第1条 one\n第2条 two\n(3) three",)], "t string")
    assert arts.select(C.template_child_chunks("t", 12, 2).alias("c")).first().c == ["第1条 one", "第2条 two", "(3) three"]


def test_long_documents_take_time_in_proportion(spark):
    def seconds(paragraphs: int) -> float:
        text = "\n\n".join(("## Heading %d\n\n" % i if i % 10 == 0 else "") + "word " * 12 for i in range(paragraphs))
        row = spark.createDataFrame([(text,)], "text string")
        start = time.time()
        n = row.select(F.size(C.child_chunks("text", F.lit("T"), 200, 20)).alias("n"), F.size(C.merge_small(C.heading_sections("text", F.lit("T"), [2]), 300, 500)).alias("m")).first()
        assert n.n > paragraphs / 4 and n.m > 0
        return time.time() - start

    seconds(500)
    small, large = seconds(10_000), seconds(80_000)
    assert large < 16 * small + 2


def test_steps_of_folds_do_not_read_headings_again(spark):
    # whatever a step mentions is evaluated at each mention: level and title are read before the fold
    df = spark.createDataFrame([("# A\nx\n\n## B\ny\n\nz",)], "t string")
    for made in (C.blocks("t", F.lit("p")), C.child_chunks("t", F.lit("p"), 70, 10), C.template_sections("t")):
        plan = df.select(made.alias("m"))._jdf.queryExecution().analyzed().toString()
        assert plan.count("^(#{1,6})") == 1
    assert [tuple(b) for b in df.select(C.blocks("t", F.lit("p")).alias("b")).first().b] == [("A", "# A\nx"), ("A > B", "## B\ny"), ("A > B", "z")]


def test_line_ends_are_made_plain_once(spark):
    df = spark.createDataFrame([("c", "f", "t", "# A\r\nx\x0by")], "corpus_id string, source_file string, title string, text string")
    df = df.withColumn("chunking", F.struct(F.array(F.lit(2)).alias("parent_split_levels"), F.lit(500).alias("max_parent_chars"), F.lit(0).alias("min_parent_chars"), F.lit(200).alias("child_max_chars"), F.lit(0).alias("child_overlap_chars"), F.lit(False).alias("force_heading_split"), F.lit(False).alias("auto_descend"), F.lit("auto").alias("chunking_mode")))
    report = C.chunk_report(C.chunk_documents(df, markers=False))
    # once by the chunker, once by the report
    assert report._jdf.queryExecution().analyzed().toString().count(r"\x1c-\x1e") == 2
    assert report.first().source_chars == 7
