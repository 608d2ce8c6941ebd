import os
import tempfile
import threading
from collections import Counter
from pathlib import Path

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom import schemas as Z
from corpusloom.functions import clients
from corpusloom.operators import chunking as C
from corpusloom.operators import logs as L
from corpusloom.operators import search as S
from corpusloom.plans.logs import ask_logs
from corpusloom.sources import commits, documents, readers, writers
from corpusloom.streaming import streams

SF = "/root/testdata/sf0.001"


def folder() -> str:
    return tempfile.mkdtemp(prefix="spark-")


def test_json_and_csv_scans(spark):
    base = Path(folder())
    (base / "a.jsonl").write_text('{"k": "1"}\n\n  \n{"k": "2", "z": 1}\n', encoding="utf-8")
    (base / "b.csv").write_text('﻿name,note\nx,"two\nlines ""q"""\n', encoding="utf-8")
    k = T.StructType([T.StructField("k", T.StringType())])
    assert sorted(r.k for r in readers.read_jsonl(spark, str(base / "a.jsonl"), k).filter("k is not null").collect()) == ["1", "2"]
    assert readers.read_jsonl(spark, str(base / "none.jsonl"), k).count() == 0
    schema = T.StructType([T.StructField("name", T.StringType()), T.StructField("note", T.StringType())])
    rows = readers.read_csv(spark, str(base / "b.csv"), schema).collect()
    assert [(r.name, r.note) for r in rows] == [("x", 'two\nlines "q"')]
    assert readers.newer_of(spark, str(base / "none"), str(base / "a.jsonl")).endswith("a.jsonl")


def test_markdown_scan_and_forms(spark):
    root = Path(folder())
    for name in ("one/a.md", "one/sub/b.md", "two/c.md", "one/skip.txt", "forms/01_申請書（旧）.xlsx", "forms/x.pdf"):
        path = root / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(f"# {name}\nline", encoding="utf-8")
    corpora = spark.createDataFrame([("c1", "one/", True), ("c2", "two", False)], "corpus_id string, markdown_dir string, enabled boolean")
    got = sorted((r.corpus_id, r.source_file) for r in readers.read_markdown(spark, str(root), corpora).collect())
    assert got == [("c1", "one/a.md"), ("c1", "one/sub/b.md")]
    forms = readers.form_catalog(spark, str(root / "forms")).collect()
    assert [(f.form_name, f.file_type) for f in forms] == [("申請書", "xlsx")]


def test_sinks(spark):
    base = folder()
    a, b = spark.createDataFrame([(1, "x")], "id long, a string"), spark.createDataFrame([(2, "y")], "id long, b string")
    writers.write_csv([a, b], base + "/u")
    assert sorted(tuple(r) for r in spark.read.option("header", True).csv(base + "/u").select("id", "a", "b").collect()) == [("1", "x", None), ("2", None, "y")]
    for release, n in (("r1", 3), ("r2", 2), ("r1", 1)):
        writers.write_release(spark.range(n).withColumn("v", F.lit(1)), base + "/index", release)
    counts = {r.release_id: r["count"] for r in spark.read.parquet(base + "/index").groupBy("release_id").count().collect()}
    assert counts == {"r1": 1, "r2": 2}
    logs = ask_logs(spark, SF)
    writers.append_logs(logs, base + "/logs")
    writers.append_logs(logs, base + "/logs")
    assert spark.read.parquet(base + "/logs").count() == 2 * logs.count()
    child = spark.createDataFrame([("k", 7, None)], "child_id string, meeting_id int, slide_no int")
    assert tuple(child.select(*writers.payload_columns(child)).first()) == ("k", "7", 0)
    writers.replace_jsonl(a, base + "/json")
    writers.replace_jsonl(b, base + "/json")
    assert spark.read.schema("id long").json(base + "/json").first().id == 2
    assert readers.read_table(spark, base + "/nothing", Z.ASK_LOGS).count() == 0


def test_clients(spark):
    df = spark.createDataFrame([(i, f"text {i}") for i in range(70)], "id long, text string").repartition(3)
    vectors = clients.embed(df, "id", "text", clients.hashing_vectors(16)).collect()
    assert len(vectors) == 70 and all(len(r.embedding) == 16 and r.error is None for r in vectors)

    def failing(items):
        raise RuntimeError("down")

    bad = clients.complete(df, "id", "text", failing, retries=1, pause=0.0).collect()
    assert len(bad) == 70 and {r.error for r in bad} == {"down"} and {r.reply for r in bad} == {None}
    scores = clients.rerank(df.withColumn("q", F.lit("text 1")), "id", "q", "text", lambda pairs: [float(q == d) for q, d in pairs]).filter("rerank_score > 0").collect()
    assert [r.id for r in scores] == [1]


def test_stream_equals_batch(spark):
    base = folder()
    logs = ask_logs(spark, SF)
    logs.repartition(4).write.parquet(base + "/in")
    schema = spark.read.parquet(base + "/in").schema
    stream = spark.readStream.schema(schema).parquet(base + "/in")
    streams.append_stream(streams.windowed_metrics(stream, "1 day"), base + "/out", base + "/cp").awaitTermination(120)
    got = {str(r.window_start)[:10]: (r.questions, r.no_hit, r.low_confidence) for r in spark.read.parquet(base + "/out").collect()}
    want = {str(r.date): (r.questions, r.no_hit, r.low_confidence) for r in L.daily_quality(logs, "2024-01-31 00:00:00", 40).collect() if r.questions}
    # the last window stays open until the watermark passes it
    assert got and all(want[d] == v for d, v in got.items()) and len(want) - len(got) <= 1


def test_duplicate_deliveries(spark):
    base = folder()
    logs = ask_logs(spark, SF)
    logs.unionByName(logs).coalesce(1).write.parquet(base + "/in")
    stream = spark.readStream.schema(spark.read.parquet(base + "/in").schema).parquet(base + "/in")
    streams.append_stream(streams.first_deliveries(stream), base + "/out", base + "/cp").awaitTermination(120)
    assert spark.read.parquet(base + "/out").count() == logs.count()


def landing(spark, base, *files):
    """One file of landed documents per call: (name, body, landed at, deleted)."""
    rows = [("c", name, "T", f"# H\n\n{body}", at, gone) for name, body, at, gone in files]
    schema = "corpus_id string, source_file string, title string, text string, at long, gone boolean"
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(base + "/in")
    stream = spark.readStream.schema(schema).parquet(base + "/in")
    prepare = lambda d: d.withColumn("chunking", C.chunking_rules())
    streams.ingest_documents(stream, prepare, base + "/out", base + "/cp", newest_by="at", deleted="gone").awaitTermination(120)
    return {r.source_file: r.text.split("\n")[-1] for r in documents.read_documents(spark, base + "/out").collect()}


def test_changed_and_deleted_documents_are_replaced(spark):
    base = folder()
    assert landing(spark, base, *[(f"f{i}.md", f"body {i}", 1, False) for i in range(5)]) == {f"f{i}.md": f"body {i}" for i in range(5)}
    got = landing(spark, base, ("f1.md", "early", 2, False), ("f1.md", "late", 3, False), ("f2.md", None, 2, True), ("f3.md", "body 3", 2, False), ("f9.md", None, 2, True))
    want = {"f0.md": "body 0", "f1.md": "late", "f3.md": "body 3", "f4.md": "body 4"}
    assert got == want
    manifest = {r.doc_key: (r.deleted, r.version) for r in documents.read_manifest(spark, base + "/out").collect()}
    assert manifest['["c","f2.md"]'] == (True, 2) and manifest['["c","f3.md"]'] == (False, 1) and len(manifest) == 5
    # a deleted document may come back, and an older snapshot stays readable
    assert landing(spark, base, ("f2.md", "again", 4, False)) == want | {"f2.md": "again"}
    assert documents.read_documents(spark, base + "/out", 1).count() == 5


def test_a_batch_that_runs_again_changes_nothing(spark):
    base = folder()
    rows = lambda body: spark.createDataFrame([("c", "a.md", body), ("c", "b.md", "same")], "corpus_id string, source_file string, text string")
    put = lambda body, number: documents.replace_documents(rows(body), base, lambda d: d, number=number)
    assert [put("one", 0), put("one", 0), put("two", 0), put("two", 1), put("two", 2)] == [1, 1, 1, 2, 3]
    assert sorted(r.text for r in documents.read_documents(spark, base).collect()) == ["same", "two"]
    for i in range(3, documents.MERGE_AFTER + 4):
        put(f"n{i}", i)
    assert sorted(r.text for r in documents.read_documents(spark, base).collect()) == [f"n{i}", "same"]


def test_two_writers_lose_no_transition(spark):
    log = folder() + "/releases"
    schema = "release_id string, corpus_version string, index_version string, collection_name string, status string, row_count long, embedding_size long, error string"

    def writer(name: str) -> None:
        for n in range(3):
            new = spark.createDataFrame([(name, f"v{n}", "x")], "corpus_version string, index_version string, collection_name string")
            release = f"{name}_v{n}"
            commits.update_table(spark, log, schema, lambda t: S.begin_release(t, new))
            commits.update_table(spark, log, schema, lambda t: S.finish_release(t, release, 1, 8))
            commits.update_table(spark, log, schema, lambda t: S.activate_release(t, release))

    threads = [threading.Thread(target=writer, args=(name,)) for name in ("a", "b")]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    states = {r.release_id: r.status for r in commits.read_state(spark, log, schema).collect()}
    assert set(states) == {f"{w}_v{n}" for w in "ab" for n in range(3)}
    assert sorted(states.values()) == ["active"] + ["archived"] * 5
    assert commits.newest(spark, log)[0] == 18


def test_put_if_absent(spark):
    log = folder() + "/log"
    assert commits.newest(spark, log) == (0, None)
    assert commits.put_if_absent(spark, log, 1, {"a": "é"}) and not commits.put_if_absent(spark, log, 1, {"a": 2})
    assert commits.newest(spark, log) == (1, {"a": "é"})
    assert commits.update(spark, log, lambda e: None) == 1
    with pytest.raises(commits.Lost):
        commits.update(spark, log, lambda e: commits.put_if_absent(spark, log, commits.newest(spark, log)[0] + 1, {}) and {}, tries=2)


def test_windowed_counts_equal_batch_with_late_rows(spark):
    base = folder()
    schema = "created_at string, kind string"
    rows = [(f"2024-01-01 {h:02d}:{m:02d}:00", "ab"[m % 2]) for h in range(6) for m in range(0, 60, 7)]
    late_ok, too_late = ("2024-01-01 04:50:00", "a"), ("2024-01-01 00:10:00", "a")
    for part in (rows, [late_ok, too_late], [("2024-01-01 09:00:00", "b")], [("2024-01-02 00:00:00", "b")]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(base + "/in")
        stream = spark.readStream.schema(schema).parquet(base + "/in")
        counted = streams.windowed_counts(stream, "created_at", "1 hour", "1 hour", "kind")
        streams.append_stream(counted, base + "/out", base + "/cp").awaitTermination(120)
    got = {(str(r.window_start), r.kind): r.questions for r in spark.read.parquet(base + "/out").collect()}
    want = Counter((t[:13] + ":00:00", k) for t, k in [*rows, late_ok, ("2024-01-01 09:00:00", "b")])
    assert got == want


def test_source_manifest_of_nested_folders(spark):
    base = Path(folder())
    derived, original = base / "derived", base / "original"
    for root, day in ((original, "1"), (derived, "2")):
        (root / "lang=en" / "part=a").mkdir(parents=True)
        (root / "top.md").write_text("top " + day)
        (root / "lang=en" / "part=a" / "deep.md").write_text("deep " + day)
    (original / "only.md").write_text("only")
    for path, at in ((original / "top.md", 500), (derived / "top.md", 400), (original / "lang=en/part=a/deep.md", 300), (derived / "lang=en/part=a/deep.md", 600), (original / "only.md", 200)):
        os.utime(path, (at, at))
    assert readers.newest_change(spark, str(original)) == 500_000 and readers.newest_change(spark, str(derived)) == 600_000
    assert readers.newest_change(spark, str(base / "none")) == -1 and readers.newest_change(spark, str(original / "top.md")) == 500_000
    assert readers.newer_of(spark, str(derived), str(original)) == str(derived)
    picked = {r.file: r.path for r in readers.newest_files(spark, str(derived), str(original), "*.md").collect()}
    assert picked == {"top.md": f"{original}/top.md", "lang=en/part=a/deep.md": f"{derived}/lang=en/part=a/deep.md", "only.md": f"{original}/only.md"}
    before = spark.createDataFrame(readers.source_manifest(spark, str(original), contents=True).collect())
    (original / "lang=en" / "part=a" / "deep.md").write_text("new text")
    (original / "lang=en" / "more.md").write_text("more")
    os.utime(original / "top.md", (900, 900))  # touched, with the same content
    (original / "only.md").unlink()
    changes = readers.changed_files(before, readers.source_manifest(spark, str(original), contents=True))
    assert {r.file: r.change for r in changes.collect()} == {"lang=en/part=a/deep.md": "changed", "lang=en/more.md": "added", "only.md": "removed"}
    assert readers.source_manifest(spark, str(base / "none")).count() == 0
