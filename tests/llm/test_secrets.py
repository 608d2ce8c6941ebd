"""Secrets planted in prose, decoys, and the odd cases."""

import random

import numpy as np

from corpusloom.llm import secret_forest

DDL = "doc_id long, text string, masked string"


def corpus(n=400):
    rng = random.Random(8)
    words = ["".join(rng.choices("abcdefghijklm", k=rng.randint(3, 9))) for _ in range(300)]
    prose = lambda k: " ".join(rng.choices(words, k=k))
    hexa = lambda k: "".join(rng.choices("0123456789abcdef", k=k))
    upper = lambda k: "".join(rng.choices("ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", k=k))
    rows, truth = [], {}
    for i in range(n):
        kind = i % 5
        s = ["AKIA" + upper(16), "password=" + hexa(18) + "1a", 'token = "' + hexa(38) + '7b"', str(rng.randrange(10**15, 10**16)), "commit " + hexa(39) + "2"][kind]
        rows.append((i, f"{prose(12)} {s} {prose(8)}", ""))
        truth[i] = kind < 3
    return rows, truth


def test_secrets_and_decoys(spark):
    rows, truth = corpus()
    odd = [(9000, None, ""), (9001, "", ""), (9002, "plain words only", ""), (None, "token = abcdef12345678", ""), rows[0]]
    got = secret_forest.find(spark.createDataFrame(rows + odd, DDL)).collect()
    assert len(got) == len(rows) + len(odd)
    for r in got:
        if r.doc_id in truth:
            assert bool(r.secrets) == truth[r.doc_id], (r.doc_id, r.masked)
            assert ("[SECRET]" in r.masked) == truth[r.doc_id]
    assert [r.masked for r in got if r.doc_id == 9000] == [""]


def test_given_findings(spark):
    rows, truth = corpus(200)
    docs = spark.createDataFrame(rows, DDL)
    marks = [(i, s, e, int(truth[i])) for i, t, _ in rows if i % 2 for s, e, _ in secret_forest.candidates(t)]
    got = secret_forest.digests(docs, spark.createDataFrame(marks + [(None, 1, 2, 1)], "doc_id long, start int, end int, secret int")).collect()
    assert sum(bool(r.n_secrets) == truth[r.doc_id] for r in got) >= 195


def test_one_class_and_empty(spark):
    assert secret_forest.digests(spark.createDataFrame([(1, "a 1234567890123456 b", "")], DDL)).collect()[0].n_secrets == 0
    assert secret_forest.digests(spark.createDataFrame([], DDL)).count() == 0


def test_dictionary_does_not_depend_on_tasks(spark, monkeypatch):
    rows = [(i, "some words stand once in every text of ours" + " seldom" * (i < 2), "") for i in range(24)]
    docs = spark.createDataFrame(rows, DDL)
    one, many = secret_forest.corpus_of(docs.coalesce(1)), secret_forest.corpus_of(docs.repartition(24))
    assert one.words == many.words == {"some", "words", "stand", "once", "every", "text", "ours"}
    assert (one.pairs == many.pairs).all()
    monkeypatch.setattr(secret_forest, "TABLE", 1)
    assert secret_forest.corpus_of(docs.repartition(6)).words == one.words


def test_candidates_are_judged_as_a_whole():
    known = secret_forest.Corpus({"plain", "words"}, np.zeros((28, 28)))
    start = "plain/words/" * 40
    ends = ["plain/words/" * 5, "9fK2x7Qz1LmP4vT8bN3wRc6YdH5sJ0gAeUiOoXqZkVtBnMwLrPyC"]
    a, b = (secret_forest.features(start + e, 0, len(start + e), "", known) for e in ends)
    assert all(a[k] != b[k] for k in (1, 2, 3, 4, 6, 7, 8, 9))
    assert secret_forest.features("a" * 400 + "x", 0, 401, "", known)[10] == 0


def test_assignments_within_longer_values():
    found = lambda text: [(text[s:e], name) for s, e, name in secret_forest.candidates(text)]
    key = "9fK2x7Qz1LmP4vT8"
    assert found(f"see https://host/v1?token={key} there") == [(f"//host/v1?token={key}", "https"), (key, "token")]
    assert (key, "api_key") in found(f'url = "http://h/1?user=me&api_key={key}&page=2&secret=short"')
    assert found(f"password=ab{key}") == [(f"ab{key}", "password")]
    assert found(f"note:12345678password: {key}") == [("12345678password:", "note"), (key, "password")]
    text = f"get https://host/v1?x=1&token={key}&y=2 now"
    forest = type("", (), {"score": lambda self, x: x[17]})()
    spans = [c[:2] for c in secret_forest.decide(text, secret_forest.Corpus(set(), np.zeros((28, 28))), forest) if c[2] >= 0.5]
    assert secret_forest.masked(text, spans) == "get https://host/v1?x=1&token=[SECRET]&y=2 now"
    assert len(secret_forest.candidates("url=1" + "token=" * 50_000)) == 2


def test_long_tokens_are_linear():
    text = "a1" * 200_000 + " key=" + "b2" * 50_000
    assert len(secret_forest.candidates(text)) == 2
