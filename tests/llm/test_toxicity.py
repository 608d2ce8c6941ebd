"""Held-out accuracy, and the odd cases."""

import random
import zlib

from corpusloom.llm import nb_toxicity

DDL = "doc_id long, text string, toxic string, score int"
LABELS = "doc_id long, toxic int, quality int"


def corpus(n=900):
    rng = random.Random(3)
    words = ["".join(rng.choices("abcdefghij", k=rng.randint(2, 8))) for _ in range(400)]
    docs, labels = [], []
    for i in range(n):
        text = rng.choices(words, k=rng.choice([10, 80, 400]))
        bad = rng.random() < 0.2
        if bad:
            for _ in range(2):
                text.insert(rng.randrange(len(text)), rng.choice(["zonker", "Wuxxi", "qwyrm"]))
        docs.append((i, " ".join(text), "1", 0))
        if i % 10:
            labels.append((i, int(bad), 1))
    return docs, labels


def test_held_out_accuracy(spark):
    docs, labels = corpus()
    truth = {i: t for i, t, _ in labels}
    odd = [(5000, None, None, None), (5001, "", None, None), (5002, "x", None, None), (None, "no id", None, None), docs[3]]
    got = nb_toxicity.score(spark.createDataFrame(docs + odd, DDL), spark.createDataFrame(labels + [(None, 1, 0), (7, None, 0), labels[0]], LABELS)).collect()
    assert len(got) == len(docs) + len(odd)
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert len(held) > 100 and sum(r.predicted == truth[r.doc_id] for r in held) >= 0.97 * len(held)
    for r in got:
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)
        assert r.doc_id not in (5000, 5001, 5002, None) or not r.predicted


def test_held_out_labels_do_not_matter(spark):
    docs, labels = corpus(300)
    turned = [(d, 1 - t if zlib.crc32(str(d).encode()) % 5 == 0 else t, q) for d, t, q in labels]
    frame = spark.createDataFrame(docs, DDL)
    a, b = (nb_toxicity.score(frame, spark.createDataFrame(x, LABELS)).orderBy("doc_id").collect() for x in (labels, turned))
    assert [r.predicted for r in a] == [r.predicted for r in b]


def test_few_labels_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a", "", 0)], DDL)
    for labels in ([], [(1, 0, 0)], [(2, 1, 0)]):
        assert nb_toxicity.score(docs, spark.createDataFrame(labels, LABELS)).count() == 1
    assert nb_toxicity.score(spark.createDataFrame([], DDL), spark.createDataFrame([(1, 1, 1)], LABELS)).count() == 0
