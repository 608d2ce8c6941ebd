"""Encoding and packing against the tokenizers library and against counting."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from corpusloom.llm import best_fit, bpe_concat

DDL = "doc_id long, text string, ids string, n_chars long"


@pytest.fixture(scope="module")
def exact():
    return Tokenizer.from_file(bpe_concat.default_path())


def tricky() -> list:
    rng = random.Random(5)
    letters = "abcdefghéèñ'.,!?-_0123 \n\tABCÉİΣßＡ中é<|"
    texts = [None, "", " ", "a" * 5000, "ab" * 3000, "it's <|endoftext|> don't!!'t", "x\x1cy z", " İstanbul ΣΑΣ ﬁ"]
    texts += ["".join(rng.choices(letters, k=rng.choice([3, 30, 400, 3000]))) for _ in range(60)]
    texts += ["".join(rng.choices("abcdefghijklmnop", k=4000)) for _ in range(5)]
    texts += ["".join(rng.choices("!?'st.", k=2000)) for _ in range(3)]
    texts += ["<|endoftext|>" * 100, "the cat sat on the mat. " * 400]
    return texts


def test_encoding_equals_the_library(spark, exact):
    texts = tricky()
    rows = [(i, t, "x", 1) for i, t in enumerate(texts)] + [(3, texts[3], "y", 2), (None, "null id", "x", 1)]
    got = bpe_concat.digests(spark.createDataFrame(rows, DDL), leaf_chars=100).collect()
    assert len(got) == len(rows)
    want = {}
    for d, t, *_ in rows:
        ids = exact.encode(t or "", add_special_tokens=False).ids
        want[d] = (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(exact.decode(ids, skip_special_tokens=False).encode()).hexdigest())
    for r in got:
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == want[r.doc_id], texts[r.doc_id][:80]


def test_empty_table(spark):
    empty = spark.createDataFrame([], DDL)
    assert bpe_concat.digests(empty).count() == 0
    assert best_fit.pack(empty).count() == 0


def test_best_fit_fills_bins():
    assert sorted(map(sorted, best_fit.best_fit([6, 5, 5, 4, 10], 10))) == [[0, 3], [1, 2], [4]]
    rng = random.Random(2)
    sizes = [rng.randint(1, 50) for _ in range(2000)]
    bins = best_fit.best_fit(sizes, 100)
    assert sorted(i for b in bins for i in b) == list(range(2000))
    assert all(sum(sizes[i] for i in b) <= 100 for b in bins)
    assert len(bins) <= -(-sum(sizes) // 100) + 1


def test_packing_is_whole_and_gapless(spark, exact):
    texts = [None, "", "word " * 50] + [t for t in tricky() if t] * 2
    docs = spark.createDataFrame([(i, t, "x", 0) for i, t in enumerate(texts)] + [(7, "again", "x", 0)] * 2, DDL).repartition(7)
    got = best_fit.pack(docs, capacity=64, fan_in=2).collect()
    by_doc = {}
    for r in got:
        by_doc.setdefault(r.doc_id, []).append(r)
    for i, t in enumerate(texts):
        if i == 7:
            continue
        ids = np.array(exact.encode(t or "", add_special_tokens=False).ids + [1], "<u4")
        rows = sorted(by_doc[i], key=lambda r: r.piece)
        assert [(r.start, r.length) for r in rows] == [(s, min(64, len(ids) - s)) for s in range(0, len(ids), 64)]
        assert [r.ids_crc32 for r in rows] == [zlib.crc32(ids[s : s + 64].tobytes()) for s in range(0, len(ids), 64)]
    bins = {}
    for r in got:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in bins.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 64
    assert len(bins) <= -(-sum(r.length for r in got) // 64) * 1.02 + 1
