"""Minimum bin slack: the choice against all subsets, the packing against the tokenizers library."""

import json
import random
import zlib
from collections import Counter

import numpy as np
from tokenizers import Tokenizer

from corpusloom.llm import bin_slack

DDL = "doc_id long, text string, ids binary, length long"


def test_fill_is_the_best_subset():
    rng = random.Random(1)
    for _ in range(300):
        lengths = [rng.randint(1, 12) for _ in range(rng.randint(0, 9))]
        room = rng.randint(0, 30)
        sums = {0}
        for x in lengths:
            sums |= {s + x for s in sums}
        counts = [lengths.count(x) for x in range(31)]
        total, chosen = bin_slack.fill(sum(1 << x for x in set(lengths)), counts, room)
        assert total == max(s for s in sums if s <= room) == sum(x * n for x, n in chosen)
        assert all(n <= counts[x] for x, n in chosen)


def tricky() -> list:
    rng = random.Random(5)
    letters = "abcdefghéèñ'.,!?-_0123 \n\tABCÉİΣßＡ中é<|\x1c\x85ԱՖ՘𐥀😀"
    texts = [None, "", " ", "a" * 5000, "ab " * 3000, "it's <|endoftext|> don't!!'t", "x\x1cy z", "  two  spaces \n\n ", "1,234 ½ ²"]
    texts += ["".join(rng.choices(letters, k=rng.choice([3, 30, 400, 3000]))) for _ in range(150)]
    return texts + ["same text of one length"] * 150


def library():
    return Tokenizer.from_file(bin_slack.default_path())


def test_encoding_equals_the_library():
    exact, bpe = library(), bin_slack.ByteBpe(bin_slack.default_path())
    for text in [t or "" for t in tricky()] + ["ab" * 40_000, " " * 50_000 + "x", "1" * 30_000]:
        assert list(np.frombuffer(bpe.encode(text), "<u4")) == exact.encode(text, add_special_tokens=False).ids


def test_both_libraries_see_the_same_classes_of_characters():
    exact, bpe = library(), bin_slack.ByteBpe(bin_slack.default_path())
    codes = [c for c in range(0xA000) if not bin_slack._BEYOND.search(chr(c))]
    assert len(codes) > 30_000
    texts = [f"a{chr(c)}1{chr(c)}!{chr(c)} " for c in codes]
    for text, want in zip(texts, exact.encode_batch_fast(texts, add_special_tokens=False)):
        assert bpe.fast.encode_ordinary(text) == want.ids


def test_the_last_merge_of_every_token_by_rank_is_the_listed_one():
    with open(bin_slack.default_path(), encoding="utf-8") as f:
        spec = json.load(f)
    ranks = bin_slack.ranks_of(spec)
    by_id = {i: t for t, i in ranks.items()}
    text_of = {i: t for t, i in spec["model"]["vocab"].items()}
    listed = {tuple(m if isinstance(m, list) else m.split(" ")) for m in spec["model"]["merges"]}
    for i, token in by_id.items():
        parts = [token[k : k + 1] for k in range(len(token))]
        last = None
        while len(parts) > 1:
            rank, k = min((ranks.get(parts[k] + parts[k + 1], 1 << 30), k) for k in range(len(parts) - 1))
            assert rank < 1 << 30
            last = (parts[k], parts[k + 1])
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
        if last:
            assert tuple(text_of[ranks[p]] for p in last) in listed, text_of[i]


def test_other_files_go_through_the_library():
    with open(bin_slack.default_path(), encoding="utf-8") as f:
        spec = json.load(f)
    assert bin_slack.ranks_of(spec | {"normalizer": {"type": "Lowercase"}}) is None
    assert bin_slack.ranks_of(spec | {"model": spec["model"] | {"merges": spec["model"]["merges"][::-1]}}) is None


def check(spark, texts, partitions, capacity, **options):
    rows = [(i, t, b"x", 0) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows + [(None, "null id", b"", 0)] * 2, DDL).repartition(partitions)
    got = bin_slack.pack(docs, capacity=capacity, **options).collect()
    exact = library()
    by_doc, by_sequence = {}, {}
    for r in got:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    assert set(by_doc) == {*range(len(texts)), None}
    for i, t in enumerate(texts):
        ids = np.array(exact.encode(t or "", add_special_tokens=False).ids + [1], "<u4")
        at = 0
        for r in sorted(by_doc[i], key=lambda r: r.start):
            assert (r.start, r.doc_tokens) == (at, len(ids))
            assert r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at and r.length > 0
            at += r.length
        assert at == capacity or at & (at - 1) == 0 and at < capacity
    return got, by_sequence


def test_packing_has_no_padding(spark):
    got, sequences = check(spark, tricky(), 7, 64, pool_pieces=40, left_pieces=4, group_pieces=8)
    short = sum(1 for s in sequences.values() if sum(r.length for r in s) < 64)
    assert short <= 6 * 8
    check(spark, tricky(), 3, 2048)


def test_few_documents_are_cut(spark):
    rng = random.Random(4)
    texts = [" ".join(["word"] * rng.randint(5, 900)) for _ in range(1500)]
    got, _ = check(spark, texts, 2, 2048)
    pieces = Counter(r.doc_id for r in got)
    assert sum(n > 1 for d, n in pieces.items() if d is not None) <= 30


def test_one_length_that_never_fills_a_sequence(spark):
    check(spark, ["one two three four five six"] * 400, 2, 16, pool_pieces=50, left_pieces=3, group_pieces=10)


def test_empty_table(spark):
    assert bin_slack.pack(spark.createDataFrame([], DDL)).count() == 0
