"""The audit of filter orders against a loop over documents and orders."""

import re
from collections import Counter
from itertools import permutations

from corpusloom.llm import filter_audit

DOCS = "doc_id long, text string, lang string, words int, mask string, digest string"
LABELS = "doc_id long, quality int, toxic int, lang string"
ORDERS = ["".join(p) for p in permutations("ABCDE")]


def texts():
    long = " ".join(f"w{i}" for i in range(250))
    few = " ".join("abc"[i % 3] for i in range(300))
    return [None, "", " \t\n", "short", "short", long, long, long, few, few + " $", long.upper(), long + " &", "x" * 300_000 + " | Y", few.upper(), "İ Ａ " * 120, "a b " * 250, long, None]


def data():
    rows = [(i, t, ["en", "fr", None, ""][i % 4], 1, "m", "d") for i, t in enumerate(texts())]
    rows += [rows[5], (None, texts()[5], "en", 0, "", ""), (None, "only", "en", 0, "", ""), (7, "other text", "de", 0, "", "")]
    labels = [(i, i % 2, int(i % 3 == 0), "z") for i in range(0, 16)] + [(2, 1, None, ""), (2, 0, 1, ""), (None, 1, 1, ""), (4, None, None, "")]
    return rows, labels


def brute(rows, labels):
    out = Counter()
    for doc, text, lang, *_ in rows:
        t = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {
            "A": len(words) < 200,
            "B": 100 * len(set(words)) < 50 * len(words),
            "C": 100 * len(re.findall("[A-Z]", t)) > 3 * len(t),
            "D": bool(re.search("[#$%&*|]", t)),
            "E": doc is not None and any(d is not None and d < doc and (u or "") == t for d, u, *_ in rows),
        }
        good = any(d == doc and q == 1 for d, q, *_ in labels if d is not None)
        toxic = any(d == doc and x == 1 for d, _, x, _ in labels if d is not None)
        part = lang or ""
        for order in ORDERS:
            gone = False
            for step, x in enumerate(order, 1):
                key = (part, order, step)
                removed = fails[x] and not gone
                out[key, "redundant"] += fails[x] and gone
                gone |= fails[x]
                out[key, "kept"] += not gone
                out[key, "removed"] += removed
                out[key, "unique_fails"] += [y for y in fails if fails[y]] == [x]
                out[key, "good_lost"] += removed and good
                out[key, "toxic_lost"] += removed and toxic
                out[part, x] += removed
    return out


def check(spark, rows, labels, **options):
    docs = spark.createDataFrame(rows, DOCS).repartition(5)
    got = filter_audit.audit(filter_audit.masks(docs, spark.createDataFrame(labels, LABELS)), **options).collect()
    want = brute(rows, labels)
    assert len(got) == len({(r.part, r.filter_order, r.step) for r in got}) == 600 * len({lang or "" for _, _, lang, *_ in rows})
    for r in got:
        for name in filter_audit.COUNTERS:
            assert r[name] == want[(r.part, r.filter_order, r.step), name], (r, name)
        assert r.shapley == want[r.part, r.filter_order[r.step - 1]]


def test_equals_a_loop(spark):
    rows, labels = data()
    check(spark, rows, labels, fan_in=2)
    check(spark, rows, [])


def test_many_parts_pass_on_their_sums(spark, monkeypatch):
    monkeypatch.setattr(filter_audit, "TASK_PARTS", 3)
    rows, labels = data()
    check(spark, [(d, t, f"p{i % 12}", *more) for i, (d, t, _, *more) in enumerate(rows)], labels, fan_in=1)


def test_empty_table(spark):
    empty = filter_audit.masks(spark.createDataFrame([], DOCS), spark.createDataFrame([], LABELS))
    assert filter_audit.audit(empty).count() == 0


def test_fields_hold_sums_beyond_32_bits():
    n = 3 * 10**12
    total = n * filter_audit.wide("ABCDE", 0b10110, True, False) + 7 * filter_audit.wide("ABCDE", 0, False, True)
    got = filter_audit.unpacked("ABCDE", total)
    want = n * filter_audit.outcomes("ABCDE", 0b10110, True, False).astype(int) + 7 * filter_audit.outcomes("ABCDE", 0, False, True).astype(int)
    assert (got == want).all()


def test_other_filters(spark):
    from pyspark.sql import functions as F

    docs = spark.createDataFrame([(1, "a", "x", 0, "", ""), (2, "bb", "x", 0, "", "")], DOCS)
    masked = filter_audit.masks(docs, spark.createDataFrame([], LABELS), filters={"L": F.length("text") < 2})
    got = {(r.filter_order, r.step): r.kept for r in filter_audit.audit(masked, "LR").collect()}
    assert got == {("LR", 1): 1, ("LR", 2): 1, ("RL", 1): 2, ("RL", 2): 1}
