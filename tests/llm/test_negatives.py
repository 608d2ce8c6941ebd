"""Hard negatives against brute force."""

import math

import numpy as np

from corpusloom.llm import threshold_negatives as tn

DDL = "vec_id long, embedding array<float>, label int, score double, name string"


def rows(n=500, width=12, seed=3):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((12, width))
    v = centres[rng.integers(0, 12, n)] + 0.5 * rng.standard_normal((n, width))
    out = [(i, [float(np.float32(x)) for x in row], int(rng.integers(0, 4)), 0.5, "x") for i, row in enumerate(v)]
    for i in range(100, 200):  # a large group of equal vectors, of two labels
        out[i] = (i, out[50][1], i % 2, None, None)
    out += [(10000, None, 0, 0.0, ""), (10050, [None] * width, 0, 0.0, ""), (10100, [math.nan] * width, 0, 0.0, ""), (10150, [math.inf] * width, 0, 0.0, "")]
    out += [(10200, [0.0] * width, 0, 0.0, ""), (10250, [1.0, 2.0], 0, 0.0, ""), (10251, [2.0, 1.0], 0, 0.0, ""), (10252, [0.75, 0.75], 1, 0.0, "")]
    out += [(None, [1.0] * width, 0, 0.0, ""), (10300, [], 0, 0.0, ""), (10301, [], 1, 0.0, ""), (10302, [], 0, 0.0, ""), (10350, out[7][1], None, 0.0, "")]
    # repeated rows, and one vec_id with another vector
    return out + [out[7], out[7], out[50], (150, out[3][1], 2, 0.0, "")]


def brute(data, positives=5, negatives=3):
    fine = [(i, [math.floor(256 * x) for x in v], c) for i, v, c, *_ in data if i is not None and c is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for a, q, label in {(i, tuple(v), c) for i, v, c in fine if i % 50 == 0}:
        scored = sorted((-sum(x * y for x, y in zip(q, v)), i, c) for i, v, c in fine if i != a and len(v) == len(q))
        for s, p, _ in [x for x in scored if x[2] == label][:positives]:
            inside = [(t, i) for t, i, c in scored if c != label and 50 * -s <= 100 * -t <= 95 * -s]
            out += [(a, p, r + 1, i, -s, -t) for r, (t, i) in enumerate(inside[:negatives])]
    return sorted(out)


def got(df):
    return sorted((r.anchor_id, r.positive_id, r["rank"], r.negative_id, r.positive_score, r.negative_score) for r in df.collect())


def test_equals_brute_force(spark):
    data = rows()
    want = brute(data)
    assert {x[0] for x in want} >= {0, 50, 150, 10250, 10300} and 10350 not in {x[0] for x in want}
    df = spark.createDataFrame(data, DDL)
    assert got(tn.mine(df)) == want
    assert got(tn.mine(df, block_rows=64, anchor_rows=4)) == want


def test_large_components_stay_exact(spark):
    big = [(i, [float(2**20 + 3 * i), float(-(2**19) - i), 1.0], i % 2, 0.0, "") for i in range(0, 120)]
    assert got(tn.mine(spark.createDataFrame(big, "vec_id long, embedding array<double>, label int, score double, name string"))) == brute(big)


def test_empty_table_and_no_anchor(spark):
    assert tn.mine(spark.createDataFrame([], DDL)).count() == 0
    assert tn.mine(spark.createDataFrame([(1, [1.0], 0, 0.0, ""), (2, [1.0], 1, 0.0, "")], DDL)).count() == 0


def test_lists_are_read_until_the_threshold_falls_below(spark):
    rng = np.random.default_rng(0)
    lists = tn.Lists(np.floor(256 * rng.exponential(1.0, (20000, 3)) ** 3))
    q, kept = np.array([3.0, 2.0, 1.0]), np.ones(20000, bool)
    exact = lists.rows @ q
    places, scores, met = lists.search(q, kept, lambda s, bound: len(s) >= 5 and tn.kth(s, 5) > bound)
    assert met < 2000
    assert sorted(scores)[-5:] == sorted(exact)[-5:] and (exact[places] == scores).all()
    top = int(exact.max())
    windows = [(top // 2, top * 95 // 100), (top // 3, top * 6 // 10)]
    places, scores, met = lists.search(q, kept, lambda s, bound: tn.windows_done(s, bound, windows, 3))
    assert met < 4000
    for low, high in windows:
        assert sorted(s for s in scores if low <= s <= high)[-3:] == sorted(s for s in exact if low <= s <= high)[-3:]


def test_a_tie_with_the_threshold_is_not_the_end():
    # the list's next row could have the k-th score and a smaller id
    assert not tn.windows_done(np.array([10, 10, 10]), 10, [(5, 12)], 3)
    assert tn.windows_done(np.array([10, 10, 10]), 9, [(5, 12)], 3)
    assert not tn.windows_done(np.array([10]), 5, [(5, 12)], 3) and tn.windows_done(np.array([10]), 4, [(5, 12)], 3)
