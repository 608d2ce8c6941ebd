"""Log statistics of hot groups against plain loops."""

import random
from collections import defaultdict

import numpy as np
import pytest

from corpusloom import schemas as Z
from corpusloom.operators import logs as L


@pytest.mark.parametrize("ranges,few", [(1024, 10_000), (4, 3)])
def test_exact_percentiles(spark, ranges, few):
    rng = random.Random(2)
    rows = [("hot", rng.choice([rng.lognormvariate(3, 2), 7.0, 7.0, -1e300, 1e300])) for _ in range(3000)]
    rows += [("same", 5.0)] * 50 + [("one", 1.5), ("two", 1.0), ("two", 2.0), (None, 3.0), (None, 4.0), ("hot", None), ("hot", float("nan")), ("nothing", None)]
    df = spark.createDataFrame(rows, "k string, v double").repartition(6)
    got = {(r.k, r.prob): r.percentile for r in L.exact_percentiles(df, "k", "v", [0.0, 0.5, 0.95, 1.0], ranges, few).collect()}
    groups = defaultdict(list)
    for k, v in rows:
        if v is not None and v == v:
            groups[k].append(v)
    assert {k for k, _ in got} == set(groups)
    for (k, p), value in got.items():
        ordered = sorted(groups[k])
        at = p * (len(ordered) - 1)
        low, high = ordered[int(np.floor(at))], ordered[int(np.ceil(at))]
        assert value == pytest.approx(low + (high - low) * (at - np.floor(at)), rel=1e-12), (k, p)


def test_chunk_hits_of_a_hot_chunk(spark):
    rng = random.Random(3)
    logs, want = [], defaultdict(list)
    for i in range(400):
        names = ["hot"] * (1 + (i % 50 == 0)) + [f"c{rng.randrange(6)}"]
        sources = [{"corpus_id": "k", "parent_id": "p", "child_id": n, "title": f"title {i}", "score": rng.random()} for n in names]
        logs.append({"id": i, "sources": sources, "source_count": len(names)})
        for n in names:
            want[n].append(i)
    df = spark.createDataFrame(logs, Z.ASK_LOGS).repartition(7)
    got = L.chunk_hits(df, top_n=3).collect()
    order = sorted(want, key=lambda n: (-len(want[n]), f"k|p|{n}"))[:3]
    assert [r.child_id for r in got] == order and [r.hits for r in got] == [len(want[n]) for n in order]
    assert [r.sample_log_ids for r in got] == [sorted(want[n], reverse=True)[:5] for n in order]
    assert [r.title for r in got] == [f"title {max(want[n])}" for n in order]


def test_report_summary(spark):
    rows = [(i, "open" if i % 3 == 0 else "resolved") for i in range(30)]
    got = defaultdict(list)
    for r in L.report_summary(spark.createDataFrame(rows, "report_id long, status string"), limit=4).orderBy("part", "rank").collect():
        got[r.part].append((r.report_id, r.status, r["count"]))
    assert got["total"] == [(None, None, 30)] and got["status"] == [(None, "resolved", 20), (None, "open", 10)]
    assert [r[0] for r in got["recent"]] == [29, 28, 27, 26] and [r[0] for r in got["open"]] == [27, 24, 21, 18]
    empty = L.report_summary(spark.createDataFrame([], "report_id long, status string")).collect()
    assert [(r.part, r["count"]) for r in empty] == [("total", 0)]
