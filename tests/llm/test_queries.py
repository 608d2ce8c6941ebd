"""The registered queries on the small tables: against their SQL, or for whole results."""

import pytest

from corpusloom.llm.queries import ORACLES, QUERIES
from oracle import compare, connect

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_sql(spark, name):
    assert not compare(spark, connect(SF), QUERIES[name], ORACLES[name], SF)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES) - {"op5_collision_counting"}))
def test_every_document_has_its_row(spark, name):
    ids = {r.doc_id for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id").collect()}
    got = QUERIES[name](spark, SF).collect()
    assert {r.doc_id for r in got} == ids
    assert name in ("op1_best_fit", "op13_bin_slack") or len(got) == len(ids)
