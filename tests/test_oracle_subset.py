"""A cross-section of registered queries against their DuckDB SQL at sf0.001."""

import pytest

import __spark_entry__ as entry
from riskframe.checks.compare import compare, duck_connect

SF_SMALL = "/root/testdata/sf0.001"

IDS = ["P2", "P10", "P20", "A1", "A4", "A8", "C1", "E3", "E4", "E7", "F7", "F9", "F10", "R2", "R3",
       "R4", "M2", "M14", "T4", "T13", "S7"]


@pytest.fixture(scope="module")
def con():
    return duck_connect(SF_SMALL)


@pytest.mark.parametrize("qid", IDS)
def test_query_matches_oracle(spark, con, qid):
    r = compare(entry.queries()[qid](spark, SF_SMALL), entry.oracle_sql()[qid], con)
    assert r["cols_match"] and r["rows_spark"] == r["rows_oracle"] and r["hash_match"], r


def test_entry_runs(spark):
    df = entry.entry(spark)
    rows = df.collect()
    assert {r["split"] for r in rows} == {"train", "test"}
    assert set(df.columns) >= {"accuracy", "precision", "recall", "f1", "auc"}
