"""Top-n: ties, versions, nulls, empty tables, clashing columns, and the query against its SQL."""

import os

import oracle
import pytest
from pyspark.sql import functions as F

from riskframe.llm import queries
from riskframe.llm.topn import riskiest_callables

SF = os.environ.get("RISKFRAME_TEST_SF", f"{oracle.DATA}/sf0.001")


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_top_n(spark):
    import datetime as dt

    t = lambda h: dt.datetime(2026, 1, 1, h)
    data = [("r", "f", f"i{i:03d}", float(i % 7), t(1), t(1)) for i in range(500)] + [("r", "f", "i006", 100.0, t(0), t(9)), ("r", "f", "i013", None, t(2), t(2)), ("r", "g", "n", None, t(1), t(1)), ("r", "h", "nan", float("nan"), t(1), t(1)), (None, "f", "x", 1.0, t(1), t(1)), ("r", "f", None, 9.0, t(1), t(1))]
    df = spark.createDataFrame(data * 2, "repository string, file string, id string, risk double, analyzed_at timestamp_ntz, loaded_at timestamp_ntz").withColumn("rank_no", F.lit(5)).withColumn("_score", F.lit(1))
    got = rows(riskiest_callables(df).select("repository", "file", "id", "rank_no"))
    assert got == sorted([("r", "f", "i006", 1), ("r", "f", "i020", 2), ("r", "f", "i027", 3), (None, "f", "x", 1)], key=repr)
    assert "WindowGroupLimit" in riskiest_callables(df)._jdf.queryExecution().toString()
    assert rows(riskiest_callables(df.limit(0))) == []


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_matches_sql(spark, name):
    ok, why = oracle.compare(spark, SF, queries.QUERIES[name], queries.ORACLE[name])
    assert ok, why
