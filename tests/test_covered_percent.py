"""Coverage of ranges: against every pair of a span and a range, and without meeting pair by pair."""

import random

import oracle

from riskframe.operators import intervals
from riskframe.plans import registry

SPANS = "file string, start_line int, end_line int, statements int, covered boolean"
OWNED = "id int, file string, start_line int, end_line int"


def pairwise(spans, owned):
    total = {}
    for key, file, a, b in owned:
        for f, s, e, n, covered in spans:
            if None not in (file, a, b, s, e) and f == file and s >= a and e <= b:
                hit, every = total.get(key, (0, 0))
                total[key] = (hit + (n or 0) * bool(covered), every + (n or 0))
    return {k: int(hit * 10000 / every + 0.5) / 100 if every else None for k, (hit, every) in total.items()}


def lines(draw, backwards):
    """A start and an end between -200 and 900: short, long, with few starts, backwards, unknown."""
    s = draw.choice([draw.randint(-200, 600), draw.choice([-64, -1, 0, 1, 63, 64, 128])])
    e = s + draw.choice([0, 1, 2, draw.randint(0, 20), draw.randint(0, 300)])
    s, e = (e, s) if draw.random() < backwards else (s, e)
    return (None if draw.random() < 0.02 else s), (None if draw.random() < 0.02 else e)


def test_equals_pairs_one_by_one(spark):
    for seed in range(4):
        draw = random.Random(seed)
        file = lambda: draw.choice(["a", "a", "b", "c", None])  # noqa: E731, B023
        spans = [(file(), *lines(draw, 0.1), draw.choice([0, 1, 5, None]), draw.choice([True, False, None])) for _ in range(400)]
        owned = [(draw.randint(1, 250), file() or "only here", *lines(draw, 0.1)) for _ in range(300)]
        got = intervals.covered_percent(spark.createDataFrame(spans, SPANS), spark.createDataFrame(owned, OWNED)).collect()
        want = pairwise(spans, owned)
        assert len(got) == len(want) and {r[0]: r[1] for r in got} == want and len(want) > 100


def test_line_numbers_up_to_the_bounds(spark):
    top, low = 2**31 - 1, -(2**31)
    spans = [("a", low, top, 1, True), ("a", top, top, 2, False), ("a", low, low, 3, True), ("a", top, low, 4, False)]
    owned = [(1, "a", low, top), (2, "a", top, top), (3, "a", low, low), (4, "a", 0, 1), (5, "a", top, low)]
    got = intervals.covered_percent(spark.createDataFrame(spans, SPANS), spark.createDataFrame(owned, OWNED))
    assert {r[0]: r[1] for r in got.collect()} == pairwise(spans, owned)


def rows_out(spark, plan):
    """Rows that the widest step of a plan gave, after it ran."""
    found = plan.metrics().get("numOutputRows")
    inner = {"AdaptiveSparkPlan": "executedPlan", "ShuffleQueryStage": "plan", "BroadcastQueryStage": "plan", "ResultQueryStage": "plan"}.get(plan.nodeName())
    below = [getattr(plan, inner)()] if inner else spark._jvm.scala.jdk.javaapi.CollectionConverters.asJava(plan.children())
    return max([found.get().value() if found.isDefined() else 0, *(rows_out(spark, p) for p in below)])


def test_many_ranges_over_many_spans_do_not_meet_pair_by_pair(spark):
    spans = spark.range(1500).selectExpr("'a' as file", "cast(10 + id % 40 as int) as start_line", "cast(10 + id % 40 + id % 3 as int) as end_line", "1 as statements", "id % 2 = 0 as covered")
    owned = spark.range(1500).selectExpr("cast(id as int) as id", "'a' as file", "cast(1 + id % 9 as int) as start_line", "cast(60 + id % 7 as int) as end_line")
    df = intervals.covered_percent(spans, owned)
    assert {r[1] for r in df.collect()} == {50.0} and df.columns == ["id", "coverage_percent"]
    assert 1500 <= rows_out(spark, df._jdf.queryExecution().executedPlan()) <= 10000  # all pairs would be 2.25 million


def test_many_short_ranges_in_many_long_spans_do_not_meet_pair_by_pair(spark):
    spans = spark.range(1200).selectExpr("'a' as file", "cast(id as int) as start_line", "cast(3000 + id % 700 as int) as end_line", "1 as statements", "true as covered")
    owned = spark.range(1200).selectExpr("cast(id as int) as id", "'a' as file", "cast(1500 + id as int) as start_line", "cast(1501 + id as int) as end_line")
    inside = spark.createDataFrame([("a", k, k, 1, True) for k in range(1500, 2702, 2)], SPANS)
    df = intervals.covered_percent(spans.unionByName(inside), owned)
    assert {r[0]: r[1] for r in df.collect()} == dict.fromkeys(range(1200), 100.0)
    assert rows_out(spark, df._jdf.queryExecution().executedPlan()) <= 60000  # all pairs would be 1.44 million


def test_query_on_odd_tables(spark, tmp_path):
    con = oracle.duck(str(tmp_path))
    size = "CAST(CASE WHEN k % 11 = 0 THEN -(k % 50) WHEN k % 13 = 0 THEN NULL WHEN k % 17 = 0 THEN 900 ELSE 1 + k % 50 END AS INT)"
    con.execute(f"COPY (SELECT k AS p_partkey, 'Name' AS p_name, 'Brand#1' AS p_brand, 'T' || k % 3 AS p_type, {size} AS p_size FROM range(600) t(k)) TO '{tmp_path}/part.parquet'")
    order = "CASE WHEN k % 23 = 0 THEN NULL WHEN k % 3 = 0 THEN -k ELSE k END AS l_orderkey, CAST(CASE WHEN k % 7 = 0 THEN -(k % 8) ELSE k % 8 END AS INT) AS l_linenumber"
    statements = "CASE WHEN k % 1000 < 700 THEN NULL ELSE CAST(1 + k % 50 AS DOUBLE) END AS l_quantity, CASE WHEN k % 4 = 0 THEN 'N' WHEN k % 9 = 0 THEN NULL ELSE 'R' END AS l_returnflag"
    con.execute(f"COPY (SELECT k % 600 AS l_partkey, {order}, {statements} FROM range(3000) t(k)) TO '{tmp_path}/lineitem.parquet'")
    ok, why = oracle.compare(spark, str(tmp_path), registry.queries()["coverage_percent"], registry.oracle_sql()["coverage_percent"])
    assert ok and int(why.split()[0]) > 100, why
