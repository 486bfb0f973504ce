"""Every query of the core against its SQL, and those without SQL for rows and a stable schema."""

import os

import oracle
import pytest

from riskframe.plans import registry

SF = os.environ.get("RISKFRAME_TEST_SF", f"{oracle.DATA}/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_matches_sql(spark, name):
    ok, why = oracle.compare(spark, SF, registry.queries()[name], registry.oracle_sql()[name])
    assert ok, why


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_runs(spark, name):
    df = registry.queries()[name](spark, SF)
    assert df.columns and df.count() >= 0


def test_witnesses_cover_all_import_cycles(spark):
    want = {r[0] for r in oracle.duck(SF).execute(f"SELECT node FROM ({registry.oracle_sql()['import_cycles']})").fetchall()}
    got = registry.queries()["cycle_witnesses"](spark, SF).collect()
    assert want and {n for r in got for n in r["modules"]} == want and {n for r in got for n in (r["from_id"], r["to_id"])} <= want


def test_entry(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).count() > 0
