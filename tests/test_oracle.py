"""Every query with an oracle must match DuckDB on the smallest driver tables."""
import os

import pytest

import __spark_entry__ as entry
from tests.oracle import connect, differences

SF = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables not present")


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_matches_oracle(spark, con, name):
    got = entry.queries()[name](spark, SF).toPandas()
    assert differences(got, con.sql(entry.oracle_sql()[name]).df()) is None


@pytest.mark.parametrize("name", ["bootstrap_roi", "table_fingerprint", "walk_forward", "platt_isotonic", "disjoint_cards", "capped_compounding"])
def test_runs_without_oracle(spark, name):
    df = entry.queries()[name](spark, SF)
    assert len(df.columns) > 1 and df.count() >= 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0
