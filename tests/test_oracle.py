"""Every SQL-checked registered query equals its DuckDB oracle (sf0.001)."""
import os
import sys

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

import __spark_entry__ as ent  # noqa: E402
from fixture_paths import SF0001  # noqa: E402
from oracle_check import compare, duck  # noqa: E402

SQL = ent.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return duck(SF0001)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_oracle(spark, con, name):
    ok, _, detail = compare(spark, con, name, ent.queries()[name], SQL[name], SF0001)
    assert ok, detail


def test_every_oracle_has_a_query():
    assert set(SQL) <= set(ent.queries())


def test_entry_runs(spark):
    df = ent.entry(spark)
    rows = df.collect()
    assert len(rows) > 0
    assert df.columns == ["variable", "lag", "acf", "band"]


def test_package_shipped_once_per_application(spark):
    import zipfile

    from chronoframe import session as ss
    ent.queries()["subjects"](spark, SF0001)
    app = spark.sparkContext.applicationId
    with zipfile.ZipFile(ss._SHIPPED[app]) as zf:
        assert "chronoframe/operators/ordering.py" in zf.namelist()
    assert ss.ship_package(spark) is None                     # second call: nothing to do
