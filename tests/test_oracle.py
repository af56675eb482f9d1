"""Every registered query against its DuckDB oracle (the driver's gate, at a small scale)."""
import pytest

from spanshield.plans.catalog import REGISTRY
from spanshield.plans.checks import compare, duck

NAMES = sorted(REGISTRY)


@pytest.fixture(scope="module")
def con(sf_dir):
    return duck(sf_dir)


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_oracle(spark, sf_dir, con, name):
    fn, sql = REGISTRY[name]
    df = fn(spark, sf_dir)
    if sql is None:
        assert df.count() >= 0
        return
    res = compare(df, con, sql)
    assert res["ok"], res


def test_entry_smoke(spark):
    import __spark_entry__ as E
    df = E.entry(spark)
    assert df.count() >= 0
    assert set(E.oracle_sql()) <= set(E.queries())
