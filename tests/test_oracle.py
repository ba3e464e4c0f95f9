"""Every registered query with an oracle equals its DuckDB SQL (sf0.001),
and every registered query runs (rows-only keys included)."""

import pytest

from conftest import SF_SMALL
from ladle.plans.catalog import as_callables, oracle_sql
from ladle.plans.compare import compare, duck_connect

KEYS = sorted(as_callables())


@pytest.fixture(scope="module")
def con():
    return duck_connect(SF_SMALL)


@pytest.mark.parametrize("key", [k for k in KEYS if k in oracle_sql()])
def test_matches_oracle(spark, con, key):
    r = compare(spark, SF_SMALL, key, con)
    assert r["status"] == "ok", r


@pytest.mark.parametrize("key", [k for k in KEYS if k not in oracle_sql()])
def test_rows_only_keys_run(spark, key):
    df = as_callables()[key](spark, SF_SMALL)
    assert df.count() >= 0


def test_entry_smoke(spark):
    import __spark_entry__ as e
    df = e.entry(spark)
    assert df.count() > 0
    assert set(e.queries()) >= set(e.oracle_sql())
