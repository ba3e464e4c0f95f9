"""Plan checks: no cartesian products, no Python UDFs in registered plans,
filters reach the parquet scan, per-key top-n is limited before the shuffle."""

import pytest
from conftest import SF_SMALL
from ladle.operators import filters as B
from ladle.plans.catalog import as_callables, oracle_sql
from ladle.sources.domain import Domain

STREAMS = {k for k in as_callables() if k.startswith("stream_")}
SETTLE = {"settle_food_orders", "settle_produce_orders", "loyalty_earn", "loyalty_redeem", "promo_usage_apply",
          "stock_deduct", "settlement_audit", "loyalty_manual_redeem"}


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("key", sorted(set(as_callables()) - STREAMS - SETTLE))
def test_no_cartesian_or_python_udf(spark, key):
    p = _plan(as_callables()[key](spark, SF_SMALL))
    assert "CartesianProduct" not in p
    assert "BatchEvalPython" not in p and "ArrowEvalPython" not in p


def test_filter_pushed_to_scan(spark):
    d = Domain(spark, SF_SMALL)
    p = _plan(B.restaurants_by_cuisine(d.restaurants, "GERMANY").select("id"))
    assert "PushedFilters" in p


def test_top_n_uses_window_group_limit(spark):
    d = Domain(spark, SF_SMALL)
    df = B.audit_by_user(d.audit_log, 5)
    assert "WindowGroupLimit" in _plan(df)


def test_oracle_keys_subset():
    assert set(oracle_sql()) <= set(as_callables())
    assert len(oracle_sql()) >= 100

