"""Registered streaming queries (X1-X8): the final answer of each stream
after all available input, checked against the batch twin's SQL."""

from __future__ import annotations

from ..streaming import streams as X
from . import q_aggregates, q_joins, q_setops, q_windows  # noqa: F401  (their SQL is the oracle here)
from .catalog import query, sql_of


def _tall(report: str, key: str, names: list[str]) -> str:
    """A one-row report's SQL as (report, name, value) rows."""
    body = sql_of(key)
    return " union all ".join(f"select '{report}' report, '{n}' \"name\", cast({n} as double) \"value\" from ({body}) x" for n in names)


@query("stream_admin_kpis", oracle=" union all ".join([
    _tall("counts", "admin_counts", ["total_orders", "total_users", "total_riders", "pending_riders", "total_restaurants",
                                     "pending_restaurants"]),
    _tall("revenue", "admin_revenue", ["revenue", "platform_revenue", "total_platform_cut"]),
    _tall("breakdown", "revenue_breakdown", ["total_gmv", "restaurant_revenue", "platform_fee", "delivery_fee", "rider_tip"]),
    f"""select 'top restaurants' report, restaurant_label "name", cast(orders as double) "value"
        from ({sql_of("orders_top10_restaurants")}) x"""]))
def _x1(d):
    return X.stream_admin_kpis(X.Arrivals(d))


@query("stream_manager_stats", oracle=sql_of("manager_stats"))
def _x2(d):
    return X.stream_manager_stats(X.Arrivals(d))


@query("stream_available_orders", oracle=sql_of("available_orders"))
def _x3(d):
    return X.stream_available_orders(X.Arrivals(d))


@query("stream_unread", oracle=sql_of("conversation_list"))
def _x4(d):
    return X.stream_unread(X.Arrivals(d))


@query("stream_loyalty", oracle=f"""
select w.*, t.tier from ({sql_of("loyalty_balance_running")}) w
join ({sql_of("loyalty_tier")}) t on w.customer_id = t.customer_id""")
def _x5(d):
    return X.stream_loyalty(X.Arrivals(d))


@query("stream_order_status", oracle=sql_of("order_detail"))
def _x6(d):
    return X.stream_order_status(X.Arrivals(d))


@query("stream_audit", oracle=sql_of("audit_with_user"))
def _x7(d):
    return X.stream_audit(X.Arrivals(d))


@query("stream_ratings", oracle=sql_of("restaurant_rating"))
def _x8(d):
    return X.stream_ratings(X.Arrivals(d))
