"""Golden cases: the app's recorded rollback/commit scenarios and its
documented examples, on literal fixtures (FIXTURES.md §2)."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from ladle.functions.exprs import order_progress, status_dim
from ladle.operators import aggregates as A
from ladle.operators import filters as B
from ladle.operators import joins as C
from ladle.operators import settlement as S
from ladle.operators import windows as W
from ladle.sources.requests import REQUEST_SCHEMA

T0 = dt.datetime(2026, 3, 16, 10, 0, 0)


def _req(i, typ, cust, items, sub=100.0, rest=1, code=None, promo=0.0, loyalty=0.0):
    return {"request_id": i, "requested_at": T0 + dt.timedelta(seconds=i), "order_type": typ, "customer_id": cust,
            "restaurant_id": rest if typ == "food" else None, "subtotal": sub, "delivery_fee": 50.0,
            "promo_code": code, "promo_discount": promo, "loyalty_discount": loyalty,
            "items": [{"item_id": a, "quantity": q, "unit_price": 10.0} for a, q in items]}


@pytest.fixture(scope="module")
def world(spark):
    menu = spark.createDataFrame(
        [(1, "Pizza Margherita", 1, 0), (2, "Zinger Burger", 2, 1), (3, "Fries", 1, 1), (4, "Cola", 1, 1)],
        "id bigint, name string, restaurant_id bigint, is_available int")
    produce = spark.createDataFrame([(10, "Mango", 0, 30.0), (11, "Apple", 1, 10.0)],
                                    "id bigint, name string, is_available int, stock_kg double")
    promos = spark.createDataFrame(
        [(1, "USED_UP", "percent", 10.0, 0.0, 100, 100, 1), (2, "WELCOME10", "percent", 10.0, 0.0, 100, 45, 1)],
        "id bigint, code string, discount_type string, discount_value double, min_order double, max_uses int, "
        "used_count int, is_active int")
    loyalty = spark.createDataFrame([(5, 5, 5), (7, 20, 20)], "customer_id bigint, total_points bigint, "
                                                               "lifetime_points bigint")
    return menu, produce, promos, loyalty


def test_rollback_and_commit_scenarios(spark, world):
    menu, produce, promos, loyalty = world
    reqs = [
        _req(1, "food", 1, [(1, 1.0)]),                                   # 1A unavailable item
        _req(2, "food", 2, [(2, 1.0)]),                                   # 1B other restaurant's item
        _req(3, "food", 3, [(3, 1.0), (4, 2.0), (3, 1.0)], code="USED_UP"),  # 1C exhausted promo
        _req(4, "food", 5, [(3, 1.0)], loyalty=50.0),                     # 1D 5 points, needs 50
        _req(5, "produce", 6, [(10, 1.0)]),                               # 2A unavailable produce
        _req(6, "food", 7, [(3, 2.0), (4, 1.0)], sub=800.0, code="WELCOME10", promo=32.5, loyalty=10.0),  # 3
    ]
    s = S.settle(spark.createDataFrame(reqs, REQUEST_SCHEMA), menu, produce, promos, loyalty, ui_adds_fee=True)
    got = {r.request_id: (r.accepted, r.error) for r in s.decisions.collect()}
    assert got[1] == (False, "Menu item Pizza Margherita is currently unavailable")
    assert got[2] == (False, "Menu item Zinger Burger does not belong to selected restaurant")
    assert got[3] == (False, "Promo code 'USED_UP' has reached its usage limit (100/100)")
    assert got[4] == (False, "Insufficient loyalty points (have 5, need 50)")
    assert got[5] == (False, "Produce item 'Mango' is currently out of stock")
    assert got[6] == (True, None)

    order = s.accepted.collect()
    assert len(order) == 1 and order[0].total_amount == 847.5 and order[0].points_earned == 8
    ledger = S.loyalty_earn(s).unionByName(S.loyalty_redeem(s))
    bal = {r.customer_id: r.total_points for r in S.loyalty_balances(loyalty, ledger).collect()}
    assert bal[7] == 18 and bal[5] == 5
    used = {r.code: r.used_count for r in S.promo_usage_apply(
        promos, s.accepted.where(F.col("promo_code").isNotNull()).select(F.col("promo_code").alias("code"))).collect()}
    assert used == {"USED_UP": 100, "WELCOME10": 46}
    audit = {r.request_id: (r.action, r.details) for r in S.settlement_audit(s).collect()}
    assert audit[6] == ("PLACE_ORDER", "Order #6 PKR 847.5 promo=WELCOME10 pts=8")
    assert audit[5][0] == "PRODUCE_ORDER_ROLLBACK"


def test_two_lines_of_one_item_share_pre_order_stock(spark, world):
    """6 kg + 6 kg of an item with 10 kg: both lines see 10 kg, the order is
    accepted, stock clamps to 0, the item goes unavailable, the next order fails."""
    menu, _, promos, loyalty = world
    produce = spark.createDataFrame([(11, "Apple", 1, 10.0)], "id bigint, name string, is_available int, stock_kg double")
    reqs = [_req(1, "produce", 1, [(11, 6.0), (11, 6.0)]), _req(2, "produce", 2, [(11, 1.0)])]
    s = S.settle(spark.createDataFrame(reqs, REQUEST_SCHEMA), menu, produce, promos, loyalty, ui_adds_fee=True)
    got = {r.request_id: r.error for r in s.decisions.collect()}
    assert got == {1: None, 2: "Produce item 'Apple' is currently out of stock"}
    taken = s.stock_lines.join(s.decisions.where("accepted"), S.KEY, "left_semi").select("produce_id", "q")
    row = S.stock_deduct(produce, taken).collect()[0]
    assert (row.stock_kg, row.is_available) == (0.0, 0)


def test_not_enough_stock_message(spark, world):
    menu, _, promos, loyalty = world
    produce = spark.createDataFrame([(11, "Apple", 1, 10.0)], "id bigint, name string, is_available int, stock_kg double")
    reqs = [_req(1, "produce", 1, [(11, 7.5)]), _req(2, "produce", 2, [(11, 3.0)])]
    s = S.settle(spark.createDataFrame(reqs, REQUEST_SCHEMA), menu, produce, promos, loyalty, ui_adds_fee=True)
    got = {r.request_id: r.error for r in s.decisions.collect()}
    assert got[2] == "Not enough stock for 'Apple' — requested 3.0kg, only 2.5kg available"


def test_quotes(spark):
    promos = spark.createDataFrame(
        [("TEN", "percent", 10.0, 0.0, 100, 0, 1), ("FLAT500", "fixed", 500.0, 0.0, 100, 0, 1),
         ("FULL", "percent", 10.0, 0.0, 5, 5, 1), ("BIG", "percent", 10.0, 2000.0, 100, 0, 1)],
        "code string, discount_type string, discount_value double, min_order double, max_uses int, "
        "used_count int, is_active int")
    q = spark.createDataFrame([(1, " ten ", 1000.0), (2, "xyz", 1000.0), (3, "", 1000.0), (4, "flat500", 300.0),
                               (5, "full", 100.0), (6, "big", 100.0)], "id int, code string, order_total double")
    got = {r.id: (r.valid, r.discount_amount, r.message) for r in S.quote_promo(q, promos).collect()}
    assert got[1] == (True, 100.0, "\U0001F389 10% off applied! You save PKR 100")
    assert got[2] == (False, None, '"XYZ" is not a valid promo code')
    assert got[3] == (False, None, "Please enter a promo code")
    assert got[4][:2] == (True, 300.0)
    assert got[5][2] == "This promo code has reached its usage limit"
    assert got[6][2] == "Minimum order of PKR 2000 required"


def test_swagger_pricing(spark):
    r = [_req(1, "food", 1, [], sub=1100.0, promo=110.0)]
    p = S.price_requests(spark.createDataFrame(r, REQUEST_SCHEMA), ui_adds_fee=True).collect()[0]
    assert (p.platform_fee, p.total_amount, p.points_earned) == (55.0, 1095.0, 10)


def test_tiers(spark):
    pts = spark.createDataFrame([(i, v) for i, v in enumerate([499, 500, 4999, 5000, 100000])],
                                "customer_id int, lifetime_points bigint")
    got = {r.customer_id: (r.tier, r.progress_pct) for r in
           W.loyalty_tier_progress(pts, C.tier_dim(spark)).collect()}
    assert [got[i][0] for i in range(5)] == ["Bronze", "Silver", "Gold", "Platinum", "Bronze"]
    assert got[3][1] == 100.0 and got[4][1] == 100.0


def test_stock_levels(spark):
    items = spark.createDataFrame([(1, "a", 1, 0.0), (2, "b", 1, 15.0), (3, "c", 1, 16.0), (4, "d", 1, 120.0)],
                                  "id bigint, name string, is_available int, stock_kg double")
    got = {r.id: (r.level, r.pct) for r in B.produce_stock_level(items).collect()}
    assert got == {1: ("out", 0), 2: ("low", 15), 3: ("high", 16), 4: ("high", 100)}


def test_ratings_and_zero_order_restaurant(spark):
    rest = spark.createDataFrame([(1, "A", 4.0), (2, "B", 4.0)], "id bigint, name string, rating double")
    reviews = spark.createDataFrame([(1, 4), (1, 5), (1, 5)], "restaurant_id bigint, rating int")
    got = {r.id: r.rating for r in A.restaurant_rating(rest, reviews).collect()}
    assert got == {1: 4.7, 2: 4.0}
    orders = spark.createDataFrame([(1, "Delivered", 100.0)], "restaurant_id bigint, status string, total_amount double")
    stats = {r.restaurant_id: (r.total_orders, r.revenue, r.platform_fee, r.net_revenue)
             for r in A.manager_stats(rest, orders).collect()}
    assert stats[2] == (0, 0.0, 0.0, 0.0) and stats[1] == (1, 100.0, 5.0, 95.0)


def test_orphan_order_drops_from_joins(spark):
    rest = spark.createDataFrame([(1, "A", "Lahore")], "id bigint, name string, location string")
    orders = spark.createDataFrame([(10, 1), (11, 2)], "id bigint, restaurant_id bigint")
    assert [r.id for r in C.orders_with_restaurant(orders, rest).collect()] == [10]


def test_status_map_defaults(spark):
    o = spark.createDataFrame([(1, "Delivered"), (2, "Cancelled")], "id bigint, status string")
    got = {r.id: (r.step, r.progress, r.eta, r.step_index) for r in order_progress(o, status_dim(spark)).collect()}
    assert got == {1: (4, 100, "Delivered! ✅", 4), 2: (0, 0, "—", -1)}


def test_round_guard_raises_instead_of_returning_unstable(spark, world):
    """Requests competing for one promo use need more than one round; with
    max_rounds=1 the settlement must refuse rather than return a guess."""
    menu, produce, _, loyalty = world
    promos = spark.createDataFrame([(1, "ONE", "percent", 10.0, 0.0, 1, 0, 1)],
                                   "id bigint, code string, discount_type string, discount_value double, "
                                   "min_order double, max_uses int, used_count int, is_active int")
    reqs = [_req(i, "food", 7, [(3, 1.0)], code="ONE") for i in range(1, 4)]
    rdf = spark.createDataFrame(reqs, REQUEST_SCHEMA)
    with pytest.raises(RuntimeError):
        S.settle(rdf, menu, produce, promos, loyalty, max_rounds=1)
    got = {r.request_id: r.accepted for r in S.settle(rdf, menu, produce, promos, loyalty, ui_adds_fee=True).decisions.collect()}
    assert got == {1: True, 2: False, 3: False}
