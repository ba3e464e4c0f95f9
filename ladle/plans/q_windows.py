"""Registered window / running-value queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import joins as C
from ..operators import windows as W
from .catalog import query


@query("last_message_per_contact", oracle="""
select user_lo, user_hi, id, sender_id, receiver_id, message, created_at from (
  select least(sender_id, receiver_id) user_lo, greatest(sender_id, receiver_id) user_hi, *,
    row_number() over (partition by least(sender_id, receiver_id), greatest(sender_id, receiver_id)
                       order by created_at desc, id desc) rn
  from messages) x where rn = 1""")
def _w1(d):
    return W.last_message_per_contact(d.messages)


@query("loyalty_last20", oracle="""
select * from (select *, row_number() over (partition by customer_id order by created_at desc, id desc) rn
  from loyalty_transactions) x where rn <= 20""")
def _w2(d):
    return W.loyalty_last20(d.loyalty_transactions).withColumn("rn", F.col("rn").cast("bigint"))


@query("promo_usage_running", oracle="""
select ok id, order_type, promo_id, created_at,
  coalesce(count(*) over (partition by promo_id order by created_at, order_type, ok
                          rows between unbounded preceding and 1 preceding), 0) uses_before
from all_orders where promo_id is not null""")
def _w3(d):
    po = d.all_orders.where(F.col("promo_id").isNotNull()).select(
        F.col("ok").alias("id"), "order_type", "promo_id", "created_at")
    return W.promo_usage_running(po)


@query("loyalty_balance_running", oracle="""
select *, cast(balance_before + points as bigint) balance_after from (
  select *, cast(coalesce(sum(points) over (partition by customer_id order by created_at, id
                                       rows between unbounded preceding and 1 preceding), 0) as bigint) balance_before
  from loyalty_transactions) x""")
def _w4(d):
    return W.loyalty_balance_running(d.loyalty_transactions).withColumn(
        "balance_before", F.col("balance_before").cast("bigint")).withColumn(
        "balance_after", F.col("balance_after").cast("bigint"))


@query("stock_running", oracle="""
with lines as (select poi.order_id, poi.produce_id, poi.quantity_kg, poi.unit_price, po.created_at
  from produce_order_items poi join produce_orders po on poi.order_id = po.id),
per as (select produce_id, order_id, created_at, sum(cast(quantity_kg as decimal(18,6))) q
  from lines group by produce_id, order_id, created_at),
run as (select *, coalesce(sum(q) over (partition by produce_id order by created_at, order_id
                                      rows between unbounded preceding and 1 preceding), 0) used_before from per)
select l.produce_id, l.order_id, l.quantity_kg, l.unit_price, l.created_at,
  cast(greatest(0, cast(p.stock_kg as decimal(18,6)) - r.used_before) as double) stock_before
from lines l join run r on l.produce_id = r.produce_id and l.order_id = r.order_id
join produce_items p on p.id = l.produce_id""")
def _w5(d):
    lines = d.produce_order_items.join(
        d.produce_orders.select(F.col("id").alias("order_id"), "created_at"), "order_id")
    return W.stock_running(lines, d.produce_items)


_TIERS = """(select * from (values ('Bronze', 0, 499), ('Silver', 500, 1999), ('Gold', 2000, 4999),
  ('Platinum', 5000, 99999)) t(tier, min_points, max_points))"""


@query("loyalty_tier_progress", oracle=f"""
with tiers as {_TIERS},
nxt as (select tier, min_points, lead(tier) over (order by min_points) next_tier,
          lead(min_points) over (order by min_points) next_min from tiers),
t as (select lp.*, coalesce(t.tier, 'Bronze') tier from loyalty_points lp
      left join tiers t on lp.lifetime_points between t.min_points and t.max_points)
select t.id, t.customer_id, t.total_points, t.lifetime_points, t.tier, n.next_tier,
  case when n.next_min is null then 100.0
       else least(100.0, cast(t.lifetime_points - n.min_points as double) / cast(n.next_min - n.min_points as double) * 100)
  end progress_pct,
  n.next_min - t.lifetime_points points_to_next
from t left join nxt n on t.tier = n.tier""")
def _w6(d):
    return W.loyalty_tier_progress(d.loyalty_points, C.tier_dim(d.spark))


@query("review_rating_running", oracle="""
select id, customer_id, restaurant_id, rating, comment, created_at,
  cast(floor((s * 20 + n) / (n * 2)) as double) / 10 rating_after from (
  select *, sum(cast(rating as bigint)) over w s, count(*) over w n from reviews
  window w as (partition by restaurant_id order by created_at, id rows between unbounded preceding and current row)) x""")
def _w7(d):
    return W.review_rating_running(d.reviews)
