"""Registered settlement queries.

The batch replays every historic order as a placement request against the
start-of-run tables (promo uses reset to 0).  Its decisions are written once
per session and scale and shared by the views derived from them (S8-S11,
S15-S17).
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import settlement as S
from ..sources.requests import derived_requests
from ..sources.staging import scratch, staged
from ..streaming.ledger import Start, settle_arrivals
from .catalog import query

_CACHE: dict[tuple, S.Settlement] = {}


def _stamp(d) -> tuple:
    """Path, size and time of the input tables: a changed input is settled anew."""
    path = d.spark._jvm.org.apache.hadoop.fs.Path(d.sf_dir)
    files = path.getFileSystem(d.spark._jsc.hadoopConfiguration()).listStatus(path)
    return tuple(sorted((f.getPath().toString(), f.getLen(), f.getModificationTime()) for f in files))


def batch(d) -> S.Settlement:
    key = (d.spark.sparkContext.applicationId, *_stamp(d))
    if key not in _CACHE:
        promos = d.promo_codes.withColumn("used_count", F.lit(0))
        _CACHE[key] = S.settle(derived_requests(d), d.menu_items, d.produce_items, promos, d.loyalty_points,
                               ui_adds_fee=True)  # derived requests carry the bare subtotal; the page adds the fee
    return _CACHE[key]


_REQ = """
fr as (select o.id request_id, 'food' order_type, o.customer_id, o.created_at requested_at, x.sub, a.promo_id
  from food_orders o
  join (select order_id, sum(cast(unit_price as decimal(18,2)) * quantity) sub from order_items group by order_id) x
    on o.id = x.order_id
  join all_orders a on a.ok = o.id // 100000),
pr as (select o.id request_id, 'produce' order_type, o.customer_id, o.created_at requested_at, x.sub, a.promo_id
  from produce_orders o
  join (select order_id, sum(cast(cast(cast(quantity_kg as decimal(18,1)) as decimal(18,2))
          * cast(unit_price as decimal(18,2)) as decimal(18,2))) sub from produce_order_items group by order_id) x
    on o.id = x.order_id
  join all_orders a on a.ok = o.id),
req as (select r.*, p.code promo_code,
  coalesce(round_even(least(case when p.discount_type = 'percent'
      then round(cast(r.sub as decimal(18,2)) * cast(p.discount_value as decimal(18,2)) * cast(0.01 as decimal(3,2)), 2)
      else cast(p.discount_value as decimal(18,2)) end, cast(r.sub as decimal(18,2))), 0), 0) promo_discount,
  case when r.request_id % 9 = 0 then cast(5 as decimal(18,2)) else cast(0 as decimal(18,2)) end loyalty_discount
  from (select * from fr union all select * from pr) r left join promo_codes p on r.promo_id = p.id)"""


@query("price_food_orders", oracle=f"""
with {_REQ}
select request_id, customer_id, cast(sub as double) subtotal, promo_code, cast(promo_discount as double) promo_discount,
  cast(loyalty_discount as double) loyalty_discount,
  cast(round(sub * cast(0.05 as decimal(4,2)), 2) as double) platform_fee,
  cast(round(sub * cast(0.10 as decimal(4,2)), 2) as double) rider_tip,
  cast(round(greatest(0, sub + 50 + round(sub * cast(0.05 as decimal(4,2)), 2) - promo_discount - loyalty_discount), 2)
       as double) total_amount
from req where order_type = 'food'""")
def _s1(d):
    r = derived_requests(d).where(F.col("order_type") == "food")
    return S.price_food_orders(r).select("request_id", "customer_id", "subtotal", "promo_code", "promo_discount",
                                         "loyalty_discount", "platform_fee", "rider_tip", "total_amount")


@query("price_produce_orders", oracle=f"""
with {_REQ}
select request_id, customer_id, cast(sub as double) subtotal, promo_code, cast(promo_discount as double) promo_discount,
  cast(loyalty_discount as double) loyalty_discount,
  cast(round(greatest(0, sub + 50 + 50 - promo_discount - loyalty_discount), 2) as double) total_amount
from req where order_type = 'produce'""")
def _s2(d):
    r = derived_requests(d).where(F.col("order_type") == "produce")
    return S.price_produce_orders(r, ui_adds_fee=True).select("request_id", "customer_id", "subtotal", "promo_code", "promo_discount",
                                            "loyalty_discount", "total_amount")


@query("validate_food_items", oracle="""
with lines as (select oi.order_id, oi.item_id, row_number() over (partition by oi.order_id
                 order by oi.item_id, cast(oi.quantity as double), oi.unit_price) pos
               from order_items oi),
e as (select l.order_id, l.pos, case when m.id is null then 'Menu item ' || l.item_id || ' not found'
          when m.restaurant_id <> l.order_id % 100000 then 'Menu item ' || m.name || ' does not belong to selected restaurant'
          when coalesce(m.is_available, 0) = 0 then 'Menu item ' || m.name || ' is currently unavailable' end error
      from lines l left join menu_items m on l.item_id = m.id)
select 'food' order_type, order_id request_id, arg_min(error, pos) item_error from e
where error is not null and order_id in (select id from food_orders) group by order_id""")
def _s3(d):
    return S.validate_food_items(derived_requests(d), d.menu_items)


@query("validate_produce_items", oracle="""
with lines as (select poi.order_id, poi.produce_id, poi.quantity_kg, row_number() over (partition by poi.order_id
                 order by poi.produce_id, poi.quantity_kg, poi.unit_price) pos
               from produce_order_items poi),
e as (select l.order_id, l.pos, case when p.id is null then 'Produce item ' || l.produce_id || ' not found'
          when coalesce(p.is_available, 0) = 0 or p.stock_kg <= 0
            then 'Produce item ''' || p.name || ''' is currently out of stock'
          when l.quantity_kg > p.stock_kg then 'Not enough stock for ''' || p.name || ''' — requested '
            || cast(l.quantity_kg as varchar) || 'kg, only ' || cast(p.stock_kg as varchar) || 'kg available' end error
      from lines l left join produce_items p on l.produce_id = p.id)
select 'produce' order_type, order_id request_id, arg_min(error, pos) item_error from e
where error is not null and order_id in (select id from produce_orders) group by order_id""")
def _s4(d):
    return S.validate_produce_items(derived_requests(d), d.produce_items)


@query("quote_promo", oracle=f"""
with {_REQ},
qs as (select request_id, lower(promo_code) || '  ' code, cast(sub as double) order_total from req
       where promo_code is not null),
j as (select qs.*, upper(trim(qs.code)) clean, p.code pc, p.discount_type, p.discount_value, p.min_order, p.max_uses,
        p.used_count from qs left join (select * from promo_codes where is_active = 1) p on upper(trim(qs.code)) = p.code),
c as (select *, round_even(least(case when discount_type = 'percent'
        then round(cast(order_total as decimal(18,2)) * cast(discount_value as decimal(18,2)) * cast(0.01 as decimal(3,2)), 2)
        else cast(discount_value as decimal(18,2)) end, cast(order_total as decimal(18,2))), 0) disc,
      case when clean = '' then 'Please enter a promo code'
           when pc is null then '"' || clean || '" is not a valid promo code'
           when used_count >= max_uses then 'This promo code has reached its usage limit'
           when cast(order_total as decimal(18,2)) < cast(min_order as decimal(18,2))
             then 'Minimum order of PKR ' || cast(cast(trunc(min_order) as bigint) as varchar) || ' required' end err
      from j)
select request_id, code, order_total, clean clean_code, err is null valid,
  case when err is null then cast(disc as double) end discount_amount,
  case when err is null then '\U0001F389 ' || case when discount_type = 'percent'
         then cast(cast(trunc(discount_value) as bigint) as varchar) || '% off'
         else 'PKR ' || cast(cast(trunc(discount_value) as bigint) as varchar) || ' off' end
       || ' applied! You save PKR ' || cast(cast(disc as bigint) as varchar) else err end message
from c""")
def _s7(d):
    r = derived_requests(d).where(F.col("promo_code").isNotNull())
    quotes = r.select("request_id", F.concat(F.lower("promo_code"), F.lit("  ")).alias("code"),
                      F.col("subtotal").alias("order_total"))
    return S.quote_promo(quotes, d.promo_codes)


_PRICED = """
priced as (select *, cast(trunc(total / 100) as bigint) points_earned,
    case when loyalty_discount > 0 then cast(trunc(loyalty_discount) as bigint) else 0 end redeem_points
  from (select *, case when order_type = 'food'
      then round(greatest(0, sub + 50 + round(sub * cast(0.05 as decimal(4,2)), 2) - promo_discount - loyalty_discount), 2)
      else round(greatest(0, sub + 50 + 50 - promo_discount - loyalty_discount), 2) end total from req) x)"""

_USES = """count(*) over (partition by c.id order by p.requested_at, p.order_type, p.request_id
    rows between unbounded preceding and 1 preceding)"""


@query("validate_promo_use", oracle=f"""
with {_REQ}, {_PRICED.strip()}
select p.order_type, p.request_id, p.promo_code,
  case when c.id is not null then {_USES} end uses_before,
  case when c.id is null then 'Promo code ''' || p.promo_code || ''' is invalid or inactive'
       when {_USES} >= c.max_uses then 'Promo code ''' || p.promo_code || ''' has reached its usage limit ('
            || c.max_uses || '/' || c.max_uses || ')' end promo_error
from priced p left join (select * from promo_codes where is_active = 1) c on p.promo_code = c.code
where p.promo_code is not null and p.promo_code <> ''""")
def _s5(d):
    r = S.price_requests(derived_requests(d), ui_adds_fee=True)
    return S.validate_promo_use(r, d.promo_codes.withColumn("used_count", F.lit(0)))


@query("validate_loyalty", oracle=f"""
with {_REQ}, {_PRICED.strip()},
mv as (select *, points_earned - redeem_points delta from priced
       where points_earned - redeem_points <> 0 or loyalty_discount > 0),
run as (select *, coalesce(sum(delta) over (partition by customer_id order by requested_at, order_type, request_id
          rows between unbounded preceding and 1 preceding), 0) moved from mv)
select r.order_type, r.request_id, r.customer_id, cast(r.loyalty_discount as double) loyalty_discount,
  cast(coalesce(l.total_points, 0) + r.moved as bigint) points_before,
  case when coalesce(l.total_points, 0) + r.moved < cast(trunc(r.loyalty_discount) as bigint)
    then 'Insufficient loyalty points (have ' || cast(coalesce(l.total_points, 0) + r.moved as bigint) || ', need '
         || cast(trunc(r.loyalty_discount) as bigint) || ')' end loyalty_error
from run r left join loyalty_points l on r.customer_id = l.customer_id where r.loyalty_discount > 0""")
def _s6(d):
    return S.validate_loyalty(S.price_requests(derived_requests(d), ui_adds_fee=True), d.loyalty_points)


def _orders(d):
    return batch(d).orders.select("order_type", "request_id", "customer_id", "accepted", "error", "total_amount",
                                  "platform_fee", "rider_tip", "points_earned", "promo_code", "requested_at")


@query("settle_food_orders")
def _s8(d):
    return _orders(d).where(F.col("order_type") == "food")


@query("settle_produce_orders")
def _s9(d):
    return _orders(d).where(F.col("order_type") == "produce")


@query("loyalty_earn")
def _s10(d):
    return S.loyalty_earn(batch(d))


@query("loyalty_redeem")
def _s11(d):
    return S.loyalty_redeem(batch(d))


@query("loyalty_manual_earn", oracle="""
select customer_id, cast(trunc(total_amount / 100) as bigint) points, 'earn' type,
  'Earned from order PKR ' || cast(cast(trunc(total_amount) as bigint) as varchar) description, id order_id
from food_orders where status = 'Delivered'""")
def _s12(d):
    from ..operators.changes import loyalty_manual_earn
    req = d.food_orders.where(F.col("status") == "Delivered").select(
        "customer_id", F.col("total_amount").alias("order_amount"), F.col("id").alias("order_id"))
    return loyalty_manual_earn(req)


@query("loyalty_manual_redeem")
def _s13(d):
    from ..operators.changes import loyalty_manual_redeem
    tx = d.loyalty_transactions
    req = tx.where(F.col("type") == "redeem").select(
        F.col("id").alias("request_id"), "customer_id", (-F.col("points")).alias("points"),
        F.col("created_at").alias("requested_at"))
    start = tx.where(F.col("type") == "earn").groupBy("customer_id").agg(F.sum("points").alias("total_points"))
    return loyalty_manual_redeem(req, start)


@query("loyalty_reconcile", oracle="""
select coalesce(p.customer_id, l.customer_id) customer_id, coalesce(p.total_points, 0) stored,
  coalesce(l.s, 0) ledger, coalesce(p.total_points, 0) - coalesce(l.s, 0) diff
from loyalty_points p full join (select customer_id, cast(sum(points) as bigint) s from loyalty_transactions
  group by customer_id) l on p.customer_id = l.customer_id""")
def _s14(d):
    from ..operators.changes import loyalty_reconcile
    return loyalty_reconcile(d.loyalty_points, d.loyalty_transactions)


@query("promo_usage_apply")
def _s15(d):
    s = batch(d)
    uses = s.accepted.where(F.col("promo_code").isNotNull()).select(F.col("promo_code").alias("code"))
    return S.promo_usage_apply(d.promo_codes.withColumn("used_count", F.lit(0)), uses)


@query("stock_deduct")
def _s16(d):
    s = batch(d)
    taken = s.stock_lines.join(s.decisions.where("accepted"), S.KEY, "left_semi").select("produce_id", "q")
    return S.stock_deduct(d.produce_items, taken)


@query("settlement_audit")
def _s17(d):
    return S.settlement_audit(batch(d))


@query("settled_food_items")
def _s8_lines(d):
    """Order lines written with the accepted food orders."""
    return batch(d).accepted_lines.where(F.col("order_type") == "food").drop("order_type")


@query("settled_produce_items")
def _s9_lines(d):
    """Order lines written with the accepted produce orders; ``quantity`` is in kg."""
    return batch(d).accepted_lines.where(F.col("order_type") == "produce").drop("order_type")


@query("settled_balances")
def _s10_balances(d):
    """Balances after the ledger rows of all accepted orders."""
    s = batch(d)
    return S.loyalty_balances(d.loyalty_points, S.loyalty_earn(s).unionByName(S.loyalty_redeem(s)))


# Arriving files of the replayed order history: by requests, up to a number.  A batch costs some forty Spark jobs and
# rewrites the state that it leaves, so with more input the files grow, not their number.
ROWS_PER_FILE = 25_000
MOST_FILES = 4


@query("stream_settlement")
def _x9(d):
    """The order history arrives as files of requests in time order; every file is
    settled once, against the state the files before it left."""
    requests = staged(derived_requests(d), "arriving")
    inbox, root = scratch(d.spark, "inbox"), scratch(d.spark, "ledger")
    files = min(-(-requests.count() // ROWS_PER_FILE), MOST_FILES)
    requests.repartitionByRange(max(1, files), *S.ORDER).write.parquet(inbox)
    promos = d.promo_codes.withColumn("used_count", F.lit(0))
    return settle_arrivals(d.spark, inbox, root, d.menu_items, Start(promos, d.loyalty_points, d.produce_items),
                           ui_adds_fee=True)
