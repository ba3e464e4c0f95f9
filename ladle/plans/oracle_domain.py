"""The domain mapping written once more, as DuckDB SQL, for the oracle.

Independent of the Spark code on purpose: the oracle re-derives every domain
table from the pre-registered driver views, so a mismatch in either mapping
shows up in the correctness check.
"""

from __future__ import annotations

import re

_PART_TYPES = ("(select p_type pt, cast(row_number() over (order by p_type) as integer) tid "
               "from (select distinct p_type from part) z)")

DOMAIN_CTES: dict[str, str] = {
    "riders": """
select cast(c_custkey // 20 + 1 as bigint) id, cast(c_custkey // 20 + 1 + 2000000 as bigint) user_id,
  case when (c_custkey // 20 + 1) % 3 = 0 then 'Car' else 'Bike' end vehicle_type,
  'LEA-' || cast(c_custkey // 20 + 1 as varchar) license_plate,
  case (c_custkey // 20 + 1) % 4 when 0 then 'pending' when 1 then 'rejected' else 'approved' end status,
  cast(case when (c_custkey // 20 + 1) % 5 = 0 then 0 else 1 end as integer) is_available,
  cast(0 as double) total_earnings
from customer where c_custkey % 20 = 0""",
    "users": """
select id, name, email, '0300-' || lpad(cast(abs(id) % 10000000 as varchar), 7, '0') phone, role, created_at from (
  select c_custkey id, c_name name, 'c' || cast(c_custkey as varchar) || '@example.com' email, 'customer' role,
    cast(date '2020-01-01' + cast(c_custkey % 1461 as integer) as timestamp) created_at from customer
  union all
  select 1000000 + s_suppkey, s_name, 'm' || cast(s_suppkey as varchar) || '@example.com', 'manager',
    cast(date '2019-06-01' + cast(s_suppkey % 365 as integer) as timestamp) from supplier
  union all
  select user_id, 'Rider ' || cast(id as varchar), 'r' || cast(id as varchar) || '@example.com', 'rider',
    cast(date '2021-01-01' + cast(id % 365 as integer) as timestamp) from riders
  union all
  select cast(-1 as bigint), 'Support', 'support@example.com', 'admin', timestamp '2019-01-01 00:00:00'
  from region where r_regionkey = 0) u""",
    "restaurants": """
select s_suppkey id, s_name name, n_name cuisine, r_name location,
  '042-' || lpad(cast(s_suppkey % 10000000 as varchar), 7, '0') phone,
  case when s_suppkey % 6 = 0 then null when s_suppkey % 6 = 1 then ''
       else 'r' || cast(s_suppkey as varchar) || '.jpg' end image_filename,
  cast(4.0 as double) rating, cast(20 + s_suppkey % 31 as integer) delivery_time,
  cast(case when s_suppkey % 10 = 0 then 0 else 1 end as integer) is_open,
  case s_suppkey % 7 when 0 then 'pending' when 1 then 'rejected' else 'approved' end status,
  case when s_suppkey % 5 = 0 then null else 1000000 + s_suppkey end manager_id,
  cast(0 as double) min_order,
  cast(date '2021-01-01' + cast(s_suppkey % 1000 as integer) as timestamp) created_at
from supplier join nation on s_nationkey = n_nationkey join region on n_regionkey = r_regionkey""",
    "supplied_parts": f"""
select l_suppkey, l_partkey, p_name, p_type, p_size, p_retailprice, p_brand, t.tid
from (select distinct l_suppkey, l_partkey from lineitem) pr
join part on l_partkey = p_partkey join {_PART_TYPES} t on t.pt = p_type""",
    "categories": """
select distinct l_suppkey * 1000 + tid id, l_suppkey restaurant_id, p_type name from supplied_parts""",
    "menu_items": """
select l_suppkey * 10000000 + l_partkey id,
  case when p_size % 10 = 0 then null when p_size % 10 = 1 then cast(0 as bigint)
       else l_suppkey * 1000 + tid end category_id,
  l_suppkey restaurant_id, p_name name, p_brand description, p_retailprice price,
  case when l_partkey % 5 = 0 then null else 'm' || cast(l_partkey as varchar) || '.jpg' end image_filename,
  cast(case when p_size % 8 = 0 then 0 else 1 end as integer) is_available
from supplied_parts""",
    "all_orders": """
select o_orderkey ok, case when o_orderkey % 4 = 0 then 'produce' else 'food' end order_type,
  o_custkey customer_id,
  case when o_orderkey % 11 = 0 then 'Cancelled' when o_orderstatus = 'F' then 'Delivered'
       when o_orderstatus = 'P' and o_orderkey % 2 = 0 then 'Out for Delivery'
       when o_orderstatus = 'P' then 'Preparing' when o_orderkey % 2 = 0 then 'Confirmed'
       else 'Pending' end status,
  o_orderdate created_at,
  case when o_orderkey % 7 = 3 then o_custkey % 25 + 1 end promo_id,
  case when o_orderkey % 3 = 0 then 'Cash on Delivery' when o_orderkey % 3 = 1 then 'Card'
       else 'Wallet' end payment_method
from orders""",
    "order_items": """
select l_orderkey * 100000 + l_suppkey order_id, l_suppkey * 10000000 + l_partkey item_id,
  cast(l_quantity as integer) quantity, p_retailprice unit_price
from lineitem join part on l_partkey = p_partkey where l_orderkey % 4 <> 0""",
    "food_orders": """
select i.order_id id, a.customer_id, i.order_id % 100000 restaurant_id,
  case when a.status in ('Out for Delivery', 'Delivered') then a.customer_id // 20 + 1 end rider_id,
  a.status, cast(50 as double) delivery_fee,
  cast(round(sub * cast(0.05 as decimal(4,2)), 2) as double) platform_fee,
  cast(round(sub * cast(0.10 as decimal(4,2)), 2) as double) rider_tip,
  cast(sub + 50 + round(sub * cast(0.05 as decimal(4,2)), 2) as double) total_amount,
  a.payment_method, 35 estimated_time, a.created_at, a.created_at updated_at
from (select order_id, sum(cast(unit_price as decimal(18,2)) * quantity) sub from order_items group by order_id) i
join all_orders a on a.ok = i.order_id // 100000""",
    "produce_items": """
select p_partkey id, p_name name, case when p_size % 2 = 0 then 'fruit' else 'vegetable' end category,
  p_retailprice price_per_kg,
  case when p_partkey % 4 = 0 then null else 'p' || cast(p_partkey as varchar) || '.jpg' end image_filename,
  cast(case when p_size % 8 = 0 then 0 else 1 end as integer) is_available,
  cast(p_size - 1 as double) * 2 stock_kg
from part""",
    "produce_order_items": """
select l_orderkey order_id, l_partkey produce_id, l_quantity / 10 quantity_kg, p_retailprice unit_price
from lineitem join part on l_partkey = p_partkey where l_orderkey % 4 = 0""",
    "produce_orders": """
select a.ok id, a.customer_id,
  case when a.status in ('Out for Delivery', 'Delivered') then a.customer_id // 20 + 1
       when a.ok % 8 = 0 then cast(0 as bigint) end rider_id,
  case when a.status = 'Preparing' then 'Confirmed' else a.status end status,
  cast(50 as double) delivery_fee, cast(sub + 50 as double) total_amount,
  a.payment_method, a.created_at, a.created_at updated_at
from (select order_id,
        sum(cast(cast(cast(quantity_kg as decimal(18,1)) as decimal(18,2)) * cast(unit_price as decimal(18,2))
            as decimal(18,2))) sub
      from produce_order_items group by order_id) i
join all_orders a on a.ok = i.order_id""",
    "messages": """
select conv_id * 100 + turn id,
  cast(case when role = 'user' then conv_id else -1 end as bigint) sender_id,
  cast(case when role = 'user' then -1 else conv_id end as bigint) receiver_id,
  text message, cast(turn % 2 as integer) is_read,
  timestamp '2024-01-01 00:00:00' + to_minutes(conv_id * 60 + turn) created_at
from conversations""",
    "reviews": """
select event_id id, user_id customer_id, event_id % (select count(*) from supplier) restaurant_id,
  cast(1 + event_id % 5 as integer) rating, props comment, ts created_at
from events where event_type = 'view'""",
    "audit_log": """
select event_id id, case when event_type = 'error' then null else user_id end user_id,
  upper(event_type) action, props details, ts "timestamp"
from events""",
    "loyalty_transactions": """
select event_id id, user_id customer_id,
  case when event_type = 'purchase' then cast(trunc(value) as bigint) else -cast(trunc(value / 4) as bigint) end points,
  case when event_type = 'purchase' then 'earn' else 'redeem' end type,
  case when event_type = 'purchase' then 'Earned from order' else 'Redeemed at checkout' end description,
  ts created_at
from events where event_type in ('purchase', 'click')""",
    "loyalty_points": """
select customer_id id, customer_id, cast(sum(points) as bigint) total_points,
  cast(sum(case when points > 0 then points else 0 end) as bigint) lifetime_points
from loyalty_transactions group by customer_id""",
    "promo_codes": """
select c.id, code, discount_type, discount_value, min_order, max_uses,
  cast(coalesce(u.used_count, 0) as integer) used_count, is_active, created_at
from (select cast(n_nationkey + 1 as bigint) id,
        upper(replace(n_name, ' ', '')) || cast(5 + n_nationkey % 4 * 5 as varchar) code,
        case n_nationkey % 4 when 0 then 'percent' when 1 then 'fixed' when 2 then 'percentage'
             else 'percent' end discount_type,
        case when n_nationkey % 4 in (0, 3) then cast(5 + n_nationkey % 4 * 5 as double)
             else cast(25 + n_nationkey % 3 * 25 as double) end discount_value,
        cast(n_nationkey % 3 * 100 as double) min_order,
        cast(case n_nationkey % 3 when 0 then 40 when 1 then 400 else 1000000 end as integer) max_uses,
        cast(case when n_nationkey % 6 = 5 then 0 else 1 end as integer) is_active,
        cast(date '2024-01-01' + cast(n_nationkey as integer) as timestamp) created_at
      from nation) c
left join (select promo_id, count(*) used_count from all_orders where promo_id is not null group by promo_id) u
  on c.id = u.promo_id""",
}

_NAME_RE = {name: re.compile(rf"\b{name}\b") for name in DOMAIN_CTES}


def _deps(sql: str) -> list[str]:
    return [n for n, rx in _NAME_RE.items() if rx.search(sql)]


def with_domain(body: str) -> str:
    """Prefix ``body`` with the domain CTEs it (transitively) references."""
    order: list[str] = []
    seen: set[str] = set()

    def visit(name: str) -> None:
        if name in seen:
            return
        seen.add(name)
        for d in _deps(DOMAIN_CTES[name]):
            if d != name:
                visit(d)
        order.append(name)

    for n in _deps(body):
        visit(n)
    if not order:
        return body.strip()
    ctes = ",\n".join(f"{n} as ({DOMAIN_CTES[n].strip()})" for n in order)
    body = body.strip()
    if body[:5].lower() == "with ":
        return f"with {ctes},\n{body[5:]}"
    return f"with {ctes}\n{body}"
