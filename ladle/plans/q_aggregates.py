"""Registered aggregate queries (G1-G17) with their DuckDB oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import aggregates as A
from ..operators import setops as U
from .catalog import query

_ADMIN = "(select min(id) from users where role = 'admin')"


@query("manager_stats", oracle="""
select r.id restaurant_id, coalesce(p.total_orders, 0) total_orders,
  cast(coalesce(p.rev, 0) as double) revenue,
  cast(coalesce(p.rev, 0) * cast(0.05 as decimal(4,2)) as double) platform_fee,
  cast(coalesce(p.rev, 0) - coalesce(p.rev, 0) * cast(0.05 as decimal(4,2)) as double) net_revenue
from restaurants r left join (
  select restaurant_id, count(*) total_orders,
    sum(case when status = 'Delivered' then cast(total_amount as decimal(18,2)) end) rev
  from food_orders group by restaurant_id) p on r.id = p.restaurant_id""")
def _manager_stats(d):
    return A.manager_stats(d.restaurants, d.food_orders)


@query("admin_counts", oracle="""
select (select count(*) from food_orders) total_orders,
  (select count(*) from users where role = 'customer') total_users,
  (select count(*) from riders) total_riders,
  (select count(*) from riders where status = 'pending') pending_riders,
  (select count(*) from restaurants where is_open = 1 and status = 'approved') total_restaurants,
  (select count(*) from restaurants where status = 'pending') pending_restaurants""")
def _admin_counts(d):
    return A.admin_counts(d.food_orders, d.users, d.riders, d.restaurants)


@query("admin_revenue", oracle="""
select cast(coalesce(sum(case when status = 'Delivered' then cast(total_amount as decimal(18,2)) end), 0) as double) revenue,
  cast(coalesce(sum(case when status = 'Delivered' then cast(platform_fee as decimal(18,2)) end), 0) as double) platform_revenue,
  cast(coalesce(sum(cast(platform_fee as decimal(18,2))), 0) as double) total_platform_cut
from food_orders""")
def _admin_revenue(d):
    return A.admin_revenue(d.food_orders)


@query("restaurant_rating", oracle="""
select r.id, r.name,
  coalesce(cast(floor((p.s * 20 + p.n) / (p.n * 2)) as double) / 10, r.rating) rating,
  coalesce(p.n, 0) review_count
from restaurants r left join (
  select restaurant_id, cast(sum(rating) as bigint) s, count(*) n from reviews group by restaurant_id) p
on r.id = p.restaurant_id""")
def _restaurant_rating(d):
    return A.restaurant_rating(d.restaurants, d.reviews)


@query("unread_per_contact", oracle=f"""
select sender_id contact_id, count(*) unread from messages
where receiver_id = {_ADMIN} and is_read = 0 group by sender_id""")
def _unread(d):
    return A.unread_per_contact(d.messages, A.first_admin_id(d.users))


# Whole order history (food with restaurant name, produce as the market).
_ALL_ORDERS_NAMED = """
(select o.total_amount, o.delivery_fee, o.platform_fee, o.rider_tip, r.name restaurant_name
 from food_orders o join restaurants r on o.restaurant_id = r.id join users u on o.customer_id = u.id
 union all
 select p.total_amount, p.delivery_fee, null, null, 'Fresh Produce Market'
 from produce_orders p join users u on p.customer_id = u.id)"""


@query("orders_top10_restaurants", oracle=f"""
select substring(coalesce(nullif(restaurant_name, ''), 'Unknown'), 1, 15) restaurant_label, count(*) orders
from {_ALL_ORDERS_NAMED} x group by 1 order by orders desc, restaurant_label limit 10""")
def _top10(d):
    return A.orders_top_restaurants(U.admin_orders(d, None, None), 10)


@query("revenue_breakdown", oracle=f"""
select cast(coalesce(sum(cast(total_amount as decimal(18,2))), 0) as double) total_gmv,
  cast(floor(greatest(0, coalesce(sum(cast(total_amount as decimal(18,2))), 0)
     - coalesce(sum(cast(delivery_fee as decimal(18,2))), 0)
     - coalesce(sum(cast(platform_fee as decimal(18,2))), 0)
     - coalesce(sum(cast(rider_tip as decimal(18,2))), 0)) + 0.5) as bigint) restaurant_revenue,
  cast(floor(coalesce(sum(cast(platform_fee as decimal(18,2))), 0) + 0.5) as bigint) platform_fee,
  cast(floor(coalesce(sum(cast(delivery_fee as decimal(18,2))), 0) + 0.5) as bigint) delivery_fee,
  cast(floor(coalesce(sum(cast(rider_tip as decimal(18,2))), 0) + 0.5) as bigint) rider_tip
from {_ALL_ORDERS_NAMED} x""")
def _revenue_breakdown(d):
    return A.revenue_breakdown(U.admin_orders(d, None, None))


_HISTORY = """
(select o.customer_id, o.status, o.total_amount from food_orders o join restaurants r on o.restaurant_id = r.id
 union all select customer_id, status, total_amount from produce_orders)"""


@query("customer_profile_stats", oracle=f"""
select customer_id, count(*) total_orders, count(case when status = 'Delivered' then 1 end) delivered,
  cast(coalesce(sum(case when status = 'Delivered' then cast(total_amount as decimal(18,2)) end), 0) as double) spent,
  cast(floor(coalesce(sum(case when status = 'Delivered' then cast(total_amount as decimal(18,2)) end), 0)
       / 1000 + 0.5) as bigint) spent_k
from {_HISTORY} h group by customer_id""")
def _customer_profile(d):
    return A.customer_profile_stats(U.customer_order_history(d))


_RIDER_ORDERS = """
(select o.rider_id, o.status, o.total_amount from food_orders o join restaurants r on o.restaurant_id = r.id
   join users u on o.customer_id = u.id where o.rider_id is not null
 union all select p.rider_id, p.status, p.total_amount from produce_orders p join users u on p.customer_id = u.id
   where p.rider_id is not null)"""


@query("rider_profile_stats", oracle=f"""
select rider_id, count(*) total_orders, count(case when status = 'Delivered' then 1 end) delivered,
  cast(floor(coalesce(sum(case when status = 'Delivered' then cast(total_amount as decimal(18,2)) end), 0)
       * cast(0.10 as decimal(4,2)) + 0.5) as bigint) earnings_est
from {_RIDER_ORDERS} x group by rider_id""")
def _rider_profile(d):
    return A.rider_profile_stats(U.rider_orders(d))


@query("rider_dashboard_stats", oracle=f"""
select rider_id, count(*) deliveries, count(case when status = 'Delivered' then 1 end) completed,
  count(case when status = 'Out for Delivery' then 1 end) active
from {_RIDER_ORDERS} x group by rider_id""")
def _rider_dash(d):
    return A.rider_dashboard_stats(U.rider_orders(d))


@query("promo_summary", oracle="""
select count(*) codes, count(case when coalesce(is_active, 0) <> 0 then 1 end) active_codes,
  cast(coalesce(sum(used_count), 0) as bigint) total_uses from promo_codes""")
def _promo_summary(d):
    return A.promo_summary(d.promo_codes)


@query("produce_stock_summary", oracle="""
select count(*) total,
  count(case when coalesce(is_available, 0) <> 0 and stock_kg > 15 then 1 end) in_stock,
  count(case when coalesce(is_available, 0) <> 0 and stock_kg > 0 and stock_kg <= 15 then 1 end) low,
  count(case when not (coalesce(is_available, 0) <> 0) or stock_kg <= 0 then 1 end) out
from produce_items""")
def _stock_summary(d):
    return A.produce_stock_summary(d.produce_items)


@query("cart_totals", oracle="""
select order_id request_id, cast(sub as double) subtotal, cast(50 as double) delivery_fee,
  cast(floor(sub * cast(0.05 as decimal(4,2)) + 0.5) as double) platform_fee,
  cast(greatest(0, sub + 50 + floor(sub * cast(0.05 as decimal(4,2)) + 0.5)) as double) total
from (select order_id, sum(cast(unit_price as decimal(18,2)) * quantity) sub from order_items group by order_id) c""")
def _cart_totals(d):
    lines = d.order_items.select(F.col("order_id").alias("request_id"), "unit_price", "quantity")
    return A.cart_totals(lines)


@query("line_totals", oracle="""
select order_id, item_id, quantity, unit_price,
  cast(cast(unit_price as decimal(18,2)) * quantity as double) line_total from order_items""")
def _line_totals(d):
    return A.line_totals(d.order_items)


@query("category_item_counts", oracle="""
select c.id category_id, c.restaurant_id, c.name, coalesce(p.items, 0) item_count
from categories c left join (select category_id, count(*) items from menu_items
  where category_id is not null group by category_id) p on c.id = p.category_id""")
def _cat_counts(d):
    return A.category_item_counts(d.categories, d.menu_items)


@query("distinct_cuisines", oracle="""
select distinct cuisine from restaurants where cuisine is not null and cuisine <> '' order by cuisine""")
def _cuisines(d):
    return A.distinct_cuisines(d.restaurants)


@query("conversation_list", oracle=f"""
select u.id, u.name, u.role,
  (select message from messages m where (m.sender_id = u.id and m.receiver_id = {_ADMIN})
     or (m.sender_id = {_ADMIN} and m.receiver_id = u.id) order by created_at desc, id desc limit 1) last_message,
  (select count(*) from messages m where m.sender_id = u.id and m.receiver_id = {_ADMIN} and m.is_read = 0) unread
from users u
where u.id in (select sender_id from messages where receiver_id = {_ADMIN}
               union select receiver_id from messages where sender_id = {_ADMIN})
  and u.role <> 'admin'""")
def _conversation_list(d):
    return A.conversation_list(d.messages, d.users, A.first_admin_id(d.users))
