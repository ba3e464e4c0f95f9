"""Registered join queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import aggregates as A
from ..operators import joins as C
from .catalog import query

_ADMIN = "(select min(id) from users where role = 'admin')"


@query("orders_with_restaurant", oracle="""
select o.*, r.name restaurant_name from food_orders o join restaurants r on o.restaurant_id = r.id""")
def _c1(d):
    return C.orders_with_restaurant(d.food_orders, d.restaurants)


@query("orders_with_customer", oracle="""
select o.*, u.name customer_name from food_orders o join users u on o.customer_id = u.id""")
def _c2(d):
    return C.orders_with_customer(d.food_orders, d.users)


@query("orders_enriched", oracle="""
select o.*, r.name restaurant_name, r.location pickup_location, u.name customer_name, u.phone customer_phone,
  u.id customer_user_id
from food_orders o join restaurants r on o.restaurant_id = r.id join users u on o.customer_id = u.id""")
def _c3(d):
    return C.orders_enriched(d.food_orders, d.restaurants, d.users)


_RIDER_NAMES = """(select ri.id rider_key, u.name rider_name, ri.vehicle_type rider_vehicle
  from riders ri left join users u on ri.user_id = u.id)"""


@query("order_detail", oracle=f"""
select o.*, r.name restaurant_name, r.location restaurant_location, rn.rider_name, rn.rider_vehicle
from food_orders o join restaurants r on o.restaurant_id = r.id
left join {_RIDER_NAMES} rn on o.rider_id = rn.rider_key""")
def _c4(d):
    return C.order_detail(d.food_orders, d.restaurants, d.riders, d.users)


@query("produce_order_detail", oracle=f"""
select po.*, u.name customer_name, rn.rider_name, rn.rider_vehicle,
  'Fresh Produce Market' restaurant_name, 'produce' order_type
from produce_orders po join users u on po.customer_id = u.id
left join {_RIDER_NAMES} rn on po.rider_id = rn.rider_key""")
def _c5(d):
    return C.produce_order_detail(d.produce_orders, d.riders, d.users)


@query("restaurants_with_manager", oracle="""
select r.*, u.name manager_name from restaurants r left join users u on r.manager_id = u.id""")
def _c6(d):
    return C.restaurants_with_manager(d.restaurants, d.users)


@query("audit_with_user", oracle="""
select a.*, coalesce(u.name, 'System') user_name from audit_log a left join users u on a.user_id = u.id""")
def _c7(d):
    return C.audit_with_user(d.audit_log, d.users)


@query("riders_with_user", oracle="""
select r.*, u.name, u.email, u.phone from riders r join users u on r.user_id = u.id""")
def _c8(d):
    return C.riders_with_user(d.riders, d.users)


@query("order_lines_named", oracle="""
select oi.*, m.name from order_items oi join menu_items m on oi.item_id = m.id""")
def _c9(d):
    return C.order_lines_named(d.order_items, d.menu_items)


@query("produce_lines_named", oracle="""
select poi.*, p.name, p.image_filename, p.category
from produce_order_items poi join produce_items p on poi.produce_id = p.id""")
def _c10(d):
    return C.produce_lines_named(d.produce_order_items, d.produce_items)


@query("reviews_with_customer", oracle="""
select rv.*, u.name customer_name from reviews rv join users u on rv.customer_id = u.id""")
def _c11(d):
    return C.reviews_with_customer(d.reviews, d.users)


@query("messages_with_sender", oracle="""
select m.*, u.name sender_name from messages m join users u on m.sender_id = u.id""")
def _c12(d):
    return C.messages_with_sender(d.messages, d.users)


@query("conversation_pair", oracle="""
select m.*, u.name sender_name, least(sender_id, receiver_id) user_lo, greatest(sender_id, receiver_id) user_hi
from messages m join users u on m.sender_id = u.id""")
def _c13(d):
    return C.conversation_pair(d.messages, d.users)


@query("admin_contacts", oracle=f"""
select id, name, role from users where role <> 'admin' and id in (
  select sender_id from messages where receiver_id = {_ADMIN}
  union select receiver_id from messages where sender_id = {_ADMIN})""")
def _c14(d):
    return C.admin_contacts(d.messages, d.users, A.first_admin_id(d.users))


@query("admin_contact_ids", oracle=f"""
select sender_id contact_id from messages where receiver_id = {_ADMIN}
union select receiver_id from messages where sender_id = {_ADMIN}""")
def _u1(d):
    return C.admin_contact_ids(d.messages, A.first_admin_id(d.users))


@query("menu_uncategorised_anti", oracle="""
select * from menu_items m where (m.category_id is null or m.category_id = 0)
  and m.id not in (select id from menu_items where category_id is not null and category_id <> 0
                   and category_id in (select id from categories))""")
def _c15(d):
    from ..operators.filters import menu_uncategorised, uncategorised
    categorised = d.menu_items.where(~uncategorised()).join(
        d.categories.select(F.col("id").alias("_c")), F.col("category_id") == F.col("_c"), "left_semi")
    return C.menu_uncategorised_anti(menu_uncategorised(d.menu_items), categorised)


_TIERS = """(select * from (values ('Bronze', 0, 499), ('Silver', 500, 1999), ('Gold', 2000, 4999),
  ('Platinum', 5000, 99999)) t(tier, min_points, max_points))"""


@query("loyalty_tier", oracle=f"""
select lp.id, lp.customer_id, lp.total_points, lp.lifetime_points, coalesce(t.tier, 'Bronze') tier
from loyalty_points lp left join {_TIERS} t on lp.lifetime_points between t.min_points and t.max_points""")
def _c16(d):
    return C.loyalty_tier(d.loyalty_points, C.tier_dim(d.spark))


@query("login_profile", oracle="""
select u.id user_id, u.role, u.name, u.email, coalesce(u.phone, '') phone,
  r.status rider_status, r.id rider_id, m.restaurant_id, m.restaurant_name, m.restaurant_status
from users u
left join riders r on u.id = r.user_id and u.role = 'rider'
left join (select manager_id, min(id) restaurant_id, arg_min(name, id) restaurant_name,
             arg_min(status, id) restaurant_status
           from restaurants where manager_id is not null group by manager_id) m
  on u.id = m.manager_id and u.role = 'manager'""")
def _c17(d):
    return C.login_profile(d.users, d.riders, d.restaurants)
