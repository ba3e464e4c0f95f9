"""Registered unions and top-k lists."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import setops as U
from .catalog import query
from .q_nested import as_json

_FOOD_ITEMS = """(select oi.order_id, list(struct_pack(item_id := oi.item_id, name := m.name,
    quantity := cast(oi.quantity as double), unit_price := oi.unit_price)
    order by oi.item_id, m.name, cast(oi.quantity as double), oi.unit_price) items
  from order_items oi join menu_items m on oi.item_id = m.id group by oi.order_id)"""
_PRODUCE_ITEMS = """(select poi.order_id, list(struct_pack(item_id := poi.produce_id, name := p.name,
    quantity := poi.quantity_kg, unit_price := poi.unit_price)
    order by poi.produce_id, p.name, poi.quantity_kg, poi.unit_price) items
  from produce_order_items poi join produce_items p on poi.produce_id = p.id group by poi.order_id)"""

@query("customer_order_history", oracle=f"""
select o.id, 'food' order_type, o.customer_id, o.restaurant_id, o.rider_id, o.status, o.total_amount,
  o.delivery_fee, o.platform_fee, o.rider_tip, o.payment_method, o.created_at, r.name restaurant_name,
  coalesce(cast(to_json(x.items) as varchar), '[]') items
from food_orders o join restaurants r on o.restaurant_id = r.id left join {_FOOD_ITEMS} x on o.id = x.order_id
union all
select p.id, 'produce', p.customer_id, null, p.rider_id, p.status, p.total_amount, p.delivery_fee, null, null,
  p.payment_method, p.created_at, 'Fresh Produce Market', coalesce(cast(to_json(x.items) as varchar), '[]')
from produce_orders p left join {_PRODUCE_ITEMS} x on p.id = x.order_id""")
def _u2(d):
    return U.customer_order_history(d).withColumn("items", as_json("items"))


@query("available_orders", oracle="""
select o.id, 'food' order_type, o.customer_id, o.restaurant_id, o.rider_id, o.status, o.total_amount,
  o.delivery_fee, o.platform_fee, o.rider_tip, o.payment_method, o.created_at, r.name restaurant_name,
  r.location pickup_location, u.name customer_name
from food_orders o join restaurants r on o.restaurant_id = r.id join users u on o.customer_id = u.id
where o.status = 'Confirmed' and o.rider_id is null
union all
select p.id, 'produce', p.customer_id, null, p.rider_id, p.status, p.total_amount, p.delivery_fee, null, null,
  p.payment_method, p.created_at, 'Fresh Produce Market', 'Produce Warehouse, Lahore', u.name
from produce_orders p join users u on p.customer_id = u.id
where p.status = 'Confirmed' and (p.rider_id is null or p.rider_id = 0)""")
def _u3(d):
    return U.available_orders(d)


@query("rider_orders", oracle="""
select o.id, 'food' order_type, o.customer_id, o.restaurant_id, o.rider_id, o.status, o.total_amount,
  o.delivery_fee, o.platform_fee, o.rider_tip, o.payment_method, o.created_at, r.name restaurant_name,
  r.location pickup_location, u.name customer_name, u.phone customer_phone, u.id customer_user_id
from food_orders o join restaurants r on o.restaurant_id = r.id join users u on o.customer_id = u.id
where o.rider_id is not null
union all
select p.id, 'produce', p.customer_id, null, p.rider_id, p.status, p.total_amount, p.delivery_fee, null, null,
  p.payment_method, p.created_at, 'Fresh Produce Market', 'Produce Warehouse, Lahore', u.name, u.phone, null
from produce_orders p join users u on p.customer_id = u.id where p.rider_id is not null""")
def _u4(d):
    return U.rider_orders(d)


_ADMIN_FOOD = """(select o.*, r.name restaurant_name, u.name customer_name
  from food_orders o join restaurants r on o.restaurant_id = r.id join users u on o.customer_id = u.id
  order by o.created_at desc, o.id desc limit 200)"""
_ADMIN_PRODUCE = """(select p.*, u.name customer_name from produce_orders p join users u on p.customer_id = u.id
  order by p.created_at desc, p.id desc limit 100)"""


@query("admin_orders", oracle=f"""
select id, 'food' order_type, customer_id, restaurant_id, rider_id, status, total_amount, delivery_fee,
  platform_fee, rider_tip, payment_method, created_at, restaurant_name, customer_name, cast(null as varchar) items
from {_ADMIN_FOOD} f
union all
select id, 'produce', customer_id, null, rider_id, status, total_amount, delivery_fee, null, null,
  payment_method, created_at, 'Fresh Produce Market', customer_name, coalesce(cast(to_json(x.items) as varchar), '[]')
from {_ADMIN_PRODUCE} p left join {_PRODUCE_ITEMS} x on p.id = x.order_id""")
def _u5(d):
    return U.admin_orders(d, items=True).withColumn("items", as_json("items"))


@query("admin_recent_food_200", oracle=f"select * from {_ADMIN_FOOD} f")
def _l1(d):
    from ..operators.joins import orders_with_restaurant
    u = d.users.select(F.col("id").alias("_uid"), F.col("name").alias("customer_name"))
    f = orders_with_restaurant(d.food_orders, d.restaurants).join(u, F.col("customer_id") == u["_uid"]).drop("_uid")
    return f.orderBy(F.desc("created_at"), F.desc("id")).limit(200)


@query("admin_recent_produce_100", oracle=f"select * from {_ADMIN_PRODUCE} p")
def _l2(d):
    u = d.users.select(F.col("id").alias("_uid"), F.col("name").alias("customer_name"))
    p = d.produce_orders.join(u, F.col("customer_id") == u["_uid"]).drop("_uid")
    return p.orderBy(F.desc("created_at"), F.desc("id")).limit(100)


@query("recent_orders_5", oracle="""
select * exclude (rn) from (select *, row_number() over (partition by restaurant_id order by created_at desc, id desc) rn
  from food_orders) x where rn <= 5""")
def _l3(d):
    return U.recent_orders_per_restaurant(d.food_orders, 5)


@query("admin_recent_5", oracle=f"""
select * from (
  select id, 'food' order_type, restaurant_name, customer_name, status, total_amount, created_at from {_ADMIN_FOOD} f
  union all
  select id, 'produce', 'Fresh Produce Market', customer_name, status, total_amount, created_at from {_ADMIN_PRODUCE} p) x
order by created_at desc, order_type, id desc limit 5""")
def _l3_admin(d):
    return U.recent_admin_orders(d, 5).select("id", "order_type", "restaurant_name", "customer_name", "status",
                                              "total_amount", "created_at")


@query("audit_recent_100", oracle="""
select a.*, coalesce(u.name, 'System') user_name from audit_log a left join users u on a.user_id = u.id
order by a."timestamp" desc, a.id desc limit 100""")
def _l4(d):
    from ..operators.joins import audit_with_user
    return audit_with_user(d.audit_log, d.users).orderBy(F.desc("timestamp"), F.desc("id")).limit(100)


@query("first_admin", oracle="select min(id) id from users where role = 'admin'")
def _l5(d):
    return d.users.where(F.col("role") == "admin").agg(F.min("id").alias("id"))


@query("promos_newest", oracle="select * from promo_codes order by created_at desc, id desc")
def _l6a(d):
    return d.promo_codes.orderBy(F.desc("created_at"), F.desc("id"))


@query("restaurants_newest", oracle="""
select r.*, u.name manager_name from restaurants r left join users u on r.manager_id = u.id
order by r.created_at desc, r.id desc""")
def _l6b(d):
    from ..operators.joins import restaurants_with_manager
    return restaurants_with_manager(d.restaurants, d.users).orderBy(F.desc("created_at"), F.desc("id"))

