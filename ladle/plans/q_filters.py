"""Registered filter/projection queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import filters as B
from .catalog import query


@query("scan_table", oracle="select * from menu_items")
def _scan(d):
    """A1: full scan of a named domain table (menu_items here)."""
    return d.menu_items


@query("users_directory", oracle="select id, name, email, phone, role, created_at from users")
def _users_directory(d):
    """A2: the user list without any credential column (newest first when shown)."""
    return d.users.select("id", "name", "email", "phone", "role", "created_at")


@query("restaurants_open", oracle="select * from restaurants where status = 'approved' and is_open = 1")
def _open(d):
    return B.restaurants_open(d.restaurants)


@query("restaurants_all", oracle="select * from restaurants")
def _all(d):
    return B.restaurants_all(d.restaurants)


@query("restaurants_by_manager", oracle="select * from restaurants where manager_id is not null")
def _by_manager(d):
    return B.restaurants_by_manager(d.restaurants)


@query("restaurants_by_cuisine", oracle="select * from restaurants where cuisine = 'NATION_1'")
def _by_cuisine(d):
    return B.restaurants_by_cuisine(d.restaurants, "NATION_1")


@query("menu_available", oracle="select * from menu_items where is_available = 1")
def _menu_available(d):
    return B.menu_available(d.menu_items)


@query("menu_uncategorised", oracle="select * from menu_items where category_id is null or category_id = 0")
def _menu_uncat(d):
    return B.menu_uncategorised(d.menu_items)


@query("produce_search", oracle="""
select * from produce_items where contains(lower(name), 'ro') and category = 'fruit'""")
def _produce_search(d):
    return B.produce_search(d.produce_items, "Ro", "fruit")


@query("users_search", oracle="""
select * from users where (contains(lower(coalesce(name, '')), '#00000001')
  or contains(lower(coalesce(email, '')), '#00000001')) and role = 'manager'""")
def _users_search(d):
    return B.users_search(d.users, "#00000001", "manager")


@query("orders_by_status", oracle="select * from food_orders where status = 'Preparing'")
def _by_status(d):
    return B.orders_by_status(d.food_orders, "Preparing")


@query("approvals_by_status", oracle="select * from riders where status = 'pending'")
def _approvals(d):
    return B.approvals_by_status(d.riders, "pending")


@query("orders_active_past", oracle="""
select *, status in ('Pending', 'Confirmed', 'Preparing', 'Out for Delivery') is_active from food_orders""")
def _active_past(d):
    return B.orders_active_past(d.food_orders)


@query("produce_listing", oracle="select * from produce_items where category = 'vegetable'")
def _produce_listing(d):
    return B.produce_listing(d.produce_items, "vegetable")


_LEVEL = """case when not (coalesce(is_available, 0) <> 0) or stock_kg <= 0 then 'out'
  when stock_kg <= 15 then 'low' else 'high' end"""
_PCT = "least(100, cast(floor(cast(stock_kg as decimal(18,2)) / cast(100 as decimal(18,2)) * 100 + 0.5) as bigint))"


@query("produce_stock_level", oracle=f"""
select id, name, stock_kg, is_available, {_LEVEL} level, {_PCT} pct from produce_items""")
def _stock_level(d):
    return B.produce_stock_level(d.produce_items)


@query("produce_low_or_out", oracle=f"""
select * from (select id, name, stock_kg, is_available, {_LEVEL} level, {_PCT} pct from produce_items) x
where level in ('low', 'out')""")
def _low_out(d):
    return B.produce_low_or_out(d.produce_items)


@query("produce_purchase_cap", oracle="""
select id, name, stock_kg, least(cast(20 as double), case when stock_kg > 0 then stock_kg else cast(20 as double) end) max_kg, cast(0.5 as double) min_kg
from produce_items""")
def _purchase_cap(d):
    return B.produce_purchase_cap(d.produce_items)


@query("audit_by_user", oracle="""
select * from (select *, row_number() over (partition by user_id order by "timestamp" desc, id desc) rn
  from audit_log where user_id is not null) x where rn <= 50""")
def _audit_by_user(d):
    return B.audit_by_user(d.audit_log).withColumn("rn", F.col("rn").cast("bigint"))


@query("available_food_orders_filter", oracle="""
select id, 'food' order_type from food_orders where status = 'Confirmed' and rider_id is null
union all
select id, 'produce' from produce_orders where status = 'Confirmed' and (rider_id is null or rider_id = 0)""")
def _available_filter(d):
    f = B.available_food(d.food_orders).select("id", F.lit("food").alias("order_type"))
    p = B.available_produce(d.produce_orders).select("id", F.lit("produce").alias("order_type"))
    return f.unionByName(p)
