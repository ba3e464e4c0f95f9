"""Registered nested-assembly queries.

Arrays are returned as JSON text (the app answers with JSON too): nested
values then compare exactly across engines.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import nested as N
from .catalog import query

_JSON_OPTS = {"ignoreNullFields": "false"}


def as_json(c: str):
    return F.to_json(F.col(c), _JSON_OPTS).alias(c)


_FOOD_ITEMS = """(select oi.order_id, list(struct_pack(item_id := oi.item_id, name := m.name,
    quantity := cast(oi.quantity as double), unit_price := oi.unit_price)
    order by oi.item_id, m.name, cast(oi.quantity as double), oi.unit_price) items
  from order_items oi join menu_items m on oi.item_id = m.id group by oi.order_id)"""

_PRODUCE_ITEMS_DETAIL = """(select poi.order_id, list(struct_pack(item_id := poi.produce_id, name := p.name,
    quantity := poi.quantity_kg, unit_price := poi.unit_price, image_filename := p.image_filename,
    category := p.category)
    order by poi.produce_id, p.name, poi.quantity_kg, poi.unit_price, p.image_filename, p.category) items
  from produce_order_items poi join produce_items p on poi.produce_id = p.id group by poi.order_id)"""


@query("orders_with_items", oracle=f"""
select o.id, coalesce(cast(to_json(x.items) as varchar), '[]') items
from food_orders o left join {_FOOD_ITEMS} x on o.id = x.order_id""")
def _n1(d):
    return N.orders_with_items(d.food_orders, d.order_items, d.menu_items).select("id", as_json("items"))


@query("produce_orders_with_items", oracle=f"""
select o.id, coalesce(cast(to_json(x.items) as varchar), '[]') items
from produce_orders o left join {_PRODUCE_ITEMS_DETAIL} x on o.id = x.order_id""")
def _n2(d):
    return (N.produce_orders_with_items(d.produce_orders, d.produce_order_items, d.produce_items)
            .select("id", as_json("items")))


_ITEM = ("struct_pack(id := id, name := name, description := description, price := price, "
         "is_available := is_available)")
_ITEM_ORDER = "order by id, name, description, price, is_available"


def _menu_sql(avail_only: bool, label: str, fallback: bool, filled: bool = False) -> str:
    where = "where is_available = 1" if avail_only else ""
    cats = "coalesce(len(p.cs), 0) > 0"
    if fallback:
        expr = (f"case when {cats} then p.cs when e.all_items is not null then "
                f"[struct_pack(id := cast(null as bigint), name := '{label}', items := e.all_items)] else [] end")
    else:
        expr = "coalesce(p.cs, [])"
    if filled:
        expr = f"list_filter({expr}, lambda c: len(c.items) > 0)"
    return f"""
with its as (select * from menu_items {where}),
per_cat as (select category_id, restaurant_id, list({_ITEM} {_ITEM_ORDER}) items from its
  where not (category_id is null or category_id = 0) group by category_id, restaurant_id),
cats as (select c.restaurant_id rid, c.id cid, c.name cname, coalesce(p.items, []) items
  from categories c left join per_cat p on c.id = p.category_id and c.restaurant_id = p.restaurant_id),
loose as (select restaurant_id rid, cast(null as bigint) cid, '{label}' cname, list({_ITEM} {_ITEM_ORDER}) items
  from its where category_id is null or category_id = 0 group by restaurant_id),
grp as (select * from cats union all select * from loose),
per_rest as (select rid, list(struct_pack(id := cid, name := cname, items := items)
  order by coalesce(cid, 9223372036854775807), cid, cname) cs from grp group by rid),
every as (select restaurant_id rid, list({_ITEM} {_ITEM_ORDER}) all_items from its group by restaurant_id)
select r.id, cast(to_json({expr}) as varchar) categories
from restaurants r left join per_rest p on r.id = p.rid left join every e on r.id = e.rid"""


@query("restaurant_menu", oracle=_menu_sql(True, "Menu", True))
def _n3(d):
    return N.restaurant_menu(d.restaurants, d.categories, d.menu_items).select("id", as_json("categories"))


@query("manager_menu", oracle=_menu_sql(False, "Uncategorised", False))
def _n4(d):
    return N.manager_menu(d.restaurants, d.categories, d.menu_items).select("id", as_json("categories"))


@query("menu_filled_categories", oracle=_menu_sql(True, "Menu", True, filled=True))
def _n5(d):
    m = N.restaurant_menu(d.restaurants, d.categories, d.menu_items)
    return N.menu_filled_categories(m).select("id", as_json("categories"))


@query("order_items_summary", oracle="""
select o.id, coalesce(x.t, '') items_text from food_orders o left join (
  select oi.order_id, string_agg(m.name || ' x' || cast(oi.quantity as varchar), ', '
    order by oi.item_id, m.name, cast(oi.quantity as double), oi.unit_price) t
  from order_items oi join menu_items m on oi.item_id = m.id group by oi.order_id) x on o.id = x.order_id""")
def _n6(d):
    return N.order_items_summary(N.orders_with_items(d.food_orders, d.order_items, d.menu_items))


@query("produce_items_summary", oracle="""
select o.id, coalesce(x.t, '') items_text from produce_orders o left join (
  select poi.order_id, string_agg(p.name || ' ' ||
      case when poi.quantity_kg = floor(poi.quantity_kg) then cast(cast(floor(poi.quantity_kg) as bigint) as varchar)
           else cast(poi.quantity_kg as varchar) end || 'kg', ', '
    order by poi.produce_id, p.name, poi.quantity_kg, poi.unit_price) t
  from produce_order_items poi join produce_items p on poi.produce_id = p.id group by poi.order_id) x
on o.id = x.order_id""")
def _n6p(d):
    po = N.produce_orders_with_items(d.produce_orders, d.produce_order_items, d.produce_items, detail=False)
    return N.order_items_summary(po, produce=True)


@query("loyalty_statement", oracle="""
select u.id customer_id, coalesce(lp.total_points, 0) total_points, coalesce(lp.lifetime_points, 0) lifetime_points,
  coalesce(cast(to_json(t.txs) as varchar), '[]') transactions
from users u left join loyalty_points lp on u.id = lp.customer_id
left join (select customer_id, list(struct_pack(id := id, points := points, type := type, description := description,
             created_at := strftime(created_at, '%Y-%m-%d %H:%M:%S')) order by rn) txs
           from (select *, row_number() over (partition by customer_id order by created_at desc, id desc) rn
                 from loyalty_transactions) x where rn <= 20 group by customer_id) t on u.id = t.customer_id
where u.role = 'customer'""")
def _n7(d):
    customers = d.users.where(F.col("role") == "customer")
    return (N.loyalty_statement(customers, d.loyalty_points, d.loyalty_transactions)
            .select("customer_id", "total_points", "lifetime_points", as_json("transactions")))
