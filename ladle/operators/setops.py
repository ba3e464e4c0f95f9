"""Unions of the two order families and top-k lists.

Food and produce orders have different columns; both are projected onto one
fixed target schema (missing columns NULL) before ``unionByName``, so the
union's schema does not depend on which side happens to have a column.
Top-k lists are ``orderBy(...).limit(k)`` -> TakeOrderedAndProject: each task
keeps its own k best rows, the driver merges k x tasks rows, no full sort.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .filters import available_food, available_produce
from .joins import PRODUCE_MARKET, PRODUCE_PICKUP, orders_enriched, orders_with_restaurant
from .nested import orders_with_items, produce_orders_with_items

ORDER_COLUMNS = {
    "id": "bigint", "order_type": "string", "customer_id": "bigint", "restaurant_id": "bigint",
    "rider_id": "bigint", "status": "string", "total_amount": "double", "delivery_fee": "double",
    "platform_fee": "double", "rider_tip": "double", "payment_method": "string",
    "created_at": "timestamp_ntz", "restaurant_name": "string",
}


def conform(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    return df.select(*[(F.col(c) if c in df.columns else F.lit(None)).cast(t).alias(c)
                       for c, t in columns.items()])


def union_orders(food: DataFrame, produce: DataFrame, columns: dict[str, str]) -> DataFrame:
    f = food.withColumn("order_type", F.lit("food"))
    p = produce.withColumn("order_type", F.lit("produce")) \
        .withColumn("restaurant_name", F.lit(PRODUCE_MARKET))
    return conform(f, columns).unionByName(conform(p, columns))


def newest_first(df: DataFrame, ts: str = "created_at", k: int | None = None) -> DataFrame:
    out = df.orderBy(F.desc(ts), F.desc("order_type") if "order_type" in df.columns else F.lit(0), F.desc("id"))
    return out if k is None else out.limit(k)


NAMES_BYTES = 32 << 20


def _names(restaurants: DataFrame) -> DataFrame:
    """Ids and names; broadcast if they measure at most ``NAMES_BYTES``, so that orders need no shuffle by restaurant."""
    names = restaurants.select("id", "name")
    size = names.agg(F.sum(F.coalesce(F.octet_length("name"), F.lit(0)) + F.lit(32).cast("bigint"))).first()[0] or 0
    return F.broadcast(names) if size <= NAMES_BYTES else names


def customer_order_history(d) -> DataFrame:
    """Food (with restaurant name) and produce orders of every customer, each
    with ``items[]`` (U2).  Filter ``customer_id`` for one customer."""
    food = orders_with_items(orders_with_restaurant(d.food_orders, _names(d.restaurants)), d.order_items, d.menu_items)
    prod = produce_orders_with_items(d.produce_orders, d.produce_order_items, d.produce_items, detail=False)
    cols = dict(ORDER_COLUMNS, items="array<struct<item_id:bigint,name:string,quantity:double,unit_price:double>>")
    return union_orders(food, prod, cols)


def available_orders(d) -> DataFrame:
    """Unassigned confirmed food and produce orders with pickup details."""
    cols = dict(ORDER_COLUMNS, pickup_location="string", customer_name="string")
    food = orders_enriched(available_food(d.food_orders), d.restaurants, d.users)
    u = d.users.select(F.col("id").alias("_uid"), F.col("name").alias("customer_name"))
    prod = (available_produce(d.produce_orders).join(u, F.col("customer_id") == u["_uid"]).drop("_uid")
            .withColumn("pickup_location", F.lit(PRODUCE_PICKUP)))
    return union_orders(food, prod, cols)


def rider_orders(d) -> DataFrame:
    """Every rider's food and produce orders (U4); produce rows have no
    ``customer_user_id``."""
    cols = dict(ORDER_COLUMNS, pickup_location="string", customer_name="string", customer_phone="string",
                customer_user_id="bigint")
    food = orders_enriched(d.food_orders.where(F.col("rider_id").isNotNull()), d.restaurants, d.users)
    u = d.users.select(F.col("id").alias("_uid"), F.col("name").alias("customer_name"),
                       F.col("phone").alias("customer_phone"))
    prod = (d.produce_orders.where(F.col("rider_id").isNotNull())
            .join(u, F.col("customer_id") == u["_uid"]).drop("_uid")
            .withColumn("pickup_location", F.lit(PRODUCE_PICKUP)))
    return union_orders(food, prod, cols)


def admin_orders(d, food_k: int | None = 200, produce_k: int | None = 100, items: bool = False) -> DataFrame:
    """The admin order list (U5): newest ``food_k`` food orders (with
    restaurant and customer names) merged with the newest ``produce_k``
    produce orders.  ``None`` keeps every order.  With ``items``, produce
    orders carry their ``items[]`` (food orders have none, NULL)."""
    cols = dict(ORDER_COLUMNS, customer_name="string")
    u = d.users.select(F.col("id").alias("_uid"), F.col("name").alias("customer_name"))
    food = orders_with_restaurant(d.food_orders, d.restaurants).join(
        u, F.col("customer_id") == u["_uid"]).drop("_uid")
    prod = d.produce_orders.join(u, F.col("customer_id") == u["_uid"]).drop("_uid")
    if food_k is not None:
        food = food.orderBy(F.desc("created_at"), F.desc("id")).limit(food_k)
    if produce_k is not None:
        prod = prod.orderBy(F.desc("created_at"), F.desc("id")).limit(produce_k)
    if items:
        cols["items"] = "array<struct<item_id:bigint,name:string,quantity:double,unit_price:double>>"
        ids = prod.select(F.col("id").alias("order_id"))
        lines = d.produce_order_items.join(F.broadcast(ids) if produce_k is not None else ids, "order_id", "left_semi")
        prod = produce_orders_with_items(prod, lines, d.produce_items, detail=False)
    return union_orders(food, prod, cols)


def recent_admin_orders(d, k: int = 5) -> DataFrame:
    """The first ``k`` of the merged admin list (L3, admin): newest first, food before produce at the same time."""
    return admin_orders(d, k, k).orderBy(F.desc("created_at"), "order_type", F.desc("id")).limit(k)


def recent_orders_per_restaurant(orders: DataFrame, k: int = 5) -> DataFrame:
    """The first ``k`` of each restaurant's list, newest first (L3, manager)."""
    from .windows import top_n_per_key
    return top_n_per_key(orders, ["restaurant_id"], [F.desc("created_at"), F.desc("id")], k).drop("rn")
