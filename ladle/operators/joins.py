"""Joins of the app.

Inner joins stay inner: the app never enforces foreign keys, so orphans
(orders of a deleted restaurant) drop out of joined reports exactly as they
do there; ``quality.check_orphans`` reports them.

Join strategy is left to Catalyst + AQE: dimension sides whose size is
bounded by construction (tiers, status maps, promo codes) are broadcast
explicitly; every data-sized side is joined by shuffle and AQE converts it to
a broadcast only when runtime statistics show it is under
``spark.sql.adaptive.autoBroadcastJoinThreshold``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PRODUCE_MARKET = "Fresh Produce Market"        # fixed value
PRODUCE_PICKUP = "Produce Warehouse, Lahore"   # fixed value
SYSTEM_USER = "System"                          # fixed value


def _pick(df: DataFrame, alias: str, cols: dict[str, str]) -> DataFrame:
    return df.select(*[F.col(src).alias(f"{alias}{dst}") for src, dst in cols.items()])


def orders_with_restaurant(orders: DataFrame, restaurants: DataFrame) -> DataFrame:
    """orders JOIN restaurants -> restaurant_name."""
    r = restaurants.select(F.col("id").alias("_rid"), F.col("name").alias("restaurant_name"))
    return orders.join(r, orders["restaurant_id"] == r["_rid"]).drop("_rid")


def orders_with_customer(orders: DataFrame, users: DataFrame) -> DataFrame:
    """orders JOIN users -> customer_name."""
    u = users.select(F.col("id").alias("_uid"), F.col("name").alias("customer_name"))
    return orders.join(u, orders["customer_id"] == u["_uid"]).drop("_uid")


def orders_enriched(orders: DataFrame, restaurants: DataFrame, users: DataFrame) -> DataFrame:
    """orders JOIN restaurants JOIN users: restaurant name, pickup location,
    customer name, phone and user id (C3)."""
    r = restaurants.select(F.col("id").alias("_rid"), F.col("name").alias("restaurant_name"),
                           F.col("location").alias("pickup_location"))
    u = users.select(F.col("id").alias("_uid"), F.col("name").alias("customer_name"),
                     F.col("phone").alias("customer_phone"))
    return (orders.join(r, orders["restaurant_id"] == r["_rid"])
            .join(u, F.col("customer_id") == u["_uid"])
            .withColumn("customer_user_id", F.col("_uid")).drop("_rid", "_uid"))


def _rider_names(riders: DataFrame, users: DataFrame) -> DataFrame:
    ru = users.select(F.col("id").alias("_ruid"), F.col("name").alias("rider_name"))
    rr = riders.select(F.col("id").alias("_rider"), F.col("user_id").alias("_ruser"),
                       F.col("vehicle_type").alias("rider_vehicle"))
    return rr.join(ru, rr["_ruser"] == ru["_ruid"], "left").select("_rider", "rider_name", "rider_vehicle")


def order_detail(orders: DataFrame, restaurants: DataFrame, riders: DataFrame, users: DataFrame) -> DataFrame:
    """orders JOIN restaurants LEFT JOIN riders LEFT JOIN users (C4)."""
    r = restaurants.select(F.col("id").alias("_rid"), F.col("name").alias("restaurant_name"),
                           F.col("location").alias("restaurant_location"))
    rn = _rider_names(riders, users)
    return (orders.join(r, orders["restaurant_id"] == r["_rid"])
            .join(rn, F.col("rider_id") == rn["_rider"], "left").drop("_rid", "_rider"))


def produce_order_detail(produce_orders: DataFrame, riders: DataFrame, users: DataFrame) -> DataFrame:
    """produce_orders JOIN users LEFT JOIN riders LEFT JOIN users, with the
    market name and order type literals (C5)."""
    cu = users.select(F.col("id").alias("_cid"), F.col("name").alias("customer_name"))
    rn = _rider_names(riders, users)
    return (produce_orders.join(cu, produce_orders["customer_id"] == cu["_cid"])
            .join(rn, F.col("rider_id") == rn["_rider"], "left")
            .withColumn("restaurant_name", F.lit(PRODUCE_MARKET))
            .withColumn("order_type", F.lit("produce")).drop("_cid", "_rider"))


def restaurants_with_manager(restaurants: DataFrame, users: DataFrame) -> DataFrame:
    """restaurants LEFT JOIN users -> manager_name."""
    u = users.select(F.col("id").alias("_uid"), F.col("name").alias("manager_name"))
    return restaurants.join(u, restaurants["manager_id"] == u["_uid"], "left").drop("_uid")


def audit_with_user(audit_log: DataFrame, users: DataFrame) -> DataFrame:
    """audit_log LEFT JOIN users; no user shown as 'System' (C7)."""
    u = users.select(F.col("id").alias("_uid"), F.col("name").alias("_uname"))
    return (audit_log.join(u, audit_log["user_id"] == u["_uid"], "left")
            .withColumn("user_name", F.coalesce(F.col("_uname"), F.lit(SYSTEM_USER)))
            .drop("_uid", "_uname"))


def riders_with_user(riders: DataFrame, users: DataFrame) -> DataFrame:
    """riders JOIN users -> name, email, phone."""
    u = users.select(F.col("id").alias("_uid"), "name", "email", "phone")
    return riders.join(u, riders["user_id"] == u["_uid"]).drop("_uid")


def order_lines_named(order_items: DataFrame, menu_items: DataFrame) -> DataFrame:
    """order_items JOIN menu_items -> item name; orphan lines drop."""
    m = menu_items.select(F.col("id").alias("_mid"), F.col("name").alias("name"))
    return order_items.join(m, order_items["item_id"] == m["_mid"]).drop("_mid")


def produce_lines_named(produce_order_items: DataFrame, produce_items: DataFrame) -> DataFrame:
    """produce_order_items JOIN produce_items -> name, image, category."""
    p = produce_items.select(F.col("id").alias("_pid"), "name", "image_filename", "category")
    return produce_order_items.join(p, produce_order_items["produce_id"] == p["_pid"]).drop("_pid")


def reviews_with_customer(reviews: DataFrame, users: DataFrame) -> DataFrame:
    """reviews JOIN users -> customer_name (C11)."""
    u = users.select(F.col("id").alias("_uid"), F.col("name").alias("customer_name"))
    return reviews.join(u, reviews["customer_id"] == u["_uid"]).drop("_uid")


def messages_with_sender(messages: DataFrame, users: DataFrame) -> DataFrame:
    """messages JOIN users on the sender -> sender_name."""
    u = users.select(F.col("id").alias("_uid"), F.col("name").alias("sender_name"))
    return messages.join(u, messages["sender_id"] == u["_uid"]).drop("_uid")


def pair_key(a: Column | str = "sender_id", b: Column | str = "receiver_id") -> tuple[Column, Column]:
    a = F.col(a) if isinstance(a, str) else a
    b = F.col(b) if isinstance(b, str) else b
    return F.least(a, b), F.greatest(a, b)


def conversation_pair(messages: DataFrame, users: DataFrame) -> DataFrame:
    """Both directions of every pair, keyed by (least, greatest) instead of
    the app's OR over two orientations -- an equi-key a hash join or a
    partitioned sort can use (C13).  Sender name attached."""
    lo, hi = pair_key()
    return messages_with_sender(messages, users).withColumn("user_lo", lo).withColumn("user_hi", hi)


def admin_contact_ids(messages: DataFrame, admin_id: Column) -> DataFrame:
    """Distinct senders to the admin UNION receivers from the admin."""
    to_admin = messages.where(F.col("receiver_id") == admin_id).select(F.col("sender_id").alias("contact_id"))
    from_admin = messages.where(F.col("sender_id") == admin_id).select(F.col("receiver_id").alias("contact_id"))
    return to_admin.union(from_admin).distinct()


def admin_contacts(messages: DataFrame, users: DataFrame, admin_id: Column) -> DataFrame:
    """Non-admin users IN (contact ids) -- a left-semi join (C14)."""
    ids = admin_contact_ids(messages, admin_id)
    return (users.where(F.col("role") != "admin")
            .join(ids, users["id"] == ids["contact_id"], "left_semi")
            .select("id", "name", "role"))


def menu_uncategorised_anti(menu_items: DataFrame, categorised: DataFrame) -> DataFrame:
    """Items whose id is not among the categorised ids."""
    ids = categorised.select(F.col("id").alias("_cid"))
    return menu_items.join(ids, menu_items["id"] == ids["_cid"], "left_anti")


def tier_dim(spark) -> DataFrame:
    """Loyalty tiers (fixed values): Bronze 0-499, Silver 500-1999,
    Gold 2000-4999, Platinum 5000-99999."""
    rows = [("Bronze", 0, 499), ("Silver", 500, 1999), ("Gold", 2000, 4999), ("Platinum", 5000, 99999)]
    return spark.createDataFrame(rows, "tier string, min_points bigint, max_points bigint")


def loyalty_tier(points: DataFrame, tiers: DataFrame, col: str = "lifetime_points") -> DataFrame:
    """Range join of lifetime points into the 4-row tier table; outside every
    range -> Bronze (C16).  The tier side is 4 rows, broadcast by construction,
    so the range predicate runs as a broadcast nested-loop with no shuffle."""
    t = F.broadcast(tiers.select("tier", "min_points", "max_points"))
    j = points.join(t, (F.col(col) >= F.col("min_points")) & (F.col(col) <= F.col("max_points")), "left")
    return j.withColumn("tier", F.coalesce(F.col("tier"), F.lit("Bronze"))).drop("min_points", "max_points")


def login_profile(users: DataFrame, riders: DataFrame, restaurants: DataFrame) -> DataFrame:
    """User + rider (status, id) for riders, or the managed restaurant (id,
    name, status) for managers; the role sits in the join condition (C17).
    A manager with several restaurants gets the smallest restaurant id."""
    rr = riders.select(F.col("user_id").alias("_ruser"), F.col("status").alias("rider_status"),
                       F.col("id").alias("rider_id"))
    first = (restaurants.where(F.col("manager_id").isNotNull()).groupBy("manager_id")
             .agg(F.min_by(F.struct(F.col("id").alias("restaurant_id"), F.col("name").alias("restaurant_name"),
                                    F.col("status").alias("restaurant_status")), F.col("id")).alias("r")))
    return (users.join(rr, (users["id"] == rr["_ruser"]) & (users["role"] == "rider"), "left")
            .join(first, (users["id"] == first["manager_id"]) & (users["role"] == "manager"), "left")
            .select(F.col("id").alias("user_id"), "role", "name", "email",
                    F.coalesce(F.col("phone"), F.lit("")).alias("phone"),
                    "rider_status", "rider_id", "r.restaurant_id", "r.restaurant_name", "r.restaurant_status"))
