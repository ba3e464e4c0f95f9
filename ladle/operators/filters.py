"""Projections, filters and derived-predicate columns.

Point lookups of the app (``WHERE id = ?``) become whole-table views with an
optional key argument: when given, the predicate sits directly on the scan
side so Catalyst pushes it into the parquet reader.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .aggregates import FULL_STOCK_KG, LOW_STOCK_KG

ACTIVE_ORDER_STATUSES = ("Pending", "Confirmed", "Preparing", "Out for Delivery")  # fixed value


def truthy(c: Column | str) -> Column:
    """SQLite/Python truthiness of a 0/1 flag: NULL and 0 are false."""
    c = F.col(c) if isinstance(c, str) else c
    return F.coalesce(c, F.lit(0)) != 0


def _maybe(df: DataFrame, cond: Column | None) -> DataFrame:
    return df if cond is None else df.where(cond)


def restaurants_open(restaurants: DataFrame) -> DataFrame:
    """Approved and open, best rated first (B1)."""
    return restaurants.where((F.col("status") == "approved") & (F.col("is_open") == 1)).orderBy(F.desc("rating"), "id")


def restaurants_all(restaurants: DataFrame) -> DataFrame:
    """Every restaurant, best rated first (B2)."""
    return restaurants.orderBy(F.desc("rating"), "id")


def restaurants_by_manager(restaurants: DataFrame, manager_id=None) -> DataFrame:
    """Restaurants of a manager, any status, newest first."""
    return _maybe(restaurants.where(F.col("manager_id").isNotNull()),
                  None if manager_id is None else F.col("manager_id") == manager_id).orderBy(F.desc("created_at"), "id")


def restaurants_by_cuisine(restaurants: DataFrame, cuisine: str = "all") -> DataFrame:
    """Equality filter; 'all' means no filter."""
    return restaurants if cuisine == "all" else restaurants.where(F.col("cuisine") == cuisine)


def menu_available(menu_items: DataFrame, restaurant_id=None) -> DataFrame:
    """Available items, optionally of one restaurant."""
    cond = F.col("is_available") == 1
    if restaurant_id is not None:
        cond = cond & (F.col("restaurant_id") == restaurant_id)
    return menu_items.where(cond)


def uncategorised(c: Column | str = "category_id") -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return c.isNull() | (c == 0)


def menu_uncategorised(menu_items: DataFrame) -> DataFrame:
    """category_id IS NULL OR = 0."""
    return menu_items.where(uncategorised())


def produce_search(produce_items: DataFrame, q: str = "", category: str = "all") -> DataFrame:
    """Case-insensitive substring on the name plus optional category."""
    cond = F.lower(F.col("name")).contains(q.lower())
    if category != "all":
        cond = cond & (F.col("category") == category)
    return produce_items.where(cond)


def users_search(users: DataFrame, q: str = "", role: str = "all") -> DataFrame:
    """Role filter and name-or-email substring, case-insensitive."""
    ql = q.lower()
    cond = F.lower(F.coalesce("name", F.lit(""))).contains(ql) | F.lower(F.coalesce("email", F.lit(""))).contains(ql)
    if role != "all":
        cond = cond & (F.col("role") == role)
    return users.where(cond)


def orders_by_status(orders: DataFrame, status: str = "all") -> DataFrame:
    """Status equality, or every order."""
    return orders if status == "all" else orders.where(F.col("status") == status)


def approvals_by_status(df: DataFrame, status: str = "all") -> DataFrame:
    """Riders or restaurants in an approval status."""
    return df if status == "all" else df.where(F.col("status") == status)


def pending_count(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.when(F.col("status") == "pending", 1)).alias("pending"))


def orders_active_past(orders: DataFrame) -> DataFrame:
    """Split flag: status among the four active values."""
    return orders.withColumn("is_active", F.col("status").isin(*ACTIVE_ORDER_STATUSES))


def produce_listing(produce_items: DataFrame, category: str | None = None) -> DataFrame:
    """Optional category; sort: available first, then category, name."""
    df = produce_items if category is None else produce_items.where(F.col("category") == category)
    return df.orderBy(F.desc("is_available"), "category", "name")


def stock_level(avail: Column | str = "is_available", stock: Column | str = "stock_kg") -> Column:
    """out: unavailable or stock <= 0; low: <= 15 kg; else high."""
    s = F.col(stock) if isinstance(stock, str) else stock
    return (F.when(~truthy(avail) | (s <= 0), "out")
            .when(s <= LOW_STOCK_KG, "low").otherwise("high"))


def stock_pct(stock: Column | str = "stock_kg") -> Column:
    """min(100, Math.round(stock / 100 * 100))."""
    s = F.col(stock) if isinstance(stock, str) else stock
    pct = F.floor(s.cast("decimal(18,2)") / F.lit(FULL_STOCK_KG).cast("decimal(18,2)") * 100 + F.lit(0.5))
    return F.least(F.lit(100).cast("bigint"), pct.cast("bigint"))


def produce_stock_level(produce_items: DataFrame) -> DataFrame:
    """Stock level and bar percentage per produce item."""
    return produce_items.select("id", "name", "stock_kg", "is_available",
                                stock_level().alias("level"), stock_pct().alias("pct"))


def produce_low_or_out(produce_items: DataFrame) -> DataFrame:
    """Items whose level is low or out."""
    return produce_stock_level(produce_items).where(F.col("level").isin("low", "out"))


MAX_PICK_KG = 20.0  # fixed value: largest selectable quantity
MIN_PICK_KG = 0.5   # fixed value: smallest selectable quantity


def produce_purchase_cap(produce_items: DataFrame) -> DataFrame:
    """Largest selectable kg = min(20, stock if stock > 0 else 20); min 0.5."""
    stock = F.col("stock_kg")
    cap = F.least(F.lit(MAX_PICK_KG), F.when(stock > 0, stock).otherwise(F.lit(MAX_PICK_KG)))
    return produce_items.select("id", "name", "stock_kg", cap.alias("max_kg"), F.lit(MIN_PICK_KG).alias("min_kg"))


def audit_by_user(audit_log: DataFrame, k: int = 50) -> DataFrame:
    """Each user's newest ``k`` audit rows (B16): a per-user top-k.

    ``row_number() <= k`` lets Spark insert a partial WindowGroupLimit before
    the shuffle, so a user holding a large share of the log ships at most
    ``k`` rows per map task.
    """
    from .windows import top_n_per_key
    return top_n_per_key(audit_log.where(F.col("user_id").isNotNull()), ["user_id"],
                         [F.desc("timestamp"), F.desc("id")], k)


def available_food(orders: DataFrame) -> DataFrame:
    """Confirmed food orders without a rider."""
    return orders.where((F.col("status") == "Confirmed") & F.col("rider_id").isNull())


def available_produce(produce_orders: DataFrame) -> DataFrame:
    """Confirmed produce orders without a rider; rider 0 also counts."""
    return produce_orders.where((F.col("status") == "Confirmed")
                                & (F.col("rider_id").isNull() | (F.col("rider_id") == 0)))
