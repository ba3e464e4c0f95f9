"""Grouped and global aggregates (dashboard numbers, per-entity stats).

Every "WHERE key = ?" aggregate of the app is re-aimed as one grouped pass
over the whole table; a caller filters the result and Catalyst pushes the
filter down.  Conditional counts/sums share one pass (no per-status scans).
Hash aggregation runs partial (map-side) then final, so a hot key -- one
restaurant or customer holding a third of the rows -- is combined before
the shuffle and never lands whole in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.money import MONEY, js_round, money, rate, sum_money, to_double


def count_if(cond: Column) -> Column:
    return F.count(F.when(cond, F.lit(1)))


def manager_stats(restaurants: DataFrame, food_orders: DataFrame) -> DataFrame:
    """Per restaurant: orders, delivered revenue, 5 % platform cut, net.

    Restaurants without orders appear with zeros (left join from the
    restaurant table).
    """
    per = food_orders.groupBy("restaurant_id").agg(
        F.count(F.lit(1)).alias("total_orders"),
        F.sum(F.when(F.col("status") == "Delivered", money("total_amount"))).alias("rev"),
    )
    return manager_report(restaurants, per)


def manager_report(restaurants: DataFrame, per: DataFrame) -> DataFrame:
    """G3 from ``per`` (restaurant_id, total_orders, rev): every restaurant, with fee and net."""
    rev = F.coalesce(F.col("rev"), F.lit(0).cast(MONEY))
    fee = rev * rate(0.05)
    return (
        restaurants.select(F.col("id").alias("restaurant_id"))
        .join(per, "restaurant_id", "left")
        .select(
            "restaurant_id",
            F.coalesce("total_orders", F.lit(0)).alias("total_orders"),
            to_double(rev).alias("revenue"),
            to_double(fee).alias("platform_fee"),
            to_double(rev - fee).alias("net_revenue"),
        )
    )


def admin_counts(food_orders: DataFrame, users: DataFrame, riders: DataFrame,
                 restaurants: DataFrame) -> DataFrame:
    """The six dashboard counters (G1) as one row.

    Each table is reduced to one partial row; the rows are unioned and summed,
    so there is no join between the one-row results.
    """
    zero = F.lit(0).cast("bigint")
    cols = ["total_orders", "total_users", "total_riders", "pending_riders",
            "total_restaurants", "pending_restaurants"]

    def part(df: DataFrame, **aggs: Column) -> DataFrame:
        return df.agg(*[(aggs[c] if c in aggs else zero).alias(c) for c in cols])

    parts = [
        part(food_orders, total_orders=F.count(F.lit(1))),
        part(users, total_users=count_if(F.col("role") == "customer")),
        part(riders, total_riders=F.count(F.lit(1)), pending_riders=count_if(F.col("status") == "pending")),
        part(restaurants,
             total_restaurants=count_if((F.col("is_open") == 1) & (F.col("status") == "approved")),
             pending_restaurants=count_if(F.col("status") == "pending")),
    ]
    u = parts[0]
    for p in parts[1:]:
        u = u.unionByName(p)
    return u.agg(*[F.sum(c).cast("bigint").alias(c) for c in cols])


def admin_revenue(food_orders: DataFrame) -> DataFrame:
    """Delivered revenue, delivered platform fee, all platform fee; 0 on empty."""
    delivered = F.col("status") == "Delivered"
    return food_orders.agg(
        to_double(F.coalesce(F.sum(F.when(delivered, money("total_amount"))), F.lit(0).cast(MONEY))).alias("revenue"),
        to_double(F.coalesce(F.sum(F.when(delivered, money("platform_fee"))), F.lit(0).cast(MONEY)))
        .alias("platform_revenue"),
        to_double(sum_money("platform_fee")).alias("total_platform_cut"),
    )


def restaurant_rating(restaurants: DataFrame, reviews: DataFrame) -> DataFrame:
    """Rating written back by the review route: avg rating to 1 dp.

    Restaurants without reviews keep their stored rating.  Rounding is
    half-up on the exact ratio: ``floor((20*sum + n) / (2*n)) / 10``.
    """
    per = reviews.groupBy("restaurant_id").agg(
        F.sum("rating").cast("bigint").alias("s"), F.count(F.lit(1)).alias("n"))
    return rating_report(restaurants, per)


def rating_report(restaurants: DataFrame, per: DataFrame) -> DataFrame:
    """G4 from ``per`` (restaurant_id, s, n)."""
    avg1 = (F.floor((F.col("s") * 20 + F.col("n")) / (F.col("n") * 2)) / 10).cast("double")
    return (
        restaurants.select("id", "name", "rating")
        .join(per, restaurants["id"] == per["restaurant_id"], "left")
        .select("id", "name", F.coalesce(avg1, F.col("rating")).alias("rating"),
                F.coalesce(F.col("n"), F.lit(0)).alias("review_count"))
    )


def orders_top_restaurants(orders: DataFrame, k: int = 10) -> DataFrame:
    """Orders counted by the first 15 characters of the restaurant name.

    Names sharing the prefix merge, as on the dashboard; ties on the count
    break by name.  ``k`` rows (top-k is the feature).
    """
    name = F.substring(F.coalesce(F.nullif(F.col("restaurant_name"), F.lit("")), F.lit("Unknown")), 1, 15)
    return (orders.groupBy(name.alias("restaurant_label"))
            .agg(F.count(F.lit(1)).alias("orders"))
            .orderBy(F.desc("orders"), F.asc("restaurant_label")).limit(k))


def revenue_breakdown(orders: DataFrame) -> DataFrame:
    """Doughnut split of a list of orders (G7): sums with NULL = 0, the
    restaurant share ``max(0, gmv - delivery - platform - tip)``, each
    rounded like ``Math.round``."""
    return revenue_split(orders.select(*[money(c).alias(c) for c in SPLIT]))


SPLIT = ["total_amount", "delivery_fee", "platform_fee", "rider_tip"]


def revenue_split(sums: DataFrame) -> DataFrame:
    """G7 from rows of decimal amounts or partial sums of them."""
    gmv, delivery, platform, rider = (F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in SPLIT)
    agg = sums.agg(gmv, delivery, platform, rider)
    rest = F.greatest(F.lit(0), F.col("total_amount") - F.col("delivery_fee") - F.col("platform_fee") - F.col("rider_tip"))
    return agg.select(
        to_double(F.col("total_amount")).alias("total_gmv"),
        js_round(rest).cast("bigint").alias("restaurant_revenue"),
        js_round(F.col("platform_fee")).cast("bigint").alias("platform_fee"),
        js_round(F.col("delivery_fee")).cast("bigint").alias("delivery_fee"),
        js_round(F.col("rider_tip")).cast("bigint").alias("rider_tip"),
    )


def customer_profile_stats(history: DataFrame) -> DataFrame:
    """Per customer over food + produce history: orders, delivered, spend."""
    delivered = F.col("status") == "Delivered"
    spent = F.coalesce(F.sum(F.when(delivered, money("total_amount"))), F.lit(0).cast(MONEY))
    return history.groupBy("customer_id").agg(
        F.count(F.lit(1)).alias("total_orders"),
        count_if(delivered).alias("delivered"),
        to_double(spent).alias("spent"),
        js_round(spent / 1000).cast("bigint").alias("spent_k"),
    )


def rider_profile_stats(rider_orders: DataFrame) -> DataFrame:
    """Per rider: orders, delivered, estimated earnings = 10 % of delivered totals."""
    delivered = F.col("status") == "Delivered"
    earn = F.coalesce(F.sum(F.when(delivered, money("total_amount"))), F.lit(0).cast(MONEY)) * rate(0.10)
    return rider_orders.groupBy("rider_id").agg(
        F.count(F.lit(1)).alias("total_orders"),
        count_if(delivered).alias("delivered"),
        js_round(earn).cast("bigint").alias("earnings_est"),
    )


def rider_dashboard_stats(rider_orders: DataFrame) -> DataFrame:
    """Per rider: deliveries, completed, active."""
    return rider_orders.groupBy("rider_id").agg(
        F.count(F.lit(1)).alias("deliveries"),
        count_if(F.col("status") == "Delivered").alias("completed"),
        count_if(F.col("status") == "Out for Delivery").alias("active"),
    )


def promo_summary(promo_codes: DataFrame) -> DataFrame:
    """Codes, active codes, total uses."""
    return promo_codes.agg(
        F.count(F.lit(1)).alias("codes"),
        count_if(F.coalesce(F.col("is_active"), F.lit(0)) != 0).alias("active_codes"),
        F.coalesce(F.sum("used_count"), F.lit(0)).cast("bigint").alias("total_uses"),
    )


LOW_STOCK_KG = 15.0   # fixed value: "low" threshold of the produce admin
FULL_STOCK_KG = 100.0  # fixed value: stock shown as a full bar


def produce_stock_summary(produce_items: DataFrame) -> DataFrame:
    """Total / in stock / low / out."""
    avail = F.coalesce(F.col("is_available"), F.lit(0)) != 0
    stock = F.col("stock_kg")
    return produce_items.agg(
        F.count(F.lit(1)).alias("total"),
        count_if(avail & (stock > LOW_STOCK_KG)).alias("in_stock"),
        count_if(avail & (stock > 0) & (stock <= LOW_STOCK_KG)).alias("low"),
        count_if(~avail | (stock <= 0)).alias("out"),
    )


def cart_totals(lines: DataFrame, cart_cols=("request_id",), discounts: DataFrame | None = None) -> DataFrame:
    """Per cart: subtotal = sum(price * qty), fee 50, platform = Math.round(5 %),
    total = max(0, sub + fee + platform - promo - loyalty) (G13).

    ``lines`` has the cart key(s), ``unit_price`` and ``quantity``;
    ``discounts`` (optional) has the cart key(s), ``promo_discount`` and
    ``loyalty_discount``.
    """
    keys = list(cart_cols)
    sub = lines.groupBy(*keys).agg(F.sum(money("unit_price") * F.col("quantity")).alias("sub"))
    if discounts is not None:
        sub = sub.join(discounts.select(*keys, "promo_discount", "loyalty_discount"), keys, "left")
    else:
        sub = sub.withColumn("promo_discount", F.lit(None).cast("double")) \
                 .withColumn("loyalty_discount", F.lit(None).cast("double"))
    platform = js_round(F.col("sub") * rate(0.05))
    total = F.greatest(F.lit(0).cast(MONEY),
                       F.col("sub") + 50 + platform
                       - F.coalesce(money("promo_discount"), F.lit(0).cast(MONEY))
                       - F.coalesce(money("loyalty_discount"), F.lit(0).cast(MONEY)))
    return sub.select(*keys, to_double(F.col("sub")).alias("subtotal"), F.lit(50.0).alias("delivery_fee"),
                      to_double(platform).alias("platform_fee"), to_double(total).alias("total"))


def line_totals(order_items: DataFrame) -> DataFrame:
    """unit_price x quantity per line."""
    return order_items.withColumn("line_total", to_double(money("unit_price") * F.col("quantity")))


def category_item_counts(categories: DataFrame, menu_items: DataFrame) -> DataFrame:
    """Items per category, empty categories included."""
    per = menu_items.where(F.col("category_id").isNotNull()).groupBy("category_id") \
        .agg(F.count(F.lit(1)).alias("items"))
    return (categories.join(per, categories["id"] == per["category_id"], "left")
            .select(categories["id"].alias("category_id"), "restaurant_id", "name",
                    F.coalesce("items", F.lit(0)).alias("item_count")))


def distinct_cuisines(restaurants: DataFrame) -> DataFrame:
    """Distinct non-empty cuisines, sorted."""
    return (restaurants.where(F.col("cuisine").isNotNull() & (F.col("cuisine") != ""))
            .select("cuisine").distinct().orderBy("cuisine"))


def first_admin_id(users: DataFrame) -> Column:
    """The support account as a scalar subquery: smallest admin id."""
    return users.where(F.col("role") == "admin").agg(F.min("id")).scalar()


def unread_per_contact(messages: DataFrame, admin_id: Column) -> DataFrame:
    """Unread messages to the admin, per sender."""
    return (messages.where((F.col("receiver_id") == admin_id) & (F.col("is_read") == 0))
            .groupBy(F.col("sender_id").alias("contact_id")).agg(F.count(F.lit(1)).alias("unread")))


def conversation_list(messages: DataFrame, users: DataFrame, admin_id: Column) -> DataFrame:
    """Admin inbox (G17): every non-admin user who wrote to or got a message
    from the admin, with the newest message in either direction and the unread
    count -- one grouped pass instead of two correlated subqueries per user."""
    mine = messages.where((F.col("sender_id") == admin_id) | (F.col("receiver_id") == admin_id))
    other = F.when(F.col("sender_id") == admin_id, F.col("receiver_id")).otherwise(F.col("sender_id"))
    per = mine.groupBy(other.alias("contact_id")).agg(
        F.max_by("message", F.struct("created_at", "id")).alias("last_message"),
        count_if((F.col("receiver_id") == admin_id) & (F.col("is_read") == 0)
                 & (F.col("sender_id") != admin_id)).alias("unread"),
    )
    people = users.where(F.col("role") != "admin").select("id", "name", "role")
    return people.join(per, people["id"] == per["contact_id"]).select(
        "id", "name", "role", "last_message", "unread")
