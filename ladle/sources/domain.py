"""Driver tables -> the sixteen tables of the ordering app.

The app's data model (users, riders, restaurants, menus, food and produce
orders, messages, reviews, audit log, promo codes, loyalty ledger) is derived
from the TPC-H-like driver tables so every report grows with the input.

Scale notes
-----------
* Everything is a lazy plan; nothing is cached or collected here.
* ``menu_items``/``categories`` de-duplicate ``(l_suppkey, l_partkey)`` on the
  narrow lineitem projection *before* joining ``part`` (partial aggregation
  map-side, then one shuffle on the pair).
* The part-type numbering is a window over the distinct ``p_type`` values --
  a vocabulary (150 values in TPC-H), not a data-sized set.
* Food orders are one ``(l_orderkey, l_suppkey)`` pair: lines are aggregated
  per pair first, then joined to ``orders`` on ``l_orderkey``.

Id spaces (fixed values of the mapping; the oracle SQL uses the same):
users: customers keep ``c_custkey``; managers ``1000000 + s_suppkey``;
riders ``2000000 + rider id``; the support admin is ``-1``.
Food order id ``l_orderkey * 100000 + l_suppkey``; menu item id
``l_suppkey * 10000000 + l_partkey``; category id ``l_suppkey * 1000 + type``.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.ints import idiv
from .tables import read_table

# Fixed values of the mapping.
MANAGER_ID_OFFSET = 1_000_000
RIDER_USER_OFFSET = 2_000_000
ADMIN_ID = -1
FOOD_ORDER_MULT = 100_000
MENU_ITEM_MULT = 10_000_000
CATEGORY_MULT = 1_000
CUSTOMERS_PER_RIDER = 20
PROMO_EVERY = 7          # orders with o_orderkey % 7 == 3 carry a promo code
DELIVERY_FEE = 50.0
ACTIVE_RIDER_STATUSES = ("Out for Delivery", "Delivered")


def dec2(c: Column) -> Column:
    return c.cast("decimal(18,2)")


def ts_plus_days(base: str, days: Column) -> Column:
    """``base`` date + days, as timestamp_ntz (time-zone independent)."""
    return F.date_add(F.lit(base).cast("date"), days.cast("int")).cast("timestamp_ntz")


class Domain:
    """Lazily derived domain tables for one scale-factor directory."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir

    def raw(self, name: str) -> DataFrame:
        return read_table(self.spark, self.sf_dir, name)

    # ------------------------------------------------------------------ people
    @cached_property
    def riders(self) -> DataFrame:
        rid = idiv("c_custkey", CUSTOMERS_PER_RIDER) + 1
        return (
            self.raw("customer")
            .where(F.col("c_custkey") % CUSTOMERS_PER_RIDER == 0)
            .select(rid.alias("id"))
            .select(
                "id",
                (F.col("id") + RIDER_USER_OFFSET).alias("user_id"),
                F.when(F.col("id") % 3 == 0, "Car").otherwise("Bike").alias("vehicle_type"),
                F.concat(F.lit("LEA-"), F.col("id").cast("string")).alias("license_plate"),
                F.when(F.col("id") % 4 == 0, "pending").when(F.col("id") % 4 == 1, "rejected")
                .otherwise("approved").alias("status"),
                F.when(F.col("id") % 5 == 0, 0).otherwise(1).cast("int").alias("is_available"),
                F.lit(0.0).alias("total_earnings"),
            )
        )

    @cached_property
    def users(self) -> DataFrame:
        def phone(idc: Column) -> Column:
            return F.concat(F.lit("0300-"), F.lpad((F.abs(idc) % 10_000_000).cast("string"), 7, "0"))

        cust = self.raw("customer").select(
            F.col("c_custkey").alias("id"), F.col("c_name").alias("name"),
            F.concat(F.lit("c"), F.col("c_custkey").cast("string"), F.lit("@example.com")).alias("email"),
            F.lit("customer").alias("role"),
            ts_plus_days("2020-01-01", F.col("c_custkey") % 1461).alias("created_at"))
        mgr = self.raw("supplier").select(
            (F.col("s_suppkey") + MANAGER_ID_OFFSET).alias("id"), F.col("s_name").alias("name"),
            F.concat(F.lit("m"), F.col("s_suppkey").cast("string"), F.lit("@example.com")).alias("email"),
            F.lit("manager").alias("role"),
            ts_plus_days("2019-06-01", F.col("s_suppkey") % 365).alias("created_at"))
        rid = self.riders.select(
            F.col("user_id").alias("id"),
            F.concat(F.lit("Rider "), F.col("id").cast("string")).alias("name"),
            F.concat(F.lit("r"), F.col("id").cast("string"), F.lit("@example.com")).alias("email"),
            F.lit("rider").alias("role"),
            ts_plus_days("2021-01-01", F.col("id") % 365).alias("created_at"))
        admin = self.raw("region").where(F.col("r_regionkey") == 0).select(
            F.lit(ADMIN_ID).cast("bigint").alias("id"), F.lit("Support").alias("name"),
            F.lit("support@example.com").alias("email"), F.lit("admin").alias("role"),
            F.lit("2019-01-01").cast("date").cast("timestamp_ntz").alias("created_at"))
        out = cust.unionByName(mgr).unionByName(rid).unionByName(admin)
        return out.select("id", "name", "email", phone(F.col("id")).alias("phone"), "role", "created_at")

    # ------------------------------------------------------------ restaurants
    @cached_property
    def restaurants(self) -> DataFrame:
        s = F.col("s_suppkey")
        geo = F.broadcast(
            self.raw("nation").join(F.broadcast(self.raw("region")),
                                    F.col("n_regionkey") == F.col("r_regionkey"))
            .select("n_nationkey", "n_name", "r_name"))
        return (
            self.raw("supplier").join(geo, F.col("s_nationkey") == F.col("n_nationkey"))
            .select(
                s.alias("id"), F.col("s_name").alias("name"), F.col("n_name").alias("cuisine"),
                F.col("r_name").alias("location"),
                F.concat(F.lit("042-"), F.lpad((s % 10_000_000).cast("string"), 7, "0")).alias("phone"),
                F.when(s % 6 == 0, F.lit(None).cast("string")).when(s % 6 == 1, F.lit(""))
                .otherwise(F.concat(F.lit("r"), s.cast("string"), F.lit(".jpg"))).alias("image_filename"),
                F.lit(4.0).alias("rating"),
                (F.lit(20) + s % 31).cast("int").alias("delivery_time"),
                F.when(s % 10 == 0, 0).otherwise(1).cast("int").alias("is_open"),
                F.when(s % 7 == 0, "pending").when(s % 7 == 1, "rejected").otherwise("approved").alias("status"),
                F.when(s % 5 == 0, F.lit(None).cast("bigint")).otherwise(s + MANAGER_ID_OFFSET).alias("manager_id"),
                F.lit(0.0).alias("min_order"),
                ts_plus_days("2021-01-01", s % 1000).alias("created_at"),
            )
        )

    @cached_property
    def _part_types(self) -> DataFrame:
        # Numbering distinct type names needs one ordered window; the input
        # is the type vocabulary (distinct values after a partial aggregate),
        # not the part table.  Its join is left to AQE, which broadcasts it
        # only when the runtime size is under the threshold.
        return (self.raw("part").select("p_type").distinct()
                .select(F.col("p_type").alias("pt"),
                        F.row_number().over(Window.orderBy("p_type")).cast("int").alias("tid")))

    @cached_property
    def _supplied_parts(self) -> DataFrame:
        """Distinct (supplier, part) pairs with part attributes and type number."""
        pairs = self.raw("lineitem").select("l_suppkey", "l_partkey").distinct()
        part = self.raw("part").select("p_partkey", "p_name", "p_type", "p_size", "p_retailprice", "p_brand")
        return (pairs.join(part, F.col("l_partkey") == F.col("p_partkey"))
                .join(self._part_types, F.col("pt") == F.col("p_type")))

    @cached_property
    def categories(self) -> DataFrame:
        return (self._supplied_parts
                .select((F.col("l_suppkey") * CATEGORY_MULT + F.col("tid")).alias("id"),
                        F.col("l_suppkey").alias("restaurant_id"), F.col("p_type").alias("name"))
                .distinct())

    @cached_property
    def menu_items(self) -> DataFrame:
        size = F.col("p_size")
        return self._supplied_parts.select(
            (F.col("l_suppkey") * MENU_ITEM_MULT + F.col("l_partkey")).alias("id"),
            F.when(size % 10 == 0, F.lit(None).cast("bigint")).when(size % 10 == 1, F.lit(0).cast("bigint"))
            .otherwise(F.col("l_suppkey") * CATEGORY_MULT + F.col("tid")).alias("category_id"),
            F.col("l_suppkey").alias("restaurant_id"),
            F.col("p_name").alias("name"),
            F.col("p_brand").alias("description"),
            F.col("p_retailprice").alias("price"),
            F.when(F.col("l_partkey") % 5 == 0, F.lit(None).cast("string"))
            .otherwise(F.concat(F.lit("m"), F.col("l_partkey").cast("string"), F.lit(".jpg"))).alias("image_filename"),
            F.when(size % 8 == 0, 0).otherwise(1).cast("int").alias("is_available"),
        )

    # ----------------------------------------------------------------- orders
    @cached_property
    def all_orders(self) -> DataFrame:
        ok = F.col("o_orderkey")
        st = F.col("o_orderstatus")
        status = (F.when(ok % 11 == 0, "Cancelled").when(st == "F", "Delivered")
                  .when((st == "P") & (ok % 2 == 0), "Out for Delivery").when(st == "P", "Preparing")
                  .when(ok % 2 == 0, "Confirmed").otherwise("Pending"))
        promo_id = F.when(ok % PROMO_EVERY == 3, F.col("o_custkey") % 25 + 1)
        return self.raw("orders").select(
            ok.alias("ok"),
            F.when(ok % 4 == 0, "produce").otherwise("food").alias("order_type"),
            F.col("o_custkey").alias("customer_id"),
            status.alias("status"),
            F.col("o_orderdate").alias("created_at"),
            promo_id.alias("promo_id"),
            F.when(ok % 3 == 0, "Cash on Delivery").when(ok % 3 == 1, "Card").otherwise("Wallet")
            .alias("payment_method"),
        )

    @cached_property
    def order_items(self) -> DataFrame:
        li = self.raw("lineitem").where(F.col("l_orderkey") % 4 != 0)
        part = self.raw("part").select("p_partkey", "p_retailprice")
        return li.join(part, F.col("l_partkey") == F.col("p_partkey")).select(
            (F.col("l_orderkey") * FOOD_ORDER_MULT + F.col("l_suppkey")).alias("order_id"),
            (F.col("l_suppkey") * MENU_ITEM_MULT + F.col("l_partkey")).alias("item_id"),
            F.col("l_quantity").cast("int").alias("quantity"),
            F.col("p_retailprice").alias("unit_price"),
        )

    @cached_property
    def food_orders(self) -> DataFrame:
        sub = (self.order_items.groupBy("order_id")
               .agg(F.sum(dec2(F.col("unit_price")) * F.col("quantity")).alias("sub")))
        a = self.all_orders
        rate5 = F.lit(0.05).cast("decimal(4,2)")
        rate10 = F.lit(0.10).cast("decimal(4,2)")
        platform = F.round(F.col("sub") * rate5, 2)
        oid = F.col("order_id")
        return sub.join(a, idiv("order_id", FOOD_ORDER_MULT) == F.col("ok")).select(
            oid.alias("id"),
            "customer_id",
            (oid % FOOD_ORDER_MULT).alias("restaurant_id"),
            F.when(F.col("status").isin(*ACTIVE_RIDER_STATUSES),
                   idiv("customer_id", CUSTOMERS_PER_RIDER) + 1).alias("rider_id"),
            "status",
            F.lit(DELIVERY_FEE).alias("delivery_fee"),
            platform.cast("double").alias("platform_fee"),
            F.round(F.col("sub") * rate10, 2).cast("double").alias("rider_tip"),
            (F.col("sub") + 50 + platform).cast("double").alias("total_amount"),
            "payment_method",
            F.lit(35).alias("estimated_time"),
            "created_at",
            F.col("created_at").alias("updated_at"),
        )

    @cached_property
    def produce_items(self) -> DataFrame:
        size = F.col("p_size")
        return self.raw("part").select(
            F.col("p_partkey").alias("id"), F.col("p_name").alias("name"),
            F.when(size % 2 == 0, "fruit").otherwise("vegetable").alias("category"),
            F.col("p_retailprice").alias("price_per_kg"),
            F.when(F.col("p_partkey") % 4 == 0, F.lit(None).cast("string"))
            .otherwise(F.concat(F.lit("p"), F.col("p_partkey").cast("string"), F.lit(".jpg"))).alias("image_filename"),
            F.when(size % 8 == 0, 0).otherwise(1).cast("int").alias("is_available"),
            ((size - 1).cast("double") * 2).alias("stock_kg"),
        )

    @cached_property
    def produce_order_items(self) -> DataFrame:
        li = self.raw("lineitem").where(F.col("l_orderkey") % 4 == 0)
        part = self.raw("part").select("p_partkey", "p_retailprice")
        return li.join(part, F.col("l_partkey") == F.col("p_partkey")).select(
            F.col("l_orderkey").alias("order_id"),
            F.col("l_partkey").alias("produce_id"),
            (F.col("l_quantity") / 10).alias("quantity_kg"),
            F.col("p_retailprice").alias("unit_price"),
        )

    @cached_property
    def produce_orders(self) -> DataFrame:
        line = (dec2(F.col("quantity_kg").cast("decimal(18,1)")) * dec2(F.col("unit_price"))).cast("decimal(18,2)")
        sub = self.produce_order_items.groupBy("order_id").agg(F.sum(line).alias("sub"))
        ok = F.col("ok")
        return sub.join(self.all_orders, ok == F.col("order_id")).select(
            ok.alias("id"), "customer_id",
            F.when(F.col("status").isin(*ACTIVE_RIDER_STATUSES),
                   idiv("customer_id", CUSTOMERS_PER_RIDER) + 1)
            .when(ok % 8 == 0, F.lit(0).cast("bigint")).alias("rider_id"),
            F.when(F.col("status") == "Preparing", "Confirmed").otherwise(F.col("status")).alias("status"),
            F.lit(DELIVERY_FEE).alias("delivery_fee"),
            (F.col("sub") + 50).cast("double").alias("total_amount"),
            "payment_method",
            "created_at",
            F.col("created_at").alias("updated_at"),
        )

    # ----------------------------------------------------- messages & events
    @cached_property
    def messages(self) -> DataFrame:
        user = F.col("role") == "user"
        base = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")
        created = F.timestamp_add("MINUTE", F.col("conv_id") * 60 + F.col("turn"), base)
        return self.raw("conversations").select(
            (F.col("conv_id") * 100 + F.col("turn")).alias("id"),
            F.when(user, F.col("conv_id")).otherwise(F.lit(ADMIN_ID)).cast("bigint").alias("sender_id"),
            F.when(user, F.lit(ADMIN_ID)).otherwise(F.col("conv_id")).cast("bigint").alias("receiver_id"),
            F.col("text").alias("message"),
            (F.col("turn") % 2).cast("int").alias("is_read"),
            created.alias("created_at"),
        )

    @cached_property
    def reviews(self) -> DataFrame:
        nsupp = self.raw("supplier").select(F.count(F.lit(1))).scalar()
        return self.raw("events").where(F.col("event_type") == "view").select(
            F.col("event_id").alias("id"), F.col("user_id").alias("customer_id"),
            (F.col("event_id") % nsupp).alias("restaurant_id"),
            (F.lit(1) + F.col("event_id") % 5).cast("int").alias("rating"),
            F.col("props").alias("comment"), F.col("ts").alias("created_at"))

    @cached_property
    def audit_log(self) -> DataFrame:
        return self.raw("events").select(
            F.col("event_id").alias("id"),
            F.when(F.col("event_type") == "error", F.lit(None).cast("bigint")).otherwise(F.col("user_id"))
            .alias("user_id"),
            F.upper("event_type").alias("action"), F.col("props").alias("details"),
            F.col("ts").alias("timestamp"))

    @cached_property
    def loyalty_transactions(self) -> DataFrame:
        purchase = F.col("event_type") == "purchase"
        return self.raw("events").where(F.col("event_type").isin("purchase", "click")).select(
            F.col("event_id").alias("id"), F.col("user_id").alias("customer_id"),
            F.when(purchase, F.col("value").cast("bigint")).otherwise(-(F.col("value") / 4).cast("bigint"))
            .alias("points"),
            F.when(purchase, "earn").otherwise("redeem").alias("type"),
            F.when(purchase, "Earned from order").otherwise("Redeemed at checkout").alias("description"),
            F.col("ts").alias("created_at"))

    @cached_property
    def loyalty_points(self) -> DataFrame:
        return self.loyalty_transactions.groupBy("customer_id").agg(
            F.sum("points").alias("total_points"),
            F.sum(F.when(F.col("points") > 0, F.col("points")).otherwise(0)).alias("lifetime_points"),
        ).select(F.col("customer_id").alias("id"), "customer_id", "total_points", "lifetime_points")

    # ------------------------------------------------------------------ promo
    @cached_property
    def promo_codes(self) -> DataFrame:
        """One code per nation; uses = historic orders that carried the code."""
        n = F.col("n_nationkey")
        kind = (F.when(n % 4 == 0, "percent").when(n % 4 == 1, "fixed")
                .when(n % 4 == 2, "percentage").otherwise("percent"))
        codes = self.raw("nation").select(
            (n + 1).cast("bigint").alias("id"),
            F.concat(F.upper(F.regexp_replace("n_name", " ", "")), (F.lit(5) + n % 4 * 5).cast("string"))
            .alias("code"),
            kind.alias("discount_type"),
            F.when(kind == "percent", (F.lit(5) + n % 4 * 5).cast("double"))
            .otherwise((F.lit(25) + n % 3 * 25).cast("double")).alias("discount_value"),
            (n % 3 * 100).cast("double").alias("min_order"),
            F.when(n % 3 == 0, 40).when(n % 3 == 1, 400).otherwise(1_000_000).cast("int").alias("max_uses"),
            F.when(n % 6 == 5, 0).otherwise(1).cast("int").alias("is_active"),
            ts_plus_days("2024-01-01", n).alias("created_at"),
        )
        uses = (self.all_orders.where(F.col("promo_id").isNotNull())
                .groupBy("promo_id").agg(F.count(F.lit(1)).cast("int").alias("used_count")))
        return (codes.join(uses, F.col("id") == F.col("promo_id"), "left")
                .select("id", "code", "discount_type", "discount_value", "min_order", "max_uses",
                        F.coalesce("used_count", F.lit(0)).alias("used_count"), "is_active", "created_at"))


TABLE_NAMES = (
    "users", "riders", "restaurants", "categories", "menu_items", "food_orders", "order_items",
    "messages", "reviews", "audit_log", "produce_items", "produce_orders", "produce_order_items",
    "promo_codes", "loyalty_points", "loyalty_transactions",
)
