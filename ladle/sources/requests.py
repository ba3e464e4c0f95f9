"""Order requests: the settlement's input.

``REQUEST_SCHEMA`` is what a staged JSON request decodes to (A3).  For the
registered queries the requests are derived from the order history in the
driver tables (every historic order replayed as a placement request), so the
settlement's work grows with the data.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.ints import idiv
from ..functions.money import money, to_double

ITEM = T.StructType([
    T.StructField("item_id", T.LongType()),
    T.StructField("quantity", T.DoubleType()),
    T.StructField("unit_price", T.DoubleType()),
])

REQUEST_SCHEMA = T.StructType([
    T.StructField("request_id", T.LongType()),
    T.StructField("requested_at", T.TimestampNTZType()),
    T.StructField("order_type", T.StringType()),
    T.StructField("customer_id", T.LongType()),
    T.StructField("restaurant_id", T.LongType()),
    T.StructField("subtotal", T.DoubleType()),
    T.StructField("delivery_fee", T.DoubleType()),
    T.StructField("promo_code", T.StringType()),
    T.StructField("promo_discount", T.DoubleType()),
    T.StructField("loyalty_discount", T.DoubleType()),
    T.StructField("payment_method", T.StringType()),
    T.StructField("delivery_address", T.StringType()),
    T.StructField("special_instructions", T.StringType()),
    T.StructField("estimated_time", T.IntegerType()),
    T.StructField("items", T.ArrayType(ITEM)),
])

# The names that a produce body uses for its own fields.
WIRE_ITEM = T.StructType([*ITEM.fields, T.StructField("produce_id", T.LongType()),
                          T.StructField("quantity_kg", T.DoubleType())])
WIRE_SCHEMA = T.StructType([*[f if f.name != "items" else T.StructField("items", T.ArrayType(WIRE_ITEM))
                              for f in REQUEST_SCHEMA.fields], T.StructField("total_amount", T.DoubleType())])

# Defaults the app fills in for absent request fields.
DEFAULTS = {"delivery_fee": 50.0, "payment_method": "Cash on Delivery", "estimated_time": 35,
            "promo_discount": 0.0, "loyalty_discount": 0.0, "delivery_address": "", "special_instructions": ""}
LOYALTY_EVERY = 9      # derived requests: every 9th redeems loyalty points
LOYALTY_REDEEM = 5.0   # derived requests: PKR redeemed


def ingest_json(lines: DataFrame, col: str = "value") -> DataFrame:
    """Decode JSON-lines requests with the explicit schema and apply the
    defaults of absent fields (A3).  No schema inference pass.

    A produce body names its amount ``total_amount`` and its lines
    ``produce_id`` / ``quantity_kg``; both kinds decode to the columns of
    ``REQUEST_SCHEMA``.  Without ``order_type``, a body with an amount or a
    line of that kind is produce, any other food."""
    return _with_defaults(lines.select(F.from_json(F.col(col), WIRE_SCHEMA).alias("r")).select("r.*"), REQUEST_SCHEMA.names)


def _with_defaults(r: DataFrame, keep: list[str]) -> DataFrame:
    produce = F.col("total_amount").isNotNull() | F.exists("items", lambda i: i["produce_id"].isNotNull())
    r = (r.withColumn("order_type", F.coalesce("order_type", F.when(produce, "produce").otherwise("food")))
         .withColumn("subtotal", F.coalesce("subtotal", "total_amount"))
         .withColumn("items", F.transform("items", lambda i: F.struct(
             F.coalesce(i["item_id"], i["produce_id"]).alias("item_id"),
             F.coalesce(i["quantity"], i["quantity_kg"]).alias("quantity"), i["unit_price"].alias("unit_price"))))
         .select(*keep))
    for c, v in DEFAULTS.items():
        r = r.withColumn(c, F.coalesce(F.col(c), F.lit(v)))
    return r


def ingest_checked(lines: DataFrame, col: str = "value") -> tuple[DataFrame, DataFrame]:
    """Requests as :func:`ingest_json` decodes them, and the bodies that are none, unchanged, with an ``error`` (A3).

    Rejected: NULL or blank bodies, text that is no JSON of the expected form (cut off, or text where a number
    belongs), and bodies without ``request_id``.  Other columns of ``lines`` stay on both sides; one whose name is a
    request column is replaced on the first."""
    schema = T.StructType([*WIRE_SCHEMA.fields, T.StructField("_bad", T.StringType())])
    body = F.col(col)
    decoded = lines.withColumn("_r", F.from_json(body, schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}))
    error = (F.when(F.coalesce(F.trim(body), F.lit("")) == "", F.lit("empty body"))
             .when(F.col("_r").isNull() | F.col("_r._bad").isNotNull(), F.lit("not JSON of the expected form"))
             .when(F.col("_r.request_id").isNull(), F.lit("no request_id")))
    judged = decoded.withColumn("error", error)
    own = [c for c in lines.columns if c != col and c not in REQUEST_SCHEMA.names]
    good = judged.where(F.col("error").isNull()).select(*own, *[F.col(f"_r.{n}").alias(n) for n in WIRE_SCHEMA.names])
    return _with_defaults(good, [*own, *REQUEST_SCHEMA.names]), judged.where(F.col("error").isNotNull()).select(*lines.columns, "error")


def quote_discount(subtotal: Column, kind: Column, value: Column) -> Column:
    """Promo discount as the quote computes it: percent -> round(total*v/100, 2),
    anything else flat; capped at the total; rounded half-even to whole PKR."""
    pct = F.round(money(subtotal) * money(value) * F.lit("0.01").cast("decimal(3,2)"), 2)
    raw = F.when(kind == "percent", pct).otherwise(money(value))
    return F.bround(F.least(raw, money(subtotal)), 0)


def derived_requests(d) -> DataFrame:
    """Every historic food and produce order as a placement request.

    Lines keep their list order (position = line order by item id); the
    promo code is the one the order carried; every ``LOYALTY_EVERY``-th
    request redeems ``LOYALTY_REDEEM`` points.
    """
    # Promo codes: one per nation (25 rows by construction), so broadcast.
    promos = d.promo_codes.select(F.col("id").alias("promo_id"), "code", "discount_type", "discount_value")

    # One pass over the lines per family: the item array and the subtotal come
    # from the same aggregate, joined straight to the orders (the order
    # tables would aggregate the same lines a second time).
    food = (d.order_items.groupBy("order_id").agg(
        F.array_sort(F.collect_list(F.struct(F.col("item_id"), F.col("quantity").cast("double").alias("quantity"),
                                             F.col("unit_price")))).alias("items"),
        F.sum(money("unit_price") * F.col("quantity")).alias("sub"))
            .join(d.all_orders, idiv("order_id", 100_000) == F.col("ok"))
            .select(F.col("order_id").alias("request_id"), F.col("created_at").alias("requested_at"),
                    F.lit("food").alias("order_type"), "customer_id",
                    (F.col("order_id") % 100_000).alias("restaurant_id"), "sub", "payment_method",
                    "promo_id", "items"))
    prod = (d.produce_order_items.groupBy("order_id").agg(
        F.array_sort(F.collect_list(F.struct(F.col("produce_id").alias("item_id"),
                                             F.col("quantity_kg").alias("quantity"), F.col("unit_price")))).alias("items"),
        F.sum((money(F.col("quantity_kg").cast("decimal(18,1)")) * money("unit_price")).cast("decimal(18,2)"))
        .alias("sub"))
            .join(d.all_orders, F.col("order_id") == F.col("ok"))
            .select(F.col("order_id").alias("request_id"), F.col("created_at").alias("requested_at"),
                    F.lit("produce").alias("order_type"), "customer_id",
                    F.lit(None).cast("bigint").alias("restaurant_id"), "sub", "payment_method", "promo_id", "items"))
    both = food.unionByName(prod).join(F.broadcast(promos), "promo_id", "left")
    sub = to_double(F.col("sub"))
    return both.select(
        "request_id", "requested_at", "order_type", "customer_id", "restaurant_id",
        sub.alias("subtotal"), F.lit(50.0).alias("delivery_fee"),
        F.col("code").alias("promo_code"),
        F.coalesce(to_double(quote_discount(F.col("sub"), F.col("discount_type"), F.col("discount_value"))),
                   F.lit(0.0)).alias("promo_discount"),
        F.when(F.col("request_id") % LOYALTY_EVERY == 0, F.lit(LOYALTY_REDEEM)).otherwise(F.lit(0.0))
        .alias("loyalty_discount"),
        "payment_method", F.lit("").alias("delivery_address"), F.lit("").alias("special_instructions"),
        F.lit(35).alias("estimated_time"), "items")
