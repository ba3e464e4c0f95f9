"""Structured Streaming versions of the app's polling dashboards.

Orders arrive as a change stream: one row per status an order went through,
with the status before it; messages, ledger rows, audit rows and reviews
arrive as they are written.  Aggregates run in update mode and write their
changed rows to files (:mod:`keyed`); rows are appended to files by the
Parquet sink.  The results are read back from those files and finished with
the same operators as the batch reports, so nothing is held on the driver.

Watermarks bound the state.  A row that comes later than its watermark allows
is never lost: every row is also kept by a stateless branch, and the reader
repairs what the stateful branch did not see.
"""

from __future__ import annotations

from functools import cached_property
from types import SimpleNamespace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.money import money
from ..operators import aggregates as A
from ..operators import joins as J
from ..operators import setops as U
from ..operators.windows import running_sum
from ..sources.sinks import run_to_files
from ..sources.staging import scratch
from .keyed import newest, run_updates

# The app's order of statuses.
FLOW = ["Pending", "Confirmed", "Preparing", "Out for Delivery", "Delivered"]
MINUTES_PER_STEP = 10


def instant(c: str) -> Column:
    """A time as TIMESTAMP, which watermarks need (session time zone UTC)."""
    return F.col(c).cast("timestamp")


class Arrivals:
    """Streams of a domain's rows: every table is laid out as ``files`` deals by a hash of the row's id, and read
    ``per_trigger`` deals' worth of files at a time.  A deal is one file, or as many of AQE's partition size as its rows
    need, so that no task writes or reads more.  Rows are dealt without regard to time, so they come out of order.
    Queries over the same table read the same files."""

    def __init__(self, domain, files: int = 2, per_trigger: int = 1):
        self.d, self.files, self.per_trigger = domain, files, per_trigger
        self._laid: dict[tuple[str, str], tuple[DataFrame, str]] = {}

    def _lay(self, rows: DataFrame, name: str, key: str) -> str:
        laid = self._laid.get((name, key))
        if laid is None or laid[0] is not rows:
            path = scratch(self.d.spark, f"arriving-{name}")
            dealt = rows.withColumn("deal", F.pmod(F.xxhash64(key), F.lit(self.files)))
            dealt.hint("rebalance", "deal").write.partitionBy("deal").parquet(path)
            laid = self._laid[name, key] = rows, path
        return laid[1]

    def stream(self, rows: DataFrame, name: str, key: str = "id") -> DataFrame:
        spark, path = self.d.spark, self._lay(rows, name, key)
        parts = len(spark.read.schema(rows.schema).option("recursiveFileLookup", True).parquet(path).inputFiles())
        at_once = max(1, -(-parts * self.per_trigger // self.files))
        return (spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", at_once)
                .option("recursiveFileLookup", True).parquet(path))

    @cached_property
    def changes_table(self) -> DataFrame:
        """Every status of every order: its columns, ``seq`` from 0, ``prev_status`` and ``changed_at``.  An order has
        its rider from its last status on."""
        food = self.d.food_orders.withColumn("order_type", F.lit("food"))
        kinds = {f.name: f.dataType.simpleString() for f in food.schema}
        orders = food.unionByName(U.conform(self.d.produce_orders.withColumn("order_type", F.lit("produce")), kinds))
        flow = F.array(*[F.lit(s) for s in FLOW])
        steps = F.when(F.col("status") == "Cancelled", F.array(F.lit("Pending"), F.lit("Cancelled"))).otherwise(
            F.slice(flow, F.lit(1), F.array_position(flow, F.col("status")).cast("int")))
        last = F.size("steps") - 1
        return orders.withColumn("steps", steps).select("*", F.posexplode("steps").alias("seq", "now")).select(
            *[c for c in orders.columns if c not in ("status", "rider_id")],
            F.when(F.col("seq") == last, F.col("rider_id")).alias("rider_id"), F.col("now").alias("status"), "seq",
            F.get("steps", F.col("seq") - 1).alias("prev_status"),
            F.timestamp_add("MINUTE", F.col("seq") * MINUTES_PER_STEP, F.col("created_at")).alias("changed_at"))

    def changes(self) -> DataFrame:
        return self.stream(self.changes_table, "orders")


def _signed(value: Column) -> Column:
    """``value`` when an order becomes delivered, taken back when it leaves that status."""
    now, before = F.col("status") == "Delivered", F.coalesce(F.col("prev_status") == "Delivered", F.lit(False))
    return F.when(now & ~before, value).when(~now & before, -value)


def _placed(value: Column) -> Column:
    return F.when(F.col("seq") == 0, value)


def stream_manager_stats(a: Arrivals) -> DataFrame:
    """Per restaurant: orders, delivered revenue, fee and net, zeros included (X2, the rows of G3)."""
    food = a.changes().where(F.col("order_type") == "food")
    per = food.groupBy("restaurant_id").agg(
        F.sum(_placed(F.lit(1))).alias("total_orders"), F.sum(_signed(money("total_amount"))).alias("rev"))
    now = newest(run_updates(per, scratch(a.d.spark, "manager-stats")), "restaurant_id")
    return A.manager_report(a.d.restaurants, now)


def stream_admin_kpis(a: Arrivals) -> DataFrame:
    """The admin dashboard from one scan of the order changes (X1): G1, G2, G6 and G7 as (report, name, value).

    A change goes into two groupings at once, by scope: all food orders; and every order under the label of its
    restaurant, from which both the top list and the revenue split follow."""
    d = a.d
    names = d.restaurants.select(F.col("id").alias("restaurant_id"), F.col("name").alias("restaurant_name"))
    customers = d.users.select(F.col("id").alias("customer_id"), F.lit(True).alias("known"))
    c = a.changes().join(names, "restaurant_id", "left").join(customers, "customer_id", "left")
    food = F.col("order_type") == "food"
    shown = F.col("known") & (~food | F.col("restaurant_name").isNotNull())
    name = F.when(food, F.col("restaurant_name")).otherwise(J.PRODUCE_MARKET)
    label = F.substring(F.coalesce(F.nullif(name, F.lit("")), F.lit("Unknown")), 1, 15)
    scopes = F.array_compact(F.array(F.when(food, F.struct(F.lit("food").alias("scope"), F.lit("").alias("label"))),
                                     F.when(shown, F.struct(F.lit("shown").alias("scope"), label.alias("label")))))
    sums = {c2: F.sum(_placed(money(c2))).alias(c2) for c2 in ("total_amount", "delivery_fee", "platform_fee", "rider_tip")}
    per = c.withColumn("g", F.explode(scopes)).groupBy("g.scope", "g.label").agg(
        F.sum(_placed(F.lit(1))).alias("orders"), *sums.values(),
        F.sum(_signed(money("total_amount"))).alias("delivered"), F.sum(_signed(money("platform_fee"))).alias("delivered_fee"))
    now = newest(run_updates(per, scratch(d.spark, "admin-kpis")), "scope", "label")
    z = lambda c: F.coalesce(F.sum(c), F.lit(0))
    total = now.where(F.col("scope") == "food").agg(
        z("orders").alias("total_orders"), z("delivered").alias("revenue"), z("delivered_fee").alias("platform_revenue"),
        z("platform_fee").alias("total_platform_cut"))
    shown_orders = now.where(F.col("scope") == "shown")
    static = A.admin_counts(d.food_orders.limit(0), d.users, d.riders, d.restaurants)
    top = shown_orders.groupBy(F.col("label").alias("name")).agg(F.sum("orders").cast("double").alias("value")) \
        .orderBy(F.desc("value"), "name").limit(10)
    split = A.revenue_split(shown_orders)
    parts = [_tall(static.drop("total_orders"), "counts"), _tall(total.select("total_orders"), "counts"),
             _tall(total.drop("total_orders"), "revenue"), _tall(split, "breakdown"),
             top.select(F.lit("top restaurants").alias("report"), "name", "value")]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _tall(one_row: DataFrame, report: str) -> DataFrame:
    """A one-row report as (report, name, value) rows."""
    pairs = F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).cast("double").alias("value")) for c in one_row.columns])
    return one_row.select(F.lit(report).alias("report"), F.explode(pairs).alias("p")).select("report", "p.name", "p.value")


def latest_orders(a: Arrivals, name: str, only: Column | None = None) -> DataFrame:
    """The newest state of every order, from the change stream: one state row per order."""
    c = a.changes() if only is None else a.changes().where(only)
    rest = [x for x in c.columns if x not in ("id", "order_type")]
    per = c.groupBy("order_type", "id").agg(F.max_by(F.struct(*rest), "seq").alias("o"))
    return newest(run_updates(per, scratch(a.d.spark, name)), "order_type", "id").select("order_type", "id", "o.*")


def stream_available_orders(a: Arrivals) -> DataFrame:
    """Confirmed orders without a rider, by their latest status, with pickup and names (X3, the rows of U3)."""
    now = latest_orders(a, "available")
    view = SimpleNamespace(food_orders=now.where(F.col("order_type") == "food").drop("order_type"),
                           produce_orders=now.where(F.col("order_type") == "produce").drop("order_type", "restaurant_id"),
                           restaurants=a.d.restaurants, users=a.d.users)
    return U.available_orders(view)


def stream_unread(a: Arrivals) -> DataFrame:
    """The admin's inbox (X4, the rows of G17): one state row per contact holds the newest message of either direction
    and the unread count."""
    admin = a.d.users.where(F.col("role") == "admin").agg(F.min("id").alias("admin_id"))
    m = a.stream(a.d.messages, "messages").join(F.broadcast(admin), (F.col("sender_id") == F.col("admin_id"))
                                                | (F.col("receiver_id") == F.col("admin_id")))
    other = F.when(F.col("sender_id") == F.col("admin_id"), F.col("receiver_id")).otherwise(F.col("sender_id"))
    unread = (F.col("receiver_id") == F.col("admin_id")) & (F.col("is_read") == 0) & (F.col("sender_id") != F.col("admin_id"))
    per = m.groupBy(other.alias("contact_id")).agg(
        F.max_by("message", F.struct("created_at", "id")).alias("last_message"), A.count_if(unread).alias("unread"))
    now = newest(run_updates(per, scratch(a.d.spark, "inbox")), "contact_id")
    people = a.d.users.where(F.col("role") != "admin").select("id", "name", "role")
    return people.join(now, people["id"] == now["contact_id"]).select("id", "name", "role", "last_message", "unread")


def stream_loyalty(a: Arrivals, slice_by: str = "month", late_by: str = "30 days") -> DataFrame:
    """Balance before and after each ledger row, and the customer's tier (X5: the rows of W4 with C16's tier).

    Time is cut into slices.  One branch keeps the rows, the other the sum and number of rows per customer and slice,
    in state that a watermark (``late_by``) ends.  A row's balance is the sum of the customer's earlier slices plus the
    rows before it in its slice.  Where a late row made the numbers differ, the slice is summed from its rows."""
    spark, tx = a.d.spark, a.d.loyalty_transactions
    rows_at = scratch(spark, "ledger-rows")
    cut = F.date_trunc(slice_by, instant("created_at"))
    run_to_files(a.stream(tx, "ledger").withColumn("slice", cut.cast("string")), f"{rows_at}/rows", f"{rows_at}/checkpoint")
    with_slice = T.StructType([*tx.schema.fields, T.StructField("slice", T.StringType())])
    points = F.col("points")
    per = (a.stream(tx, "ledger").withColumn("slice_start", cut).withWatermark("slice_start", late_by)
           .groupBy("customer_id", "slice_start").agg(
               F.sum("points").alias("points"), F.sum(F.greatest(points, F.lit(0))).alias("earned"), F.count(F.lit(1)).alias("n")))
    totals = newest(run_updates(per, scratch(spark, "ledger-slices")), "customer_id", "slice_start") \
        .withColumn("slice", F.col("slice_start").cast("string")).drop("slice_start")
    rows = spark.read.schema(with_slice).parquet(f"{rows_at}/rows")
    counted = rows.groupBy("customer_id", "slice").agg(F.count(F.lit(1)).alias("rows"))
    odd = counted.join(totals, ["customer_id", "slice"], "left").where(~F.col("rows").eqNullSafe(F.col("n"))) \
        .select("customer_id", "slice")
    repaired = rows.join(odd, ["customer_id", "slice"], "left_semi").groupBy("customer_id", "slice").agg(
        F.sum("points").alias("points"), F.sum(F.greatest(points, F.lit(0))).alias("earned"), F.count(F.lit(1)).alias("n"))
    slices = totals.join(odd, ["customer_id", "slice"], "left_anti").unionByName(repaired.select(totals.columns))
    offsets = running_sum(slices, ["customer_id"], ["slice"], "points", "offset").select("customer_id", "slice", "offset")
    inside = running_sum(rows, ["customer_id", "slice"], ["created_at", "id"], "points", "inside")
    lifetime = slices.groupBy("customer_id").agg(F.sum("earned").alias("lifetime_points"))
    tiers = J.loyalty_tier(lifetime, J.tier_dim(spark)).select("customer_id", "tier")
    out = inside.join(offsets, ["customer_id", "slice"]).join(tiers, "customer_id")
    before = (F.col("offset") + F.col("inside")).cast("bigint")
    return out.select(*tx.columns, before.alias("balance_before"), (before + points).cast("bigint").alias("balance_after"), "tier")


def stream_order_status(a: Arrivals, within: str = "2 hours") -> DataFrame:
    """Tracking detail of every food order (X6, the rows of C4): the latest status, and the rider from a left outer
    join of two streams, status changes and rider assignments, both with a watermark.

    State of the join ends ``within`` after a row; an assignment that comes later is kept by its own branch and
    merged by the reader."""
    d, spark = a.d, a.d.spark
    given = d.food_orders.where(F.col("rider_id").isNotNull()).select(
        F.col("id").alias("order_id"), "rider_id", F.timestamp_add("MINUTE", F.lit(25), F.col("created_at")).alias("assigned_at"))
    top = scratch(spark, "tracking")
    status = a.changes().where(F.col("order_type") == "food").select(
        "id", "seq", instant("changed_at").alias("changed")).withWatermark("changed", within)
    riders = a.stream(given, "riders", "order_id").withColumn("assigned", instant("assigned_at")).withWatermark("assigned", within)
    near = (F.col("id") == F.col("order_id")) & (F.col("assigned") >= F.col("changed") - F.expr("interval 1 hour")) \
        & (F.col("assigned") <= F.col("changed") + F.expr("interval 1 hour"))
    joined = status.join(riders, near, "leftOuter").select("id", "seq", "rider_id", "assigned_at")
    run_to_files(joined, f"{top}/joined", f"{top}/joined-checkpoint")
    run_to_files(a.stream(given, "riders", "order_id"), f"{top}/riders", f"{top}/riders-checkpoint")
    matched = spark.read.schema(joined.schema).parquet(f"{top}/joined").where(F.col("rider_id").isNotNull()) \
        .select(F.col("id").alias("order_id"), "rider_id", "assigned_at")
    late = spark.read.schema(given.schema).parquet(f"{top}/riders").join(matched, ["order_id", "assigned_at"], "left_anti")
    rider = matched.unionByName(late.select(matched.columns)).groupBy("order_id").agg(
        F.max_by("rider_id", F.struct("assigned_at", "rider_id")).alias("rider_id"))
    now = latest_orders(a, "status", F.col("order_type") == "food").drop("order_type", "rider_id")
    orders = now.join(rider, now["id"] == rider["order_id"], "left").select(*d.food_orders.columns)
    return J.order_detail(orders, d.restaurants, d.riders, d.users)


def stream_audit(a: Arrivals, late_by: str = "1 hour", source: DataFrame | None = None) -> DataFrame:
    """Audit rows with the user's name, replays dropped by id (X7, the rows of C7).

    De-duplication state ends ``late_by`` after the newest row seen.  What came later than that and was dropped is
    taken from the branch that keeps every row: rows whose id the first branch did not write, once each.  So
    ``late_by`` bounds the state and never loses a row.  ``source`` replaces the stream of audit rows."""
    spark = a.d.spark
    read = (lambda: source) if source is not None else (lambda: a.stream(a.d.audit_log, "audit"))
    top = scratch(spark, "audit")
    schema = a.d.audit_log.schema
    once = read().withColumn("ets", instant("timestamp")).withWatermark("ets", late_by).dropDuplicatesWithinWatermark(["id"]).drop("ets")
    run_to_files(once, f"{top}/once", f"{top}/once-checkpoint")
    run_to_files(read(), f"{top}/all", f"{top}/all-checkpoint")
    done = spark.read.schema(schema).parquet(f"{top}/once")
    # state that ended may let a replay through a second time, so ids are made unique once more
    late = spark.read.schema(schema).parquet(f"{top}/all").join(done.select("id"), "id", "left_anti").select(schema.names)
    return J.audit_with_user(done.unionByName(late).dropDuplicates(["id"]), a.d.users)


def stream_ratings(a: Arrivals) -> DataFrame:
    """Ratings from the review stream (X8, the rows of G4); a restaurant without reviews keeps its stored rating."""
    per = a.stream(a.d.reviews, "reviews").groupBy("restaurant_id").agg(
        F.sum("rating").cast("bigint").alias("s"), F.count(F.lit(1)).alias("n"))
    return A.rating_report(a.d.restaurants, newest(run_updates(per, scratch(a.d.spark, "ratings")), "restaurant_id"))
