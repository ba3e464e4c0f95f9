"""Windows, ranking and running values (W1-W7) and the skew-safe helpers
the settlement relies on.

Per-key top-n
    ``row_number() <= n``: Spark inserts a partial WindowGroupLimit before
    the exchange, so each map task ships at most ``n`` rows per key.

Running sums on hot keys
    A window partitioned only by the key sends a hot key (one promo code used
    by a third of all orders) to a single task.  :func:`running_sum` cuts the
    (key, order) sequence into contiguous range slices: a small (slice, key)
    total table gives each slice its offset, and the running sum inside each
    (slice, key) group adds it.  The result is exact; no group is larger than
    one range slice.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.staging import staged


def top_n_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= n)


def running_sum(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: Column | str | Sequence[Column | str],
                out: str | Sequence[str], inclusive: bool = False, bucket: Column | None = None,
                slices: int | None = None) -> DataFrame:
    """Per-key running sum of ``value`` ordered by ``order`` (ascending; the
    order columns must make rows unique within a key).  ``inclusive=False``
    sums strictly earlier rows.  Exact two-level prefix sum.  ``value`` and
    ``out`` may be lists of equal length: several sums in one pass.  Rows with
    a NULL key form a key of their own.

    Buckets are contiguous slices of the ``(keys, order)`` total order:
    by default ``repartitionByRange`` cuts the data into ``slices`` ranges
    (``spark.sql.shuffle.partitions``) from a sample, so a key holding a third
    of all rows spans many slices and no slice exceeds ~1/``slices`` of the
    data, however its timestamps are distributed.  Each slice gets the sum of
    the key's earlier slices as an offset (a table of at most keys + slices
    rows) and the ordered window runs inside (slice, key).  The sliced rows
    are written once, with their slice id.  A caller may pass its own
    monotone ``bucket`` expression instead (e.g. a day; nothing is written)."""
    outs = [out] if isinstance(out, str) else list(out)
    values = [value] if isinstance(out, str) else list(value)
    keys = list(keys)
    vs = [f"_v{i}" for i in range(len(outs))]
    x = df.withColumns({v: F.col(c) if isinstance(c, str) else c for v, c in zip(vs, values)})
    if bucket is not None:
        x = x.withColumn("_b", bucket)
    else:
        n = slices or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        # The slice id must be the same in both uses below; range bounds are
        # sampled per exchange, so the sliced rows are written once with it.
        x = staged(x.repartitionByRange(n, *[F.col(k) for k in keys], *[F.col(c) for c in order])
                   .withColumn("_b", F.spark_partition_id()), "running-sum")
    totals = x.groupBy("_b", *keys).agg(*[F.sum(v).alias(f"{v}t") for v in vs])
    wb = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(F.col("_b").alias("_ob"), *[F.col(k).alias(f"_ok{i}") for i, k in enumerate(keys)],
                            *[F.coalesce(F.sum(f"{v}t").over(wb), F.lit(0)).alias(f"{v}o") for v in vs])
    frame_end = Window.currentRow if inclusive else -1
    wi = (Window.partitionBy("_b", *keys).orderBy(*[F.col(c) for c in order])
          .rowsBetween(Window.unboundedPreceding, frame_end))
    inner = x.withColumns({f"{v}i": F.coalesce(F.sum(v).over(wi), F.lit(0)) for v in vs})
    same = F.col("_b") == F.col("_ob")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_ok{i}"))
    joined = inner.join(offsets, same)
    return joined.select(*keys, *[c for c in df.columns if c not in keys and c not in outs],
                         *[(F.col(f"{v}o") + F.col(f"{v}i")).alias(o) for v, o in zip(vs, outs)])


def last_message_per_contact(messages: DataFrame) -> DataFrame:
    """Newest message of each (user, other) pair in either direction."""
    lo, hi = F.least("sender_id", "receiver_id"), F.greatest("sender_id", "receiver_id")
    return messages.groupBy(lo.alias("user_lo"), hi.alias("user_hi")).agg(
        F.max_by(F.struct("id", "sender_id", "receiver_id", "message", "created_at"),
                 F.struct("created_at", "id")).alias("m")).select("user_lo", "user_hi", "m.*")


def loyalty_last20(loyalty_transactions: DataFrame, n: int = 20) -> DataFrame:
    """The newest ``n`` transactions of every customer."""
    return top_n_per_key(loyalty_transactions, ["customer_id"], [F.desc("created_at"), F.desc("id")], n)


def promo_usage_running(promo_orders: DataFrame) -> DataFrame:
    """Uses of the code before each order (W3); both order families share
    the counter.  Input: ``promo_id``, ``created_at``, ``order_type``, ``id``."""
    return running_sum(promo_orders, ["promo_id"], ["created_at", "order_type", "id"], F.lit(1),
                       "uses_before")


def loyalty_balance_running(loyalty_transactions: DataFrame) -> DataFrame:
    """Balance before and after each ledger row."""
    r = running_sum(loyalty_transactions, ["customer_id"], ["created_at", "id"], "points", "balance_before")
    return r.withColumn("balance_after", F.col("balance_before") + F.col("points"))


def stock_running(lines: DataFrame, produce_items: DataFrame) -> DataFrame:
    """Kg left before each produce order line: ``max(0, stock - earlier)``
    where "earlier" is every line of strictly earlier orders (two lines of
    one item in one order both see the pre-order stock) (W5).

    ``lines``: ``order_id``, ``created_at``, ``produce_id``, ``quantity_kg``.
    """
    per_order = (lines.groupBy("produce_id", "order_id", "created_at")
                 .agg(F.sum(F.col("quantity_kg").cast("decimal(18,6)")).alias("q")))
    run = running_sum(per_order, ["produce_id"], ["created_at", "order_id"], "q", "used_before")
    stock = produce_items.select(F.col("id").alias("produce_id"), F.col("stock_kg").cast("decimal(18,6)").alias("s"))
    j = run.join(stock, "produce_id")
    left = F.greatest(F.lit(0).cast("decimal(18,6)"), F.col("s") - F.col("used_before"))
    return (lines.join(j.select("produce_id", "order_id", left.cast("double").alias("stock_before")),
                       ["produce_id", "order_id"]))


def loyalty_tier_progress(points: DataFrame, tiers: DataFrame) -> DataFrame:
    """Tier, next tier, progress % (capped at 100; 100 at the top tier) and
    points to the next tier (W6).  ``lead`` over the 4-row tier table gives
    each tier its successor; the table is broadcast."""
    from .joins import loyalty_tier
    nxt = tiers.select("tier", "min_points",
                       F.lead("tier").over(Window.orderBy("min_points")).alias("next_tier"),
                       F.lead("min_points").over(Window.orderBy("min_points")).alias("next_min"))
    t = loyalty_tier(points, tiers)
    j = t.join(F.broadcast(nxt), "tier", "left")
    life = F.col("lifetime_points")
    progress = F.when(F.col("next_min").isNull(), F.lit(100.0)).otherwise(
        F.least(F.lit(100.0), (life - F.col("min_points")).cast("double")
                / (F.col("next_min") - F.col("min_points")).cast("double") * 100))
    return j.select(*t.columns, "next_tier", progress.alias("progress_pct"),
                    (F.col("next_min") - life).alias("points_to_next"))


def review_rating_running(reviews: DataFrame) -> DataFrame:
    """Rating stored after each review: avg of the restaurant's reviews so
    far (this one included), half-up to 1 dp (W7)."""
    keys, order = ["restaurant_id"], ["created_at", "id"]
    s = running_sum(reviews, keys, order, [F.col("rating").cast("bigint"), F.lit(1).cast("bigint")], ["_s", "_n"],
                    inclusive=True)
    avg1 = (F.floor((F.col("_s") * 20 + F.col("_n")) / (F.col("_n") * 2)) / 10).cast("double")
    return s.withColumn("rating_after", avg1).drop("_s", "_n")
