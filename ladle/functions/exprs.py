"""Scalar expressions of the UI layer (initials, age labels, stars, ETA,
status maps), all as built-in column expressions -- no Python UDFs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Order status steps, bar fill, tracking labels, simulated
# rider progress and ETA text, as shown on the tracking page.
STATUS_STEPS = ("Pending", "Confirmed", "Preparing", "Out for Delivery", "Delivered")
STATUS_ROWS = [
    # status, step, fill, label, progress, eta
    ("Pending", 0, "0%", "Waiting for restaurant", 0, "Waiting for confirmation"),
    ("Confirmed", 1, "25%", "Restaurant confirmed!", 15, "~30 min"),
    ("Preparing", 2, "50%", "Chef is cooking your food", 40, "~20 min"),
    ("Out for Delivery", 3, "75%", "Rider is on the way!", 75, "~10 min"),
    ("Delivered", 4, "100%", "Delivered! Enjoy your meal \U0001F389", 100, "Delivered! ✅"),
]
STAR_FULL = "⭐"
STAR_EMPTY = "☆"
DEFAULT_ETA_MIN = 35
ETA_EXTRA_MIN = 10


def status_dim(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        STATUS_ROWS, "status string, step int, fill string, label string, progress int, eta string")


def order_progress(orders: DataFrame, dim: DataFrame) -> DataFrame:
    """Status -> step, fill, label, progress, ETA text (defaults: 'Pending'
    look, progress 0, ETA '—'), plus the 0-based position in the step list
    (-1 when absent).  The 5-row dimension is broadcast."""
    d = F.broadcast(dim.withColumnRenamed("status", "_st"))
    j = orders.join(d, orders["status"] == d["_st"], "left")
    return j.select(
        "id", "status",
        F.coalesce("step", F.lit(0)).alias("step"),
        F.coalesce("fill", F.lit("0%")).alias("fill"),
        F.coalesce("label", F.lit("Waiting for restaurant")).alias("label"),
        F.coalesce("progress", F.lit(0)).alias("progress"),
        F.coalesce("eta", F.lit("—")).alias("eta"),
        (F.array_position(F.array(*[F.lit(s) for s in STATUS_STEPS]), F.col("status")) - 1).cast("int").alias("step_index"),
    )


def initials(name: Column | str) -> Column:
    """First letter of each space-separated word, first two, upper-cased."""
    name = F.col(name) if isinstance(name, str) else name
    letters = F.transform(F.split(name, " "), lambda w: F.substring(w, 1, 1))
    return F.upper(F.substring(F.array_join(letters, ""), 1, 2))


def stars(rating: Column | str) -> Column:
    r = F.col(rating) if isinstance(rating, str) else rating
    return F.concat(F.repeat(F.lit(STAR_FULL), r), F.repeat(F.lit(STAR_EMPTY), F.lit(5) - r))


def eta_minutes(delivery_time: Column | str) -> Column:
    c = F.col(delivery_time) if isinstance(delivery_time, str) else delivery_time
    return F.coalesce(F.nullif(c, F.lit(0)), F.lit(DEFAULT_ETA_MIN)) + ETA_EXTRA_MIN


def age_label(ts: Column | str, as_of: str) -> Column:
    """'just now' / 'Nm ago' / 'Nh ago' / M/D/YYYY relative to ``as_of``
    (the run timestamp is a parameter, never the clock)."""
    ts = F.col(ts) if isinstance(ts, str) else ts
    now = F.lit(as_of).cast("timestamp_ntz")
    m = F.timestamp_diff("MINUTE", ts, now)
    h = F.floor(m / 60)
    return (F.when(m < 1, F.lit("just now"))
            .when(m < 60, F.concat(m.cast("string"), F.lit("m ago")))
            .when(h < 24, F.concat(h.cast("string"), F.lit("h ago")))
            .otherwise(F.date_format(ts, "M/d/yyyy")))
