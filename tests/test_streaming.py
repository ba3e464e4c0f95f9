"""Streams = batch when the input arrives as several files in any order, one
file per micro-batch, with replayed rows, lost commits and late rows."""

import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from ladle.operators import joins as J
from ladle.operators import windows as W
from ladle.plans import catalog
from ladle.plans.compare import compare, duck_connect
from ladle.sources.domain import Domain
from ladle.sources.sinks import numbers, run_to_files
from ladle.sources.staging import scratch
from ladle.streaming import streams as X
from ladle.streaming.keyed import all_versions, newest, run_updates

STREAMS = ["stream_admin_kpis", "stream_manager_stats", "stream_available_orders", "stream_unread", "stream_order_status",
           "stream_ratings"]


def _rows(df):
    cols = sorted(df.columns)
    return sorted(map(repr, df.select(*cols).collect()))


@pytest.mark.parametrize("key", STREAMS)
def test_four_batches_equal_the_sql(spark, key, monkeypatch):
    catalog.load_all()
    monkeypatch.setitem(catalog.QUERIES, key, lambda d: getattr(X, key)(X.Arrivals(d, files=4)))
    assert compare(spark, SF_SMALL, key, duck_connect(SF_SMALL))["status"] == "ok"


@pytest.mark.parametrize("late_by", ["1 minute", "3650 days"])
def test_loyalty_over_four_batches_in_any_order(spark, late_by):
    d = Domain(spark, SF_SMALL)
    got = X.stream_loyalty(X.Arrivals(d, files=4), late_by=late_by)
    want = W.loyalty_balance_running(d.loyalty_transactions).withColumns(
        {c: F.col(c).cast("bigint") for c in ("balance_before", "balance_after")})
    assert _rows(got.drop("tier")) == _rows(want)
    tiers = {r.customer_id: r.tier for r in J.loyalty_tier(d.loyalty_points, J.tier_dim(spark)).collect()}
    assert {r.customer_id: r.tier for r in got.collect()} == tiers


@pytest.mark.parametrize("late_by", ["1 minute", "3650 days"])
def test_audit_loses_no_late_row_and_drops_replays(spark, late_by):
    d = Domain(spark, SF_SMALL)
    path = scratch(spark, "test-audit")
    d.audit_log.repartition(3, "id").write.parquet(path)
    d.audit_log.where(F.col("id") % 5 == 0).coalesce(1).write.mode("append").parquet(path)
    source = spark.readStream.schema(d.audit_log.schema).option("maxFilesPerTrigger", 1).parquet(path)
    got = X.stream_audit(X.Arrivals(d), late_by=late_by, source=source)
    assert _rows(got) == _rows(J.audit_with_user(d.audit_log, d.users))


def test_late_riders_are_merged(spark):
    d = Domain(spark, SF_SMALL)
    got = X.stream_order_status(X.Arrivals(d, files=5), within="1 minute")
    assert _rows(got) == _rows(J.order_detail(d.food_orders, d.restaurants, d.riders, d.users))


def test_only_committed_batches_are_read(spark):
    d = Domain(spark, SF_SMALL)
    root = scratch(spark, "test-keyed")
    stream = X.Arrivals(d, files=3).stream(d.reviews, "reviews")
    versions = run_updates(stream.groupBy("restaurant_id").agg(F.count(F.lit(1)).alias("n")), root)
    want = _rows(d.reviews.groupBy("restaurant_id").agg(F.count(F.lit(1)).alias("n")))
    assert _rows(newest(versions, "restaurant_id")) == want
    assert versions.select("epoch").distinct().count() == 3 == len(numbers(spark, f"{root}/checkpoint/commits"))
    # the rows of a batch that died before its commit do not count
    versions.where("epoch = 2").drop("epoch").withColumn("n", F.lit(-1).cast("bigint")).write.parquet(f"{root}/rows/epoch=3")
    again = all_versions(spark, root, versions.drop("epoch").schema)
    assert _rows(newest(again, "restaurant_id")) == want


def test_changed_rows_are_written_by_columns(spark, monkeypatch):
    """no row of an update-mode stream passes a Python writer on its own."""
    from pyspark.sql.streaming import DataStreamWriter

    def rowwise(*_):
        raise AssertionError("rows one by one")

    monkeypatch.setattr(DataStreamWriter, "foreach", rowwise)
    d = Domain(spark, SF_SMALL)
    orders = X.latest_orders(X.Arrivals(d, files=3), "test-latest")
    want = d.food_orders.select("id", "status").unionByName(d.produce_orders.select("id", "status"))
    assert _rows(orders.select("id", "status")) == _rows(want)


def test_tracking_lays_every_table_out_once(spark, monkeypatch):
    """the three streams of the tracking detail read two tables, each written once."""
    named = []
    real = X.scratch
    monkeypatch.setattr(X, "scratch", lambda s, name: named.append(name) or real(s, name))
    d = Domain(spark, SF_SMALL)
    got = X.stream_order_status(X.Arrivals(d, files=2))
    assert sorted(n for n in named if n.startswith("arriving-")) == ["arriving-orders", "arriving-riders"]
    assert _rows(got) == _rows(J.order_detail(d.food_orders, d.restaurants, d.riders, d.users))


def test_a_deal_is_as_many_files_as_its_rows_need(spark):
    """With a small partition size a deal is cut; without, it is one file.  Either way all rows arrive."""
    from types import SimpleNamespace
    rows = spark.range(0, 200_000, 1, 8).selectExpr("id", "uuid() as text")
    a = X.Arrivals(SimpleNamespace(spark=spark), files=2)
    size = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    old = spark.conf.get(size)
    try:
        spark.conf.set(size, "1m")
        cut = a.stream(rows, "cut")
    finally:
        spark.conf.set(size, old)
    whole = a.stream(rows, "whole")
    for stream, few in ((cut, False), (whole, True)):
        top = scratch(spark, "deals")
        run_to_files(stream, f"{top}/rows", f"{top}/checkpoint")
        got = spark.read.schema(rows.schema).parquet(f"{top}/rows")
        assert got.count() == 200_000 and got.select("id").distinct().count() == 200_000
        assert (len(got.inputFiles()) <= 4) == few
