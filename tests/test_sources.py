"""Sources and sinks: JSON request ingest with defaults, versioned
committed snapshots, partitioned audit append."""

import datetime as dt
import gzip
import json
import tempfile
from pathlib import Path

from pyspark.sql import functions as F

from ladle.sources import sinks
from ladle.sources.requests import ingest_checked, ingest_json


def test_ingest_fills_defaults(spark):
    lines = [json.dumps({"request_id": 1, "order_type": "food", "customer_id": 3, "restaurant_id": 2,
                         "subtotal": 120.5, "items": [{"item_id": 9, "quantity": 2, "unit_price": 60.25}]}),
             json.dumps({"request_id": 2, "order_type": "food", "customer_id": 3, "restaurant_id": 2,
                         "subtotal": 10.0, "delivery_fee": 70, "payment_method": "Card", "items": []})]
    r = {x.request_id: x for x in ingest_json(spark.createDataFrame([(v,) for v in lines], "value string")).collect()}
    assert (r[1].delivery_fee, r[1].payment_method, r[1].estimated_time) == (50.0, "Cash on Delivery", 35)
    assert (r[1].promo_discount, r[1].loyalty_discount) == (0.0, 0.0)
    assert r[1].items[0].item_id == 9 and r[1].items[0].quantity == 2.0
    assert (r[2].delivery_fee, r[2].payment_method) == (70.0, "Card")


def test_ingest_produce_body(spark):
    line = json.dumps({"request_id": 3, "customer_id": 4, "total_amount": 150.0,
                       "items": [{"produce_id": 7, "quantity_kg": 1.25, "unit_price": 120.0}]})
    r = ingest_json(spark.createDataFrame([(line,)], "value string")).first()
    assert (r.order_type, r.subtotal, r.delivery_fee) == ("produce", 150.0, 50.0)
    assert tuple(r.items[0]) == (7, 1.25, 120.0)


def test_snapshots_switch_versions(spark):
    root = tempfile.mkdtemp(prefix="run-", dir="/tmp") + "/promo_codes"
    v1 = sinks.write_snapshot(spark.createDataFrame([("A", 1)], "code string, used int"), root)
    v2 = sinks.write_snapshot(spark.createDataFrame([("A", 2), ("B", 0)], "code string, used int"), root)
    assert (v1, v2) == (1, 2)
    assert sorted(tuple(r) for r in sinks.read_snapshot(spark, root).collect()) == [("A", 2), ("B", 0)]
    # the previous version stays readable: nothing was overwritten in place
    assert spark.read.parquet(f"{root}/v=1").count() == 1


def test_snapshot_survives_a_crash_before_its_commit(spark):
    root = tempfile.mkdtemp(prefix="run-", dir="/tmp") + "/promo_codes"
    one, two = (spark.createDataFrame([("A", n)], "code string, used int") for n in (1, 2))
    sinks.write_snapshot(one, root)
    two.write.parquet(f"{root}/v=2")  # a writer that died before the commit
    assert [tuple(r) for r in sinks.read_snapshot(spark, root).collect()] == [("A", 1)]
    assert sinks.write_snapshot(two, root) == 3
    assert [tuple(r) for r in sinks.read_snapshot(spark, root).collect()] == [("A", 2)]


def test_audit_append_partitions_by_day(spark):
    path = tempfile.mkdtemp(prefix="run-", dir="/tmp") + "/audit"
    t = dt.datetime(2024, 5, 1, 23, 30)
    rows = spark.createDataFrame([(1, "LOGIN", "x", t), (2, "LOGIN", "y", t + dt.timedelta(hours=1))],
                                 "user_id bigint, action string, details string, timestamp timestamp_ntz")
    sinks.audit_append(rows, path)
    sinks.audit_append(rows.limit(1), path)
    got = spark.read.parquet(path)
    assert got.count() == 3
    assert {str(r.event_date) for r in got.select("event_date").distinct().collect()} == {"2024-05-01", "2024-05-02"}
    assert got.where(F.col("event_date") == "2024-05-02").count() == 1


def test_a_repeated_audit_batch_replaces_itself(spark):
    path = tempfile.mkdtemp(prefix="run-", dir="/tmp") + "/audit"
    t = dt.datetime(2024, 5, 1, 12)
    rows = spark.createDataFrame([(i, "LOGIN", "x", t + dt.timedelta(days=i % 3)) for i in range(9)] + [(9, "LOGIN", "x", None)],
                                 "user_id bigint, action string, details string, timestamp timestamp_ntz")
    for batch in ("a", "b", "a"):
        sinks.audit_append(rows, path, batch=batch)
    got = sinks.audit_read(spark, path)
    assert got.count() == 20 and {r.batch for r in got.collect()} == {"a", "b"}
    day = sinks.audit_read(spark, path, "2024-05-02", "2024-05-02")
    assert sorted(r.user_id for r in day.collect()) == [1, 1, 4, 4, 7, 7]
    assert "PartitionFilters: [isnotnull(event_date" in day._jdf.queryExecution().executedPlan().toString()


def test_rejected_bodies_keep_their_error(spark):
    good = '{"request_id": 1, "customer_id": 3, "items": []}'
    bodies = [good, good[:20], "", None, "[]", '{"customer_id": 3}', '{"request_id": "x"}', "not json"]
    lines = spark.createDataFrame(list(enumerate(bodies)), "n int, value string")
    ok, bad = ingest_checked(lines)
    assert [(r.n, r.request_id, r.delivery_fee) for r in ok.collect()] == [(0, 1, 50.0)]
    form = "not JSON of the expected form"
    got = {r.n: r.error for r in bad.collect()}
    assert {k: v for k, v in got.items() if k != 4} == {1: form, 2: "empty body", 3: "empty body", 5: "no request_id", 6: form, 7: form}
    assert 4 in got and [r.value for r in bad.orderBy("n").collect()] == bodies[1:]


def test_versions_fill_only_absent_columns(spark):
    root = tempfile.mkdtemp(prefix="run-", dir="/tmp") + "/t"
    spark.createDataFrame([(1, 7)], "id int, n int").write.parquet(f"{root}/schema=1")
    spark.createDataFrame([(2, 2 ** 40, None), (3, None, "c")], "id int, n long, s string").write.parquet(f"{root}/schema=2")
    schema = spark.createDataFrame([], "id int, n long, s string").schema
    got = sinks.read_versions(spark, root, schema, {1: {"s": F.lit("old")}})
    assert sorted(map(tuple, got.collect())) == [(1, 7, "old"), (2, 2 ** 40, None), (3, None, "c")]


def test_nested_export_reads_back_equal(spark):
    path = tempfile.mkdtemp(prefix="run-", dir="/tmp") + "/json"
    df = spark.createDataFrame([(1, [(2, 0.1)], dt.datetime(2024, 1, 1, 2, 3, 4, 567)), (2, [], None), (3, None, None)],
                               "id long, items array<struct<a:long,b:double>>, t timestamp_ntz")
    sinks.json_export(df, path)
    assert sorted(map(repr, sinks.json_import(spark, path, df.schema).collect())) == sorted(map(repr, df.collect()))


def test_export_is_packed_and_bounded_by_file(spark, monkeypatch):
    path = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    monkeypatch.setattr(sinks, "EXPORT_ROWS", 400)
    df = spark.range(1000).select("id", F.lit("Confirmed").alias("status"), F.array(F.col("id") * 0.1).alias("items")).coalesce(1)
    sinks.json_export(df, f"{path}/packed")
    sinks.json_export(df, f"{path}/plain", compression="none")
    packed, plain = ([f for f in Path(path, k).iterdir() if f.name.startswith("part-")] for k in ("packed", "plain"))
    assert len(packed) == len(plain) == 3  # 400, 400 and 200 records
    assert all(f.name.endswith(".json.gz") for f in packed)
    assert 4 * sum(f.stat().st_size for f in packed) < sum(f.stat().st_size for f in plain)
    lines = [line for f in packed for line in gzip.open(f, "rt")]
    assert sorted(json.loads(line)["id"] for line in lines) == [*range(1000)]
    assert sorted(map(tuple, sinks.json_import(spark, f"{path}/packed", df.schema).collect())) == sorted(map(tuple, df.collect()))
