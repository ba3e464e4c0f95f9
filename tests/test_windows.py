"""Skew-safe running sum: exact on a hot key with tied timestamps."""

import datetime as dt
import random

from pyspark.sql import functions as F

from ladle.operators.windows import running_sum


def test_running_sum_hot_key(spark):
    rng = random.Random(7)
    t0 = dt.datetime(2024, 1, 1)
    rows = []
    for i in range(6000):
        key = "hot" if i < 4000 else f"k{i % 40}"
        rows.append((key, t0 + dt.timedelta(days=rng.randint(0, 3)), i, rng.randint(-5, 9)))
    df = spark.createDataFrame(rows, "k string, ts timestamp_ntz, id bigint, v bigint")
    out = running_sum(df, ["k"], ["ts", "id"], "v", "before", slices=8)
    got = {r.id: r.before for r in out.collect()}

    want, acc = {}, {}
    for k, ts, i, v in sorted(rows, key=lambda r: (r[0], r[1], r[2])):
        want[i] = acc.get(k, 0)
        acc[k] = acc.get(k, 0) + v
    assert got == want

    # the hot key really is cut into several slices
    sliced = (df.repartitionByRange(8, "k", "ts", "id").withColumn("b", F.spark_partition_id())
              .where(F.col("k") == "hot").select("b").distinct().count())
    assert sliced > 1


def test_running_sum_inclusive_with_day_buckets(spark):
    t0 = dt.datetime(2024, 1, 1)
    rows = [("a", t0 + dt.timedelta(hours=h), h, 1) for h in range(50)]
    df = spark.createDataFrame(rows, "k string, ts timestamp_ntz, id bigint, v bigint")
    out = running_sum(df, ["k"], ["ts", "id"], "v", "upto", inclusive=True, bucket=F.date_trunc("day", "ts"))
    assert {r.id: r.upto for r in out.collect()} == {h: h + 1 for h in range(50)}


def test_running_sum_keeps_null_keys_and_sums_several_values(spark):
    df = spark.createDataFrame([(None, 1, 5), (None, 2, 6), ("a", 3, 7)], "k string, id bigint, v bigint")
    out = running_sum(df, ["k"], ["id"], ["v", F.lit(1)], ["s", "n"], inclusive=True, slices=2)
    assert sorted((r.id, r.s, r.n) for r in out.collect()) == [(1, 5, 1), (2, 11, 2), (3, 7, 1)]


def test_only_a_local_master_gets_a_scratch_folder():
    import pytest

    from ladle.session import ensure_checkpoint_dir

    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()

        class conf:
            get = staticmethod(lambda key, default=None: default)

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        ensure_checkpoint_dir(Session())
