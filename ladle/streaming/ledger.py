"""Exactly-once settlement of requests that arrive as files.

A Structured Streaming query takes every new file of the inbox once and keeps
its rows under the file's name, the batch.  Batches are settled one after the
other, in the order of their names, each against the state that the last
committed batch left behind: promo uses, loyalty balances and stock.

What a batch writes (decisions, order lines, state) goes to a folder of its
own.  It counts once the marker ``_committed/<k>`` exists, for the k-th batch
of the ledger; the marker names folder and batch.  A run that dies before the
marker leaves a folder that nothing reads, and the next run settles the batch
anew from the same state; a batch with a marker is never settled again; of two
runs that settle at once, the second fails to create the marker.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import settlement as S
from ..sources import sinks
from ..sources.requests import REQUEST_SCHEMA


@dataclass
class Start:
    """The tables that the first batch starts from."""

    promo_codes: DataFrame
    loyalty_points: DataFrame
    produce_items: DataFrame


def receive(spark: SparkSession, inbox: str, root: str) -> DataFrame:
    """Take the files that arrived since the last call; all requests so far, with their ``batch``."""
    kept = f"{root}/requests"
    arrived = spark.readStream.schema(REQUEST_SCHEMA).parquet(inbox).select("*", F.col("_metadata.file_name").alias("batch"))
    sinks.run_to_files(arrived, kept, f"{root}/receive", partition_by="batch")
    return spark.read.schema(T.StructType([*REQUEST_SCHEMA.fields, T.StructField("batch", T.StringType())])).parquet(kept)


def settle_arrivals(spark: SparkSession, inbox: str, root: str, menu_items: DataFrame, start: Start, ui_adds_fee: bool = False,
                    after_write: Callable[[str], None] | None = None) -> DataFrame:
    """Settle every batch that has no marker, then return :func:`ledger`.  ``after_write(batch)`` is called between a
    batch's write and its marker (tests let a run die there)."""
    requests = receive(spark, inbox, root)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))  # one task reads a file, so a batch is dealt anew
    done = sinks.commits(spark, root)
    settled = {c.note for c in done}
    arrived = sorted(r.batch for r in requests.select("batch").distinct().collect())  # one name per arrived file
    for batch in arrived:
        if batch in settled:
            continue
        if done:
            last = f"{root}/v={done[-1].version}"
            state = Start(*[spark.read.parquet(f"{last}/{t}") for t in ("promo_codes", "loyalty_points", "produce_items")])
        else:
            state = start
        s = S.settle(requests.where(F.col("batch") == batch).drop("batch").repartition(parts, "request_id"), menu_items, state.produce_items, state.promo_codes,
                     state.loyalty_points, ui_adds_fee=ui_adds_fee)
        promos, loyalty, produce = S.carried(s, state.promo_codes, state.loyalty_points, state.produce_items)
        number = len(done) + 1
        version = sinks.write_version({
            "decisions": s.decisions.withColumn("batch", F.lit(number).cast("bigint")),
            "lines": s.accepted_lines.withColumn("batch", F.lit(number).cast("bigint")),
            "promo_codes": promos, "loyalty_points": loyalty, "produce_items": produce}, spark, root)
        if after_write:
            after_write(batch)
        done = [*done, sinks.commit(spark, root, number, version, batch)]
    return ledger(spark, root)


def ledger(spark: SparkSession, root: str, table: str = "decisions") -> DataFrame:
    """The rows of all committed batches: ``decisions`` or ``lines``."""
    paths = [f"{root}/v={c.version}/{table}" for c in sinks.commits(spark, root)]
    if not paths:
        raise FileNotFoundError(f"no committed batch under {root}")
    return spark.read.parquet(*paths)


def state(spark: SparkSession, root: str, table: str) -> DataFrame:
    """``promo_codes``, ``loyalty_points`` or ``produce_items`` after the last committed batch."""
    return spark.read.parquet(f"{root}/v={sinks.commits(spark, root)[-1].version}/{table}")
