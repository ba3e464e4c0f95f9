"""Sinks: immutable snapshots for table updates, partitioned append for the
audit log, JSON export (A4, A5, H3).

No table format is available, so an update never overwrites the path it
reads: each version of a table is a new directory ``<root>/v=<n>``, live
once an empty file ``<root>/_committed/<n>`` exists; the newest committed
version counts.  A failed write leaves the previous version live.
"""

from __future__ import annotations

import uuid
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

MARKERS = "_committed"


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def numbers(spark: SparkSession, path: str, prefix: str = "") -> list[int]:
    """The n of every ``<prefix><n>`` in a folder; none if there is no such folder."""
    fs, p = _fs(spark, path)
    if not fs.exists(p):
        return []
    names = [f.getPath().getName() for f in fs.listStatus(p)]
    return [int(n[len(prefix):]) for n in names if n.startswith(prefix) and n[len(prefix):].isdigit()]


def current_version(spark: SparkSession, root: str) -> int | None:
    return max(numbers(spark, f"{root.rstrip('/')}/{MARKERS}"), default=None)


def read_snapshot(spark: SparkSession, root: str) -> DataFrame:
    v = current_version(spark, root)
    if v is None:
        raise FileNotFoundError(f"no snapshot under {root}")
    return spark.read.parquet(f"{root.rstrip('/')}/v={v}")


def write_snapshot(df: DataFrame, root: str) -> int:
    """Write ``df`` as the next version and commit it.

    The number is above every version ever begun, so a write that died before
    its commit is passed over; of two writers that pick the same number, the
    second fails.
    """
    spark, root = df.sparkSession, root.rstrip("/")
    v = max(numbers(spark, root, "v="), default=0) + 1
    df.write.mode("errorifexists").parquet(f"{root}/v={v}")
    fs, p = _fs(spark, f"{root}/{MARKERS}/{v}")
    fs.create(p, False).close()
    return v


class Commit(NamedTuple):
    """One line of a ledger: the k-th commit, the folder it made live, and what it stands for."""

    number: int
    version: int
    note: str


def write_version(tables: dict[str, DataFrame], spark: SparkSession, root: str) -> int:
    """Write several tables that belong together as ``<root>/v=<n>/<name>``; nothing reads them before :func:`commit`."""
    v = max(numbers(spark, root, "v="), default=0) + 1
    for name, df in tables.items():
        df.write.mode("errorifexists").parquet(f"{root}/v={v}/{name}")
    return v


def commit(spark: SparkSession, root: str, number: int, version: int, note: str) -> Commit:
    """Make ``version`` the ``number``-th commit.  The marker is created once; a second writer of it fails."""
    fs, p = _fs(spark, f"{root}/{MARKERS}/{number}")
    out = fs.create(p, False)
    out.write(bytearray(f"{number} {version} {note}".encode()))
    out.close()
    return Commit(number, version, note)


def commits(spark: SparkSession, root: str) -> list[Commit]:
    """All commits in order (one small file each)."""
    if not numbers(spark, f"{root}/{MARKERS}"):
        return []
    lines = spark.read.schema("value string").text(f"{root}/{MARKERS}").collect()
    found = [r.value.split(" ", 2) for r in lines if r.value]
    return sorted(Commit(int(k), int(v), note) for k, v, note in found)


def run_to_files(stream: DataFrame, path: str, checkpoint: str, partition_by: str | None = None) -> None:
    """Append everything a stream has available to Parquet files (each row once, by the sink's own log)."""
    w = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
    q = (w.partitionBy(partition_by) if partition_by else w).trigger(availableNow=True).start()
    q.awaitTermination()
    if q.exception() is not None:
        raise RuntimeError(str(q.exception()))


AUDIT = "user_id long, action string, details string, timestamp timestamp_ntz, event_date date, batch string"


def audit_append(rows: DataFrame, path: str, batch: str | None = None) -> None:
    """Append audit rows (A5) under ``event_date=<day>/batch=<id>``.

    A repeated batch replaces its own files and no others, so an append may be
    retried; without an id the append is a batch of its own.  The write is its own job: a failure here never undoes the write
    it describes.  Rows without a time share the default partition."""
    (rows.withColumns({"event_date": F.to_date("timestamp"), "batch": F.lit(batch or uuid.uuid4().hex)})
     .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("event_date", "batch").parquet(path))


def audit_read(spark: SparkSession, path: str, first: str | None = None, last: str | None = None) -> DataFrame:
    """Audit rows of the days ``first`` to ``last`` (both included, None: open); other days' files are not read."""
    rows = spark.read.schema(AUDIT).parquet(path)
    if first is not None:
        rows = rows.where(F.col("event_date") >= F.lit(first).cast("date"))
    if last is not None:
        rows = rows.where(F.col("event_date") <= F.lit(last).cast("date"))
    return rows


# Times with all their digits: the writer's default drops fractions of a second.
TIMES = {"timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS", "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"}


EXPORT_ROWS = 1_000_000


def json_export(df: DataFrame, path: str, compression: str = "gzip") -> None:
    """Rows as JSON records, nested arrays kept (A4).

    The field names and digits of every record make plain files many times as
    large as the rows, so they are packed; ``compression="none"`` writes plain
    ones.  One task reads a packed file, so a file has at most ``EXPORT_ROWS`` records."""
    (df.write.mode("errorifexists").option("compression", compression).option("maxRecordsPerFile", EXPORT_ROWS)
     .options(**TIMES).json(path))


def json_import(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Exported records, with the schema they were written from; a broken record fails the read."""
    return spark.read.schema(schema).options(mode="FAILFAST", **TIMES).json(path)


def read_versions(spark: SparkSession, root: str, schema: T.StructType, defaults: dict[int, dict[str, Column]]) -> DataFrame:
    """A table whose files were written under several schema versions, ``<root>/schema=<n>/``.

    Columns that a version lacks are filled from ``defaults[n]`` (NULL without one); numbers that a version stored in
    a shorter type are widened by the scan.  A stored NULL of a column that the version had stays NULL."""
    versioned = T.StructType([*schema.fields, T.StructField("schema", T.IntegerType())])
    rows = spark.read.schema(versioned).parquet(root)
    cols = []
    for f in schema.fields:
        value = F.col(f.name)
        for n, given in defaults.items():
            if f.name in given:
                value = F.when(F.col("schema") == n, given[f.name].cast(f.dataType)).otherwise(value)
        cols.append(value.alias(f.name))
    return rows.select(*cols)
