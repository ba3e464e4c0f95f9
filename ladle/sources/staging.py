"""Intermediate tables as Parquet files below the shared folder of ``spark.checkpoint.dir``.

A table that is written and read back has a short lineage, survives lost
executors, and has the size of its files as its size estimate.  (A
``checkpoint()`` keeps the estimate of its plan, which every join multiplies:
in an iteration the numbers grow until planning itself is slow.)
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from ..session import ensure_checkpoint_dir


def scratch(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder; it is removed when the session's file system closes."""
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/ladle-{name}-{uuid.uuid4().hex[:12]}"
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(jpath)
    return path


def staged(df: DataFrame, name: str = "table") -> DataFrame:
    """Write ``df`` and read it back with its schema."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
