"""Files as the result table of an update-mode stream.

Every micro-batch writes its changed rows, and only those, to
``<root>/epoch=<batch>/<partition>.parquet`` from the executors.  A repeated
batch or task writes the same names again.  The reader takes, per key, the
row of the newest committed batch; nothing passes the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.sinks import numbers


def _epoch_files(root: str):
    """Writes the rows of a partition as they come, by columns; none leave.  The function is local so that it travels by
    value: workers need not have this package."""
    def write(batches):
        import posixpath
        import re
        import uuid

        import pyarrow as pa
        import pyarrow.parquet as pq
        from pyarrow import fs
        from pyspark import TaskContext
        task, file = TaskContext.get(), None
        for batch in batches:
            if not batch.num_rows:
                continue
            if file is None:
                store, top = fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", root))
                folder = posixpath.join(top, f"epoch={task.getLocalProperty('streaming.sql.batchId')}")
                store.create_dir(folder)
                part = posixpath.join(folder, f"_{uuid.uuid4().hex}")  # hidden until it is whole
                file = pq.ParquetWriter(part, batch.schema, filesystem=store)
            file.write_batch(batch)
        if file is not None:
            file.close()
            store.move(part, posixpath.join(folder, f"{task.partitionId():05d}.parquet"))
        return iter(())

    return write


def run_updates(changes: DataFrame, root: str) -> DataFrame:
    """Process all available input of a streaming aggregation in update mode; returns :func:`newest` of its rows.

    The last operator writes the files, so the sink gets no rows."""
    spark, schema = changes.sparkSession, changes.schema
    q = (changes.mapInArrow(_epoch_files(f"{root}/rows"), schema).writeStream.format("noop").outputMode("update")
         .option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start())
    q.awaitTermination()
    if q.exception() is not None:
        raise RuntimeError(str(q.exception()))
    return all_versions(spark, root, schema)


def all_versions(spark: SparkSession, root: str, schema: T.StructType) -> DataFrame:
    """Every row written by a committed batch, with its ``epoch``."""
    committed = max(numbers(spark, f"{root}/checkpoint/commits"), default=-1)
    with_epoch = T.StructType([*schema.fields, T.StructField("epoch", T.LongType())])
    if not numbers(spark, f"{root}/rows", "epoch="):
        return spark.createDataFrame([], with_epoch)
    return spark.read.schema(with_epoch).parquet(f"{root}/rows").where(F.col("epoch") <= committed)


def newest(versions: DataFrame, *keys: str) -> DataFrame:
    """Per key the row of the newest batch (combined before the shuffle)."""
    rest = [c for c in versions.columns if c not in (*keys, "epoch")]
    return versions.groupBy(*keys).agg(F.max_by(F.struct(*rest), "epoch").alias("r")).select(*keys, "r.*")
