"""Small helpers shared by the training-data operators.

Tables are read through Spark only (inputs may sit in a store that nothing
else can open); intermediate tables are written as Parquet below the shared
folder named in ``spark.checkpoint.dir``, so a lost executor never costs more
than the stage that was running.
"""

from __future__ import annotations

import ctypes
import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir

# Rows of an Arrow batch where the session names none: texts are long, and a batch is held whole on both sides.
BATCH_ROWS = 1000

# White space as the contracts define it: space and U+0009 to U+000D.
WS_CLASS = r"[ \t-\r]"
WORD = r"[^ \t-\r]+"
WS_CHARS = " \t\n\x0b\x0c\r"


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers, once per application (they may not have it on their path).

    Arrow batches get ``BATCH_ROWS`` rows unless the session sets their size.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key, None) is None:
        spark.conf.set(key, str(BATCH_ROWS))
    sc = spark.sparkContext
    if getattr(sc, "_ladle_shipped", False):
        return
    top = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    archive = os.path.join(tempfile.mkdtemp(prefix="ladle-"), "ladle_llm.zip")
    with zipfile.ZipFile(archive, "w") as z:
        for folder, _, names in sorted(os.walk(top)):
            for path in (os.path.join(folder, n) for n in sorted(names) if n.endswith(".py")):
                z.write(path, os.path.join("ladle", os.path.relpath(path, top)))
    sc.addPyFile(archive)
    sc._ladle_shipped = True


def trimmed(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``run`` over a task's batches; at its end the worker, which stays alive, hands back free memory."""
    def task(batches: Iterator) -> Iterator:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim:
            trim(0)

    return task


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    ship(spark)
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back (cuts lineage).

    The folder is removed when the session's file system closes.
    """
    spark = df.sparkSession
    ship(spark)
    path = f"{ensure_checkpoint_dir(spark)}/llm-{name}-{uuid.uuid4().hex[:12]}"
    df.write.parquet(path)
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(jpath)
    out = spark.read.schema(df.schema).parquet(path)
    out._staged_path = path
    return out


def unstage(*tables: DataFrame) -> None:
    """Delete staged tables that no later plan reads."""
    for df in tables:
        path = getattr(df, "_staged_path", None)
        if path:
            jpath = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            jpath.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(jpath, True)


def words(text: Column) -> Column:
    """Words of a text as an array; a null or blank text has none.

    Splitting at a literal space is several times as fast as at a pattern, so
    the pattern is left to texts with white space other than space and newline.
    """
    text = F.coalesce(text, F.lit(""))
    rare = F.contains(text, F.lit("\t")) | F.contains(text, F.lit("\r")) | F.contains(text, F.lit("\x0b")) \
        | F.contains(text, F.lit("\x0c"))
    plain = F.split(F.replace(text, F.lit("\n"), F.lit(" ")), " ")
    return F.array_remove(F.when(rare, F.split(text, WS_CLASS + "+")).otherwise(plain), "")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def fits_broadcast(small: DataFrame, row_bytes: int, limit_bytes: int = 8 << 20) -> bool:
    """Whether a staged table is proven small enough to broadcast: its rows are counted."""
    return small.count() * row_bytes <= limit_bytes
