"""Tables that jobs write to cut lineage, in the folder that the cluster names."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from functools import cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Written tables of at most so many bytes of files are broadcast.
BROADCAST_BYTES = 32 << 20
#: Bytes of rows that a Python worker gets at once, and Spark's setting for them.
BATCH_BYTES = 4 << 20
BATCHES = "spark.sql.execution.arrow.maxBytesPerBatch"
#: Spark's setting under which a query's shuffle files go when it ends, not when the driver happens to collect its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@cache
def _local_folder() -> str:
    return "file://" + tempfile.mkdtemp(prefix="panelspan-")


def folder(spark: SparkSession) -> str:
    """A new folder below ``spark.checkpoint.dir``, which driver and executors share.

    Only where that setting is missing and the session runs on one machine (tests, a notebook) a local folder is used.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = _local_folder()
    return f"{root.rstrip('/')}/panelspan-{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """``df``, written as Parquet and read again: later steps don't compute it anew, even when executors are lost."""
    spark = df.sparkSession
    path = folder(spark)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def drop(*tables: DataFrame) -> None:
    """Deletes tables as ``written`` returned them, once what reads them is written itself."""
    for table in tables:
        path = table.sparkSession._jvm.org.apache.hadoop.fs.Path(table.written_to)
        path.getFileSystem(table.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


@contextmanager
def tidy(spark: SparkSession) -> Iterator[None]:
    """Inside, the shuffle files of a query go when it ends: for steps that write their tables, whose shuffles nothing reads again."""
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEANUP, before)


def modest_batches(spark: SparkSession) -> None:
    """From now on in this session Python workers get BATCH_BYTES of rows at once, whatever the length of a row: executor and worker both hold
    each batch, outside the heap, and keep such memory for later. Tables are read when they are written or shown, so the setting stays."""
    spark.conf.set(BATCHES, str(BATCH_BYTES))


def small(table: DataFrame) -> DataFrame:
    """A written table, marked for broadcast if its files have at most BROADCAST_BYTES; else joins shuffle."""
    size = table._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    return F.broadcast(table) if int(str(size)) <= BROADCAST_BYTES else table
