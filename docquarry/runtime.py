"""What every operator needs from its session: shipped code, reliable checkpoints, bounded broadcasts."""

from __future__ import annotations

import ctypes
import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows up to which a checked, already aggregated table is broadcast; larger ones are joined by a shuffle.
BROADCAST_ROWS = 100_000
#: Rows and bytes in an Arrow batch at most: some texts are long, and a batch is held whole by a Python worker.
BATCH_ROWS, BATCH_BYTES = 2000, 8 << 20
_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Gives the executors this package, once per application, so that Arrow functions can be unpickled anywhere."""
    rows = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(rows)) <= BATCH_ROWS:
        spark.conf.set(rows, str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", f"{BATCH_BYTES}b")
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="docquarry")) / "docquarry_code.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    spark.sparkContext.addPyFile(str(archive))
    _shipped.add(app)


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which driver and executors share; local sessions that set none get one."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = sc.getConf().get("spark.checkpoint.dir")
        if folder is None:
            if not sc.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            folder = os.path.join(tempfile.gettempdir(), "checkpoints", "docquarry")
        sc.setCheckpointDir(folder)
    return sc.getCheckpointDir()


def checkpointed(df: DataFrame) -> DataFrame:
    """Cuts the lineage with a reliable checkpoint."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame) -> tuple[DataFrame, str]:
    """Cuts the lineage with a Parquet table in the shared folder, smaller than a checkpoint for wide rows; the table, read again, and its path."""
    path = f"{shared_folder(df.sparkSession)}/{uuid.uuid4().hex}.parquet"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def materialised(df: DataFrame) -> DataFrame:
    """stored() where the table may stay."""
    return stored(df)[0]


def removed(spark: SparkSession, path: str) -> None:
    """Deletes a table that stored() wrote, once nothing reads it any more."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def released(spark: SparkSession) -> None:
    """Lets shuffle files go that no plan needs any more: Spark's cleaner drops them only once the driver's JVM has collected their plans."""
    spark._jvm.System.gc()


def tidied(rows: Iterator) -> Iterator:
    """rows of a Python task; what it freed goes back to the system after them. The allocators of a worker keep it otherwise, through the stages that follow."""
    try:
        yield from rows
    finally:
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc's
        if trim:
            trim(0)


def spread(df: DataFrame) -> DataFrame:
    """df in as many partitions as there are cores, where it has fewer: a small file in one piece would keep one core busy."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def join_small(big: DataFrame, small: DataFrame, on, how: str = "inner") -> DataFrame:
    """Joins a checkpointed small side: broadcast if its row count is within BROADCAST_ROWS, else by a shuffle."""
    if small.count() <= BROADCAST_ROWS:
        small = F.broadcast(small)
    return big.join(small, on, how)
