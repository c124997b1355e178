"""Where intermediate tables go, and how large inputs are."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch(spark: SparkSession, name: str) -> str:
    """A new path below spark.checkpoint.dir, which driver and executors share.

    Without that setting, a local session gets a folder that goes with the process. A cluster
    takes its warehouse, if that isn't a folder of each machine; else there is no shared place.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    master = spark.sparkContext.master
    if not base and (master == "local" or master.startswith("local[")):
        base = tempfile.mkdtemp(prefix="shalebed-")
        atexit.register(shutil.rmtree, base, ignore_errors=True)
    if not base:
        base = spark.conf.get("spark.sql.warehouse.dir")
        if base.startswith("file:") or "://" not in base:
            raise RuntimeError("a cluster needs spark.checkpoint.dir, a folder that driver and executors share")
    return f"{base.rstrip('/')}/shalebed/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex[:12]}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """The frame, written to the shared folder and read again: a cut of the lineage that survives lost executors."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def input_bytes(df: DataFrame) -> int:
    """Catalyst's estimate of the size of a frame that is read from files; 0 where it has none."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return size if size < 1 << 60 else 0


def partitions_for(df: DataFrame, bytes_each: int = 32 << 20) -> int:
    """Shuffle partitions: the session's number, more if a partition would take more than ``bytes_each`` of input."""
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-input_bytes(df) // bytes_each))
