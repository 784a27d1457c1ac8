"""Tables written to the folder that driver and executors share."""

from __future__ import annotations

import atexit
import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_written: dict[str, SparkSession] = {}


def _one_process(spark: SparkSession) -> bool:
    master = spark.sparkContext.master
    return master.startswith("local") and not master.startswith("local-cluster")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see: spark.checkpoint.dir, or our own where that is unset and all runs in one process."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not _one_process(spark):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="fernpath-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def stash(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back: lineage ends there and lost executors cost nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/stash/{name}-{uuid.uuid4().hex}"
    schema = df.schema
    df.write.option("compression", "zstd").parquet(path)
    if not _written:
        atexit.register(_forget)
    _written[path] = spark
    del df
    tidy(spark)
    found = spark.read.schema(schema).parquet(path)
    found._stashed_at = path
    return found


def tidy(spark: SparkSession) -> None:
    """Let Spark remove shuffle files that no plan needs any more; where all runs in one process they are left to their own time."""
    if not _one_process(spark):
        gc.collect()
        spark.sparkContext._jvm.System.gc()


def remove(spark: SparkSession, path: str) -> None:
    """Delete a file or folder of any file system that Spark reads."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def release(*tables: DataFrame) -> None:
    """Remove written tables that no plan still to run reads."""
    for df in tables:
        remove(_written.pop(df._stashed_at), df._stashed_at)


def _forget() -> None:
    """Remove the written tables when the driver ends; if its JVM is gone already they stay for the cluster's clean-up."""
    for path, spark in _written.items():
        try:
            remove(spark, path)
        except Exception:  # noqa: BLE001
            return
