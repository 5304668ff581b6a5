"""Session helpers: lineage cutting that survives executor loss."""

from __future__ import annotations

import gc
import tempfile
import time

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Rows of a small input over all cores, where its files give fewer tasks than the cluster can run; a large input stays as it is.

    Filters and pruned columns still reach the scan, so only what is read moves."""
    tasks = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(tasks) if df.rdd.getNumPartitions() < tasks else df


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Uses the cluster's shared folder from ``spark.checkpoint.dir``; a local folder only where that is unset (tests)."""
    sc = spark.sparkContext
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        if sc._jsc.sc().getCheckpointDir().isEmpty():
            sc.setCheckpointDir(shared)
    elif sc._jsc.sc().getCheckpointDir().isEmpty():
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="colophon-"))


def cut(df: DataFrame, eager: bool = True) -> DataFrame:
    """Reliable checkpoint: written once to shared storage, so later stages never recompute it."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager)


def release(df: DataFrame) -> None:
    """Removes the files of a checkpoint that nothing reads any more; where there is none, nothing happens."""
    from py4j.protocol import Py4JError

    try:
        at = df._jdf.queryExecution().logical().rdd().getCheckpointFile()
        if at.isDefined():
            path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(at.get())
            path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)
    except Py4JError:  # not a checkpoint
        return


def sweep(spark: SparkSession) -> None:
    """Lets Spark remove the shuffle files that only a stage before a ``cut`` has read: it does so when the driver collects its garbage,
    which on a large heap may be never. Twice, because what Python held is let go after the first time only."""
    for _ in range(2):
        gc.collect()
        spark._jvm.System.gc()
        time.sleep(0.2)
