"""Session settings and durable intermediate tables."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from collections.abc import Callable, Iterable
from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession

# SQL settings the operators rely on; all can be set on a running session.
SQL_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Split a hot join key even when the result has to be shuffled once more.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # Shuffles start with many small parts, of which AQE joins neighbours to at most its advisory size (64 MB). A task then
    # sorts no more than that, however large the table; the session's own number of parts would let it grow with the table.
    "spark.sql.adaptive.coalescePartitions.initialPartitionNum": "1024",
}

def configure(spark: SparkSession) -> SparkSession:
    """Apply the SQL settings to a session that already runs; cluster sizing stays untouched."""
    for key, value in SQL_SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def local_session(cores: str = "8", memory: str = "8g", app: str = "meterlake") -> SparkSession:
    """A single-machine session for tests and the benchmark."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", cores if cores.isdigit() else "8")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    spark = configure(builder.getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    return spark


SHARED = "meterlake.shared.dir"  # a setting of a running session, for clusters that name no folder


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can reach: `spark.checkpoint.dir` as the cluster names it, else `meterlake.shared.dir`.

    A machine-local folder is taken only where neither is set and Spark runs in one process, as in tests. On a cluster
    that is an error, since every executor would write to its own disk.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get(SHARED, None)
    if named:
        return named
    master = spark.sparkContext.master
    if not re.fullmatch(r"local(\[[^\]]*\])?", master):
        raise RuntimeError(f"{master} names no folder that all executors share: set spark.checkpoint.dir, or {SHARED}")
    return os.path.join(tempfile.gettempdir(), "meterlake")


def cut_lineage(spark: SparkSession) -> None:
    """Make sure that jobs which checkpoint as they go, such as tree fits, have a shared folder to do so."""
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(f"{_scratch_folder(spark)}/checkpoints")


def _scratch_folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark).rstrip('/')}/meterlake-{spark.sparkContext.applicationId}"


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path of its own for one written table."""
    return f"{_scratch_folder(spark)}/{name}-{uuid.uuid4().hex}"


def durable(df: DataFrame) -> DataFrame:
    """Write `df` as Parquet in the shared folder and read it back.

    This cuts the lineage, survives lost executors, and later readers prune columns and push filters. Spark also
    knows the size of a written table: below `spark.sql.autoBroadcastJoinThreshold` a join broadcasts it, above
    it shuffles. A fresh aggregate has no known size, and a join with it may shuffle the large side by a handful
    of hot keys first.
    """
    path = scratch_path(df.sparkSession, "table")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def side_by_side(spark: SparkSession, jobs: Iterable[Callable], at_once: int = 4) -> list:
    """What these jobs return, in their order. They must not need each other: so many run at a time, and the tasks of one take
    the cores that the short jobs of another leave idle."""
    with ThreadPoolExecutor(at_once) as pool:
        return list(pool.map(lambda job: job(), [inheritable_thread_target(spark)(job) for job in jobs]))


def drop_scratch(spark: SparkSession) -> None:
    """Delete the tables this application has written for itself; frames that read them end with it."""
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(_scratch_folder(spark))
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)
