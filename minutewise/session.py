"""Session settings, and where a job may keep shared files."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Settings this library relies on. Safe to apply to any session: all are runtime SQL settings.
SQL_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Sort-based aggregation holds one bucket's sample at a time; start it before many large ones pile up.
    "spark.sql.objectHashAggregate.sortBased.fallbackThreshold": "32",
    "spark.sql.streaming.stateStore.providerClass": (
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    ),
}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the library's SQL settings (time zone, adaptive execution, state store) to an existing session, for all it runs."""
    for key, value in SQL_SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def local_session(cores: int | str = "*", partitions: int = 8, name: str = "minutewise") -> SparkSession:
    """A session for tests and benchmarks on one machine."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "10g")
        .config("spark.sql.shuffle.partitions", str(partitions))
    )
    for key, value in SQL_SETTINGS.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """A new folder every executor can reach: under spark.checkpoint.dir, or where setCheckpointDir points.

    A local folder is made only where neither is set and there are no other machines; on a cluster that is an error.
    """
    context = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not base:
        if not re.match(r"local(\[|$)", context.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        return tempfile.mkdtemp(prefix="minutewise-")
    run = context.applicationId
    stamp = spark._jvm.java.util.UUID.randomUUID().toString()
    return f"{base.rstrip('/')}/minutewise/{run}/{stamp}"


def cut(df: DataFrame) -> DataFrame:
    """Compute df now and keep it in the shared checkpoint folder, so later steps don't repeat it.

    For tables far smaller than the events, such as rollups and rank targets. The files are reliable storage: losing
    executors loses nothing.
    """
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def small(df: DataFrame, rows: int = 100_000) -> DataFrame:
    """A cut frame of short rows, marked for broadcast if it has few; otherwise the join shuffles as Spark decides."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df
