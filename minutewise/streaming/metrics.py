"""Closed buckets: streaming state per value, exact percentiles once the watermark has passed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.scalar import is_error
from ..operators.rollup import rollup_values
from ..params import Params
from ..schemas import SERIES, VALUE_COUNT
from ..sources.tables import write_batch
from .ingest import EVERY_5_SECONDS


def closed_values(events: DataFrame, params: Params = Params(), dedupe: bool = False) -> DataFrame:
    """VALUE_COUNT rows of each bucket, emitted once, when no more events of it are expected.

    The state holds a count per bucket and latency value rather than a sample per bucket: a batch rewrites
    only the values it brings, and a busy series spreads over all state partitions. All rows of a bucket
    come out in the same batch. With dedupe, repeated event_ids within the watermark are dropped.
    """
    rows = events.withWatermark("ts", f"{params.watermark_seconds} seconds")
    if dedupe:
        rows = rows.dropDuplicatesWithinWatermark(["event_id"])
    window = F.window("ts", f"{params.window_seconds} seconds")
    counted = rows.groupBy(window, *SERIES, "latency_ms").agg(
        # A count and a sum, as the state names its columns after the functions.
        F.count("*").alias("n"), F.sum(is_error("status_code").cast("bigint")).alias("errors")
    )
    return counted.withColumn("minute_bucket", F.col("window.start")).select(*VALUE_COUNT.fieldNames())


def start_metrics(events: DataFrame, path: str, checkpoint: str, params: Params = Params(), dedupe: bool = False,
                  trigger: dict | None = None) -> StreamingQuery:
    """Write METRIC rows of closed buckets, one directory per batch."""

    def write(values: DataFrame, batch_id: int) -> None:
        values.persist()
        # A series' buckets of a batch share a file, so a reader that follows the files sees them in order.
        metrics = rollup_values(values, params).repartition(*SERIES).sortWithinPartitions(*SERIES, "minute_bucket")
        write_batch(metrics, path, batch_id)
        values.unpersist()

    return (
        closed_values(events, params, dedupe)
        .writeStream.queryName("metrics")
        .outputMode("append")
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or EVERY_5_SECONDS))
        .foreachBatch(write)
        .start()
    )
