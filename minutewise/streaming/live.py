"""The live feed: every batch re-publishes the full, exact rollup of each bucket it touched."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.messages import envelope, metric_point
from ..functions.scalar import is_error
from ..operators.rollup import rollup_values
from ..params import Params
from ..schemas import SERIES, VALUE_COUNT
from .ingest import EVERY_5_SECONDS
from .state import OpenBucket

# Batches can't overlap in sequence while one series has fewer touched buckets than this.
SEQUENCE_STEP = 2**32


def with_sequence(points: DataFrame, batch_id: int) -> DataFrame:
    """A number that rises per series over batches and restarts; the same again if a batch is replayed."""
    nth = F.row_number().over(W.partitionBy(*SERIES).orderBy("minute_bucket"))
    return points.withColumn("sequence", F.lit(batch_id) * F.lit(SEQUENCE_STEP) + nth)


_KEY = ["bucket", *SERIES, "part"]
_COUNTED = "bucket long, service string, endpoint string, part int, latency_ms double, n long, errors long"


def _counted(parts: int):
    """Value counts of the events of one Arrow batch, and a row with n = 0 for each part of every bucket in it."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.schema(
            [("bucket", pa.int64()), ("service", pa.string()), ("endpoint", pa.string()), ("part", pa.int32()), ("latency_ms", pa.float64()), ("n", pa.int64()), ("errors", pa.int64())]
        )
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            sums = rows.group_by([*_KEY, "latency_ms"]).aggregate([("errors", "count"), ("errors", "sum")])
            yield from sums.rename_columns([*_KEY, "latency_ms", "n", "errors"]).select(kind.names).cast(kind).to_batches()
            touched = rows.group_by(["bucket", *SERIES]).aggregate([])
            for part in range(parts if parts > 1 else 0):
                size = touched.num_rows
                asks = {"part": [part] * size, "latency_ms": [0.0] * size, "n": [0] * size, "errors": [0] * size}
                yield from pa.table([*(touched[c] for c in ("bucket", *SERIES)), *asks.values()], names=["bucket", *SERIES, *asks]).cast(kind).to_batches()

    return count


def open_values(events: DataFrame, params: Params = Params(), dedupe: bool = False) -> DataFrame:
    """VALUE_COUNT rows: all values of every bucket that a batch of events touches, as a stream.

    The values of open buckets are keyed state, a bucket's dealt to live_parts keys by their hash, so that a busy bucket
    spreads over tasks; every part of a touched bucket is asked. Events are counted by value before the shuffle. The
    same rules hold as for closed buckets: an event whose bucket ended before the watermark is dropped, and with dedupe a
    repeated event_id within the watermark counts once.
    """
    rows = events.withWatermark("ts", f"{params.watermark_seconds} seconds")
    if dedupe:
        rows = rows.dropDuplicatesWithinWatermark(["event_id"])
    value = F.col("latency_ms").cast("double")
    placed = rows.select(
        F.unix_micros(F.window("ts", f"{params.window_seconds} seconds")["start"]).alias("bucket"),
        *SERIES,
        F.pmod(F.xxhash64(value), F.lit(params.live_parts)).cast("int").alias("part"),
        value.alias("latency_ms"),
        is_error("status_code").cast("long").alias("errors"),
    )
    counted = placed.mapInArrow(_counted(params.live_parts), _COUNTED)
    held = counted.groupBy(*_KEY).transformWithStateInPandas(OpenBucket(params.window_seconds), OpenBucket.OUTPUT, "Append", "EventTime")
    return held.withColumn("minute_bucket", F.timestamp_micros("bucket")).select(*VALUE_COUNT.fieldNames())


def start_live(events: DataFrame, feed_path: str, checkpoint: str, params: Params = Params(), trigger: dict | None = None,
               dedupe: bool = False) -> StreamingQuery:
    """Publish metric_point messages as JSON lines, one directory per batch, from the state of open_values."""

    def publish(values: DataFrame, batch_id: int) -> None:
        values.persist()
        messages = with_sequence(rollup_values(values, params), batch_id).select(envelope(metric_point()).alias("value"))
        messages.write.mode("overwrite").text(f"{feed_path}/batch_id={batch_id}")
        values.unpersist()

    return (
        open_values(events, params, dedupe)
        .writeStream.queryName("live")
        .outputMode("append")
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or EVERY_5_SECONDS))
        .foreachBatch(publish)
        .start()
    )
