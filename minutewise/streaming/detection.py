"""Detection on closed buckets as they are written, then alerts: apart from the metrics query, so a fault
here never holds the metrics up."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.messages import alert, anomaly, as_json, envelope
from ..operators.detect import detect
from ..operators.history import latest_rows
from ..params import Params
from ..schemas import ANOMALY, METRIC, OUTBOX, SERIES
from ..sources.events import FILES_PER_BATCH
from ..sources.tables import ensure_table, read_batches, write_batch
from .ingest import EVERY_5_SECONDS
from .state import SeriesTail


def alert_outbox(anomalies: DataFrame) -> DataFrame:
    """id and payload of each finding, for whatever delivers alerts."""
    return anomalies.select("id", as_json(alert()).alias("payload"))


def anomaly_messages(anomalies: DataFrame) -> DataFrame:
    return anomalies.select(envelope(anomaly()).alias("value"))


def with_history(closed: DataFrame, params: Params = Params(), history: DataFrame | None = None) -> DataFrame:
    """METRIC rows and `fresh`: the new buckets of a stream of metrics, each series' with the last ones before them.

    A series' last buckets are keyed state of its own, so a batch reads and writes the series that it brings and no other.
    `history` (for instance a backfill) is the state to begin with.
    """
    n = params.longest_history

    def keyed(metrics: DataFrame) -> DataFrame:
        rest = [c for c in METRIC.fieldNames() if c != "minute_bucket"]
        return metrics.select(F.unix_micros("minute_bucket").alias("bucket"), *rest)

    past = None if history is None else keyed(latest_rows(history.select(*METRIC.fieldNames()), n)).groupBy(*SERIES)
    told = keyed(closed.withWatermark("minute_bucket", "0 seconds")).groupBy(*SERIES).transformWithStateInPandas(
        SeriesTail(n, params.series_ttl_seconds), SeriesTail.OUTPUT, "Append", "EventTime", past
    )
    return told.withColumn("minute_bucket", F.timestamp_micros("bucket")).select(*METRIC.fieldNames(), "fresh")


def start_detection(spark: SparkSession, metrics_path: str, anomalies_path: str, checkpoint: str, params: Params = Params(),
                    history: DataFrame | None = None, outbox_path: str | None = None, feed_path: str | None = None,
                    trigger: dict | None = None, max_files: int = FILES_PER_BATCH) -> StreamingQuery:
    """Follow the closed-bucket table and write ANOMALY rows, one directory per batch.

    The detectors see the new buckets with the history of with_history; the metrics table is never scanned. A replayed
    batch finds the state that it found before. Alerts and feed messages are made from the stored findings, after they are
    stored; each is off unless given a path.
    """

    def process(batch: DataFrame, batch_id: int) -> None:
        session = batch.sparkSession
        batch.persist()
        fresh, past = batch.where("fresh").drop("fresh"), batch.where("NOT fresh").drop("fresh")
        write_batch(detect(fresh, params, earlier=past), anomalies_path, batch_id)
        if outbox_path or feed_path:
            stored = read_batches(session, anomalies_path, ANOMALY, batch_id=batch_id)
            if outbox_path:
                write_batch(alert_outbox(stored), outbox_path, batch_id)
            if feed_path:
                anomaly_messages(stored).write.mode("overwrite").text(f"{feed_path}/batch_id={batch_id}")
        batch.unpersist()

    ensure_table(spark, metrics_path, METRIC)
    reader = spark.readStream.schema(METRIC).option("ignoreMissingFiles", "true").option("maxFilesPerTrigger", max_files)
    return (
        with_history(reader.parquet(metrics_path), params, history)
        .writeStream.queryName("detection")
        .outputMode("append")
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or EVERY_5_SECONDS))
        .foreachBatch(process)
        .start()
    )


def read_outbox(spark: SparkSession, path: str) -> DataFrame:
    return read_batches(spark, path, OUTBOX)
