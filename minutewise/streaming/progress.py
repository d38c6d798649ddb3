"""Backlog and liveness of running queries, as tables made from Spark's own progress reports."""

from __future__ import annotations

import json
import logging
from collections.abc import Iterable
from threading import Event, Lock

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from ..functions.messages import envelope, lag
from ..functions.scalar import backlog_class
from ..schemas import PROGRESS
from ..sources.log import Log, Offset

_REPORT = (
    "name string, timestamp timestamp, batchId bigint, numInputRows bigint, inputRowsPerSecond double, "
    "processedRowsPerSecond double, "
    "stateOperators array<struct<numRowsTotal: bigint, numRowsDroppedByWatermark: bigint>>, "
    "sources array<struct<metrics: map<string, string>>>, "
    "observedMetrics struct<arrived: struct<bytes: bigint>, judged: struct<accepted: bigint, rejected: bigint>>"
)


class ProgressLog(StreamingQueryListener):
    """Appends every progress report of the session's queries to a table of JSON lines, `every` reports a file.

    Spark itself keeps the last hundred reports of a query only. What is held back is written when a query
    ends, or by flush().
    """

    def __init__(self, spark: SparkSession, path: str, every: int = 20):
        self._spark, self._path, self._every = spark, path, every
        self._held: list[str] = []
        self._ended: dict[str, Event] = {}
        self._lock = Lock()

    def onQueryStarted(self, event) -> None:  # noqa: N802
        pass

    def onQueryIdle(self, event) -> None:  # noqa: N802
        pass

    def onQueryProgress(self, event) -> None:  # noqa: N802
        with self._lock:
            self._held.append(event.progress.json)
        if len(self._held) >= self._every:
            self.flush()

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        self.flush()
        self._end(str(event.runId)).set()

    def settle(self, run_id: str, seconds: float = 60.0) -> None:
        """Wait until all reports of a query that has ended are in; they arrive a little later than its end."""
        if not self._end(str(run_id)).wait(seconds):
            raise TimeoutError(f"no end of query run {run_id} was reported")

    def _end(self, run_id: str) -> Event:
        with self._lock:
            return self._ended.setdefault(run_id, Event())

    def flush(self) -> None:
        with self._lock:
            if self._held:
                lines = self._spark.createDataFrame([(" ".join(x.split()),) for x in self._held], "value string")
                lines.coalesce(1).write.mode("append").text(self._path)
                self._held = []

    def read(self) -> DataFrame:
        """PROGRESS rows of all reports so far, of earlier runs too."""
        self.flush()
        try:
            lines = self._spark.read.text(self._path)
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            lines = self._spark.createDataFrame([], "value string")
        return parse_progress(lines)


class LagFeed(ProgressLog):
    """A log of reports that also publishes a lag message to the live feed after every poll of one query of an append log.

    stream_length counts the rows of the log, lag those behind the reported batch, and pending_count how many of these
    are in a batch that runs by now. A message that can't be published is left out: the query goes on.
    """

    def __init__(self, spark: SparkSession, path: str, log_path: str, group: str, feed_path: str, query: str = "ingest", every: int = 20):
        super().__init__(spark, path, every)
        self._log, self._group, self._feed, self._query = Log(log_path), group, feed_path, query
        self._followed: dict[str, Offset] = {}

    def onQueryStarted(self, event) -> None:  # noqa: N802
        if event.name == self._query:
            self._followed[str(event.runId)] = self._log.position(self._group)[1]

    def onQueryProgress(self, event) -> None:  # noqa: N802
        super().onQueryProgress(event)
        run = str(event.progress.runId)
        if run in self._followed:
            self._followed[run] = Offset(**json.loads(event.progress.sources[0].endOffset))
            self._publish(self._followed[run])

    def onQueryIdle(self, event) -> None:  # noqa: N802
        if str(event.runId) in self._followed:
            self._publish(self._followed[str(event.runId)])

    def _publish(self, end: Offset) -> None:
        try:
            newest, (handed, _) = self._log.after(Offset(), None), self._log.position(self._group)
            counts = (self._log.between(Offset(), newest), self._log.between(end, handed), self._log.between(end, newest))
            rows = self._spark.createDataFrame([counts], "stream_length bigint, pending_count bigint, lag bigint")
            lag_messages(rows).coalesce(1).write.mode("append").text(self._feed)
        except Exception:
            logging.getLogger(__name__).exception("no lag message")


def progress_table(spark: SparkSession, reports: Iterable) -> DataFrame:
    """PROGRESS rows from progress reports (objects or their JSON text) at hand; ProgressLog keeps all of them.

    lag is what the source says is still to be read (offsets or files); null if it doesn't say.
    """
    lines = [(r if isinstance(r, str) else r.json,) for r in reports]
    return parse_progress(spark.createDataFrame(lines, "value string"))


def parse_progress(lines: DataFrame) -> DataFrame:
    """The same from a table of JSON lines `value`."""
    r = lines.select(F.from_json("value", _REPORT).alias("r")).select("r.*")

    def total(field: str) -> Column:
        return F.aggregate(
            "stateOperators", F.lit(0).cast("bigint"), lambda a, s: a + F.coalesce(s[field], F.lit(0).cast("bigint"))
        )

    said = F.transform(
        "sources",
        lambda s: F.coalesce(
            F.try_element_at(s["metrics"], F.lit("maxOffsetsBehindLatest")),
            F.try_element_at(s["metrics"], F.lit("numFilesOutstanding")),
        ).try_cast("bigint"),
    )
    return r.select(
        F.col("timestamp").alias("at"),
        "name",
        F.col("batchId").alias("batch_id"),
        F.col("numInputRows").alias("input_rows"),
        F.col("inputRowsPerSecond").alias("input_rows_per_second"),
        F.col("processedRowsPerSecond").alias("processed_rows_per_second"),
        total("numRowsTotal").alias("state_rows"),
        total("numRowsDroppedByWatermark").alias("dropped_rows"),
        F.array_max(said).alias("lag"),
        F.col("observedMetrics.judged.accepted").alias("accepted"),
        F.col("observedMetrics.judged.rejected").alias("rejected"),
        F.col("observedMetrics.arrived.bytes").alias("bytes"),
    ).select(*PROGRESS.fieldNames())


def backlog(progress: DataFrame) -> DataFrame:
    """at, name, stream_length (rows taken in so far), pending_count, lag, backlog class.

    A query without a reported lag has 0 pending and a null lag: unknown, not zero.
    """
    so_far = W.partitionBy("name").orderBy("at", "batch_id").rowsBetween(W.unboundedPreceding, W.currentRow)
    return progress.select(
        "at",
        "name",
        F.sum("input_rows").over(so_far).alias("stream_length"),
        F.coalesce("lag", F.lit(0)).alias("pending_count"),
        "lag",
    ).withColumn("backlog", backlog_class("pending_count"))


def liveness(progress: DataFrame, now: Column | None = None) -> DataFrame:
    """Milliseconds since each query last reported; a number to judge by, not a verdict."""
    current = F.current_timestamp() if now is None else now
    idle = (F.unix_micros(current) - F.unix_micros(F.max("at"))) / 1000
    return progress.groupBy("name").agg(F.floor(idle).alias("idle_ms"))


def lag_messages(backlog_rows: DataFrame) -> DataFrame:
    return backlog_rows.select(envelope(lag()).alias("value"))
