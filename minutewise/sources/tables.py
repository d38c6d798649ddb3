"""The stored tables: metrics, anomalies, alerts, labels."""

from __future__ import annotations

from datetime import date, datetime, time, timedelta, timezone

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalar import bucket_start, instant, utc
from ..operators.dedupe import fullest
from ..operators.history import search_back
from ..operators.rollup import rollup
from ..params import Params
from ..schemas import ANOMALY, BUCKET_KEY, INCIDENT, LABEL, METRIC, SERIES
from ..session import cut


_DATED_METRIC = T.StructType([*METRIC.fields, T.StructField("bucket_date", T.DateType())])


def write_batch(df: DataFrame, path: str, batch_id: int) -> None:
    """Write one micro-batch of a table; running the batch again replaces its rows.

    Tables by bucket lie in bucket_date=/batch_id= folders, so that a range of time opens the days it needs.
    """
    if "minute_bucket" not in df.columns:
        df.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")
        return
    dated = df.withColumns({"bucket_date": F.to_date("minute_bucket"), "batch_id": F.lit(batch_id).cast("bigint")})
    (
        dated.write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("bucket_date", "batch_id")
        .parquet(path)
    )


def read_batches(spark: SparkSession, path: str, schema, start: datetime | None = None, end: datetime | None = None,
                 batch_id: int | None = None) -> DataFrame:
    """A table written by write_batch, or one of its batches; empty before the first one is written.

    With start or end (start <= minute_bucket < end) only the days between them are opened.
    """
    dated = "minute_bucket" in schema.fieldNames()
    folders = [T.StructField("bucket_date", T.DateType())] if dated and "bucket_date" not in schema.fieldNames() else []
    whole = T.StructType([*schema.fields, *folders, T.StructField("batch_id", T.LongType())])
    try:
        rows = spark.read.schema(whole).option("basePath", path).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)
    if batch_id is not None:
        rows = rows.where(F.col("batch_id") == batch_id)
    if dated:
        rows = _days_between(rows, start, end)
    return rows.select(*schema.fieldNames())


def _days_between(rows: DataFrame, start: datetime | None, end: datetime | None) -> DataFrame:
    """Rows of start <= minute_bucket < end, by day first: that reaches the folders."""
    if start is not None:
        rows = rows.where(F.col("bucket_date") >= F.lit(utc(start).astimezone(timezone.utc).date()))
    if end is not None:
        rows = rows.where(F.col("bucket_date") <= F.lit(utc(end).astimezone(timezone.utc).date()))
    return _between(rows, start, end)


def ensure_table(spark: SparkSession, path: str, schema) -> None:
    """Give a stream something to watch before the first batch of its input is written."""
    try:
        spark.read.schema(schema).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        write_batch(spark.createDataFrame([], schema), path, -1)


def read_anomalies(spark: SparkSession, path: str, start: datetime | None = None, end: datetime | None = None) -> DataFrame:
    return read_batches(spark, path, ANOMALY, start, end)


def read_labels(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    return spark.read.schema(LABEL).format(fmt).load(path)


def read_incidents(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    return spark.read.schema(INCIDENT).format(fmt).load(path)


def read_metrics(spark: SparkSession, closed: str, repaired: str | None = None, start: datetime | None = None,
                 end: datetime | None = None) -> DataFrame:
    """Metrics as written by the live job, with repaired buckets in place of the live ones.

    Only days that have a repair pay for the key comparison; all others are read as they are. With start or
    end (start <= minute_bucket < end), repaired days outside the range aren't opened.
    """
    live = read_batches(spark, closed, _DATED_METRIC, start, end)
    if repaired is None:
        return live.select(*METRIC.fieldNames())
    try:
        fixed = spark.read.schema(_DATED_METRIC).parquet(repaired)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return live.select(*METRIC.fieldNames())
    fixed = _days_between(fixed, start, end)
    # One value per day directory.
    days = [row.bucket_date for row in fixed.select("bucket_date").distinct().collect()]
    day = F.col("bucket_date")
    untouched = live.where(~day.isin(days))
    superseded = live.where(day.isin(days)).join(fixed.select(*BUCKET_KEY), BUCKET_KEY, "left_anti")
    return untouched.unionByName(superseded).unionByName(fixed).select(*METRIC.fieldNames())


def read_since(spark: SparkSession, closed: str, since: datetime, rows: int, repaired: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Metrics from a moment on, and the last rows of each of their series before it, from as few day folders as hold these."""
    wanted = read_metrics(spark, closed, repaired, start=since)
    dates = [read_batches(spark, closed, _DATED_METRIC)]
    if repaired is not None:
        dates.append(spark.read.schema(_DATED_METRIC).parquet(repaired))
    # The dates are names of folders: no column is read for them.
    known = [day for day in (d.agg(F.min("bucket_date")).first()[0] for d in dates) if day is not None]
    since = utc(since)
    earliest = min([datetime.combine(day, time(), timezone.utc) for day in known], default=since)
    read = lambda start, end: read_metrics(spark, closed, repaired, start, end)
    return wanted, search_back(read, wanted.select(*SERIES), rows, since, earliest)


def _between(metrics: DataFrame, start: datetime | None, end: datetime | None) -> DataFrame:
    if start is not None:
        metrics = metrics.where(F.col("minute_bucket") >= instant(start))
    if end is not None:
        metrics = metrics.where(F.col("minute_bucket") < instant(end))
    return metrics


def write_metrics(metrics: DataFrame, path: str) -> None:
    """Replace whole days of a metrics table: only the days present in `metrics` are touched.

    Rows lie sorted by service within files, so filters on day, service and bucket all prune.
    """
    dated = metrics.withColumn("bucket_date", F.to_date("minute_bucket"))
    (
        dated.hint("rebalance", "bucket_date")
        .sortWithinPartitions("bucket_date", *SERIES, "minute_bucket")
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("bucket_date")
        .parquet(path)
    )


def upsert_metrics(updates: DataFrame, path: str, order: str | None = None) -> None:
    """Put updates into a table kept by write_metrics: a bucket that is there already is replaced, not added to.

    Of duplicate updates of a bucket the one with most requests is kept, as a count never shrinks; with `order`, a
    column of updates such as a batch number, the one highest in it. Only the days touched are read and rewritten, and
    the new rows are complete in the checkpoint folder before the first old one goes.
    """
    spark = updates.sparkSession
    new = cut(fullest(updates, order).select(*METRIC.fieldNames()))
    # One value per day touched.
    days = [row.day for row in new.select(F.to_date("minute_bucket").alias("day")).distinct().collect()]
    try:
        old = spark.read.schema(_DATED_METRIC).parquet(path).where(F.col("bucket_date").isin(days))
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        write_metrics(new, path)
        return
    kept = old.select(*METRIC.fieldNames()).join(new.select(*BUCKET_KEY), BUCKET_KEY, "left_anti")
    write_metrics(cut(kept.unionByName(new)), path)


def compact_metrics(spark: SparkSession, closed: str, daily: str, before: date) -> list[date]:
    """Copy the days before a date from the live table's batch folders into the day files of write_metrics.

    A bucket the daily table has already (from a repair) stays as it is there. read_metrics(closed, daily) sees every row once
    before, during and after; the batch folders of the days given back may go as the storage's own rules have it.
    """
    live = read_batches(spark, closed, _DATED_METRIC, end=datetime.combine(before, time(), timezone.utc))
    # One value per day folder.
    days = sorted(row.bucket_date for row in live.select("bucket_date").distinct().collect())
    if days:
        until = datetime.combine(max(days), time(), timezone.utc) + timedelta(days=1)
        begin = datetime.combine(min(days), time(), timezone.utc)
        write_metrics(cut(read_metrics(spark, closed, daily, begin, until)), daily)
    return days


def _spans(days: list[date]) -> list[tuple[date, date]]:
    """Runs of consecutive days, as first and last."""
    spans: list[tuple[date, date]] = []
    for day in sorted(set(days)):
        if spans and day - spans[-1][1] == timedelta(days=1):
            spans[-1] = (spans[-1][0], day)
        else:
            spans.append((day, day))
    return spans


def repair(events: DataFrame, path: str, days: list[date], params: Params = Params()) -> None:
    """Recompute whole days from raw events, late ones included, and replace them in the repaired table.

    The ranges on ts, one for each run of days, reach the scan of the events. A stored count can't shrink: every event
    of the day's buckets is read again.
    """
    if not days:
        return
    wide = timedelta(days=1, seconds=params.window_seconds)
    nearby = F.lit(False)
    for first, last in _spans(days):
        start, until = (datetime.combine(d, time(), timezone.utc) for d in (first, last))
        nearby = nearby | ((F.col("ts") >= instant(start)) & (F.col("ts") < instant(until + wide)))
    of_days = events.where(nearby).where(F.to_date(bucket_start("ts", params.window_seconds)).isin(days))
    write_metrics(rollup(of_days, params), path)
