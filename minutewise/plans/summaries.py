"""Read queries over the metrics and anomalies tables."""

from __future__ import annotations

from datetime import datetime, timedelta, timezone

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.messages import SCHEMA_VERSION, as_json
from ..functions.scalar import error_rate, health_class, instant, iso_utc, percent_text, utc
from ..operators.dedupe import first_by_id
from ..params import Params
from ..schemas import METRIC
from ..session import cut

# The filter's choices and the sizes of a page, the snapshot and the feed.
STATUS_CLASSES = ("all", "healthy", "error")
MAX_PAGE = 100
SNAPSHOT_SERVICES = 100
FEED_ROWS = 50


def bounds(start: datetime | None = None, end: datetime | None = None, now: datetime | None = None,
           params: Params = Params()) -> tuple[datetime, datetime]:
    """The range asked for; end defaults to now, start to the default width before end."""
    until = utc(end or now or datetime.now(timezone.utc))
    return (utc(start) if start else until - timedelta(minutes=params.default_range_minutes)), until


def in_range(df: DataFrame, start: datetime, end: datetime) -> DataFrame:
    """start <= minute_bucket < end, with literal bounds that reach the scan."""
    return df.where((F.col("minute_bucket") >= instant(start)) & (F.col("minute_bucket") < instant(end)))


def status_class(totals: DataFrame, wanted: str) -> DataFrame:
    """Keep groups with no errors ("healthy"), with some ("error"), or "all"."""
    if wanted not in STATUS_CLASSES:
        raise ValueError(f"status_class must be one of {STATUS_CLASSES}")
    if wanted == "all":
        return totals
    errors = F.col("error_count")
    return totals.where(errors == 0 if wanted == "healthy" else errors > 0)


def page(df: DataFrame, order: list[str], limit: int = 20, offset: int = 0) -> tuple[DataFrame, DataFrame]:
    """(one ordered page, a one-row table `total` of all matching rows)."""
    if not 1 <= limit <= MAX_PAGE:
        raise ValueError(f"limit must be in 1..{MAX_PAGE}")
    if offset < 0:
        raise ValueError("offset must be >= 0")
    base = cut(df)
    return base.orderBy(*order).offset(offset).limit(limit), base.agg(F.count("*").alias("total"))


def page_after(df: DataFrame, order: list[str], last: list | None = None, limit: int = 20) -> DataFrame:
    """The rows after the one with the key `last` (None: the first ones): a page that costs no count and stays right as rows come in."""
    if not 1 <= limit <= MAX_PAGE:
        raise ValueError(f"limit must be in 1..{MAX_PAGE}")
    if last is not None:
        if len(last) != len(order):
            raise ValueError("last must have a value for each column of order")
        df = df.where(F.struct(*order) > F.struct(*[F.lit(v).alias(c) for c, v in zip(order, last)]))
    return df.orderBy(*order).limit(limit)


def service_totals(metrics: DataFrame, start: datetime | None = None, end: datetime | None = None,
                   status: str = "all", now: datetime | None = None) -> DataFrame:
    """Additive totals per service. No percentile: they can't be merged."""
    return status_class(_totals(in_range(metrics, *bounds(start, end, now)), ["service"]), status)


def endpoint_totals(metrics: DataFrame, service: str | None = None, start: datetime | None = None,
                    end: datetime | None = None, status: str = "all", now: datetime | None = None) -> DataFrame:
    """Additive totals per service and endpoint."""
    rows = in_range(metrics, *bounds(start, end, now))
    if service is not None:
        rows = rows.where(F.col("service") == service)
    return status_class(_totals(rows, ["service", "endpoint"]), status)


def services(metrics: DataFrame, start: datetime | None = None, end: datetime | None = None, status: str = "all",
             limit: int = 20, offset: int = 0, now: datetime | None = None) -> tuple[DataFrame, DataFrame]:
    return page(service_totals(metrics, start, end, status, now), ["service"], limit, offset)


def endpoints(metrics: DataFrame, service: str | None = None, start: datetime | None = None,
              end: datetime | None = None, status: str = "all", limit: int = 20, offset: int = 0,
              now: datetime | None = None) -> tuple[DataFrame, DataFrame]:
    return page(endpoint_totals(metrics, service, start, end, status, now), ["service", "endpoint"], limit, offset)


def tiles(totals: DataFrame) -> DataFrame:
    """Totals with the health class and percent text a dashboard shows."""
    return totals.withColumns({"health": health_class("error_rate"), "error_percent": percent_text("error_rate")})


def service_points(metrics: DataFrame, service: str, start: datetime | None = None, end: datetime | None = None,
                   now: datetime | None = None) -> DataFrame:
    """Every bucket of one service, unmerged, by endpoint and time."""
    rows = in_range(metrics, *bounds(start, end, now)).where(F.col("service") == service)
    return rows.select(*METRIC.fieldNames()).orderBy("endpoint", "minute_bucket")


def service_detail(metrics: DataFrame, service: str, start: datetime | None = None, end: datetime | None = None,
                   now: datetime | None = None, params: Params = Params()) -> DataFrame:
    """One row per endpoint of a service: its totals, the service's totals, and its series as an array.

    An array holds every bucket of the range; service_points gives the same points as plain rows, which
    suits very long ranges better.
    """
    first, until = bounds(start, end, now, params)
    rows = in_range(metrics, first, until).where(F.col("service") == service)
    point = F.struct("minute_bucket", "request_count", "error_count", "p50", "p95", "p99")
    per_endpoint = rows.groupBy("service", "endpoint").agg(
        F.sum("request_count").alias("request_count"),
        F.sum("error_count").alias("error_count"),
        F.array_sort(F.collect_list(point)).alias("series"),
    )
    whole = rows.groupBy("service").agg(
        F.sum("request_count").alias("service_request_count"), F.sum("error_count").alias("service_error_count")
    )
    return (
        # At most one row: the service asked for.
        per_endpoint.join(F.broadcast(whole), "service")
        .withColumn("error_rate", error_rate())
        .withColumn("service_error_rate", error_rate("service_error_count", "service_request_count"))
        .select("service", "service_request_count", "service_error_count", "service_error_rate",
                "endpoint", "request_count", "error_count", "error_rate", "series")
        .orderBy("endpoint")
    )


def snapshot(metrics: DataFrame, now: datetime | None = None) -> DataFrame:
    """The one message a new viewer starts from: the first services by name, over the default range."""
    first = service_totals(metrics, now=now).orderBy("service").limit(SNAPSHOT_SERVICES)
    row = F.struct("service", "request_count", "error_count", "error_rate", iso_utc("last_seen").alias("last_seen"))
    listed = first.agg(F.array_sort(F.collect_list(row)).alias("services"))
    fields = [F.lit("snapshot").alias("type"), F.lit(SCHEMA_VERSION).alias("schema_version"), F.col("services")]
    return listed.select(as_json(fields).alias("message"))


def anomaly_feed(anomalies: DataFrame, rows: int = FEED_ROWS) -> DataFrame:
    """The newest findings, each id once as it first arrived.

    One pass: arrivals of an id are combined before the shuffle, and every task keeps its newest rows only. For a table
    by days, give it the days of interest: a finding arrives soon after its bucket.
    """
    return first_by_id(anomalies).orderBy(F.desc("created_at"), "id").limit(rows)


def _totals(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.groupBy(*keys).agg(
        F.sum("request_count").alias("request_count"),
        F.sum("error_count").alias("error_count"),
        F.max("minute_bucket").alias("last_seen"),
    ).withColumn("error_rate", error_rate())
