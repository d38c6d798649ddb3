"""Column expressions: error rule, ratios, classes, buckets, text forms."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import Column
from pyspark.sql import functions as F

# The error rule and the display classes.
ERROR_STATUS = 500
RATE_ERROR = 0.1
RATE_WARN = 0.02
BACKLOG_ERROR = 100
BACKLOG_WARN = 20

FEATURES = ["request_count", "error_rate", "p50", "p95", "p99"]


def is_error(status_code: Column | str) -> Column:
    """Only server errors count; 4xx is the client's doing."""
    return _col(status_code) >= ERROR_STATUS


def bucket_start(ts: Column | str, window_seconds: int) -> Column:
    """Start of the epoch-aligned UTC window holding ts (floors before 1970 too)."""
    return F.window(_col(ts), f"{window_seconds} seconds")["start"]


def ratio(numerator: Column | str, denominator: Column | str) -> Column:
    """numerator / denominator as double, 0.0 where the denominator is 0."""
    top, bottom = _col(numerator), _col(denominator)
    return F.when(bottom > 0, top.cast("double") / F.nullif(bottom, F.lit(0))).otherwise(F.lit(0.0))


def error_rate(error_count: Column | str = "error_count", request_count: Column | str = "request_count") -> Column:
    return ratio(error_count, request_count)


def features() -> Column:
    """The vector the forest sees, in the order of FEATURES."""
    return F.array(
        F.col("request_count").cast("double"),
        error_rate(),
        F.col("p50"),
        F.col("p95"),
        F.col("p99"),
    )


def health_class(rate: Column | str) -> Column:
    c = _col(rate)
    return F.when(c >= RATE_ERROR, "error").when(c >= RATE_WARN, "warn").otherwise("healthy")


def backlog_class(pending: Column | str) -> Column:
    """error, warn, or null for an ordinary backlog."""
    c = _col(pending)
    return F.when(c > BACKLOG_ERROR, "error").when(c > BACKLOG_WARN, "warn")


def percent_text(rate: Column | str) -> Column:
    return F.format_string("%.1f%%", _col(rate) * 100)


def iso_utc(ts: Column | str) -> Column:
    """ISO-8601 with a numeric offset; the fraction appears only where it is not zero."""
    c = _col(ts)
    whole = F.date_format(c, "yyyy-MM-dd'T'HH:mm:ssxxx")
    exact = F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSSxxx")
    return F.when(F.unix_micros(c) % 1_000_000 == 0, whole).otherwise(exact)


def safe_since(moment: Column | str) -> Column:
    """The minute before the one holding moment: no bucket still forming then is missed."""
    return F.date_trunc("minute", _col(moment)) - F.expr("INTERVAL 1 MINUTE")


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def utc(moment: datetime) -> datetime:
    """A datetime without an offset is taken as UTC."""
    return moment if moment.tzinfo else moment.replace(tzinfo=timezone.utc)


def instant(moment: datetime) -> Column:
    """A literal that filters can push to the scan."""
    return F.lit(utc(moment))
