"""JSON text of live messages and alerts, one column per message."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .scalar import iso_utc

# Fixed value: raised only when a message changes incompatibly.
SCHEMA_VERSION = 1

_KEEP_NULLS = {"ignoreNullFields": "false"}


def metric_point() -> list[Column]:
    return [
        F.lit("metric_point").alias("type"),
        F.col("sequence"),
        F.col("service"),
        F.col("endpoint"),
        iso_utc("minute_bucket").alias("minute_bucket"),
        F.col("request_count"),
        F.col("error_count"),
        F.col("p50"),
        F.col("p95"),
        F.col("p99"),
    ]


def anomaly() -> list[Column]:
    return [
        F.lit("anomaly").alias("type"),
        F.col("id"),
        F.col("service"),
        F.col("endpoint"),
        iso_utc("minute_bucket").alias("minute_bucket"),
        F.col("detector"),
        F.col("score"),
        F.col("reason"),
        iso_utc("created_at").alias("created_at"),
    ]


def lag() -> list[Column]:
    return [F.lit("lag").alias("type"), F.col("stream_length"), F.col("pending_count"), F.col("lag")]


def alert() -> list[Column]:
    """The alert receiver's payload; id lets it drop repeats."""
    return [
        F.col("id"),
        iso_utc("minute_bucket").alias("minute_bucket"),
        F.col("service"),
        F.col("endpoint"),
        F.col("detector"),
        F.col("score"),
        F.col("reason"),
    ]


def as_json(fields: list[Column]) -> Column:
    """The fields as one JSON object, unknown (null) values kept."""
    return F.to_json(F.struct(*fields), _KEEP_NULLS)


def envelope(fields: list[Column]) -> Column:
    """The fields as published: schema_version first, then the message unchanged."""
    return as_json([F.lit(SCHEMA_VERSION).alias("schema_version"), *fields])
