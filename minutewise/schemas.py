"""Explicit schemas; nothing here is ever inferred."""

from pyspark.sql import types as T

SERIES = ["service", "endpoint"]
BUCKET_KEY = ["minute_bucket", "service", "endpoint"]
FINDING_KEY = [*BUCKET_KEY, "detector", "signal"]

EVENT = T.StructType(
    [
        T.StructField("service", T.StringType()),
        T.StructField("endpoint", T.StringType()),
        T.StructField("status_code", T.IntegerType()),
        T.StructField("latency_ms", T.DoubleType()),
        T.StructField("ts", T.TimestampType()),
    ]
)

EVENT_WITH_ID = T.StructType([T.StructField("event_id", T.LongType()), *EVENT.fields])

# The same five fields as they travel between processes: every value is text.
EVENT_WIRE = T.StructType([T.StructField(f.name, T.StringType()) for f in EVENT.fields])

# What the ingest query stores: typed columns for accepted rows, raw text and reason for the others.
INGESTED = T.StructType(
    [
        *EVENT.fields,
        T.StructField("raw", T.StringType()),
        T.StructField("reject_reason", T.StringType()),
        T.StructField("accepted", T.BooleanType()),
        T.StructField("event_date", T.DateType()),
    ]
)

METRIC = T.StructType(
    [
        T.StructField("minute_bucket", T.TimestampType()),
        T.StructField("service", T.StringType()),
        T.StructField("endpoint", T.StringType()),
        T.StructField("request_count", T.LongType()),
        T.StructField("error_count", T.LongType()),
        T.StructField("p50", T.DoubleType()),
        T.StructField("p95", T.DoubleType()),
        T.StructField("p99", T.DoubleType()),
    ]
)

ANOMALY = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("minute_bucket", T.TimestampType()),
        T.StructField("service", T.StringType()),
        T.StructField("endpoint", T.StringType()),
        T.StructField("detector", T.StringType()),
        T.StructField("signal", T.StringType()),
        T.StructField("score", T.DoubleType()),
        T.StructField("reason", T.StringType()),
        T.StructField("created_at", T.TimestampType()),
    ]
)

OUTBOX = T.StructType([T.StructField("id", T.LongType()), T.StructField("payload", T.StringType())])

# How often each latency occurred in a bucket: the mergeable form of a bucket's sample.
VALUE_COUNT = T.StructType(
    [
        T.StructField("minute_bucket", T.TimestampType()),
        T.StructField("service", T.StringType()),
        T.StructField("endpoint", T.StringType()),
        T.StructField("latency_ms", T.DoubleType()),
        T.StructField("n", T.LongType()),
        T.StructField("errors", T.LongType()),
    ]
)

LABEL = T.StructType(
    [
        T.StructField("minute_bucket", T.TimestampType()),
        T.StructField("service", T.StringType()),
        T.StructField("endpoint", T.StringType()),
    ]
)

INCIDENT = T.StructType(
    [
        T.StructField("seq", T.LongType()),
        T.StructField("service", T.StringType()),
        T.StructField("endpoint", T.StringType()),
        T.StructField("start", T.TimestampType()),
        T.StructField("end", T.TimestampType()),
        T.StructField("kind", T.StringType()),
    ]
)

PROGRESS = T.StructType(
    [
        T.StructField("at", T.TimestampType()),
        T.StructField("name", T.StringType()),
        T.StructField("batch_id", T.LongType()),
        T.StructField("input_rows", T.LongType()),
        T.StructField("input_rows_per_second", T.DoubleType()),
        T.StructField("processed_rows_per_second", T.DoubleType()),
        T.StructField("state_rows", T.LongType()),
        T.StructField("dropped_rows", T.LongType()),
        T.StructField("lag", T.LongType()),
        T.StructField("accepted", T.LongType()),
        T.StructField("rejected", T.LongType()),
        T.StructField("bytes", T.LongType()),
    ]
)
