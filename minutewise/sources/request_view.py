"""The driver's `events` table seen as a request log (the test data has no request log of its own)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Explicit, so that the same schema serves batch and streaming reads.
RAW_EVENTS = T.StructType(
    [
        T.StructField("event_id", T.LongType()),
        T.StructField("ts", T.TimestampNTZType()),
        T.StructField("user_id", T.LongType()),
        T.StructField("event_type", T.StringType()),
        T.StructField("value", T.DoubleType()),
        T.StructField("props", T.StringType()),
    ]
)


def request_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_requests(spark.read.schema(RAW_EVENTS).parquet(f"{sf_dir}/events.parquet"))


def as_requests(raw: DataFrame) -> DataFrame:
    kind = F.col("event_type")
    return raw.select(
        "event_id",
        F.concat(F.lit("svc"), F.col("user_id") % 5).alias("service"),
        F.concat(F.lit("/api/"), F.get_json_object("props", "$.k").cast("int") % 3).alias("endpoint"),
        F.when(kind == "error", 500).when(kind == "signup", 201).when(kind == "purchase", 404).otherwise(200)
        .alias("status_code"),
        F.col("value").alias("latency_ms"),
        F.col("ts").cast("timestamp").alias("ts"),
    )
