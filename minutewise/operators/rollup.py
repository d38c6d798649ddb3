"""Events to per-bucket metrics with exact percentiles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import bucket_start, is_error
from ..params import Params
from ..schemas import BUCKET_KEY, METRIC
from ..session import cut, small
from .ranks import interpolate, interpolation_ranks, select_ranks

PERCENTILES = [0.5, 0.95, 0.99]


def to_values(events: DataFrame, window_seconds: int) -> DataFrame:
    """One row per event in the value-count form, before any grouping."""
    return events.select(
        bucket_start("ts", window_seconds).alias("minute_bucket"),
        "service",
        "endpoint",
        F.col("latency_ms").cast("double").alias("latency_ms"),
        F.lit(1).cast("bigint").alias("n"),
        is_error("status_code").cast("bigint").alias("errors"),
    )


def count_values(values: DataFrame) -> DataFrame:
    """Merge value counts. Shuffles on the value too, so a busy bucket spreads over all tasks."""
    return values.groupBy(*BUCKET_KEY, "latency_ms").agg(F.sum("n").alias("n"), F.sum("errors").alias("errors"))


def rollup(events: DataFrame, params: Params = Params()) -> DataFrame:
    """METRIC rows of a batch of events."""
    return rollup_values(to_values(events, params.window_seconds), params)


def rollup_values(values: DataFrame, params: Params = Params()) -> DataFrame:
    """METRIC rows from value counts.

    Ordinary buckets use the built-in percentile, which combines on the map side and then holds one
    bucket's distinct values in one task. A first job looks for buckets with more than hot_values of them. Those
    are counted by value once, and all that select_ranks does starts from these counts.
    """
    hot = cut(hot_buckets(values, params))
    if hot.isEmpty():
        return _ordinary(values)
    keys = small(hot.select(*BUCKET_KEY))
    counted = cut(count_values(values.join(keys, BUCKET_KEY, "left_semi")))
    return _ordinary(values.join(keys, BUCKET_KEY, "left_anti")).unionByName(_hot(counted, hot))


def hot_buckets(values: DataFrame, params: Params) -> DataFrame:
    """Key and totals of the buckets with more than about hot_values distinct latencies."""
    totals = values.groupBy(*BUCKET_KEY).agg(
        F.sum("n").alias("request_count"),
        F.sum("errors").alias("error_count"),
        F.approx_count_distinct("latency_ms").alias("_distinct"),
    )
    return totals.where(F.col("_distinct") > params.hot_values).drop("_distinct")


def _ordinary(values: DataFrame) -> DataFrame:
    quantiles = F.percentile("latency_ms", F.array(*[F.lit(p) for p in PERCENTILES]), F.col("n"))
    return _metric(
        values.groupBy(*BUCKET_KEY)
        .agg(F.sum("n").alias("request_count"), F.sum("errors").alias("error_count"), quantiles.alias("_q"))
        .withColumns({"p50": F.col("_q")[0], "p95": F.col("_q")[1], "p99": F.col("_q")[2]})
    )


def _hot(values: DataFrame, sizes: DataFrame) -> DataFrame:
    targets = sizes.select(*BUCKET_KEY, interpolation_ranks(F.col("request_count"), PERCENTILES).alias("ranks"))
    found = select_ranks(values, targets, BUCKET_KEY, "latency_ms", "n")
    # At most two ranks per percentile and bucket.
    at_rank = found.groupBy(*BUCKET_KEY).agg(
        F.map_from_entries(F.collect_list(F.struct("rank", "value"))).alias("_at")
    )
    p50, p95, p99 = (interpolate(F.col("_at"), F.col("request_count"), p) for p in PERCENTILES)
    return _metric(sizes.join(at_rank, BUCKET_KEY).withColumns({"p50": p50, "p95": p95, "p99": p99}))


def _metric(df: DataFrame) -> DataFrame:
    return df.select(*METRIC.fieldNames())
