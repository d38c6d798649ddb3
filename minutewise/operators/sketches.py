"""Percentiles that merge: a quantile sketch per bucket, put together over any range of time or set of series.

Exact percentiles can't be merged over buckets; these can, with an error in rank of about 1.3 % at the default size.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import bucket_start, is_error
from ..params import Params
from ..schemas import BUCKET_KEY
from .rollup import PERCENTILES


def sketched(events: DataFrame, params: Params = Params()) -> DataFrame:
    """BUCKET_KEY, request_count, error_count and the sketch of the latencies, a few kilobytes however busy a bucket is."""
    placed = events.withColumn("minute_bucket", bucket_start("ts", params.window_seconds))
    return placed.groupBy(*BUCKET_KEY).agg(
        F.count("*").alias("request_count"), F.count_if(is_error("status_code")).alias("error_count"), F.kll_sketch_agg_double("latency_ms").alias("sketch")
    )


def merged(sketches: DataFrame, keys: list[str]) -> DataFrame:
    """The same per group of keys; groups combine before the shuffle."""
    return sketches.groupBy(*keys).agg(
        F.sum("request_count").alias("request_count"), F.sum("error_count").alias("error_count"), F.kll_merge_agg_double("sketch").alias("sketch")
    )


def with_percentiles(sketches: DataFrame) -> DataFrame:
    """p50, p95 and p99 in place of the sketch."""
    at = {f"p{round(p * 100)}": F.kll_sketch_get_quantile_double("sketch", F.lit(p)) for p in PERCENTILES}
    return sketches.withColumns(at).drop("sketch")
