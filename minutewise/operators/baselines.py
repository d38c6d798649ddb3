"""Detectors that need no model of the recent past: fixed bounds, and the same time of earlier periods."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W
from pyspark.sql import functions as F

from ..functions.scalar import error_rate
from ..params import Params
from ..schemas import BUCKET_KEY, SERIES


def threshold(metrics: DataFrame, signal: str, bound: float, least_requests: int = 1) -> DataFrame:
    """BUCKET_KEY and score (how many times the bound) of buckets whose signal is at or above a bound.

    Buckets of fewer requests are left out, as one error of one request is a rate of 1.
    """
    if bound <= 0:
        raise ValueError("bound must be above 0")
    rows = metrics.withColumn("error_rate", error_rate()).where(F.col("request_count") >= least_requests)
    return rows.where(F.col(signal) >= bound).select(*BUCKET_KEY, (F.col(signal) / bound).alias("score"))


def seasonal(metrics: DataFrame, signal: str, params: Params = Params(), period_seconds: int = 86_400, periods: int = 7,
             least_periods: int = 3) -> DataFrame:
    """BUCKET_KEY and score of buckets whose signal is zscore_threshold deviations or more from the mean of its season.

    The season of a bucket is the same bucket of up to `periods` earlier periods that have it. A frame runs over one place
    in the period of one series, so a long or busy series is many small groups. A flat or short season gives no result.
    """
    if period_seconds % params.window_seconds:
        raise ValueError("period_seconds must be a multiple of window_seconds")
    micros = F.unix_micros("minute_bucket")
    place = F.pmod(micros, F.lit(period_seconds * 1_000_000))
    number = ((micros - place) / (period_seconds * 1_000_000)).cast("long")
    rows = metrics.withColumn("error_rate", error_rate()).withColumns({"_place": place, "_number": number})
    season = W.partitionBy(*SERIES, "_place").orderBy("_number").rangeBetween(-periods, -1)
    told = rows.withColumns(
        {"_n": F.count(signal).over(season), "_mean": F.avg(signal).over(season), "_dev": F.stddev_samp(signal).over(season)}
    )
    score = (F.col(signal) - F.col("_mean")) / F.nullif("_dev", F.lit(0.0))
    return (
        told.where(F.col("_n") >= least_periods)
        .withColumn("score", score)
        .where(F.abs("score") >= params.zscore_threshold)
        .select(*BUCKET_KEY, "score")
    )
