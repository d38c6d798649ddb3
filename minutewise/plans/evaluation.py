"""Scoring detections against labels, and the numbers of a load run."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import instant, ratio, safe_since
from ..operators.ranks import exact_ranks
from ..params import Params
from ..schemas import BUCKET_KEY

# The shares a latency summary reports.
SHARES = {"p50_ms": 0.50, "p95_ms": 0.95, "p99_ms": 0.99}


def flagged(anomalies: DataFrame, since: datetime | None = None) -> DataFrame:
    """Distinct buckets with any finding, from the minute before `since` on."""
    rows = anomalies if since is None else anomalies.where(F.col("minute_bucket") >= safe_since(instant(since)))
    return rows.select(*BUCKET_KEY).distinct()


def true_positives(truth: DataFrame, detected: DataFrame) -> DataFrame:
    return truth.select(*BUCKET_KEY).intersect(detected.select(*BUCKET_KEY))


def false_positives(truth: DataFrame, detected: DataFrame) -> DataFrame:
    return detected.select(*BUCKET_KEY).subtract(truth.select(*BUCKET_KEY))


def false_negatives(truth: DataFrame, detected: DataFrame) -> DataFrame:
    return truth.select(*BUCKET_KEY).subtract(detected.select(*BUCKET_KEY))


def confusion(truth: DataFrame, detected: DataFrame) -> DataFrame:
    """Every labelled or detected bucket once, with outcome TP, FP or FN.

    A union grouped by key in place of a full outer join: repeats collapse before the shuffle.
    """
    marked = truth.select(*BUCKET_KEY, F.lit(True).alias("_truth"), F.lit(False).alias("_found")).unionByName(
        detected.select(*BUCKET_KEY, F.lit(False).alias("_truth"), F.lit(True).alias("_found"))
    )
    both = marked.groupBy(*BUCKET_KEY).agg(F.max("_truth").alias("_truth"), F.max("_found").alias("_found"))
    outcome = F.when(F.col("_truth") & F.col("_found"), "TP").when(F.col("_found"), "FP").otherwise("FN")
    return both.select(*BUCKET_KEY, outcome.alias("outcome"))


def precision_recall(truth: DataFrame, detected: DataFrame) -> DataFrame:
    """One row: true/false positives, false negatives, precision, recall (0.0 over nothing)."""
    counted = confusion(truth, detected).agg(
        F.count_if(F.col("outcome") == "TP").alias("true_positives"),
        F.count_if(F.col("outcome") == "FP").alias("false_positives"),
        F.count_if(F.col("outcome") == "FN").alias("false_negatives"),
    )
    tp = F.col("true_positives")
    return counted.withColumns(
        {
            "precision": ratio(tp, tp + F.col("false_positives")),
            "recall": ratio(tp, tp + F.col("false_negatives")),
        }
    )


def processed_count(metrics: DataFrame, service: str, endpoint: str, since: datetime) -> DataFrame:
    """One row: requests of one series in durable buckets, from the minute before `since` on."""
    rows = metrics.where(
        (F.col("service") == service)
        & (F.col("endpoint") == endpoint)
        & (F.col("minute_bucket") >= safe_since(instant(since)))
    )
    return rows.agg(F.coalesce(F.sum("request_count"), F.lit(0)).alias("processed"))


def rate(count: Column | str, seconds: float) -> Column:
    """Events per second, 0.0 for a run of no length."""
    return ratio(count, F.lit(float(seconds)))


def latency_stats(samples: DataFrame, by: list[str] | None = None, params: Params = Params()) -> DataFrame:
    """count, avg_ms and floor-rank percentiles of latency_ms, per `by` group or overall.

    Unlike the rollup's, these percentiles are an element of the sample: the one at min(floor(n*p), n-1).
    Overall on no rows gives a row of zeros.
    """
    keys = by or ["_all"]
    rows = samples if by else samples.withColumn("_all", F.lit(0))

    def rank(n: Column, p: float) -> Column:
        return F.least(F.floor(n * F.lit(p)), n - 1).cast("bigint")

    def ranks(n: Column) -> Column:
        return F.array_distinct(F.array(*[rank(n, p) for p in SHARES.values()]))

    at = exact_ranks(rows, keys, "latency_ms", ranks, params)
    stats = at.select(
        *keys,
        F.col("n").alias("count"),
        F.col("mean").alias("avg_ms"),
        *[F.col("at")[rank(F.col("n"), p)].alias(name) for name, p in SHARES.items()],
    )
    if by:
        return stats
    return stats.agg(
        F.coalesce(F.max("count"), F.lit(0)).alias("count"),
        *[F.coalesce(F.max(c), F.lit(0.0)).alias(c) for c in ("avg_ms", *SHARES)],
    )


def throughput_series(samples: DataFrame, duration_seconds: float) -> DataFrame:
    """Sends per whole second of a run (second, sent), zeros included; the last second takes the rest."""
    seconds = max(int(duration_seconds), 1)
    second = F.least(F.col("offset_s").cast("bigint"), F.lit(seconds - 1))
    sent = (
        samples.select(second.alias("second")).where("second >= 0").groupBy("second").agg(F.count("*").alias("sent"))
    )
    every = samples.sparkSession.range(seconds).withColumnRenamed("id", "second")
    return every.join(sent, "second", "left").select("second", F.coalesce("sent", F.lit(0)).alias("sent"))


def throughput_spread(series: DataFrame) -> DataFrame:
    """One row: mean, population deviation, lowest and highest of a throughput series."""
    return series.agg(
        F.avg("sent").alias("mean"),
        F.stddev_pop("sent").alias("stddev"),
        F.min("sent").alias("minimum"),
        F.max("sent").alias("maximum"),
    )


def peak_backlog(progress: DataFrame) -> DataFrame:
    """One row: the highest pending_count and lag; lag stays null if none was ever reported."""
    return progress.agg(
        F.coalesce(F.max("pending_count"), F.lit(0)).alias("peak_pending"), F.max("lag").alias("peak_lag")
    )


def report(scenario: str, run_at: Column, throughput: DataFrame, live: DataFrame, detection: DataFrame,
           spread: DataFrame, backlog: DataFrame, processed: DataFrame, duration_seconds: float) -> DataFrame:
    """A run's numbers as one nested row, ready for write_report. Every input has exactly one row."""
    parts = {
        "throughput_latency": throughput,
        "throughput_variance": spread,
        "live_latency": live,
        "detection": detection,
        "operational": backlog,
        "processing": processed.select("processed", rate("processed", duration_seconds).alias("processed_per_sec")),
    }
    out = None
    for name, one in parts.items():
        row = one.select(F.lit(1).alias("_one"), F.struct(*one.columns).alias(name))
        out = row if out is None else out.join(row, "_one")
    return out.select(
        F.lit(scenario).alias("scenario_name"),
        run_at.alias("run_timestamp"),
        F.lit(float(duration_seconds)).alias("throughput_duration_seconds"),
        *parts,
    )


def write_report(one_row: DataFrame, path: str) -> None:
    one_row.write.mode("overwrite").json(path)
