"""The three detectors and their fusion into findings."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.forest import forest_column
from ..functions.scalar import error_rate, features, instant
from ..params import Params
from ..schemas import ANOMALY, BUCKET_KEY, FINDING_KEY, METRIC, SERIES
from .history import CHUNK, chunked, history, latest_rows, previous

SIGNALS = ("p95", "error_rate")

# The reason texts.
REASON = {
    "p95": "p95 latency %.1fms is %.2f std devs from ",
    "error_rate": "error rate %.3f is %.2f std devs from ",
    "multivariate": "multivariate outlier across request_count/error_rate/p50/p95/p99 "
    "(isolation forest score %.3f, lower = more anomalous)",
}
BASELINE_WINDOW = "the {n}-bucket baseline"
BASELINE_EWMA = "the EWMA baseline (alpha={alpha})"


def detect(metrics: DataFrame, params: Params = Params(), since: datetime | None = None,
           earlier: DataFrame | None = None, created_at: Column | None = None) -> DataFrame:
    """ANOMALY rows of every bucket (from `since` on) that any detector flags.

    `earlier` holds buckets that serve as history only, for callers that keep each series' last ones or have them from
    tables.read_since; `since` itself is for metrics at hand, all of which it looks through.
    """
    return findings(scored(metrics, params, since, earlier), params, created_at)


def scored(metrics: DataFrame, params: Params = Params(), since: datetime | None = None,
           earlier: DataFrame | None = None, with_forest: bool = True) -> DataFrame:
    """METRIC rows with one score column per detector and signal, null where nothing fired.

    All frames share one shuffle and one sort. The forest, by far the dearest step, runs in the same tasks: a
    chunk is small, so chunks spread evenly however few series there are. Their number of tasks is set here
    because the planner would merge tasks by bytes, and a forest costs time rather than bytes.
    """
    tasks = params.forest_partitions or int(metrics.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    base = _with_history(metrics, params, since, earlier, tasks if with_forest else None)
    ready = F.size("_p95") >= params.min_history
    out = base.select(
        *METRIC.fieldNames(),
        "error_rate",
        *([F.flatten("_forest_history").alias("_past"), features().alias("_now")] if with_forest else []),
        *[_zscore(s, ready, params).alias(f"zscore_{s}") for s in SIGNALS],
        *[_ewma(s, ready, params).alias(f"ewma_{s}") for s in SIGNALS],
    )
    if not with_forest:
        return out
    score = forest_column(params.contamination, params.forest_min_history)
    return out.withColumn("forest", score("_past", "_now")).drop("_past", "_now")


def zscore(metrics: DataFrame, signal: str, params: Params = Params(), since: datetime | None = None,
           earlier: DataFrame | None = None) -> DataFrame:
    """Buckets whose signal is zscore_threshold sample deviations or more from the recent mean."""
    return _hits(metrics, f"zscore_{_signal(signal)}", params, since, earlier)


def ewma(metrics: DataFrame, signal: str, params: Params = Params(), since: datetime | None = None,
         earlier: DataFrame | None = None) -> DataFrame:
    """Same against an exponentially weighted mean and deviation."""
    return _hits(metrics, f"ewma_{_signal(signal)}", params, since, earlier)


def forest(metrics: DataFrame, params: Params = Params(), since: datetime | None = None) -> DataFrame:
    """Buckets an isolation forest of the recent history calls outliers; lower scores are worse."""
    return scored(metrics, params, since).where("forest IS NOT NULL").select(*BUCKET_KEY, F.col("forest").alias("score"))


def findings(scores: DataFrame, params: Params = Params(), created_at: Column | None = None) -> DataFrame:
    """One ANOMALY row per score that fired, with a stable id and a reason in words."""
    window = BASELINE_WINDOW.format(n=params.min_history)
    weighted = BASELINE_EWMA.format(alpha=params.ewma_alpha)
    fired = [
        _finding(kind, signal, f"{kind}_{signal}", F.format_string(REASON[signal] + base, signal, f"{kind}_{signal}"))
        for kind, base in (("zscore", window), ("ewma", weighted))
        for signal in SIGNALS
    ]
    if "forest" in scores.columns:
        outlier = F.format_string(REASON["multivariate"], "forest")
        fired.append(_finding("isolation_forest", "multivariate", "forest", outlier))
    return (
        scores.select(*BUCKET_KEY, F.inline(F.filter(F.array(*fired), lambda f: f.isNotNull())))
        .withColumn("id", F.xxhash64(*FINDING_KEY))
        .withColumn("created_at", F.current_timestamp() if created_at is None else created_at)
        .select(*ANOMALY.fieldNames())
    )


def _with_history(metrics: DataFrame, params: Params, since: datetime | None,
                  earlier: DataFrame | None, tasks: int | None) -> DataFrame:
    rows = metrics.select(*METRIC.fieldNames())
    if since is not None:
        # A time filter can't pass below a frame that counts rows, so fetch just what the frames need.
        wanted = rows.where(F.col("minute_bucket") >= instant(since))
        # Series without a new bucket need no past.
        theirs = rows.join(wanted.select(*SERIES).distinct(), SERIES, "left_semi")
        older = latest_rows(theirs, params.longest_history, instant(since))
        earlier = older if earlier is None else earlier.select(*METRIC.fieldNames()).unionByName(older)
        rows = wanted
    rows = rows.withColumn("_wanted", F.lit(True))
    if earlier is not None:
        rows = rows.unionByName(earlier.select(*METRIC.fieldNames(), F.lit(False).alias("_wanted")))
    rows = chunked(rows.withColumn("error_rate", error_rate()), params.longest_history, params.chunk_rows)
    if tasks:
        rows = rows.repartition(tasks, *CHUNK)

    tail = previous(params.min_history)
    for s in SIGNALS:
        rows = rows.withColumns(
            {
                f"_{s}": history(F.col(s), params.min_history),
                f"_mean_{s}": F.avg(s).over(tail),
                f"_dev_{s}": F.stddev_samp(s).over(tail),
            }
        )
    return rows.withColumn("_forest_history", history(features(), params.longest_history)).where("_own AND _wanted")


def _zscore(signal: str, ready: Column, params: Params) -> Column:
    z = (F.col(signal) - F.col(f"_mean_{signal}")) / F.nullif(F.col(f"_dev_{signal}"), F.lit(0.0))
    return F.when(ready & (F.abs(z) >= params.zscore_threshold), z)


def _ewma(signal: str, ready: Column, params: Params) -> Column:
    values, alpha = F.col(f"_{signal}"), F.lit(params.ewma_alpha)

    def step(state: Column, value: Column) -> Column:
        gap = value - state["mean"]
        move = alpha * gap
        return F.struct(
            (state["mean"] + move).alias("mean"),
            ((1 - alpha) * (state["var"] + gap * move)).alias("var"),
        )

    first = F.struct(F.get(values, F.lit(0)).alias("mean"), F.lit(0.0).alias("var"))
    state = F.aggregate(F.slice(values, 2, params.min_history), first, step)
    z = (F.col(signal) - state["mean"]) / F.nullif(F.sqrt(state["var"]), F.lit(0.0))
    return F.when(ready & (F.abs(z) >= params.zscore_threshold), z)


def _hits(metrics: DataFrame, column: str, params: Params, since: datetime | None, earlier: DataFrame | None) -> DataFrame:
    rows = scored(metrics, params, since, earlier, with_forest=False)
    return rows.where(F.col(column).isNotNull()).select(*BUCKET_KEY, F.col(column).alias("score"))


def _finding(detector: str, signal: str, column: str, reason: Column) -> Column:
    found = F.struct(
        F.lit(detector).alias("detector"),
        F.lit(signal).alias("signal"),
        F.col(column).alias("score"),
        reason.alias("reason"),
    )
    return F.when(F.col(column).isNotNull(), found)


def _signal(name: str) -> str:
    if name not in SIGNALS:
        raise ValueError(f"signal must be one of {SIGNALS}")
    return name
