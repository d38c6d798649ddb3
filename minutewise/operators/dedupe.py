"""First or last row per key, as aggregates that combine before the shuffle."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schemas import BUCKET_KEY


def first_by_id(anomalies: DataFrame, arrival: str = "created_at") -> DataFrame:
    """One row per id: the one that arrived first."""
    return _pick(anomalies, ["id"], F.min_by, arrival)


def latest_points(points: DataFrame) -> DataFrame:
    """One row per bucket: the update with the highest sequence; stale ones are ignored."""
    return _pick(points, BUCKET_KEY, F.max_by, "sequence")


def fullest(metrics: DataFrame, order: str | None = None) -> DataFrame:
    """One row per bucket: the highest in `order`, or the one with most requests."""
    return _pick(metrics, BUCKET_KEY, F.max_by, order or "request_count")


def _pick(df: DataFrame, keys: list[str], choose, order: str) -> DataFrame:
    rest = [c for c in df.columns if c not in keys]
    # Ties are broken by content, so a rerun picks the same row.
    best = choose(F.struct(*rest), F.struct(order, *rest)).alias("_best")
    return df.groupBy(*keys).agg(best).select(*keys, "_best.*").select(*df.columns)
