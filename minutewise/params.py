"""Settings shared by every operator."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Params:
    """Window widths, detector thresholds and size bounds.

    The first block changes answers; the second only changes how Spark computes them.
    """

    # The defaults users of the service know.
    window_seconds: int = 60
    watermark_seconds: int = 120
    zscore_threshold: float = 3.0
    ewma_alpha: float = 0.3
    contamination: float = 0.05
    min_history: int = 10
    forest_min_history: int = 30
    max_future_skew_seconds: int = 60
    default_range_minutes: int = 60

    # A bucket with more distinct latencies than this, about, takes the distributed percentile path.
    hot_values: int = 250_000
    # One series' buckets go to tasks in runs of this many, each with its history copied along.
    chunk_rows: int = 500
    # Tasks for detection with the forest; 0 means spark.sql.shuffle.partitions.
    forest_partitions: int = 0
    # State keys that an open bucket's values are dealt to by their hash.
    live_parts: int = 4
    # How long detection remembers a series that brings nothing.
    series_ttl_seconds: int = 90 * 86_400

    def __post_init__(self) -> None:
        if self.window_seconds < 1 or self.watermark_seconds < 0:
            raise ValueError("window_seconds must be >= 1 and watermark_seconds >= 0")
        if self.min_history < 2 or self.forest_min_history < 2:
            raise ValueError("min_history and forest_min_history must be >= 2")
        if not 0.0 < self.ewma_alpha <= 1.0:
            raise ValueError("ewma_alpha must be in (0, 1]")
        if not 0.0 < self.contamination <= 0.5:
            raise ValueError("contamination must be in (0, 0.5]")
        if self.zscore_threshold < 0:
            raise ValueError("zscore_threshold must be >= 0")
        if self.hot_values < 1 or self.live_parts < 1 or self.series_ttl_seconds < 1:
            raise ValueError("hot_values, live_parts and series_ttl_seconds must be >= 1")
        if self.chunk_rows <= self.longest_history:
            raise ValueError("chunk_rows must exceed the history length")

    @property
    def longest_history(self) -> int:
        return max(self.min_history, self.forest_min_history)
