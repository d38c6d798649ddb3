"""Fixed bounds, seasons, sketches and paging by key on small tables."""

from datetime import timedelta

import pytest
from conftest import minute
from pyspark.sql import functions as F

from minutewise.operators import baselines, sketches
from minutewise.params import Params
from minutewise.plans.summaries import page_after
from minutewise.schemas import EVENT, METRIC


def test_threshold(spark):
    rows = [(minute(k), "a", "/x", n, e, 1.0, 1.0, 1.0) for k, (n, e) in enumerate([(1, 1), (10, 1), (10, 2), (10, 5)])]
    found = baselines.threshold(spark.createDataFrame(rows, METRIC), "error_rate", 0.2, least_requests=5).collect()
    assert sorted((r.minute_bucket.minute, r.score) for r in found) == [(2, 1.0), (3, 2.5)]
    with pytest.raises(ValueError):
        baselines.threshold(spark.createDataFrame([], METRIC), "p95", 0)


def test_seasons(spark):
    day = lambda d, k, p95: (minute(k) + timedelta(days=d), "a", "/x", 9, 0, 1.0, float(p95), 1.0)
    # The first minute of a day is slow every day, the second is slow once.
    rows = [day(d, 0, 500 + d % 3) for d in range(9)] + [day(d, 1, 500 if d == 8 else 50 + d % 3) for d in range(9)]
    rows += [day(d, 2, 50) for d in range(8)] + [day(8, 2, 900)]  # flat until then
    found = baselines.seasonal(spark.createDataFrame(rows, METRIC), "p95").collect()
    assert [(r.minute_bucket.day, r.minute_bucket.minute) for r in found] == [(9, 1)] and found[0].score > 100
    with pytest.raises(ValueError):
        baselines.seasonal(spark.createDataFrame(rows, METRIC), "p95", Params(window_seconds=7))


def test_sketches_merge(spark):
    events = spark.range(20_000).select(
        F.lit("a").alias("service"), F.lit("/x").alias("endpoint"), F.when(F.col("id") % 10 == 0, 500).otherwise(200).alias("status_code"),
        F.pmod(F.col("id") * 7919, F.lit(20_000)).cast("double").alias("latency_ms"), F.timestamp_seconds(F.col("id") % 3600).alias("ts"),
    )
    apart = sketches.sketched(events.select(*EVENT.fieldNames()))
    whole = sketches.with_percentiles(sketches.merged(apart, ["service"])).first()
    assert apart.count() == 60 and (whole.request_count, whole.error_count) == (20_000, 2_000)
    for got, want in ((whole.p50, 0.5), (whole.p95, 0.95), (whole.p99, 0.99)):
        assert abs(got / 20_000 - want) < 0.03


def test_pages_by_key(spark):
    rows = spark.createDataFrame([(s, e) for s in "abc" for e in range(4)], "s string, e int")
    seen, last = [], None
    while page := [tuple(r) for r in page_after(rows, ["s", "e"], last, 5).collect()]:
        seen, last = seen + page, list(page[-1])
    assert seen == [(s, e) for s in "abc" for e in range(4)]
    for bad in ({"limit": 0}, {"last": ["a"]}):
        with pytest.raises(ValueError):
            page_after(rows, ["s", "e"], **bad)
