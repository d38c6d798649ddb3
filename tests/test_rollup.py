import random
from datetime import datetime, timezone

import numpy as np
import pytest
from conftest import minute
from pyspark.sql import functions as F

from minutewise.functions.scalar import bucket_start, is_error, ratio
from minutewise.operators.rollup import count_values, rollup, rollup_values, to_values
from minutewise.params import Params
from minutewise.schemas import EVENT, METRIC


def events(spark, rows):
    return spark.createDataFrame(rows, EVENT)


@pytest.mark.parametrize(
    "ts, width, expected",
    [
        ("2026-01-01 00:00:30", 60, "2026-01-01 00:00:00"),
        ("2026-01-01 00:01:00", 60, "2026-01-01 00:01:00"),
        ("2026-01-01 00:07:30", 300, "2026-01-01 00:05:00"),
        ("1969-12-31 23:59:30", 60, "1969-12-31 23:59:00"),
    ],
)
def test_bucket_start(spark, ts, width, expected):
    df = spark.createDataFrame([(ts,)], "t string").select(F.to_timestamp("t").alias("ts"))
    got = df.select(bucket_start("ts", width).cast("string").alias("b")).first().b
    assert got == expected


def test_only_server_errors_count(spark):
    rows = spark.createDataFrame([(s,) for s in (200, 301, 404, 499, 500, 503, 599)], "s int")
    got = {r.s: r.e for r in rows.select("s", is_error("s").alias("e")).collect()}
    assert got == {200: False, 301: False, 404: False, 499: False, 500: True, 503: True, 599: True}


def test_ratio_of_nothing_is_zero(spark):
    rows = spark.createDataFrame([(1, 4), (0, 0)], "a bigint, b bigint")
    assert [r.x for r in rows.select(ratio("a", "b").alias("x")).collect()] == [0.25, 0.0]


def test_known_bucket(spark):
    rows = [("a", "/x", 500 if i < 2 else 200, 10.0 * (i + 1), minute(0)) for i in range(10)]
    out = rollup(events(spark, rows)).first()
    assert (out.request_count, out.error_count, out.p50) == (10, 2, 55.0)
    assert out.p95 == pytest.approx(95.5) and out.p99 == pytest.approx(99.1)


def test_single_event(spark):
    out = rollup(events(spark, [("a", "/x", 200, 42.0, minute(0))])).first()
    assert (out.p50, out.p95, out.p99) == (42.0, 42.0, 42.0)


def test_schema(spark):
    assert rollup(events(spark, [])).schema.fieldNames() == METRIC.fieldNames()


def _mixed(spark, seed=5):
    rng = random.Random(seed)
    rows = []
    # One bucket holds most rows: ties, zeros, tiny and huge values among them.
    for _ in range(4000):
        value = rng.choice([0.0, 1e-12, 7.5, rng.uniform(0, 1), rng.lognormvariate(3, 2), rng.uniform(100, 100.001), 1e15])
        rows.append(("hot", "/x", rng.choice([200, 500]), value, minute(0)))
    for i in range(300):
        rows.append((f"s{i % 7}", "/y", 200, rng.uniform(0, 50), minute(i % 9)))
    return events(spark, rows), rows


@pytest.mark.parametrize("hot_values", [1000, 3])
def test_distributed_percentiles_equal_built_in(spark, hot_values):
    df, _ = _mixed(spark)
    plain = {tuple(r[:3]): tuple(r) for r in rollup(df).collect()}
    split = {tuple(r[:3]): tuple(r) for r in rollup(df, Params(hot_values=hot_values)).collect()}
    assert split == plain


def test_distributed_percentiles_equal_numpy(spark):
    df, rows = _mixed(spark, 6)
    out = rollup(df, Params(hot_values=1000)).where("service = 'hot'").first()
    expected = np.percentile([r[3] for r in rows if r[0] == "hot"], [50, 95, 99])
    assert [out.p50, out.p95, out.p99] == pytest.approx(list(expected), rel=1e-12)


def test_value_counts_merge(spark):
    df, _ = _mixed(spark, 7)
    counts = count_values(to_values(df, 60))
    # Merging counts of counts changes nothing, with either way to the percentiles.
    for params in (Params(), Params(hot_values=10)):
        assert sorted(rollup_values(count_values(counts), params).collect()) == sorted(rollup(df).collect())


def test_wide_window(spark):
    rows = [("a", "/x", 200, float(i), minute(i)) for i in range(10)]
    got = sorted(r.request_count for r in rollup(events(spark, rows), Params(window_seconds=300)).collect())
    assert got == [5, 5]


@pytest.mark.parametrize(
    "bad",
    [
        {"min_history": 1}, {"min_history": 0}, {"ewma_alpha": 0.0}, {"contamination": 0.6}, {"window_seconds": 0},
        {"chunk_rows": 30}, {"hot_values": 0}, {"zscore_threshold": -1},
    ],
)
def test_params_are_checked(bad):
    with pytest.raises(ValueError):
        Params(**bad)


def test_bucket_start_is_utc(spark):
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "Asia/Kolkata")
        ts = datetime(2026, 1, 1, 1, 0, tzinfo=timezone.utc)
        df = spark.range(1).select(F.unix_seconds(bucket_start(F.lit(ts), 21600)).alias("s"))
        assert df.first().s == int(datetime(2026, 1, 1, tzinfo=timezone.utc).timestamp())
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
