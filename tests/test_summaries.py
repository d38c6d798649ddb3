import json
from datetime import datetime, timedelta, timezone

import pytest
from conftest import at, minute
from pyspark.sql import functions as F

from minutewise.functions.scalar import backlog_class, health_class, percent_text
from minutewise.operators.dedupe import first_by_id, latest_points
from minutewise.params import Params
from minutewise.plans import summaries as sm
from minutewise.schemas import ANOMALY, METRIC

NOW = at("12:00")
RANGE = {"start": at("11:50"), "end": at("12:01")}


@pytest.fixture(scope="module")
def metrics(spark):
    return spark.createDataFrame(
        [
            (at("11:56"), "tides", "/gauge", 64, 3, 8.0, 19.0, 23.0),
            (at("11:56"), "tides", "/chart", 16, 0, 31.0, 44.0, 52.0),
            (at("11:59"), "tides", "/gauge", 32, 1, 9.0, 21.0, 22.0),
            (at("11:57"), "tides", "/gauge", 48, 4, 7.0, 18.0, 27.0),
            (at("11:59"), "buoys", "/fix", 90, 0, 3.0, 5.0, 6.0),
        ],
        METRIC,
    )


def test_services(metrics):
    rows, total = sm.services(metrics, **RANGE)
    got = [(r.service, r.request_count, r.error_count, r.error_rate) for r in rows.collect()]
    assert got == [("buoys", 90, 0, 0.0), ("tides", 160, 8, 0.05)] and total.first().total == 2
    assert not {"p50", "p95", "p99"} & set(rows.columns)
    assert rows.collect()[1].last_seen == datetime(2026, 1, 1, 11, 59)


@pytest.mark.parametrize("status, expected", [("error", ["tides"]), ("healthy", ["buoys"]), ("all", ["buoys", "tides"])])
def test_status_class(metrics, status, expected):
    rows, total = sm.services(metrics, **RANGE, status=status)
    assert [r.service for r in rows.collect()] == expected and total.first().total == len(expected)


def test_pages(metrics):
    pages = [sm.services(metrics, **RANGE, limit=1, offset=o) for o in (0, 1, 5)]
    assert [[r.service for r in rows.collect()] for rows, _ in pages] == [["buoys"], ["tides"], []]
    assert [total.first().total for _, total in pages] == [2, 2, 2]


@pytest.mark.parametrize("bad", [{"limit": 0}, {"limit": 101}, {"offset": -1}, {"status": "odd"}])
def test_parameters_are_checked(metrics, bad):
    with pytest.raises(ValueError):
        sm.services(metrics, **RANGE, **bad)


def test_endpoints(metrics):
    rows, total = sm.endpoints(metrics, **RANGE)
    assert [(r.service, r.endpoint) for r in rows.collect()] == [("buoys", "/fix"), ("tides", "/chart"), ("tides", "/gauge")]
    assert total.first().total == 3
    assert sm.endpoints(metrics, "tides", **RANGE)[1].first().total == 2


def test_range_is_half_open(metrics):
    def names(start, end):
        return {r.service for r in sm.services(metrics, at(start), at(end))[0].collect()}

    assert names("11:59", "12:00") == {"buoys", "tides"}
    assert names("11:57", "11:59") == {"tides"}
    assert names("11:58", "11:59") == set()
    assert names("12:00", "11:00") == set()


def test_default_bounds():
    assert sm.bounds(now=NOW) == (at("11:00"), NOW)
    assert sm.bounds(end=at("10:00"), now=NOW) == (at("09:00"), at("10:00"))
    assert sm.bounds(start=at("01:00"), now=NOW) == (at("01:00"), NOW)
    assert sm.bounds(start=datetime(2026, 1, 1), end=NOW)[0] == minute(0)
    start, end = sm.bounds()
    assert end - start == timedelta(minutes=60) and datetime.now(timezone.utc) - end < timedelta(minutes=1)


def test_detail(metrics):
    rows = {r.endpoint: r for r in sm.service_detail(metrics, "tides", **RANGE).collect()}
    assert rows["/gauge"].request_count == 144 and rows["/chart"].request_count == 16
    assert [p.p95 for p in rows["/gauge"].series] == [19.0, 18.0, 21.0] and [p.p95 for p in rows["/chart"].series] == [44.0]
    assert {(r.service_request_count, r.service_error_count, r.service_error_rate) for r in rows.values()} == {(160, 8, 0.05)}
    assert sm.service_detail(metrics, "nobody", **RANGE).count() == 0
    points = sm.service_points(metrics, "tides", **RANGE).collect()
    assert [(p.endpoint, p.p95) for p in points] == [("/chart", 44.0), ("/gauge", 19.0), ("/gauge", 18.0), ("/gauge", 21.0)]


def test_detail_of_any_range(metrics):
    long = {"start": at("00:00") - timedelta(days=400), "end": at("12:00")}
    assert sm.service_detail(metrics, "tides", **long).count() == 2


def test_feed_shows_each_id_once_as_it_first_arrived(spark):
    rows = [(i, minute(i), "a", "/x", "zscore", "p95", 3.0, "r", minute(i)) for i in range(100)]
    # The newest rows are repeats of one old finding, more of them than the feed first looks at.
    rows += [(3, minute(3), "a", "/x", "zscore", "p95", 3.0, "r", minute(200 + k)) for k in range(30)]
    feed = sm.anomaly_feed(spark.createDataFrame(rows, ANOMALY), 5).collect()
    assert [r.id for r in feed] == [99, 98, 97, 96, 95]
    few = sm.anomaly_feed(spark.createDataFrame(rows[:2] + rows[-3:], ANOMALY), 5).collect()
    assert [(r.id, r.created_at.minute) for r in few] == [(3, 47), (1, 1), (0, 0)]
    assert sm.anomaly_feed(spark.createDataFrame([], ANOMALY)).collect() == []


def test_time_filter_reaches_the_scan(spark, metrics, tmp_path, capsys):
    metrics.write.parquet(str(tmp_path / "m"))
    stored = spark.read.schema(METRIC).parquet(str(tmp_path / "m"))
    sm.service_totals(stored, **RANGE).explain("formatted")
    plan = capsys.readouterr().out
    assert "GreaterThanOrEqual(minute_bucket" in plan and "LessThan(minute_bucket" in plan
    assert "p95" not in plan.split("ReadSchema")[1].split("\n")[0]


def test_snapshot(metrics):
    message = json.loads(sm.snapshot(metrics, NOW).first().message)
    assert (message["type"], message["schema_version"]) == ("snapshot", 1)
    assert message["services"][1] == {"service": "tides", "request_count": 160, "error_count": 8, "error_rate": 0.05,
                                      "last_seen": "2026-01-01T11:59:00+00:00"}
    assert json.loads(sm.snapshot(metrics, at("03:00")).first().message)["services"] == []


def test_tiles_and_classes(spark, metrics):
    tiles = {r.service: r for r in sm.tiles(sm.service_totals(metrics, **RANGE)).collect()}
    assert (tiles["tides"].health, tiles["tides"].error_percent) == ("warn", "5.0%")
    rates = spark.createDataFrame([(0.1,), (0.0999,), (0.02,), (0.0199,)], "r double")
    assert [r[0] for r in rates.select(health_class("r")).collect()] == ["error", "warn", "warn", "healthy"]
    assert rates.select(percent_text("r")).first()[0] == "10.0%"
    pending = spark.createDataFrame([(101,), (100,), (21,), (20,)], "p bigint")
    assert [r[0] for r in pending.select(backlog_class("p")).collect()] == ["error", "warn", "warn", None]


def finding(i, created, reason="r"):
    return (i, minute(0), "a", "/x", "zscore", "p95", 4.0, reason, created)


def test_feed_is_newest_first_and_deduplicated(spark):
    rows = [finding(i, minute(i)) for i in range(60)] + [finding(59, minute(99), "again")]
    feed = sm.anomaly_feed(spark.createDataFrame(rows, ANOMALY)).collect()
    assert [r.id for r in feed] == list(range(59, 9, -1)) and feed[0].reason == "r"


def test_first_by_id(spark):
    rows = [finding(1, minute(5), "late"), finding(1, minute(2), "early"), finding(2, minute(9))]
    got = {r.id: r.reason for r in first_by_id(spark.createDataFrame(rows, ANOMALY)).collect()}
    assert got == {1: "early", 2: "r"}


def test_stale_updates_are_ignored(spark):
    rows = [(minute(0), "a", "/x", 3, 30.0), (minute(0), "a", "/x", 1, 10.0), (minute(1), "a", "/x", 2, 20.0)]
    df = spark.createDataFrame(rows, "minute_bucket timestamp, service string, endpoint string, sequence bigint, p95 double")
    got = {(r.sequence, r.p95) for r in latest_points(df).where(F.col("service") == "a").collect()}
    assert got == {(3, 30.0), (2, 20.0)}
