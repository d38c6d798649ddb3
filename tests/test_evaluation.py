import json
import random
from datetime import datetime, timedelta, timezone

import pytest
from conftest import at, minute
from pyspark.sql import functions as F

from minutewise.operators.incidents import covered, label_incidents, label_keys
from minutewise.params import Params
from minutewise.plans import evaluation as ev
from minutewise.schemas import ANOMALY, EVENT, INCIDENT, LABEL, METRIC

# Five buckets of a ward's monitors, worked through by hand below.
WARD = [(minute(7 * k), f"bed{k}", "/rate") for k in range(5)]


def keys(spark, rows):
    return spark.createDataFrame(rows, LABEL)


@pytest.mark.parametrize(
    "truth, detected, expected",
    [
        (WARD[:4], WARD[1:], (3, 1, 1, 0.75, 0.75)),
        (WARD, WARD[2:4], (2, 0, 3, 1.0, 0.4)),
        (WARD[4:], WARD, (1, 4, 0, 0.2, 1.0)),
        (WARD[:2], WARD[3:], (0, 2, 2, 0.0, 0.0)),
        ([], WARD[:1], (0, 1, 0, 0.0, 0.0)),
        (WARD[:3] * 2, WARD[2:4] * 3, (1, 1, 2, 0.5, 1 / 3)),
    ],
)
def test_precision_recall(spark, truth, detected, expected):
    t, d = keys(spark, truth), keys(spark, detected)
    assert tuple(ev.precision_recall(t, d).first()) == pytest.approx(expected)
    sets = (ev.true_positives(t, d), ev.false_positives(t, d), ev.false_negatives(t, d))
    assert tuple(s.count() for s in sets) == expected[:3]
    assert ev.confusion(t, d).count() == sum(expected[:3])


def test_flagged(spark):
    rows = [(i, minute(b), "a", "/x", d, "p95", 4.0, "r", minute(9)) for i, (b, d) in
            enumerate([(0, "zscore"), (0, "ewma"), (4, "zscore"), (5, "zscore")])]
    found = spark.createDataFrame(rows, ANOMALY)
    assert ev.flagged(found).count() == 3
    assert ev.flagged(found, datetime(2026, 1, 1, 0, 5, 47, tzinfo=timezone.utc)).count() == 2


def sends(spark, offsets):
    return spark.createDataFrame([(float(o), 1.0) for o in offsets], "offset_s double, latency_ms double")


@pytest.mark.parametrize(
    "offsets, seconds, expected",
    [
        ([0.25, 0.5, 1.75, 3.0, 3.125, 3.875], 4, [2, 1, 0, 3]),
        ([k / 8 for k in range(36)], 5, [8, 8, 8, 8, 4]),
        ([], 5, [0] * 5),
        ([-0.5, -1.0, -7.0, 2.5, 99.0], 3.9, [1, 0, 2]),
        ([0.1], 0.4, [1]),
    ],
)
def test_throughput(spark, offsets, seconds, expected):
    series = ev.throughput_series(sends(spark, offsets), seconds)
    assert [r.sent for r in series.orderBy("second").collect()] == expected
    mean = sum(expected) / len(expected)
    dev = (sum((c - mean) ** 2 for c in expected) / len(expected)) ** 0.5
    assert tuple(ev.throughput_spread(series).first()) == pytest.approx((mean, dev, min(expected), max(expected)))


def samples(spark, values, phase="live"):
    return spark.createDataFrame([(phase, float(v)) for v in values], "phase string, latency_ms double")


def floor_rank(values):
    s, n = sorted(values), len(values)
    return [s[min(int(n * p), n - 1)] for p in (0.5, 0.95, 0.99)]


@pytest.mark.parametrize("hot_values", [1_000_000, 10])
def test_latency_stats(spark, hot_values):
    params = Params(hot_values=hot_values)
    assert tuple(ev.latency_stats(samples(spark, range(1, 101)), params=params).first()) == (100, 50.5, 51.0, 96.0, 100.0)
    assert tuple(ev.latency_stats(samples(spark, [7]), params=params).first()) == (1, 7.0, 7.0, 7.0, 7.0)
    assert tuple(ev.latency_stats(samples(spark, []), params=params).first()) == (0, 0.0, 0.0, 0.0, 0.0)
    rng = random.Random(3)
    groups = {name: [rng.lognormvariate(3, 1) for _ in range(n)] for name, n in (("a", 7), ("b", 901))}
    both = samples(spark, groups["a"], "a").unionAll(samples(spark, groups["b"], "b"))
    for r in ev.latency_stats(both, ["phase"], params).collect():
        assert [r.p50_ms, r.p95_ms, r.p99_ms] == floor_rank(groups[r.phase])
        assert r["count"] == len(groups[r.phase])


def test_processed(spark):
    metrics = spark.createDataFrame(
        [(minute(b), "a", e, n, 0, 1.0, 1.0, 1.0) for b, e, n in [(3, "/x", 7), (4, "/x", 10), (5, "/x", 5), (5, "/y", 99)]],
        METRIC,
    )
    since = datetime(2026, 1, 1, 0, 5, 30, tzinfo=timezone.utc)
    count = ev.processed_count(metrics, "a", "/x", since)
    assert count.first().processed == 15
    assert ev.processed_count(metrics, "nobody", "/x", since).first().processed == 0
    assert [count.select(ev.rate("processed", s)).first()[0] for s in (5, 0)] == [3.0, 0.0]


def test_peak_backlog(spark):
    schema = "pending_count bigint, lag bigint"
    assert tuple(ev.peak_backlog(spark.createDataFrame([(3, 7), (9, None), (0, 2)], schema)).first()) == (9, 7)
    assert tuple(ev.peak_backlog(spark.createDataFrame([(0, None)], schema)).first()) == (0, None)
    assert tuple(ev.peak_backlog(spark.createDataFrame([], schema)).first()) == (0, None)


def event(ts, service="a"):
    return (service, "/x", 200, 1.0, ts)


def test_incident_labels(spark):
    incidents = spark.createDataFrame(
        [
            (1, "a", "/x", at("10:00:30"), at("10:01:30"), "latency_spike"),
            (2, "a", "/x", at("10:01:00"), at("10:03:00"), "error_burst"),
            (3, "b", "/x", at("10:00:00"), at("10:00:10"), "latency_spike"),
            (4, "c", "/x", at("10:05:00"), at("10:05:00"), "empty"),
        ],
        INCIDENT,
    )
    events = spark.createDataFrame(
        [
            event(at("10:00:29")), event(at("10:00:30")), event(at("10:00:59")),  # only the latter two are inside
            event(at("10:01:15")), event(at("10:01:45")),  # both incidents, then the second alone
            event(at("10:02:59")), event(at("10:03:00")),  # the end is outside
            event(at("10:00:10"), "b"), event(at("10:05:00"), "c"), event(at("10:00:30"), "d"),
        ],
        EVENT,
    )
    labels = label_incidents(events, incidents)
    got = sorted((r.minute_bucket.minute, r.service, r.seq, r.kind) for r in labels.collect())
    assert got == [(0, "a", 1, "latency_spike"), (1, "a", 1, "latency_spike"), (2, "a", 2, "error_burst")]
    assert label_keys(labels.unionAll(labels)).count() == 3


def test_incidents_across_wide_buckets(spark):
    incidents = spark.createDataFrame([(1, "a", "/x", at("00:10"), at("09:00"), "long")], INCIDENT)
    events = spark.createDataFrame([event(at(f"{h:02d}:30")) for h in range(12)], EVENT)
    got = label_incidents(events, incidents, 21600).collect()
    assert sorted(r.minute_bucket.hour for r in got) == [0, 6]


def test_report(spark, tmp_path):
    t, d = keys(spark, WARD[:2]), keys(spark, WARD[:1])
    stats = ev.latency_stats(samples(spark, range(1, 101)))
    backlog = ev.peak_backlog(spark.createDataFrame([(3, None)], "pending_count bigint, lag bigint"))
    processed = spark.createDataFrame([(30,)], "processed bigint")
    row = ev.report("steady", F.lit("2026-01-01T00:00:00+00:00"), stats, stats, ev.precision_recall(t, d),
                    ev.throughput_spread(ev.throughput_series(sends(spark, [0.1, 1.1]), 2)), backlog, processed, 15.0)
    assert row.count() == 1
    path = str(tmp_path / "report")
    ev.write_report(row, path)
    data = json.loads(spark.read.text(path).first().value)
    assert data["scenario_name"] == "steady" and data["detection"]["recall"] == 0.5
    assert data["processing"]["processed_per_sec"] == 2.0 and data["live_latency"]["p99_ms"] == 100.0


def test_long_incidents_are_few_rows(spark):
    """Events of every bucket around incidents of all lengths, against each event by itself; a year is below 100 rows."""
    rng = random.Random(8)
    events = [("a", "/x", 200, 1.0, minute(k) + timedelta(seconds=rng.randrange(60))) for k in range(0, 300) for _ in range(rng.randrange(3))]
    spans = [(n, minute(rng.randrange(280)) + timedelta(seconds=rng.randrange(60)), rng.randrange(1, 2 << rng.randrange(13))) for n in range(40)]
    incidents = [(n, "a", "/x", start, start + timedelta(seconds=long), f"k{n}") for n, start, long in spans]
    incidents += [(99, "b", "/x", minute(0), minute(300), "other"), (98, "a", "/x", minute(9), minute(9), "empty")]
    got = label_incidents(spark.createDataFrame(events, EVENT), spark.createDataFrame(incidents, INCIDENT))
    want = {}
    for *_, ts in events:
        for n, _, _, start, end, kind in incidents[:-2]:
            if start <= ts < end:
                bucket = ts.replace(second=0, tzinfo=None)
                want[bucket] = min(want.get(bucket, (n, kind)), (n, kind))
    assert {r.minute_bucket: (r.seq, r.kind) for r in got.collect()} == want and len(want) > 50
    year = spark.createDataFrame([(1, "a", "/x", minute(17), minute(17 + 525_600), "year")], INCIDENT)
    plan = covered(year, 60).collect()
    assert len(plan) < 100 and sum(1 if r.level is None else 2**r.level for r in plan) == 525_600
