import json

from conftest import at, minute

from minutewise.functions import messages as msg
from minutewise.schemas import ANOMALY, METRIC
from minutewise.streaming.detection import alert_outbox, anomaly_messages
from minutewise.streaming.live import SEQUENCE_STEP, with_sequence
from minutewise.streaming.progress import backlog, lag_messages, liveness, progress_table


def one(df, column="value"):
    return json.loads(df.first()[column])


def test_metric_point(spark):
    metrics = spark.createDataFrame([(minute(1), "a", "/x", 3, 1, 1.0, 2.0, 3.5)], METRIC)
    message = one(with_sequence(metrics, 2).select(msg.envelope(msg.metric_point()).alias("value")))
    assert list(message) == ["schema_version", "type", "sequence", "service", "endpoint", "minute_bucket", "request_count",
                             "error_count", "p50", "p95", "p99"]
    assert message["schema_version"] == 1 and message["type"] == "metric_point"
    assert message["sequence"] == 2 * SEQUENCE_STEP + 1
    assert message["minute_bucket"] == "2026-01-01T00:01:00+00:00" and message["p99"] == 3.5


def test_sequence_rises_per_series(spark):
    rows = [(minute(b), s, "/x", 1, 0, 1.0, 1.0, 1.0) for s in "ab" for b in range(3)]
    metrics = spark.createDataFrame(rows, METRIC)
    first = {(r.service, r.minute_bucket): r.sequence for r in with_sequence(metrics, 4).collect()}
    later = {(r.service, r.minute_bucket): r.sequence for r in with_sequence(metrics, 5).collect()}
    assert all(max(v for (s, _), v in first.items() if s == n) < min(v for (s, _), v in later.items() if s == n) for n in "ab")
    for name in "ab":
        in_order = [v for (s, _), v in sorted(first.items()) if s == name]
        assert in_order == sorted(set(in_order))


def test_anomaly_and_alert(spark):
    created = at("12:00:01").replace(microsecond=250000)
    found = spark.createDataFrame([(42, minute(0), "a", "/x", "zscore", "p95", 4.25, "why", created)], ANOMALY)
    message = one(anomaly_messages(found))
    assert message == {"schema_version": 1, "type": "anomaly", "id": 42, "service": "a", "endpoint": "/x",
                       "minute_bucket": "2026-01-01T00:00:00+00:00", "detector": "zscore", "score": 4.25, "reason": "why",
                       "created_at": "2026-01-01T12:00:01.250000+00:00"}
    payload = one(alert_outbox(found), "payload")
    assert payload == {"id": 42, "minute_bucket": "2026-01-01T00:00:00+00:00", "service": "a", "endpoint": "/x",
                       "detector": "zscore", "score": 4.25, "reason": "why"}


def test_lag_keeps_null(spark):
    rows = spark.createDataFrame([(42, 3, None)], "stream_length bigint, pending_count bigint, lag bigint")
    assert one(lag_messages(rows)) == {"schema_version": 1, "type": "lag", "stream_length": 42, "pending_count": 3, "lag": None}


def report(name, at_, rows, metrics=None, dropped=0):
    return json.dumps({
        "name": name, "timestamp": at_, "batchId": 1, "numInputRows": rows, "inputRowsPerSecond": 2.0,
        "processedRowsPerSecond": 3.0, "stateOperators": [{"numRowsTotal": 5, "numRowsDroppedByWatermark": dropped}],
        "sources": [{"metrics": metrics or {}}],
    })


def test_progress(spark):
    table = progress_table(spark, [
        report("m", "2026-01-01T00:00:00.000Z", 10, {"maxOffsetsBehindLatest": "30"}),
        report("m", "2026-01-01T00:00:05.000Z", 20, {"maxOffsetsBehindLatest": "120"}, 2),
        report("n", "2026-01-01T00:00:00.000Z", 1),
    ])
    assert {(r.name, r.state_rows, r.dropped_rows) for r in table.collect()} == {("m", 5, 0), ("m", 5, 2), ("n", 5, 0)}
    rows = backlog(table).orderBy("name", "at").collect()
    assert [(r.stream_length, r.pending_count, r.lag, r.backlog) for r in rows] == [
        (10, 30, 30, "warn"), (30, 120, 120, "error"), (1, 0, None, None)]
    from pyspark.sql import functions as F

    idle = {r.name: r.idle_ms for r in liveness(table, F.lit(minute(1))).collect()}
    assert idle == {"m": 55_000, "n": 60_000}


def test_no_progress_yet(spark):
    empty = progress_table(spark, [])
    assert empty.count() == 0 and backlog(empty).count() == 0 and liveness(empty).count() == 0
