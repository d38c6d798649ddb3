import json
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from minutewise.sources.events import parse_json_events, parse_wire_events, split_valid, to_wire, to_wire_json

NOW = datetime(2026, 1, 1, 12, tzinfo=timezone.utc)
GOOD = {"service": "ledger", "endpoint": "/v2/entries", "status_code": 204, "latency_ms": 17.25,
        "ts": "2026-01-01T12:00:00Z"}


def verdicts(spark, lines):
    df = spark.createDataFrame([(i, line) for i, line in enumerate(lines)], "i int, raw string")
    rows = parse_json_events(df, as_of=F.lit(NOW)).select("*", F.unix_micros("ts").alias("us")).collect()
    return sorted(rows, key=lambda r: r.i)


def with_(**changes):
    return json.dumps({k: v for k, v in {**GOOD, **changes}.items() if v is not ...})


def test_valid_event(spark):
    row = verdicts(spark, [with_()])[0]
    assert row.reject_reason is None
    assert (row.service, row.endpoint, row.status_code, row.latency_ms) == ("ledger", "/v2/entries", 204, 17.25)
    assert row.us == int(NOW.timestamp() * 1e6)


REJECTED = {
    "range status_code": [with_(status_code=999), with_(status_code=99), with_(status_code=10**15)],
    "type status_code": [with_(status_code="200"), with_(status_code=200.0), with_(status_code=True),
                         with_(status_code=[1])],
    "missing service": [with_(service=...), with_(service=None)],
    "missing ts": [with_(ts=...)],
    "type service": [with_(service=5), with_(service={"a": 1})],
    "blank service": [with_(service="")],
    "blank endpoint": [with_(endpoint="")],
    "type latency_ms": [with_(latency_ms="42"), with_(latency_ms=True)],
    "range latency_ms": [with_(latency_ms=-1), with_().replace("17.25", "1e400"), with_(latency_ms=-0.001)],
    "type ts": [with_(ts="not-a-timestamp"), with_(ts="12:00"), with_(ts="2026"), with_(ts=True), with_(ts=1.5),
                with_(ts="2026-13-01T00:00:00"), with_(ts=10**18)],
    "future ts": [with_(ts="2026-01-01T13:00:00Z"), with_(ts="2026-01-01T12:01:00.000001Z")],
    "malformed": ["{", "", "null", "[1]", "5", with_().replace("17.25", "NaN"), with_()[:-3]],
}


@pytest.mark.parametrize("reason", REJECTED)
def test_rejected(spark, reason):
    assert {r.reject_reason for r in verdicts(spark, REJECTED[reason])} == {reason}


ACCEPTED = {
    with_(extra=[1, 2]): 0,
    with_(service=" "): 0,
    with_(latency_ms=0): 0,
    with_(latency_ms=5): 0,
    with_(status_code=100): 0,
    with_(status_code=599): 0,
    with_(ts="2026-01-01T12:01:00Z"): 60,
    with_(ts="2026-01-01T12:00:00"): 0,
    with_(ts="2026-01-01 12:00"): 0,
    with_(ts="2026-01-01"): -43200,
    with_(ts="2026-01-01T17:30:00+05:30"): 0,
    with_(ts="2025-01-01T12:00:00Z"): -365 * 86400,
    with_(ts=int(NOW.timestamp())): 0,
}


def test_accepted_and_in_utc(spark):
    rows = verdicts(spark, list(ACCEPTED))
    assert [r.reject_reason for r in rows] == [None] * len(rows)
    assert [r.us // 10**6 - int(NOW.timestamp()) for r in rows] == list(ACCEPTED.values())


def test_text_times_ignore_the_session_zone(spark):
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/New_York")
        assert verdicts(spark, [with_(ts="2026-01-01T12:00:00")])[0].us == int(NOW.timestamp() * 1e6)
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_split(spark):
    df = spark.createDataFrame([(with_(),), ("{",)], "raw string")
    valid, rejects = split_valid(parse_json_events(df, as_of=F.lit(NOW)))
    assert valid.columns == ["service", "endpoint", "status_code", "latency_ms", "ts"]
    assert valid.count() == 1
    assert [tuple(r) for r in rejects.collect()] == [("{", "malformed")]


WIRE = "service string, endpoint string, status_code string, latency_ms string, ts string"


@pytest.mark.parametrize(
    "change, reason",
    [
        ({}, None),
        ({"service": None}, "missing service"),
        ({"status_code": "not-a-number"}, "type status_code"),
        ({"status_code": "2_00"}, "type status_code"),
        ({"status_code": "999"}, "range status_code"),
        ({"ts": "not-a-timestamp"}, "type ts"),
        ({"ts": "12:00"}, "type ts"),
        ({"ts": "2026"}, "type ts"),
        ({"latency_ms": "nan"}, "type latency_ms"),
        ({"latency_ms": "inf"}, "type latency_ms"),
        ({"latency_ms": "1.5d"}, "type latency_ms"),
        ({"latency_ms": "1e400"}, "range latency_ms"),
        ({"latency_ms": "-1"}, "range latency_ms"),
        ({"latency_ms": " 1e2 "}, None),
    ],
)
def test_wire_entries(spark, change, reason):
    row = {"service": "a", "endpoint": "/x", "status_code": "200", "latency_ms": "42.5", "ts": "2026-01-01T12:00:00+00:00"}
    df = spark.createDataFrame([tuple({**row, **change}.values())], WIRE)
    out = parse_wire_events(df, as_of=F.lit(NOW)).first()
    assert out.reject_reason == reason
    if reason is None:
        assert out.status_code == 200 and out.latency_ms == (100.0 if change else 42.5)
    else:
        assert json.loads(out.raw).get("endpoint") == "/x"


def test_wire_round_trip(spark):
    df = spark.createDataFrame([(with_(ts="2026-01-01T11:59:59.250000Z"),)], "raw string")
    valid, _ = split_valid(parse_json_events(df, as_of=F.lit(NOW)))
    wire = to_wire(valid)
    assert wire.first().ts == "2026-01-01T11:59:59.250000+00:00"
    again, _ = split_valid(parse_wire_events(wire, as_of=F.lit(NOW)))
    assert again.collect() == valid.collect()
    assert json.loads(to_wire_json(valid).first().value)["status_code"] == "204"


def test_default_clock(spark):
    late = (datetime.now(timezone.utc) + timedelta(hours=1)).isoformat()
    soon = datetime.now(timezone.utc).isoformat()
    df = spark.createDataFrame([(0, with_(ts=late)), (1, with_(ts=soon))], "i int, raw string")
    assert [r.reject_reason for r in parse_json_events(df).orderBy("i").collect()] == ["future ts", None]
