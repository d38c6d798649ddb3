import json
import random
from datetime import date, datetime, timezone

import pytest
from conftest import minute
from pyspark.sql import functions as F

from minutewise.operators.detect import detect
from minutewise.operators.rollup import rollup
from minutewise.params import Params
from minutewise.schemas import EVENT, EVENT_WITH_ID, METRIC
from minutewise.sources import tables
from minutewise.sources.events import append_wire, parse_wire_events, read_wire, split_valid, stream_events, stream_json
from minutewise.streaming import detection, ingest, live
from minutewise.streaming.metrics import start_metrics
from minutewise.streaming.progress import progress_table

ONCE = {"availableNow": True}


class Run:
    """A log folder that gets files dropped in, and the queries that follow it."""

    def __init__(self, spark, home, params=Params(), dedupe=True):
        self.spark, self.home, self.params, self.dedupe = spark, str(home), params, dedupe

    def path(self, name):
        return f"{self.home}/{name}"

    def drop(self, rows):
        """rows: (event_id, seconds past midnight, latency) of series (a, /x), or full EVENT_WITH_ID rows."""
        full = [r if len(r) > 3 else (r[0], "a", "/x", 200, float(r[2]),
                                      datetime.fromtimestamp(minute(0).timestamp() + r[1], timezone.utc)) for r in rows]
        self.spark.createDataFrame(full, EVENT_WITH_ID).coalesce(1).write.mode("append").parquet(self.path("log"))

    def events(self):
        return stream_events(self.spark, self.path("log"), with_id=True)

    def close(self):
        q = start_metrics(self.events(), self.path("closed"), self.path("cp/m"), self.params, self.dedupe, ONCE)
        q.awaitTermination()
        return q

    def closed(self):
        return tables.read_metrics(self.spark, self.path("closed"))

    def publish(self):
        live.start_live(self.events(), self.path("feed"), self.path("cp/l"), self.params, ONCE).awaitTermination()

    def detect(self, **more):
        detection.start_detection(self.spark, self.path("closed"), self.path("found"), self.path("cp/d"),
                                  self.params, trigger=ONCE, **more).awaitTermination()


def short(df):
    return sorted((r.minute_bucket.hour * 60 + r.minute_bucket.minute, r.request_count, r.p50, round(r.p95, 6)) for r in df.collect())


def test_closed_late_and_duplicate_events(spark, tmp_path):
    run = Run(spark, tmp_path)
    run.drop([(1, 10, 10), (2, 50, 30), (1, 10, 10)])
    run.close()
    assert short(run.closed()) == []
    run.drop([(3, 310, 10)])
    run.close()
    assert short(run.closed()) == [(0, 2, 20.0, 29.0)]
    run.drop([(4, 20, 99)])  # after a restart, too late
    query = run.close()
    assert short(run.closed()) == [(0, 2, 20.0, 29.0)]
    progress = progress_table(spark, query.recentProgress).agg(F.sum("dropped_rows"), F.sum("input_rows")).first()
    assert tuple(progress) == (1, 1)

    # The repair reads the raw log again and never shrinks a count.
    log = spark.read.schema(EVENT_WITH_ID).parquet(run.path("log")).dropDuplicates(["event_id"])
    tables.repair(log, run.path("repaired"), [date(2026, 1, 1)], run.params)
    whole = tables.read_metrics(spark, run.path("closed"), run.path("repaired"))
    assert short(whole) == [(0, 3, 30.0, pytest.approx(92.1)), (5, 1, 10.0, 10.0)]
    ranged = tables.read_metrics(spark, run.path("closed"), run.path("repaired"), minute(1), minute(60))
    assert short(ranged) == [(5, 1, 10.0, 10.0)]
    tables.repair(log, run.path("repaired"), [], run.params)
    assert tables.read_metrics(spark, run.path("closed"), run.path("nowhere")).count() == 1


def test_restart_inside_an_open_bucket(spark, tmp_path):
    run = Run(spark, tmp_path)
    for i, (second, latency) in enumerate([(5, 10), (25, 20), (45, 30)]):
        run.drop([(i, second, latency)])
        run.close()  # each run is a restart
    run.drop([(9, 400, 1)])
    run.close()
    assert short(run.closed()) == [(0, 3, 20.0, 29.0)]


def random_log(seed, n=600):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        second = i * 12 + rng.randint(-60, 60)
        rows.append((i, rng.choice("aab"), "/x", rng.choice([200, 200, 500]), float(rng.randint(1, 40)),
                     datetime.fromtimestamp(minute(10).timestamp() + second, timezone.utc)))
    return rows


@pytest.mark.parametrize("params", [Params(), Params(hot_values=3)])
def test_stream_equals_batch(spark, tmp_path, params):
    run, rows = Run(spark, tmp_path, params), random_log(1)
    for start in range(0, len(rows), 150):
        run.drop(rows[start : start + 150])
        run.close()
    run.drop([(10**6, 10**6, 1)])  # far ahead: closes everything before it
    run.close()
    batch = rollup(spark.createDataFrame(rows, EVENT_WITH_ID))
    key = ["minute_bucket", "service", "endpoint"]
    assert run.closed().orderBy(key).collect() == batch.orderBy(key).collect()


def test_replayed_batch_replaces_its_rows(spark, tmp_path):
    metrics = spark.createDataFrame([(minute(0), "a", "/x", 1, 0, 1.0, 1.0, 1.0)], METRIC)
    for _ in range(2):
        tables.write_batch(metrics, str(tmp_path / "m"), 3)
    assert tables.read_metrics(spark, str(tmp_path / "m")).count() == 1
    assert tables.read_anomalies(spark, str(tmp_path / "none")).count() == 0


def dated(spark, path, batches):
    for batch, days in enumerate(batches):
        rows = [(minute(1440 * d + 5), "a", "/x", 10 + batch, 0, 1.0, 1.0, 1.0) for d in days]
        tables.write_batch(spark.createDataFrame(rows, METRIC), path, batch)


def test_a_range_opens_its_days_only(spark, tmp_path):
    path = str(tmp_path / "m")
    dated(spark, path, [range(0, 4), range(2, 9), [20]])
    some = tables.read_metrics(spark, path, start=minute(1440 * 3), end=minute(1440 * 5))
    assert sorted(r.minute_bucket.day for r in some.collect()) == [4, 4, 5]
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket_date" in plan


def test_compaction_moves_days_and_keeps_repairs(spark, tmp_path):
    live, daily = str(tmp_path / "m"), str(tmp_path / "d")
    dated(spark, live, [range(0, 3), [2], [6]])
    before = sorted(tables.read_metrics(spark, live).collect())
    repaired = spark.createDataFrame([(minute(1445), "a", "/x", 99, 0, 1.0, 1.0, 1.0)], METRIC)
    tables.write_metrics(repaired, daily)
    assert tables.compact_metrics(spark, live, daily, date(2026, 1, 5)) == [date(2026, 1, d) for d in (1, 2, 3)]
    after = sorted(tables.read_metrics(spark, live, daily).collect())
    assert [r if r.minute_bucket.day != 2 else None for r in after] == [r if r.minute_bucket.day != 2 else None for r in before]
    assert [r.request_count for r in after if r.minute_bucket.day == 2] == [99]
    # Once more changes nothing, and neither does losing the batch folders of the days that were moved.
    tables.compact_metrics(spark, live, daily, date(2026, 1, 5))
    assert sorted(tables.read_metrics(spark, live, daily).collect()) == after
    only_new = tables.read_metrics(spark, live, start=minute(1440 * 4))
    assert sorted(only_new.unionByName(tables.read_metrics(spark, str(tmp_path / "none"), daily)).collect()) == after


def test_repair_reads_runs_of_days():
    days = [date(2026, 1, 3), date(2026, 1, 1), date(2026, 1, 2), date(2027, 1, 1)]
    assert tables._spans(days) == [(date(2026, 1, 1), date(2026, 1, 3)), (date(2027, 1, 1), date(2027, 1, 1))]


def test_detection_touches_the_series_it_brings(spark, tmp_path, monkeypatch):
    run = Run(spark, tmp_path)
    past = spark.createDataFrame([steady(b, series=f"s{k}") for k in range(50) for b in range(40)], METRIC)
    seen = []
    real = detection.detect
    monkeypatch.setattr(detection, "detect", lambda m, p, earlier: (seen.append(m.count() + earlier.count()), real(m, p, earlier=earlier))[1])
    tables.write_batch(spark.createDataFrame([steady(41, series="s7")], METRIC), run.path("closed"), 0)
    run.detect(history=past)
    assert sum(seen) == 31  # one new bucket, and the thirty before it


def test_live_feed_drops_repeats_and_late_events(spark, tmp_path):
    run = Run(spark, tmp_path)
    start = lambda: live.start_live(
        run.events(), run.path("feed"), run.path("cp/l"), run.params, ONCE, dedupe=True
    ).awaitTermination()
    run.drop([(1, 10, 10), (1, 10, 10), (2, 50, 30)])
    start()
    run.drop([(3, 400, 5)])
    start()
    run.drop([(4, 20, 50), (5, 401, 7)])  # the first bucket is over by now
    start()
    run.drop([(6, 402, 9)])
    start()
    messages = [json.loads(r.value) for r in spark.read.text(run.path("feed")).collect()]
    shown = sorted((m["sequence"], m["minute_bucket"][11:16], m["request_count"]) for m in messages)
    assert [s[1:] for s in shown] == [("00:00", 2), ("00:06", 1), ("00:06", 2), ("00:06", 3)]
    # The state of a bucket that is over is gone; the open one's is still there.
    held = spark.read.format("statestore").option("path", run.path("cp/l")).option("operatorId", 0).option("stateVarName", "counts").load()
    assert {r.key.bucket for r in held.select("key").collect()} == {int(minute(6).timestamp() * 1e6)}


def test_live_feed_repeats_touched_buckets_in_full(spark, tmp_path):
    run = Run(spark, tmp_path)
    run.drop([(1, 10, 10), (2, 50, 30), (3, 70, 5)])
    run.publish()
    run.drop([(4, 20, 50), (5, 4000, 1)])  # an old bucket again, and one in another hour
    run.publish()
    messages = [json.loads(r.value) for r in spark.read.text(run.path("feed")).collect()]
    batches = sorted({m["sequence"] >> 32 for m in messages})
    shown = sorted((batches.index(m["sequence"] >> 32), m["minute_bucket"][11:16], m["request_count"], m["p50"]) for m in messages)
    assert shown == [(0, "00:00", 2, 20.0), (0, "00:01", 1, 5.0), (1, "00:00", 3, 30.0), (1, "01:06", 1, 1.0)]
    assert {m["type"] for m in messages} == {"metric_point"} and {m["schema_version"] for m in messages} == {1}


def steady(bucket, p95=None, series="a"):
    n = 100 + bucket % 5
    return (minute(bucket), series, "/x", n, 2 + bucket % 2, 50.0 + bucket % 3, p95 or 90.0 + bucket % 4, 110.0 + bucket % 3)


def test_detection_follows_closed_buckets(spark, tmp_path):
    params = Params()
    run = Run(spark, tmp_path, params)
    rows = [steady(b) for b in range(40)] + [steady(40, 2000.0), steady(41), steady(43, 1500.0)]
    rows += [steady(b, series="b") for b in range(0, 43, 3)]
    whole = detect(spark.createDataFrame(rows, METRIC), params)
    key = ["id", "minute_bucket", "service", "detector", "signal", "score", "reason"]

    run.detect()  # before anything is written
    rows.sort(key=lambda r: r[0])
    for batch, start in enumerate(range(0, len(rows), 11)):
        tables.write_batch(spark.createDataFrame(rows[start : start + 11], METRIC), run.path("closed"), batch)
        run.detect(outbox_path=run.path("outbox"), feed_path=run.path("alerts"))
    found = tables.read_anomalies(spark, run.path("found"))
    assert sorted(found.select(key).collect()) == sorted(whole.select(key).collect()) and found.count() >= 3

    # A metrics batch written once more shows up as new files; its buckets are known and found again by nobody.
    tables.write_batch(spark.createDataFrame(rows[-11:], METRIC), run.path("closed"), batch)
    run.detect(outbox_path=run.path("outbox"), feed_path=run.path("alerts"))
    assert tables.read_anomalies(spark, run.path("found")).count() == found.count()

    outbox = {r.id: json.loads(r.payload) for r in detection.read_outbox(spark, run.path("outbox")).collect()}
    assert set(outbox) == {r.id for r in found.collect()}
    assert {json.loads(r.value)["type"] for r in spark.read.text(run.path("alerts")).collect()} == {"anomaly"}


def test_one_of_many_series_is_touched(spark, tmp_path, monkeypatch):
    run = Run(spark, tmp_path, Params(series_ttl_seconds=3600))
    tables.write_batch(spark.range(10_000).select(
        F.lit(minute(0)).alias("minute_bucket"), F.concat(F.lit("s"), "id").alias("service"), F.lit("/x").alias("endpoint"),
        *[F.lit(v).cast(k).alias(c) for c, v, k in (("request_count", 5, "long"), ("error_count", 0, "long"), ("p50", 1, "double"), ("p95", 1, "double"), ("p99", 1, "double"))],
    ), run.path("closed"), 0)
    seen = []
    monkeypatch.setattr(detection, "detect", lambda m, p, earlier: (seen.append((m.count(), earlier.count())), detect(m, p, earlier=earlier))[1])
    run.detect()
    tables.write_batch(spark.createDataFrame([steady(1, series="s7")], METRIC), run.path("closed"), 1)
    run.detect()
    assert [s for s in seen if s != (0, 0)] == [(10_000, 0), (1, 1)]

    def remembered():
        held = spark.read.format("statestore").option("path", run.path("cp/d")).option("stateVarName", "tail").load()
        return {r.service for r in held.select("key.service").distinct().collect()}

    assert len(remembered()) == 10_000
    # An hour on, the series that brought nothing since are forgotten.
    tables.write_batch(spark.createDataFrame([steady(60 + k, series="s7") for k in (0, 9)], METRIC), run.path("closed"), 2)
    run.detect()
    assert remembered() == {"s7"}


def test_live_state_over_a_break_and_in_parts(spark, tmp_path):
    """A batch that breaks after its messages were written comes again as it was, however many parts a bucket has."""
    for parts in (1, 5):
        run = Run(spark, tmp_path / str(parts), Params(live_parts=parts))
        run.drop([(k, k % 50, k) for k in range(1, 40)])
        run.publish()
        run.drop([(50, 30, 7), (51, 31, 100)])
        broken = live.open_values(run.events(), run.params).writeStream.outputMode("append").option("checkpointLocation", run.path("cp/l"))
        query = broken.trigger(**ONCE).foreachBatch(lambda batch, n: (batch.count(), 1 / 0)).start()
        with pytest.raises(Exception):
            query.awaitTermination()
        run.publish()
        messages = [json.loads(r.value) for r in spark.read.text(run.path("feed")).collect()]
        assert sorted(m["request_count"] for m in messages) == [39, 41]
        assert max(m["p99"] for m in messages) > 70


def test_detection_starts_from_a_backfill(spark, tmp_path):
    run = Run(spark, tmp_path)
    past = spark.createDataFrame([steady(b) for b in range(30)], METRIC)
    spike = (minute(30), "a", "/x", 100, 90, 800.0, 2000.0, 3000.0)
    tables.write_batch(spark.createDataFrame([spike], METRIC), run.path("closed"), 0)
    run.detect(history=past)
    found = tables.read_anomalies(spark, run.path("found")).collect()
    assert {"zscore", "ewma", "isolation_forest"} == {r.detector for r in found}
    with pytest.raises(Exception):
        spark.read.parquet(run.path("outbox"))  # alerts are off unless asked for


def test_ingest_keeps_good_rows_and_sets_bad_ones_aside(spark, tmp_path):
    raw, table = str(tmp_path / "raw"), str(tmp_path / "table")
    good = {"service": "a", "endpoint": "/x", "status_code": 200, "latency_ms": 1.5, "ts": "2026-01-01T00:00:10Z"}
    lines = [json.dumps(good), json.dumps({**good, "status_code": "200"}), "{", json.dumps({**good, "ts": "2026-01-02"})]
    for part in (lines[:2], lines[2:]):
        spark.createDataFrame([(x,) for x in part], "value string").write.mode("append").text(raw)
        ingest.start_ingest(stream_json(spark, raw), table, str(tmp_path / "cp"), trigger=ONCE).awaitTermination()
    accepted = ingest.accepted_events(spark, table)
    assert accepted.columns == EVENT.fieldNames() and accepted.count() == 2
    assert ingest.accepted_events(spark, table, days=[date(2026, 1, 2)]).count() == 1
    rejected = {r.reject_reason: r.raw for r in ingest.rejected_events(spark, table).collect()}
    assert rejected == {"type status_code": lines[1], "malformed": "{"}

    # The table feeds the metrics query as a stream.
    closed = str(tmp_path / "closed")
    start_metrics(ingest.accepted_events(spark, table, stream=True), closed, str(tmp_path / "cp2"), trigger=ONCE).awaitTermination()
    assert short(tables.read_metrics(spark, closed)) == [(0, 1, 1.5, 1.5)]


def test_upsert_replaces_and_keeps(spark, tmp_path):
    path = str(tmp_path / "m")

    def put(*rows):
        tables.upsert_metrics(spark.createDataFrame([(minute(b), s, "/x", n, 0, 1.0, 1.0, 1.0) for b, s, n in rows], METRIC), path)

    put((0, "a", 5), (1, "a", 6), (2000, "a", 9))
    put((0, "a", 7), (0, "b", 1))  # a correction and a newcomer on the first day
    put((0, "b", 1))
    stored = tables.read_metrics(spark, str(tmp_path / "none"), path)
    got = sorted((r.service, r.minute_bucket.day, r.minute_bucket.minute, r.request_count) for r in stored.collect())
    assert got == [("a", 1, 0, 7), ("a", 1, 1, 6), ("a", 2, 20, 9), ("b", 1, 0, 1)]


def test_wire_log_batch_and_stream(spark, tmp_path):
    run, stream_log, batch_log = Run(spark, tmp_path), str(tmp_path / "wire"), str(tmp_path / "wire2")
    run.drop([(1, 10, 10.5), (2, 50, 30)])
    append_wire(run.events().drop("event_id"), stream_log, run.path("cp/w"), ONCE).awaitTermination()
    append_wire(spark.read.schema(EVENT).parquet(run.path("log")), batch_log)
    for log in (stream_log, batch_log):
        lines = spark.read.text(log)
        assert all(isinstance(v, str) for r in lines.collect() for v in json.loads(r.value).values())
        valid, rejects = split_valid(parse_wire_events(read_wire(lines, "value")))
        assert sorted(r.latency_ms for r in valid.collect()) == [10.5, 30.0] and rejects.count() == 0
