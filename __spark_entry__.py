
from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.errors import StreamingQueryException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from minutewise.functions import forest
from minutewise.functions import messages as msg
from minutewise.operators import baselines, sketches
from minutewise.operators import detect as det
from minutewise.operators.dedupe import first_by_id, latest_points
from minutewise.operators.incidents import label_incidents, label_keys
from minutewise.operators.rollup import count_values, rollup, to_values
from minutewise.params import Params
from minutewise.plans import evaluation as ev
from minutewise.plans import summaries as sm
from minutewise.session import configure, cut, shared_folder
from minutewise.sources import events as src
from minutewise.sources import log, tables
from minutewise.sources.request_view import RAW_EVENTS, as_requests, request_events
from minutewise.streaming import detection as sdet
from minutewise.streaming import ingest, live, progress
from minutewise.streaming import metrics as smet

try:  # the training-data operators are an optional part
    from minutewise.llm import queries as llm
except ModuleNotFoundError as missing:
    if missing.name != "minutewise.llm":
        raise
    llm = None
try:
    import corpus_pipeline
except ModuleNotFoundError as missing:
    if missing.name not in ("corpus_pipeline", "minutewise.llm"):
        raise
    corpus_pipeline = None

SMOKE_DIR = "/root/testdata/sf0.001"

SIX_HOURS = Params(window_seconds=21600)
MINUTE = Params()
# Small bounds, so that test data takes the paths meant for very large groups.
SPLIT = Params(window_seconds=21600, hot_values=5, chunk_rows=40)
JANUARY = (datetime(2024, 1, 1), datetime(2024, 2, 1))
NOW = datetime(2024, 1, 31)
SINCE = datetime(2024, 1, 15)
ONCE = {"availableNow": True}
RUN_SECONDS = 720.0


# ---- shared inputs -------------------------------------------------------------------------------


def _requests(spark: SparkSession, d: str) -> DataFrame:
    return request_events(configure(spark), d)


def _metrics(spark: SparkSession, d: str, params: Params = SIX_HOURS) -> DataFrame:
    return rollup(_requests(spark, d), params)


def _stored_metrics(spark: SparkSession, d: str, params: Params = SIX_HOURS) -> DataFrame:
    """Detection reads its metrics more than once, so they are written first, as in production."""
    return cut(_metrics(spark, d, params))


def _statistical(spark: SparkSession, d: str) -> DataFrame:
    scores = det.scored(_stored_metrics(spark, d), SIX_HOURS, with_forest=False)
    return det.findings(scores, SIX_HOURS, F.col("minute_bucket") + F.expr("INTERVAL 6 HOURS"))


def _incidents(requests: DataFrame) -> DataFrame:
    """Per series and day, half an hour from the first slow server error on."""
    slow = requests.where("status_code >= 500 AND latency_ms >= 150")
    firsts = slow.groupBy("service", "endpoint", F.to_date("ts").alias("day")).agg(F.min("ts").alias("start"))
    return firsts.select(
        F.unix_micros("start").alias("seq"),
        "service",
        "endpoint",
        "start",
        (F.col("start") + F.expr("INTERVAL 30 MINUTES")).alias("end"),
        F.concat(F.lit("errors "), F.col("day").cast("string")).alias("kind"),
    )


def _truth(spark: SparkSession, d: str) -> DataFrame:
    requests = _requests(spark, d)
    return label_keys(label_incidents(requests, _incidents(requests), SIX_HOURS.window_seconds))


def _samples(spark: SparkSession, d: str) -> DataFrame:
    """Send samples: an hour of the log stands for a second of the run."""
    hours = (F.unix_micros("ts") - F.lit(1_704_067_200_000_000)) / F.lit(3_600_000_000.0)
    return _requests(spark, d).select("service", hours.alias("offset_s"), "latency_ms")


def _json_lines(spark: SparkSession, d: str) -> DataFrame:
    """The request log as JSON text, with every kind of fault seeded by event_id."""
    r = _requests(spark, d)

    def text(name: str) -> Column:
        return F.concat(F.lit('"'), F.col(name), F.lit('"'))

    fault = F.col("event_id") % 24
    stamp = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    service = F.when(fault == 4, "5").when(fault == 9, '""').otherwise(text("service"))
    status = F.col("status_code").cast("string")
    status = (
        F.when(fault == 1, F.concat(F.lit('"'), status, F.lit('"')))
        .when(fault == 2, F.concat(status, F.lit(".0")))
        .when(fault == 3, "true")
        .when(fault == 8, "999")
        .otherwise(status)
    )
    latency = F.col("latency_ms").cast("string")
    latency = (
        F.when(fault == 6, F.concat(F.lit('"'), latency, F.lit('"')))
        .when(fault == 7, "-1.5")
        .otherwise(latency)
    )
    stamp = (
        F.when(fault == 10, "2099-01-01T00:00:00Z").when(fault == 11, "12:00")
        .when(fault == 12, F.concat(stamp, F.lit("+00:00"))).otherwise(stamp)
    )
    endpoint = F.when(fault == 5, "").otherwise(F.concat(F.lit(', "endpoint": '), text("endpoint")))
    closing = F.when(fault == 0, "").when(fault == 13, ', "extra": [1]}').otherwise("}")
    return r.select(
        F.concat(
            F.lit('{"service": '), service, endpoint, F.lit(', "status_code": '), status,
            F.lit(', "latency_ms": '), latency, F.lit(', "ts": "'), stamp, F.lit('"'), closing,
        ).alias("raw")
    )


def _stream_requests(spark: SparkSession, d: str) -> DataFrame:
    # As a pattern, because a file stream takes a lone file only that way; it fits a directory as well.
    return as_requests(configure(spark).readStream.schema(RAW_EVENTS).parquet(f"{d}/events.parque[t]"))


def _finish(query) -> None:
    query.awaitTermination()


# ---- output forms --------------------------------------------------------------------------------


def _plain(df: DataFrame, digits: int = 6) -> DataFrame:
    """Timestamps without zone and doubles rounded, for comparison with the oracle."""
    out = []
    for name, kind in df.dtypes:
        c = F.col(name)
        if kind == "timestamp":
            c = c.cast("timestamp_ntz")
        elif kind == "double":
            c = F.round(c, digits)
        out.append(c.alias(name))
    return df.select(*out)


def _fields(df: DataFrame, column: str, kinds: dict[str, str]) -> DataFrame:
    """A JSON column taken apart again: its keys in order, then each field."""
    return df.select(
        F.array_join(F.json_object_keys(column), ",").alias("keys"),
        *[F.get_json_object(column, f"$.{name}").cast(kind).alias(name) for name, kind in kinds.items()],
    )


# ---- queries -------------------------------------------------------------------------------------


def entry(spark: SparkSession) -> DataFrame:
    """Services by total traffic and error rate over the whole log."""
    return services(spark, SMOKE_DIR)


def services(spark, d):
    return _plain(sm.tiles(sm.service_totals(_metrics(spark, d), *JANUARY)).orderBy("service"))


def service_detail(spark, d):
    return _detail(sm.service_detail(_metrics(spark, d), "svc1", *JANUARY, params=SIX_HOURS))


def service_detail_minutes(spark, d):
    """Sixty days by the minute: as long as a viewer may ask for."""
    return _detail(sm.service_detail(_metrics(spark, d, MINUTE), "svc1", datetime(2023, 12, 15), datetime(2024, 2, 13)))


def _detail(detail):
    point = F.transform(
        "series",
        lambda p: F.concat_ws(
            "|",
            F.date_format(p["minute_bucket"], "yyyy-MM-dd HH:mm"),
            p["request_count"].cast("string"),
            p["error_count"].cast("string"),
            F.round(p["p95"] * 10000).cast("bigint").cast("string"),
        ),
    )
    return _plain(detail.withColumn("series", F.array_join(point, ";")))


def progress_samples(spark, d):
    """Backlog samples taken hourly from the log: lag is unreported in hours without a 404."""
    hourly = _requests(spark, d).groupBy(F.date_trunc("hour", F.col("ts")).alias("at")).agg(
        F.count("*").alias("stream_length"),
        F.count_if(F.col("status_code") >= 500).alias("pending_count"),
        F.count_if(F.col("status_code") == 404).alias("missing"),
    )
    return hourly.withColumn("lag", F.nullif("missing", F.lit(0)))


def wire_events(spark, d):
    valid, _ = src.split_valid(src.parse_wire_events(src.to_wire(_requests(spark, d)), F.lit(NOW)))
    return _plain(valid)


def live_latest(spark, d):
    r = _requests(spark, d)
    points = r.select(
        F.window("ts", "6 hours")["start"].alias("minute_bucket"), "service", "endpoint",
        F.col("event_id").alias("sequence"), "status_code", "latency_ms",
    )
    return _plain(latest_points(points))


def _arrivals(spark, d):
    return _requests(spark, d).where("status_code >= 500").select(
        F.col("event_id").alias("id"), "service", "endpoint", "latency_ms", F.col("ts").alias("created_at")
    )


def first_arrivals(spark, d):
    r = _requests(spark, d).select(
        (F.col("latency_ms") * 100).cast("bigint").alias("id"), "event_id", "service", F.col("ts").alias("created_at")
    )
    return _plain(first_by_id(r))


def message_metric_point(spark, d):
    points = live.with_sequence(_metrics(spark, d), 7)
    kinds = {"schema_version": "int", "type": "string", "sequence": "bigint", "service": "string", "endpoint": "string",
             "minute_bucket": "string", "request_count": "bigint", "error_count": "bigint", "p50": "double",
             "p95": "double", "p99": "double"}
    return _plain(_fields(points.select(msg.envelope(msg.metric_point()).alias("value")), "value", kinds))


_FINDING_FIELDS = {"service": "string", "endpoint": "string", "minute_bucket": "string", "detector": "string",
                   "score": "double", "reason": "string"}


def message_anomaly(spark, d):
    kinds = {"schema_version": "int", "type": "string", **_FINDING_FIELDS, "created_at": "string"}
    return _plain(_fields(sdet.anomaly_messages(_statistical(spark, d)), "value", kinds))


def alert_outbox(spark, d):
    return _plain(_fields(sdet.alert_outbox(_statistical(spark, d)), "payload", _FINDING_FIELDS))


def message_lag(spark, d):
    kinds = {"schema_version": "int", "type": "string", "stream_length": "bigint", "pending_count": "bigint",
             "lag": "bigint"}
    return _fields(progress.lag_messages(progress_samples(spark, d)), "value", kinds)


def snapshot(spark, d):
    message = sm.snapshot(_metrics(spark, d, MINUTE), NOW)
    row = "array<struct<service:string,request_count:bigint,error_count:bigint,error_rate:double,last_seen:string>>"
    rows = message.select(
        F.get_json_object("message", "$.type").alias("type"),
        F.inline(F.from_json(F.get_json_object("message", "$.services"), row)),
    )
    return _plain(rows)


def run_report(spark, d):
    samples = cut(_samples(spark, d))
    metrics = _stored_metrics(spark, d)
    truth, found = _truth(spark, d), ev.flagged(_statistical(spark, d))
    stats = ev.latency_stats(samples)
    one = ev.report(
        "january", F.lit("2024-01-31T00:00:00+00:00"), stats, stats, ev.precision_recall(truth, found),
        ev.throughput_spread(ev.throughput_series(samples, RUN_SECONDS)), ev.peak_backlog(progress_samples(spark, d)),
        ev.processed_count(metrics, "svc1", "/api/1", SINCE), RUN_SECONDS,
    )
    return _plain(
        one.select(
            "scenario_name", "run_timestamp", "throughput_duration_seconds", "throughput_latency.*",
            "throughput_variance.*", F.col("live_latency.p95_ms").alias("live_p95_ms"), "detection.*", "operational.*",
            "processing.*",
        )
    )


def repaired_metrics(spark, d):
    """Live rows that lack half of the events, put right by a repair of the second half of the month."""
    home = shared_folder(configure(spark))
    requests = _requests(spark, d)
    tables.write_batch(rollup(requests.where("status_code <> 404"), SIX_HOURS), f"{home}/closed", 0)
    days = [datetime(2024, 1, n).date() for n in range(16, 32)]
    tables.repair(requests, f"{home}/repaired", days, SIX_HOURS)
    return _plain(tables.read_metrics(spark, f"{home}/closed", f"{home}/repaired"))


def upserted_metrics(spark, d):
    """A table of rows that lack the 404s, then corrected by an upsert of half the services."""
    home = shared_folder(configure(spark))
    requests = _requests(spark, d)
    tables.write_metrics(rollup(requests.where("status_code <> 404"), SIX_HOURS), f"{home}/metrics")
    # Each bucket is updated twice, and the later update holds.
    early = rollup(requests.where("status_code <> 404 OR event_id % 2 = 0"), SIX_HOURS).withColumn("batch_id", F.lit(1))
    late = rollup(requests, SIX_HOURS).withColumn("batch_id", F.lit(2))
    tables.upsert_metrics(early.unionByName(late).where("service >= 'svc2'"), f"{home}/metrics", order="batch_id")
    return _plain(tables.read_metrics(spark, f"{home}/none", f"{home}/metrics"))


def stream_ingest(spark, d):
    home = shared_folder(configure(spark))
    _json_lines(spark, d).withColumnRenamed("raw", "value").write.text(f"{home}/raw")
    _finish(ingest.start_ingest(src.stream_json(spark, f"{home}/raw"), f"{home}/table", f"{home}/cp", trigger=ONCE))
    rejected = ingest.rejected_events(spark, f"{home}/table").groupBy("reject_reason").agg(F.count("*").alias("n"))
    accepted = ingest.accepted_events(spark, f"{home}/table").agg(
        F.lit("accepted").alias("reject_reason"), F.count("*").alias("n")
    )
    return rejected.unionByName(accepted)


def stream_log(spark, d):
    """The append log: read in batches of a quarter, stopped, and read on from where it was after more came in."""
    home = shared_folder(configure(spark))
    lines = cut(_json_lines(spark, d))
    limit = max(lines.count() // 4, 1)
    for segment in range(3):
        log.append_segment(lines.where(F.pmod(F.xxhash64("raw"), F.lit(3)) == segment), f"{home}/log", segment)
        if segment:
            raw = log.stream_log(spark, f"{home}/log", "ingest", limit)
            query = ingest.start_ingest(raw, f"{home}/table", f"{home}/cp", trigger={"processingTime": "0 seconds"})
            query.processAllAvailable()
            query.stop()
    rejected = ingest.rejected_events(spark, f"{home}/table").groupBy("reject_reason").agg(F.count("*").alias("n"))
    accepted = ingest.accepted_events(spark, f"{home}/table").agg(F.lit("accepted").alias("reject_reason"), F.count("*").alias("n"))
    return rejected.unionByName(accepted)


def lag_feed(spark, d):
    """The lag messages of an ingest in eight batches, read from the feed."""
    home = shared_folder(configure(spark))
    lines = cut(_json_lines(spark, d))
    log.append_segment(lines, f"{home}/log", 0)
    limit = (lines.count() + 7) // 8
    feed = progress.LagFeed(spark, f"{home}/reports", f"{home}/log", "ingest", f"{home}/feed")
    spark.streams.addListener(feed)
    try:
        raw = log.stream_log(spark, f"{home}/log", "ingest", limit)
        query = ingest.start_ingest(raw, f"{home}/table", f"{home}/cp", trigger={"processingTime": "0 seconds"})
        query.processAllAvailable()
        query.stop()
        feed.settle(query.runId)
    finally:
        spark.streams.removeListener(feed)
    told = _fields(spark.read.text(f"{home}/feed"), "value", {"type": "string", "stream_length": "bigint", "pending_count": "bigint", "lag": "bigint"})
    # How much of the rows behind a message runs by its time is up to the clock.
    return told.select("type", "stream_length", "lag", F.col("pending_count").between(0, F.col("lag")).alias("bounded")).distinct()


def stream_metrics(spark, d):
    home = shared_folder(configure(spark))
    _finish(smet.start_metrics(_stream_requests(spark, d), f"{home}/closed", f"{home}/cp", SIX_HOURS, True, ONCE))
    return _plain(tables.read_metrics(spark, f"{home}/closed"))


def stream_live(spark, d):
    home = shared_folder(configure(spark))
    _finish(live.start_live(_stream_requests(spark, d), f"{home}/feed", f"{home}/cp", SIX_HOURS, ONCE))
    kinds = {"type": "string", "service": "string", "endpoint": "string", "minute_bucket": "string",
             "request_count": "bigint", "error_count": "bigint", "p95": "double"}
    return _plain(_fields(spark.read.text(f"{home}/feed"), "value", kinds)).drop("keys")


def stream_detection(spark, d):
    home = shared_folder(configure(spark))
    tables.write_batch(_metrics(spark, d), f"{home}/closed", 0)
    _finish(
        sdet.start_detection(spark, f"{home}/closed", f"{home}/anomalies", f"{home}/cp", SIX_HOURS,
                             outbox_path=f"{home}/outbox", trigger=ONCE)
    )
    found = tables.read_anomalies(spark, f"{home}/anomalies")
    return _plain(found.select("minute_bucket", "service", "endpoint", "detector", "signal", "score"))


def stream_outbox(spark, d):
    """What stream_detection leaves for the alert sender."""
    home = shared_folder(configure(spark))
    tables.write_batch(_metrics(spark, d), f"{home}/closed", 0)
    _finish(
        sdet.start_detection(spark, f"{home}/closed", f"{home}/anomalies", f"{home}/cp", SIX_HOURS,
                             outbox_path=f"{home}/outbox", trigger=ONCE)
    )
    alerts = _fields(sdet.read_outbox(spark, f"{home}/outbox"), "payload", _FINDING_FIELDS)
    return _plain(alerts)


def zscore_p95_stored(spark, d):
    """From a table by days: the second half of the month, with history from as few earlier days as hold it."""
    wanted, earlier = tables.read_since(spark, _daily_batches(spark, d), SINCE, SIX_HOURS.longest_history)
    return _plain(det.zscore(wanted, "p95", SIX_HOURS, earlier=earlier))


def _broken_detection(spark, d, home):
    """Metrics and detection at once, where no finding can be stored: a file stands in the way of their folder."""
    spark.createDataFrame([("in the way",)], "value string").coalesce(1).write.text(f"{home}/block")
    taken = spark.read.text(f"{home}/block").inputFiles()[0]
    closing = smet.start_metrics(_stream_requests(spark, d), f"{home}/closed", f"{home}/cp/m", SIX_HOURS, True, ONCE)
    _finish(closing)
    finding = sdet.start_detection(spark, f"{home}/closed", f"{taken}/anomalies", f"{home}/cp/d", SIX_HOURS, trigger=ONCE)
    try:
        _finish(finding)
    except StreamingQueryException:
        return
    raise AssertionError("detection was to fail")


def isolated_metrics(spark, d):
    """Closed metrics of a run in which detection fails: all of them."""
    home = shared_folder(configure(spark))
    _broken_detection(spark, d, home)
    return _plain(tables.read_metrics(spark, f"{home}/closed"))


def recovered_detection(spark, d):
    """What detection finds when it goes on, with its checkpoint, after it failed on a batch."""
    home = shared_folder(configure(spark))
    _broken_detection(spark, d, home)
    _finish(sdet.start_detection(spark, f"{home}/closed", f"{home}/anomalies", f"{home}/cp/d", SIX_HOURS, trigger=ONCE))
    found = tables.read_anomalies(spark, f"{home}/anomalies")
    names = F.when(F.col("detector") == "isolation_forest", "forest").otherwise("statistical").alias("kind")
    # A forest's finding has no SQL, but its bucket has a history.
    counts = F.count_if(F.col("detector") != "isolation_forest").alias("n"), F.min("score").isNotNull().alias("scored")
    return found.groupBy(names).agg(*counts)


def state_after_replay(spark, d):
    """The state of open buckets, read from the store, after a break between writing a batch and committing it."""
    home = shared_folder(configure(spark))

    def written_and_broken(batch, batch_id):
        batch.write.mode("overwrite").parquet(f"{home}/half/batch_id={batch_id}")
        raise RuntimeError("broken on purpose")

    values = smet.closed_values(_stream_requests(spark, d), SIX_HOURS)
    broken = values.writeStream.option("checkpointLocation", f"{home}/cp").trigger(**ONCE).foreachBatch(written_and_broken).start()
    try:
        _finish(broken)
    except StreamingQueryException:
        pass
    _finish(smet.start_metrics(_stream_requests(spark, d), f"{home}/closed", f"{home}/cp", SIX_HOURS, trigger=ONCE))
    held = spark.read.format("statestore").load(f"{home}/cp").select("key.*", "value.*")
    named = held.toDF("window", "service", "endpoint", "latency_ms", "n", "errors")
    return _plain(named.select(F.col("window.start").alias("minute_bucket"), *named.columns[1:]))


def stream_forest(spark, d):
    """Every bucket with enough history for a forest, and whether stream and batch say the same of it."""
    home = shared_folder(configure(spark))
    metrics = _stored_metrics(spark, d)
    for batch in range(2):
        tables.write_batch(metrics.where((F.col("minute_bucket") < F.lit(SINCE)) == F.lit(batch == 0)), f"{home}/closed", batch)
        _finish(sdet.start_detection(spark, f"{home}/closed", f"{home}/anomalies", f"{home}/cp", SIX_HOURS, trigger=ONCE))
    key = ["minute_bucket", "service", "endpoint"]
    streamed = tables.read_anomalies(spark, f"{home}/anomalies").where("detector = 'isolation_forest'").select(*key, F.col("score").alias("streamed"))
    told = det.scored(metrics, SIX_HOURS).select(*key, "forest")
    ready = det._with_history(metrics, SIX_HOURS, None, None, None).where(F.size("_forest_history") >= SIX_HOURS.forest_min_history).select(*key)
    met = told.join(streamed, key, "full").join(ready.withColumn("ready", F.lit(True)), key, "left")
    shown = met.where("ready OR forest IS NOT NULL OR streamed IS NOT NULL")
    return _plain(shown.select(*key, F.coalesce("ready", F.lit(False)).alias("eligible"), F.col("forest").eqNullSafe(F.col("streamed")).alias("same")))


def sketch_percentiles(spark, d):
    """Per service, from sketches of six hours put together: are the percentiles within 3 % of their rank?"""
    requests = _requests(spark, d)
    told = sketches.with_percentiles(sketches.merged(sketches.sketched(requests, SIX_HOURS), ["service"]))
    ranks = requests.join(told, "service").groupBy("service", "request_count", "error_count").agg(
        *[(F.count_if(F.col("latency_ms") <= F.col(c)) / F.count("*")).alias(c) for c in ("p50", "p95", "p99")],
        *[(F.count_if(F.col("latency_ms") < F.col(c)) / F.count("*")).alias(f"{c}_low") for c in ("p50", "p95", "p99")],
    )
    near = [((F.col(c) >= p - 0.03) & (F.col(f"{c}_low") <= p + 0.03)).alias(f"{c}_near") for c, p in (("p50", 0.5), ("p95", 0.95), ("p99", 0.99))]
    return ranks.select("service", "request_count", "error_count", *near)


def stream_backlog(spark, d):
    """More batches than Spark keeps reports of, one file each, all of them in the log of reports."""
    home = shared_folder(configure(spark))
    _json_lines(spark, d).withColumnRenamed("raw", "value").repartition(105).write.text(f"{home}/raw")
    log = progress.ProgressLog(spark, f"{home}/reports", every=50)
    spark.streams.addListener(log)
    try:
        raw = src.stream_json(spark, f"{home}/raw", max_files=1)
        query = ingest.start_ingest(raw, f"{home}/table", f"{home}/cp", trigger=ONCE)
        _finish(query)
        log.settle(query.runId)
    finally:
        spark.streams.removeListener(log)
    return log.read().groupBy("name").agg(
        F.sum("input_rows").alias("rows_in"), F.sum("dropped_rows").alias("dropped"),
        (F.countDistinct("batch_id") > 100).alias("over_100_batches"),
        F.sum("accepted").alias("accepted"), F.sum("rejected").alias("rejected"), F.sum("bytes").alias("bytes"),
    )


def _run_twice(spark, d, home, start):
    """Run a query, and again after late events: the first write lacks some early ones and repeats others, the second has them.

    A run takes all files of a write in one batch, so the writes, and the reads after them, are spread over tasks.
    """
    requests = _requests(spark, d)
    late = F.expr("event_id % 10 = 3 AND ts < TIMESTAMP '2024-01-10'")
    first = requests.where("ts < TIMESTAMP '2024-01-20'").where(~late)
    repeated = first.unionByName(first.where("event_id % 10 = 0"))
    for part in (repeated, requests.where(late | F.expr("ts >= TIMESTAMP '2024-01-20'"))):
        part.write.mode("append").parquet(f"{home}/log")
        _finish(start(src.stream_events(spark, f"{home}/log", with_id=True, max_files=2**31 - 1)))


def stream_metrics_late(spark, d):
    """Late and repeated events, and a restart in between."""
    home = shared_folder(configure(spark))
    _run_twice(spark, d, home, lambda e: smet.start_metrics(e, f"{home}/closed", f"{home}/cp", SIX_HOURS, True, ONCE))
    return _plain(tables.read_metrics(spark, f"{home}/closed"))


def stream_live_late(spark, d):
    """The last message of every bucket under the same input: late events change nothing, repeated ones count once."""
    home = shared_folder(configure(spark))
    _run_twice(spark, d, home, lambda e: live.start_live(e, f"{home}/feed", f"{home}/cp", SIX_HOURS, ONCE, dedupe=True))
    kinds = {"type": "string", "service": "string", "endpoint": "string", "minute_bucket": "string", "sequence": "bigint",
             "request_count": "bigint", "error_count": "bigint", "p95": "double"}
    shown = _plain(_fields(spark.read.text(f"{home}/feed"), "value", kinds)).drop("keys", "type")
    return latest_points(shown).drop("sequence")


def metrics_range(spark, d):
    """A range of a table of many batches; only the folders of its days are opened."""
    return _plain(tables.read_metrics(spark, _daily_batches(spark, d), start=datetime(2024, 1, 10), end=datetime(2024, 1, 20, 12)))


def compacted_metrics(spark, d):
    """The same table after its first half went to day files."""
    closed = _daily_batches(spark, d)
    tables.compact_metrics(spark, closed, f"{closed}-daily", datetime(2024, 1, 16).date())
    return _plain(tables.read_metrics(spark, closed, f"{closed}-daily"))


def _daily_batches(spark, d):
    home = shared_folder(configure(spark))
    metrics = _stored_metrics(spark, d)
    for batch in range(8):
        part = metrics.where(F.pmod(F.dayofmonth("minute_bucket"), F.lit(8)) == batch)
        tables.write_batch(part, f"{home}/closed", batch)
    return f"{home}/closed"


def _reports(spark, d):
    """Progress reports of one query per service: an hour of the log is a batch, and its 404s are still to be read."""
    return _requests(spark, d).groupBy(F.col("service").alias("name"), F.date_trunc("hour", F.col("ts")).alias("at")).agg(
        F.count("*").alias("input_rows"), F.nullif(F.count_if(F.col("status_code") == 404) * 15, F.lit(0)).alias("lag")
    ).withColumn("batch_id", F.unix_seconds("at"))


def anomaly_feed(spark, d):
    """The newest findings, where every other one arrived a second time a day later."""
    place = F.expr(
        "CAST(right(service, 1) AS INT) * 1000 + CAST(right(endpoint, 1) AS INT) * 100 + IF(detector = 'ewma', 10, 0) + IF(signal = 'p95', 1, 0)"
    )
    found = cut(_statistical(spark, d).withColumn("created_at", F.timestamp_micros(F.unix_micros("created_at") + place)))
    again = found.where("day(minute_bucket) % 2 = 0")
    repeated = again.withColumn("created_at", F.col("created_at") + F.expr("INTERVAL 1 DAY"))
    feed = sm.anomaly_feed(found.unionByName(repeated))
    return _plain(feed.select("minute_bucket", "service", "endpoint", "detector", "signal", "score", "created_at"))


def anomaly_reasons(spark, d):
    return _statistical(spark, d).select(F.col("minute_bucket").cast("timestamp_ntz").alias("minute_bucket"), "service", "endpoint", "detector", "signal", "reason")


def forest_windows(spark, d):
    """What each bucket's forest is grown on; flagged only where there is enough, with a score between -1 and 0."""
    metrics = _stored_metrics(spark, d)
    seen = det._with_history(metrics, SIX_HOURS, None, None, None)
    total = F.aggregate(F.flatten("_forest_history"), F.lit(0.0), lambda a, x: a + x)
    key = ["minute_bucket", "service", "endpoint"]
    windows = seen.select(*key, F.size("_forest_history").alias("rows"), F.round(total, 3).alias("feature_sum"))
    flags = windows.join(det.forest(metrics, SIX_HOURS), key, "left")
    enough = F.col("rows") >= SIX_HOURS.forest_min_history
    sound = F.col("score").isNull() | (enough & F.col("score").between(-1, 0))
    return _plain(flags.select(*key, "rows", enough.alias("eligible"), "feature_sum", sound.alias("sound")))


def fused_detectors(spark, d):
    """All findings of the fused detectors."""
    found = det.detect(_stored_metrics(spark, d), SIX_HOURS, created_at=F.lit(NOW))
    return _plain(found.select("minute_bucket", "service", "endpoint", "detector", "signal", "score"))


def stored_labels(spark, d):
    """Incidents and labels written, read back and joined."""
    home = shared_folder(configure(spark))
    requests = _requests(spark, d)
    _incidents(requests).write.parquet(f"{home}/incidents")
    incidents = tables.read_incidents(spark, f"{home}/incidents")
    label_keys(label_incidents(requests, incidents, SIX_HOURS.window_seconds)).write.json(f"{home}/labels")
    return _plain(tables.read_labels(spark, f"{home}/labels", "json"))


def page_bounds(spark, d):
    """Which pages may be asked for, with the services that the accepted ones hold."""
    totals = sm.service_totals(_metrics(spark, d), *JANUARY)
    rows = []
    for limit, offset in ((0, 0), (1, 0), (100, 0), (101, 0), (20, -1), (3, 4)):
        try:
            held, _ = sm.page(totals, ["service"], limit, offset)
            rows.append((limit, offset, True, held.count()))
        except ValueError:
            rows.append((limit, offset, False, 0))
    return spark.createDataFrame(rows, "page_limit int, page_offset int, accepted boolean, held bigint")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return (
        _telemetry_queries()
        | (llm.QUERIES if llm else {})
        | ({"pipeline": corpus_pipeline.run} if corpus_pipeline else {})
    )


def _telemetry_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "rollup_6h": lambda s, d: _plain(_metrics(s, d)),
        "rollup_1m": lambda s, d: _plain(_metrics(s, d, MINUTE)),
        "rollup_6h_split": lambda s, d: _plain(_metrics(s, d, SPLIT)),
        "value_counts": lambda s, d: _plain(count_values(to_values(_requests(s, d), 21600))),
        "wire_events": wire_events,
        "validated": lambda s, d: _plain(
            src.split_valid(src.parse_json_events(_json_lines(s, d), as_of=F.lit(NOW)))[0]
        ),
        "rejected_by_reason": lambda s, d: src.split_valid(
            src.parse_json_events(_json_lines(s, d), as_of=F.lit(NOW))
        )[1].groupBy("reject_reason").agg(F.count("*").alias("n")),
        "services": services,
        "services_error": lambda s, d: _plain(sm.service_totals(_metrics(s, d), *JANUARY, status="error")),
        "services_last_hour": lambda s, d: _plain(sm.service_totals(_metrics(s, d, MINUTE), now=NOW)),
        "endpoints": lambda s, d: _plain(
            sm.endpoint_totals(_metrics(s, d), None, *JANUARY).orderBy("service", "endpoint")
        ),
        "endpoints_healthy": lambda s, d: _plain(
            sm.endpoint_totals(_metrics(s, d, MINUTE), status="healthy", now=NOW)
        ),
        "endpoints_of_service": lambda s, d: _plain(sm.endpoint_totals(_metrics(s, d), "svc1", *JANUARY)),
        "services_page": lambda s, d: _plain(sm.services(_metrics(s, d), *JANUARY, limit=2, offset=1)[0]),
        "services_total": lambda s, d: sm.services(_metrics(s, d), *JANUARY, limit=2, offset=1)[1],
        "service_points": lambda s, d: _plain(sm.service_points(_metrics(s, d), "svc1", *JANUARY)),
        "service_detail": service_detail,
        "snapshot": snapshot,
        "zscore_p95": lambda s, d: _plain(det.zscore(_stored_metrics(s, d), "p95", SIX_HOURS)),
        "zscore_error_rate": lambda s, d: _plain(det.zscore(_stored_metrics(s, d), "error_rate", SIX_HOURS)),
        "ewma_p95": lambda s, d: _plain(det.ewma(_stored_metrics(s, d), "p95", SIX_HOURS)),
        "ewma_error_rate": lambda s, d: _plain(det.ewma(_stored_metrics(s, d), "error_rate", SIX_HOURS)),
        "anomalies_stat": lambda s, d: _plain(
            _statistical(s, d).select("minute_bucket", "service", "endpoint", "detector", "signal", "score")
        ),
        "zscore_p95_split": lambda s, d: _plain(det.zscore(_stored_metrics(s, d), "p95", SPLIT)),
        "zscore_p95_since": lambda s, d: _plain(det.zscore(_stored_metrics(s, d), "p95", SIX_HOURS, SINCE)),
        "threshold_error_rate": lambda s, d: _plain(baselines.threshold(_metrics(s, d), "error_rate", 0.25, 2)),
        "seasonal_p95": lambda s, d: _plain(baselines.seasonal(_stored_metrics(s, d), "p95", SIX_HOURS)),
        "sketch_percentiles": sketch_percentiles,
        "endpoints_after": lambda s, d: _plain(
            sm.page_after(sm.endpoint_totals(_metrics(s, d), None, *JANUARY), ["service", "endpoint"], ["svc1", "/api/0"], 5)
        ),
        "zscore_p95_stored": zscore_p95_stored,
        "isolated_metrics": isolated_metrics,
        "recovered_detection": recovered_detection,
        "state_after_replay": state_after_replay,
        "stream_forest": stream_forest,
        "anomalies_forest": lambda s, d: _plain(det.forest(_stored_metrics(s, d), SIX_HOURS)),
        "anomalies_fused": lambda s, d: _plain(
            det.detect(_stored_metrics(s, d), SIX_HOURS, created_at=F.lit(NOW))
        ),
        "distinct_flagged": lambda s, d: _plain(ev.flagged(_statistical(s, d), SINCE)),
        "incident_labels": lambda s, d: _plain(
            label_incidents(_requests(s, d), _incidents(_requests(s, d)), SIX_HOURS.window_seconds)
        ),
        "confusion": lambda s, d: _plain(ev.confusion(_truth(s, d), ev.flagged(_statistical(s, d)))),
        "true_positives": lambda s, d: _plain(ev.true_positives(_truth(s, d), ev.flagged(_statistical(s, d)))),
        "false_positives": lambda s, d: _plain(ev.false_positives(_truth(s, d), ev.flagged(_statistical(s, d)))),
        "false_negatives": lambda s, d: _plain(ev.false_negatives(_truth(s, d), ev.flagged(_statistical(s, d)))),
        "precision_recall": lambda s, d: _plain(
            ev.precision_recall(_truth(s, d), ev.flagged(_statistical(s, d)))
        ),
        "latency_stats": lambda s, d: _plain(ev.latency_stats(_samples(s, d))),
        "latency_stats_split": lambda s, d: _plain(ev.latency_stats(_samples(s, d), params=SPLIT)),
        "latency_stats_by_service": lambda s, d: _plain(ev.latency_stats(_samples(s, d), ["service"])),
        "throughput_series": lambda s, d: ev.throughput_series(_samples(s, d), RUN_SECONDS),
        "throughput_spread": lambda s, d: _plain(
            ev.throughput_spread(ev.throughput_series(_samples(s, d), RUN_SECONDS))
        ),
        "processed_count": lambda s, d: ev.processed_count(_metrics(s, d), "svc1", "/api/1", SINCE),
        "peak_backlog": lambda s, d: ev.peak_backlog(progress_samples(s, d)),
        "live_latest": live_latest,
        "first_arrivals": first_arrivals,
        "anomaly_feed": anomaly_feed,
        "message_metric_point": message_metric_point,
        "message_anomaly": message_anomaly,
        "message_lag": message_lag,
        "alert_outbox": alert_outbox,
        "run_report": run_report,
        "repaired_metrics": repaired_metrics,
        "upserted_metrics": upserted_metrics,
        "stream_ingest": stream_ingest,
        "stream_log": stream_log,
        "lag_feed": lag_feed,
        "stream_metrics": stream_metrics,
        "stream_live": stream_live,
        "stream_detection": stream_detection,
        "stream_backlog": stream_backlog,
        "stream_outbox": stream_outbox,
        "stream_metrics_late": stream_metrics_late,
        "stream_live_late": stream_live_late,
        "service_detail_minutes": service_detail_minutes,
        "metrics_range": metrics_range,
        "compacted_metrics": compacted_metrics,
        "backlog_levels": lambda s, d: _plain(progress.backlog(_reports(s, d))),
        "liveness": lambda s, d: progress.liveness(_reports(s, d), F.lit(NOW)),
        "anomaly_reasons": anomaly_reasons,
        "forest_windows": forest_windows,
        "fused_detectors": fused_detectors,
        "stored_labels": stored_labels,
        "page_bounds": page_bounds,
    }


# ---- oracle --------------------------------------------------------------------------------------

_REQ = """req AS (
  SELECT event_id, 'svc' || (user_id % 5) AS service,
         '/api/' || (CAST(json_extract_string(props, '$.k') AS INTEGER) % 3) AS endpoint,
         CASE event_type WHEN 'error' THEN 500 WHEN 'signup' THEN 201 WHEN 'purchase' THEN 404 ELSE 200 END AS status_code,
         value AS latency_ms, ts
  FROM events)"""


def _m(source: str = "req", width: str = "6 hours", name: str = "m") -> str:
    return f"""{name} AS (
  SELECT time_bucket(INTERVAL '{width}', ts, TIMESTAMP '1970-01-01') AS minute_bucket, service, endpoint,
         count(*) AS request_count, count(*) FILTER (WHERE status_code >= 500) AS error_count,
         quantile_cont(latency_ms, 0.5::DOUBLE) AS p50, quantile_cont(latency_ms, 0.95::DOUBLE) AS p95,
         quantile_cont(latency_ms, 0.99::DOUBLE) AS p99
  FROM {source} GROUP BY ALL)"""


_METRIC_OUT = """minute_bucket, service, endpoint, request_count, error_count,
  round(p50, 6) AS p50, round(p95, 6) AS p95, round(p99, 6) AS p99"""

_TOTALS = """CAST(sum(request_count) AS BIGINT) AS request_count, CAST(sum(error_count) AS BIGINT) AS error_count,
  max(minute_bucket) AS last_seen, round(sum(error_count) / sum(request_count), 6) AS error_rate"""

_LAST_HOUR = "minute_bucket >= TIMESTAMP '2024-01-30 23:00:00' AND minute_bucket < TIMESTAMP '2024-01-31'"


def _hist() -> str:
    """The four statistical scores; the EWMA weights hold because a usable window has exactly ten rows."""
    parts = []
    for s in ("p95", "error_rate"):
        parts.append(f"list({s}) OVER w AS h_{s}, avg({s}) OVER w AS mean_{s}, stddev_samp({s}) OVER w AS dev_{s}")
    base = f"""r AS (SELECT *, error_count / request_count AS error_rate FROM m),
h AS (SELECT *, count(*) OVER w AS n, {', '.join(parts)} FROM r
      WINDOW w AS (PARTITION BY service, endpoint ORDER BY minute_bucket ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING)),
k AS (SELECT *, [pow(0.7, 9), 0.3 * pow(0.7, 8), 0.3 * pow(0.7, 7), 0.3 * pow(0.7, 6), 0.3 * pow(0.7, 5),
                 0.3 * pow(0.7, 4), 0.3 * pow(0.7, 3), 0.3 * pow(0.7, 2), 0.3 * 0.7::DOUBLE, 0.3::DOUBLE] AS wt
      FROM h WHERE n = 10)"""
    for s in ("p95", "error_rate"):
        base += f""",
e_{s} AS (SELECT *, list_dot_product(h_{s}, wt) AS em FROM k WHERE list_min(h_{s}) < list_max(h_{s})),
f_{s} AS (SELECT *, list_dot_product(list_transform(h_{s}, lambda x: (x - em) * (x - em)), wt) AS ev FROM e_{s}),
ewma_{s} AS (SELECT minute_bucket, service, endpoint, ({s} - em) / sqrt(ev) AS score FROM f_{s}
             WHERE abs(({s} - em) / sqrt(ev)) >= 3),
zscore_{s} AS (SELECT minute_bucket, service, endpoint, ({s} - mean_{s}) / dev_{s} AS score FROM k
               WHERE list_min(h_{s}) < list_max(h_{s}) AND abs(({s} - mean_{s}) / dev_{s}) >= 3)"""
    union = " UNION ALL ".join(
        f"SELECT minute_bucket, service, endpoint, '{k}' AS detector, '{s}' AS signal, score FROM {k}_{s}"
        for k in ("zscore", "ewma") for s in ("p95", "error_rate")
    )
    return f"{base}, stat AS ({union}), flagged AS (SELECT DISTINCT minute_bucket, service, endpoint FROM stat)"


_INC = """firsts AS (SELECT service, endpoint, CAST(ts AS DATE) AS day, min(ts) AS start FROM req
  WHERE status_code >= 500 AND latency_ms >= 150 GROUP BY ALL),
inc AS (SELECT epoch_us(start) AS seq, service, endpoint, start, start + INTERVAL 30 MINUTE AS stop,
  'errors ' || CAST(day AS VARCHAR) AS kind FROM firsts),
hit AS (SELECT time_bucket(INTERVAL '6 hours', ts, TIMESTAMP '1970-01-01') AS minute_bucket, q.service, q.endpoint,
  seq, kind, start FROM req q JOIN inc i ON q.service = i.service AND q.endpoint = i.endpoint
  AND q.ts >= i.start AND q.ts < i.stop),
truth AS (SELECT DISTINCT minute_bucket, service, endpoint FROM hit)"""

_SAMPLES = """samples AS (SELECT service, (epoch_us(ts) - 1704067200000000) / 3600000000.0::DOUBLE AS offset_s, latency_ms
  FROM req)"""

_SERIES = """series AS (
  SELECT second, coalesce(n, 0) AS sent FROM (SELECT unnest(generate_series(0, 719)) AS second) g LEFT JOIN
  (SELECT least(CAST(trunc(offset_s) AS BIGINT), 719) AS second, count(*) AS n FROM samples
   WHERE CAST(trunc(offset_s) AS BIGINT) >= 0 GROUP BY 1) c USING (second))"""


def _stats(by: str) -> str:
    over = f"PARTITION BY {by}" if by else ""
    group = f"{by}, " if by else ""
    tail = f"GROUP BY {by}" if by else ""
    at = ", ".join(
        f"round(max(latency_ms) FILTER (WHERE rn = least(CAST(floor(n * {p}::DOUBLE) AS BIGINT), n - 1)), 6) AS {name}"
        for name, p in (("p50_ms", 0.5), ("p95_ms", 0.95), ("p99_ms", 0.99))
    )
    return f"""stats AS (SELECT {group}count(*) AS count, round(avg(latency_ms), 6) AS avg_ms, {at}
  FROM (SELECT *, row_number() OVER ({over} ORDER BY latency_ms) - 1 AS rn, count(*) OVER ({over}) AS n FROM samples)
  {tail})"""


_BACKLOG = """hourly AS (SELECT date_trunc('hour', ts) AS at, count(*) AS stream_length,
  count(*) FILTER (WHERE status_code >= 500) AS pending_count,
  nullif(count(*) FILTER (WHERE status_code = 404), 0) AS lag FROM req GROUP BY 1)"""

_HOURLY = """hours AS (SELECT service AS name, date_trunc('hour', ts) AS "at", count(*) AS n,
  nullif(count(*) FILTER (WHERE status_code = 404) * 15, 0) AS lag FROM req GROUP BY 1, 2)"""

_JSON = """parts AS (SELECT *, event_id % 24 AS fault, strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') AS stamp FROM req),
j AS (SELECT '{"service": ' || CASE fault WHEN 4 THEN '5' WHEN 9 THEN '""' ELSE '"' || service || '"' END
  || CASE fault WHEN 5 THEN '' ELSE ', "endpoint": "' || endpoint || '"' END
  || ', "status_code": ' || CASE fault WHEN 1 THEN '"' || status_code || '"' WHEN 2 THEN status_code || '.0'
       WHEN 3 THEN 'true' WHEN 8 THEN '999' ELSE CAST(status_code AS VARCHAR) END
  || ', "latency_ms": ' || CASE fault WHEN 6 THEN '"' || latency_ms || '"' WHEN 7 THEN '-1.5'
       ELSE CAST(latency_ms AS VARCHAR) END
  || ', "ts": "' || CASE fault WHEN 10 THEN '2099-01-01T00:00:00Z' WHEN 11 THEN '12:00'
       WHEN 12 THEN stamp || '+00:00' ELSE stamp END || '"'
  || CASE fault WHEN 0 THEN '' WHEN 13 THEN ', "extra": [1]}' ELSE '}' END AS raw FROM parts),
ok AS (SELECT raw FROM j WHERE json_valid(raw)),
t AS (SELECT raw, json_type(raw, '$.service') AS ks, json_type(raw, '$.endpoint') AS ke,
  json_type(raw, '$.status_code') AS kc, json_type(raw, '$.latency_ms') AS kl,
  json_extract_string(raw, '$.service') AS service, json_extract_string(raw, '$.endpoint') AS endpoint,
  json_extract_string(raw, '$.status_code') AS c, json_extract_string(raw, '$.latency_ms') AS l,
  json_extract_string(raw, '$.ts') AS x FROM ok),
judged AS (SELECT *, CASE WHEN ke IS NULL THEN 'missing endpoint' WHEN ks <> 'VARCHAR' THEN 'type service'
  WHEN length(service) < 1 THEN 'blank service' WHEN kc NOT IN ('UBIGINT', 'BIGINT') THEN 'type status_code'
  WHEN CAST(c AS INTEGER) NOT BETWEEN 100 AND 599 THEN 'range status_code'
  WHEN kl NOT IN ('UBIGINT', 'BIGINT', 'DOUBLE') THEN 'type latency_ms'
  WHEN CAST(l AS DOUBLE) < 0 THEN 'range latency_ms' WHEN length(x) < 10 THEN 'type ts'
  WHEN x[1:4] > '2024' THEN 'future ts' END AS reject_reason FROM t),
verdict AS (SELECT reject_reason FROM judged WHERE reject_reason IS NOT NULL
  UNION ALL SELECT 'malformed' FROM j WHERE NOT json_valid(raw))"""


_DETAIL = """SELECT e.*, s.* FROM (
  SELECT service, endpoint, CAST(sum(request_count) AS BIGINT) AS request_count,
    CAST(sum(error_count) AS BIGINT) AS error_count, round(sum(error_count) / sum(request_count), 6) AS error_rate,
    string_agg(concat_ws('|', strftime(minute_bucket, '%Y-%m-%d %H:%M'), request_count, error_count,
      CAST(round(p95 * 10000) AS BIGINT)), ';' ORDER BY minute_bucket) AS series
  FROM m WHERE service = 'svc1' GROUP BY service, endpoint) e,
  (SELECT CAST(sum(request_count) AS BIGINT) AS service_request_count,
    CAST(sum(error_count) AS BIGINT) AS service_error_count,
    round(sum(error_count) / sum(request_count), 6) AS service_error_rate FROM m WHERE service = 'svc1') s"""


def _reason(detector: str, signal: str) -> str:
    """The reason text, decimals rounded half up as written."""
    baseline = "the 10-bucket baseline" if detector == "zscore" else "the EWMA baseline (alpha=0.3)"
    value, digits = ("p95 latency ' || {} || 'ms", 1) if signal == "p95" else ("error rate ' || {} || '", 3)
    shown = value.format(f"CAST(CAST(CAST({signal} AS VARCHAR) AS DECIMAL(18, {digits})) AS VARCHAR)")
    score = "CAST(CAST(CAST(s.score AS VARCHAR) AS DECIMAL(18, 2)) AS VARCHAR)"
    return f"'{shown} is ' || {score} || ' std devs from {baseline}'"


_REASONS = "reasons AS (SELECT s.*, CASE " + " ".join(
    f"WHEN s.detector = '{k}' AND s.signal = '{x}' THEN {_reason(k, x)}" for k in ("zscore", "ewma") for x in ("p95", "error_rate")
) + """ END AS reason FROM stat s JOIN r ON s.minute_bucket = r.minute_bucket AND s.service = r.service
  AND s.endpoint = r.endpoint)"""

def _forest() -> str:
    """The forest of every bucket with thirty before it, grown again in SQL from the same draws: its score where it is flagged."""
    trees, depth = forest.TREES, 5
    _, limit, _, preferred, position = forest._draws(SIX_HOURS.forest_min_history, 5)
    assert limit == depth and SIX_HOURS.forest_min_history == SIX_HOURS.longest_history == 30
    slots = ", ".join(
        f"({level}, {tree}, {node}, [{', '.join(str(f + 1) for f in preferred[level, tree * 2**depth + node])}], {position[level, tree * 2**depth + node]:.17e})"
        for level in range(depth) for tree in range(trees) for node in range(2**level)
    )
    path = f"CASE WHEN {{n}} <= 1 THEN 0.0::DOUBLE WHEN {{n}} = 2 THEN 1.0::DOUBLE ELSE 2 * (ln({{n}} - 1) + {forest.EULER_GAMMA:.17e}) - 2 * ({{n}} - 1)::DOUBLE / {{n}} END"
    features = "[request_count::DOUBLE, error_rate::DOUBLE, p50, p95, p99]"
    steps = [f"""slots(level, tree, node, tried, position) AS MATERIALIZED (VALUES {slots}),
fw AS MATERIALIZED (SELECT row_number() OVER () AS id, * FROM (SELECT minute_bucket, service, endpoint, {features} AS x, list({features}) OVER w AS h,
  count(*) OVER w AS n FROM r WINDOW w AS (PARTITION BY service, endpoint ORDER BY minute_bucket ROWS BETWEEN 30 PRECEDING AND 1 PRECEDING)) WHERE n = 30),
fp AS MATERIALIZED (SELECT id, unnest(range(31)) AS p, unnest(list_append(h, x)) AS x FROM fw),
fa0 AS MATERIALIZED (SELECT id, p, x, tree, 0 AS node FROM fp, (SELECT unnest(range({trees})) AS tree))"""]
    for level in range(depth + 1):
        ends = ", ".join(f"{f}(x[{k}]) FILTER (p < 30)" for f in ("min",) for k in range(1, 6)), ", ".join(f"max(x[{k}]) FILTER (p < 30)" for k in range(1, 6))
        steps.append(f"""fg{level} AS MATERIALIZED (SELECT id, tree, node, count(*) FILTER (p < 30) AS size, [{ends[0]}] AS low, [{ends[1]}] AS high
  FROM fa{level} GROUP BY ALL)""")
        if level == depth:
            steps.append(f"fd{level} AS MATERIALIZED (SELECT id, p, {level} + {path.format(n='size')} AS depth FROM fa{level} JOIN fg{level} USING (id, tree, node))")
            break
        steps.append(f"""fc{level} AS MATERIALIZED (SELECT id, tree, node, size, f, CASE WHEN low[f] + position * (high[f] - low[f]) < high[f]
    THEN low[f] + position * (high[f] - low[f]) ELSE low[f] END AS cut
  FROM (SELECT g.*, position, CASE WHEN size > 1 THEN list_filter(tried, lambda k: high[k] > low[k])[1] END AS f
    FROM fg{level} g JOIN slots s ON s.level = {level} AND s.tree = g.tree AND s.node = g.node))""")
        steps.append(f"fd{level} AS MATERIALIZED (SELECT id, p, {level} + {path.format(n='size')} AS depth FROM fa{level} JOIN fc{level} USING (id, tree, node) WHERE f IS NULL)")
        steps.append(f"""fa{level + 1} AS MATERIALIZED (SELECT id, p, x, tree, node * 2 + CASE WHEN x[f] > cut THEN 1 ELSE 0 END AS node
  FROM fa{level} JOIN fc{level} USING (id, tree, node) WHERE f IS NOT NULL)""")
    every = " UNION ALL ".join(f"SELECT * FROM fd{level}" for level in range(depth + 1))
    steps.append(f"""fs AS MATERIALIZED (SELECT id, p, -pow(2.0::DOUBLE, -(sum(depth) / {trees}) / ({path.format(n=30)})) AS score FROM ({every}) GROUP BY id, p),
fo AS MATERIALIZED (SELECT id, quantile_cont(score, {SIX_HOURS.contamination}::DOUBLE) FILTER (p < 30) AS least, max(score) FILTER (p = 30) AS score FROM fs GROUP BY id),
forest AS MATERIALIZED (SELECT minute_bucket, service, endpoint, fo.score FROM fo JOIN fw USING (id) WHERE round(fo.score, 12) < round(least, 12)),
found AS MATERIALIZED (SELECT * FROM stat UNION ALL SELECT minute_bucket, service, endpoint, 'isolation_forest', 'multivariate', score FROM forest)""")
    return ",\n".join(steps)


# The log without the events that come late, for the queries whose input has some.
_ON_TIME = "ontime AS (SELECT * FROM req WHERE NOT (event_id % 10 = 3 AND ts < TIMESTAMP '2024-01-10'))"


def _with(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


def oracle_sql() -> dict[str, str]:
    return _telemetry_sql() | (llm.ORACLE_SQL if llm else {})


def _telemetry_sql() -> dict[str, str]:
    m, m1 = _with(_REQ, _m()), _with(_REQ, _m(width="1 minute"))
    hist = _with(_REQ, _m(), _hist())
    whole = _with(_REQ, _m(), _hist(), _forest())
    judge = _with(_REQ, _m(), _hist(), _INC)
    key = "minute_bucket, service, endpoint"
    score = f"SELECT {key}, round(score, 6) AS score FROM"
    iso = "strftime(minute_bucket, '%Y-%m-%dT%H:%M:%S+00:00') AS minute_bucket"
    pr = """SELECT tp AS true_positives, fp AS false_positives, fn AS false_negatives,
  round(CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0.0 END, 6) AS precision,
  round(CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0.0 END, 6) AS recall
  FROM (SELECT (SELECT count(*) FROM (SELECT * FROM truth INTERSECT SELECT * FROM flagged)) AS tp,
               (SELECT count(*) FROM (SELECT * FROM flagged EXCEPT SELECT * FROM truth)) AS fp,
               (SELECT count(*) FROM (SELECT * FROM truth EXCEPT SELECT * FROM flagged)) AS fn)"""
    processed = """SELECT CAST(coalesce(sum(request_count), 0) AS BIGINT) AS processed FROM m WHERE service = 'svc1'
  AND endpoint = '/api/1' AND minute_bucket >= TIMESTAMP '2024-01-14 23:59:00'"""
    reasons = _with(_REQ, _m(), _hist(), _REASONS)
    finding_fields = f"service, endpoint, {iso}, detector, round(score, 6) AS score"
    outbox = f"""SELECT 'id,minute_bucket,service,endpoint,detector,score,reason' AS keys, {finding_fields}, reason
  FROM reasons"""
    return {
        "rollup_6h": m + f"SELECT {_METRIC_OUT} FROM m",
        "rollup_1m": m1 + f"SELECT {_METRIC_OUT} FROM m",
        "rollup_6h_split": m + f"SELECT {_METRIC_OUT} FROM m",
        "value_counts": _with(_REQ) + """SELECT time_bucket(INTERVAL '6 hours', ts, TIMESTAMP '1970-01-01') AS minute_bucket,
  service, endpoint, latency_ms, count(*) AS n, count(*) FILTER (WHERE status_code >= 500) AS errors
  FROM req GROUP BY 1, 2, 3, 4""",
        "wire_events": _with(_REQ) + "SELECT service, endpoint, status_code, latency_ms, ts FROM req",
        "validated": _with(_REQ, _JSON) + """SELECT service, endpoint, CAST(c AS INTEGER) AS status_code,
  CAST(l AS DOUBLE) AS latency_ms, CAST(x[1:26] AS TIMESTAMP) AS ts FROM judged WHERE reject_reason IS NULL""",
        "rejected_by_reason": _with(_REQ, _JSON) + "SELECT reject_reason, count(*) AS n FROM verdict GROUP BY 1",
        "services": m + f"""SELECT *, CASE WHEN error_rate >= 0.1 THEN 'error' WHEN error_rate >= 0.02 THEN 'warn'
  ELSE 'healthy' END AS health, printf('%.1f%%', error_rate * 100) AS error_percent
  FROM (SELECT service, {_TOTALS} FROM m GROUP BY service) ORDER BY service""",
        "services_error": m + f"SELECT service, {_TOTALS} FROM m GROUP BY service HAVING sum(error_count) > 0",
        "services_last_hour": m1 + f"SELECT service, {_TOTALS} FROM m WHERE {_LAST_HOUR} GROUP BY service",
        "endpoints": m + f"SELECT service, endpoint, {_TOTALS} FROM m GROUP BY ALL ORDER BY service, endpoint",
        "endpoints_healthy": m1 + f"""SELECT service, endpoint, {_TOTALS} FROM m WHERE {_LAST_HOUR}
  GROUP BY service, endpoint HAVING sum(error_count) = 0""",
        "endpoints_of_service": m + f"SELECT service, endpoint, {_TOTALS} FROM m WHERE service = 'svc1' GROUP BY ALL",
        "services_page": m + f"SELECT service, {_TOTALS} FROM m GROUP BY service ORDER BY service LIMIT 2 OFFSET 1",
        "services_total": m + "SELECT count(DISTINCT service) AS total FROM m",
        "service_points": m + f"SELECT {_METRIC_OUT} FROM m WHERE service = 'svc1'",
        "service_detail": m + _DETAIL,
        "service_detail_minutes": m1 + _DETAIL,
        "snapshot": m1 + f"""SELECT 'snapshot' AS type, service, CAST(sum(request_count) AS BIGINT) AS request_count,
  CAST(sum(error_count) AS BIGINT) AS error_count, round(sum(error_count) / sum(request_count), 6) AS error_rate,
  strftime(max(minute_bucket), '%Y-%m-%dT%H:%M:%S+00:00') AS last_seen
  FROM m WHERE {_LAST_HOUR} GROUP BY service ORDER BY service LIMIT 100""",
        "zscore_p95": hist + f"{score} zscore_p95",
        "zscore_error_rate": hist + f"{score} zscore_error_rate",
        "ewma_p95": hist + f"{score} ewma_p95",
        "ewma_error_rate": hist + f"{score} ewma_error_rate",
        "anomalies_forest": whole + f"{score} forest",
        "fused_detectors": whole + f"SELECT {key}, detector, signal, round(score, 6) AS score FROM found",
        "stream_detection": whole + f"SELECT {key}, detector, signal, round(score, 6) AS score FROM found",
        "anomalies_stat": hist + f"SELECT {key}, detector, signal, round(score, 6) AS score FROM stat",
        "zscore_p95_split": hist + f"{score} zscore_p95",
        "zscore_p95_since": hist + f"{score} zscore_p95 WHERE minute_bucket >= TIMESTAMP '2024-01-15'",
        "threshold_error_rate": m + f"""SELECT {key}, round(error_count / request_count / 0.25::DOUBLE, 6) AS score FROM m
  WHERE request_count >= 2 AND error_count / request_count >= 0.25::DOUBLE""",
        "seasonal_p95": m + f"""SELECT {key}, round((p95 - mean) / dev, 6) AS score FROM (
  SELECT *, count(*) OVER w AS n, avg(p95) OVER w AS mean, stddev_samp(p95) OVER w AS dev FROM m WINDOW w AS (
    PARTITION BY service, endpoint, hour(minute_bucket) ORDER BY CAST(minute_bucket AS DATE)
    RANGE BETWEEN INTERVAL 7 DAY PRECEDING AND INTERVAL 1 DAY PRECEDING)) WHERE n >= 3 AND dev > 0 AND abs((p95 - mean) / dev) >= 3""",
        "sketch_percentiles": _with(_REQ) + """SELECT service, count(*) AS request_count, count(*) FILTER (WHERE status_code >= 500) AS error_count,
  true AS p50_near, true AS p95_near, true AS p99_near FROM req GROUP BY service""",
        "endpoints_after": m + f"""SELECT service, endpoint, {_TOTALS} FROM m GROUP BY ALL
  HAVING (service, endpoint) > ('svc1', '/api/0') ORDER BY service, endpoint LIMIT 5""",
        "zscore_p95_stored": hist + f"{score} zscore_p95 WHERE minute_bucket >= TIMESTAMP '2024-01-15'",
        "isolated_metrics": m + f"""SELECT {_METRIC_OUT} FROM m
  WHERE minute_bucket + INTERVAL 6 HOUR <= (SELECT max(ts) FROM req) - INTERVAL 120 SECOND""",
        "recovered_detection": hist + """SELECT 'statistical' AS kind, count(*) AS n, true AS scored FROM stat
  WHERE minute_bucket + INTERVAL 6 HOUR <= (SELECT max(ts) FROM req) - INTERVAL 120 SECOND
  UNION ALL SELECT 'forest', 0, true""",
        "state_after_replay": _with(_REQ) + """SELECT * FROM (SELECT time_bucket(INTERVAL '6 hours', ts, TIMESTAMP '1970-01-01') AS minute_bucket,
  service, endpoint, latency_ms, count(*) AS n, count(*) FILTER (WHERE status_code >= 500) AS errors FROM req GROUP BY 1, 2, 3, 4)
  WHERE minute_bucket + INTERVAL 6 HOUR > (SELECT max(ts) FROM req) - INTERVAL 120 SECOND""",
        "stream_forest": hist + f"""SELECT {key}, true AS eligible, true AS same FROM (SELECT *, count(*) OVER (PARTITION BY service, endpoint
  ORDER BY minute_bucket ROWS BETWEEN 30 PRECEDING AND 1 PRECEDING) AS n30 FROM r) WHERE n30 >= 30""",
        "distinct_flagged": hist + "SELECT * FROM flagged WHERE minute_bucket >= TIMESTAMP '2024-01-14 23:59:00'",
        "incident_labels": _with(_REQ, _INC) + f"""SELECT {key}, min(seq) AS seq, arg_min(kind, seq) AS kind
  FROM hit GROUP BY ALL""",
        "confusion": judge + """SELECT coalesce(t.minute_bucket, f.minute_bucket) AS minute_bucket,
  coalesce(t.service, f.service) AS service, coalesce(t.endpoint, f.endpoint) AS endpoint,
  CASE WHEN f.service IS NULL THEN 'FN' WHEN t.service IS NULL THEN 'FP' ELSE 'TP' END AS outcome
  FROM truth t FULL JOIN flagged f ON t.minute_bucket = f.minute_bucket AND t.service = f.service
  AND t.endpoint = f.endpoint""",
        "true_positives": judge + "SELECT * FROM truth INTERSECT SELECT * FROM flagged",
        "false_positives": judge + "SELECT * FROM flagged EXCEPT SELECT * FROM truth",
        "false_negatives": judge + "SELECT * FROM truth EXCEPT SELECT * FROM flagged",
        "precision_recall": judge + pr,
        "latency_stats": _with(_REQ, _SAMPLES, _stats("")) + "SELECT * FROM stats",
        "latency_stats_split": _with(_REQ, _SAMPLES, _stats("")) + "SELECT * FROM stats",
        "latency_stats_by_service": _with(_REQ, _SAMPLES, _stats("service")) + "SELECT * FROM stats",
        "throughput_series": _with(_REQ, _SAMPLES, _SERIES) + "SELECT * FROM series",
        "throughput_spread": _with(_REQ, _SAMPLES, _SERIES) + """SELECT round(avg(sent), 6) AS mean,
  round(stddev_pop(sent), 6) AS stddev, min(sent) AS minimum, max(sent) AS maximum FROM series""",
        "processed_count": m + processed,
        "peak_backlog": _with(_REQ, _BACKLOG) + """SELECT max(pending_count) AS peak_pending, max(lag) AS peak_lag
  FROM hourly""",
        "live_latest": _with(_REQ) + """SELECT minute_bucket, service, endpoint, event_id AS sequence, status_code, latency_ms
  FROM (SELECT *, time_bucket(INTERVAL '6 hours', ts, TIMESTAMP '1970-01-01') AS minute_bucket FROM req)
  QUALIFY row_number() OVER (PARTITION BY minute_bucket, service, endpoint ORDER BY event_id DESC) = 1""",
        "first_arrivals": _with(_REQ) + """SELECT CAST(trunc(latency_ms * 100) AS BIGINT) AS id, event_id, service,
  ts AS created_at FROM req QUALIFY row_number() OVER (PARTITION BY CAST(trunc(latency_ms * 100) AS BIGINT)
  ORDER BY ts, event_id) = 1""",
        "anomaly_feed": hist + f"""SELECT {key}, detector, signal, round(score, 6) AS score, to_timestamp_us AS created_at
  FROM (SELECT *, minute_bucket + INTERVAL 6 HOUR + to_microseconds(CAST(right(service, 1) AS INT) * 1000
    + CAST(right(endpoint, 1) AS INT) * 100 + CASE detector WHEN 'ewma' THEN 10 ELSE 0 END
    + CASE signal WHEN 'p95' THEN 1 ELSE 0 END) AS to_timestamp_us FROM stat)
  ORDER BY created_at DESC LIMIT 50""",
        "message_metric_point": m + f"""SELECT
  'schema_version,type,sequence,service,endpoint,minute_bucket,request_count,error_count,p50,p95,p99' AS keys,
  1 AS schema_version, 'metric_point' AS type, 7 * 4294967296 + row_number() OVER
  (PARTITION BY service, endpoint ORDER BY m.minute_bucket) AS sequence, service, endpoint, {iso}, request_count,
  error_count, round(p50, 6) AS p50, round(p95, 6) AS p95, round(p99, 6) AS p99 FROM m""",
        "message_anomaly": reasons + f"""SELECT
  'schema_version,type,id,service,endpoint,minute_bucket,detector,score,reason,created_at' AS keys,
  1 AS schema_version, 'anomaly' AS type, {finding_fields}, reason,
  strftime(reasons.minute_bucket + INTERVAL 6 HOUR, '%Y-%m-%dT%H:%M:%S+00:00') AS created_at FROM reasons""",
        "alert_outbox": reasons + outbox,
        "stream_outbox": _with(_REQ, _m(), _hist(), _REASONS, _forest()) + outbox + f"""
  UNION ALL SELECT 'id,minute_bucket,service,endpoint,detector,score,reason', service, endpoint, {iso}, 'isolation_forest', round(score, 6),
  'multivariate outlier across request_count/error_rate/p50/p95/p99 (isolation forest score '
  || CAST(CAST(CAST(score AS VARCHAR) AS DECIMAL(18, 3)) AS VARCHAR) || ', lower = more anomalous)' FROM forest""",
        "anomaly_reasons": reasons + f"SELECT {key}, detector, signal, reason FROM reasons",
        "forest_windows": hist + f"""SELECT {key}, CAST(n30 AS INTEGER) AS rows, n30 >= 30 AS eligible,
  round(coalesce(total, 0), 3) AS feature_sum, true AS sound FROM (SELECT *, count(*) OVER w AS n30,
    sum(request_count + error_rate + p50 + p95 + p99) OVER w AS total FROM r
    WINDOW w AS (PARTITION BY service, endpoint ORDER BY minute_bucket ROWS BETWEEN 30 PRECEDING AND 1 PRECEDING))""",
        "stored_labels": _with(_REQ, _INC) + "SELECT * FROM truth",
        "page_bounds": m + """SELECT CAST(a AS INTEGER) AS page_limit, CAST(b AS INTEGER) AS page_offset, ok AS accepted,
  CASE WHEN ok THEN greatest(least(n - b, a), 0) ELSE 0 END AS held
  FROM (VALUES (0, 0, false), (1, 0, true), (100, 0, true), (101, 0, false), (20, -1, false), (3, 4, true)) v(a, b, ok),
  (SELECT count(DISTINCT service) AS n FROM m)""",
        "metrics_range": m + f"""SELECT {_METRIC_OUT} FROM m
  WHERE minute_bucket >= TIMESTAMP '2024-01-10' AND minute_bucket < TIMESTAMP '2024-01-20 12:00:00'""",
        "compacted_metrics": m + f"SELECT {_METRIC_OUT} FROM m",
        "stream_metrics_late": _with(_REQ, _ON_TIME, _m("ontime")) + f"""SELECT {_METRIC_OUT} FROM m
  WHERE minute_bucket + INTERVAL 6 HOUR <= (SELECT max(ts) FROM req) - INTERVAL 120 SECOND""",
        "stream_live_late": _with(_REQ, _ON_TIME, _m("ontime")) + f"""SELECT service, endpoint, {iso}, request_count,
  error_count, round(p95, 6) AS p95 FROM m""",
        "backlog_levels": _with(_REQ, _HOURLY) + """SELECT "at", name,
  CAST(sum(n) OVER (PARTITION BY name ORDER BY "at") AS BIGINT) AS stream_length, coalesce(lag, 0) AS pending_count, lag,
  CASE WHEN coalesce(lag, 0) > 100 THEN 'error' WHEN coalesce(lag, 0) > 20 THEN 'warn' END AS backlog FROM hours""",
        "liveness": _with(_REQ, _HOURLY) + """SELECT name,
  (epoch_us(TIMESTAMP '2024-01-31') - epoch_us(max("at"))) // 1000 AS idle_ms FROM hours GROUP BY name""",
        "message_lag": _with(_REQ, _BACKLOG) + """SELECT 'schema_version,type,stream_length,pending_count,lag' AS keys,
  1 AS schema_version, 'lag' AS type, stream_length, pending_count, lag FROM hourly""",
        "run_report": _with(_REQ, _m(), _hist(), _INC, _SAMPLES, _SERIES, _stats(""), _BACKLOG,
                            f"pr AS ({pr})", f"pc AS ({processed})") + """SELECT 'january' AS scenario_name, '2024-01-31T00:00:00+00:00' AS run_timestamp,
  720.0::DOUBLE AS throughput_duration_seconds, s.*, s.p95_ms AS live_p95_ms, v.*, pr.*, h.*, pc.processed,
  round(pc.processed / 720.0::DOUBLE, 6) AS processed_per_sec
  FROM stats s, pr, pc, (SELECT round(avg(sent), 6) AS mean, round(stddev_pop(sent), 6) AS stddev, min(sent) AS minimum,
  max(sent) AS maximum FROM series) v, (SELECT max(pending_count) AS peak_pending, max(lag) AS peak_lag FROM hourly) h""",
        "repaired_metrics": _with(_REQ, "part AS (SELECT * FROM req WHERE status_code <> 404)", _m(),
                                  _m("part", name="p")) + f"""
  SELECT {_METRIC_OUT} FROM m WHERE minute_bucket >= TIMESTAMP '2024-01-16'
  UNION ALL SELECT {_METRIC_OUT} FROM p WHERE minute_bucket < TIMESTAMP '2024-01-16'""",
        "upserted_metrics": _with(_REQ, "part AS (SELECT * FROM req WHERE status_code <> 404)", _m(),
                                  _m("part", name="p")) + f"""
  SELECT {_METRIC_OUT} FROM m WHERE service >= 'svc2' UNION ALL SELECT {_METRIC_OUT} FROM p WHERE service < 'svc2'""",
        "stream_ingest": _with(_REQ, _JSON) + """SELECT reject_reason, count(*) AS n FROM verdict GROUP BY 1
  UNION ALL SELECT 'accepted', count(*) FROM judged WHERE reject_reason IS NULL""",
        "stream_log": _with(_REQ, _JSON) + """SELECT reject_reason, count(*) AS n FROM verdict GROUP BY 1
  UNION ALL SELECT 'accepted', count(*) FROM judged WHERE reject_reason IS NULL""",
        "lag_feed": """SELECT DISTINCT 'lag' AS type, n AS stream_length, greatest(n - k * ((n + 7) // 8), 0) AS lag, true AS bounded
  FROM (SELECT count(*) AS n FROM events), range(1, 9) t(k)""",
        "stream_metrics": m + f"""SELECT {_METRIC_OUT} FROM m
  WHERE minute_bucket + INTERVAL 6 HOUR <= (SELECT max(ts) FROM req) - INTERVAL 120 SECOND""",
        "stream_live": m + f"""SELECT 'metric_point' AS type, service, endpoint, {iso}, request_count, error_count,
  round(p95, 6) AS p95 FROM m""",
        "stream_backlog": _with(_REQ, _JSON) + """SELECT 'ingest' AS name, n AS rows_in, CAST(0 AS BIGINT) AS dropped,
  true AS over_100_batches, n - bad AS accepted, bad AS rejected, bytes
  FROM (SELECT count(*) AS n, CAST(sum(strlen(raw)) AS BIGINT) AS bytes FROM j), (SELECT count(*) AS bad FROM verdict)""",
    }
