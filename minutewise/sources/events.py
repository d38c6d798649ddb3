"""Reading, validating and writing request events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalar import iso_utc
from ..params import Params
from ..schemas import EVENT, EVENT_WIRE, EVENT_WITH_ID

FIELDS = EVENT.fieldNames()

# The accepted text forms of numbers and times.
_INTEGER = r"^\s*[+-]?\d+\s*$"
_DECIMAL = r"^\s*[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?\s*$"
_ISO_TIME = r"^\d{4}-\d{2}-\d{2}([Tt ]\d{2}:\d{2}(:\d{2}([.,]\d+)?)?([Zz]|[+-]\d{2}(:?\d{2})?)?)?$"
_USUAL_TIME = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d+)?(Z|[+-]\d{2}:\d{2})?$"
# What a shorter form leaves out: the time of day, the seconds, the zone.
_FILL_IN = [
    (r"^(\d{4}-\d{2}-\d{2})$", "$1T00:00:00"),
    (r"([T ]\d{2}:\d{2})($|[Z+-])", "$1:00$2"),
    (r"([T ][\d:.]+)$", "$1Z"),
]
# The first and last second of years 1 to 9999.
_FIRST_SECOND, _LAST_SECOND = -62135596800, 253402300799


# What a stream takes in at once unless told otherwise: files of a folder, records of a topic.
FILES_PER_BATCH, OFFSETS_PER_BATCH = 1_000, 1_000_000


def read_events(spark: SparkSession, path: str, fmt: str = "parquet", with_id: bool = False) -> DataFrame:
    """A backfill scan of stored events; rollup() takes it like any stream's rows."""
    return spark.read.schema(EVENT_WITH_ID if with_id else EVENT).format(fmt).load(path)


def stream_json(spark: SparkSession, path: str, max_files: int = FILES_PER_BATCH) -> DataFrame:
    """Lines of JSON files as a stream with one column, `raw`."""
    reader = spark.readStream.format("text").option("maxFilesPerTrigger", max_files)
    return reader.load(path).withColumnRenamed("value", "raw")


def stream_kafka(spark: SparkSession, servers: str, topic: str, max_offsets: int = OFFSETS_PER_BATCH) -> DataFrame:
    """Values of a Kafka topic in the same form. Needs the Kafka connector on the class path."""
    reader = spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic)
    return reader.option("maxOffsetsPerTrigger", max_offsets).load().select(F.col("value").cast("string").alias("raw"))


def stream_events(spark: SparkSession, path: str, with_id: bool = False, max_files: int = FILES_PER_BATCH) -> DataFrame:
    """Stored events as a stream."""
    reader = spark.readStream.schema(EVENT_WITH_ID if with_id else EVENT)
    return reader.option("maxFilesPerTrigger", max_files).parquet(path)


def parse_json_events(df: DataFrame, raw: str = "raw", as_of: Column | None = None,
                      params: Params = Params()) -> DataFrame:
    """Typed event columns and reject_reason (null when valid) beside the JSON text of each row.

    Types are taken from the JSON tokens, not coerced: "200", 200.0 and true are no status code, 5 is no
    name. Fields beyond the five are ignored. Nothing raises; a bad row only gets a reason.
    """
    doc = F.try_parse_json(F.col(raw))
    parsed = df.withColumn("_doc", doc).withColumn("_root", F.schema_of_variant("_doc"))
    for name in FIELDS:
        parsed = parsed.withColumn(f"_{name}", F.schema_of_variant(F.try_variant_get("_doc", f"$.{name}", "variant")))

    def value(name: str, kind: str) -> Column:
        return F.try_variant_get("_doc", f"$.{name}", kind)

    ts_text = F.when(F.col("_ts") == "STRING", value("ts", "string"))
    ts_number = F.when(F.col("_ts") == "BIGINT", value("ts", "bigint"))
    status = F.when(F.col("_status_code") == "BIGINT", value("status_code", "bigint"))
    numeric = F.col("_latency_ms").rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL.*)$")
    typed = parsed.withColumns(
        {
            "service": F.when(F.col("_service") == "STRING", value("service", "string")),
            "endpoint": F.when(F.col("_endpoint") == "STRING", value("endpoint", "string")),
            "_status": status,
            "latency_ms": F.when(numeric, value("latency_ms", "double")),
            "ts": F.coalesce(_iso_instant(ts_text), _epoch_instant(ts_number)),
        }
    )
    is_object = F.coalesce(F.col("_root").startswith("OBJECT"), F.lit(False))
    missing = [
        F.when(F.coalesce(F.col(f"_{name}"), F.lit("VOID")) == "VOID", f"missing {name}") for name in FIELDS
    ]
    reason = F.coalesce(F.when(~is_object, "malformed"), *missing, *_faults(as_of, params))
    return _finish(typed, reason, df.columns)


def parse_wire_events(df: DataFrame, as_of: Column | None = None, params: Params = Params()) -> DataFrame:
    """The same from EVENT_WIRE rows, where every value is text; `raw` holds the row as JSON."""
    number = F.regexp_like("latency_ms", F.lit(_DECIMAL))
    whole = F.regexp_like("status_code", F.lit(_INTEGER))
    missing = [F.when(F.col(name).isNull(), f"missing {name}").alias(f"_no_{name}") for name in FIELDS]
    texts = df.select("*", F.to_json(F.struct(*FIELDS)).alias("raw"), *missing)
    typed = texts.withColumns(
        {
            "_status": F.when(whole, F.trim("status_code").try_cast("bigint")),
            "latency_ms": F.when(number, F.trim("latency_ms").try_cast("double")),
            "ts": _iso_instant(F.col("ts")),
        }
    )
    reason = F.coalesce(*[F.col(f"_no_{name}") for name in FIELDS], *_faults(as_of, params))
    return _finish(typed, reason, [c for c in df.columns if c not in FIELDS] + ["raw"])


def split_valid(parsed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid events, rejected rows with their raw text and reason)."""
    valid = parsed.where("reject_reason IS NULL").drop("reject_reason", "raw")
    return valid, parsed.where("reject_reason IS NOT NULL").select("raw", "reject_reason")


def to_wire(events: DataFrame) -> DataFrame:
    """Events as EVENT_WIRE rows: every value text, time as ISO-8601."""
    return events.select(
        *[(iso_utc("ts") if name == "ts" else F.col(name).cast("string")).alias(name) for name in EVENT_WIRE.fieldNames()]
    )


def to_wire_json(events: DataFrame) -> DataFrame:
    """Wire rows as one JSON column `value`: the form a file or Kafka sink appends."""
    return to_wire(events).select(F.to_json(F.struct(*FIELDS)).alias("value"))


def append_wire(events: DataFrame, path: str, checkpoint: str | None = None, trigger: dict | None = None):
    """Append events to a log of JSON lines; a streaming frame needs a checkpoint and returns its query.

    A folder takes either batch or streaming appends: its readers trust a stream's own list of files.
    """
    lines = to_wire_json(events)
    if not events.isStreaming:
        return lines.write.mode("append").text(path)
    writer = lines.writeStream.queryName("append").format("text").option("path", path)
    return writer.option("checkpointLocation", checkpoint).trigger(**(trigger or {"processingTime": "5 seconds"})).start()


def read_wire(df: DataFrame, raw: str = "raw") -> DataFrame:
    """EVENT_WIRE rows from a log written by append_wire."""
    return df.select(F.from_json(raw, EVENT_WIRE).alias("_event")).select("_event.*")


def _faults(as_of: Column | None, params: Params) -> list[Column]:
    """One reason column per rule, in the order they are reported; the fields are typed or null by now."""
    now = F.current_timestamp() if as_of is None else as_of
    latest = now + F.make_dt_interval(secs=F.lit(params.max_future_skew_seconds))
    latency = F.col("latency_ms")
    return [
        F.when(F.col("service").isNull(), "type service"),
        F.when(F.length("service") < 1, "blank service"),
        F.when(F.col("endpoint").isNull(), "type endpoint"),
        F.when(F.length("endpoint") < 1, "blank endpoint"),
        F.when(F.col("_status").isNull(), "type status_code"),
        F.when(~F.col("_status").between(100, 599), "range status_code"),
        F.when(latency.isNull(), "type latency_ms"),
        # NaN compares above everything in Spark, so the upper bound drops it along with infinity.
        F.when(~((latency >= 0) & (latency < float("inf"))), "range latency_ms"),
        F.when(F.col("ts").isNull(), "type ts"),
        F.when(F.col("ts") > latest, "future ts"),
    ]


def _finish(typed: DataFrame, reason: Column, keep: list[str]) -> DataFrame:
    ok = F.col("_status").between(100, 599)
    row = F.struct(
        "service",
        "endpoint",
        F.when(ok, F.col("_status")).cast("int").alias("status_code"),
        "latency_ms",
        "ts",
        reason.alias("reject_reason"),
    )
    # A filter on reject_reason would otherwise move below the projection and parse the text once per rule;
    # it can't move below a generator.
    return typed.select(*keep, F.inline(F.array(row)))


def _iso_instant(text: Column) -> Column:
    """ISO-8601 text as an instant; without an offset it is UTC, whatever the session's zone."""
    # The usual form is cast as it is; only others are filled in.
    usual = F.regexp_like(text, F.lit(_USUAL_TIME))
    zoned = F.when(F.substr(text, F.length(text) - 5, F.lit(1)).isin("+", "-") | F.endswith(text, F.lit("Z")), text)
    direct = F.coalesce(zoned, F.concat(text, F.lit("Z"))).try_cast("timestamp")
    full = F.regexp_replace(F.upper(text), ",", ".")
    for pattern, replacement in _FILL_IN:
        full = F.regexp_replace(full, pattern, replacement)
    return F.when(usual, direct).when(F.regexp_like(text, F.lit(_ISO_TIME)), full.try_cast("timestamp"))


def _epoch_instant(seconds: Column) -> Column:
    return F.timestamp_seconds(F.when(seconds.between(_FIRST_SECOND, _LAST_SECOND), seconds))
