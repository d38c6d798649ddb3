"""Raw JSON to one exactly-once table holding accepted and rejected rows apart."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..params import Params
from ..schemas import EVENT, INGESTED
from ..sources.events import parse_json_events

EVERY_5_SECONDS = {"processingTime": "5 seconds"}


def ingested(raw: DataFrame, params: Params = Params()) -> DataFrame:
    """INGESTED rows: the text is parsed once, and only a rejected row keeps it."""
    parsed = parse_json_events(raw.select("raw"), "raw", None, params)
    accepted = F.col("reject_reason").isNull()
    return parsed.select(
        *EVENT.fieldNames(),
        F.when(~accepted, F.col("raw")).alias("raw"),
        "reject_reason",
        accepted.alias("accepted"),
        F.coalesce(F.when(accepted, F.to_date("ts")), F.current_date()).alias("event_date"),
    )


def start_ingest(raw: DataFrame, table: str, checkpoint: str, params: Params = Params(),
                 trigger: dict | None = None) -> StreamingQuery:
    """Append to the table through the file sink, whose log makes every row count once for later readers.

    Every report of the query tells how much its batch took in: observed as `arrived` (bytes) and `judged` (accepted, rejected).
    """
    arrived = raw.observe("arrived", F.sum(F.octet_length("raw")).alias("bytes"))
    accepted = F.count_if("accepted").alias("accepted")
    judged = ingested(arrived, params).observe("judged", accepted, F.count_if(~F.col("accepted")).alias("rejected"))
    return (
        judged.writeStream.queryName("ingest")
        .format("parquet")
        .partitionBy("accepted", "event_date")
        .option("path", table)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(**(trigger or EVERY_5_SECONDS))
        .start()
    )


def accepted_events(spark: SparkSession, table: str, stream: bool = False, days: list[date] | None = None) -> DataFrame:
    """Accepted events, as a batch or a stream; only their directories (and days) are read."""
    reader = spark.readStream if stream else spark.read
    rows = reader.schema(INGESTED).parquet(table).where("accepted")
    if days:
        rows = rows.where(F.col("event_date").isin(days))
    return rows.select(*EVENT.fieldNames())


def rejected_events(spark: SparkSession, table: str) -> DataFrame:
    """The dead letters: raw text and reason."""
    return spark.read.schema(INGESTED).parquet(table).where("NOT accepted").select("raw", "reject_reason", "event_date")
