"""Per-series history, split so that no task has to sort one long series."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from ..schemas import SERIES
from ..session import cut

CHUNK = [*SERIES, "_chunk"]


def chunked(metrics: DataFrame, longest: int, chunk_rows: int) -> DataFrame:
    """Cut each series into chunks of chunk_rows buckets, each led by copies of the `longest` rows before it.

    Adds _chunk and _own (false on the copies). A row's place in its series is its place in its day plus
    the rows of earlier days, so it takes a small per-day count and no sort of the whole series.
    """
    dated = metrics.withColumn("_day", F.to_date("minute_bucket"))
    earlier = F.sum("_rows").over(W.partitionBy(*SERIES).orderBy("_day").rowsBetween(W.unboundedPreceding, -1))
    days = dated.groupBy(*SERIES, "_day").agg(F.count("*").alias("_rows"))
    starts = days.select(*SERIES, "_day", F.coalesce(earlier, F.lit(0)).alias("_start"))
    in_day = F.row_number().over(W.partitionBy(*SERIES, "_day").orderBy("minute_bucket")) - 1

    place = F.col("_start") + F.col("_in_day")
    home = F.floor(place / chunk_rows)
    leads_next = place % chunk_rows >= chunk_rows - longest
    return (
        dated.withColumn("_in_day", in_day)
        .join(starts, [*SERIES, "_day"])
        .withColumn("_home", home)
        .withColumn("_chunk", F.explode(F.when(leads_next, F.array(home, home + 1)).otherwise(F.array(home))))
        .withColumn("_own", F.col("_chunk") == F.col("_home"))
        .drop("_day", "_in_day", "_start", "_home")
    )


def previous(rows: int):
    """Window over the last `rows` existing buckets of a chunked series, the current one excluded."""
    return W.partitionBy(*CHUNK).orderBy("minute_bucket").rowsBetween(-rows, -1)


def history(column: Column, rows: int) -> Column:
    """Array of up to `rows` earlier values, oldest first."""
    return F.collect_list(column).over(previous(rows))


def latest_rows(metrics: DataFrame, n: int, before: Column | None = None) -> DataFrame:
    """The last n existing buckets of every series, optionally only those before a bucket."""
    rows = metrics if before is None else metrics.where(F.col("minute_bucket") < before)
    newest = W.partitionBy(*SERIES).orderBy(F.desc("minute_bucket"))
    return rows.withColumn("_nth", F.row_number().over(newest)).where(F.col("_nth") <= n).drop("_nth")


def search_back(read: Callable[[datetime, datetime], DataFrame], series: DataFrame, n: int, before: datetime, earliest: datetime) -> DataFrame:
    """The last n buckets before a moment of every one of `series`, from a table that read(start, end) gives a range of.

    Goes back a day, then two more, four more and so on, each time for the series that still lack rows, and ends when none
    does or the table does: what lies before the days needed is never opened.
    """
    found, lacking, end, days = None, cut(series.distinct()), before, 1
    while True:
        start = max(end - timedelta(days=days), earliest)
        older = read(start, end).join(lacking, SERIES, "left_semi")
        found = cut(latest_rows(older if found is None else found.unionByName(older), n))
        enough = found.groupBy(*SERIES).agg(F.count("*").alias("rows")).where(F.col("rows") >= n)
        lacking = cut(lacking.join(enough.select(*SERIES), SERIES, "left_anti"))
        if start <= earliest or lacking.isEmpty():
            return found
        end, days = start, 2 * days
