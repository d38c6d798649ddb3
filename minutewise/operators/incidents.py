"""Ground-truth labels from known incident intervals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import bucket_start
from ..schemas import BUCKET_KEY, SERIES


# More levels than there are doublings in the life of a clock.
_LEVELS = 48


def label_incidents(events: DataFrame, incidents: DataFrame, window_seconds: int = 60) -> DataFrame:
    """One row per bucket with an event inside an incident of its series: BUCKET_KEY, seq, kind.

    An incident covers start <= ts < end. Where several do, the first by seq wins. Only in the first and the last bucket of
    an incident the time of an event matters; these are joined by bucket. All buckets between are covered by
    aligned blocks of 1, 2, 4, ... buckets, at most two of a size, so an incident is a few rows however long it lasts; the
    distinct buckets of the events meet them once per size. Labels form in the partial aggregates.
    """
    buckets = events.select(*SERIES, "ts", bucket_start("ts", window_seconds).alias("minute_bucket"))
    first = F.min(F.struct("seq", "kind")).alias("first")
    plan = covered(incidents, window_seconds)
    at_edge = (
        buckets.join(plan.where("level IS NULL").withColumn("minute_bucket", _instant_of("block", window_seconds)), BUCKET_KEY)
        .where((F.col("ts") >= F.col("start")) & (F.col("ts") < F.col("end")))
        .groupBy(*BUCKET_KEY)
        .agg(first)
    )
    # One number per size of block in use.
    levels = [row.level for row in plan.select("level").distinct().where("level IS NOT NULL").collect()]
    number = _number("minute_bucket", window_seconds)
    sizes = F.array(*[F.struct(F.lit(k).alias("level"), F.shiftright(number, k).alias("block")) for k in levels or [0]])
    each = buckets.select(*BUCKET_KEY).distinct().select(*BUCKET_KEY, F.inline(sizes))
    inside = each.join(plan.where("level IS NOT NULL"), [*SERIES, "level", "block"]).groupBy(*BUCKET_KEY).agg(first)
    return at_edge.unionByName(inside).groupBy(*BUCKET_KEY).agg(F.min("first").alias("first")).select(*BUCKET_KEY, "first.*")


def covered(incidents: DataFrame, window_seconds: int) -> DataFrame:
    """Each incident as blocks of buckets: level and block, a block being buckets block << level to ((block + 1) << level) - 1.

    Its first and last bucket have no level. Of a range from low to high, a level has the block at either end that the next
    larger size can't take in.
    """
    real = incidents.where(F.col("start") < F.col("end")).withColumns(
        {"low": _number("start", window_seconds), "high": _number(F.timestamp_micros(F.unix_micros("end") - 1), window_seconds)}
    )
    edges = F.transform(F.array_distinct(F.array("low", "high")), lambda n: F.struct(F.lit(None).cast("int").alias("level"), n.alias("block")))

    def ends(k: int) -> list[Column]:
        left = F.shiftright(F.col("low") + 1 + F.lit(2**k - 1), k)
        right = F.shiftright(F.col("high"), k)
        some = left < right
        block = lambda n, taken: F.when(some & taken, F.struct(F.lit(k).alias("level"), n.alias("block")))
        return [block(left, left.bitwiseAND(F.lit(1)) == 1), block(right - 1, right.bitwiseAND(F.lit(1)) == 1)]

    between = F.array_compact(F.array(*[end for k in range(_LEVELS) for end in ends(k)]))
    return real.select(*incidents.columns, F.inline(F.concat(edges, between)))


def _number(moment: Column | str, window_seconds: int) -> Column:
    """The number of the bucket that holds a moment."""
    width = F.lit(window_seconds * 1_000_000)
    micros = F.unix_micros(moment)
    return ((micros - F.pmod(micros, width)) / width).cast("long")


def _instant_of(number: str, window_seconds: int) -> Column:
    return F.timestamp_micros(F.col(number) * F.lit(window_seconds * 1_000_000))


def label_keys(labels: DataFrame) -> DataFrame:
    return labels.select(*BUCKET_KEY).distinct()
