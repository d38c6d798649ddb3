"""Exact order statistics of groups too large for one task.

A group's rows are counted into narrow value ranges, the range holding each wanted rank is found
from the counts, and only the rows of those ranges are looked at again. Nothing but counts is
ever gathered per group, so one group may hold most of the table.

1. Logarithmic ranges, LOG_STEPS per doubling of the value.
2. Equal slices, LINEAR_SLICES per range that holds a wanted rank.
3. The distinct values of each slice that holds one. A double has 2**52 steps per doubling, so a
   slice has at most 2**52 / LOG_STEPS / LINEAR_SLICES = 2**24 of them, whatever the data.

The ranges need only rise with the value to be exact; rounding in their limits does no harm.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from ..params import Params
from ..session import cut, small

LOG_STEPS = 4096
LINEAR_SLICES = 65536


def select_ranks(values: DataFrame, targets: DataFrame, keys: list[str], value: str, weight: str) -> DataFrame:
    """The value at each wanted 0-based rank: one row (keys, rank, value) per rank.

    values: keys, a non-negative double, and how often it occurred.
    targets: one row per group, keys and ranks array<bigint>; the two tables derived from it have at most
    one row per wanted rank. All are kept in the shared checkpoint folder, and broadcast if they are small.
    values is passed over three times, so it should be stored counts.
    """
    targets = cut(targets)
    ranged = values.select(*keys, F.col(value).alias("_x"), F.col(weight).alias("_w"), _log_range(value).alias("_a"))

    by_range = (
        ranged.join(small(targets.select(*keys)), keys)
        .groupBy(*keys, "_a")
        .agg(F.sum("_w").alias("_m"), F.min("_x").alias("_lo"), F.max("_x").alias("_hi"))
        .join(small(targets.select(*keys, F.transform("ranks", _wanted).alias("_want"))), keys)
    )
    ranges = cut(_holding(by_range, keys, "_a").select(*keys, "_a", "_lo", "_hi", "_want"))

    sliced = ranged.join(small(ranges), [*keys, "_a"]).withColumn("_b", _slice())
    by_slice = sliced.groupBy(*keys, "_a", "_b").agg(F.sum("_w").alias("_m"), F.any_value("_want").alias("_want"))
    slices = cut(_holding(by_slice, [*keys, "_a"], "_b").select(*keys, "_a", "_b", "_want"))

    by_value = (
        sliced.drop("_want")
        .join(small(slices), [*keys, "_a", "_b"])
        .groupBy(*keys, "_a", "_b", "_x")
        .agg(F.sum("_w").alias("_m"), F.any_value("_want").alias("_want"))
    )
    return _holding(by_value, [*keys, "_a", "_b"], "_x").select(
        *keys, F.explode("_want.rank").alias("rank"), F.col("_x").alias("value")
    )


def exact_ranks(samples: DataFrame, keys: list[str], value: str, ranks, params: Params) -> DataFrame:
    """One row (keys, n, mean, at) per group; `at` maps each rank that ranks(n) names to its value.

    The samples are read once and counted by value. A group of up to hot_values distinct values is then ranked by
    a running sum in one task; larger ones go through select_ranks.
    """
    counted = cut(samples.groupBy(*keys, F.col(value).cast("double").alias("_x")).agg(F.count("*").alias("_w")))
    totals = counted.groupBy(*keys).agg(
        F.sum("_w").alias("n"), (F.sum(F.col("_x") * F.col("_w")) / F.sum("_w")).alias("mean"), F.count("*").alias("_distinct")
    )
    sizes = cut(totals.withColumn("ranks", ranks(F.col("n"))))
    large = sizes.where(F.col("_distinct") > params.hot_values).select(*keys, "ranks")
    usual = sizes.where(F.col("_distinct") <= params.hot_values).select(*keys, F.transform("ranks", _wanted).alias("_want"))

    found = _holding(counted.withColumnRenamed("_w", "_m").join(usual, keys), keys, "_x").select(
        *keys, F.explode("_want.rank").alias("rank"), F.col("_x").alias("value")
    )
    if not large.isEmpty():
        found = found.unionByName(select_ranks(counted, large, keys, "_x", "_w"))
    at = F.map_from_entries(F.collect_list(F.struct("rank", "value"))).alias("at")
    return found.groupBy(*keys).agg(at).join(sizes.drop("ranks", "_distinct"), keys)


def interpolate(at_rank: Column, rows: Column, p: float) -> Column:
    """Linear-interpolated percentile from a map rank -> value of a sample of that many rows."""
    position = (rows - 1) * F.lit(p)
    low, high = F.floor(position), F.ceil(position)
    below, above = at_rank[low], at_rank[high]
    return F.when(below == above, below).otherwise((high - position) * below + (position - low) * above)


def interpolation_ranks(rows: Column, ps: list[float]) -> Column:
    """The ranks that interpolate() reads for these percentiles."""
    positions = [(rows - 1) * F.lit(p) for p in ps]
    return F.array_distinct(F.array(*[f(x).cast("bigint") for x in positions for f in (F.floor, F.ceil)]))


def _log_range(value: str) -> Column:
    return F.floor(F.log2(F.greatest(F.col(value), F.lit(1e-300))) * LOG_STEPS)


def _slice() -> Column:
    width = F.nullif(F.col("_hi") - F.col("_lo"), F.lit(0.0))
    return F.coalesce(F.floor((F.col("_x") - F.col("_lo")) / width * LINEAR_SLICES), F.lit(0))


def _wanted(rank: Column) -> Column:
    return F.struct(rank.alias("rank"), rank.alias("left"))


def _holding(counts: DataFrame, group: list[str], order: str) -> DataFrame:
    """Rows of counts that hold a wanted rank, with what is left to count inside each."""
    run = W.partitionBy(*group).orderBy(order).rowsBetween(W.unboundedPreceding, W.currentRow)
    before = F.col("_upto") - F.col("_m")
    inside = F.filter("_want", lambda t: (t["left"] >= before) & (t["left"] < F.col("_upto")))
    rebased = F.transform(inside, lambda t: F.struct(t["rank"].alias("rank"), (t["left"] - before).alias("left")))
    return (
        counts.withColumn("_upto", F.sum("_m").over(run))
        .withColumn("_want", rebased)
        .where(F.size("_want") > 0)
    )
