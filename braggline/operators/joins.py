"""Tolerance and nearest-neighbour joins without a cross join."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import checkpointed
from .ordered import CHUNK, grouped, with_chunk


def interval_join(intervals: DataFrame, points: DataFrame, by: Sequence[str], low: Column,
                  high: Column, point: str, width: float) -> DataFrame:
    """Pair each interval row with the points in ``[low, high]`` that share ``by``.

    Intervals are replicated to the buckets they touch and points live in one
    bucket each, so the pairing is an equi-join and yields each pair once.
    Adaptive execution may still split a hot bucket.
    """
    by = list(by)
    w = F.lit(float(width))
    left = (intervals.withColumn("_lo", low).withColumn("_hi", high)
            .where(F.col("_lo") <= F.col("_hi"))
            .withColumn("_bucket", F.explode(F.sequence(F.floor(F.col("_lo") / w),
                                                        F.floor(F.col("_hi") / w)))))
    right = points.withColumn("_bucket", F.floor(F.col(point) / w))
    return (left.join(right, [*by, "_bucket"])
            .where((F.col(point) >= F.col("_lo")) & (F.col(point) <= F.col("_hi")))
            .drop("_bucket", "_lo", "_hi"))


def nearest_join(left: DataFrame, right: DataFrame, by: Sequence[str], left_value: str,
                 right_value: str, width: float, carry: str | None = None) -> DataFrame:
    """Add the nearest right value and its distance to each left row; a tie goes left.

    Both sides are cut into value chunks; what lies beyond a chunk is carried in
    through a per-chunk summary, so a hot group is spread over many tasks.  ``carry`` names a
    right column to bring along; of right rows of one value its largest is taken.
    """
    by = list(by)
    names = left.columns
    if carry is not None:
        return nearest_with(left, right, by, left_value, right_value, width, carry)
    lrows = left.select(*by, F.col(left_value).alias("_x"), F.lit(1).alias("_side"),
                        F.struct(*[F.col(c) for c in names]).alias("_row"),
                        F.lit(None).cast("double").alias("_r"))
    rrows = right.select(*by, F.col(right_value).cast("double").alias("_x"),
                         F.lit(0).alias("_side"),
                         F.lit(None).cast(left.select(F.struct(*names)).schema[0].dataType).alias("_row"),
                         F.col(right_value).cast("double").alias("_r"))
    both, by = grouped(with_chunk(lrows.unionByName(rrows), "_x", width), by)
    summary = both.groupBy(*by, CHUNK).agg(F.min("_r").alias("_rmin"), F.max("_r").alias("_rmax"))
    up = Window.partitionBy(*by).orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    down = Window.partitionBy(*by).orderBy(F.desc(CHUNK)).rowsBetween(Window.unboundedPreceding, -1)
    carry = (summary.withColumn("_below", F.last("_rmax", True).over(up))
             .withColumn("_above", F.last("_rmin", True).over(down))
             .drop("_rmin", "_rmax"))
    rising = (Window.partitionBy(*by, CHUNK).orderBy("_x", "_side")
              .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    falling = (Window.partitionBy(*by, CHUNK).orderBy(F.desc("_x"), "_side")
               .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    placed = (both.join(carry, [*by, CHUNK])
              .withColumn("_lv", F.coalesce(F.last("_r", True).over(rising), F.col("_below")))
              .withColumn("_rv", F.coalesce(F.last("_r", True).over(falling), F.col("_above")))
              .where(F.col("_side") == 1))
    lgap, rgap = F.col("_x") - F.col("_lv"), F.col("_rv") - F.col("_x")
    take_left = F.col("_rv").isNull() | (lgap <= rgap)
    return placed.select(
        *[F.col(f"_row.{c}").alias(c) for c in names],
        F.when(take_left, F.col("_lv")).otherwise(F.col("_rv")).alias("nearest"),
        F.when(take_left, lgap).otherwise(rgap).alias("gap"))


def nearest_with(left: DataFrame, right: DataFrame, by: list[str], left_value: str, right_value: str, width: float, carry: str) -> DataFrame:
    """``nearest_join`` with a column of the nearest right row: a look-up of the nearest value in the right side, one row per value."""
    near = nearest_join(left, right, by, left_value, right_value, width)
    values = right.select(*by, F.col(right_value).alias("nearest"), carry).groupBy(*by, "nearest").agg(F.max(carry).alias(carry))
    return near.join(values, [*by, "nearest"], "left")


def greedy_pairs(pairs: DataFrame, left: Sequence[str], right: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One-to-one pairs, best first: a pair stays if neither its left nor its right side is in a better pair that stays.

    A pair that is the best of both its sides is certain to stay; the pairs that share a
    side with it go, and the rest is looked at again until nothing is left.  ``order`` tells any
    two pairs of one side apart.  Every round is two aggregates over all groups at once, so
    no group is collected or sorted; its pairs are checkpointed, as the next round reads them twice.
    """
    columns = pairs.columns
    rank = F.struct(*order)
    rest = pairs.withColumn("_left", F.struct(*left)).withColumn("_right", F.struct(*right))
    kept = None
    while True:
        best_left = rest.groupBy("_left").agg(F.min(rank).alias("_best_left"))
        best_right = rest.groupBy("_right").agg(F.min(rank).alias("_best_right"))
        seen = rest.join(best_left, "_left").join(best_right, "_right")
        seen = checkpointed(seen.withColumn("_won", (rank == F.col("_best_left")) & (rank == F.col("_best_right"))))
        won = seen.where("_won")
        kept = won if kept is None else kept.unionByName(won)
        # A lost pair stays in the race while both of its sides are free.
        rest = (seen.where("not _won").drop("_best_left", "_best_right", "_won")
                .join(won.select("_left"), "_left", "left_anti").join(won.select("_right"), "_right", "left_anti"))
        if rest.isEmpty():
            return kept.select(*columns)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Hash rows over a fixed number of partitions ahead of a Python kernel.

    Kernel rows cost milliseconds but few bytes, so partitions must not be merged
    by size, which adaptive execution does unless the number is given.
    """
    return df.repartition(task_count(df.sparkSession), *keys)


def task_count(spark: SparkSession) -> int:
    """The number of partitions of ``spread``."""
    return max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))


def sorted_stream(df: DataFrame, keys: Sequence[str], order: Sequence, step,
                  schema: T.StructType | str) -> DataFrame:
    """Run ``step`` over sorted rows, key by key, with state carried across batches."""
    keys = list(keys)
    return spread(df, *keys).sortWithinPartitions(*keys, *order).mapInPandas(step, schema)
