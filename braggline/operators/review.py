"""Inspection summaries: counts, anomaly flags and samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordered import exact_quantiles, median_and_mad, with_rank


def pattern_anomaly(values: Column) -> Column:
    """Why a pattern is unusable, null when it is fine."""
    n = F.size(values)
    finite = F.size(F.filter(values, lambda x: x.isNotNull()))
    return (F.when(finite == 0, "all-missing").when(F.array_max(values) <= 0, "no-signal")
            .when(finite / n < 0.5, "mostly-missing"))


def spread_sample(frames: DataFrame, k: int, chunk: float = 1_000_000.0) -> DataFrame:
    """Up to ``k`` usable frames at evenly spaced positions (truncated)."""
    live = frames.where(~F.col("excluded")).select("frame")
    total = live.groupBy().count().scalar()
    ranked = with_rank(live, [], ["frame"], "frame", chunk, "position").withColumn("_n", total)
    size = F.least(F.lit(k), F.col("_n"))
    spots = F.when(size > 1, F.transform(F.sequence(F.lit(0), size - 1), lambda i: F.floor(
        i * (F.col("_n") - 1) / (size - 1)))).otherwise(F.array(F.lit(0).cast("long")))
    return ranked.where(F.array_contains(spots, F.col("position"))).select("position", "frame")


def pixel_statistics(pixels: DataFrame, value: str = "intensity") -> DataFrame:
    """Extremes, percentiles and the shares of zero and negative pixels (one row)."""
    q = exact_quantiles(pixels, value, [0.0, 0.01, 0.5, 0.99, 1.0]).select(
        F.col("n"), *[F.col(f"q{i}").alias(c) for i, c in enumerate(("min", "p1", "median", "p99", "max"))])
    share = pixels.where(F.col(value).isNotNull()).groupBy().agg(F.struct(
        F.avg((F.col(value) == 0).cast("double")).alias("zeros"),
        F.avg((F.col(value) < 0).cast("double")).alias("negatives")).alias("s")).scalar()
    return q.withColumn("_s", share).select("*", "_s.zeros", "_s.negatives").drop("_s")


def outlier_frames(frames: DataFrame, value: str, k: float = 5.0) -> DataFrame:
    """Number of frames above median + k x MAD (unit MAD when it is zero)."""
    m = median_and_mad(frames, value).select(F.struct("median", "mad")).scalar()
    spread = F.when(F.col("_m.mad") > 0, F.col("_m.mad")).otherwise(1.0)
    return frames.withColumn("_m", m).groupBy().agg(
        F.count_if(F.col(value) > F.col("_m.median") + k * spread).alias("n_outliers"))


def analysis_summary(peaks: DataFrame) -> DataFrame:
    """Peak counts of a run (one row)."""
    return peaks.groupBy().agg(
        F.count(F.lit(1)).alias("n_peaks"), F.count_if(F.col("flag") == 0).alias("n_good"),
        F.count_if(F.col("flag") != 0).alias("n_flagged"),
        F.count_distinct("frame").alias("n_frames"))


def good_peak_counts(frames: DataFrame, peaks: DataFrame) -> DataFrame:
    """Good peaks per frame, zero where there are none."""
    counts = peaks.where(F.col("flag") == 0).groupBy("frame").agg(F.count(F.lit(1)).alias("n"))
    return frames.select("frame").join(counts, "frame", "left").select(
        "frame", F.coalesce("n", F.lit(0)).alias("n_good"))
