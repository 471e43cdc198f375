"""Detector images to patterns: integration of pixels with known coordinates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def suggest_bins(nrows: Column, ncols: Column, beam_row: Column, beam_col: Column) -> Column:
    """Bin counts from the farthest detector corner, rounded up to 50 and clamped."""
    def reach(r: Column, c: Column) -> Column:
        return F.hypot(r - beam_row, c - beam_col)

    def up(v: Column) -> Column:
        return F.ceil(v / 50) * 50
    zero = F.lit(0.0)
    far = F.greatest(reach(zero, zero), reach(zero, ncols - 1), reach(nrows - 1, zero), reach(nrows - 1, ncols - 1))
    return F.struct(F.least(F.greatest(up(far), F.lit(500)), F.lit(4000)).cast("long").alias("npt_1d"),
                    F.least(F.greatest(up(far / 2), F.lit(300)), F.lit(1000)).cast("long").alias("npt_radial"),
                    F.lit(360).alias("npt_azimuthal"))


def azimuth_range(text: str | Sequence[float] | None) -> tuple[float, float] | None:
    """Sector limits from ``lo,hi`` text or a pair; nothing means the whole ring."""
    if text is None or (isinstance(text, str) and not text.strip()):
        return None
    parts = text.replace(";", ",").split(",") if isinstance(text, str) else list(text)
    low, high = (float(p) for p in parts)
    if not low < high:
        raise ValueError("azimuth range must rise")
    return low, high


def integrate(pixels: DataFrame, value: str = "intensity", sector: tuple[float, float] | None = None) -> DataFrame:
    """Azimuthal mean per frame and radial bin (map-side combined)."""
    rows = pixels if sector is None else pixels.where(F.col("azim").between(*sector))
    return rows.groupBy("frame", "rbin").agg(F.avg(value).alias("mean"), F.count(value).alias("n"))


def cake(pixels: DataFrame, value: str = "intensity") -> DataFrame:
    """Mean per frame, radial and azimuthal bin."""
    return pixels.groupBy("frame", "rbin", "abin").agg(F.avg(value).alias("y"))


def band_mean(pixels: DataFrame, value: str = "intensity", low: float = 0.45, high: float = 0.55) -> DataFrame:
    """Mean of the azimuthal quantile band of each frame and radial bin.

    Pixels are first counted per distinct value, so a saturated bin does not
    grow; positions of equal values follow from running counts.  When the band
    is empty the median is used.
    """
    counted = pixels.groupBy("frame", "rbin", F.col(value).alias("v")).agg(F.count(F.lit(1)).alias("c"))
    by = Window.partitionBy("frame", "rbin")
    running = by.orderBy("v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = counted.withColumn("_n", F.sum("c").over(by)).withColumn("_cum", F.sum("c").over(running))
    lo_rank, hi_rank = F.ceil(low * (F.col("_n") - 1)), F.floor(high * (F.col("_n") - 1))
    first, last = F.col("_cum") - F.col("c"), F.col("_cum") - 1
    inside = F.greatest(F.least(last, hi_rank) - F.greatest(first, lo_rank) + 1, F.lit(0))

    def holds(rank: Column) -> Column:
        return (first <= rank) & (last >= rank)
    mid_lo, mid_hi = F.floor((F.col("_n") - 1) / 2), F.ceil((F.col("_n") - 1) / 2)
    out = placed.groupBy("frame", "rbin").agg(
        F.sum(inside * F.col("v")).alias("_s"), F.sum(inside).alias("_k"),
        F.max(F.when(holds(mid_lo), F.col("v"))).alias("_a"), F.max(F.when(holds(mid_hi), F.col("v"))).alias("_b"))
    return out.select("frame", "rbin", F.when(F.col("_k") > 0, F.col("_s") / F.col("_k"))
                      .otherwise((F.col("_a") + F.col("_b")) / 2).alias("robust"))


def sigma_clip(pixels: DataFrame, value: str = "intensity", k: float = 3.0, rounds: int = 3) -> DataFrame:
    """Mean after repeatedly dropping pixels beyond ``k`` sigma, by moments only."""
    stats = None
    for _ in range(rounds + 1):
        rows = pixels if stats is None else (
            pixels.join(stats, ["frame", "rbin"])
            .where(F.abs(F.col(value) - F.col("m")) <= k * F.col("s")))
        stats = rows.groupBy("frame", "rbin").agg(
            F.avg(value).alias("m"), F.coalesce(F.stddev_pop(value), F.lit(0.0)).alias("s"))
    return stats.select("frame", "rbin", F.col("m").alias("sigmaclip"))


def sum_by_pressure(pixels: DataFrame, frames: DataFrame, value: str = "intensity") -> DataFrame:
    """Sum raw pixels over the frames of one pressure; any bad pixel voids the sum."""
    known = frames.where(F.col("pressure").isNotNull()).select("frame", "pressure")
    summed = (pixels.join(known, "frame").groupBy("pressure", "rbin", "abin")
              .agg(F.sum(value).alias("counts"), F.bool_or(F.col(value) < 0).alias("bad")))
    return summed.where(~F.col("bad")).groupBy("pressure", "rbin").agg(
        F.avg("counts").alias("intensity"), (F.sqrt(F.sum("counts")) / F.count(F.lit(1))).alias("sigma"))


def floor_sigma(pattern: DataFrame, by: Sequence[str]) -> DataFrame:
    """Replace a zero sigma by the smallest positive one of its pattern."""
    small = pattern.where(F.col("sigma") > 0).groupBy(*by).agg(F.min("sigma").alias("_s"))
    return (pattern.join(small, list(by), "left")
            .withColumn("sigma", F.when(F.col("sigma") > 0, F.col("sigma")).otherwise(F.col("_s"))).drop("_s"))
