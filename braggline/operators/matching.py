"""Observed peaks against predicted lines: windows, nearest lines, ranked matches."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.axis import to_q
from .joins import interval_join

# Fixed value: ambient diamond lattice constant in angstrom.
DIAMOND_A0 = 3.56712


def normalize_reflections(lines: DataFrame, *, max_lines: int = 40, min_weight: float = 0.01) -> DataFrame:
    """Strongest lines of each phase, weights relative to the strongest.

    A phase has at most a few hundred lines, so the window stays small.
    """
    order = Window.partitionBy("phase").orderBy(F.desc("w"), "ord")
    return (lines.withColumn("w", F.col("w") / F.max("w").over(Window.partitionBy("phase")))
            .where(F.col("w") >= min_weight)
            .withColumn("rank", F.row_number().over(order))
            .where(F.col("rank") <= max_lines))


def diamond_lines(q_max: float, a: float = DIAMOND_A0) -> list[float]:
    """Allowed diamond reflections up to ``q_max``: all odd, or all even adding up to 4n."""
    top = math.ceil(a * q_max / (2 * math.pi))
    squares = {h * h + k * k + l * l
               for h in range(top + 1) for k in range(h + 1) for l in range(k + 1)
               if (h % 2 == k % 2 == l % 2 == 1)
               or (h % 2 == k % 2 == l % 2 == 0 and (h + k + l) % 4 == 0)}
    lines = (round(2 * math.pi * math.sqrt(n) / a, 9) for n in sorted(squares) if n)
    return [q for q in lines if q <= q_max]


def diamond_windows(q_max: float, *, a: float = DIAMOND_A0, rel_tol: float = 0.02,
                    max_compression: float = 0.04) -> list[tuple[float, float]]:
    """Exclusion windows, wider towards high q because the anvil only shrinks."""
    up = rel_tol + max_compression
    return [(q * (1 - rel_tol), q * (1 + up)) for q in diamond_lines(q_max * (1 + up) + 1e-9, a)]


def line_windows(exclude_d: Sequence[float], width: float = 0.028) -> list[tuple[float, float]]:
    """Fractional q windows around contaminant d-spacings."""
    return [(2 * math.pi / d * (1 - width), 2 * math.pi / d * (1 + width)) for d in exclude_d]


def in_windows(q: Column, windows: Sequence[tuple[float, float]]) -> Column:
    """True inside any window; the list is a literal, so this stays in the projection."""
    hit = F.lit(False)
    for low, high in windows:
        hit = hit | q.between(low, high)
    return hit


def d_window_mask(radial: Column, unit: str, wavelength, exclude_d: Sequence[float],
                  width: float = 0.028) -> Column:
    return in_windows(to_q(radial, unit, wavelength), line_windows(exclude_d, width))


def match_lines(observed: DataFrame, lines: DataFrame, *, value: str = "d", rel_tol: float = 0.03,
                top: int = 3, key: Sequence[str] = ("id",), bucket: float = 0.05) -> DataFrame:
    """Up to ``top`` closest lines within ``rel_tol`` of each observation.

    The tolerance is relative to the line, so its window is ``d/(1 -+ tol)``.
    """
    low = F.col(value) / (1 + rel_tol) * (1 - 1e-12)
    high = F.col(value) / (1 - rel_tol) * (1 + 1e-12)
    calc = lines.select(F.col("phase").alias("line_phase"), F.col("ord").alias("line_ord"),
                        F.col("d").alias("d_calc"), F.col("w").alias("line_weight"))
    pairs = (interval_join(observed, calc, [], low, high, "d_calc", bucket)
             .withColumn("delta_rel", (F.col(value) - F.col("d_calc")) / F.col("d_calc"))
             .where(F.abs("delta_rel") <= rel_tol))
    order = Window.partitionBy(*key, value).orderBy(F.abs("delta_rel"), "line_phase", "line_ord")
    return (pairs.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
            .select(*key, value, "rank", "line_phase", "line_ord", "d_calc", "delta_rel", "line_weight"))


def pooled_attributed(peaks: DataFrame, frames: DataFrame) -> DataFrame:
    """Distinct attributed ring positions of each pressure point.

    A ring seen in one frame of a pressure point excludes spots in all of them;
    the distinct rings are pooled per pressure rather than copied per frame.
    """
    known = frames.where(F.col("pressure").isNotNull()).select("frame", F.round("pressure", 9).alias("pressure"))
    return (peaks.where(F.col("phase") != "").join(known, "frame")
            .groupBy("pressure", "center").agg(F.max("fwhm").alias("fwhm"), F.count(F.lit(1)).alias("n_peaks")))


def track_labels(points: DataFrame) -> DataFrame:
    """Pressure-sorted points of each track with slope and zero-pressure d."""
    return points.groupBy("track").agg(
        F.count(F.lit(1)).alias("n_points"), F.min_by("d", "pressure").alias("d0"),
        F.min("pressure").alias("p_min"), F.max("pressure").alias("p_max"),
        F.regr_slope("d", "pressure").alias("dd_dp"))


def phase_layers(bins: DataFrame, lines: DataFrame, *, rel_tol: float = 0.01, value: str = "y",
                 bucket: float = 0.25) -> DataFrame:
    """Intensity summed around the predicted lines of each phase and frame.

    ``lines`` is ``phase, frame, center`` when lines move with the frame, or
    ``phase, center`` when they do not.  Bins are pre-summed per axis position
    only when lines are frame independent, so the join is against one axis row
    per bin; a bin inside two windows counts twice, as two lines claim it.
    """
    half = F.greatest(rel_tol * F.abs(F.col("center")), F.lit(1e-9))
    low, high = F.col("center") - half, F.col("center") + half
    if "frame" in lines.columns:
        hits = interval_join(lines, bins, ["frame"], low, high, "radial", bucket)
    else:
        axis = bins.select("bin", "radial").distinct()
        weights = (interval_join(lines, axis, [], low, high, "radial", bucket)
                   .groupBy("phase", "bin").agg(F.count(F.lit(1)).alias("_times")))
        hits = bins.join(weights, "bin").withColumn(value, F.col(value) * F.col("_times"))
    raw = hits.groupBy("phase", "frame").agg(F.sum(value).alias("intensity_raw"))
    top = raw.groupBy("phase").agg(F.max("intensity_raw").alias("_top"))
    return (raw.join(top, "phase")
            .withColumn("intensity", F.when(F.col("_top") > 0, F.col("intensity_raw") / F.col("_top"))
                        .otherwise(F.col("intensity_raw"))).drop("_top"))


def predicted_lines(states: DataFrame, lines: DataFrame, scale: Column, max_lines: int = 12) -> DataFrame:
    """Predicted d of the strongest lines of each phase at the state of each frame.

    ``states`` is ``frame, phase`` with the columns ``scale`` needs (pressure,
    temperature, equation of state); a line follows its phase's lattice scale.
    """
    strongest = normalize_reflections(lines, max_lines=max_lines).select("phase", "ord", "d", "w")
    return states.withColumn("_scale", scale).join(strongest, "phase").withColumn(
        "pred_d", F.col("d") * F.col("_scale")).drop("_scale")
