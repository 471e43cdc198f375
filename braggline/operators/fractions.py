"""Semi-quantitative phase fractions from attributed peak areas."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def attributed(peaks: DataFrame) -> DataFrame:
    """Good peaks that carry a phase and a finite area."""
    return peaks.where((F.col("flag") == 0) & (F.col("phase") != "") & F.col("area").isNotNull())


def valid_rir(value) -> bool:
    try:
        return 0 < float(value) < float("inf")
    except (TypeError, ValueError):
        return False


def rir_column(phase: Column, rir: Mapping[str, float] | None) -> Column:
    out = F.lit(1.0)
    for name, value in (rir or {}).items():
        if valid_rir(value):
            out = F.when(phase == name, F.lit(float(value))).otherwise(out)
    return out


def phase_fractions(peaks: DataFrame, *, rir: Mapping[str, float] | None = None,
                    identified: DataFrame | None = None,
                    min_confidence: float | None = None) -> DataFrame:
    """Share of each phase in each frame's attributed area.

    Columns ``frame, phase, area, fraction``; frames without attributed area have
    no row (see :func:`dense`).  The confidence gate is strict, and a phase
    without an identification is not gated.
    """
    rows = attributed(peaks)
    if min_confidence is not None and identified is not None:
        gate = identified.select("frame", "phase", "confidence")
        known = gate.select("phase").distinct().withColumn("_known", F.lit(True))
        rows = (rows.join(gate, ["frame", "phase"], "left").join(known, "phase", "left")
                .where(F.col("_known").isNull() | (F.col("confidence") > min_confidence)))
    weighted = rows.select("frame", "phase",
                           (F.col("area") / rir_column(F.col("phase"), rir)).alias("area"))
    sums = weighted.groupBy("frame", "phase").agg(F.sum("area").alias("area"))
    total = F.sum("area").over(Window.partitionBy("frame"))
    return (sums.withColumn("_total", total)
            .withColumn("fraction", F.when(F.col("_total") > 0, F.col("area") / F.col("_total")))
            .drop("_total"))


def dense(fractions: DataFrame, frames: DataFrame) -> DataFrame:
    """A null row for every frame that has no attributed area."""
    return frames.select("frame").join(fractions, "frame", "left")


def fraction_summary(fractions: DataFrame, present: float = 0.05) -> DataFrame:
    """Per phase: mean, maximum and number of frames above ``present``."""
    return fractions.groupBy("phase").agg(
        F.avg("fraction").alias("mean_fraction"), F.max("fraction").alias("max_fraction"),
        F.count_if(F.col("fraction") > present).alias("n_present"))
