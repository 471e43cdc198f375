"""Patterns measured on axes of their own, brought onto one common axis."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.arrays import array_diff, array_median
from ..sources.files import read_xy
from .ordered import exact_quantiles

MIN_POINTS = 16
SLACK = 1e-9  # of a step: a knot this close above a grid point still holds it


def knots(points: DataFrame, key: str, min_points: int = MIN_POINTS) -> DataFrame:
    """``key, k``: the sorted knots of each pattern as one array, as long as its detector allows.

    Rows without finite x or y go, y of one x are averaged, and patterns of fewer than
    ``min_points`` different x are left out.
    """
    finite = [F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")) for c in ("x", "y")]
    means = points.where(finite[0] & finite[1]).groupBy(key, "x").agg(F.avg("y").alias("y"))
    packed = means.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("x", "y"))).alias("k"))
    return packed.where(F.size("k") >= min_points)


def common_axis(packed: DataFrame) -> DataFrame:
    """One row ``start, stop, step``: the union of all ranges and the median over patterns of their median steps."""
    own = packed.select(F.get("k", F.lit(0))["x"].alias("first"), F.element_at("k", -1)["x"].alias("last"), array_median(array_diff(F.col("k.x"))).alias("own"))
    ends = own.agg(F.min("first").alias("start"), F.max("last").alias("stop"))
    # Both sides are one row.
    return ends.select("start", "stop", exact_quantiles(own, "own", [0.5]).select("q0").scalar().alias("step"))


def on_common_axis(points: DataFrame, key: str = "filename", min_points: int = MIN_POINTS) -> DataFrame:
    """``key, bin, radial, y``: every pattern interpolated linearly at the points of the common axis inside its own range.

    ``points`` is ``key, x, y`` in any order, see ``knots`` for what is left out.  A
    segment between two knots gives the grid points from its left knot up to the one before its right knot's,
    so each is given once; no pattern is compared with the grid as a whole.
    """
    packed = knots(points, key, min_points)
    axis = common_axis(packed)
    start, step = axis.select("start").scalar(), axis.select("step").scalar()
    rows = packed.select(key, start.alias("_start"), step.alias("_step"), F.posexplode("k").alias("_i", "_a"), "k")
    rows = rows.select(key, "_start", "_step", "_a", F.get("k", F.col("_i") + 1).alias("_b"))

    def at(x: Column) -> Column:
        return F.ceil((x - F.col("_start")) / F.col("_step") - SLACK)

    # The last knot holds a grid point of its own only if one lies on it.
    begin, left_of = at(F.col("_a.x")), F.when(F.col("_b").isNotNull(), at(F.col("_b.x"))).otherwise(
        F.floor((F.col("_a.x") - F.col("_start")) / F.col("_step") + SLACK) + 1)
    hits = rows.withColumn("_begin", begin).withColumn("_end", left_of).where("_begin < _end")
    hits = hits.withColumn("bin", F.explode(F.sequence("_begin", F.col("_end") - 1)))
    radial = F.col("_start") + F.col("_step") * F.col("bin")
    part = (F.col("radial") - F.col("_a.x")) / (F.col("_b.x") - F.col("_a.x"))
    y = F.when(F.col("_b").isNull(), F.col("_a.y")).otherwise(F.col("_a.y") + F.greatest(F.least(part, F.lit(1.0)), F.lit(0.0)) * (F.col("_b.y") - F.col("_a.y")))
    return hits.withColumn("radial", radial).select(key, F.col("bin").cast("long").alias("bin"), "radial", y.alias("y"))


def pack(rows: DataFrame, n_bins: int, key: str = "filename") -> DataFrame:
    """``key, clean``: one array row per pattern, null where a bin was not measured; what the pattern operators take."""
    cells = rows.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("bin", "y"))).alias("_m"))
    return cells.select(key, F.transform(F.sequence(F.lit(0), F.lit(n_bins - 1)), lambda b: F.try_element_at("_m", b.cast("long"))).alias("clean"))


def ingest_folder(spark: SparkSession, folder: str, pattern: str = "*.xy", min_points: int = MIN_POINTS) -> DataFrame:
    """Text patterns of a folder on one common axis: ``filename, bin, radial, y``."""
    return on_common_axis(read_xy(spark, folder, pattern), "filename", min_points)
