"""Scan-grid maps: serpentine order, coordinate clustering, per-cell values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .joins import nearest_join
from .ordered import with_island, with_previous, with_rank


def grid_position(index: Column, line: int, *, order: str = "horizontal", serpentine: bool = True) -> Column:
    """Struct ``row, col`` of a linear frame index on a scan grid of ``line`` frames per line."""
    if line <= 0 or order not in ("horizontal", "vertical"):
        raise ValueError("give a positive line length and a horizontal or vertical order")
    major = F.floor(index / line)
    minor = F.pmod(index, F.lit(line))
    if serpentine:
        minor = F.when(F.pmod(major, F.lit(2)) == 1, line - 1 - minor).otherwise(minor)
    row, col = (major, minor) if order == "horizontal" else (minor, major)
    return F.struct(row.cast("long").alias("row"), col.cast("long").alias("col"))


def line_tolerance(values: DataFrame, value: str, chunk: float) -> DataFrame:
    """One row: the gap that separates scan lines from motor jitter.

    It is the geometric mean across the largest ratio of consecutive sorted
    gaps when that exceeds 4, else half the smallest gap.
    """
    distinct = values.select(F.col(value).alias("v")).where(F.col("v").isNotNull()).distinct()
    gaps = (with_previous(distinct, [], ["v"], "v", chunk, ["v"])
            .select((F.col("v") - F.col("prev_v")).alias("gap")).where(F.col("gap") > 0).groupBy("gap").count())
    # Repeated equal gaps have ratio 1, so distinct gaps are enough; their chunks are decades.
    steps = with_previous(gaps.withColumn("decade", F.log10("gap")), [], ["decade", "gap"], "decade", 0.25, ["gap"])
    best = F.max_by(F.struct((F.col("gap") / F.col("prev_gap")).alias("ratio"), "gap", "prev_gap"),
                    F.when(F.col("prev_gap").isNotNull(), F.struct(F.col("gap") / F.col("prev_gap"), -F.col("gap"))))
    found = steps.groupBy().agg(best.alias("b"), F.min("gap").alias("smallest"))
    return found.select(F.when(F.col("b.ratio") > 4, F.sqrt(F.col("b.gap") * F.col("b.prev_gap")))
                        .otherwise(F.coalesce(F.col("smallest") / 2, F.lit(0.0))).alias("tolerance"))


def cluster_lines(values: DataFrame, value: str, chunk: float, tolerance: float | None = None,
                  name: str = "line") -> DataFrame:
    """Add ``name``: the 0-based scan line of each coordinate."""
    gap = F.lit(float(tolerance)) if tolerance is not None else line_tolerance(values, value, chunk).scalar()
    points = values.select(F.col(value).alias("_v")).where(F.col("_v").isNotNull()).distinct()
    lines = with_island(points, [], ["_v"], "_v", chunk, gap, name)
    return values.join(lines, F.col(value) == F.col("_v")).drop("_v")


def coordinate_grid(positions: DataFrame, chunk: float) -> DataFrame:
    """Frame per grid cell; the later frame wins a shared cell, which counts as a collision."""
    usable = positions.where(F.col("pos_x").isNotNull() & F.col("pos_y").isNotNull())
    placed = cluster_lines(cluster_lines(usable, "pos_x", chunk, name="col"), "pos_y", chunk, name="row")
    return placed.groupBy("row", "col").agg(F.max("frame").alias("frame"),
                                            (F.count(F.lit(1)) - 1).alias("collisions"))




def value_map(positions: DataFrame, values: DataFrame, chunk: float, fill: bool = True) -> DataFrame:
    """``row, col, value, n, filled``: a scalar of the frames on every cell of the grid that their positions imply.

    ``values`` is ``frame, value``.  Frames that share a cell are averaged (``n`` of them with a value); cells
    without a value take that of the nearest cell of their row, the left one of two as near, and are
    marked ``filled``; a row without any value, or ``fill`` off, leaves them null.  The result has a row per cell.
    """
    usable = positions.where(F.col("pos_x").isNotNull() & F.col("pos_y").isNotNull())
    placed = cluster_lines(cluster_lines(usable, "pos_x", chunk, name="col"), "pos_y", chunk, name="row")
    seen = placed.join(values.select("frame", "value"), "frame").where(F.col("value").isNotNull())
    held = seen.groupBy("row", "col").agg(F.avg("value").alias("value"), F.count(F.lit(1)).alias("n"))
    ends = placed.agg(F.max("col")).scalar()
    cells = placed.select("row").distinct().withColumn("col", F.explode(F.sequence(F.lit(0).cast("long"), ends)))
    grid = cells.join(held, ["row", "col"], "left")
    if not fill:
        return grid.select("row", "col", "value", F.coalesce("n", F.lit(0)).alias("n"), F.lit(False).alias("filled"))
    near = nearest_join(grid.where(F.col("n").isNull()).select("row", "col"), held.select("row", F.col("col").alias("at")), ["row"], "col", "at", 64.0)
    lent = near.join(held.select("row", F.col("col").alias("nearest"), "value"), ["row", "nearest"], "left").select(
        "row", "col", "value", F.lit(0).cast("long").alias("n"), F.col("value").isNotNull().alias("filled"))
    return grid.where(F.col("n").isNotNull()).select("row", "col", "value", "n", F.lit(False).alias("filled")).unionByName(lent)


def pattern_image(bins: DataFrame, frames: DataFrame, value: str = "clean", variable: str = "frame") -> DataFrame:
    """``rank, x, bin, radial, value``: the patterns side by side along a series variable, frames without it left out.

    ``frames`` is ``frame`` and the variable.  ``rank`` counts the frames in the variable's order, ties by frame;
    null samples stay, so every frame of the image has all its bins.
    """
    known = frames.where(F.col(variable).isNotNull()).select("frame", F.col(variable).cast("double").alias("x")).distinct()
    order = with_rank(known, [], ["x", "frame"], "x", 64.0, "rank")
    return bins.join(order, "frame").select("rank", "x", "bin", "radial", F.col(value).alias("value"))
