"""Spots of a whole run: attributed to powder rings, consolidated, linked, and joined back to their detections."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, fields

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.axis import circular_difference, radial_to_d
from ..session import checkpointed
from ..sources.files import write_table
from .joins import interval_join
from .matching import match_lines
from .ordered import with_rank
from .spots import blob_spots, consolidate, link_spots, merged_spots

POINT_DIGITS = 9  # pressures that agree to this many digits are one point of the ladder


@dataclass(frozen=True)
class SpotTables:
    """The tables of a run: every detection, one row per reflection and pressure point, tracks, ladders."""

    detections: DataFrame
    points: DataFrame
    tracks: DataFrame
    groups: DataFrame


def ring_place(frame: Column, pressure: Column) -> Column:
    """Where a ring counts: at every frame of its pressure point, without a pressure at its own frame."""
    return F.coalesce(F.concat(F.lit("p"), F.round(pressure, POINT_DIGITS).cast("string")), F.concat(F.lit("f"), frame.cast("string")))


def ring_windows(peaks: DataFrame, frames: DataFrame, *, bin_r: float, fwhm_mult: float = 2.0) -> DataFrame:
    """``place, low, high``: disjoint windows covered by the attributed rings of each place.

    ``peaks`` is ``frame, center, fwhm, phase``; rings without a phase and peaks without a
    centre do not count.  A window is at least ``2 * bin_r`` long, so windows that begin in one
    cell of ``bin_r`` overlap and are merged by a plain aggregate first.  What is left of
    a place is bounded by the axis, however many frames share its pressure.
    """
    half = F.greatest(fwhm_mult * F.col("fwhm"), F.lit(float(bin_r)))
    rings = (peaks.where((F.col("phase") != "") & F.col("center").isNotNull())
             .join(frames.select("frame", "pressure"), "frame", "left")
             .select(ring_place(F.col("frame"), F.col("pressure")).alias("place"),
                     (F.col("center") - half).alias("low"), (F.col("center") + half).alias("high")))
    cells = rings.groupBy("place", F.floor(F.col("low") / float(bin_r)).alias("_cell")).agg(F.min("low").alias("low"), F.max("high").alias("high"))
    before = Window.partitionBy("place").orderBy("low").rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy("place").orderBy("low").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    reach = F.max("high").over(before)
    begun = cells.withColumn("_new", F.when(F.col("low") <= reach, 0).otherwise(1)).withColumn("_window", F.sum("_new").over(upto))
    return begun.groupBy("place", "_window").agg(F.min("low").alias("low"), F.max("high").alias("high")).drop("_window")


def attribute_to_rings(spots: DataFrame, frames: DataFrame, windows: DataFrame) -> DataFrame:
    """Add ``on_ring`` to ``frame, spot, q_peak, ...``: the brightest cell of the spot lies on a ring of its place."""
    placed = spots.join(frames.select("frame", "pressure"), "frame", "left").withColumn("_place", ring_place(F.col("frame"), F.col("pressure")))
    hits = interval_join(windows.withColumnRenamed("place", "_place"), placed.select("_place", "frame", "spot", "q_peak"), ["_place"],
                         F.col("low"), F.col("high"), "q_peak", 0.25)
    # The windows of a place are disjoint, so a spot is hit once.
    marks = hits.select("frame", "spot", F.lit(True).alias("on_ring"))
    return spots.join(marks, ["frame", "spot"], "left").withColumn("on_ring", F.coalesce("on_ring", F.lit(False)))


def ladders(frames: DataFrame, ladder: str, chunk: float) -> DataFrame:
    """``group, axis, position``: the distinct values of each group along the ladder, numbered from 0."""
    value = F.round(F.col("pressure").cast("double"), POINT_DIGITS) if ladder == "pressure" else F.col("frame").cast("double")
    points = frames.select("group", value.alias("axis")).where(F.col("axis").isNotNull() & ~F.isnan("axis")).distinct()
    return with_rank(points, ["group"], ["axis"], "axis", chunk, "position")


def track_table(points: DataFrame, detections: DataFrame) -> DataFrame:
    """One row per track out of its points; the spread of the azimuth is taken about its mean in a second aggregate."""
    rows = points.where(F.col("track").isNotNull())
    w, angle = F.col("intensity"), F.radians("azim")
    first = rows.groupBy("group", "track").agg(
        F.count(F.lit(1)).alias("n_points"), F.min("pressure").alias("p_min"), F.max("pressure").alias("p_max"),
        F.min_by("q", "position").alias("q_first"), F.max_by("q", "position").alias("q_last"), F.min_by("d", "position").alias("d0"),
        F.min("d").alias("d_min"), F.max("d").alias("d_max"), F.regr_slope("d", "pressure").alias("dd_dp"),
        F.degrees(F.atan2(F.sum(w * F.sin(angle)), F.sum(w * F.cos(angle)))).alias("azim_mean"),
        F.max(w).alias("intensity_max"), F.max_by("best_frame", F.struct(w, -F.col("position"))).alias("best_frame"))
    off = circular_difference(F.col("azim"), F.col("azim_mean"))
    spread = rows.join(first.select("track", "azim_mean"), "track").groupBy("track").agg(F.sqrt(F.sum(w * off * off) / F.sum(w)).alias("azim_spread"))
    seen = detections.where(F.col("track").isNotNull()).groupBy("track").agg(F.count_distinct("frame").alias("n_frames"), F.count(F.lit(1)).alias("n_obs"))
    return first.join(spread, "track").join(seen, "track").withColumnRenamed("azim_mean", "azim")


def track_spots(cakes: DataFrame, frames: DataFrame, peaks: DataFrame | None = None, *, n_azim: int, bin_a: float, bin_r: float,
                unit: str = "q", wavelength: float | None = None, ladder: str = "pressure", ladder_chunk: float = 64.0,
                exclude_windows: Sequence[tuple[float, float]] = (), fwhm_mult: float = 2.0, q_tol: float | None = None, azim_tol: float = 6.0,
                link_q_rel: float = 0.05, link_azim_tol: float = 8.0, max_gap: int = 3, min_points: int = 3, predict: bool = True,
                **detection) -> SpotTables:
    """Detect the spots of every cake, set aside those on powder rings, merge them per pressure point and link the points.

    ``frames`` is ``frame`` with ``pressure`` and, if it has them, ``group`` (one ladder each; null
    counts as ''), and ``excluded`` (those cakes are left out).  ``peaks`` (``frame, center, fwhm,
    phase``) are fitted peaks; the rings of one pressure count at all of its frames.  Detections
    on a ring stay in the table with ``on_ring`` and get no point or track, as do those of
    frames without a place on the ladder.  ``ladder`` is 'pressure' or 'frame'.  Links are decided
    position by position within a ladder, see ``link_spots``.
    """
    if ladder not in ("pressure", "frame"):
        raise ValueError(f"ladder must be 'pressure' or 'frame', not {ladder!r}")
    q_tol = 3 * bin_r if q_tol is None else q_tol
    group = F.coalesce(F.col("group").cast("string"), F.lit("")) if "group" in frames.columns else F.lit("all")
    out = F.coalesce(F.col("excluded"), F.lit(False)) if "excluded" in frames.columns else F.lit(False)
    known = frames.select("frame", F.col("pressure").cast("double").alias("pressure"), group.alias("group"), out.alias("excluded"))
    shown = cakes.join(known.where("excluded").select("frame"), "frame", "left_anti")
    found = blob_spots(shown, n_azim=n_azim, bin_a=bin_a, bin_r=bin_r, exclude_windows=exclude_windows, **detection)
    if peaks is None:
        found = found.withColumn("on_ring", F.lit(False))
    else:
        # The kernel would run once for the rings and once for the rows.
        found = attribute_to_rings(checkpointed(found), known, ring_windows(peaks, known, bin_r=bin_r, fwhm_mult=fwhm_mult))
    steps = ladders(known, ladder, ladder_chunk)
    value = F.round("pressure", POINT_DIGITS) if ladder == "pressure" else F.col("frame").cast("double")
    placed = found.join(known.drop("excluded"), "frame", "left").withColumn("axis", value).join(steps, ["group", "axis"], "left")
    detections = checkpointed(placed.select(
        F.concat_ws("-", "frame", "spot").alias("id"), "frame", "group", "position", "axis", "pressure", "q",
        radial_to_d(F.col("q"), unit, wavelength).alias("d"), "azim", "intensity", "area", "snr", "q_width", "azim_width", "n_pixels", "on_ring"))

    free = detections.where(F.col("position").isNotNull() & ~F.col("on_ring"))
    merged = checkpointed(consolidate(free.select("group", "position", "frame", "id", "q", "azim", "intensity", "area"),
                                      ["group", "position"], q_tol=q_tol, azim_tol=azim_tol))
    points = merged_spots(merged, ["group", "position"]).withColumnRenamed("merged", "point").join(steps, ["group", "position"])
    points = checkpointed(points)
    linked = checkpointed(link_spots(points.withColumnRenamed("point", "id"), ["group"], max_gap=max_gap, min_points=min_points,
                                     q_rel=link_q_rel, q_floor=3 * bin_r, azim_tol=link_azim_tol, predict=predict)
                          .select(F.col("id").alias("point"), "track"))
    pressure = F.col("axis") if ladder == "pressure" else F.lit(None).cast("double")
    points = points.join(linked, "point", "left").select(
        "point", "group", "position", "track", pressure.alias("pressure"), "q", radial_to_d(F.col("q"), unit, wavelength).alias("d"),
        "azim", "q_width", "azim_width", "intensity", "area", "n_frames", "best_frame")
    detections = (detections.drop("axis").join(merged.select("id", F.col("merged").alias("point")), "id", "left").join(linked, "point", "left"))
    tracks = track_table(points, detections)
    groups = (known.groupBy("group").agg(F.count_distinct("frame").alias("n_frames"))
              .join(detections.groupBy("group").agg(F.count(F.lit(1)).alias("n_obs")), "group", "left")
              .join(tracks.groupBy("group").agg(F.count(F.lit(1)).alias("n_tracks")), "group", "left").fillna(0, ["n_obs", "n_tracks"]))
    return SpotTables(detections, points, tracks, groups)


def label_tracks(tracks: DataFrame, lines: DataFrame, rel_tol: float = 0.03) -> DataFrame:
    """Tracks with the closest calculated line of their lowest pressure, null where none is within ``rel_tol``.

    ``lines`` is ``phase, ord, d, w``, as ``read_reflections`` gives them.
    """
    near = match_lines(tracks.select(F.col("track").alias("id"), F.col("d0").alias("d")), lines, rel_tol=rel_tol, top=1)
    return tracks.join(near.select(F.col("id").alias("track"), "line_phase", "line_ord", "d_calc", "delta_rel", "line_weight"), "track", "left")


def untracked(points: DataFrame) -> DataFrame:
    """Points that no track holds: reflections seen at one stretch of pressure only."""
    return points.where(F.col("track").isNull()).drop("track")


def save_spot_tables(tables: SpotTables, folder: str, kind: str = "parquet") -> None:
    """Write the tables of a run beside each other."""
    for field in fields(tables):
        write_table(getattr(tables, field.name), f"{folder}/{field.name}", kind)


def load_spot_tables(spark: SparkSession, folder: str, min_points: int = 1) -> SpotTables:
    """Stored tables of a run; tracks of fewer than ``min_points`` points are left out, their points become untracked."""
    stored = {f.name: spark.read.parquet(f"{folder}/{f.name}") for f in fields(SpotTables)}
    tracks = stored["tracks"].where(F.col("n_points") >= min_points)
    kept = tracks.select("track", F.lit(True).alias("_kept"))
    for name in ("points", "detections"):
        rows = stored[name].join(kept, "track", "left")
        stored[name] = rows.withColumn("track", F.when(F.col("_kept"), F.col("track"))).drop("_kept")
    return SpotTables(**{**stored, "tracks": tracks})
