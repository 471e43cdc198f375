"""Frame metadata: series axes and groups, name matching, merges."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import metadata as md
from .joins import spread
from .ordered import with_previous, with_rank

VALUE_KEYS = ("pressure", "pressure_sigma", "temperature", "pos_x", "pos_y")
FRAME_CHUNK = 1_000_000
AXES = ("frame", "pressure", "temperature", "time")
GROUPS = ("none", "scan", "folder")


def canonical_columns(rows: DataFrame) -> DataFrame:
    """Rename accepted header spellings, cast values, keep rows with a key and a value."""
    lookup = {alias: name for name, aliases in md.CSV_ALIASES.items() for alias in aliases}
    chosen: dict[str, str] = {}
    for column in rows.columns:
        name = lookup.get(column.strip().lower())
        if name and name not in chosen:
            chosen[name] = column
    values = [k for k in VALUE_KEYS if k in chosen]
    if not values:
        raise ValueError("no value column in the metadata rows")
    if "frame" not in chosen and "filename" not in chosen:
        raise ValueError("no frame or filename column in the metadata rows")
    out = rows.select(
        *[c for c in rows.columns if c not in chosen.values()],
        (F.col(chosen["frame"]).cast("string").try_cast("long") if "frame" in chosen
         else F.lit(None).cast("long")).alias("frame"),
        (F.nullif(F.trim(F.col(chosen["filename"]).cast("string")), F.lit("")) if "filename" in chosen
         else F.lit(None).cast("string")).alias("filename"),
        *[(md.finite_number(F.col(chosen[k])) if k in chosen
           else F.lit(None).cast("double")).alias(k) for k in VALUE_KEYS])
    return out.where((F.col("frame").isNotNull() | F.col("filename").isNotNull())
                     & F.coalesce(*[F.col(k) for k in VALUE_KEYS]).isNotNull())


def map_rows_to_frames(rows: DataFrame, frames: DataFrame, order: str) -> DataFrame:
    """Values per frame out of metadata rows.

    A frame number beats a name; a name matches by whole path, base name, then
    stem, and a key shared by several frames means the first of them.  Of
    several rows for one frame the last value in ``order`` wins.
    """
    keys = (frames.select("frame", F.explode(md.name_keys(F.col("filename"))).alias("_key"))
            .groupBy("_key").agg(F.min("frame").alias("_hit")))
    direct = rows.where(F.col("frame").isNotNull())
    named = (rows.where(F.col("frame").isNull()).drop("frame")
             .select("*", F.posexplode(md.name_keys(F.col("filename"))).alias("_rank", "_key"))
             .join(keys, "_key"))
    best = named.groupBy(order).agg(F.min_by("_hit", "_rank").alias("frame"),
                                    *[F.first(k).alias(k) for k in VALUE_KEYS])
    placed = direct.select(order, "frame", *VALUE_KEYS).unionByName(best)
    latest = placed.groupBy("frame").agg(*[
        F.max_by(k, F.when(F.col(k).isNotNull(), F.col(order))).alias(k) for k in VALUE_KEYS])
    return frames.select("frame").join(latest, "frame")


def merge_values(frames: DataFrame, new: DataFrame, columns: Sequence[str], *,
                 replace: bool = False, edited: str | None = None) -> DataFrame:
    """Overwrite ``columns`` where the new value is finite (or always, with ``replace``).

    Rows marked in ``edited`` keep what the user entered.
    """
    other = new.select("frame", *[F.col(c).alias(f"_n_{c}") for c in columns])
    out = frames.join(other, "frame", "left")
    for c in columns:
        merged = F.col(f"_n_{c}") if replace else F.coalesce(F.col(f"_n_{c}"), F.col(c))
        if edited:
            merged = F.when(F.col(edited), F.col(c)).otherwise(merged)
        out = out.withColumn(c, merged)
    return out.drop(*[f"_n_{c}" for c in columns])


def carry_user_values(frames: DataFrame, previous: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Carry user-edited values into rebuilt frames, by filename first, then by index."""
    edits = previous.where("user_edited")
    by_name = (edits.groupBy("filename")
               .agg(*[F.max_by(c, "frame").alias(f"_f_{c}") for c in columns],
                    F.lit(True).alias("_by_name")))
    by_index = edits.select("frame", *[F.col(c).alias(f"_i_{c}") for c in columns],
                            F.lit(True).alias("_by_index"))
    out = frames.join(by_name, "filename", "left").join(by_index, "frame", "left")
    for c in columns:
        carried = F.when(F.col("_by_name"), F.col(f"_f_{c}")).when(F.col("_by_index"), F.col(f"_i_{c}"))
        out = out.withColumn(c, F.coalesce(carried, F.col(c)))
    return out.withColumn("user_edited", F.coalesce(F.col("_by_name"), F.col("_by_index"), F.lit(False))).drop(
        "_by_name", "_by_index", *[f"_{p}_{c}" for p in "fi" for c in columns])


def set_excluded(frames: DataFrame, chosen: DataFrame, excluded: bool) -> DataFrame:
    """Set the exclusion flag of the frames listed in ``chosen``."""
    marked = chosen.select("frame").distinct().withColumn("_hit", F.lit(True))
    return (frames.join(marked, "frame", "left")
            .withColumn("excluded", F.when(F.col("_hit"), F.lit(excluded)).otherwise(F.col("excluded")))
            .drop("_hit"))


def summarize_pressures(frames: DataFrame, by: Sequence[str]) -> DataFrame:
    """Counts, range and monotonicity (in frame order) of the known pressures."""
    by = list(by)
    known = frames.where(F.col("pressure").isNotNull()).select(*by, "frame", "pressure")
    steps = with_previous(known, by, ["frame"], "frame", FRAME_CHUNK, ["pressure"])
    step = F.col("pressure") - F.col("prev_pressure")
    trend = steps.groupBy(*by).agg(
        ((F.count("pressure") >= 2) & (F.coalesce(F.bool_and(step >= -1e-9), F.lit(True))
                                       | F.coalesce(F.bool_and(step <= 1e-9), F.lit(True)))).alias("monotonic"))
    stats = frames.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_frames"), F.count("pressure").alias("n_parsed"),
        (F.count("pressure") / F.count(F.lit(1))).alias("frac_parsed"),
        F.min("pressure").alias("p_min"), F.max("pressure").alias("p_max"))
    return (stats.join(trend, by, "left")
            .withColumn("monotonic", F.coalesce(F.col("monotonic"), F.lit(False))))


def elapsed_seconds(frames: DataFrame, stamp: str) -> DataFrame:
    """Add ``elapsed``: seconds since the first readable time stamp."""
    micros = F.unix_micros(F.col(stamp).try_cast("timestamp"))
    first = frames.select(F.min(micros)).scalar()
    return frames.withColumn("elapsed", (micros - first) / 1_000_000)


def series_axis(frames: DataFrame, kind: str = "frame", stamp: str = "stamp") -> DataFrame:
    """Add ``axis``: the ordering value of each frame, null where it is unknown."""
    key = (kind or "frame").strip().lower()
    key = "frame" if key in ("index", "same", "") else key
    if key not in AXES:
        raise ValueError(f"axis must be one of {AXES}, not {kind!r}")
    if key == "time":
        return elapsed_seconds(frames, stamp).withColumnRenamed("elapsed", "axis")
    return frames.withColumn("axis", F.col(key).cast("double"))


def series_group(frames: DataFrame, kind: str = "none") -> DataFrame:
    """Add ``group_id`` and ``group_label``; ids follow the first appearance of a label."""
    key = (kind or "none").strip().lower()
    key = "none" if key in ("all", "same", "") else key
    if key not in GROUPS:
        raise ValueError(f"group must be one of {GROUPS}, not {kind!r}")
    if key == "none":
        return frames.withColumn("group_id", F.lit(0).cast("long")).withColumn("group_label", F.lit("all"))
    label = md.scan_label if key == "scan" else md.folder_label
    named = frames.withColumn("group_label", label(F.col("filename")))
    first = named.groupBy("group_label").agg(F.min("frame").alias("_first"))
    ids = with_rank(first, [], ["_first"], "_first", FRAME_CHUNK, "group_id").drop("_first")
    return named.join(ids, "group_label")


def order_frames(frames: DataFrame, by: Sequence[str], axis: str, width: float) -> DataFrame:
    """Drop excluded frames and add ``row``: position by axis, unknown axis last."""
    live = frames.where(~F.col("excluded"))
    ranked = with_rank(live.where(F.col(axis).isNotNull()), by, [axis, "frame"], axis, width, "row")
    missing = live.where(F.col(axis).isNull())
    known = ranked.groupBy(*by).agg(F.count(F.lit(1)).alias("_known"))
    tail = (with_rank(missing, by, ["frame"], "frame", FRAME_CHUNK, "row")
            .join(known, list(by), "left")
            .withColumn("row", F.col("row") + F.coalesce(F.col("_known"), F.lit(0))).drop("_known"))
    return ranked.unionByName(tail)


def expand_sources(files: DataFrame) -> DataFrame:
    """One row per frame out of ``file, dataset, n_frames`` container rows.

    A container is short and becomes a row per frame, so a task gets few of them whatever their bytes.
    """
    return (spread(files.where(F.col("n_frames") > 0), "file")
            .withColumn("index", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_frames").cast("long") - 1)))
            .withColumn("source", F.concat("file", F.lit("::"), "dataset", F.lit("#"),
                                           F.lpad(F.col("index").cast("string"), 6, "0"))))


def merge_library(user: DataFrame, bundled: DataFrame) -> DataFrame:
    """User phases shadow bundled ones of the same name."""
    return (user.withColumn("builtin", F.lit(False))
            .unionByName(bundled.join(user.select("name"), "name", "left_anti")
                         .withColumn("builtin", F.lit(True)), allowMissingColumns=True))


def library_position(category: Column, order: Sequence[str]) -> Column:
    """Sort key of a category: its place in ``order``, unknown ones last."""
    place = F.array_position(F.array(*[F.lit(c) for c in order]), category)
    return F.when(place > 0, place - 1).otherwise(len(order))


def upsert(library: DataFrame, rows: DataFrame, key: str = "name") -> DataFrame:
    return library.join(rows.select(key), key, "left_anti").unionByName(rows, allowMissingColumns=True)


def remove_phases(user: DataFrame, names: DataFrame, key: str = "name") -> DataFrame:
    """The user library without the named phases; bundled phases are shadowed, never removed."""
    return user.join(names.select(key), key, "left_anti")


def latest_file(files: DataFrame, by: Sequence[str], path: str, modified: str) -> DataFrame:
    """Newest path per group; the smallest path breaks a tie."""
    return (files.groupBy(*by)
            .agg(F.max(modified).alias("modified"),
                 F.min_by(path, F.struct(-F.unix_micros(F.col(modified).cast("timestamp")), F.col(path))).alias("path")))
