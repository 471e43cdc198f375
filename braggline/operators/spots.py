"""Single-crystal spots: detection, consolidation and ladder linking."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.axis import circular_difference
from .joins import interval_join, sorted_stream, spread
from .matching import in_windows
from .ordered import with_island
from .tracks import local_slope_center

SPOT_COLUMNS = ("q", "azim", "intensity", "area", "snr", "q_width", "azim_width", "n_pixels")


def bright_cells(cakes: DataFrame, *, min_snr: float = 6.0, min_intensity: float = 20.0,
                 min_samples: int = 30) -> DataFrame:
    """Cells above the azimuthal median of their radial column by the noise threshold.

    A column is as long as the cake has azimuth bins, so grouped medians are
    bounded.
    """
    column = ["frame", "rbin"]
    level = cakes.groupBy(*column).agg(F.median("y").alias("level"), F.count("y").alias("n")).where(F.col("n") >= min_samples)
    excess = cakes.join(level, column).withColumn("excess", F.col("y") - F.col("level")).drop("level", "n")
    noise = excess.groupBy(*column).agg((1.4826 * F.median(F.abs("excess"))).alias("sigma"))
    return excess.join(noise, column).where(F.col("excess") > F.greatest(min_snr * F.col("sigma"), F.lit(min_intensity)))


def label_blobs(a: np.ndarray, r: np.ndarray, n_azim: int, frame: np.ndarray | None = None) -> np.ndarray:
    """Component label of each cell, its first cell, 8-connected inside its frame, azimuth wrapping round."""
    if not a.size:
        return np.zeros(0, int)
    a, r = a.astype(np.int64), r.astype(np.int64) - r.min() + 1
    of = np.zeros(a.size, np.int64) if frame is None else np.unique(frame, return_inverse=True)[1]
    rows, columns = max(n_azim, a.max() + 1) + 1, r.max() + 2
    key = lambda at, ring: (of * rows + at) * columns + ring
    cells = key(a, r)
    order = np.argsort(cells, kind="stable")
    cells = cells[order]
    one, two = [], []
    for da, dr in ((0, 0), (0, 1), (1, -1), (1, 0), (1, 1)):
        beside = key((a + da) % n_azim if n_azim > 2 else a + da, r + dr)
        place = np.minimum(np.searchsorted(cells, beside), a.size - 1)
        met = np.flatnonzero(cells[place] == beside)
        one.append(met)
        two.append(order[place[met]])
    one, two = np.concatenate(one), np.concatenate(two)
    label = np.arange(a.size)
    while True:
        low = np.minimum(label[one], label[two])
        now = label.copy()
        np.minimum.at(now, one, low)
        np.minimum.at(now, two, low)
        now = now[now]
        if (now == label).all():
            return label
        label = now


def blob_rows(cells: pd.DataFrame, n_azim: int, bin_a: float, bin_r: float, min_pixels: int, max_azim: float,
              max_radial: int) -> pd.DataFrame:
    """Spots of whole cakes: sums over the labelled cells, positions told from each blob's brightest cell, numbered by falling peak."""
    # The order of the cells decides ties and labels, so a task that runs again names the same spots.
    cells = cells.sort_values(["frame", "abin", "rbin"]).reset_index(drop=True)
    cells = cells.assign(blob=label_blobs(cells["abin"].to_numpy(), cells["rbin"].to_numpy(), n_azim, cells["frame"].to_numpy()))
    top = cells.loc[cells.groupby("blob")["excess"].idxmax()].set_index("blob")
    half = n_azim // 2
    cells["turn"] = bin_a * ((cells["abin"] - cells["blob"].map(top["abin"]) + half) % n_azim - half)
    cells["weight"] = cells["excess"].clip(lower=0)
    total = cells.groupby("blob")["weight"].sum().replace(0, 1.0)

    def mean(values: pd.Series) -> pd.Series:
        """Weighted mean per blob."""
        return (values * cells["weight"]).groupby(cells["blob"]).sum() / total

    def width(values: pd.Series, least: float) -> pd.Series:
        """Full width at half maximum about the weighted mean, one bin at least."""
        off = values - cells["blob"].map(mean(values))
        return (2.3548 * np.sqrt(mean(off * off))).clip(lower=least)

    angle = np.radians(cells["azim"])
    by = cells.groupby("blob")
    out = pd.DataFrame({
        "frame": top["frame"], "q": mean(cells["radial"]), "azim": np.degrees(np.arctan2(mean(np.sin(angle)), mean(np.cos(angle)))),
        "intensity": top["excess"], "area": by["excess"].sum(), "snr": (top["excess"] / top["sigma"].where(top["sigma"] > 0)).fillna(math.inf),
        "q_width": width(cells["radial"], bin_r), "azim_width": width(cells["turn"], bin_a), "n_pixels": by.size(), "q_peak": top["radial"]})
    spans = (by["rbin"].max() - by["rbin"].min() + 1 <= max_radial) & (by["turn"].max() - by["turn"].min() + bin_a <= max_azim)
    kept = out[(out["n_pixels"] >= min_pixels) & spans]
    kept = kept.iloc[np.lexsort((kept.index, -kept["intensity"], kept["frame"]))]
    return kept.assign(spot=kept.groupby("frame").cumcount())[["frame", "spot", *SPOT_COLUMNS, "q_peak"]]


def blob_spots(cakes: DataFrame, *, n_azim: int, bin_a: float, bin_r: float, min_pixels: int = 2,
               max_azim: float = 45.0, max_radial: int = 30, exclude_windows: Sequence[tuple[float, float]] = (), **thresholds) -> DataFrame:
    """Blobs of bright cells per frame, with ``q_peak`` of the brightest cell.

    Cells are streamed in order of their frame and the whole cakes of a batch are taken together;
    only the last one, bounded by the detector, waits for the next batch.
    """
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        waiting = None
        for cells in batches:
            cells = cells if waiting is None else pd.concat([waiting, cells], ignore_index=True)
            whole = cells["frame"] != cells["frame"].iloc[-1] if len(cells) else []
            waiting = cells[~whole] if len(cells) else None
            if len(cells) and whole.any():
                yield blob_rows(cells[whole], n_azim, bin_a, bin_r, min_pixels, max_azim, max_radial)
        if waiting is not None:
            yield blob_rows(waiting, n_azim, bin_a, bin_r, min_pixels, max_azim, max_radial)

    kinds = ", ".join(f"{c} {'int' if c == 'n_pixels' else 'double'}" for c in SPOT_COLUMNS)
    bright = bright_cells(cakes, **thresholds).select("frame", "abin", "rbin", "azim", "radial", "excess", "sigma")
    spots = spread(bright, "frame").sortWithinPartitions("frame").mapInPandas(run, f"frame bigint, spot int, {kinds}, q_peak double")
    return spots.where(~in_windows(F.col("q_peak"), exclude_windows)) if exclude_windows else spots


def detect_spots(cakes: DataFrame, *, bin_r: float, exclude_peaks: DataFrame | None = None, fwhm_mult: float = 2.0, **options) -> DataFrame:
    """Spots of every frame, see ``blob_spots``.

    ``exclude_peaks`` is ``frame, center, fwhm`` of powder rings; a spot whose
    brightest cell lies on one is dropped by an interval anti-join.
    """
    spots = blob_spots(cakes, bin_r=bin_r, **options)
    if exclude_peaks is not None:
        half = F.greatest(fwhm_mult * F.col("fwhm"), F.lit(bin_r))
        on_ring = interval_join(exclude_peaks.select("frame", "center", "fwhm"), spots.select("frame", "spot", "q_peak"),
                                ["frame"], F.col("center") - half, F.col("center") + half, "q_peak", 0.25)
        spots = spots.join(on_ring.select("frame", "spot").distinct(), ["frame", "spot"], "left_anti")
    return spots.drop("q_peak")


def consolidate(spots: DataFrame, by: Sequence[str], *, q_tol: float, azim_tol: float = 6.0, chunk: float = 1.0) -> DataFrame:
    """Merge the detections of one pressure point into one observation per reflection.

    Strongest first, a detection joins the first merged spot within both
    tolerances of its running centroid.  A centroid stays inside the span of its
    members, so detections further apart than the tolerance along q fall into
    separate islands; an island is streamed strongest first and only its running
    centroids are kept.  Returns the detections with their ``merged`` id.
    """
    by = list(by)
    rows = with_island(spots, by, ["q", "id"], "q", chunk, q_tol, "_island")
    keys = [*by, "_island"]

    def step(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, merged = None, []
        for pdf in batches:
            ids = []
            for row in pdf.itertuples(index=False):
                key = tuple(row[pdf.columns.get_loc(k)] for k in keys)
                if key != now:
                    now, merged = key, []
                angle = math.radians(row.azim)
                for m in merged:
                    apart = abs((row.azim - math.degrees(math.atan2(m[3], m[2])) + 180) % 360 - 180)
                    if abs(row.q - m[1] / m[0]) <= q_tol and apart <= azim_tol:
                        break
                else:
                    m = [0.0, 0.0, 0.0, 0.0, row.id]
                    merged.append(m)
                m[0] += row.intensity
                m[1] += row.intensity * row.q
                m[2] += row.intensity * math.cos(angle)
                m[3] += row.intensity * math.sin(angle)
                ids.append(m[4])
            yield pdf.assign(merged=ids)

    schema = rows.withColumn("merged", F.col("id")).schema
    return sorted_stream(rows, keys, [F.desc("intensity"), "id"], step, schema).drop("_island")


def merged_spots(assigned: DataFrame, by: Sequence[str]) -> DataFrame:
    """One row per merged spot: weighted centroid, spreads about it, brightest frame.

    The spreads are moments about the centroid, from a second aggregate on the same keys;
    a difference of two large sums would lose the narrow ones.
    """
    keys = [*by, "merged"]
    w = F.col("intensity")
    angle = F.radians("azim")
    rows = assigned.withColumn("_key", F.struct(*keys))
    centre = rows.groupBy("_key").agg(
        (F.sum(w * F.col("q")) / F.sum(w)).alias("_q"),
        F.degrees(F.atan2(F.sum(w * F.sin(angle)), F.sum(w * F.cos(angle)))).alias("_azim"))
    off_q, off_azim = F.col("q") - F.col("_q"), circular_difference(F.col("azim"), F.col("_azim"))
    return (rows.join(centre, "_key").groupBy("_key").agg(
        F.first("_q").alias("q"), F.first("_azim").alias("azim"),
        F.sqrt(F.sum(w * off_q * off_q) / F.sum(w)).alias("q_width"), F.sqrt(F.sum(w * off_azim * off_azim) / F.sum(w)).alias("azim_width"),
        F.max(w).alias("intensity"), F.sum("area").alias("area"), F.count_distinct("frame").alias("n_frames"),
        F.max_by("frame", F.struct(w, -F.col("frame"))).alias("best_frame"))
        .select(*[F.col(f"_key.{k}").alias(k) for k in keys], "q", "azim", "q_width", "azim_width", "intensity", "area", "n_frames", "best_frame"))


def link_spots(spots: DataFrame, by: Sequence[str], *, max_gap: int = 3, min_points: int = 3, q_rel: float = 0.05,
               q_floor: float = 0.0, azim_tol: float = 8.0, predict: bool = True) -> DataFrame:
    """Chain merged spots along a pressure ladder in joint (q, azimuth) distance.

    ``spots`` is ``id, position, axis, q, azim, intensity``.  Silences longer
    than ``max_gap`` cut the ladder into runs; each run is streamed in order.
    """
    by = list(by)
    rows = with_island(spots.select(*by, "id", "position", "axis", "q", "azim", "intensity"), by, ["position", "id"],
                       "position", 256.0, float(max_gap + 1), "_run")
    keys = [*by, "_run"]
    kinds = dict(rows.dtypes)
    columns = [*by, "track", "id", "position", "axis", "q", "azim", "intensity"]
    schema = ", ".join(f"{c} {'string' if c == 'track' else kinds[c]}" for c in columns)

    def step(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, tracks, waiting = None, [], []

        def flush() -> list[tuple]:
            nonlocal tracks
            if not waiting:
                return []
            position, axis = waiting[0]["position"], waiting[0]["axis"]
            tracks = [t for t in tracks if position - t["position"] <= max_gap + 1]
            pairs = []
            for ti, t in enumerate(tracks):
                expected = local_slope_center(t["points"], axis) if predict else t["points"][-1][1]
                reach = max(q_rel * abs(expected), q_floor, 1e-9)
                for ri, row in enumerate(waiting):
                    dq = abs(row["q"] - expected) / reach
                    da = abs((row["azim"] - t["azim"] + 180) % 360 - 180) / max(azim_tol, 1e-9)
                    if dq <= 1 and da <= 1:
                        pairs.append((math.hypot(dq, da), ti, ri))
            taken, used = {}, set()
            for _, ti, ri in sorted(pairs):
                if ti not in used and ri not in taken:
                    taken[ri] = ti
                    used.add(ti)
            out = []
            for ri, row in enumerate(waiting):
                if ri in taken:
                    t = tracks[taken[ri]]
                else:
                    t = {"id": str(row["id"]), "points": []}
                    tracks.append(t)
                t.update(position=position, azim=row["azim"])
                t["points"] = [*t["points"][-3:], (axis, row["q"])]
                out.append((*[row[k] for k in by], t["id"], *[row[c] for c in columns[len(by) + 1:]]))
            return out

        for pdf in batches:
            out = []
            for row in pdf.to_dict("records"):
                key = tuple(row[k] for k in keys)
                if key != now:
                    out += flush()
                    now, tracks, waiting = key, [], []
                elif waiting and row["position"] != waiting[0]["position"]:
                    out += flush()
                    waiting = []
                waiting.append(row)
            yield pd.DataFrame(out, columns=columns)
        yield pd.DataFrame(flush(), columns=columns)

    linked = sorted_stream(rows, keys, ["position", "id"], step, schema)
    long_enough = linked.groupBy(*by, "track").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= min_points)
    return linked.join(long_enough.select(*by, "track"), [*by, "track"], "left_semi")


def keep_masks(cells: DataFrame, spots: DataFrame, pad: float = 1.0) -> DataFrame:
    """Cells inside any spot box of their frame (a semi-join on q, exact azimuth test)."""
    half_q, half_a = pad * F.col("q_width"), pad * F.col("azim_width")
    boxes = spots.select("frame", F.col("q").alias("_q"), F.col("azim").alias("_az"), half_q.alias("_hq"), half_a.alias("_ha"))
    hits = interval_join(boxes, cells, ["frame"], F.col("_q") - F.col("_hq"), F.col("_q") + F.col("_hq"), "radial", 0.25)
    inside = hits.where(circular_difference(F.col("azim"), F.col("_az")) <= F.col("_ha"))
    return cells.join(inside.select("frame", "rbin", "abin").distinct(), ["frame", "rbin", "abin"], "left_semi")


def integrate_masked(cells: DataFrame, boxes: DataFrame, *, pad: float = 1.0, keep: bool = True,
                     exclude_windows: Sequence[tuple[float, float]] = ()) -> DataFrame:
    """``frame, rbin, radial, intensity, sigma, n``: patterns of the cells inside (or, without ``keep``, outside) all boxes.

    ``cells`` is ``frame, rbin, abin, radial, azim, y`` and, if it has one, ``weight`` (pixels of a cell); ``boxes`` see
    ``keep_masks``, their azimuth wraps around.  The intensity is the weighted mean of what is left and ``sigma``
    its Poisson deviation, an observed zero getting the smallest positive one of its frame.  Bins without
    cells, null cells and bins inside ``exclude_windows`` (in units of ``radial``) give no row.
    """
    usable = cells.where(F.col("y").isNotNull())
    if exclude_windows:
        usable = usable.where(~in_windows(F.col("radial"), exclude_windows))
    inside = keep_masks(usable, boxes, pad)
    left = inside if keep else usable.join(inside.select("frame", "rbin", "abin").distinct(), ["frame", "rbin", "abin"], "left_anti")
    w = F.col("weight") if "weight" in cells.columns else F.lit(1.0)
    sums = left.groupBy("frame", "rbin", "radial").agg(F.sum(w).alias("w"), F.sum(w * F.col("y")).alias("wy"), F.count(F.lit(1)).alias("n")).where("w > 0")
    rows = sums.withColumn("sigma", F.when(F.col("wy") > 0, F.sqrt("wy") / F.col("w")))
    # A frame has one row per radial bin.
    least = F.coalesce(F.min("sigma").over(Window.partitionBy("frame")), F.lit(1.0))
    return rows.select("frame", "rbin", "radial", (F.col("wy") / F.col("w")).alias("intensity"), F.coalesce("sigma", least).alias("sigma"), "n")
