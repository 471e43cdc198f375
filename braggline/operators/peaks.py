"""Peak detection and joint profile fitting, one pattern row at a time."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.profiles import (FLAG_BAD_CHI2, FLAG_CENTER_DRIFT, FLAG_LOW_AMPLITUDE,
                                  FLAG_NO_CONVERGENCE, FLAG_OK, FLAG_WIDTH_BOUND, LN2, MAX_REL_MISFIT,
                                  resolve_sensitivity)
from ..session import checkpointed
from .joins import spread
from .ordered import with_running_max_before, with_running_sum

MAX_GROUP = 12
QUALITY_SPAN = 2.0
#: How far a fit may move a center (in widths) and change a width (as factors), and the share of a bound that counts as reached.
CENTER_ROOM = 0.5
WIDTH_ROOM = (0.2, 5.0)
BOUND_SLACK = 1e-3
#: Points a peak needs to be judged on its own.
MIN_POINTS = 5
PEAK_SCHEMA = ("center double, amplitude double, fwhm double, eta double, area double, chi2 double, "
               "chi2_local double, rel_misfit double, flag int, center_err double, amplitude_err double, fwhm_err double")
#: Frames of a run of ``fit_series``; the knobs that come after the candidates.
RUN_FRAMES = 256
FIT_KNOBS = ("window_factor", "max_chi2", "max_rel", "min_fwhm_bins")
#: A frame of a run, or (position -1) the run itself: paths at its ends, seeds it was entered with and left.
SERIES_SCHEMA = ("run int, position bigint, head string, path string, frame bigint, place double, y array<double>, "
                 f"fits array<struct<{PEAK_SCHEMA}>>, entered binary, left binary")


def group_overlapping(peaks: DataFrame, by: Sequence[str], factor: float, chunk: float,
                      order: Sequence[str] = ("center", "peak_id")) -> DataFrame:
    """Add ``group``: peaks whose windows ``center -+ factor x fwhm`` overlap share one."""
    rows = (peaks.withColumn("_lo", F.col("center") - factor * F.col("fwhm"))
            .withColumn("_hi", F.col("center") + factor * F.col("fwhm")))
    placed = with_running_max_before(rows, by, order, "center", chunk, "_hi", "_reach")
    starts = F.when(F.col("_reach").isNull() | (F.col("_lo") > F.col("_reach")), 1).otherwise(0)
    out = with_running_sum(placed, by, order, "center", chunk, starts, "_g")
    return out.withColumn("group", F.col("_g") - 1).drop("_g", "_lo", "_hi", "_reach")


def seed_paths(frames: DataFrame, group: str, axis: str) -> DataFrame:
    """Add ``path`` and its length: frames of one group share a path, unknown axis is alone."""
    return frames.withColumn("path", F.when(F.col(axis).isNull(), F.concat(F.lit("frame-"), F.col("frame").cast("string")))
                             .otherwise(F.concat(F.lit("group-"), F.col(group).cast("string"))))


# --- kernels: one pattern in, a few peaks out -------------------------------------------------

def split_large(centers: np.ndarray, limit: int = MAX_GROUP) -> list[np.ndarray]:
    """Cut a group at its widest inner gap until every part fits."""
    todo, done = [np.arange(centers.size)], []
    while todo:
        part = todo.pop()
        if part.size <= limit:
            done.append(part)
            continue
        cut = int(np.argmax(np.diff(centers[part]))) + 1
        todo += [part[cut:], part[:cut]]
    return done


def local_maxima(y: np.ndarray) -> np.ndarray:
    """Strict maxima, a flat top counts once at its middle, ends never count."""
    edges = np.flatnonzero(np.diff(y) != 0)
    starts = np.concatenate([[0], edges + 1])
    stops = np.concatenate([edges, [y.size - 1]])
    level = y[starts]
    if level.size < 3:
        return np.zeros(0, int)
    top = np.flatnonzero((level[1:-1] > level[:-2]) & (level[1:-1] > level[2:])) + 1
    return (starts[top] + stops[top]) // 2


def prominence(y: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Height over the higher of the lowest points towards the next higher bin each side."""
    out = np.empty(at.size)
    for n, k in enumerate(at):
        higher = np.flatnonzero(y > y[k])
        split = np.searchsorted(higher, k)
        left = higher[split - 1] + 1 if split else 0
        right = higher[split] if split < higher.size else y.size
        out[n] = y[k] - max(y[left:k + 1].min(), y[k:right].min())
    return out


def half_width_at(x: np.ndarray, y: np.ndarray, k: int) -> float:
    low = y <= y[k] / 2
    before, after = np.flatnonzero(low[:k]), np.flatnonzero(low[k + 1:])
    i = before[-1] if before.size else 0
    j = k + 1 + after[0] if after.size else y.size - 1
    width = abs(x[j] - x[i])
    if width > 0 and np.isfinite(width):
        return float(width)
    return 3 * float(np.median(np.abs(np.diff(x)))) if x.size > 1 else 3.0


def robust_sigma(y: np.ndarray) -> float:
    y = y[np.isfinite(y)]
    return 1.4826 * float(np.median(np.abs(y - np.median(y)))) if y.size else 0.0


def opening(y: np.ndarray, width: int) -> np.ndarray:
    half = width // 2
    def slide(v, pick, edge):
        return pick(np.lib.stride_tricks.sliding_window_view(np.pad(v, half, constant_values=edge), width), axis=1)
    return slide(slide(y, np.min, np.inf), np.max, -np.inf)


def detect(x: np.ndarray, y: np.ndarray, *, min_snr: float = 5.0, min_prominence_snr: float | None = None,
           sigma: float | None = None, seeds: Sequence[float] | None = None, edge_bins: int = 0,
           x_min: float | None = None, x_max: float | None = None) -> np.ndarray:
    """Candidate rows ``(center, amplitude, fwhm)`` sorted by center."""
    filled = np.where(np.isfinite(y), y, 0.0)
    noise = robust_sigma(y) if sigma is None else sigma
    noise = noise if noise > 0 else (float(np.nanstd(y)) or 1.0)
    height = min_snr * noise
    need = max((min_snr if min_prominence_snr is None else min_prominence_snr) * noise, 1e-12)
    at = local_maxima(filled)
    at = at[filled[at] >= height]
    at = at[prominence(filled, at) >= need]
    found = [(x[k], filled[k], half_width_at(x, filled, k)) for k in at]
    step = float(np.median(np.abs(np.diff(x)))) if x.size > 1 else 1.0
    if seeds is not None and len(seeds):
        typical = float(np.median([f[2] for f in found])) if found else 3 * step
        reach = max(3 * step, typical / 2)
        centers = np.array([f[0] for f in found])
        for s in sorted(seeds):
            if centers.size == 0 or np.abs(centers - s).min() > reach:
                k = int(np.argmin(np.abs(x - s)))
                found.append((x[k], max(filled[k], height), half_width_at(x, filled, k)))
    low, high = x.min(), x.max()
    if edge_bins > 0:
        ends = x[min(edge_bins, x.size - 1)], x[max(x.size - 1 - edge_bins, 0)]
        low, high = min(ends), max(ends)
    low = low if x_min is None else max(low, x_min)
    high = high if x_max is None else min(high, x_max)
    out = np.array([f for f in found if low <= f[0] <= high], float).reshape(-1, 3)
    return out[np.argsort(out[:, 0], kind="stable")]


def overlap_groups(cands: np.ndarray, factor: float, limit: int = MAX_GROUP) -> list[np.ndarray]:
    if not len(cands):
        return []
    low, high = cands[:, 0] - factor * cands[:, 2], cands[:, 0] + factor * cands[:, 2]
    starts = np.flatnonzero(np.concatenate([[True], low[1:] > np.maximum.accumulate(high)[:-1]]))
    parts = np.split(np.arange(len(cands)), starts[1:])
    return [p[q] for p in parts for q in split_large(cands[p, 0], max(2, limit))]


def profile_terms(x: np.ndarray, p: np.ndarray):
    """Profiles and their partials for parameter rows ``(center, height, width, eta)``."""
    c, a, w, e = p.T
    u = (x[:, None] - c) / w
    lor = 1 / (1 + 4 * u * u)
    gau = np.exp(-4 * LN2 * u * u)
    shape = e * lor + (1 - e) * gau
    slope = a * 8 * u / w * (e * lor * lor + (1 - e) * LN2 * gau)
    return a * shape, (slope, shape, slope * u, a * (lor - gau))


def bounded_least_squares(fun, start, low, high, rounds: int):
    """Projected Levenberg-Marquardt; returns parameters, Jacobian and convergence."""
    p = np.clip(start, low, high)
    r, jac = fun(p)
    cost, damping = r @ r, 1e-3
    for _ in range(rounds):
        grad = jac.T @ r
        free = ~(((p <= low) & (grad > 0)) | ((p >= high) & (grad < 0)))
        if not free.any() or np.abs(grad[free]).max() <= 1e-8 * max(cost, 1.0):
            return p, jac, True
        hess = jac[:, free].T @ jac[:, free]
        scale = np.maximum(np.diag(hess), 1e-30)
        for _ in range(30):
            step = np.zeros_like(p)
            try:
                step[free] = -np.linalg.solve(hess + damping * np.diag(scale), grad[free])
            except np.linalg.LinAlgError:
                damping *= 10
                continue
            trial = np.clip(p + step, low, high)
            r_new, jac_new = fun(trial)
            if np.isfinite(r_new).all() and r_new @ r_new < cost:
                break
            damping *= 4
        else:
            return p, jac, True       # no downhill step is left
        gain, moved = cost - r_new @ r_new, np.abs(trial - p).max()
        p, r, jac, cost = trial, r_new, jac_new, r_new @ r_new
        damping = max(damping / 5, 1e-12)
        if gain <= 1e-8 * cost or moved <= 1e-8 * (1 + np.abs(p).max()):
            return p, jac, True
    return p, jac, False


def fit_joint(x: np.ndarray, y: np.ndarray, group: np.ndarray, sigma: float, *, factor: float,
              max_chi2: float, max_rel: float) -> list[dict]:
    """Fit one group of peaks on a local linear baseline and judge each peak."""
    k = len(group)
    seed = np.maximum(group, [-np.inf, 1e-9, 1e-9])
    reach = factor * seed[:, 2].max()
    use = (x >= seed[:, 0].min() - reach) & (x <= seed[:, 0].max() + reach) & np.isfinite(y)
    xs, ys = x[use], y[use]
    if xs.size < 4 * k + 2:
        return [failed(g) for g in group]
    noise = sigma if sigma > 0 else 1.0
    centred = xs - xs.mean()
    start = np.column_stack([seed, np.full(k, 0.5)])
    c, a, w = seed.T
    shift, (thin, wide) = CENTER_ROOM * w, WIDTH_ROOM
    low = np.column_stack([c - shift, np.zeros(k), thin * w, np.zeros(k)])
    high = np.column_stack([c + shift, 5 * a + 1e-9, wide * w, np.ones(k)])

    def residual(p):
        shape, partials = profile_terms(xs, p[:-2].reshape(k, 4))
        r = shape.sum(axis=1) + p[-2] + p[-1] * centred - ys
        jac = np.concatenate([np.stack(partials, axis=2).reshape(xs.size, 4 * k),
                              np.ones((xs.size, 1)), centred[:, None]], axis=1)
        return r / noise, jac / noise

    free = [np.inf, np.inf]
    p, jac, converged = bounded_least_squares(
        residual, np.concatenate([start.ravel(), [np.percentile(ys, 10), 0.0]]),
        np.concatenate([low.ravel(), np.negative(free)]), np.concatenate([high.ravel(), free]), 200 * (k + 1))
    if not np.isfinite(p).all():
        return [failed(g) for g in group]
    r = residual(p)[0] * noise
    chi2 = float((r / noise) @ (r / noise) / max(xs.size - p.size, 1))
    esd = np.sqrt(np.clip(np.diag(np.linalg.pinv(jac.T @ jac)) * chi2, 0, None))[:-2].reshape(k, 4)
    return judged(p[:-2].reshape(k, 4), group, (low, high), esd, xs, r, noise, chi2, converged, max_chi2, max_rel)


def judged(fitted: np.ndarray, seeds: np.ndarray, bounds: tuple[np.ndarray, np.ndarray], esd: np.ndarray, xs: np.ndarray, misfit: np.ndarray,
           noise: float, chi2: float, converged: bool, max_chi2: float, max_rel: float) -> list[dict]:
    """Quality of all peaks of a group at once; a peak answers for the points where its profile is the highest."""
    center, height, width = fitted[:, 0], fitted[:, 1], fitted[:, 2]
    eta = np.clip(fitted[:, 3], 0, 1)
    close = np.abs(xs - center[:, None]) <= QUALITY_SPAN * np.maximum(width, 1e-9)[:, None]
    own = close & (profile_terms(xs, fitted)[0].argmax(axis=1) == np.arange(len(fitted))[:, None])
    enough = lambda rows: rows.sum(axis=1, keepdims=True) >= MIN_POINTS
    points = np.where(enough(own), own, np.where(enough(close), close, True))
    count, squares = points.sum(axis=1), points @ (misfit * misfit)
    local = squares / noise ** 2 / np.maximum(count - 4, 1)
    with np.errstate(divide="ignore"):
        rel = np.where(height > 0, np.sqrt(squares / count) / np.maximum(height, 1e-300), np.inf)
    low, high = bounds
    # A parameter counts as stopped by its bound from a slack before it.
    drift = np.abs(center - seeds[:, 0]) >= (1 - BOUND_SLACK) * (high[:, 0] - low[:, 0]) / 2
    stopped = (width <= (1 + BOUND_SLACK) * low[:, 2]) | (width >= (1 - BOUND_SLACK) * high[:, 2])
    flags = sum(np.where(bad, code, 0) for bad, code in (
        (not converged, FLAG_NO_CONVERGENCE), (height < 2 * noise, FLAG_LOW_AMPLITUDE), ((local > max_chi2) & (rel > max_rel), FLAG_BAD_CHI2),
        (drift, FLAG_CENTER_DRIFT), (stopped, FLAG_WIDTH_BOUND))) + np.full(len(fitted), FLAG_OK)
    table = {"center": center, "amplitude": height, "fwhm": width, "eta": eta,
             "area": height * width * (eta * np.pi / 2 + (1 - eta) * np.sqrt(np.pi / (4 * LN2))), "chi2": np.full(len(fitted), chi2),
             "chi2_local": local, "rel_misfit": rel, "flag": flags.astype(int), "center_err": esd[:, 0], "amplitude_err": esd[:, 1], "fwhm_err": esd[:, 2]}
    return [dict(zip(table, row)) for row in zip(*(v.tolist() for v in table.values()))]


def failed(seed: np.ndarray) -> dict:
    return {"center": seed[0], "amplitude": seed[1], "fwhm": seed[2], "eta": 0.5, "area": 0.0, "chi2": np.inf,
            "chi2_local": np.inf, "rel_misfit": np.inf, "flag": FLAG_NO_CONVERGENCE,
            "center_err": None, "amplitude_err": None, "fwhm_err": None}


def candidates(x: np.ndarray, y: np.ndarray, *, min_snr: float = 5.0, min_prominence_snr: float | None = None, edge_bins: int = 0,
               fit_min: float | None = None, fit_max: float | None = None, detrend_bins: int = 0,
               seeds: Sequence[float] | None = None) -> tuple[float, np.ndarray]:
    """Noise and candidate rows of one pattern; all that seeds change in its fit is in the rows."""
    inside = np.ones(x.size, bool)
    if edge_bins > 0:
        inside[:edge_bins] = inside[max(x.size - edge_bins, 0):] = False
    inside &= x >= (-np.inf if fit_min is None else fit_min)
    inside &= x <= (np.inf if fit_max is None else fit_max)
    signal = y - opening(np.nan_to_num(y, nan=0.0), int(detrend_bins) | 1) if detrend_bins > 1 else y
    sigma = robust_sigma(signal[inside]) or robust_sigma(signal) or float(np.nanstd(signal)) or 1.0
    return sigma, detect(x, signal, min_snr=min_snr, min_prominence_snr=min_prominence_snr, sigma=sigma, seeds=seeds,
                         edge_bins=edge_bins, x_min=fit_min, x_max=fit_max)


def fit_row(x: np.ndarray, y: np.ndarray, *, window_factor: float = 3.0, max_chi2: float = 25.0, max_rel: float = MAX_REL_MISFIT,
            min_fwhm_bins: float = 0.0, found: tuple[float, np.ndarray] | None = None, **knobs) -> list[dict]:
    """Detect (unless ``found``), group and fit the peaks of one pattern."""
    sigma, cands = candidates(x, y, **knobs) if found is None else found
    rows = [row for g in overlap_groups(cands, window_factor)
            for row in fit_joint(x, y, cands[g], sigma, factor=window_factor, max_chi2=max_chi2, max_rel=max_rel)]
    if min_fwhm_bins > 0:
        floor = min_fwhm_bins * float(np.median(np.abs(np.diff(x))))
        for row in rows:
            row["flag"] |= FLAG_WIDTH_BOUND * (row["fwhm"] < floor)
    return sorted(rows, key=lambda row: row["center"])


def fit_peaks(patterns: DataFrame, channel: str, axis: Sequence[float], **knobs) -> DataFrame:
    """Fit every pattern row on its own."""
    x = np.asarray(axis, float)
    columns = [c.split()[0] for c in PEAK_SCHEMA.split(", ")]

    def kernel(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for frame, values in zip(pdf["frame"], pdf[channel]):
                rows = fit_row(x, np.asarray(values, float), **knobs)
                out += [(frame, i, *[r[c] for c in columns]) for i, r in enumerate(rows)]
            yield pd.DataFrame(out, columns=["frame", "peak", *columns])

    return spread(patterns.select("frame", channel), "frame").mapInPandas(kernel, "frame bigint, peak int, " + PEAK_SCHEMA)


def fit_run(patterns: DataFrame, channel: str, axis: Sequence[float], sensitivity: str = "normal",
            fit_range: tuple[float | None, float | None] | str | None = "auto", **explicit) -> DataFrame:
    """The whole step: a preset with explicit values over it, and a range, told or found on the median pattern.

    The range is two numbers that reach the driver; everything else stays on the workers.
    """
    from .background import auto_fit_range, bin_medians
    knobs = resolve_sensitivity(sensitivity, **explicit)
    del knobs["preset"]
    low, high = fit_range if isinstance(fit_range, tuple) else (None, None)
    if fit_range == "auto":
        rows = patterns.select(F.posexplode(channel).alias("bin", "y")).where(F.col("y").isNotNull())
        # One row per bin of the detector axis.
        medians = bin_medians(rows, "y", ["bin"]).withColumn("radial", F.get(F.array(*[F.lit(float(x)) for x in axis]), F.col("bin")))
        found = auto_fit_range(medians).first()
        low, high = (found["fit_min"], found["fit_max"]) if found is not None else (None, None)
    low, high = (None if v is None or v != v else float(v) for v in (low, high))
    return fit_peaks(patterns, channel, axis, fit_min=low, fit_max=high, **knobs)


def predicted_seeds(history: Sequence[tuple[float, np.ndarray, np.ndarray]], at: float) -> list[float]:
    """Where the centers of the last frame are expected at ``at``.

    ``history`` holds the last frames as (axis, centers in order, widths).  A center that has one
    of the frame before within its width moves on along the line through both, by its width at most.
    """
    x1, last, width = history[-1]
    if len(history) < 2 or not len(history[-2][1]) or x1 == history[-2][0]:
        return last.tolist()
    x0, before, _ = history[-2]
    gap, at_before = nearest_in(last, before)
    moved = np.where(gap <= width, (last - before[at_before]) / (x1 - x0) * (at - x1), 0.0)
    return (last + np.clip(moved, -width, width)).tolist()


def nearest_in(values: np.ndarray, line: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distance to, and place of, the nearest entry of a sorted line."""
    edges = (line[1:] + line[:-1]) / 2
    place = np.searchsorted(edges, values)
    return np.abs(values - line[place]), place


def packed(history: Sequence[tuple[float, np.ndarray, np.ndarray]]) -> bytes:
    """A history as bytes, to travel from run to run and to be compared."""
    return b"".join(np.column_stack([np.full(c.size, n), np.full(c.size, at), c, w]).tobytes() for n, (at, c, w) in enumerate(history))


def unpacked(data: bytes | None) -> list[tuple[float, np.ndarray, np.ndarray]]:
    if not data:
        return []
    table = np.frombuffer(bytes(data)).reshape(-1, 4)
    return [(float(part[0, 1]), part[:, 2], part[:, 3]) for part in (table[table[:, 0] == n] for n in np.unique(table[:, 0]))]


def extended(history: list, place: float, fits: Sequence[dict], depth: int) -> list:
    """The history after a frame; one without good fits leaves it alone."""
    good = np.array([(f["center"], f["fwhm"]) for f in fits if f["flag"] == FLAG_OK]).reshape(-1, 2)
    return [*history, (place, good[:, 0], good[:, 1])][-depth:] if len(good) else history


def run_kernel(x: np.ndarray, predict: bool, size: int, knobs: dict):
    """Pass through blocks of ``size`` runs in order; a stored fit stays if the seeds of now lead to the candidates it was made from."""
    depth = 2 if predict else 1
    finding = {k: v for k, v in knobs.items() if k not in FIT_KNOBS}
    fitting = {k: v for k, v in knobs.items() if k in FIT_KNOBS}
    names = ("run", "position", "head", "path", "frame", "place", "y", "fits", "entered", "left")

    def seeds_of(history, place):
        return predicted_seeds(history, place) if history else None

    def kernel(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        run = head = now = None
        # Seeds of now, seeds that the stored fits were made from, and what the run was entered with.
        history, assumed, entered, position = [], [], b"", 0

        def edge():
            return run, -1, head, now, 0, 0.0, None, None, entered, packed(history)

        for pdf in batches:
            out = []
            for number, at, first, path, frame, place, y, stored, was, given in zip(*(pdf[c] for c in names)):
                if at < 0:
                    # The first run of a block goes on from the block before it, the others from the run before them.
                    if run is None or number // size != run // size:
                        if run is not None:
                            out.append(edge())
                        run, now, history = None, first, unpacked(given)
                    assumed = unpacked(was)
                    continue
                if number != run:
                    if run is not None:
                        out.append(edge())
                    history = history if path == now else []
                    run, head, now, entered, position = number, path, path, packed(history), 0
                elif path != now:
                    now, history, assumed = path, [], []
                values, fits = np.asarray(y, float), stored
                seeds, before = seeds_of(history, place), seeds_of(assumed, place)
                if stored is None or seeds != before:
                    found = candidates(x, values, seeds=seeds, **finding)
                    if stored is None or not np.array_equal(found[1], candidates(x, values, seeds=before, **finding)[1]):
                        fits = fit_row(x, values, found=found, **fitting)
                assumed = assumed if stored is None else extended(assumed, place, stored, depth)
                history = extended(history, place, fits, depth)
                out.append((run, position, None, path, frame, place, values, fits, None, None))
                position += 1
            yield pd.DataFrame(out, columns=names)
        if run is not None:
            yield pd.DataFrame([edge()], columns=names)

    return kernel


def fit_series(patterns: DataFrame, channel: str, axis: Sequence[float], path: str, order: Sequence[str],
               predict: bool = False, run_frames: int = RUN_FRAMES, **knobs) -> DataFrame:
    """Fit along each path in order, the good centers of a frame seeding the next.

    With ``predict`` the seeds follow the slope of the last two frames along the first
    order column.  Null paths form one path; rows alike in path and order go by frame, then by pattern.

    The paths, one after the other, are cut into runs of about ``run_frames`` frames, each fitted
    as if nothing came before it.  Then blocks of 2, 4, 8 ... runs are passed through in order, entered with
    the seeds that the block before them left, and frames are fitted again where other seeds mean other
    candidates.  Once every run was entered with what the run before it left, the fits are those of
    one pass frame by frame.  Seeds are mostly forgotten within a run, so the first blocks do; where they
    are not, the blocks grow to the whole path, after as many rounds as it takes doublings.
    """
    x = np.asarray(axis, float)
    place = F.col(order[0]).cast("double") if predict else F.lit(0.0)
    rows = patterns.select(F.to_json(F.struct(path)).alias("path"), F.struct(*order).alias("rank"), F.col("frame").cast("bigint").alias("frame"),
                           place.alias("place"), F.col(channel).alias("y"))
    runs = max(1, math.ceil(patterns.count() / run_frames))
    blank = {name: F.lit(None).cast(kind) for name, kind in (("head", "string"), ("fits", f"array<struct<{PEAK_SCHEMA}>>"), ("entered", "binary"), ("left", "binary"))}
    cut = (rows.repartitionByRange(runs, "path", "rank", "frame").sortWithinPartitions("path", "rank", "frame", "y")
           .withColumns({"run": F.spark_partition_id(), "position": F.lit(0), **blank}).drop("rank"))
    size = 1
    fitted = checkpointed(cut.mapInPandas(run_kernel(x, predict, size, knobs), SERIES_SCHEMA))
    while True:
        # One row per run in this window.
        before = Window.orderBy("run")
        given = F.when(F.lag("path").over(before) == F.col("head"), F.lag("left").over(before)).otherwise(F.lit(b""))
        edges = checkpointed(fitted.where("position < 0").withColumn("left", given))
        astray, last = edges.agg(F.count_if(F.col("entered") != F.col("left")), F.max("run")).first()
        if not astray:
            return fitted.where("position >= 0").select("frame", F.posexplode("fits").alias("peak", "fit")).select("frame", "peak", "fit.*")
        size *= 2
        passed = (fitted.where("position >= 0").unionByName(edges)
                  .repartitionById(last // size + 1, F.floor(F.col("run") / size).cast("int"))
                  .sortWithinPartitions("run", "position"))
        fitted = checkpointed(passed.mapInPandas(run_kernel(x, predict, size, knobs), SERIES_SCHEMA))
