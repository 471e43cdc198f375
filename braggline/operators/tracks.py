"""Tracks across frames: linking, co-occurrence clusters, transitions."""

from __future__ import annotations

import json
import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import checkpointed
from .joins import sorted_stream
from .ordered import exact_quantiles, median_and_mad, with_island, with_previous, with_running_sum

LINK_FIELDS = ("position", "axis", "center", "amplitude", "fwhm")


#: Observations of one series that are streamed in one piece; longer series are first cut where nothing can link.
SERIES_ROWS = 1_000_000


def local_slope(points: Sequence[tuple[float, float]]) -> float:
    """Slope over the last four (axis, center) points; 0 where they tell none."""
    recent = [(x, y) for x, y in points[-4:] if math.isfinite(x) and math.isfinite(y)]
    n = len(recent)
    if n < 2:
        return 0.0
    mx, my = sum(x for x, _ in recent) / n, sum(y for _, y in recent) / n
    spread = cross = 0.0
    for x, y in recent:
        spread += (x - mx) * (x - mx)
        cross += (x - mx) * (y - my)
    return cross / spread if spread > 0 else 0.0


def local_slope_center(points: list[tuple[float, float]], now: float) -> float:
    """Extrapolate the center from the slope over the last four (axis, center) points."""
    last_axis, last = points[-1]
    slope = local_slope(points)
    return last + slope * (now - last_axis) if slope else last


#: Pairs of open tracks and rows that are not worth arrays.
FEW_PAIRS = 64
#: Pairs whose similarities are computed at once, closest first; those that others have made needless are not.
SCORED_PAIRS = 512


class Linker:
    """Open tracks of one key; fed one position at a time, in order.

    ``similarity(before, rows)`` gets the last rows of the open tracks and the rows of a position and returns a function of
    two arrays of numbers: how alike the pairs of ``before[i]`` and ``rows[j]`` are.  An unknown one links nothing.
    """

    def __init__(self, tolerance: float, max_gap: int, max_axis_gap: float | None, predict: bool,
                 similarity: Callable | None, min_similarity: float):
        self.tolerance, self.max_gap, self.max_axis_gap = tolerance, max_gap, max_axis_gap
        self.predict, self.similarity, self.min_similarity = predict, similarity, min_similarity
        self.open: list[dict] = []

    def expected(self, track: dict, axis: float) -> float:
        """Where the track is looked for; its slope changes with its points only."""
        last_axis, last = track["points"][-1]
        if not self.predict:
            return last
        if "slope" not in track:
            track["slope"] = local_slope(track["points"])
        return last + track["slope"] * (axis - last_axis) if track["slope"] else last

    def few_pairs(self, axis: float, rows: list[dict]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Gaps, tracks and rows of all pairs within tolerance."""
        near = []
        sides = [(ri, row["center"], max(row["fwhm"], 1e-9)) for ri, row in enumerate(rows)]
        for ti, t in enumerate(self.open):
            expected, wide = self.expected(t, axis), t["fwhm"]
            for ri, center, width in sides:
                gap = abs(center - expected)
                if gap <= self.tolerance * (wide if wide > width else width):
                    near.append((gap, ti, ri))
        if near:
            near.sort()
            yield tuple(np.array(c) for c in zip(*near))

    def many_pairs(self, axis: float, rows: list[dict], used: np.ndarray, taken: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """``few_pairs`` by growing gap, without those that were ``used`` or ``taken`` meanwhile; equal gaps come together."""
        expected, wide = (np.array(v, float) for v in zip(*[(self.expected(t, axis), t["fwhm"]) for t in self.open]))
        center, width = (np.array([row[c] for row in rows], float) for c in ("center", "fwhm"))
        width = np.maximum(width, 1e-9)
        # No gap is wider; nearest tracks and rows are looked up in order of center first, then further ones.
        widest = self.tolerance * np.nanmax([0.0, np.fmax.reduce(wide), np.fmax.reduce(width)])
        low = -1.0
        for high in [*(widest * 2.0 ** -k for k in range(7, 0, -1)), math.inf]:
            reach = min(high, widest) * (1 + 1e-9) + 1e-9
            mine, theirs = np.flatnonzero(~used), np.flatnonzero(taken < 0)
            theirs = theirs[np.argsort(center[theirs], kind="stable")]
            first = np.searchsorted(center[theirs], expected[mine] - reach)
            count = np.maximum(np.searchsorted(center[theirs], expected[mine] + reach, side="right") - first, 0)
            at = np.repeat(np.arange(mine.size), count)
            ti, ri = mine[at], theirs[np.arange(at.size) - (count.cumsum() - count)[at] + first[at]]
            gap = np.abs(center[ri] - expected[ti])
            near = (gap > low) & (gap <= high) & (gap <= self.tolerance * np.where(wide[ti] > width[ri], wide[ti], width[ri]))
            gap, ti, ri = gap[near], ti[near], ri[near]
            order = np.argsort(gap, kind="stable")
            gap, ti, ri = gap[order], ti[order], ri[order]
            while gap.size:
                free = ~used[ti] & (taken[ri] < 0)
                gap, ti, ri = gap[free], ti[free], ri[free]
                if gap.size:
                    end = np.searchsorted(gap, gap[min(gap.size, SCORED_PAIRS) - 1], side="right")
                    yield gap[:end], ti[:end], ri[:end]
                    gap, ti, ri = gap[end:], ti[end:], ri[end:]
            low = high

    def assign(self, position: int, axis: float, rows: list[dict]) -> list[dict]:
        """Link the rows of one position and return the track of each."""
        self.open = [t for t in self.open if position - t["position"] <= self.max_gap + 1
                     and not (self.max_axis_gap is not None and abs(axis - t["points"][-1][0]) > self.max_axis_gap)]
        used, taken = np.zeros(len(self.open), bool), np.full(len(rows), -1)
        likeness = self.similarity([t["row"] for t in self.open], rows) if self.similarity is not None and self.open else None
        few = len(self.open) * len(rows) <= FEW_PAIRS
        for gap, ti, ri in self.few_pairs(axis, rows) if few else self.many_pairs(axis, rows, used, taken):
            # Closest first; where the gaps are equal the more similar first.
            unlike = np.zeros(len(gap))
            if likeness is not None:
                like = likeness(ti, ri)
                with np.errstate(invalid="ignore"):
                    good = np.isfinite(like) & (like >= self.min_similarity)
                gap, ti, ri, unlike = gap[good], ti[good], ri[good], -like[good]
            order = np.lexsort((ri, ti, unlike, gap))
            for t, r in zip(ti[order].tolist(), ri[order].tolist()):
                if not used[t] and taken[r] < 0:
                    taken[r], used[t] = t, True
        taken = taken.tolist()
        tracks = []
        for ri, row in enumerate(rows):
            if taken[ri] >= 0:
                t = self.open[taken[ri]]
                t["points"] = [*t["points"][-3:], (axis, row["center"])]
                t.pop("slope", None)
            else:
                t = {"id": row["obs"], "points": [(axis, row["center"])]}
                self.open.append(t)
            t.update(position=position, fwhm=row["fwhm"], row=row if self.similarity else None)
            tracks.append(t)
        return tracks

    def advance(self, position: int, axis: float, rows: list[dict]) -> list[str]:
        """``assign`` with the id of each track."""
        return [t["id"] for t in self.assign(position, axis, rows)]


def link_tracks(obs: DataFrame, by: Sequence[str], *, link_tol: float = 1.5, max_gap: int = 2,
                min_points: int = 3, max_axis_gap: float | None = None, predict: bool = False,
                similarity: Callable | None = None, min_similarity: float = 0.0,
                extra: Sequence[str] = (), attached: DataFrame | None = None, chunk: float = 1.0,
                series_rows: int = SERIES_ROWS) -> DataFrame:
    """Chain observations into tracks, closest pair first, one to one per position.

    ``obs`` carries ``obs`` (an id), ``position`` (place of the frame in its
    series), ``axis``, ``center``, ``amplitude`` and ``fwhm``; ``extra`` columns, and those that ``attached`` has
    beside ``position``, are there for ``similarity`` (see ``Linker``).  A row of ``attached`` is sent once to each series that has
    its position, and observations without one are left out.  A series is streamed in order with its open tracks in memory,
    and a track is held back until it has ``min_points``.

    A series of more than ``series_rows`` observations is cut first.  Observations
    further apart than the widest tolerance never share a track, and neither do
    those with a longer silence than ``max_gap``.
    With a predictor only the silences cut it, because a prediction may leave its
    neighbourhood.
    """
    by = list(by)
    rows = obs.select(*by, "obs", *LINK_FIELDS, *extra)
    stream = lambda some, keys: linked_stream(
        some, by, keys, rows.schema, min_points, lambda: Linker(link_tol, max_gap, max_axis_gap, predict, similarity, min_similarity), attached)
    # At most one key per ``series_rows`` observations.
    long = checkpointed(obs.groupBy(*by).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > series_rows).select(*by))
    if long.isEmpty():
        return stream(rows, by)
    keys, hot = [*by], rows.join(long, by, "left_semi")
    if not predict:
        reach = obs.select(F.max("fwhm") * link_tol).scalar()
        hot = with_island(hot, by, ["center", "obs"], "center", chunk, F.greatest(reach, F.lit(1e-9)), "_band")
        keys.append("_band")
    hot = with_island(hot, keys, ["position", "obs"], "position", 256.0, float(max_gap + 1), "_run")
    cut = stream(hot, [*keys, "_run"])
    return stream(rows.join(long, by, "left_anti"), by).unionByName(cut)


def linked_stream(rows: DataFrame, by: list[str], keys: list[str], fields: T.StructType, min_points: int, linker_of: Callable[[], Linker],
                  attached: DataFrame | None = None) -> DataFrame:
    """The points of all tracks of ``min_points`` or more; each key of ``keys`` is streamed by position with a linker of its own.

    The rows of ``attached`` come ahead of the observations of their position, one for each key.
    """
    schema = T.StructType([*[fields[k] for k in by], T.StructField("track", T.StringType()), fields["obs"],
                           *[fields[c] for c in LINK_FIELDS]])
    columns = schema.names
    order, more = ["position", "obs"], []
    if attached is not None:
        more, order = [c for c in attached.columns if c != "position"], ["position", "_side", "obs"]
        rows = rows.where("position is not null")
        places = rows.select(*keys, "position").distinct().join(attached, "position").withColumn("_side", F.lit(0))
        rows = rows.withColumn("_side", F.lit(1)).unionByName(places, allowMissingColumns=True)
    names = [c for c in rows.columns if c not in keys]
    n_by = len(by)

    def step(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        linker, key_now, place, waiting, parts = None, None, None, [], []

        def flush(out: list[tuple]) -> None:
            if not waiting:
                return
            first = waiting[0]
            for t, r in zip(linker.assign(first["position"], first["axis"], waiting), waiting):
                row = (*key_now[:n_by], t["id"], r["obs"], r["position"], r["axis"], r["center"], r["amplitude"], r["fwhm"])
                held = t.setdefault("held", [])
                # A track that is long enough holds nothing back any more.
                if held is None:
                    out.append(row)
                elif len(held) + 1 >= min_points:
                    out += [*held, row]
                    t["held"] = None
                else:
                    held.append(row)

        for pdf in batches:
            out: list[tuple] = []
            of = [pdf[k].astype(object).where(pdf[k].notna(), None).tolist() if pdf[k].hasnans else pdf[k].tolist() for k in keys]
            for key, values in zip(zip(*of) if of else [()] * len(pdf), zip(*[pdf[c].tolist() for c in names])):
                row = dict(zip(names, values))
                if key != key_now or row["position"] != place:
                    flush(out)
                    place, waiting, parts = row["position"], [], []
                    if key != key_now:
                        linker, key_now = linker_of(), key
                if not more:
                    waiting.append(row)
                elif row["_side"] == 0:
                    parts.append({c: row[c] for c in more})
                else:
                    waiting += [row | part for part in parts]
            yield pd.DataFrame(out, columns=columns)
        out = []
        flush(out)
        yield pd.DataFrame(out, columns=columns)

    return sorted_stream(rows, keys, order, step, schema)


def track_summary(points: DataFrame, by: Sequence[str] = ("series",)) -> DataFrame:
    """Extent, first and last center and summed amplitude of each track."""
    return points.groupBy(*by, "track").agg(
        F.count(F.lit(1)).alias("n_points"), F.min("position").alias("first"), F.max("position").alias("last"),
        F.min_by("center", "position").alias("center_first"), F.max_by("center", "position").alias("center_last"),
        F.sum("amplitude").alias("amplitude_sum"))


def track_edges(points: DataFrame, by: Sequence[str] = ("series",), chunk: float = 4096.0) -> DataFrame:
    """Consecutive points of each track with their center shift and silence."""
    steps = with_previous(points, [*by, "track"], ["position"], "position", chunk, ["position", "center"])
    return steps.where(F.col("prev_position").isNotNull()).select(
        *by, "track", F.col("prev_position").alias("from"), F.col("position").alias("to"),
        (F.col("center") - F.col("prev_center")).alias("shift"))


#: Sets up to this size are joined on pairs of their rarest items.
PAIR_SIZE = 8


def similar_sets(sets: DataFrame, threshold: float) -> DataFrame:
    """Pairs of distinct sets with Jaccard similarity of at least ``threshold``.

    ``sets`` is ``id, items``.  Two such sets share one of their rarest items,
    so only those are joined; sizes must agree within the threshold.  A common
    item appears in a prefix only where a set has nothing rarer.  Where both have at most ``PAIR_SIZE`` items
    and must share two, they share two of a prefix one item longer, and such pairs of items are far rarer than items.
    """
    frequency = sets.select(F.explode("items").alias("item")).groupBy("item").agg(F.count(F.lit(1)).alias("f"))
    ranked = (sets.select("id", F.size("items").alias("n"), F.explode("items").alias("item")).join(frequency, "item")
              .groupBy("id", "n").agg(F.transform(F.sort_array(F.collect_list(F.struct("f", "item"))),
                                                  lambda s: s["item"]).alias("items")))
    n = F.col("n")
    least, most = lambda n: math.ceil(threshold * n - 1e-9), lambda n: math.floor(n / threshold + 1e-9)
    shared = lambda a, b: math.ceil(threshold / (1 + threshold) * (a + b) - 1e-9)
    paired = lambda a, b: b <= PAIR_SIZE and shared(a, b) >= 2

    def of_short(n: int, small: bool) -> list[tuple[int, int, int]]:
        """Sizes and places of the one or two items of each key of a set of ``n``."""
        sizes = [(n, m) for m in range(n, most(n) + 1)] if small else [(m, n) for m in range(max(least(n), 1), n + 1)]
        pairs = [(a * (PAIR_SIZE + 1) + b, i, j) for a, b in sizes if paired(a, b)
                 for j in range(n - shared(a, b) + 2) for i in range(j)]
        single = {b for a, b in sizes if not paired(a, b)}
        return pairs + [(-b, i, -1) for b in sorted(single) for i in range(n - least(n) + 1)]

    def keys(small: bool) -> Column:
        shape = "array<struct<s:bigint,i:int,j:int>>"
        short = F.from_json(F.lit(json.dumps([[dict(zip("sij", k)) for k in of_short(n, small)] for n in range(PAIR_SIZE + 1)])), f"array<{shape}>")
        places = F.sequence(F.lit(0), n - F.ceil(threshold * n - 1e-9).cast("int"))
        sizes = F.sequence(n, F.floor(n / threshold + 1e-9).cast("int")) if small else F.array(n)
        long = F.flatten(F.transform(sizes, lambda m: F.transform(places, lambda i: F.struct(
            (-m).cast("bigint").alias("s"), i.alias("i"), F.lit(-1).alias("j")))))
        return F.explode(F.when(n <= PAIR_SIZE, F.get(short, n)).otherwise(long))

    # A key is a hash of sizes and items; what a collision brings together is settled by the sets.
    key = F.xxhash64("_k.s", F.get("items", F.col("_k.i")), F.get("items", F.col("_k.j")))
    keyed = lambda small: ranked.withColumn("_k", keys(small)).withColumn("_key", key)
    small = keyed(True).select("_key", F.col("id").alias("a"), n.alias("na"), F.col("items").alias("ia"))
    large = keyed(False).select("_key", F.col("id").alias("b"), n.alias("nb"), F.col("items").alias("ib"))
    # The sets travel with the keys, so a pair is settled where it meets and few pairs are shuffled.
    met = small.join(large, "_key").where((F.col("na") < F.col("nb")) | ((F.col("na") == F.col("nb")) & (F.col("a") < F.col("b"))))
    both = F.size(F.array_intersect("ia", "ib"))
    scored = met.select("a", "b", (both / (F.col("na") + F.col("nb") - both)).alias("jaccard"))
    return scored.where(F.col("jaccard") >= threshold).distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """``node, component`` with the smallest member as the component, by alternating stars.

    ``edges`` is ``a, b``.  Every round writes a checkpoint, so a lost executor
    recomputes one round; the loop ends when a round changes nothing.
    """
    def star(pairs: DataFrame, large: bool) -> DataFrame:
        if large:
            around = pairs.select("a", "b").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        else:
            around = pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        lowest = around.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        hooked = around.join(lowest, "a")
        linked = hooked.where((F.col("b") > F.col("a")) if large else F.lit(True)).select(F.col("b").alias("a"), F.col("m").alias("b"))
        if not large:
            linked = linked.unionByName(lowest.select("a", F.col("m").alias("b")))
        return linked.where(F.col("a") != F.col("b")).distinct()

    def mark(pairs: DataFrame):
        return pairs.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()

    now = checkpointed(edges.where(F.col("a") != F.col("b")).select("a", "b").distinct())
    seen = mark(now)
    while True:
        now = checkpointed(star(star(now, True), False))
        again = mark(now)
        if again == seen:
            break
        seen = again
    return now.select(F.col("a").alias("node"), F.col("b").alias("component"))


def cluster_tracks(points: DataFrame, threshold: float = 0.6) -> DataFrame:
    """``track, cluster``: tracks seen in much the same frames share a cluster.

    Tracks with equal frame sets are folded first, so a crowd of copies is one
    node.  The cluster id is the smallest track id it holds.
    """
    sets = points.groupBy("track").agg(F.sort_array(F.collect_set("frame")).alias("items"))
    folded = sets.groupBy("items").agg(F.min("track").alias("id"))
    edges = similar_sets(folded.select("id", "items"), threshold).select("a", "b")
    roots = connected_components(edges)
    members = sets.join(folded, "items").select("track", "id")
    return (members.join(roots, members["id"] == roots["node"], "left")
            .select("track", F.coalesce("component", "id").alias("cluster")))


def cluster_summary(points: DataFrame, clusters: DataFrame) -> DataFrame:
    """Per cluster: tracks, extent and the frame most of its tracks share (first on ties)."""
    joined = points.join(clusters, "track")
    crowd = joined.groupBy("cluster", "frame").agg(F.count_distinct("track").alias("n"))
    reference = crowd.groupBy("cluster").agg(F.max_by("frame", F.struct("n", -F.col("frame"))).alias("ref_frame"))
    whole = joined.groupBy("cluster").agg(
        F.count_distinct("track").alias("n_tracks"), F.count(F.lit(1)).alias("n_obs"),
        F.min("frame").alias("first_frame"), F.max("frame").alias("last_frame"),
        F.sum("amplitude").alias("amplitude_sum"))
    return whole.join(reference, "cluster")


def unknown_diagram(points: DataFrame, clusters: DataFrame, stored: DataFrame | None = None) -> DataFrame:
    """Observations with their cluster (-1 without) and, per cluster, those that have none."""
    rows = points.join(clusters, "track", "left").withColumn("cluster", F.coalesce("cluster", F.lit("-1")))
    if stored is None:
        return rows
    return rows.join(stored.select("cluster").distinct(), "cluster", "full")


def unknown_series(observations: DataFrame, by: Sequence[str], d: Column, threshold: float = 0.6, **linking) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The whole step over unexplained peaks: linked points with their cluster, the clusters, their fingerprints.

    Observations are linked into tracks, tracks seen together are clustered, each
    cluster is summed up, and ``d`` of its tracks is told at the frame most of them share.
    Clusters form within a series; ``linking`` goes to ``link_tracks``.
    """
    name = F.concat_ws("/", *[F.col(k).cast("string") for k in by], "track")
    linked = link_tracks(observations, by, **linking)
    points = checkpointed(linked.select(*by, name.alias("track"), F.concat_ws("/", *[F.col(k).cast("string") for k in by], F.lpad(F.col("position").cast("string"), 12, "0")).alias("frame"),
                                        "obs", "position", "axis", "center", "amplitude", "fwhm"))
    clusters = checkpointed(cluster_tracks(points, threshold))
    crowd = points.join(clusters, "track").groupBy("cluster", "frame").agg(F.count_distinct("track").alias("n"), F.first("position").alias("position"))
    shared = crowd.groupBy("cluster").agg(F.max_by(F.struct("frame", "position"), F.struct("n", -F.col("position"))).alias("ref"))
    summary = (points.join(clusters, "track").groupBy("cluster").agg(
        F.count_distinct("track").alias("n_tracks"), F.count(F.lit(1)).alias("n_obs"), F.min("position").alias("first_position"),
        F.max("position").alias("last_position"), F.sum("amplitude").alias("amplitude_sum"))
        .join(shared, "cluster").select("*", F.col("ref.frame").alias("ref_frame")).drop("ref"))
    marks = fingerprints(points, clusters, summary, d)
    return unknown_diagram(points, clusters), summary, marks


def fingerprints(points: DataFrame, clusters: DataFrame, summary: DataFrame, d: Column) -> DataFrame:
    """d-spacings of each cluster's tracks at its reference frame."""
    rows = points.join(clusters, "track").join(summary.select("cluster", F.col("ref_frame").alias("frame")), ["cluster", "frame"])
    return rows.select("cluster", "track", d.alias("d"))


def transition_summary(points: DataFrame, series_frames: DataFrame, windows: DataFrame | None = None,
                       chunk: float = 4096.0) -> DataFrame:
    """Births, deaths, live tracks and center shift at each step of a series.

    ``series_frames`` lists ``series, position``.  A live track is one born at or
    before the step that ends after it, so two running sums replace a range join.
    ``windows`` (``series, position, direct``) adds the window clause, which needs
    four finite steps.
    """
    ends = points.groupBy("series", "track").agg(F.min("position").alias("first"), F.max("position").alias("last"))
    born = ends.groupBy("series", F.col("first").alias("position")).agg(F.count(F.lit(1)).alias("born"))
    died = ends.groupBy("series", F.col("last").alias("position")).agg(F.count(F.lit(1)).alias("died"))
    counts = (series_frames.join(born, ["series", "position"], "left").join(died, ["series", "position"], "left")
              .fillna(0, ["born", "died"]))
    live = with_running_sum(counts, ["series"], ["position"], "position", chunk, F.col("born") - F.col("died"), "_live")
    steps = with_previous(live, ["series"], ["position"], "position", chunk, ["position", "died", "_live"]).where(
        F.col("prev_position").isNotNull())
    out = steps.select("series", F.col("prev_position").alias("from"), F.col("position").alias("to"),
                       F.col("born").alias("births"), F.col("prev_died").alias("deaths"),
                       F.col("prev__live").alias("n_active"))
    moves = with_previous(points, ["series", "track"], ["position"], "position", chunk, ["position", "center"]).where(
        F.col("prev_position").isNotNull()).select(
        "series", F.col("prev_position").alias("from"), F.col("position").alias("to"),
        F.abs(F.col("center") - F.col("prev_center")).alias("shift"))
    direct = out.select("series", "from", "to").join(moves, ["series", "from", "to"])
    medians = exact_quantiles(direct, "shift", [0.5], ["series", "from", "to"]).select(
        "series", "from", "to", F.col("q0").alias("median_center_shift"))
    out = out.join(medians, ["series", "from", "to"], "left")
    busy = F.col("births") + F.col("deaths") >= F.greatest(F.lit(2), F.ceil(0.25 * F.col("n_active")))
    if windows is None:
        return out.withColumn("transition_candidate", busy)
    level = windows.groupBy("series", F.col("position").alias("to")).agg(F.median("direct").alias("window_direct_median"))
    out = out.join(level, ["series", "to"], "left")
    stats = median_and_mad(level.where(F.col("window_direct_median").isNotNull()), "window_direct_median").select(
        F.struct("n", "median", "mad")).scalar()
    drop = (F.col("_w.n") >= 4) & (F.col("window_direct_median") < F.col("_w.median") - 2 * 1.4826 * F.col("_w.mad"))
    return (out.withColumn("_w", stats)
            .withColumn("transition_candidate", busy | F.coalesce(drop, F.lit(False))).drop("_w"))
