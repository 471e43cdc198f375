"""Tracks whose links also need evidence from the region of interest."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import checkpointed
from .correlations import directional_ious, filled_rows
from .joins import greedy_pairs, interval_join, spread
from .ordered import with_rank
from .tracks import SERIES_ROWS, link_tracks

MIN_SIMILARITY = 0.2


def mutual_similarity(axis: Sequence[float], least: float = 0.0):
    """Geometric means of the two directional ROI similarities of pairs of peak rows, see ``Linker``.

    What one direction keeps below ``least`` whatever the other says is 0.
    """
    x = np.asarray(axis, float)

    def score(before: list[dict], rows: list[dict]):
        profiles: dict[int, tuple[int, np.ndarray]] = {}

        def sides(peaks: list[dict]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            # The peaks of one position share the profile.
            which = [profiles.setdefault(id(p["profile"]), (len(profiles), p["profile"]))[0] for p in peaks]
            center, half = (np.array([p[c] for p in peaks], float) for c in ("center", "half_width"))
            return np.array(which, int), center - half, center + half

        (pa, a0, a1), (pb, b0, b1) = sides(before), sides(rows)
        block = filled_rows(np.array([np.full(x.size, np.nan) if p is None else np.asarray(p, float) for _, p in profiles.values()]), x)

        def of_pairs(i: np.ndarray, j: np.ndarray) -> np.ndarray:
            out = directional_ious(x, block, pa[i], block, pb[j], a0[i], a1[i], b0[j], b1[j])
            some = np.flatnonzero(out >= least ** 2 * (1 - 1e-9))
            out[out < least ** 2 * (1 - 1e-9)] = 0.0
            i, j = i[some], j[some]
            out[some] = np.sqrt(out[some] * directional_ious(x, block, pb[j], block, pa[i], b0[j], b1[j], a0[i], a1[i]))
            return out
        return of_pairs
    return score


def build_tracks(peaks: DataFrame, patterns: DataFrame, channel: str, axis: Sequence[float],
                 by: Sequence[str], *, min_similarity: float = MIN_SIMILARITY, **options) -> DataFrame:
    """Link the peaks of frames with a pattern by position, gated by mutual ROI similarity; 0 switches the gate off."""
    rows = peaks.select(
        *by, F.concat_ws("/", "peak_id", F.col("slot").cast("string")).alias("obs"),
        F.col("frame").alias("position"), F.col("frame").cast("double").alias("axis"), "center",
        F.coalesce("area", F.lit(0.0)).alias("amplitude"), F.col("width").alias("fwhm"), "half_width")
    profiles = patterns.select(F.col("frame").alias("position"), F.col(channel).alias("profile"))
    if not min_similarity > 0:
        return link_tracks(rows.join(profiles.select("position").distinct(), "position", "left_semi"), by, **options)
    # A pattern is sent once to the peaks of its frame.
    return link_tracks(rows, by, similarity=mutual_similarity(axis, min_similarity), min_similarity=min_similarity, extra=["half_width"], attached=profiles, **options)


# --- tracks as paths of edges ------------------------------------------------------------------

def by_length(obs: DataFrame, by: Sequence[str], rows: int = SERIES_ROWS) -> tuple[DataFrame, DataFrame | None]:
    """The groups of at most ``rows`` observations, all named, which are taken whole in one task, and the others, none if there are none."""
    by = list(by)
    known = obs.where(" and ".join(f"{c} is not null" for c in by))
    long = checkpointed(known.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"), F.count_if(F.col("obs").isNull()).alias("_nameless")).where(
        (F.col("_n") > rows) | (F.col("_nameless") > 0)).select(*by))
    return (known, None) if long.isEmpty() else (known.join(long, by, "left_anti"), known.join(long, by, "left_semi"))


def ranked(obs: DataFrame, by: Sequence[str], order: str, whole: bool = False) -> DataFrame:
    """Add ``rank``: the place of the row's ``order`` value among those of its group, whatever the gaps between them.

    ``whole``, here and below: a group fits into the memory of a task and is never cut.
    """
    by = list(by)
    if whole:
        known = obs.where(" and ".join(f"{c} is not null" for c in [*by, order]))
        return known.withColumn("rank", (F.dense_rank().over(Window.partitionBy(*by).orderBy(order)) - 1).cast("long"))
    places = with_rank(obs.select(*by, order).where(F.col(order).isNotNull()).distinct(), by, [order], order, 4096.0, "rank")
    return obs.join(places, [*by, order])


def near_pairs(tails: DataFrame, heads: DataFrame, by: Sequence[str], link_tol: float, silence: int, bucket: float) -> DataFrame:
    """Pairs of a tail and a head ``silence`` ranks later whose centers lie within ``link_tol`` of the wider width."""
    by = list(by)
    fields = ["obs", "axis", "center", "width", "feature"]
    a = tails.select(*by, (F.col("rank") + silence).alias("rank"), *[F.col(c).alias(f"{c}_a") for c in fields])
    b = heads.select(*by, "rank", *[F.col(c).alias(f"{c}_b") for c in fields])
    reach = lambda c, w: (F.col(c) - link_tol * F.col(w) * (1 + 1e-12), F.col(c) + link_tol * F.col(w) * (1 + 1e-12))
    keys = [*by, "rank"]
    # The wider width decides: within reach of one side or of the other.
    either = interval_join(a, b, keys, *reach("center_a", "width_a"), "center_b", bucket).unionByName(
        interval_join(b, a, keys, *reach("center_b", "width_b"), "center_a", bucket)).distinct()
    gap = F.abs(F.col("center_b") - F.col("center_a"))
    return either.withColumn("gap", gap).where(F.col("gap") <= link_tol * F.greatest("width_a", "width_b", F.lit(1e-9)))


def near_pairs_of_groups(obs: DataFrame, by: Sequence[str], link_tol: float, silences: Sequence[int]) -> DataFrame:
    """``near_pairs`` of all ``silences``, found in each group at once.

    An id that stands at several ranks also gives a pair with itself for each, of silence 0.
    """
    by, fields = list(by), ["obs", "rank", "axis", "center", "width", "feature"]
    out = T.StructType([*[obs.schema[c] for c in by], T.StructField("silence", T.IntegerType()), T.StructField("gap", T.DoubleType()),
                        *[T.StructField(f"{c}_{side}", obs.schema[c].dataType) for side in "ab" for c in fields]])

    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by([("rank", "ascending"), ("center", "ascending")]).combine_chunks()
        ids = group["obs"].combine_chunks().dictionary_encode().indices.to_numpy()
        again = np.flatnonzero(np.bincount(ids, minlength=1)[ids] > 1)
        found = [(np.zeros(again.size, np.int32), np.zeros(again.size), again, again)]
        placed = np.flatnonzero(group["center"].is_valid())
        rank, center, width = (group[c].take(pa.array(placed)).to_numpy().astype(float) for c in ("rank", "center", "width"))
        if len(center):
            own = link_tol * width * (1 + 1e-12)
            # Ranks are laid out one after another, further apart than any reach.
            low, widest = center.min(), np.fmax.reduce(np.append(np.abs(own), 1e-9))
            apart = center.max() - low + 2 * widest + 1.0
            slack = (rank.max() + 2) * apart * 1e-14
            laid = rank * apart + (center - low)
            for silence in silences:
                middle = laid + silence * apart
                first = np.searchsorted(laid, middle - widest - slack)
                count = np.searchsorted(laid, middle + widest + slack, side="right") - first
                a = np.repeat(np.arange(len(laid)), count)
                b = np.arange(a.size) - (count.cumsum() - count)[a] + first[a]
                gap = np.abs(center[b] - center[a])
                with np.errstate(invalid="ignore"):
                    met = ((center[b] >= center[a] - own[a]) & (center[b] <= center[a] + own[a])) | ((center[a] >= center[b] - own[b]) & (center[a] <= center[b] + own[b]))
                met &= (rank[b] == rank[a] + silence) & (gap <= link_tol * np.fmax(np.fmax(width[a], width[b]), 1e-9))
                found.append((np.full(met.sum(), silence, np.int32), gap[met], placed[a[met]], placed[b[met]]))
        silence, gap, a, b = (np.concatenate(c) for c in zip(*found))
        sides = [group[c].take(pa.array(at)) for at in (a, b) for c in fields]
        return pa.table([*[group[c].take(pa.array(a)) for c in by], pa.array(silence), pa.array(gap), *sides], names=out.names)

    return obs.select(*by, *fields).groupBy(*by).applyInArrow(run, out)


def closest_of_groups(pairs: DataFrame, by: Sequence[str]) -> DataFrame:
    """``greedy_pairs`` silence by silence, group by group: what is linked is not offered to longer silences."""
    by = list(by)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, led, met = None, set(), set()
        for batch in batches:
            kept = []
            for i, (a, b, silence, *key) in enumerate(zip(*[batch[c].to_pylist() for c in ("obs_a", "obs_b", "silence", *by)])):
                if key != now:
                    now, led, met = key, set(), set()
                if not silence:
                    kept.append(i)
                elif a not in led and b not in met:
                    led.add(a)
                    met.add(b)
                    kept.append(i)
            yield batch.take(pa.array(kept, pa.int64()))

    return spread(pairs, *by).sortWithinPartitions(*by, "silence", "gap", "_unlike", "obs_a", "obs_b").mapInArrow(run, pairs.schema)


def link_edges(obs: DataFrame, by: Sequence[str], similarity: Column, *, link_tol: float = 1.5, max_gap: int = 2,
               min_similarity: float = MIN_SIMILARITY, bucket: float = 0.1, whole: bool = False) -> DataFrame:
    """One-to-one edges between observations of neighbouring ranks, closest first.

    ``obs`` is ``by, obs, rank, axis, center, width, feature``; ``similarity`` is a column of a pair's
    ``feature_a`` and ``feature_b`` (or of its other columns with these endings) and an unknown one links nothing; 0 as
    least similarity switches the gate off.  Ranks that follow each other are linked first; what has no
    successor is then offered to the observations without predecessor two ranks on, and so
    on to ``max_gap`` silent ranks.  Ties fall to the more similar pair, then to the ids.  The edges of ``whole`` groups
    also tell rank, axis and center of both ends, which spares ``track_paths`` the observations; rows of silence 0 among
    them are no edges but the places of an id that has several.
    """
    by = list(by)
    ends = [f"{c}_{side}" for side in "ab" for c in ("rank", "axis", "center")]
    measures = [(F.col("center_b") - F.col("center_a")).alias("center_shift"), (F.col("axis_b") - F.col("axis_a")).alias("axis_gap")]
    if whole:
        pairs = near_pairs_of_groups(obs, by, link_tol, range(1, max_gap + 2)).withColumn("similarity", similarity)
        if min_similarity > 0:
            pairs = pairs.where((F.col("silence") == 0) | (F.col("similarity") >= min_similarity))
        pairs = pairs.withColumn("_unlike", -F.coalesce("similarity", F.lit(0.0))).select(*by, "obs_a", "obs_b", "silence", "similarity", "gap", "_unlike", *ends)
        return closest_of_groups(pairs, by).select(*by, "obs_a", "obs_b", "silence", "similarity", *measures, *ends)
    edges = None
    for silence in range(1, max_gap + 2):
        tails, heads = obs, obs
        if edges is not None:
            tails = obs.join(edges.select(F.col("obs_a").alias("obs")), "obs", "left_anti")
            heads = obs.join(edges.select(F.col("obs_b").alias("obs")), "obs", "left_anti")
        pairs = near_pairs(tails, heads, by, link_tol, silence, bucket).withColumn("similarity", similarity)
        if min_similarity > 0:
            pairs = pairs.where(F.col("similarity") >= min_similarity)
        pairs = pairs.withColumn("_unlike", -F.coalesce("similarity", F.lit(0.0)))
        kept = greedy_pairs(pairs, ["obs_a"], ["obs_b"], ["gap", "_unlike", "obs_a", "obs_b"]).select(
            *by, "obs_a", "obs_b", F.lit(silence).alias("silence"), "similarity", *measures)
        edges = checkpointed(kept if edges is None else edges.unionByName(kept))
    return edges


def path_heads(edges: DataFrame) -> DataFrame:
    """``obs, track``: the first observation of the path that each observation of an edge lies on, by pointer jumping.

    Every observation has one edge in and one out at most.  Each round doubles the steps a pointer
    takes, so a path of n edges needs log2(n) rounds; a round is one join of small rows and ends in a checkpoint.
    """
    back = edges.select(F.col("obs_b").alias("obs"), F.col("obs_a").alias("track"))
    first = edges.select(F.col("obs_a").alias("obs")).join(back.select("obs"), "obs", "left_anti").withColumn("track", F.col("obs"))
    now = checkpointed(back)
    while True:
        further = now.select(F.col("obs").alias("track"), F.col("track").alias("_next"))
        jumped = checkpointed(now.join(further, "track", "left").select("obs", F.coalesce("_next", "track").alias("track"), F.col("_next").isNotNull().alias("_moved")))
        now = jumped.drop("_moved")
        if jumped.where("_moved").isEmpty():
            return now.unionByName(first)


def paths_of_groups(edges: DataFrame, by: Sequence[str], min_points: int) -> DataFrame:
    """The edges of all paths of ``min_points`` observations or more with their ``track``, and the places of their ids, chained group by group."""
    by = list(by)
    out = T.StructType([*edges.schema, T.StructField("track", edges.schema["obs_a"].dataType)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def chained(table: pa.Table, keys: list[tuple]) -> list[pa.RecordBatch]:
            rows = [*zip(keys, *[table[c].to_pylist() for c in ("obs_a", "obs_b", "silence")])]
            edge = {(k, a): ((k, b), i) for i, (k, a, b, silence) in enumerate(rows) if silence}
            places: dict[tuple, list[int]] = {}
            for i, (k, a, _, silence) in enumerate(rows):
                if not silence:
                    places.setdefault((k, a), []).append(i)
            followers, kept, names = {end for end, _ in edge.values()}, [], []
            for first in edge:
                if first not in followers:
                    path, more, at = [], [*places.get(first, [])], first
                    while at in edge:
                        at, i = edge[at]
                        path.append(i)
                        more += places.get(at, [])
                    if len(path) + 1 >= min_points:
                        kept += path + more
                        names += [first[1]] * len(path + more)
            return table.take(pa.array(kept, pa.int64())).append_column("track", pa.array(names, table["obs_a"].type)).to_batches()

        held = None
        for batch in batches:
            table = pa.concat_tables([*([] if held is None else [held]), pa.Table.from_batches([batch])])
            if table.num_rows:
                # The last group may go on in the next batch.
                keys = list(zip(*[table[c].to_pylist() for c in by]))
                end = keys.index(keys[-1])
                yield from chained(table.slice(0, end), keys[:end])
                held = table.slice(end)
        if held is not None:
            yield from chained(held, list(zip(*[held[c].to_pylist() for c in by])))

    return spread(edges, *by).sortWithinPartitions(*by).mapInArrow(run, out)


def track_paths(obs: DataFrame, edges: DataFrame, by: Sequence[str], min_points: int = 3, whole: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The points, edges and summary of all paths of ``min_points`` observations or more; a track is named by its first one.

    The summary has the extent in rank and axis, the first and last center and the mean similarity of the edges.
    """
    by = list(by)
    if whole:
        told = paths_of_groups(edges, by, min_points)
        kept = told.where("silence > 0")
        named = kept.select(*by, F.col("obs_a").alias("obs"), "track").unionByName(kept.select(*by, F.col("obs_b").alias("obs"), "track")).distinct()
        end = lambda side: F.struct(*[F.col(f"{c}_{side}").alias(c) for c in ("obs", "rank", "center", "axis")])
        points = told.select(*by, "track", F.explode(F.array(end("a"), end("b"))).alias("_p")).select(*by, "track", "_p.*").distinct()
        likeness = kept.groupBy("track", *by).agg(F.avg("similarity").alias("mean_similarity"))
        return obs.join(named, [*by, "obs"]), kept, path_summary(points, by).join(likeness, ["track", *by])
    heads = path_heads(edges)
    long_enough = heads.groupBy("track").agg(F.count(F.lit(1)).alias("n_obs")).where(F.col("n_obs") >= min_points)
    named = heads.join(long_enough.select("track"), "track", "left_semi")
    points = obs.join(named, "obs")
    kept = edges.join(named.select(F.col("obs").alias("obs_a"), "track"), "obs_a")
    likeness = kept.groupBy("track").agg(F.avg("similarity").alias("mean_similarity"))
    return points, kept, path_summary(points, by).join(likeness, "track")


def path_summary(points: DataFrame, by: Sequence[str]) -> DataFrame:
    """Extent in rank and axis, first and last center of each track."""
    at = lambda c, pick: pick(c, "rank")
    return points.groupBy(*by, "track").agg(
        F.count(F.lit(1)).alias("n_obs"), F.min("rank").alias("first_rank"), F.max("rank").alias("last_rank"),
        at("center", F.min_by).alias("center_first"), at("center", F.max_by).alias("center_last"),
        at("axis", F.min_by).alias("axis_first"), at("axis", F.max_by).alias("axis_last"))
