"""Several rings of a cake, masked integration, tracks as paths of edges."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from braggline.operators import joins, roi_tracks, spots, texture

CAKE = "frame long, abin int, azim double, rbin int, radial double, y double"


def cake(rings, n_azim=36, n_bins=120, wave=None, noise=0.5, seed=0):
    """Rows of one cake with rings of (bin, height, width), optionally wavy."""
    rng = np.random.default_rng(seed)
    rows = []
    for a in range(n_azim):
        azim = -180.0 + 10 * a
        shift = 0.0 if wave is None else wave * math.cos(math.radians(azim - 30)) / 0.01
        for b in range(n_bins):
            y = 10 + sum(h * math.exp(-((b - c - shift) / w) ** 2) for c, h, w in rings) + rng.normal(0, noise)
            rows.append((a, azim, b, 1.0 + 0.01 * b, float(y)))
    return rows


def table(spark, cakes):
    return spark.createDataFrame([(f, *r) for f, rows in cakes.items() for r in rows], CAKE)


def test_strong_isolated_rings_are_picked(spark):
    cakes = table(spark, {1: cake([(20, 50, 2), (26, 30, 2), (60, 100, 2), (95, 40, 2)]), 2: cake([(40, 80, 3)], seed=1), 3: cake([], seed=2, noise=0.0)})
    got = {}
    for r in texture.pick_rings(cakes, n_rings=3, separation=8).orderBy("frame", "ring").collect():
        got.setdefault(r.frame, []).append(round(r.r0, 2))
    # Bin 26 stands within eight bins of the higher bin 20.
    assert got == {1: [1.2, 1.6, 1.95], 2: [1.4]}
    two = texture.pick_rings(cakes.where("frame = 1"), n_rings=2, separation=3).orderBy("ring").collect()
    assert [(r.ring, round(r.r0, 2)) for r in two] == [(0, 1.2), (1, 1.6)]


def test_texture_and_waviness_per_ring(spark):
    cakes = table(spark, {1: cake([(30, 200, 3), (80, 300, 3)], wave=0.02, noise=0.1), 2: cake([(30, 200, 3)], wave=0.01, noise=0.1)})
    rings = texture.pick_rings(cakes, separation=10).cache()
    assert rings.groupBy("frame").count().orderBy("frame").select("count").collect() == [(2,), (1,)]
    metrics = {(r.frame, r.ring): r for r in texture.texture_of_rings(cakes, rings, halfwidth=0.12).collect()}
    assert set(metrics) == {(1, 0), (1, 1), (2, 0)} and all(r.coverage == 1 and r.texture_index < 0.1 for r in metrics.values())
    fits = texture.waviness_of_rings(cakes, rings, halfwidth=0.12).cache()
    by = {(r.frame, r.ring): r for r in fits.collect()}
    assert all(abs(by[k].A1 - (0.02 if k[0] == 1 else 0.01)) < 0.002 and abs(by[k].phi1 - 30) < 5 for k in by)
    worst, summary = texture.diagnose_waviness(fits, "q", wavelength=0.4, distance=0.3)
    assert worst.count() == 2
    row = summary.first()
    assert row.n_cakes == 2 and row.A1_median == pytest.approx(0.015, abs=0.002) and row.doublet_splitting == pytest.approx(2 * row.A1_median)
    assert row.offset_mm == pytest.approx(row.A1_median * 0.4 / (2 * math.pi) * 300)
    assert texture.diagnose_waviness(fits, "q")[1].first().offset_mm is None
    straight = texture.straighten(cakes, fits, 0.01, 1.0)
    assert straight.where("frame = 1 and rbin = 80").first()["mean"] > cakes.where("frame = 1 and rbin = 80").agg(F.avg("y")).first()[0]


def test_no_cakes_no_rings(spark):
    assert texture.pick_rings(spark.createDataFrame([], CAKE)).collect() == []


def masked_by_hand(rows, boxes, keep):
    sums = {}
    for f, _, azim, b, radial, y in rows:
        inside = any(f == g and abs(radial - q) <= hq and abs((azim - az + 180) % 360 - 180) <= ha for g, q, az, hq, ha in boxes)
        if inside == keep:
            n, total = sums.get((f, b), (0, 0.0))
            sums[f, b] = (n + 1, total + y)
    return {k: (n, total / n) for k, (n, total) in sums.items()}


@pytest.mark.parametrize("keep", [True, False])
def test_masks_wrap_around_and_leave_the_rest(spark, keep):
    rows = [(f, *r) for f in (1, 2) for r in cake([(5, 20, 2)], n_azim=12, n_bins=12, seed=f)]
    rows = [(f, a, -180.0 + 30 * a, b, x, y) for f, a, _, b, x, y in rows]
    boxes = [(1, 1.05, 175.0, 0.021, 40.0), (1, 1.08, 0.0, 0.011, 31.0), (2, 9.0, 0.0, 0.1, 10.0)]
    frame = spark.createDataFrame(boxes, "frame long, q double, azim double, q_width double, azim_width double")
    got = spots.integrate_masked(spark.createDataFrame(rows, CAKE), frame, keep=keep).collect()
    want = masked_by_hand(rows, boxes, keep)
    assert {(r.frame, r.rbin): r.n for r in got} == {k: n for k, (n, _) in want.items()}
    assert all(r.intensity == pytest.approx(want[r.frame, r.rbin][1]) and r.sigma == pytest.approx(math.sqrt(r.intensity * r.n) / r.n) for r in got)


def test_masked_patterns_floor_zeros_and_drop_windows(spark):
    rows = [(1, 0, 0.0, b, 1.0 + b, y) for b, y in enumerate((0.0, 4.0, 9.0, None, 16.0))]
    box = spark.createDataFrame([(1, 3.0, 0.0, 10.0, 180.0)], "frame long, q double, azim double, q_width double, azim_width double")
    got = spots.integrate_masked(spark.createDataFrame(rows, CAKE), box, exclude_windows=[(4.5, 5.5)]).orderBy("rbin").collect()
    assert [(r.rbin, r.intensity, r.sigma) for r in got] == [(0, 0.0, 2.0), (1, 4.0, 2.0), (2, 9.0, 3.0)]


def paths_by_hand(rows, tol, max_gap, least, min_points):
    ranks = {}
    for s in {r[0] for r in rows}:
        for i, x in enumerate(sorted({r[2] for r in rows if r[0] == s})):
            ranks[s, x] = i
    nxt, prev = {}, {}
    for silence in range(1, max_gap + 2):
        pairs = []
        for a in rows:
            for b in rows:
                if a[0] == b[0] and ranks[b[0], b[2]] - ranks[a[0], a[2]] == silence and a[1] not in nxt and b[1] not in prev:
                    gap, like = abs(b[3] - a[3]), min(a[5], b[5]) / max(a[5], b[5])
                    if gap <= tol * max(a[4], b[4]) and like >= least:
                        pairs.append((gap, -like, a[1], b[1]))
        for _, like, a, b in sorted(pairs):
            if a not in nxt and b not in prev:
                nxt[a], prev[b] = (b, -like), a
    out = {}
    for head in [a for a in nxt if a not in prev]:
        path, likes = [head], []
        while path[-1] in nxt:
            b, like = nxt[path[-1]]
            path.append(b)
            likes.append(like)
        if len(path) >= min_points:
            out[head] = (path, sum(likes) / len(likes))
    return out


@pytest.mark.parametrize("max_gap", [0, 2])
def test_paths_equal_a_plain_linker(spark, max_gap):
    rng = np.random.default_rng(11)
    rows = []
    for s in (1, 2):
        for t in range(6):
            center = 2 + t * 0.5
            for x in range(0, 40, 2):
                center += rng.normal(0, 0.02)
                if rng.random() < 0.85:
                    rows.append((s, f"{s}-{t}-{x:02d}", float(x), round(float(center), 5), 0.05, float(rng.uniform(5, 9))))
    frame = spark.createDataFrame(rows, "series long, obs string, axis double, center double, width double, feature double").withColumn("frame", F.col("axis").cast("long"))
    placed = roi_tracks.ranked(frame, ["series"], "frame")
    like = F.least("feature_a", "feature_b") / F.greatest("feature_a", "feature_b")
    edges = roi_tracks.link_edges(placed, ["series"], like, max_gap=max_gap, min_similarity=0.6)
    points, kept, summary = roi_tracks.track_paths(placed, edges, ["series"])
    want = paths_by_hand([(r[0], r[1], r[2], r[3], r[4], r[5]) for r in rows], 1.5, max_gap, 0.6, 3)
    got = {}
    for r in points.orderBy("rank").collect():
        got.setdefault(r.track, []).append(r.obs)
    assert got == {k: p for k, (p, _) in want.items()} and len(got) > 5
    means = {r.track: r for r in summary.collect()}
    assert all(means[k].mean_similarity == pytest.approx(m) and means[k].n_obs == len(p) for k, (p, m) in want.items())
    assert kept.count() == sum(len(p) - 1 for p in got.values())


def test_long_paths_take_few_rounds(spark):
    edges = spark.range(300).select(F.format_string("%04d", "id").alias("obs_a"), F.format_string("%04d", F.col("id") + 1).alias("obs_b"))
    heads = roi_tracks.path_heads(edges)
    assert heads.select("track").distinct().collect() == [("0000",)] and heads.count() == 301


def test_greedy_pairs_of_a_chain(spark):
    """Each pair shares a side with the next better one: every second stays."""
    pairs = spark.createDataFrame([(i // 2 + (i % 2), f"r{i // 2}", float(i)) for i in range(9)], "l int, r string, gap double")
    got = sorted(r.gap for r in joins.greedy_pairs(pairs, ["l"], ["r"], ["gap"]).collect())
    used, want = set(), []
    for i in range(9):
        left, right = i // 2 + (i % 2), f"r{i // 2}"
        if left not in used and right not in used:
            used |= {left, right}
            want.append(float(i))
    assert got == want


def test_labelled_matrix(spark, tmp_path):
    from braggline.operators import ranking
    axis_d, grid = [4.0, 3.0, 2.0, 1.0], [1.5, 2.5, 3.5, 9.0]
    rows = spark.createDataFrame([(1, [0.0, 2.0, 4.0, 8.0], [1.0, 1.0, 1.0, 1.0], False), (2, [1.0, None, 1.0, 1.0], None, False), (3, [1.0] * 4, [1.0] * 4, True)],
                                 "frame long, a array<double>, b array<double>, excluded boolean")
    known = spark.createDataFrame([(1, "Re", 0.4, 2.0), (1, "Au", 0.5, 1.0), (3, "Au", 0.9, 1.0)], "frame long, phase string, confidence double, pressure double")
    good = spark.createDataFrame([(1,), (1,)], "frame long")
    out = ranking.labelled_matrix(rows, ["a", "b"], axis_d, grid, known, good).cache()
    by = {(r.frame, r.channel): r for r in out.collect()}
    assert set(by) == {(1, "a"), (1, "b"), (2, "a"), (2, "b")}
    assert by[1, "a"].x == [1.0, 0.5, pytest.approx(1 / 6), 0.0] and by[1, "a"].n_good == 2 and by[2, "a"].n_good == 0 and by[2, "a"].labels == []
    assert [(x.phase, x.present, x.pressure) for x in by[1, "b"].labels] == [("Au", True, 1.0), ("Re", False, 2.0)]
    many = spark.range(4000).select(F.col("id").alias("frame"), F.lit("a").alias("channel"))
    ranking.write_matrix(many, str(tmp_path / "m"))
    n = {r.split: r["count"] for r in spark.read.parquet(str(tmp_path / "m")).groupBy("split").count().collect()}
    assert sum(n.values()) == 4000 and abs(n["train"] - 3200) < 120 and abs(n["test"] - 400) < 80


def test_values_on_an_irregular_grid(spark):
    from braggline.operators import maps
    spots_ = [(1, 0.0, 0.0), (2, 1.001, 0.0), (3, 3.0, 0.001), (4, 0.001, 1.0), (5, 0.002, 1.001), (6, 3.0, 2.0), (7, None, 1.0)]
    at = spark.createDataFrame(spots_, "frame long, pos_x double, pos_y double")
    values = spark.createDataFrame([(1, 10.0), (2, None), (3, 30.0), (4, 4.0), (5, 6.0), (7, 9.0)], "frame long, value double")
    got = {(r.row, r.col): (r.value, r.n, r.filled) for r in maps.value_map(at, values, 4.0).collect()}
    assert got == {(0, 0): (10.0, 1, False), (0, 1): (10.0, 0, True), (0, 2): (30.0, 1, False), (1, 0): (5.0, 2, False), (1, 1): (5.0, 0, True),
                   (1, 2): (5.0, 0, True), (2, 0): (None, 0, False), (2, 1): (None, 0, False), (2, 2): (None, 0, False)}
    bare = {(r.row, r.col): r.value for r in maps.value_map(at, values, 4.0, fill=False).collect()}
    assert sum(v is not None for v in bare.values()) == 3 and len(bare) == 9


def test_pattern_image_follows_the_variable(spark):
    from braggline.operators import maps
    rows = spark.createDataFrame([(f, b, 1.0 + b, float(10 * f + b)) for f in (1, 2, 3, 4) for b in range(2)], "frame long, bin int, radial double, clean double")
    frames = spark.createDataFrame([(1, 5.0), (2, 1.0), (3, None), (4, 1.0)], "frame long, pressure double")
    got = sorted((r.rank, r.x, r.bin, r.value) for r in maps.pattern_image(rows, frames, variable="pressure").collect())
    assert got == [(0, 1.0, 0, 20.0), (0, 1.0, 1, 21.0), (1, 1.0, 0, 40.0), (1, 1.0, 1, 41.0), (2, 5.0, 0, 10.0), (2, 5.0, 1, 11.0)]
