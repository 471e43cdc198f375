"""Operators on small planted tables, against brute force, and for any partitioning."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from braggline.functions import axis, metadata as md
from braggline.operators import background as bg
from braggline.operators import corpus, fractions, joins, maps, ordered, ranking, spots, tracks
from braggline.operators import identify as idn
from braggline.operators import metadata as meta


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_exact_quantiles_with_a_bracket(spark):
    rng = np.random.default_rng(0)
    pdf = pd.DataFrame({"g": rng.integers(0, 3, 6000), "v": np.round(rng.lognormal(0, 2, 6000), 2)})
    pdf.loc[:2500, "g"] = 0
    df = spark.createDataFrame(pdf)
    # A small sketch forces the bracket path that large groups take.
    got = ordered.exact_quantiles(df, "v", [0.5, 0.995, 0.0, 1.0], ["g"], accuracy=200).toPandas().set_index("g")
    for g, part in pdf.groupby("g"):
        want = np.quantile(part["v"], [0.5, 0.995, 0, 1])
        np.testing.assert_allclose(got.loc[g, ["q0", "q1", "q2", "q3"]].to_numpy(float), want)
        assert got.loc[g, "n"] == len(part)


def test_ordered_helpers_cross_chunks(spark):
    rng = np.random.default_rng(1)
    pdf = pd.DataFrame({"g": 1, "x": np.round(rng.uniform(-5, 5, 400), 3), "id": range(400)})
    df = spark.createDataFrame(pdf)
    got = ordered.with_previous(df, ["g"], ["x", "id"], "x", 0.1, ["x"])
    got = ordered.with_island(got, ["g"], ["x", "id"], "x", 0.1, 0.05).toPandas().sort_values(["x", "id"])
    want = pdf.sort_values(["x", "id"])
    np.testing.assert_allclose(got["prev_x"].to_numpy(float)[1:], want["x"].to_numpy()[:-1])
    np.testing.assert_array_equal(got["island"], (want["x"].diff() > 0.05).cumsum())
    rank = ordered.with_rank(df, ["g"], ["x", "id"], "x", 0.1).toPandas().sort_values(["x", "id"])
    assert rank["rank"].tolist() == list(range(400))


def test_nearest_join_equals_brute_force(spark):
    rng = np.random.default_rng(2)
    left = pd.DataFrame({"g": rng.integers(0, 2, 80), "a": np.round(rng.uniform(0, 20, 80), 2)})
    right = pd.DataFrame({"g": rng.integers(0, 2, 25), "b": np.round(rng.uniform(0, 20, 25), 2)})
    got = joins.nearest_join(spark.createDataFrame(left), spark.createDataFrame(right), ["g"], "a", "b", 1.0).toPandas()
    assert len(got) == 80
    for row in got.itertuples():
        options = right.loc[right["g"] == row.g, "b"]
        assert row.gap == pytest.approx((options - row.a).abs().min())


def test_interval_join_pairs_each_pair_once(spark):
    a = frame(spark, [(1, 0.95), (2, 2.0)], "id int, c double")
    b = frame(spark, [(10, 0.9), (11, 1.0), (12, 1.05), (13, 3.0)], "k int, x double")
    got = joins.interval_join(a, b, [], F.col("c") - 0.1, F.col("c") + 0.1, "x", 0.02)
    assert sorted((r.id, r.k) for r in got.collect()) == [(1, 10), (1, 11), (1, 12)]


def brute_pairs(pred, obs, tol):
    cand = sorted((abs(p - o), i, j) for i, p in enumerate(pred) for j, o in enumerate(obs) if abs(p - o) < tol[i])
    used_i, used_j, out = set(), set(), []
    for _, i, j in cand:
        if i not in used_i and j not in used_j:
            used_i.add(i)
            used_j.add(j)
            out.append((i, j))
    return sorted(out)


def test_greedy_join_equals_brute_force(spark):
    rng = np.random.default_rng(3)
    pred = pd.DataFrame({"frame": np.repeat(range(6), 8), "phase": "A", "line": list(range(8)) * 6, "pred_d": np.round(rng.uniform(1, 3, 48), 2)})
    obs = pd.DataFrame({"frame": np.repeat(range(6), 9), "obs": list(range(9)) * 6, "d": np.round(rng.uniform(1, 3, 54), 2), "d_err": 0.0})
    got = idn.match_one_to_one(spark.createDataFrame(pred), spark.createDataFrame(obs), 0.05).toPandas()
    for f in range(6):
        p, o = pred[pred["frame"] == f], obs[obs["frame"] == f]
        want = brute_pairs(p["pred_d"].to_numpy(), o["d"].to_numpy(), 2 * 0.05 * p["pred_d"].to_numpy())
        mine = got[got["frame"] == f]
        assert sorted(zip(mine["line"], mine["obs"])) == want


def test_attribution_uses_each_line_and_peak_once(spark):
    obs = frame(spark, [(1, 0, 2.000), (1, 1, 2.004), (1, 2, 1.500)], "frame int, obs int, d double")
    lines = frame(spark, [(1, "A", 0, 2.001, 0), (1, "B", 0, 2.003, 1)], "frame int, phase string, line int, pred_d double, phase_rank int")
    got = {r.obs: r.phase for r in idn.attribute_peaks(obs, lines, 0.01).collect()}
    assert got == {0: "A", 1: "B"}


def brute_tracks(rows, tol, max_gap, min_points):
    """Plain sequential linking of (position, obs, center, fwhm) rows."""
    open_, done = [], []
    for pos in sorted({r[0] for r in rows}):
        now = sorted(r for r in rows if r[0] == pos)
        done += [t for t in open_ if pos - t[-1][0] > max_gap + 1]
        open_ = [t for t in open_ if pos - t[-1][0] <= max_gap + 1]
        cand = sorted((abs(r[2] - t[-1][2]), ti, ri) for ti, t in enumerate(open_) for ri, r in enumerate(now)
                      if abs(r[2] - t[-1][2]) <= tol * max(t[-1][3], r[3]))
        used_t, used_r = set(), set()
        for _, ti, ri in cand:
            if ti not in used_t and ri not in used_r:
                used_t.add(ti)
                used_r.add(ri)
                open_[ti].append(now[ri])
        open_ += [[r] for ri, r in enumerate(now) if ri not in used_r]
    return {frozenset(r[1] for r in t) for t in done + open_ if len(t) >= min_points}


@pytest.mark.parametrize("partitions", [1, 8])
def test_link_tracks_equals_a_plain_loop(spark, partitions):
    rng = np.random.default_rng(7)
    rows = [(int(p), f"{p:03d}-{k}", float(np.round(c + rng.normal(0, 0.02), 4)), 0.05)
            for p in range(60) for k, c in enumerate(np.linspace(1, 6, 9)) if rng.random() < 0.55]
    df = spark.createDataFrame([(1, o, p, float(p), c, 1.0, w) for p, o, c, w in rows],
                               "series long, obs string, position long, axis double, center double, amplitude double, fwhm double")
    got = tracks.link_tracks(df.repartition(partitions), ["series"], chunk=0.3).toPandas()
    mine = {frozenset(part["obs"]) for _, part in got.groupby("track")}
    assert mine == brute_tracks(rows, 1.5, 2, 3)


def test_link_gap_rule_and_groups(spark):
    schema = "series long, obs string, position long, axis double, center double, amplitude double, fwhm double"
    rows = [(s, f"{s}-{p}", p, float(p), 2.0, 1.0, 0.1) for s, ps in ((1, (0, 1, 4, 5)), (2, (0, 1, 5, 6, 7))) for p in ps]
    got = tracks.link_tracks(spark.createDataFrame(rows, schema), ["series"], max_gap=2).toPandas()
    sizes = sorted((s, len(part)) for (s, _), part in got.groupby(["series", "track"]))
    assert sizes == [(1, 4), (2, 3)]


def test_predictor_follows_a_drift(spark):
    schema = "series long, obs string, position long, axis double, center double, amplitude double, fwhm double"
    rows = [(1, str(p), p, float(p), 2.0 + 0.04 * p, 1.0, 0.03) for p in (0, 1, 2, 5, 6)]
    got = tracks.link_tracks(spark.createDataFrame(rows, schema), ["series"], predict=True).toPandas()
    assert got["track"].nunique() == 1 and len(got) == 5


def test_similar_sets_and_components_equal_brute_force(spark):
    rng = np.random.default_rng(8)
    sets = {f"t{i:03d}": sorted(set(rng.integers(0, 12, rng.integers(1, 7)).tolist())) for i in range(120)}
    points = spark.createDataFrame([(t, int(f), 1.0) for t, fs in sets.items() for f in fs], "track string, frame long, amplitude double")
    names = sorted(sets)
    root = {n: n for n in names}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n
    for i, a in enumerate(names):
        for b in names[i + 1:]:
            sa, sb = set(sets[a]), set(sets[b])
            if len(sa & sb) / len(sa | sb) >= 0.6:
                ra, rb = find(a), find(b)
                root[max(ra, rb)] = min(ra, rb)
    got = {r.track: r.cluster for r in tracks.cluster_tracks(points, 0.6).collect()}
    assert got == {n: find(n) for n in names}


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101)], "a long, b long")
    got = {r.node: r.component for r in tracks.connected_components(edges).collect()}
    assert got == {**{i: 0 for i in range(1, 61)}, 101: 100}


def test_fractions_planted_case(spark):
    peaks = frame(spark, [(0, 3.0, 0, "A"), (0, 1.0, 0, "B"), (0, 9.0, 2, "A"), (0, 5.0, 0, ""), (2, 2.0, 0, "A"), (2, 2.0, 0, "B")],
                  "frame int, area double, flag int, phase string")
    shares = fractions.phase_fractions(peaks)
    dense = fractions.dense(shares, spark.range(3).select(F.col("id").cast("int").alias("frame")))
    got = {(r.frame, r.phase): r.fraction for r in dense.collect()}
    assert got == {(0, "A"): 0.75, (0, "B"): 0.25, (1, None): None, (2, "A"): 0.5, (2, "B"): 0.5}
    gated = fractions.phase_fractions(peaks, identified=frame(spark, [(0, "A", 0.5), (2, "A", 0.6)], "frame int, phase string, confidence double"), min_confidence=0.5)
    assert {(r.frame, r.phase): r.fraction for r in gated.collect()} == {(0, "B"): 1.0, (2, "A"): 0.5, (2, "B"): 0.5}


@pytest.mark.parametrize("name,want", [
    ("x_3p9GPa_001.tif", 3.9), ("s_500MPa.tif", 0.5), ("10kbar/a.tif", 1.0), ("2Mbar.tif", 200.0), ("1.5 GPa/b.tif", 1.5),
    ("1,5GPa.tif", 1.5), ("7GPa/P_2GPa.tif", 2.0), ("5GPax.tif", None), ("noP.tif", None), ("3 GPa\\q\\c.tif", 3.0), ("100bar", 0.01)])
def test_pressure_in_names(spark, name, want):
    got = frame(spark, [(name,)], "n string").select(md.parse_pressure_from_path(F.col("n")).alias("p")).first().p
    assert got == (pytest.approx(want) if want is not None else None)


def test_display_names(spark):
    rows = [("data/a/f.h5::entry/data#12",), ("data/a/b.tif",), ("/elsewhere/c.tif",)]
    got = [r.n for r in frame(spark, rows, "s string").select(md.display_name(F.col("s"), "data").alias("n")).collect()]
    assert got == ["a/f.h5::entry/data#000012", "a/b.tif", "c.tif"]


def test_header_values(spark):
    df = spark.createDataFrame([({"Motor_Mne": "samx samy", "motor_pos": "1.5 2.5", "Temp": "300"},)], "h map<string,string>")
    row = df.select(md.header_value(F.col("h"), "SAMY").alias("y"), md.header_value(F.col("h"), "temp").alias("t"), md.header_value(F.col("h"), "z").alias("z")).first()
    assert (row.y, row.t, row.z) == (2.5, 300.0, None)


def test_axis_errors():
    with pytest.raises(ValueError):
        axis.axis_kind("furlong")


def test_axis_needs_a_wavelength(spark):
    with pytest.raises(ValueError):
        axis.radial_to_d(F.col("c"), "2th_deg")
    d = frame(spark, [(0.0,), (2.0,)], "c double").select(axis.radial_to_d(F.col("c"), "q").alias("d")).collect()
    assert d[0].d is None and d[1].d == pytest.approx(math.pi)


def test_grid_positions(spark):
    got = [(r.p.row, r.p.col) for r in spark.range(6).orderBy("id").select(maps.grid_position(F.col("id"), 3).alias("p")).collect()]
    assert got == [(0, 0), (0, 1), (0, 2), (1, 2), (1, 1), (1, 0)]


def test_lines_of_a_jittered_and_a_clean_axis(spark):
    jitter = frame(spark, [(i, x) for i, x in enumerate([0.0, 0.001, 0.5, 0.5015, 1.0, 1.0012])], "frame int, x double")
    assert [r.line for r in maps.cluster_lines(jitter, "x", 0.25).orderBy("frame").collect()] == [0, 0, 1, 1, 2, 2]
    clean = frame(spark, [(i, float(x)) for i, x in enumerate([0, 1, 2, 2])], "frame int, x double")
    assert [r.line for r in maps.cluster_lines(clean, "x", 0.5).orderBy("frame").collect()] == [0, 1, 2, 2]
    same = frame(spark, [(0, 3.0), (1, 3.0)], "frame int, x double")
    assert {r.line for r in maps.cluster_lines(same, "x", 0.5).collect()} == {0}


def test_metadata_rows(spark):
    rows = frame(spark, [(0, None, "a/P1.tif", "1.5", "x"), (1, "1", None, "2.5", "300"), (2, None, "P1", "9", None), (3, None, "zz", "1", None)],
                 "row_no int, Index string, File string, GPa string, T string")
    frames = frame(spark, [(0, "run/P1.tif"), (1, "run/P2.tif")], "frame long, filename string")
    got = {r.frame: (r.pressure, r.temperature) for r in meta.map_rows_to_frames(meta.canonical_columns(rows), frames, "row_no").collect()}
    assert got == {0: (9.0, None), 1: (2.5, 300.0)}


def test_fit_source_names():
    with pytest.raises(ValueError):
        bg.fit_source("nonsense", None)
    with pytest.raises(ValueError):
        bg.fit_source("mean", None)


def test_consolidation_islands_equal_a_plain_loop(spark):
    rng = np.random.default_rng(9)
    rows = [(1, i % 4, f"{i:03d}", float(np.round(rng.choice([2.0, 2.5, 3.1]) + rng.normal(0, 0.01), 4)), float(rng.choice([40.0, -120.0]) + rng.normal(0, 1)),
             float(np.round(rng.uniform(20, 90), 3)), 1.0) for i in range(60)]
    df = spark.createDataFrame(rows, "ladder long, frame long, id string, q double, azim double, intensity double, area double")
    got = spots.consolidate(df, ["ladder"], q_tol=0.03).toPandas()
    merged: list[list] = []
    for r in sorted(rows, key=lambda r: (-r[5], r[2])):
        for m in merged:
            w = np.array([x[5] for x in m])
            q = w @ [x[3] for x in m] / w.sum()
            az = math.degrees(math.atan2(w @ np.sin(np.radians([x[4] for x in m])), w @ np.cos(np.radians([x[4] for x in m]))))
            if abs(r[3] - q) <= 0.03 and abs((r[4] - az + 180) % 360 - 180) <= 6:
                m.append(r)
                break
        else:
            merged.append([r])
    assert {frozenset(p["id"]) for _, p in got.groupby("merged")} == {frozenset(x[2] for x in m) for m in merged}


def test_spot_ladder(spark):
    rows = [(1, f"a{p}", p, float(p), 2 + 0.01 * p, 40.0, 50.0) for p in (1, 2, 4, 5)] + [(1, f"b{p}", p, float(p), 2 + 0.01 * p, -120.0, 30.0) for p in (1, 2, 3)]
    df = spark.createDataFrame(rows, "g long, id string, position long, axis double, q double, azim double, intensity double")
    got = spots.link_spots(df, ["g"]).toPandas()
    assert sorted("".join(sorted(p["id"])) for _, p in got.groupby("track")) == ["a1a2a4a5", "b1b2b3"]


def test_planted_spots_are_found(spark):
    rng = np.random.default_rng(10)
    rows = []
    for a in range(36):
        for r in range(40):
            y = 100 + rng.normal(0, 1) + (200 if r == 12 else 0)
            y += {(4, 20): 400, (4, 21): 300, (0, 30): 250, (35, 30): 240, (20, 5): 500}.get((a, r), 0)
            rows.append((1, a, -180.0 + 10 * a, r, 1 + 0.05 * r, y))
    df = spark.createDataFrame(rows, "frame long, abin int, azim double, rbin int, radial double, y double")
    got = spots.detect_spots(df, n_azim=36, bin_a=10.0, bin_r=0.05).toPandas()
    # the ring is removed, the seam joins, the single hot pixel is too small
    assert len(got) == 2 and sorted(np.round(got["q"], 1)) == [2.0, 2.5]


def test_screening_equals_a_plain_loop(spark):
    rng = np.random.default_rng(11)
    rows = [(f"{i:03d}.cif", "AB", int(rng.integers(1, 3)), float(np.round(100 * 1.003 ** rng.integers(0, 30), 4)), int(rng.integers(150, 205))) for i in range(120)]
    kept: dict = {}
    want = {}
    for f, fo, sg, v, n in sorted(rows):
        if n > 200:
            want[f] = "too_big"
            continue
        prior = kept.setdefault((fo, sg), [])
        if any(abs(v - k) <= 0.005 * max(v, k) for k in prior):
            want[f] = "duplicate"
        else:
            prior.append(v)
            want[f] = None
    df = spark.createDataFrame(rows, "file string, formula string, spacegroup int, volume double, n_sites int")
    assert {r.file: r.reason for r in corpus.screen(df).collect()} == want


def test_auc_counts_ties_half(spark):
    df = frame(spark, [(1, 0.9), (1, 0.5), (0, 0.5), (0, 0.1)], "y int, s double")
    assert ranking.roc_auc(df, "y", "s").first().auc == pytest.approx((2 + 1 + 0.5) / 4)


def test_elapsed_seconds(spark):
    df = frame(spark, [(0, "2024-01-01T00:00:10"), (1, "bad"), (2, "2024-01-01T00:00:00")], "frame int, stamp string")
    got = [r.elapsed for r in meta.elapsed_seconds(df, "stamp").orderBy("frame").collect()]
    assert got == [10.0, None, 0.0]


def test_null_group_keys_lose_no_rows(spark):
    from braggline.operators import joins, ordered
    rows = spark.createDataFrame([(None, 1.0), (None, 5.0), (1, 2.0), (1, 9.0), (None, 12.0)], "g int, v double")
    top = ordered.with_running_max_before(rows, ["g"], ["v"], "v", 4.0, "v", "m").collect()
    assert sorted((r.g or 0, r.v, r.m or 0) for r in top) == [(0, 1.0, 0), (0, 5.0, 1.0), (0, 12.0, 5.0), (1, 2.0, 0), (1, 9.0, 2.0)]
    total = ordered.with_running_sum(rows, ["g"], ["v"], "v", 4.0, F.col("v"), "s").collect()
    assert sorted((r.g or 0, r.s) for r in total) == [(0, 1.0), (0, 6.0), (0, 18.0), (1, 2.0), (1, 11.0)]
    near = joins.nearest_join(rows, rows.withColumnRenamed("v", "w"), ["g"], "v", "w", 2.0).collect()
    assert len(near) == 5 and all(r.gap == 0 for r in near)


def test_matching_with_wide_errors_uses_every_peak_once(spark):
    lines = spark.createDataFrame([(1, "p", i, d) for i, d in enumerate((2.0, 2.35, 2.7, 3.05))], "frame int, phase string, line int, pred_d double")
    seen = spark.createDataFrame([(1, "o0", 2.18, 0.3), (1, "o1", 2.52, 0.3)], "frame int, obs string, d double, d_err double")
    assert sorted((r.line, r.obs) for r in idn.match_one_to_one(lines, seen, 0.01).collect()) == [(1, "o0"), (2, "o1")]


def test_tied_histograms_are_told(spark):
    from braggline.operators import refinement
    histograms = spark.createDataFrame([("alphabeta gammadelta", 1.0, {"A": 0.5}), ("frame 7", 2.0, {"A": 1.0})], "name string, rwp double, phases map<string,double>")
    groups = spark.createDataFrame([(1, "alphabeta", []), (2, "gammadelt", [])], "group_id int, label string, patterns array<string>")
    members = spark.createDataFrame([(1, 10), (2, 20)], "group_id int, frame long")
    got = sorted((r.name, r.frame, r.ambiguous) for r in refinement.frame_results(histograms, groups, members).collect())
    assert got == [("alphabeta gammadelta", None, True), ("frame 7", 7, False)]


def test_exact_quantiles_above_the_sketch_size(spark):
    from braggline.operators import ordered
    values = np.random.default_rng(3).gamma(2.0, size=4000)
    frame = spark.createDataFrame([(int(i % 2), float(v)) for i, v in enumerate(values)], "g int, v double")
    got = {r.g: (r.q0, r.q1) for r in ordered.exact_quantiles(frame, "v", [0.1, 0.95], ["g"], accuracy=200).collect()}
    for g in (0, 1):
        assert np.allclose(got[g], np.quantile(values[g::2], [0.1, 0.95]))


def test_unknown_lines_become_clusters(spark):
    rng = np.random.default_rng(6)
    rows = []
    for first, centers in ((0, (2.0, 2.6)), (5, (3.1, 4.0))):  # two pairs seen together, ten frames each
        rows += [(7, f"{c}-{p}", p, float(p), c + 0.002 * p, 10.0, 0.05) for c in centers for p in range(first, first + 10)]
    rows += [(7, f"noise{i}", int(p), float(p), float(c), 1.0, 0.05) for i, (p, c) in enumerate(zip(rng.integers(0, 15, 3), (5.0, 5.5, 6.0)))]
    frame = spark.createDataFrame(rows, "series long, obs string, position long, axis double, center double, amplitude double, fwhm double")
    diagram, summary, marks = tracks.unknown_series(frame, ["series"], 2 * math.pi / F.col("center"), min_points=3)
    got = sorted((r.n_tracks, r.n_obs, r.first_position, r.last_position) for r in summary.collect())
    assert got == [(2, 20, 0, 9), (2, 20, 5, 14)]
    assert diagram.count() == 40 and marks.count() == 4


def test_residual_step_leaves_unexplained_peaks(spark):
    axis_values = [1.0 + 0.01 * i for i in range(400)]
    x = np.array(axis_values)

    def shape(c, a):
        return a * (0.5 / (1 + (2 * (x - c) / 0.1) ** 2) + 0.5 * np.exp(-math.log(2) * (2 * (x - c) / 0.1) ** 2))

    y = shape(2.0, 100.0) + shape(3.5, 60.0)
    patterns = spark.createDataFrame([(1, (y + np.random.default_rng(1).normal(0, 0.2, x.size)).tolist())], "frame long, clean array<double>")
    peaks = spark.createDataFrame([(1, "a", 2 * math.pi / 2.0, 2.0, 100.0, 0.1, 0.5), (1, "b", 2 * math.pi / 3.5, 3.5, 60.0, 0.1, 0.5)],
                                  "frame long, obs string, d double, center double, amplitude double, fwhm double, eta double")
    lines = spark.createDataFrame([(1, "p", 0, 2 * math.pi / 2.001, 0), (1, "absent", 0, 2 * math.pi / 3.501, 1)], "frame long, phase string, line int, pred_d double, phase_rank int")
    found = spark.createDataFrame([(1, "p", 0.9, 3), (1, "absent", 0.1, 3)], "frame long, phase string, confidence double, n_matched int")
    told, rest = idn.residual_step(patterns, "clean", peaks, lines, found, axis_values, min_snr=10.0)
    assert {r.obs: r.phase for r in told.collect()} == {"a": "p", "b": None}
    left = [r.center for r in rest.where("flag = 0").collect()]
    assert len(left) == 1 and abs(left[0] - 3.5) < 0.01


def test_seeds_follow_the_slope():
    from braggline.operators.peaks import predicted_seeds
    history = [(0.0, np.array([1.0, 2.0]), np.array([0.1, 0.1])), (1.0, np.array([1.02, 2.5, 3.0]), np.array([0.1, 0.1, 0.1]))]
    assert np.allclose(predicted_seeds(history, 2.0), [1.04, 2.5, 3.0])
    assert np.allclose(predicted_seeds(history, 50.0), [1.12, 2.5, 3.0])
    assert predicted_seeds(history[:1], 9.0) == [1.0, 2.0]


def test_fit_run_applies_preset_and_range(spark):
    from braggline.operators import peaks as pk
    x = np.linspace(1, 5, 400)
    y = 50 * np.exp(-(x - 1) / 0.05) + 80 * np.exp(-math.log(2) * (2 * (x - 3) / 0.1) ** 2) + np.random.default_rng(0).normal(0, 0.3, 400)
    frame = spark.createDataFrame([(i, y.tolist()) for i in range(3)], "frame long, clean array<double>")
    rows = pk.fit_run(frame, "clean", x.tolist(), "conservative").where("flag = 0").collect()
    assert {r.frame for r in rows} == {0, 1, 2} and all(abs(r.center - 3) < 0.01 for r in rows)
    assert pk.fit_run(frame, "clean", x.tolist(), fit_range=(3.5, 4.5)).where("flag = 0").count() == 0
