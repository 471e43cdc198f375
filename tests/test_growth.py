"""Plans and packed forms that keep a query's memory and shuffle in step with its input."""

import pytest

import __spark_entry__ as entry

FOLDER = "/root/testdata/sf0.001"
QUERIES = entry.queries()


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["refinement_frames", "refinement_phases", "refinement_checks"])
def test_names_and_groups_are_not_broadcast(spark, name):
    assert "Broadcast" not in plan(QUERIES[name](spark, FOLDER))


def test_groups_of_names(spark):
    from braggline.operators import refinement
    histograms = spark.createDataFrame([("run alpha-12",), ("alpha-1",), ("beta one",), ("frame 7",), ("x",), (None,)], "name string")
    groups = spark.createDataFrame([(1, "alpha-1", None), (2, "alpha-12", None), (3, "beta", ["d/beta.xy"]), (4, "beta", None)],
                                   "group_id long, label string, patterns array<string>")
    members = spark.createDataFrame([(1, 10), (2, 20), (2, 21), (3, 30)], "group_id long, frame long")
    got = sorted(((r.name, r.frame, r.group_size, r.ambiguous) for r in refinement.frame_results(histograms, groups, members).collect()), key=repr)
    assert got == [("alpha-1", 10, 1, False), ("beta one", None, None, True), ("frame 7", 7, 1, False), ("run alpha-12", 20, 2, False), ("run alpha-12", 21, 2, False)]
    empty = refinement.frame_results(histograms, groups.limit(0), members)
    assert [(r.name, r.frame) for r in empty.collect()] == [("frame 7", 7)]


def test_lines_alike_on_all_frames_are_not_copied_to_them(spark):
    from pyspark.sql import functions as F
    from braggline.operators import identify as idn
    seen = spark.range(400).select(
        (F.col("id") % 40).alias("frame"), F.concat(F.lit("o"), "id").alias("obs"), (1 + F.rand(1) * 1.5).alias("d"),
        F.when(F.col("id") % 7 != 0, F.rand(2) * 0.03).alias("d_err"), (F.rand(3) * 9).alias("amplitude")).localCheckpoint()
    lines = spark.range(60).select(F.concat(F.lit("p"), F.col("id") % 3).alias("phase"), F.col("id").alias("line"), (0.8 + F.col("id") * 0.03).alias("pred_d"),
                                   (0.1 + F.rand(4)).alias("w"))
    lines = lines.withColumn("phase_rank", F.when(F.col("phase") == "p1", 0).otherwise(1)).localCheckpoint()
    present = spark.range(90).select((F.col("id") % 45).alias("frame"), F.concat(F.lit("p"), (F.col("id") * 5 % 7) % 4).alias("phase"))
    own = present.distinct().join(lines, "phase")
    narrow = lambda rows, *more: rows.select(*[c for c in ("frame", "phase") if c in rows.columns], "line", "pred_d", *more)

    def same(packed, long):
        order = sorted(long.columns)
        rounded = lambda df: sorted((tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.select(*order).collect()), key=repr)
        got = rounded(packed)
        assert got and got == rounded(long)
    plain = seen.drop("amplitude")
    same(idn.band_candidates(narrow(lines), plain, 0.01, present=present), idn.band_candidates(narrow(own), plain, 0.01))
    same(idn.match_one_to_one(narrow(lines), plain, 0.01, present), idn.match_one_to_one(narrow(own), plain, 0.01))
    same(idn.attribute_peaks(seen.select("frame", "obs", "d"), narrow(lines, "phase_rank"), 0.01, present),
         idn.attribute_peaks(seen.select("frame", "obs", "d"), narrow(own, "phase_rank"), 0.01))
    same(idn.evidence(narrow(lines, "w"), seen, 0.01, present), idn.evidence(narrow(own, "w"), seen, 0.01))


def test_anchors_are_correlated_in_blocks(spark, monkeypatch):
    import numpy as np
    from braggline.operators import correlations as co
    monkeypatch.setattr(co, "BLOCK_FRAMES", 4, raising=False)
    rng = np.random.default_rng(3)
    made = {(w, f): rng.normal(size=5).tolist() for w in (0, 1) for f in range(11)}
    made[0, 2], made[1, 3] = None, [1.0] * 5
    rows = spark.createDataFrame([(w, f, v) for (w, f), v in made.items()], "window int, frame long, profile array<double>")
    out = co.anchor_correlations(rows, rows.where("frame % 5 = 0").select("frame"))
    assert "CoGroup" in plan(out)
    got = {(r.window, r.anchor, r.frame): r.direct for r in out.collect()}
    assert set(got) == {(w, a, f) for w in (0, 1) for a in (0, 5, 10) for f in range(11) if f != a}
    for (w, a, f), value in got.items():
        void = made[w, f] is None or (w, f) == (1, 3)
        assert value is None if void else value == pytest.approx(np.corrcoef(made[w, a], made[w, f])[0, 1], abs=1e-12)


def test_pressure_search_takes_blocks_of_pairs_on_all_cores(spark, monkeypatch):
    import numpy as np
    from braggline.operators import identify as idn
    monkeypatch.setattr(idn, "BLOCK_VALUES", 12, raising=False)
    rng = np.random.default_rng(5)
    curve, weight = np.array([1.0, 1.3, 1.7])[:, None] * (1 - 0.004 * np.arange(11)), np.array([1.0, 0.7, 0.4])
    curves = spark.createDataFrame([("a", float(w), c.tolist()) for w, c in zip(weight, curve)], "phase string, w double, curve array<double>")
    seen = {f: np.sort(rng.uniform(0.9, 1.8, 1 + f % 4)) for f in range(30)}
    observed = spark.createDataFrame([(f, float(d), 0.002 if d > 1.4 else None) for f, row in seen.items() for d in row], "frame long, d double, d_err double")
    pairs = spark.createDataFrame([(f, "a", 2.0, 2.0 if f % 5 == 0 else 2.0 + f / 4, 1.0 + f * 1e-4) for f in seen], "frame long, phase string, low double, high double, thermal double")
    out = idn.fit_pressures(pairs, observed, curves, 0.004, 0.0, 1.0, 30)
    assert out.rdd.getNumPartitions() > 1

    def plain(f, p):
        at = min(int(p), 9)
        pred = (curve[:, at] + (p - at) * (curve[:, at + 1] - curve[:, at])) * (1.0 + f * 1e-4)
        near = [min(seen[f], key=lambda d: (abs(d - x), d)) for x in pred]
        return sum(w * np.exp(-0.5 * ((x - d) / np.hypot(0.004 * x, 0.002 if d > 1.4 else 0.0)) ** 2) for w, x, d in zip(weight, pred, near))
    got = {r.frame: r.p for r in out.collect()}
    assert set(got) == set(seen)
    for f, p in got.items():
        high = 2.0 if f % 5 == 0 else 2.0 + f / 4
        assert 2.0 <= p <= high
        assert plain(f, p) >= max(plain(f, q) for q in np.linspace(2.0, high, 30)) - 1e-12


def test_cakes_of_a_batch_are_taken_together(spark, monkeypatch):
    import numpy as np
    from braggline.operators import spots as sp
    rng = np.random.default_rng(8)
    rows = [(f, int(a), -180.0 + 10 * int(a), int(r), 1 + 0.05 * int(r), float(rng.uniform(50, 60) + (500 if rng.random() < 0.12 else 0)))
            for f in range(40) for a in range(36) for r in range(12)]
    cakes = spark.createDataFrame(rows, "frame long, abin int, azim double, rbin int, radial double, y double")
    options = dict(min_snr=6.0, min_intensity=20.0, min_samples=12)
    found = sp.blob_spots(cakes, n_azim=36, bin_a=10.0, bin_r=0.05, max_azim=60.0, max_radial=6, **options)
    assert found.rdd.getNumPartitions() > 1 and "MapInPandas" in plan(found)
    got = {}
    for r in found.collect():
        got.setdefault(r.frame, []).append((r.spot, r.n_pixels, round(r.area, 6), round(r.intensity, 6)))
    bright = {}
    for r in sp.bright_cells(cakes, **options).collect():
        bright.setdefault(r.frame, {})[r.abin, r.rbin] = r.excess
    for frame, cells in bright.items():
        left, want = dict(cells), []
        while left:
            todo = [min(left)]
            blob = {todo[0]: left.pop(todo[0])}
            while todo:
                a, r = todo.pop()
                for other in [((a + i) % 36, r + j) for i in (-1, 0, 1) for j in (-1, 0, 1)]:
                    if other in left:
                        blob[other] = left.pop(other)
                        todo.append(other)
            top = max(blob, key=lambda c: (blob[c], [-x for x in c]))
            turns = [(a - top[0] + 18) % 36 - 18 for a, _ in blob]
            rings = [r for _, r in blob]
            if len(blob) > 1 and max(rings) - min(rings) < 6 and 10 * (max(turns) - min(turns)) + 10 <= 60:
                want.append((len(blob), round(sum(blob.values()), 6), round(max(blob.values()), 6)))
        assert sorted(got.get(frame, [])) == [(i, *w) for i, w in enumerate(sorted(want, key=lambda w: -w[2]))]


def test_augmented_patterns_are_spread_whatever_their_phase(spark):
    import numpy as np
    from braggline.operators import simulate as sm
    grid = np.linspace(1.5, 3.0, 40)
    shapes = {"a": ([1.6, 2.2, 2.9], [1.0, 0.5, 0.2]), "b": ([1.8, 2.5], [0.3, 1.0])}
    samples = spark.createDataFrame([(i, "b" if i % 50 == 0 else "c" if i == 7 else "a") for i in range(200)], "id long, phase string")
    lines = spark.createDataFrame([(p, c, w) for p, (c, w) in shapes.items()], "phase string, centers array<double>, weights array<double>")
    out = sm.augmented_patterns(samples, lines, grid, seed=3)
    assert out.rdd.getNumPartitions() > 1
    got = {r.id: (r.phase, r.pattern) for r in out.collect()}
    assert set(got) == set(range(200)) - {7}
    for i, (phase, pattern) in got.items():
        centers, weights = (np.asarray(v) for v in shapes[phase])
        assert pattern == sm.augmented(np.random.default_rng([3, i]), grid, centers, weights, sm.Augment()).tolist()


def test_nearest_line_orders_places_not_peaks(spark, monkeypatch):
    from braggline.operators import joins
    given = []
    real = joins.nearest_join
    monkeypatch.setattr(joins, "nearest_join", lambda left, *rest, **more: given.append(left) or real(left, *rest, **more))
    QUERIES["nearest_line"](spark, FOLDER)
    assert given[0].columns == ["phase", "d"] and given[0].count() == given[0].distinct().count()


def test_containers_are_spread_before_their_frames_are_listed(spark):
    from pyspark.sql import functions as F
    from braggline.operators import metadata as md
    files = spark.range(40).coalesce(1).select(F.concat(F.lit("f"), "id").alias("file"), F.lit("d").alias("dataset"), (F.col("id") % 4).alias("n_frames"))
    out = md.expand_sources(files)
    assert out.rdd.getNumPartitions() > 1
    assert sorted(r.source for r in out.collect()) == sorted(f"f{i}::d#{k:06d}" for i in range(40) for k in range(i % 4))


def test_windows_of_a_frame_meet_without_a_join(spark):
    assert "Join" not in plan(QUERIES["within_frame_acf"](spark, FOLDER))


def test_window_kernels_hold_few_rows_at_once():
    import numpy as np
    import pandas as pd
    from braggline.operators import background as bg
    from braggline.operators import correlations as co
    rows = pd.Series(list(np.random.default_rng(0).normal(size=(2 * bg.KERNEL_ROWS + 5, 12))))
    made = list(co.autocorrelation.func(iter([rows])))
    assert [len(part) for part in made] == [bg.KERNEL_ROWS, bg.KERNEL_ROWS, 5]
    both = list(co.pearson.func(iter([(rows, rows[::-1].reset_index(drop=True))])))
    assert [len(part) for part in both] == [bg.KERNEL_ROWS, bg.KERNEL_ROWS, 5]
    want = co.pearson_rows(np.stack(rows), np.stack(rows)[::-1])
    np.testing.assert_array_equal(pd.concat(both).to_numpy(float), want)


def test_roi_features_without_profiles(spark):
    from pyspark.sql import functions as F
    from braggline.operators import correlations as co
    assert "Window" not in plan(QUERIES["roi_features"](spark, FOLDER))
    axis = [1 + 0.05 * i for i in range(20)]
    values = F.transform(F.sequence(F.lit(1), F.when(F.col("id") % 5 == 0, 25).otherwise(20)), lambda i: F.when(
        (F.col("id") % 3 != 0) | (i % 7 != 0), F.sin(F.col("id") * i)))
    rows = spark.range(1300).select("id", (0.95 + F.col("id") % 37 * 0.03).alias("c"), (0.01 + F.col("id") % 11 * 0.02).alias("h"), F.when(F.col("id") % 101 != 0, values).alias("v"))
    args = [F.col("c"), F.col("h"), F.col("v"), axis]
    got = rows.select("id", co.roi_features(*args).alias("one"), co.roi_feature(co.roi_profiles(*args)).alias("two")).collect()
    assert len(got) == 1300 and any(r.one is None for r in got) and sum(r.one is not None for r in got) > 1000
    assert all(r.one == r.two for r in got)


@pytest.mark.parametrize("predict", [False, True])
def test_long_series_link_as_short_ones(spark, predict):
    from pyspark.sql import functions as F
    from braggline.operators import tracks
    rows = spark.range(900).select(
        F.concat(F.lit("o"), "id").alias("obs"), F.when(F.col("id") % 3 > 0, F.col("id") % 3).alias("series"), F.floor(F.rand(1) * 90 + F.floor(F.rand(2) * 3) * 200).alias("position"),
        (1 + F.rand(3) * 2).alias("center"), F.rand(4).alias("amplitude"), (0.02 + F.rand(5) * 0.05).alias("fwhm")).withColumn("axis", F.col("position").cast("double")).localCheckpoint()
    link = lambda n: sorted(tuple(r) for r in tracks.link_tracks(rows.where("series > 0"), ["series"], predict=predict, series_rows=n).collect())
    whole = link(10_000)
    assert whole and whole == link(0)
    # Short series are neither cut nor counted again after the linking; a null series is one of its own.
    linked = tracks.link_tracks(rows, ["series"], predict=predict)
    assert "Window" not in plan(linked) and "Join" not in plan(linked)
    counts = linked.groupBy("series", "track").count().collect()
    assert {r["series"] for r in counts} == {None, 1, 2} and min(r["count"] for r in counts) >= 3


@pytest.mark.parametrize("threshold", [0.3, 0.6, 0.8, 1.0])
def test_similar_sets_short_and_long(spark, threshold):
    import numpy as np
    from braggline.operators import tracks
    rng = np.random.default_rng(7)
    sets = {frozenset(rng.choice(11, rng.integers(1, 12), replace=False).tolist()) for _ in range(160)}
    named = {f"s{i:03d}": s for i, s in enumerate(sorted(sets, key=sorted))}
    got = tracks.similar_sets(spark.createDataFrame([(k, sorted(v)) for k, v in named.items()], "id string, items array<long>"), threshold)
    # Of two sets of one size the smaller id comes first, else the smaller set.
    want = {(a, b): len(x & y) / len(x | y) for a, x in named.items() for b, y in named.items()
            if (len(x), a) < (len(y), b) and len(x & y) / len(x | y) >= threshold}
    assert {(r.a, r.b): r.jaccard for r in got.collect()} == want


def test_short_sets_meet_on_pairs_of_items(spark):
    from braggline.operators import tracks
    sets = spark.createDataFrame([("a", [1, 2, 3]), ("b", [1, 2, 4])], "id string, items array<long>")
    assert "xxhash64" in plan(tracks.similar_sets(sets, 0.5)) and tracks.similar_sets(sets, 0.5).count() == 1


def test_location_matches_of_crowded_places(spark):
    import numpy as np
    from braggline.operators import correlations as co
    rng = np.random.default_rng(3)
    # One frame holds most peaks of a few places; others are rare.
    rows = [(f"p{i:04d}", int(rng.choice([1, 1, 1, 1, 2, 3, 4])), float(np.round(1 + rng.choice([0.0, 0.002, 0.003, 0.0041, 0.01, rng.uniform(0, 0.02)]), 4))) for i in range(300)]
    peaks = spark.createDataFrame(rows, "peak_id string, frame long, center double")
    few = co.few_places(peaks, 2).groupBy("center").count().collect()
    assert max(r["count"] for r in few) <= 4
    for top in (1, 2, 3):
        got = {(r.peak_id, r.rank): (r.frame, r.match_id, r.match_frame, round(r.gap, 12)) for r in co.top_location_matches(peaks, 0.004, top).collect()}
        want = {}
        for pid, frame, center in rows:
            near = sorted((abs(center - c), p, f) for p, f, c in rows if f != frame and abs(center - c) < 0.004)[:top]
            want |= {(pid, k + 1): (frame, p, f, round(g, 12)) for k, (g, p, f) in enumerate(near)}
        assert got == want


def test_tasks_of_candidates_grow_with_the_peaks(spark, monkeypatch):
    from braggline.operators import identify as idn
    from braggline.plans import identification as plans
    folder = FOLDER.replace("0.001", "0.01")
    rows = lambda df: sorted(tuple(r) for r in df.collect())
    want = rows(QUERIES["identification_candidates"](spark, folder))
    peaks = plans.observed_peaks(spark, folder).count()
    monkeypatch.setattr(idn, "PIECE_PEAKS", peaks // 19)
    many = QUERIES["identification_candidates"](spark, folder)
    assert f", {-(-peaks // (peaks // 19))}), REPARTITION_BY_NUM" in plan(many)
    assert want and rows(many) == want


def frames_of_a_fading_line(n, seed):
    """A strong line that drifts, and one that falls below detection after six frames but stays fittable."""
    import numpy as np
    x, rng = np.linspace(1.0, 4.0, 90), np.random.default_rng(seed)
    shape = lambda c, a: a * np.exp(-np.log(2) * (2 * (x - c) / 0.2) ** 2)
    rows = [shape(2.0 + 0.002 * i, 30.0) + shape(3.2, 20.0 if i < 6 else 1.35) + rng.normal(0, 0.25, x.size) for i in range(n)]
    return x, [r.tolist() for r in rows]


def series_frame_by_frame(rows, x, predict, **knobs):
    """The plain loop: ``rows`` are (path, place, frame, pattern)."""
    import numpy as np
    from braggline.operators import peaks as pk
    now, history, out = None, [], set()
    for path, place, frame, y in sorted(rows, key=lambda r: (repr(r[0]), *r[1:])):
        if repr(path) != now:
            now, history = repr(path), []
        fits = pk.fit_row(x, np.array(y), seeds=pk.predicted_seeds(history if predict else history[-1:], place) if history else None, **knobs)
        good = np.array([(f["center"], f["fwhm"]) for f in fits if f["flag"] == 0]).reshape(-1, 2)
        history = [*history[-1:], (place, good[:, 0], good[:, 1])] if len(good) else history
        out |= {(frame, i, *f.values()) for i, f in enumerate(fits)}
    return out


@pytest.mark.parametrize("predict", [False, True])
def test_runs_of_a_series_meet_as_if_fitted_frame_by_frame(spark, monkeypatch, predict):
    x, faded = frames_of_a_fading_line(40, 1)
    rows = [("a", float(i // 2), 100 + i, y) for i, y in enumerate(faded)]
    rows += [(None, float(i), 200 + i, y) for i, y in enumerate(frames_of_a_fading_line(9, 2)[1])]
    rows += [(f"alone{i}", 1.0, 300 + i, y) for i, y in enumerate(faded[-4:])]
    want = series_frame_by_frame(rows, x, predict, min_snr=5.0)
    table = spark.createDataFrame(rows[::-1], "path string, place double, frame long, clean array<double>")
    from braggline.operators import peaks as pk
    # Runs that know nothing of what came before miss the faded line.
    cold = {r[:2] for y in [faded[30]] for r in series_frame_by_frame([("a", 0.0, 130, y)], x, predict, min_snr=5.0)}
    assert cold < {r[:2] for r in want if r[0] == 130}
    dealt = type(table).repartitionById
    for run_frames, share in ((3, 1), (4, 3), (1000, 1)):
        # A task may be dealt several blocks.
        monkeypatch.setattr(type(table), "repartitionById", lambda df, n, key, share=share: dealt(df, -(-n // share), key))
        got = pk.fit_series(table, "clean", x.tolist(), "path", ["place"], predict, run_frames=run_frames, min_snr=5.0)
        assert {tuple(r) for r in got.collect()} == want


def test_one_long_path_is_fitted_in_many_tasks(spark):
    from pyspark.sql import functions as F
    from braggline.operators import peaks as pk
    x, rows = frames_of_a_fading_line(1100, 3)
    table = spark.createDataFrame([("a", i, y) for i, y in enumerate(rows)], "path string, frame long, clean array<double>")
    got = pk.fit_series(table, "clean", x.tolist(), "path", ["frame"], min_snr=8.0)
    assert got.groupBy(F.spark_partition_id()).count().count() > 1


def test_series_without_frames(spark):
    from braggline.operators import peaks as pk
    table = spark.createDataFrame([], "path string, frame long, clean array<double>")
    got = pk.fit_series(table, "clean", [1.0, 2.0, 3.0], "path", ["frame"])
    assert got.collect() == [] and got.columns[:3] == ["frame", "peak", "center"]


def test_roi_tracks_take_every_good_peak(spark, monkeypatch):
    from braggline.operators import roi_tracks
    from braggline.sources.tables import view
    given = []
    monkeypatch.setattr(roi_tracks, "build_tracks", lambda peaks, *rest, **more: given.append(peaks) or peaks)
    QUERIES["build_roi_tracks"](spark, FOLDER)
    good = view(spark, FOLDER, "pattern_peaks").where("flag = 0 and center between 1.0 and 4.15")
    assert given[0].count() == good.count() > 0


@pytest.mark.parametrize("scored", [1, 7, 512])
def test_crowded_positions_link_as_sparse_ones(monkeypatch, scored):
    import numpy as np
    from braggline.operators import roi_tracks, tracks
    rng, axis = np.random.default_rng(4), np.linspace(1.0, 4.0, 40)
    frames = []
    for f in range(5):
        profile = rng.normal(size=axis.size)
        profile[rng.integers(0, axis.size, f)] = np.nan
        frames.append([{"obs": f"{f}-{i}", "center": float(np.round(rng.uniform(1, 4), 2)), "fwhm": float(rng.choice([0.05, 0.1])), "half_width": 0.1, "profile": profile} for i in range(50)])
    alike = roi_tracks.mutual_similarity(axis, 0.2)

    def linked(few):
        monkeypatch.setattr(tracks, "FEW_PAIRS", few)
        monkeypatch.setattr(tracks, "SCORED_PAIRS", scored)
        linker = tracks.Linker(1.5, 1, None, False, alike, 0.2)
        return [linker.advance(f, float(f), rows) for f, rows in enumerate(frames)]
    whole = linked(10**9)
    assert whole == linked(0)
    assert sum(t != r["obs"] for ids, rows in zip(whole, frames) for t, r in zip(ids, rows)) > 20


def test_attached_rows_are_sent_once_to_their_position(spark):
    from pyspark.sql import functions as F
    from braggline.operators import tracks
    rows = spark.range(60).select(F.concat(F.lit("o"), "id").alias("obs"), F.when(F.col("id") % 2 == 0, 1).alias("series"), F.floor(F.col("id") / 12).alias("position"),
                                  (F.col("id") % 12).cast("double").alias("center"), F.lit(1.0).alias("amplitude"), F.lit(0.1).alias("fwhm"))
    rows = rows.withColumn("axis", F.col("position").cast("double"))
    notes = spark.createDataFrame([(p, [float(p)]) for p in (0, 1, 2, 4)], "position long, note array<double>")

    def alike(before, now):
        assert all(r["note"][0] == r["position"] for r in [*before, *now])
        return lambda i, j: i * 0 + 1.0
    linked = tracks.link_tracks(rows, ["series"], similarity=alike, min_similarity=0.5, attached=notes).collect()
    # Position 3 has no note; the others make twelve tracks of four points.
    assert len(linked) == 48 and {r.position for r in linked} == {0, 1, 2, 4} and len({r.track for r in linked}) == 12


def test_roi_similarities_of_many_pairs(spark):
    import numpy as np
    from braggline.operators import correlations as co
    axis, rng = np.linspace(1.0, 4.0, 40), np.random.default_rng(6)
    rows = {f: [rng.normal(size=40) + 1 for _ in range(1 + f % 2)] for f in range(6)}
    rows[3][0][17] = np.nan
    listed = [[None if np.isnan(v) else float(v) for v in r] for r in rows[3]]
    made = [(i, f, float(rng.uniform(1, 4)), float(rng.uniform(0.05, 0.4)), 1, float(rng.uniform(1, 4)), float(rng.uniform(0.05, 0.4)), len(rows[f]),
             [*listed, None] if f == 3 else [r.tolist() for r in rows[f]]) for i in range(90) for f in [int(rng.integers(0, 6))]]
    pairs = spark.createDataFrame(made, "id int, frame int, center_a double, half_a double, of_a int, center_b double, half_b double, of_b int, rows array<array<double>>")
    got = {r.id: r for r in co.roi_similarity(pairs, axis).collect()}
    for i, f, ca, ha, a, cb, hb, b, _ in made:
        one, two = rows[f][a - 1], rows[f][b - 1]
        want = [co.directional_iou(axis, p, q, (c - h, c + h), (d - g, d + g)) for p, q, c, h, d, g in ((one, two, ca, ha, cb, hb), (two, one, cb, hb, ca, ha))]
        for value, score in zip((got[i].forward, got[i].backward), want):
            assert value is None if np.isnan(score) else value == pytest.approx(score, abs=1e-12)
    assert any(r.mutual for r in got.values()) and any(r.forward is None for r in got.values())
    text = plan(QUERIES["roi_similarity"](spark, FOLDER))
    assert "prev_clean" not in text and "ArrowEvalPython" in text


@pytest.mark.parametrize("held", [0, 1000])
def test_scores_of_lines_held_in_tasks(spark, monkeypatch, held):
    import math
    from braggline.operators import identify as idn
    monkeypatch.setattr(idn, "HELD_LINES", held)
    lines = [("a", 1.0, 2.0), ("a", 1.5, 0.5), ("a", None, 3.0), ("b", 2.0, None), ("c", 1.2, 1.0), ("c", 1.4, None), (None, 1.0, 1.0)]
    many = {2: [1.0 + 0.013 * i for i in range(60)]}
    seen = {1: [1.01, 1.49], 3: [1.0, 1.0, 2.5], 4: []} | many
    named = {1: ["a", "b", "x"], 2: ["a", "c", "c"], 3: ["c"], 4: ["a"], 5: ["a"]}
    rows = [(f, d, None) for f, ds in seen.items() for d in ds] + [(f, None, p) for f, ps in named.items() for p in ps] + [(6, 1.0, None)]
    out = idn.nearest_score(spark.createDataFrame(lines, "phase string, pred_d double, w double"), spark.createDataFrame(rows, "frame long, d double, phase string"), 0.01)
    want = {}
    for f, phases in named.items():
        for p in set(phases):
            of = [(d, w) for q, d, w in lines if q == p]
            near = lambda d: 0.0 if d is None or not seen.get(f) else math.exp(-0.5 * (min(abs(d - o) for o in seen[f]) / (0.01 * d)) ** 2)  # noqa: E731, B023
            if of:
                want[f, p] = None if all(w is None for _, w in of) else pytest.approx(sum(w * near(d) for d, w in of if w is not None), abs=1e-12)
    assert {(r.frame, r.phase): r.score for r in out.collect()} == want
    assert ("MapInArrow" in plan(out)) == (held > 0)


@pytest.mark.parametrize("max_gap", [0, 2])
def test_paths_of_whole_series(spark, max_gap):
    from pyspark.sql import functions as F
    from braggline.operators import roi_tracks as rt
    rows = spark.range(700).select(
        F.concat(F.lit("o"), F.when(F.col("id") != 333, F.col("id")).otherwise(3)).alias("obs"), F.when((F.col("id") % 9 > 0) | (F.col("id") < 4), F.col("id") % 3).alias("series"), F.floor(F.rand(1) * 40).alias("frame"),
        F.round(1 + F.rand(2) * 2, 2).alias("center"), F.when(F.col("id") % 31 > 0, 0.02 + F.rand(3) * 0.05).alias("width"), (0.1 + F.round(F.rand(4), 1)).alias("feature"))
    rows = rows.withColumn("axis", F.col("frame").cast("double")).localCheckpoint()
    like = F.least("feature_a", "feature_b") / F.greatest("feature_a", "feature_b")

    def found(whole):
        placed = rt.ranked(rows, ["series"], "frame", whole)
        edges = rt.link_edges(placed, ["series"], like, max_gap=max_gap, min_similarity=0.3, whole=whole)
        points, kept, summary = rt.track_paths(placed, edges, ["series"], whole=whole)
        tell = lambda df, *names: sorted((tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.select(*names).collect()), key=repr)
        return (tell(points, "series", "track", "obs", "rank"), tell(kept, "series", "track", "obs_a", "obs_b", "silence", "similarity", "center_shift", "axis_gap"),
                tell(summary, *sorted(summary.columns)))
    got = found(True)
    assert all(len(part) > 10 for part in got) and got == found(False)


def test_paths_of_short_series_need_no_rounds(spark, monkeypatch):
    from braggline.operators import joins, roi_tracks as rt
    from braggline.plans import series
    rounds = []
    real = joins.greedy_pairs
    monkeypatch.setattr(rt, "greedy_pairs", lambda *a: rounds.append(1) or real(*a))
    want = sorted(tuple(r) for r in series.roi_track_summary(spark, FOLDER).collect())
    assert want and not rounds
    # Longer series, and those with nameless observations, are linked round by round.
    given = rt.by_length.__defaults__
    monkeypatch.setattr(rt.by_length, "__defaults__", (610,))
    mixed = sorted(tuple(r) for r in series.roi_track_summary(spark, FOLDER).collect())
    assert rounds and mixed == want and given != (610,)


def test_correlations_of_a_block_are_told_in_parts(spark, monkeypatch):
    import numpy as np
    from braggline.operators import correlations as co
    assert co.TOLD_FRAMES < co.BLOCK_FRAMES >= 2048
    rng = np.random.default_rng(9)
    made = {f: rng.normal(size=6 if f % 4 else 5).tolist() for f in range(70)}
    made[7] = None
    rows = spark.createDataFrame([(0, f, v) for f, v in made.items()], "window int, frame long, profile array<double>")
    got = {(r.anchor, r.frame): r.direct for r in co.anchor_correlations(rows, rows.where("frame in (7, 8, 9, 10)").select("frame")).collect()}
    assert set(got) == {(a, f) for a in (7, 8, 9, 10) for f in made if f != a}
    for (a, f), value in got.items():
        apart = made[a] is None or made[f] is None or len(made[a]) != len(made[f])
        assert value is None if apart else value == pytest.approx(np.corrcoef(made[a], made[f])[0, 1], abs=1e-12)
