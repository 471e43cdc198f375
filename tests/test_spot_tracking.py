"""Spot tracking of a run on planted crystals, and its parts against plain loops."""

import math

import numpy as np
import pytest

from braggline.operators import spot_tracking as st, spots

CAKE = "frame long, abin int, azim double, rbin int, radial double, y double"
FRAMES = "frame long, pressure double, group string, excluded boolean"
PEAKS = "frame long, center double, fwhm double, phase string"
SHAPE = dict(n_azim=36, bin_a=10.0, bin_r=0.02)


def cake_rows(frame, planted, n_bins=100):
    """One cake of noise with blobs of two by two cells at (azimuth bin, radial bin, height)."""
    rng = np.random.default_rng(frame)
    y = 100 + rng.normal(0, 1, (36, n_bins))
    for a, r, h in planted:
        for da, dr, part in ((0, 0, 1.0), (1, 0, 0.8), (0, 1, 0.7), (1, 1, 0.5)):
            y[(a + da) % 36, r + dr] += h * part
    return [(frame, a, -180.0 + 10 * a, r, 1 + 0.02 * r, float(y[a, r])) for a in range(36) for r in range(n_bins)]


@pytest.fixture(scope="module")
def planted(spark):
    """Six pressures of two frames; crystal A moves one bin a step, B sits on a ring, C is seen twice only."""
    cakes, frames = [], []
    for step in range(6):
        for k in (0, 1):
            frame = 2 * step + k
            blobs = [(4, 20 + step, 400 + k), (20, 60, 300)]
            if step in (0, 5):
                blobs.append((30, 80 + (step > 0), 200))
            cakes += cake_rows(frame, blobs)
            frames.append((frame, 2.0 * step, None, False))
    # A frame without a pressure, an excluded one, and one that has no cake.
    cakes += cake_rows(50, [(4, 20, 400)]) + cake_rows(51, [(4, 20, 900)])
    frames += [(50, None, None, False), (51, 0.0, None, True), (52, 4.0, None, None)]
    # The ring is attributed in one frame of each pressure only.
    peaks = [(2 * step, 2.205, 0.02, "W") for step in range(6)] + [(50, 1.41, 0.02, ""), (2, None, 0.1, "W"), (77, 1.4, 0.5, "W")]
    return (spark.createDataFrame(cakes, CAKE), spark.createDataFrame(frames, FRAMES), spark.createDataFrame(peaks, PEAKS))


@pytest.fixture(scope="module")
def tables(planted):
    return st.track_spots(*planted, **SHAPE)


def test_planted_crystals_become_tracks(tables):
    tracks = tables.tracks.toPandas()
    assert len(tracks) == 1
    t = tracks.iloc[0]
    assert (t["group"], t.n_points, t.n_frames, t.n_obs, t.p_min, t.p_max) == ("", 6, 12, 12, 0.0, 10.0)
    points = tables.points.toPandas()
    mine = points[points["track"] == t["track"]].sort_values("position")
    assert list(mine["position"]) == list(range(6)) and list(mine["n_frames"]) == [2] * 6
    assert t.d0 == pytest.approx(2 * math.pi / mine["q"].iloc[0]) and t.q_last == mine["q"].iloc[-1]
    assert t.dd_dp == pytest.approx(np.polyfit(mine["pressure"], mine["d"], 1)[0])
    w, off = mine["intensity"], (mine["azim"] - t.azim + 180) % 360 - 180
    assert t.azim_spread == pytest.approx(math.sqrt((w * off ** 2).sum() / w.sum()), abs=1e-9)
    assert t.best_frame == mine.loc[mine["intensity"].idxmax(), "best_frame"]
    free = st.untracked(tables.points).toPandas()
    assert sorted(free["position"]) == [0, 5] and (free["q"] > 2.5).all()


def test_detections_know_ring_point_and_track(tables):
    rows = tables.detections.toPandas()
    assert rows["id"].is_unique and 51 not in set(rows["frame"])
    # B lies on the ring in every frame of its pressure, attributed there or not.
    ring = rows[rows["on_ring"]]
    assert sorted(ring["frame"]) == list(range(12)) and ring["point"].isna().all() and ring["track"].isna().all()
    lone = rows[rows["frame"] == 50]
    assert len(lone) == 1 and lone["position"].isna().all() and lone["point"].isna().all()
    assert rows["track"].notna().sum() == 12 and rows["point"].notna().sum() == 16
    groups = tables.groups.toPandas()
    assert [tuple(r) for r in groups[["n_frames", "n_obs", "n_tracks"]].to_numpy()] == [(15, len(rows), 1)]


def test_tables_are_stored_and_read_back(spark, tables, tmp_path):
    st.save_spot_tables(tables, str(tmp_path / "run"))
    back = st.load_spot_tables(spark, str(tmp_path / "run"))
    for name in ("detections", "points", "tracks", "groups"):
        assert sorted(map(str, getattr(back, name).select(*getattr(tables, name).columns).collect())) == sorted(map(str, getattr(tables, name).collect()))
    long = st.load_spot_tables(spark, str(tmp_path / "run"), min_points=7)
    assert long.tracks.count() == 0 and long.points.where("track is not null").count() == 0 and long.points.count() == 8


def test_tracks_meet_calculated_lines(spark, tables):
    d0 = tables.tracks.first().d0
    lines = spark.createDataFrame([("X", 1, d0 * 1.02, 10.0), ("X", 2, d0 * 0.995, 1.0), ("Y", 1, d0 * 1.2, 99.0)], "phase string, ord long, d double, w double")
    row = st.label_tracks(tables.tracks, lines).first()
    assert (row.line_phase, row.line_ord) == ("X", 2) and row.delta_rel == pytest.approx(1 / 0.995 - 1)
    assert st.label_tracks(tables.tracks, lines.where("phase = 'Y'")).first().line_phase is None


def test_frames_as_the_ladder_and_no_rings(planted):
    cakes, frames, _ = planted
    got = st.track_spots(cakes, frames, None, ladder="frame", **SHAPE)
    # Every frame is a point of its own, so B is a track now, and the frame without pressure has a place.
    points = got.points.toPandas()
    assert points["pressure"].isna().all() and points["position"].max() == 12 and not got.detections.where("on_ring").count()
    tracks = got.tracks.toPandas().sort_values("q_first")
    assert list(tracks["n_points"]) == [12, 12] and tracks["dd_dp"].isna().all()
    with pytest.raises(ValueError, match="ladder"):
        st.track_spots(cakes, frames, ladder="time", **SHAPE)


def test_empty_cakes_give_empty_tables(planted):
    cakes, frames, peaks = planted
    got = st.track_spots(cakes.where("false"), frames, peaks, **SHAPE)
    assert [t.count() for t in (got.detections, got.points, got.tracks)] == [0, 0, 0]
    row = got.groups.first()
    assert (row.n_frames, row.n_obs, row.n_tracks) == (15, 0, 0)


def test_ring_windows_equal_a_plain_union(spark):
    rng = np.random.default_rng(4)
    peaks = [(int(f), float(c), float(w), "A" if rng.random() < 0.9 else "") for f, c, w in zip(rng.integers(0, 30, 600), rng.uniform(1, 9, 600), rng.uniform(0, 0.05, 600))]
    # A third of all rows share one pressure.
    pressure = {f: None if f < 5 else 3.0 if f < 15 else f / 10 for f in range(30)}
    frames = spark.createDataFrame([(f, p) for f, p in pressure.items()], "frame long, pressure double")
    got = {}
    for r in st.ring_windows(spark.createDataFrame(peaks, PEAKS), frames, bin_r=0.03).collect():
        got.setdefault(r.place, []).append((r.low, r.high))
    want = {}
    for f, c, w, phase in peaks:
        if phase:
            want.setdefault(f"f{f}" if pressure[f] is None else f"p{pressure[f]}", []).append((c - max(2 * w, 0.03), c + max(2 * w, 0.03)))
    for place, parts in want.items():
        union = []
        for low, high in sorted(parts):
            if union and low <= union[-1][1]:
                union[-1][1] = max(union[-1][1], high)
            else:
                union.append([low, high])
        np.testing.assert_allclose(sorted(got[place]), union)
    assert set(got) == set(want)


def test_spreads_are_taken_about_the_centroid(spark):
    rows = [("g", 1, 1, "a", 1e4 + 1e-4, 179.0, 2.0, 1.0, "a"), ("g", 1, 2, "b", 1e4 - 1e-4, -179.0, 2.0, 1.0, "a")]
    df = spark.createDataFrame(rows, "group string, position long, frame long, id string, q double, azim double, intensity double, area double, merged string")
    row = spots.merged_spots(df, ["group", "position"]).first()
    assert row.q_width == pytest.approx(1e-4, rel=1e-4) and row.azim_width == pytest.approx(1.0) and abs(abs(row.azim) - 180) < 1e-9
    assert (row.best_frame, row.n_frames) == (1, 2)
