"""Numeric kernels against plain loops and planted truth."""

import math

import numpy as np
import pytest

from braggline.functions import eos
from braggline.operators import background as bg
from braggline.operators import correlations as co
from braggline.operators import matching
from braggline.operators import peaks as pk
from braggline.operators import simulate as sm
from braggline.operators import spots as sp
from braggline.operators.texture import waviness_fit


def test_snip_equals_a_plain_loop():
    rng = np.random.default_rng(1)
    y = np.linspace(50, 20, 90) + 40 * np.exp(-0.5 * ((np.arange(90) - 30) / 3) ** 2) + rng.normal(0, 1, 90)
    work = y.copy()
    for m in range(1, 13):
        last = work.copy()
        for i in range(90):
            work[i] = min(last[i], (last[max(i - m, 0)] + last[min(i + m, 89)]) / 2)
    got = bg.clip_to_neighbours(np.stack([y, y[::-1]]), 12, 1)
    np.testing.assert_allclose(got[0], work)
    np.testing.assert_allclose(got[1], work[::-1])
    assert (got[0] <= y).all()


def test_bridge_fills_gaps_linearly():
    block = np.array([[0.0, np.nan, 2.0, 3.0], [np.nan] * 4])
    out = bg.bridge(block)
    np.testing.assert_allclose(out[0], [0, 1, 2, 3])
    assert np.isnan(out[1]).all()


@pytest.mark.parametrize("kind,kp,kpp", [("BM2", 4, 0), ("BM3", 4.6, 0), ("BM4", 4.2, -0.02), ("Vinet", 5, 0), ("Murnaghan", 4, 0)])
def test_eos_round_trip(kind, kp, kpp):
    r = np.linspace(0.75, 0.999, 40)
    p = eos._pressure_block(kind, 160.0, kp, kpp, r)
    np.testing.assert_allclose(eos.invert_block(kind, 160.0, kp, kpp, p), r, atol=1e-9)
    assert eos.invert_block(kind, 160.0, kp, kpp, np.array([0.0, -1.0])).tolist() == [1.0, 1.0]


def test_eos_takes_the_first_crossing():
    # A softening curve turns over; the branch next to ambient must be chosen.
    grid = 1 - 0.0025 * np.arange(1, 392)
    curve = eos._pressure_block("BM4", 100.0, 4.0, -0.5, grid)
    top = int(np.argmax(curve[:200]))
    target = 0.5 * curve[top]
    r = eos.invert_block("BM4", 100.0, 4.0, -0.5, np.array([target]))[0]
    assert r > grid[top]


def test_detect_recovers_planted_peaks_and_prominence():
    x = np.linspace(0, 10, 500)
    y = 100 * np.exp(-0.5 * ((x - 3) / 0.1) ** 2) + 60 * np.exp(-0.5 * ((x - 7) / 0.15) ** 2)
    y = y + np.random.default_rng(0).normal(0, 0.5, 500)
    found = pk.detect(x, y, min_snr=20)
    np.testing.assert_allclose(found[:, 0], [3, 7], atol=0.05)
    assert pk.local_maxima(np.array([0, 2, 2, 2, 0, 1, 0.0])).tolist() == [2, 5]
    assert pk.prominence(np.array([0, 5, 3, 4, 0.0]), np.array([1, 3])).tolist() == [5, 1]


@pytest.mark.parametrize("centers", [[5.0], [4.8, 5.3]])
def test_fit_recovers_planted_profiles(centers):
    x = np.linspace(0, 10, 400)
    y = 3 + 0.4 * x
    for c in centers:
        z = (2 * (x - c) / 0.3) ** 2
        y = y + 80 * (0.4 / (1 + z) + 0.6 * np.exp(-math.log(2) * z))
    rows = pk.fit_row(x, y + np.random.default_rng(2).normal(0, 0.3, 400), min_snr=15, min_prominence_snr=4)
    good = [r for r in rows if r["flag"] == 0]
    np.testing.assert_allclose([r["center"] for r in good], centers, atol=0.01)
    np.testing.assert_allclose([r["fwhm"] for r in good], 0.3, atol=0.03)
    np.testing.assert_allclose([r["amplitude"] for r in good], 80, rtol=0.05)


def test_large_groups_are_cut_at_the_widest_gap():
    centers = np.concatenate([np.arange(10), np.arange(15, 25)]).astype(float)
    parts = pk.split_large(centers, 12)
    assert [p.size for p in parts] == [10, 10]
    assert sorted(np.concatenate(parts)) == list(range(20))


def test_opening_removes_narrow_features():
    y = np.zeros(30)
    y[10], y[20:27] = 5, 3
    out = pk.opening(y, 5)
    assert out[10] == 0 and (out[20:27] == 3).all()


def test_directional_iou_contract():
    x = np.linspace(0, 10, 101)
    a = np.where((x > 3) & (x < 5), 1.0, 0.0)
    assert co.directional_iou(x, a, a, (3, 5), (3, 5)) == pytest.approx(1)
    assert co.directional_iou(x, a, a, (3, 5), (6, 8)) == 0
    assert math.isnan(co.directional_iou(x, a, a, (-1, 1), (3, 5)))
    gap = a.copy()
    gap[40] = np.nan
    assert math.isnan(co.directional_iou(x, gap, a, (3, 5), (3, 5)))
    # Two crossing lines on [0, 1]: min has area 1/4, max 3/4.
    line = np.array([0.0, 1.0])
    assert co.directional_iou(np.array([0.0, 1.0]), line, 1 - line, (0, 1), (0, 1)) == pytest.approx(1 / 3)


def test_directional_iou_against_fine_sampling():
    rng = np.random.default_rng(4)
    x = np.linspace(0, 10, 60)
    for _ in range(20):
        a, t = rng.random(60), rng.random(60)
        lo, tlo = rng.uniform(0.5, 4, 2)
        sa, st = (lo, lo + 3), (tlo, tlo + 2.5)
        fine = np.linspace(*sa, 200_001)
        fa = np.interp(fine, x, a)
        ft = np.where((fine > st[0]) & (fine < st[1]), np.interp(fine, x, t), 0)
        want = np.minimum(fa, ft).sum() / np.maximum(fa, ft).sum()
        assert co.directional_iou(x, a, t, sa, st) == pytest.approx(want, abs=1e-4)


def test_autocorrelation_is_the_lag_sum():
    row = np.random.default_rng(5).random(64)
    z = (row - row.mean()) / row.std()
    lags = np.array([z[:64 - k] @ z[k:] for k in range(64)])
    rel = lags[1:] / lags[0]
    want = (rel - rel.mean()) / rel.std()
    np.testing.assert_allclose(co.fingerprint_block(row[None])[0], want, atol=1e-10)
    assert np.isnan(co.fingerprint_block(np.ones((1, 64)))).all()


def test_window_bounds():
    assert co.window_bounds(0, 10, 5, 1) == [(i, i + 5) for i in range(6)]
    assert co.window_bounds(0, 5, 5, 1) == [(0, 5)]
    with pytest.raises(ValueError):
        co.window_bounds(0, 4, 5, 1)


def test_waviness_is_recovered():
    phi = np.arange(-180, 180, 5.0)
    r = 2 + 0.03 * np.cos(np.radians(phi - 30)) + 0.01 * np.cos(2 * np.radians(phi - 50))
    fit = waviness_fit(phi, r)
    assert fit["A1"] == pytest.approx(0.03, abs=1e-9) and fit["phi1"] == pytest.approx(30)
    assert fit["A2"] == pytest.approx(0.01, abs=1e-9) and fit["rms"] < 1e-9
    assert waviness_fit(phi[:7], r[:7]) is None


def test_blobs_merge_across_the_seam_and_diagonally():
    a, r = np.array([0, 35, 10, 11, 20]), np.array([4, 5, 1, 2, 9])
    labels = sp.label_blobs(a, r, 36)
    assert labels[0] == labels[1] and labels[2] == labels[3] and len(set(labels)) == 3


def test_diamond_lines():
    d = [2 * math.pi / q for q in matching.diamond_lines(6.0)]
    assert d[0] == pytest.approx(3.56712 / math.sqrt(3)) and d[1] == pytest.approx(3.56712 / math.sqrt(8))
    for (lo, hi), q in zip(matching.diamond_windows(6.0), matching.diamond_lines(6.36)):
        assert lo < q < hi and hi - q > q - lo


def test_simulation_repeats_per_id():
    grid = np.linspace(1.2, 4, 200)
    centers, weights = np.array([2.0, 2.8]), np.array([1.0, 0.6])
    one = sm.augmented(np.random.default_rng([3, 17]), grid, centers, weights, sm.Augment())
    two = sm.augmented(np.random.default_rng([3, 17]), grid, centers, weights, sm.Augment())
    assert (one == two).all() and one.max() == 1 and one.min() >= 0


def test_auto_fit_range_trims_onset_and_tail():
    x = np.linspace(0, 10, 400)
    y = 50 * np.exp(-x / 0.2) + 20 * np.exp(-0.5 * ((x - 4) / 0.2) ** 2)
    y[300:] = 0
    lo, hi = bg.trim_range(x, y + np.random.default_rng(0).normal(0, 0.01, 400))
    assert lo is not None and 0 < lo < 2
    assert hi is None or hi > 7
