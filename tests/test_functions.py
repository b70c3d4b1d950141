"""Closed forms of the numpy kernels."""

import itertools
import math
import time

import numpy as np
import pytest

from sparkloom.functions import images, signals


def test_savgol_keeps_polynomials_up_to_its_order():
    x = np.arange(40.0)
    for order in range(6):
        y = sum(c * x**i / 10**i for i, c in enumerate(range(1, order + 2)))
        assert np.allclose(signals.savgol(y, 13, 5), y)


def test_nan_savgol_leaves_short_runs_and_its_input():
    y = np.arange(30.0) ** 2
    y[5] = np.nan
    before = y.copy()
    out = signals.nan_savgol(y, 13, 5)
    assert np.array_equal(y, before, equal_nan=True) and np.isnan(out[5])
    assert np.array_equal(out[:5], y[:5]) and np.allclose(out[6:], y[6:])


def test_all_missing_series():
    nothing = np.full(50, np.nan)
    for f in (lambda x: signals.nan_savgol(x, 13, 5), signals.nan_low_pass, lambda x: signals.fill_gaps(x, 3)):
        assert np.isnan(f(nothing)).all()


def test_low_pass_keeps_constants_and_damps_fast_waves():
    t = np.arange(200)
    assert np.allclose(signals.nan_low_pass(np.full(200, 3.0)), 3.0)
    slow, fast = np.sin(2 * np.pi * t / 80), np.sin(2 * np.pi * t / 2.5)
    out = signals.nan_low_pass(slow + fast)
    assert np.abs(out - slow)[30:-30].max() < 0.05


def test_cubic_fill_is_exact_on_cubics_and_stops_at_the_limit():
    x = np.arange(30.0) ** 3
    y = x.copy()
    y[[10, 11, 20, 21, 22, 23, 24]] = np.nan
    out = signals.fill_gaps(y, 3)
    assert np.allclose(out[[10, 11, 20, 21, 22]], x[[10, 11, 20, 21, 22]]) and np.isnan(out[[23, 24]]).all()


def test_akima_passes_through_points_and_keeps_lines():
    x, fine = np.arange(12.0), np.linspace(0, 11, 111)
    assert np.allclose(signals.akima(x, 3 * x - 1, fine), 3 * fine - 1)
    y = np.random.default_rng(1).random(12)
    assert np.allclose(signals.akima(x, y, x), y)


def test_peaks_by_height_distance_and_prominence():
    x = np.zeros(50)
    x[[10, 13, 30, 40]] = [1.0, 0.9, 0.5, 0.3]
    assert signals.peaks(x, 0.4, 1, 0.2).tolist() == [10, 13, 30]
    assert signals.peaks(x, 0.4, 5, 0.2).tolist() == [10, 30]
    flat = np.array([0, 1, 1, 1, 0.0])
    assert signals.local_maxima(flat).tolist() == [2]


def test_band_spacing_of_two_gaussians():
    at = (np.arange(61) - 30) * 0.1
    profile = np.exp(-((at + 0.9) ** 2) / 0.02) + np.exp(-((at - 1.1) ** 2) / 0.02)
    gap, off = signals.band_spacing(profile, 0.1, (1.0, 3.0))
    assert gap == pytest.approx(2.0, abs=0.02) and off == pytest.approx(0.1, abs=0.02)
    assert math.isnan(signals.band_spacing(np.ones(61), 0.1, (1.0, 3.0))[0])


def test_frames_match_as_by_augmenting_paths():
    """As many pairs at as little cost as the dense matching, each place once, with equal places and with many within reach."""
    rng = np.random.default_rng(5)
    for _ in range(300):
        n, m = rng.integers(0, 30, 2)
        span, digits = rng.choice([3, 20, 200]), rng.choice([0, 1, 9])
        p, q = rng.uniform(0, span, n).round(digits), rng.uniform(0, span, m).round(digits)
        found = signals.matched_frame(p, q, 5.0)
        reach, near = 5.0, np.abs(p[:, None] - q[None])
        while reach * 0.8 >= 1 and max((near <= reach).sum(axis=1).max(initial=0), (near <= reach).sum(axis=0).max(initial=0)) > 8:
            reach *= 0.8
        want = [near[i, j] ** 2 for i, j in zip(*signals.assignment(np.where(near <= reach, near**2, 1e12))) if near[i, j] <= reach]
        own = [near[i, j] ** 2 for j, i in enumerate(found) if i >= 0]
        assert len(own) == len(want) and abs(sum(own) - sum(want)) < 1e-6 and (near[found[found >= 0], np.flatnonzero(found >= 0)] <= reach).all()
        assert len(set(found[found >= 0].tolist())) == len(own)


def test_matching_frames_takes_time_near_linear():
    took = []
    for n in (500, 4000):
        p, q = (np.sort(np.random.default_rng(i).uniform(0, n / 10, n)) for i in (0, 1))
        start = time.process_time()
        signals.matched_frame(p, q, 2.0)
        took.append(time.process_time() - start)
    assert took[1] < 40 * took[0]


def test_peaks_of_long_profiles():
    """Prominences and distances as defined, and in time near linear."""
    took = []
    for n in (2_000, 40_000):
        x = np.random.default_rng(n).normal(size=n).cumsum() * 0.01 + np.random.default_rng(1).normal(size=n)
        start = time.process_time()
        found = signals.peaks(x, -1e9, 4, 0.5)
        took.append(time.process_time() - start)
        assert np.diff(found).min() >= 4
    for i in found[::500]:
        higher = np.flatnonzero(x > x[i])
        a, b = higher[higher < i], higher[higher > i]
        low = x[a[-1] if len(a) else 0 : i + 1].min(), x[i : (b[0] if len(b) else n - 1) + 1].min()
        assert signals.prominence(x, i) == x[i] - max(low)
    assert took[1] < 60 * took[0]


def test_assignment_equals_brute_force():
    rng = np.random.default_rng(0)
    for _ in range(60):
        n, m = map(int, rng.integers(1, 7, 2))
        c = rng.random((n, m))
        rows, cols = signals.assignment(c)
        k = min(n, m)
        pairs = (zip(range(n), p) if n <= m else zip(p, range(m)) for p in itertools.permutations(range(max(n, m)), k))
        assert c[rows, cols].sum() == pytest.approx(min(sum(c[i, j] for i, j in p) for p in pairs))


def test_linking_keeps_tracks_over_gaps():
    frames = [np.array([0.0, 10.0]), np.array([0.5]), np.array([1.0, 10.5]), np.array([1.4, 10.9, 30.0])]
    tracks = signals.linked(frames, 2.0, 3)
    assert [t.tolist() for t in tracks] == [[0, 1], [0], [0, 1], [0, 1, 2]]
    assert signals.linked(frames, 2.0, 0)[2].tolist() == [0, 2]


def test_morlet_finds_the_frequency():
    t = np.arange(400) * 0.1
    m, f = signals.morlet(np.sin(2 * np.pi * 0.5 * t), 0.1, np.geomspace(6, 60, 40))
    assert f[m[:, 100:300].mean(axis=1).argmax()] == pytest.approx(0.5, rel=0.1)


def test_labels_regions_and_skeleton():
    m = np.zeros((20, 20), bool)
    m[3:8, 3:15] = True
    m[12:15, 2:5] = True
    m[15, 5] = True  # joined across a corner
    found = images.regions(images.label(m), m * 2.0)
    assert [r["area"] for r in found] == [60, 10]
    assert found[0]["convex_area"] == 60 and found[0]["mean_intensity"] == 2.0 and found[0]["feret"] == pytest.approx(13.0)
    ends = images.skeleton_ends(images.skeleton(m[:10]))
    assert len(ends) == 2 and len({int(e[0]) for e in ends}) == 1


def test_spiral_is_one_label():
    m = np.zeros((11, 11), bool)
    for i in range(0, 11, 2):
        m[i] = True
    for i in range(1, 11, 2):
        m[i, 0 if i % 4 == 1 else 10] = True
    assert images.label(m).max() == 1


def test_nan_median_ignores_missing():
    x = np.array([[1.0, np.nan, 3.0], [np.nan, np.nan, np.nan], [5.0, 6.0, 7.0]])
    out = images.nan_median_filter(x, 3)
    assert out[1, 1] == 5.0 and out[0, 0] == 1.0
    assert np.isnan(images.nan_median_filter(np.full((2, 2), np.nan), 3)).all()


def test_phase_is_found_and_undone():
    rng = np.random.default_rng(3)
    img = np.repeat(rng.random((1, 60)), 20, axis=0)
    bent = img.copy()
    bent[1::2] = np.roll(bent[1::2], -3, axis=1)
    assert np.allclose(images.phase_corrected(bent, 5), img)


def test_line_pixels_and_distance_map():
    assert images.line_pixels(0, 0, 3, 3).tolist() == [[0, 0], [1, 1], [2, 2], [3, 3]]
    d = images.distance_map((11, 11), np.array([5.0]), np.array([5.0]), np.array([0.0]), np.array([8.0]))
    assert d[5, 1] == 0 and d[5, 5] == 1 and np.isnan(d[0, 0])


def test_double_wavelet_finds_length_and_angle():
    img = np.zeros((40, 40))
    img[:, 12] = img[:, 26] = 1.0
    lengths, angles = np.array([10.0, 14.0, 18.0]), np.deg2rad([-90.0, -45.0, 0.0, 45.0])
    score, n, t = images.best_wavelet(images.double_wavelets(img, lengths, angles, 3.0, 1.0))
    assert lengths[n[20, 19]] == 14 and angles[t[20, 19]] == 0


@pytest.mark.parametrize("kind", ["uint8", "uint16", "float32"])
def test_tiff_round_trip(kind):
    pages = [np.arange(35).reshape(5, 7).astype(kind), np.ones((5, 7), kind)]
    back, info = images.read_tiff(images.write_tiff(pages, "fps=20", 100.0))
    assert all((a == b).all() and a.dtype == b.dtype for a, b in zip(pages, back))
    assert info == {"description": "fps=20", "resolution": 100.0, "unit": "cm"}


def test_holes_are_filled_only_inside():
    x = np.add.outer(np.arange(8.0), np.arange(8.0))
    y = x.copy()
    y[3:5, 3] = y[0, 0] = np.nan
    out = images.filled_holes(y, 4)
    assert np.allclose(out[3:5, 3], x[3:5, 3], atol=1e-6) and np.isnan(out[0, 0])
