import numpy as np
import pytest

from canopyforge.operators import kernels as k


def plane(n=9, ax=1.0, ay=2.0):
    y, x = np.mgrid[0:n, 0:n].astype(float)
    return ax * x + ay * y


def test_triangles_cover_a_square_and_are_delaunay():
    rng = np.random.default_rng(1)
    x, y = rng.random(60), rng.random(60)
    x[:4], y[:4] = [0, 1, 0, 1], [0, 0, 1, 1]
    t = k.delaunay(x, y)
    area = np.abs((x[t[:, 1]] - x[t[:, 0]]) * (y[t[:, 2]] - y[t[:, 0]]) - (x[t[:, 2]] - x[t[:, 0]]) * (y[t[:, 1]] - y[t[:, 0]])) / 2
    assert area.sum() == pytest.approx(1.0, abs=1e-9)
    for a, b, c in t:
        m = np.array([[x[b] - x[a], y[b] - y[a]], [x[c] - x[a], y[c] - y[a]]])
        o = np.linalg.solve(2 * m, (m**2).sum(1))
        d2 = (x - x[a] - o[0]) ** 2 + (y - y[a] - o[1]) ** 2
        assert (d2 >= (o**2).sum() - 1e-7).all()


def test_grid_of_points_interpolates_a_plane():
    gy, gx = np.mgrid[0:6, 0:6].astype(float)
    out = k.tin_raster(gx.ravel(), gy.ravel(), (3 + 2 * gx - gy).ravel(), np.arange(0.5, 5), np.arange(4.5, 0, -1))
    assert np.allclose(out, 3 + 2 * np.arange(0.5, 5)[None, :] - np.arange(4.5, 0, -1)[:, None], atol=1e-6)


def test_long_edges_leave_gaps():
    out = k.tin_raster(np.array([0.0, 10, 0]), np.array([0.0, 0, 10]), np.ones(3), np.array([1.0]), np.array([1.0]), longest=5)
    assert np.isnan(out).all()


def test_nearest_fill_is_exact():
    rng = np.random.default_rng(2)
    a = np.where(rng.random((15, 17)) < 0.1, rng.random((15, 17)), np.nan)
    r, c = np.nonzero(np.isfinite(a))
    got_r, got_c = k.nearest_index(np.isfinite(a))
    for i, j in np.ndindex(a.shape):
        assert (got_r[i, j] - i) ** 2 + (got_c[i, j] - j) ** 2 == ((r - i) ** 2 + (c - j) ** 2).min()
    assert np.isfinite(k.fill_nearest(a)).all()


def test_filters_keep_constants_and_fill_holes():
    a = np.full((9, 9), 5.0)
    a[4, 4] = np.nan
    assert np.allclose(k.gaussian(a, 1.0), 5.0)
    assert k.fill_holes_by_median(a, 3)[4, 4] == 5.0
    b = np.full((7, 7), 5.0)
    b[3, 3] = 0.0
    assert k.fix_pits(b, np.ones_like(b, bool), 1.0)[3, 3] == 5.0
    assert (k.median_filter(b) == 5.0).all()


def cones():
    y, x = np.mgrid[0:41, 0:41].astype(float)
    return np.maximum(20 - np.hypot(y - 20, x - 10) * 2, 18 - np.hypot(y - 20, x - 30) * 2).clip(0)


def test_two_cones_have_two_peaks_and_crowns():
    a = cones()
    peaks = k.local_maxima(a, 5, 2.0)
    assert peaks == [(20, 10), (20, 30)]
    assert k.prune(peaks, 1.0, 25.0) == [(20, 10)]
    assert k.screen(a, peaks, 1.0, 110.0, 30.0) == peaks
    for grow in (lambda: k.watershed(a, peaks, a > 2), lambda: k.water_expansion(a, peaks, a > 2, 1.0)):
        labels = grow()
        assert set(np.unique(labels)) == {0, 1, 2}
        assert labels[20, 10] == 1 and labels[20, 30] == 2 and (labels[a <= 2] == 0).all()


def test_flat_top_pair_is_screened():
    a = np.full((11, 11), 10.0)
    a[5, 2] = a[5, 7] = 10.1
    assert len(k.screen(a, [(5, 2), (5, 7)], 1.0)) == 1


def test_outline_of_a_ring_has_a_hole():
    a = np.ones((3, 3), int)
    a[1, 1] = 0
    rings = k.outlines(a, 0.0, 3.0, 1.0)[1]
    area = [sum(p[0] * q[1] - q[0] * p[1] for p, q in zip(r, r[1:] + r[:1])) / 2 for r in rings]
    assert sorted(area) == [-1.0, 9.0]


def test_cloth_rests_on_support():
    a = cones()
    out = k.cloth(a, np.ones_like(a, bool))
    assert (out >= a - 1e-9).all()
