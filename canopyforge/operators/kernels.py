"""Array kernels for what is not relational: triangulation, distance fills, filters, floods, outlines. NumPy only; a kernel sees
one tile with its halo, so that memory is bounded by the tile."""

from __future__ import annotations

import heapq
from math import acos, ceil, cos, degrees, hypot, pi, sqrt

import numpy as np


def delaunay(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Triangles (m, 3) of distinct points, by insertion. Cocircular points, as in grids, are told apart by a shift of 1e-9 of the
    extent that follows from their order, so that equal inputs give equal triangles. Points come in strips from the left; triangles
    whose circle lies left of the strip are final and no longer looked at."""
    n = len(x)
    if n < 3:
        return np.zeros((0, 3), np.int64)
    scale = max(np.ptp(x), np.ptp(y), 1e-12)
    u, v = (x - x.min()) / scale, (y - y.min()) / scale
    turn = np.modf(np.arange(1, n + 1) * 0.6180339887498949)[0]
    u, v = u + 1e-9 * np.cos(2 * pi * turn), v + 1e-9 * np.sin(2 * pi * turn)
    u, v = np.concatenate([u, [-50.0, 51.0, 0.5]]), np.concatenate([v, [-50.0, -50.0, 80.0]])
    tri = np.array([[n, n + 1, n + 2]])

    def circles(t: np.ndarray) -> np.ndarray:
        ax, ay, bx, by, cx, cy = u[t[:, 0]], v[t[:, 0]], u[t[:, 1]], v[t[:, 1]], u[t[:, 2]], v[t[:, 2]]
        bx, by, cx, cy = bx - ax, by - ay, cx - ax, cy - ay
        d = 2 * (bx * cy - by * cx)
        d = np.where(np.abs(d) < 1e-300, 1e-300, d)
        b2, c2 = bx * bx + by * by, cx * cx + cy * cy
        ox, oy = (cy * b2 - by * c2) / d, (bx * c2 - cx * b2) / d
        return np.stack([ax + ox, ay + oy, ox * ox + oy * oy], 1)

    circle, final, strip = circles(tri), [], -1.0
    strips = np.round(u[:n] * sqrt(n))
    for i in np.lexsort((v[:n], strips)):
        if strips[i] > strip:
            strip = strips[i]
            over = circle[:, 0] + np.sqrt(circle[:, 2]) < (strip - 0.5) / sqrt(n) - 1e-7
            final.append(tri[over])
            tri, circle = tri[~over], circle[~over]
        bad = (u[i] - circle[:, 0]) ** 2 + (v[i] - circle[:, 1]) ** 2 < circle[:, 2]
        gone = tri[bad]
        edges = np.concatenate([gone[:, [0, 1]], gone[:, [1, 2]], gone[:, [2, 0]]])
        key = np.sort(edges, 1)
        _, at, count = np.unique(key[:, 0] * (n + 3) + key[:, 1], return_index=True, return_counts=True)
        rim = edges[at[count == 1]]
        new = np.concatenate([rim, np.full((len(rim), 1), i)], 1)
        tri, circle = np.concatenate([tri[~bad], new]), np.concatenate([circle[~bad], circles(new)])
    tri = np.concatenate([*final, tri])
    return tri[(tri < n).all(1)]


def tin_raster(x: np.ndarray, y: np.ndarray, z: np.ndarray, gx: np.ndarray, gy: np.ndarray, longest: float | None = None, proven: np.ndarray | None = None, seen: tuple[float, ...] = (), bounds: tuple[float, ...] = ()) -> np.ndarray:
    """z at the crossings of columns gx (ascending) and rows gy (descending), linear in triangles without edges over longest; where
    triangles overlap the greatest; NaN outside. proven is set where a triangle lies whose circle no point of bounds (xmin, ymin, xmax, ymax)
    outside seen can be in."""
    out = np.full((len(gy), len(gx)), np.nan)
    tri = delaunay(x, y)
    tx, ty = x[tri], y[tri]
    c_at = np.searchsorted(gx, tx.min(1) - 1e-8), np.searchsorted(gx, tx.max(1) + 1e-8, side="right")
    r_at = np.searchsorted(-gy, -ty.max(1) - 1e-8), np.searchsorted(-gy, -ty.min(1) + 1e-8, side="right")
    # of dense points, few triangles have a crossing in their box
    some = (c_at[0] < c_at[1]) & (r_at[0] < r_at[1])
    for (a, b, c), c0, c1, r0, r1 in zip(tri[some].tolist(), *(v[some].tolist() for v in (*c_at, *r_at)), strict=True):
        xs, ys = x[[a, b, c]], y[[a, b, c]]
        short = longest is None or max(hypot(xs[i] - xs[j], ys[i] - ys[j]) for i, j in ((0, 1), (1, 2), (2, 0))) <= longest
        if not short and proven is None:
            continue
        det = (ys[1] - ys[2]) * (xs[0] - xs[2]) + (xs[2] - xs[1]) * (ys[0] - ys[2])
        if abs(det) < 1e-12:
            continue
        px, py = gx[None, c0:c1], gy[r0:r1, None]
        w0 = ((ys[1] - ys[2]) * (px - xs[2]) + (xs[2] - xs[1]) * (py - ys[2])) / det
        w1 = ((ys[2] - ys[0]) * (px - xs[2]) + (xs[0] - xs[2]) * (py - ys[2])) / det
        w2 = 1 - w0 - w1
        inside = (w0 >= -1e-8) & (w1 >= -1e-8) & (w2 >= -1e-8)
        if proven is not None and circle_within(xs, ys, seen, bounds):
            proven[r0:r1, c0:c1] |= inside
        if not short:
            continue
        value = w0 * z[a] + w1 * z[b] + w2 * z[c]
        part = out[r0:r1, c0:c1]
        part[inside] = np.fmax(part[inside], value[inside])
    return out


def circle_within(xs: np.ndarray, ys: np.ndarray, seen: tuple[float, ...], bounds: tuple[float, ...]) -> bool:
    """Is the part within bounds of the circle through three points also within seen?"""
    bx, by, cx, cy = xs[1] - xs[0], ys[1] - ys[0], xs[2] - xs[0], ys[2] - ys[0]
    d = 2 * (bx * cy - by * cx)
    b2, c2 = bx * bx + by * by, cx * cx + cy * cy
    ox, oy = (cy * b2 - by * c2) / d, (bx * c2 - cx * b2) / d
    r, ox, oy = hypot(ox, oy) * (1 + 1e-9), xs[0] + ox, ys[0] + oy
    away_x, away_y = max(bounds[0] - ox, ox - bounds[2], 0.0), max(bounds[1] - oy, oy - bounds[3], 0.0)
    if max(away_x, away_y) >= r:
        return True
    wide, high = sqrt(r * r - away_y * away_y), sqrt(r * r - away_x * away_x)
    part = (max(bounds[0], ox - wide), max(bounds[1], oy - high), min(bounds[2], ox + wide), min(bounds[3], oy + high))
    return part[0] >= seen[0] and part[1] >= seen[1] and part[2] <= seen[2] and part[3] <= seen[3]


def hull(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Indices of the corners of the points' convex hull, counter-clockwise."""
    order = np.lexsort((y, x)).tolist()
    ends = []
    for way in (order, order[::-1]):
        side: list[int] = []
        for i in way:
            while len(side) > 1 and (x[side[-1]] - x[side[-2]]) * (y[i] - y[side[-2]]) - (y[side[-1]] - y[side[-2]]) * (x[i] - x[side[-2]]) <= 0:
                side.pop()
            side.append(i)
        ends += side[:-1]
    return np.array(ends or order[:1], np.int64)


def outside_hull(hx: np.ndarray, hy: np.ndarray, gx: np.ndarray, gy: np.ndarray) -> np.ndarray:
    """Which crossings of columns gx and rows gy lie outside the hull with corners (hx, hy), by more than a rounding error."""
    out = np.full((len(gy), len(gx)), len(hx) < 3)
    for i in range(len(hx) if len(hx) > 2 else 0):
        ax, ay, bx, by = hx[i - 1], hy[i - 1], hx[i], hy[i]
        out |= ((bx - ax) * (gy[:, None] - ay) - (by - ay) * (gx[None, :] - ax)) < -1e-6 * hypot(bx - ax, by - ay)
    return out


def nearest(points: np.ndarray, weight: np.ndarray, wanted: np.ndarray, k: int, margin: np.ndarray, pairs: int = 200_000) -> tuple[np.ndarray, np.ndarray]:
    """(d, take), a row for each wanted point: the distances of the nearest points, in order, and how often each counts among the k nearest.
    points are distinct and count by weight, one fewer at the wanted point's own place. Nothing is taken where the k nearest don't lie within
    the margin, unless that is infinite.

    Points lie in cells, so small that few are in one; wanted points look at the cells around theirs, and again in larger cells where
    that doesn't prove the k nearest.
    """
    n, axes = points.shape
    d, take = np.full((len(wanted), k + 1), np.inf), np.zeros((len(wanted), k + 1), np.int64)
    if not n or not len(wanted):
        return d, take
    lo, extent = points.min(0), max(np.ptp(points, axis=0).max(), 1e-300)
    size = extent * min(1.0, 2 * (k / n) ** (1 / axes))

    def cells(a: np.ndarray) -> np.ndarray:
        return np.floor((a - lo) / size).astype(np.int64)

    def crowd() -> float:
        _, c = np.unique(cells(points) @ (1 << 21) ** np.arange(axes, dtype=np.int64), return_counts=True)
        return (c.astype(float) ** 2).sum() / n

    while size > extent / (1 << 19) and crowd() > 1 + 0.55 * k:
        size = 0.8 * size
    left = np.arange(len(wanted))
    while len(left):
        shape = cells(points).max(0) + 1
        step = np.cumprod(np.concatenate([[1], shape[:0:-1]]))[::-1]  # the last axis runs fastest
        code = cells(points) @ step
        order = np.argsort(code, kind="stable")
        code, xyz, w = code[order], points[order], weight[order]
        left = left[np.argsort(cells(wanted[left]) @ step, kind="stable")]
        own = cells(wanted[left])
        begin, end = [], []
        for move in np.ndindex(*(3,) * (axes - 1)):
            at = own[:, :-1] + np.array(move) - 1
            there = ((at >= 0) & (at < shape[:-1])).all(1)
            base = at @ step[:-1]
            first, past = base + np.clip(own[:, -1] - 1, 0, shape[-1]), base + np.clip(own[:, -1] + 2, 0, shape[-1])
            begin.append(np.where(there, np.searchsorted(code, first), 0))
            end.append(np.where(there, np.searchsorted(code, past), 0))
        begin, end = np.column_stack(begin), np.column_stack(end)
        count = (end - begin).sum(1)
        by_count = np.argsort(count, kind="stable")
        at = 0
        while at < len(by_count):
            # as many as fit, all padded to the most points that one of them looks at
            upto = at + 1
            room = min(len(by_count), at + max(1, pairs // max(1, int(count[by_count[at]]))))
            while upto < room:
                more = min(room, 2 * upto - at)
                if int(count[by_count[more - 1]]) * (more - at) > pairs:
                    break
                upto = more
            some = by_count[at:upto]
            at = upto
            wide = max(int(count[some].max()), k + 1)
            size_of = (end[some] - begin[some]).ravel()
            flat = np.repeat(begin[some].ravel() - np.concatenate([[0], np.cumsum(size_of)[:-1]]), size_of) + np.arange(size_of.sum())
            mask = np.arange(wide) < count[some][:, None]
            of = np.repeat(left[some], count[some])
            d2 = np.full((len(some), wide), np.inf)
            d2[mask] = sum((xyz[flat, i] - wanted[of, i]) ** 2 for i in range(axes))
            which = np.zeros((len(some), wide), np.int64)
            which[mask] = flat
            if wide > k + 1:
                best = np.argpartition(d2, k, axis=1)[:, : k + 1]
                d2, which = np.take_along_axis(d2, best, 1), np.take_along_axis(which, best, 1)
            best = np.argsort(d2, axis=1, kind="stable")
            d2, which = np.take_along_axis(d2, best, 1), np.take_along_axis(which, best, 1)
            counts = np.where(np.isfinite(d2), w[which] - (d2 == 0), 0)
            counts = np.clip(k - (np.cumsum(counts, axis=1) - counts), 0, counts)
            far = np.sqrt(d2)
            rim = np.max(np.where(counts > 0, far, 0.0), axis=1)
            sure = ((counts.sum(1) >= k) & (rim <= size * (1 - 1e-9))) | (size >= extent)
            d[left[some]] = far
            take[left[some]] = np.where(sure[:, None], counts, 0)
            count[some] = np.where(sure, -1, 0)
        # what the margin doesn't prove here, larger cells don't either
        open_ = left[count >= 0]
        left = open_[size < margin[open_]]
        size = size * 1.5
    rim = np.max(np.where(take > 0, d, 0.0), axis=1)
    take[((take.sum(1) < k) | (rim > margin)) & np.isfinite(margin)] = 0
    return d, take


def nearest_index(valid: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row and column of the nearest True cell of every cell (Euclidean, exact); ties to the lesser column, then row."""
    h, w = valid.shape
    rows = np.arange(h)[:, None]
    up = np.maximum.accumulate(np.where(valid, rows, -(10**9)), 0)
    down = np.minimum.accumulate(np.where(valid, rows, 10**9)[::-1], 0)[::-1]
    near = np.where(rows - up <= down - rows, up, down)
    apart = np.minimum(np.abs(near - rows), 10**6).astype(np.int64) ** 2
    across = (np.arange(w)[:, None] - np.arange(w)[None, :]) ** 2
    out_r, out_c = np.empty((h, w), np.int64), np.empty((h, w), np.int64)
    for r in range(h):
        best = (apart[r][None, :] + across).argmin(1)
        out_c[r], out_r[r] = best, near[r, best]
    return out_r, out_c


def fill_nearest(a: np.ndarray, where: np.ndarray | None = None) -> np.ndarray:
    """NaN cells (of where) get the nearest value."""
    valid = np.isfinite(a)
    if not valid.any() or valid.all():
        return a.copy()
    r, c = nearest_index(valid)
    target = ~valid if where is None else ~valid & where
    return np.where(target, a[r, c], a)


def gaussian(a: np.ndarray, sigma: float, truncate: float = 4.0) -> np.ndarray:
    """Gaussian over the finite cells, weights renewed, the border repeated; NaN stays NaN only where nothing is near."""
    if sigma <= 0:
        return a.copy()
    r = int(truncate * sigma + 0.5)
    k = np.exp(-0.5 * (np.arange(-r, r + 1) / sigma) ** 2)
    k /= k.sum()
    num, den = np.where(np.isfinite(a), a, 0.0), np.isfinite(a).astype(float)
    for axis in (0, 1):
        for j, part in enumerate((num, den)):
            wide = np.pad(part, [(r, r) if ax == axis else (0, 0) for ax in (0, 1)], mode="edge")
            made = sum(w * np.take(wide, np.arange(i, i + part.shape[axis]), axis) for i, w in enumerate(k))
            num, den = (made, den) if j == 0 else (num, made)
    return np.where(den > 1e-12, num / np.maximum(den, 1e-12), np.nan)


def windows(a: np.ndarray, size: int) -> np.ndarray:
    r = size // 2
    return np.lib.stride_tricks.sliding_window_view(np.pad(a, r, mode="edge"), (size, size)).reshape(*a.shape, -1)


def median_filter(a: np.ndarray, size: int = 3) -> np.ndarray:
    return np.median(windows(a, size), -1)


def fix_pits(a: np.ndarray, footprint: np.ndarray, threshold: float, size: int = 3) -> np.ndarray:
    """In the footprint NaN becomes 0, and values further than threshold below the local median become it."""
    z = np.where(footprint & ~np.isfinite(a), 0.0, a)
    mid = median_filter(np.where(np.isfinite(z), z, 0.0), size)
    return np.where(footprint & (z < mid - threshold), mid, z)


def fill_holes_by_median(a: np.ndarray, rounds: int) -> np.ndarray:
    """NaN cells get the median of their finite neighbours, again and again until none is left or rounds are over."""
    a = a.copy()
    for _ in range(rounds):
        empty = ~np.isfinite(a)
        if not empty.any() or empty.all():
            break
        around = np.lib.stride_tricks.sliding_window_view(np.pad(a, 1, constant_values=np.nan), (3, 3))[empty].reshape(-1, 9)
        some = np.isfinite(around).any(1)
        if not some.any():
            break
        made = np.full(len(around), np.nan)
        made[some] = np.nanmedian(around[some], 1)
        a[empty] = made
    return a


def cloth(base: np.ndarray, footprint: np.ndarray, rounds: int = 40, drop: float = 0.2, sigma: float = 1.0) -> np.ndarray:
    """A cloth that sinks onto base from above: each round smooths it, lowers it, and holds it up where base supports it."""
    held = footprint & np.isfinite(base)
    if not held.any():
        return base.copy()
    sheet = np.full(base.shape, base[held].max() + drop)
    for _ in range(rounds):
        sheet = gaussian(sheet, sigma) - drop
        sheet = np.where(held, np.maximum(sheet, base), sheet)
    return np.where(footprint, sheet, np.nan)


def sobel(a: np.ndarray) -> np.ndarray:
    """Magnitude of the Sobel gradient, the border repeated."""
    p = np.pad(a, 1, mode="edge")
    left, right = p[:-2, :-2] + 2 * p[1:-1, :-2] + p[2:, :-2], p[:-2, 2:] + 2 * p[1:-1, 2:] + p[2:, 2:]
    top, bottom = p[:-2, :-2] + 2 * p[:-2, 1:-1] + p[:-2, 2:], p[2:, :-2] + 2 * p[2:, 1:-1] + p[2:, 2:]
    return np.hypot(right - left, bottom - top)


def dual_gaussian(a: np.ndarray, near: float = 0.9, far: float = 1.8, quantile: float = 0.9) -> np.ndarray:
    """Light smoothing where relief is strong, heavier where it is weak: weights exp(-2 relief)."""
    light, heavy = gaussian(a, near), gaussian(a, far)
    z = np.where(np.isfinite(a), a, 0.0)
    high = z[z > 0]
    scale = np.quantile(high, quantile) if len(high) else 1.0
    w = np.exp(-2 * sobel(z) / max(scale, 1e-6))
    return np.where(np.isfinite(a), w * heavy + (1 - w) * light, np.nan)


def local_maxima(a: np.ndarray, window: int, least: float) -> list[tuple[int, int]]:
    """(row, col) of cells that are their window's greatest and at least `least`, highest first, then by row and column."""
    z = np.where(np.isfinite(a), a, -np.inf)
    rows, cols = np.nonzero((z == windows(z, max(3, window | 1)).max(-1)) & (z >= least))
    order = np.lexsort((cols, rows, -z[rows, cols]))
    return list(zip(rows[order].tolist(), cols[order].tolist(), strict=True))


def prune(peaks: list[tuple[int, int]], res: float, apart: float) -> list[tuple[int, int]]:
    """Peaks in their order that are at least `apart` from all kept before; by a grid of kept ones, not all against all."""
    kept: list[tuple[int, int]] = []
    at: dict[tuple[int, int], list[tuple[int, int]]] = {}
    step = max(1, ceil(apart / res))
    for r, c in peaks:
        i, j = r // step, c // step
        near = (p for di in (-1, 0, 1) for dj in (-1, 0, 1) for p in at.get((i + di, j + dj), ()))
        if all(hypot(r - pr, c - pc) * res >= apart for pr, pc in near):
            kept.append((r, c))
            at.setdefault((i, j), []).append((r, c))
    return kept


def valley_angle(a: np.ndarray, p: tuple[int, int], q: tuple[int, int], res: float, band: int = 1) -> float:
    """Angle in degrees at the lowest cell of the band between two peaks; 180 where nothing lies between."""
    steps = max(abs(q[0] - p[0]), abs(q[1] - p[1]))
    best: tuple | None = None
    for i in range(1, steps):
        r, c = round(p[0] + (q[0] - p[0]) * i / steps), round(p[1] + (q[1] - p[1]) * i / steps)
        for dr in range(-band, band + 1):
            for dc in range(-band, band + 1):
                rr, cc = r + dr, c + dc
                if 0 <= rr < a.shape[0] and 0 <= cc < a.shape[1] and np.isfinite(a[rr, cc]) and (rr, cc) not in (p, q):
                    # of equally low cells the one on the line and next to its middle
                    here = (float(a[rr, cc]), abs(dr) + abs(dc), abs(2 * i - steps), rr, cc)
                    best = min(best, here) if best else here
    if best is None:
        return 180.0
    z, _, _, r, c = best
    legs = [((t[0] - r) * res, (t[1] - c) * res, max(0.0, float(a[t]) - z)) for t in (p, q)]
    size = [sqrt(sum(k * k for k in leg)) for leg in legs]
    if min(size) == 0:
        return 180.0
    return degrees(acos(max(-1.0, min(1.0, sum(i * j for i, j in zip(*legs, strict=True)) / (size[0] * size[1])))))


def screen(a: np.ndarray, peaks: list[tuple[int, int]], res: float, angle: float = 110.0, within: float = 6.0, band: int = 1) -> list[tuple[int, int]]:
    """Drops the lower of two near peaks whose valley is shallow: an angle of at least `angle` degrees. Pairs in order, dropped
    peaks out of later ones."""
    gone: set[int] = set()
    for i in range(len(peaks)):
        for j in range(i + 1, len(peaks)):
            if i in gone:
                break
            if j in gone or hypot(peaks[i][0] - peaks[j][0], peaks[i][1] - peaks[j][1]) * res > within:
                continue
            if valley_angle(a, peaks[i], peaks[j], res, band) >= angle:
                gone.add(j if a[peaks[i]] >= a[peaks[j]] else i)
    return [p for i, p in enumerate(peaks) if i not in gone]


def watershed(a: np.ndarray, peaks: list[tuple[int, int]], canopy: np.ndarray) -> np.ndarray:
    """Labels 1.. of the canopy's cells by flooding from the peaks at a cost of gradient and inverse height; 0 elsewhere."""
    z = np.where(np.isfinite(a), a, 0.0)
    slope, height = sobel(gaussian(z, 1.0)), z / max(float(z.max()), 1e-9)
    cost = np.rint(65534 * np.clip((slope / max(float(slope.max()), 1e-9) + 0.35 * (1 - height)) / 1.35, 0, 1)).astype(np.int64)
    out, heap = np.zeros(a.shape, np.int32), []
    for label, (r, c) in enumerate(peaks, 1):
        out[r, c] = label
        heap.append((int(cost[r, c]), label, r, c))
    heapq.heapify(heap)
    while heap:
        level, label, r, c = heapq.heappop(heap)
        for rr, cc in ((r - 1, c), (r, c - 1), (r, c + 1), (r + 1, c)):
            if 0 <= rr < a.shape[0] and 0 <= cc < a.shape[1] and canopy[rr, cc] and not out[rr, cc]:
                out[rr, cc] = label
                heapq.heappush(heap, (max(level, int(cost[rr, cc])), label, rr, cc))
    return np.where(canopy, out, 0)


def water_expansion(a: np.ndarray, peaks: list[tuple[int, int]], canopy: np.ndarray, res: float, most_energy: float = 2.0, drop: float = 0.5, alpha: float = 0.65, beta: float = 1.0, gamma: float = 0.85, farthest: float = 12.0) -> np.ndarray:
    """Labels by water that runs from the peaks, highest cells first: a cell joins its neighbour's crown while the energy
    alpha * fall + beta * gradient + gamma * distance (each by its scale) stays low and the crown near its peak."""
    z = np.where(np.isfinite(a), a, 0.0)
    slope = sobel(z)
    steep = max(float(np.percentile(slope[canopy], 95)) if canopy.any() else 1.0, 1e-6)
    out, heap = np.zeros(a.shape, np.int32), []
    local = []
    for i, p in enumerate(peaks):
        apart = [hypot(p[0] - q[0], p[1] - q[1]) * res for j, q in enumerate(peaks) if j != i]
        local.append(min(apart, default=8.0))
    for label, (r, c) in enumerate(peaks, 1):
        out[r, c] = label
        heapq.heappush(heap, (-float(z[r, c]), label, r, c))
    while heap:
        _, label, r, c = heapq.heappop(heap)
        pr, pc = peaks[label - 1]
        top = max(float(z[pr, pc]), 1e-6)
        for rr, cc in ((r - 1, c - 1), (r - 1, c), (r - 1, c + 1), (r, c - 1), (r, c + 1), (r + 1, c - 1), (r + 1, c), (r + 1, c + 1)):
            if not (0 <= rr < a.shape[0] and 0 <= cc < a.shape[1]) or out[rr, cc] or not canopy[rr, cc]:
                continue
            d = hypot(rr - pr, cc - pc) * res
            if d > farthest or d > 1.35 * local[label - 1] or z[rr, cc] > z[r, c] + drop:
                continue
            energy = alpha * (top - float(z[rr, cc])) / top + beta * float(slope[rr, cc]) / steep + gamma * d / farthest
            if energy <= most_energy:
                out[rr, cc] = label
                heapq.heappush(heap, (-float(z[rr, cc]), label, rr, cc))
    return out


def outlines(labels: np.ndarray, xmin: float, ymax: float, res: float) -> dict[int, list[list[tuple[float, float]]]]:
    """Rings of each label's cells (four-connected), corners only, outer ones anticlockwise and holes clockwise."""
    out: dict[int, list[list[tuple[float, float]]]] = {}
    for label in np.unique(labels[labels > 0]).tolist():
        edges: dict[tuple[int, int], list[tuple[int, int]]] = {}
        inside = labels == label
        for r, c in np.argwhere(inside).tolist():
            for dr, dc, a, b in ((-1, 0, (r, c + 1), (r, c)), (1, 0, (r + 1, c), (r + 1, c + 1)), (0, -1, (r, c), (r + 1, c)), (0, 1, (r + 1, c + 1), (r, c + 1))):
                rr, cc = r + dr, c + dc
                if not (0 <= rr < labels.shape[0] and 0 <= cc < labels.shape[1] and inside[rr, cc]):
                    edges.setdefault(a, []).append(b)
        rings = []
        while edges:
            start = min(edges)
            ring, at, before = [start], start, None
            while True:
                choices = edges[at]
                pick = 0
                if len(choices) > 1 and before is not None:  # two corners touch: turn left, so that rings stay apart
                    way = (at[0] - before[0], at[1] - before[1])
                    pick = max(range(len(choices)), key=lambda i: way[1] * (at[0] - choices[i][0]) - way[0] * (at[1] - choices[i][1]))
                nxt = choices.pop(pick)
                if not choices:
                    del edges[at]
                before, at = at, nxt
                if at == start:
                    break
                ring.append(at)
            m = len(ring)
            ring = [ring[i] for i in range(m) if (ring[i][0] - ring[i - 1][0]) * (ring[(i + 1) % m][1] - ring[i][1]) != (ring[i][1] - ring[i - 1][1]) * (ring[(i + 1) % m][0] - ring[i][0])]
            rings.append([(xmin + c * res, ymax - r * res) for r, c in ring])
        out[label] = rings
    return out


def circle_offsets(radius: float, n: int = 8) -> list[tuple[float, float]]:
    """The centre, and n places on a circle around it."""
    return [(0.0, 0.0)] + [(radius * cos(2 * pi * i / n), radius * cos(2 * pi * i / n - pi / 2)) for i in range(n)]
