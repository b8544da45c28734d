"""Numeric kernels on NumPy: filters, smoothers, splines, assignment, triangulation."""

from __future__ import annotations

import math

import numpy as np


def one_euro(v: np.ndarray, t: np.ndarray, min_cutoff: np.ndarray | float = 1.0, beta: np.ndarray | float = 0.007, d_cutoff: float = 1.0, state: dict | None = None) -> np.ndarray:
    """The One-Euro filter of columns of ``v`` (frames x channels) at times ``t``; NaN stays NaN and leaves the state.

    ``state`` (x, dx, t by channel) carries the filter from one call to the next.
    """
    n, k = v.shape
    s = {"x": np.full(k, np.nan), "dx": np.zeros(k), "t": np.full(k, np.nan), "rate": np.full(k, np.nan)} if state is None else state
    out = np.full_like(v, np.nan, dtype=float)

    def alpha(cutoff, rate):
        return 1.0 / (1.0 + rate / (2 * math.pi * cutoff))

    for i in range(n):
        ok = ~np.isnan(v[i])
        gap = t[i] - s["t"]
        s["rate"] = np.where(ok & (gap > 0), 1.0 / np.where(gap > 0, gap, 1.0), s["rate"])
        first = ok & np.isnan(s["x"])
        rate = np.where(np.isnan(s["rate"]), 1.0, s["rate"])
        dx = np.where(first, 0.0, (v[i] - s["x"]) * rate)
        a = alpha(d_cutoff, rate)
        edx = np.where(first, 0.0, a * dx + (1 - a) * s["dx"])
        a = alpha(np.maximum(min_cutoff + beta * np.abs(edx), 1e-12), rate)
        x = np.where(first, v[i], a * v[i] + (1 - a) * s["x"])
        out[i] = np.where(ok, x, np.nan)
        s["x"], s["dx"], s["t"] = np.where(ok, x, s["x"]), np.where(ok, edx, s["dx"]), np.where(ok, t[i], s["t"])
    return out


def butterworth(order: int, cutoff: float) -> tuple[np.ndarray, np.ndarray]:
    """Low-pass coefficients (b, a) for a cutoff in units of the Nyquist rate: bilinear transform of the analogue prototype."""
    warped = 4 * math.tan(math.pi * cutoff / 2)
    poles = warped * np.exp(1j * math.pi * (2 * np.arange(1, order + 1) + order - 1) / (2 * order))
    z = (4 + poles) / (4 - poles)
    a = np.real(np.poly(z))
    b = np.real(np.poly(-np.ones(order)))
    return b * a.sum() / b.sum(), a


def _run_filter(b: np.ndarray, a: np.ndarray, x: np.ndarray, zi: np.ndarray) -> np.ndarray:
    """Direct form II transposed along axis 0, columns together."""
    z = zi.copy()
    y = np.empty_like(x)
    for i in range(len(x)):
        y[i] = b[0] * x[i] + z[0]
        for k in range(len(z) - 1):
            z[k] = b[k + 1] * x[i] + z[k + 1] - a[k + 1] * y[i]
        z[-1] = b[-1] * x[i] - a[-1] * y[i]
    return y


def filtfilt(b: np.ndarray, a: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Zero-phase filtering of columns with odd padding of three filter lengths and steady initial states."""
    pad = 3 * max(len(a), len(b))
    m = len(a) - 1
    companion = np.eye(m, k=1)
    companion[:, 0] -= a[1:]
    zi = np.linalg.solve(np.eye(m) - companion, b[1:] - a[1:] * b[0])[:, None]
    ext = np.concatenate([2 * x[:1] - x[pad:0:-1], x, 2 * x[-1:] - x[-2 : -pad - 2 : -1]])
    y = _run_filter(b, a, ext, zi * ext[:1])
    y = _run_filter(b, a, y[::-1], zi * y[-1:])[::-1]
    return y[pad:-pad]


def butter_smooth(v: np.ndarray, fps: float, cutoff: float = 6.0, order: int = 2) -> np.ndarray:
    """Zero-phase Butterworth of columns; gaps are bridged for the filter and stay gaps. 35 frames or fewer pass through."""
    n = len(v)
    if n <= 35:
        return v.copy()
    b, a = butterworth(order, min(cutoff / (fps / 2), 0.99))
    frames, out = np.arange(n), v.copy()
    ok = ~np.isnan(v)
    some = ok.any(axis=0)
    full = np.stack([np.interp(frames, frames[ok[:, k]], v[ok[:, k], k]) for k in np.flatnonzero(some)], 1) if some.any() else np.zeros((n, 0))
    out[:, some] = filtfilt(b, a, full) if full.shape[1] else full
    out[~ok] = np.nan
    return out


def rts(v: np.ndarray, fps: float, q: float = 1.0, r: float = 10.0) -> np.ndarray:
    """Rauch-Tung-Striebel smoothing of a point (frames x dims) with a constant-velocity model; all dims share one covariance.

    Frames before the first sample take it, smoothing starts at the last valid frame, frames after it keep the prediction.
    """
    n, dims = v.shape
    ok = ~np.isnan(v).any(axis=1)
    if not ok.any():
        return np.full_like(v, np.nan)
    dt = 1.0 / fps
    f, noise = np.array([[1, dt], [0, 1.0]]), q * q * np.diag([dt**4 / 4, dt**2])
    x, p = np.zeros((2, dims)), 1000.0 * np.eye(2)
    xs, ps, xp, pp = np.zeros((n, 2, dims)), np.zeros((n, 2, 2)), np.zeros((n, 2, dims)), np.zeros((n, 2, 2))
    first, last = int(np.argmax(ok)), n - 1 - int(np.argmax(ok[::-1]))
    x[0] = v[first]
    for i in range(first, n):
        if i > first:
            x, p = f @ x, f @ p @ f.T + noise
        xp[i], pp[i] = x, p
        if ok[i]:
            gain = p[:, 0] / (p[0, 0] + r * r)
            x = x + gain[:, None] * (v[i] - x[0])
            p = p - np.outer(gain, p[0])
        xs[i], ps[i] = x, p
    for i in range(last - 1, first - 1, -1):
        if np.linalg.det(pp[i + 1]) ** 3 < 1e-12:
            continue
        g = ps[i] @ f.T @ np.linalg.inv(pp[i + 1])
        xs[i] = xs[i] + g @ (xs[i + 1] - xp[i + 1])
    xs[:first] = xs[first]
    return xs[:, 0]


def natural_spline(x: np.ndarray, y: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The natural cubic spline through (x, y); end pieces extrapolate."""
    h, n = np.diff(x), len(x)
    m = np.zeros(n)
    if n > 2:
        sub, diag, rhs = h[1:-1], 2 * (h[:-1] + h[1:]), 6 * (np.diff(y[1:]) / h[1:] - np.diff(y[:-1]) / h[:-1])
        c, d = np.zeros(n - 2), np.zeros(n - 2)
        for i in range(n - 2):
            low = sub[i - 1] if i else 0.0
            w = diag[i] - low * (c[i - 1] if i else 0.0)
            c[i] = (sub[i] if i < n - 3 else 0.0) / w
            d[i] = (rhs[i] - low * (d[i - 1] if i else 0.0)) / w
        for i in range(n - 3, -1, -1):
            m[i + 1] = d[i] - c[i] * (m[i + 2] if i < n - 3 else 0.0)
    k = np.clip(np.searchsorted(x, at, "right") - 1, 0, n - 2)
    a, b = x[k + 1] - at, at - x[k]
    return (m[k] * a**3 + m[k + 1] * b**3) / (6 * h[k]) + (y[k] / h[k] - m[k] * h[k] / 6) * a + (y[k + 1] / h[k] - m[k + 1] * h[k] / 6) * b


def fill_cubic(v: np.ndarray, max_gap: int = 30) -> np.ndarray:
    """All gaps of a channel filled: by a spline through its samples; across gaps over ``max_gap`` only their ends are knots."""
    at = np.flatnonzero(~np.isnan(v))
    if len(at) < 4:
        return np.interp(np.arange(len(v)), at, v[at]) if len(at) >= 2 else v.copy()
    gaps = np.flatnonzero(np.diff(at) - 1 > max_gap)
    knots = at if not len(gaps) else np.unique(np.concatenate([at[[0, -1]], at[gaps], at[gaps + 1]]))
    hole = np.flatnonzero(np.isnan(v))
    out = v.copy()
    out[hole] = natural_spline(knots.astype(float), v[knots], hole.astype(float)) if len(knots) >= 4 else np.interp(hole, at, v[at])
    return out


def assign(cost: np.ndarray, penalty: float | None = None) -> list[tuple[int, int]]:
    """The assignment of least total cost (row, column), by shortest augmenting paths; infinite costs are never chosen."""
    rows, cols = cost.shape
    if not rows or not cols:
        return []
    finite = np.isfinite(cost)
    keep = np.flatnonzero(finite.any(axis=1)), np.flatnonzero(finite.any(axis=0))
    if len(keep[0]) < rows or len(keep[1]) < cols:  # rows and columns without a finite cost take no part
        return [(int(keep[0][i]), int(keep[1][j])) for i, j in assign(cost[np.ix_(*keep)], penalty)]
    big = penalty if penalty is not None else (abs(cost[finite]).max() if finite.any() else 0.0) * 10 + 1e6
    n = max(rows, cols)
    c = np.full((n, n), big)
    c[:rows, :cols] = np.where(finite, cost, big)
    u, v = np.zeros(n + 1), np.zeros(n + 1)
    owner, way = np.zeros(n + 1, int), np.zeros(n + 1, int)
    for i in range(1, n + 1):
        owner[0], j0 = i, 0
        least, used = np.full(n + 1, np.inf), np.zeros(n + 1, bool)
        while True:
            used[j0] = True
            free = ~used[1:]
            now = c[owner[j0] - 1] - u[owner[j0]] - v[1:]
            better = free & (now < least[1:])
            least[1:][better], way[1:][better] = now[better], j0
            j1 = 1 + int(np.argmin(np.where(free, least[1:], np.inf)))
            step = least[j1]
            u[owner[used]] += step
            v[used] -= step
            least[~used] -= step
            j0 = j1
            if owner[j0] == 0:
                break
        while j0:
            owner[j0], j0 = owner[way[j0]], way[j0]
    return sorted((int(owner[j]) - 1, j - 1) for j in range(1, n + 1) if owner[j] <= rows and j <= cols and finite[owner[j] - 1, j - 1])


def assigned_means(d: np.ndarray, rows: np.ndarray, cols: np.ndarray) -> np.ndarray:
    """For each matrix of ``d`` (b, n, m), of which ``rows`` by ``cols`` count, the mean of the assignment of least total cost.

    Shortest augmenting paths in all matrices at once: rows start at their least column where it is free, each pass adds
    the next row without a column in every matrix that has one, and every round of a pass scans one row of each.
    """
    wide = rows <= cols
    n, m = np.where(wide, rows, cols), np.where(wide, cols, rows)
    size = (int(n.max(initial=0)), int(m.max(initial=0)))
    c = np.full((len(d), *size), np.inf)
    for turn, lanes in ((False, np.flatnonzero(wide)), (True, np.flatnonzero(~wide))):
        part = d[lanes].transpose(0, 2, 1) if turn else d[lanes]
        c[lanes, : part.shape[1], : part.shape[2]] = part[:, : size[0], : size[1]]
    real = np.arange(size[0]) < n[:, None]
    c[~(real[:, :, None] & (np.arange(size[1]) < m[:, None])[:, None])] = np.inf
    u, v = np.where(real, c.min(axis=2, initial=np.inf), 0.0), np.zeros((len(d), size[1]))
    of_row, of_col = np.full(c.shape[:2], -1), np.full(v.shape, -1)
    every = np.arange(len(d))
    for i in range(size[0]):
        j = c[:, i].argmin(axis=1)
        at = every[real[:, i] & (of_col[every, j] < 0)]
        of_row[at, i], of_col[at, j[at]] = j[at], i
    todo = real & (of_row < 0)
    nth = todo.cumsum(axis=1)
    for k in range(1, int(todo.sum(axis=1).max(initial=0)) + 1):
        lane = every[nth[:, -1] >= k]
        start = (nth[lane] >= k).argmax(axis=1)
        path, short, done = np.full((len(lane), size[1]), -1), np.full((len(lane), size[1]), np.inf), np.zeros((len(lane), size[1]), bool)
        row, least, sink = start.copy(), np.zeros(len(lane)), np.full(len(lane), -1)
        on = np.arange(len(lane))
        while len(on):
            at, i = lane[on], row[on]
            now = c[at, i] + (least[on] - u[at, i])[:, None] - v[at]
            before, closed = short[on], done[on]
            better = (now < before) & ~closed
            before = np.where(better, now, before)
            short[on], path[on] = before, np.where(better, i[:, None], path[on])
            j = np.where(closed, np.inf, before).argmin(axis=1)
            least[on], done[on, j] = before[np.arange(len(on)), j], True
            owner = of_col[at, j]
            sink[on[owner < 0]] = j[owner < 0]
            row[on] = owner
            on = on[owner >= 0]
        rise = np.where(done, least[:, None] - np.where(done, short, 0.0), 0.0)
        x, j = np.nonzero(done & (of_col[lane] >= 0))
        u[lane[x], of_col[lane[x], j]] += rise[x, j]
        u[lane, start] += least
        v[lane] -= rise
        on, j = np.arange(len(lane)), sink
        while len(on):
            i = path[on, j]
            of_col[lane[on], j] = i
            before = of_row[lane[on], i]
            of_row[lane[on], i] = j
            on, j = on[i != start[on]], before[i != start[on]]
    picked = np.where(of_row >= 0, np.take_along_axis(c, np.maximum(of_row, 0)[:, :, None], axis=2)[:, :, 0], 0.0)
    return picked.sum(axis=1) / n


def triangulate(p: np.ndarray, uv: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Points from views: ``p`` (n, c, 3, 4), ``uv`` (n, c, 2), ``weight`` (n, c); missing views have weight 0. NaN where degenerate."""
    w = weight[..., None]
    rows = np.concatenate([w * (uv[..., :1] * p[:, :, 2] - p[:, :, 0]), w * (uv[..., 1:] * p[:, :, 2] - p[:, :, 1])], axis=1)
    x = np.linalg.svd(rows)[2][:, -1]
    ok = np.abs(x[:, 3]) >= 1e-10
    return np.where(ok[:, None], x[:, :3] / np.where(ok, x[:, 3], 1.0)[:, None], np.nan)


def fundamental(ka, rta, kb, rtb) -> np.ndarray:
    """The fundamental matrix that maps pixels of camera a to lines of camera b, of unit norm."""
    ka, kb, rta, rtb = (np.asarray(m, float) for m in (ka, kb, rta, rtb))
    r = rtb[:, :3] @ rta[:, :3].T
    t = rtb[:, 3] - r @ rta[:, 3]
    tx = np.array([[0, -t[2], t[1]], [t[2], 0, -t[0]], [-t[1], t[0], 0]])
    f = np.linalg.inv(kb).T @ tx @ r @ np.linalg.inv(ka)
    size = np.linalg.norm(f)
    return f / size if size > 0 else f


def fundamental_of(pa, pb) -> np.ndarray:
    """The fundamental matrix of two 3x4 projections, from pixels of the first to lines of the second, of unit norm."""
    pa, pb = (np.asarray(m, float).reshape(3, 4) for m in (pa, pb))
    centre = np.linalg.svd(pa)[2][-1]
    e = pb @ centre
    f = np.array([[0, -e[2], e[1]], [e[2], 0, -e[0]], [-e[1], e[0], 0]]) @ pb @ np.linalg.pinv(pa)
    size = np.linalg.norm(f)
    return f / size if size > 0 else f


def distort(xy: np.ndarray, d: np.ndarray) -> np.ndarray:
    """Normalised points (n, 2) as a lens bends them; ``d`` (n, 8): k1, k2, p1, p2, k3, k4, k5, k6."""
    x, y = xy[:, 0], xy[:, 1]
    k1, k2, p1, p2, k3, k4, k5, k6 = d.T
    r = x * x + y * y
    radial = (1 + r * (k1 + r * (k2 + r * k3))) / (1 + r * (k4 + r * (k5 + r * k6)))
    return np.stack([x * radial + 2 * p1 * x * y + p2 * (r + 2 * x * x), y * radial + p1 * (r + 2 * y * y) + 2 * p2 * x * y], 1)


def undistort(xy: np.ndarray, d: np.ndarray, passes: int = 100, tolerance: float = 1e-11) -> np.ndarray:
    """The points that ``distort`` bends to ``xy``, by fixed-point iteration. Points that do not settle, or to which the lens
    does not lead back, are NaN."""
    k1, k2, p1, p2, k3, k4, k5, k6 = d.T
    out, todo = xy.astype(float).copy(), np.arange(len(xy))
    done = np.zeros(len(xy), bool)
    for _ in range(passes):
        if not len(todo):
            break
        x, y = out[todo].T
        own = [k[todo] for k in (k1, k2, p1, p2, k3, k4, k5, k6)]
        r = x * x + y * y
        with np.errstate(all="ignore"):
            scale = (1 + r * (own[5] + r * (own[6] + r * own[7]))) / (1 + r * (own[0] + r * (own[1] + r * own[4])))
            nx = (xy[todo, 0] - 2 * own[2] * x * y - own[3] * (r + 2 * x * x)) * scale
            ny = (xy[todo, 1] - own[2] * (r + 2 * y * y) - 2 * own[3] * x * y) * scale
            change = np.hypot(nx - x, ny - y)
        out[todo] = np.stack([nx, ny], 1)
        done[todo[change <= tolerance]] = True
        todo = todo[(change > tolerance) & np.isfinite(change)]
    with np.errstate(all="ignore"):
        done &= np.hypot(*(distort(out, d) - xy).T) < 1e-8
    out[~done] = np.nan
    return out


def reprojection(p: np.ndarray, uv: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Pixels between every view ``uv`` (n, c, 2) and the projection by ``p`` (n, c, 3, 4) of the points ``x``; NaN at no depth."""
    h = p[..., :3] @ x[:, None, :, None] + p[..., 3:]
    depth = np.where(np.abs(h[..., 2, 0]) > 1e-10, h[..., 2, 0], np.nan)
    return np.sqrt((uv[..., 0] - h[..., 0, 0] / depth) ** 2 + (uv[..., 1] - h[..., 1, 0] / depth) ** 2)


def triangulate_robust(p: np.ndarray, uv: np.ndarray, weight: np.ndarray, seen: np.ndarray, reject: float | None = None, least: int = 2) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Points, errors by view and which views were used. While a view of a point is off by more than ``reject`` pixels and
    more than ``least`` are left, the view goes without which the others agree best (a wrong view spoils the errors of all)."""
    seen = seen.copy()

    def solved(at, there):
        x = triangulate(p[at], uv[at], weight[at] * there)
        return x, np.where(there, reprojection(p[at], uv[at], x), np.nan)

    every = np.arange(len(seen))
    x, err = solved(every, seen)
    todo = every if reject is not None else every[:0]
    while True:
        todo = todo[(np.nan_to_num(err[todo], nan=-1.0) > reject).any(axis=1) & (seen[todo].sum(1) > least)] if len(todo) else todo
        if not len(todo):
            return x, err, seen
        rest = np.full((len(todo), seen.shape[1]), np.inf)
        for view in range(seen.shape[1]):
            has = seen[todo, view]
            there = seen[todo[has]].copy()
            there[:, view] = False
            others = solved(todo[has], there)[1]
            rest[has, view] = np.where(there, np.nan_to_num(others, nan=np.inf), 0.0).sum(1) / there.sum(1)
        seen[todo, np.argmin(rest, axis=1)] = False
        x[todo], err[todo] = solved(todo, seen[todo])


def iou(a, b) -> float:
    inter = max(0.0, min(a[2], b[2]) - max(a[0], b[0])) * max(0.0, min(a[3], b[3]) - max(a[1], b[1]))
    area = lambda x: max(1.0, (x[2] - x[0]) * (x[3] - x[1]))
    return inter / (area(a) + area(b) - inter)


def ious(a: list, b: list) -> np.ndarray:
    """Overlaps of every box of ``a`` with every box of ``b``."""
    if not a or not b:
        return np.zeros((len(a), len(b)))
    p, q = np.asarray(a, float)[:, None], np.asarray(b, float)[None]
    side = np.maximum(np.minimum(p[..., 2:], q[..., 2:]) - np.maximum(p[..., :2], q[..., :2]), 0)
    area = lambda x: np.maximum((x[..., 2] - x[..., 0]) * (x[..., 3] - x[..., 1]), 1.0)
    inter = side[..., 0] * side[..., 1]
    return inter / (area(p) + area(q) - inter)


def pearson_p(r: float, n: int) -> float:
    """Two-sided p-value of a correlation, by the continued fraction of the incomplete beta function."""
    if n < 3 or math.isnan(r):
        return math.nan
    if r == 0:
        return 1.0
    if abs(r) >= 1:
        return 0.0
    a, b = (n - 2) / 2, 0.5
    x = 1 - r * r

    def fraction(a, b, x):
        c, d = 1.0, 1 - (a + b) * x / (a + 1)
        d = 1 / (d if abs(d) > 1e-300 else 1e-300)
        h = d
        for m in range(1, 300):
            for top in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
                d = 1 / ((1 + top * d) or 1e-300)
                c = (1 + top / c) or 1e-300
                h *= d * c
            if abs(d * c - 1) < 1e-14:
                break
        return h

    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    return front * fraction(a, b, x) / a if x < (a + 1) / (a + b + 2) else 1 - front * fraction(b, a, 1 - x) / b
