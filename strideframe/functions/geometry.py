"""Geometry as column expressions; they compile into the surrounding stage."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def norm(*parts) -> Column:
    """The length of a vector; null if any part is."""
    total = None
    for p in parts:
        sq = col(p) * col(p)
        total = sq if total is None else total + sq
    return F.sqrt(total)


def valid(*parts) -> Column:
    """No part is missing."""
    out = None
    for p in parts or ("x", "y", "z"):
        out = col(p).isNotNull() if out is None else out & col(p).isNotNull()
    return out


def project(p, x, y, z, guard: float = 1e-10) -> tuple[Column, Column]:
    """Pixel of a point by a row-major 3x4 projection array; null where the depth is almost zero."""
    row = [F.get(col(p), 4 * r) * col(x) + F.get(col(p), 4 * r + 1) * col(y) + F.get(col(p), 4 * r + 2) * col(z) + F.get(col(p), 4 * r + 3) for r in range(3)]
    ok = F.abs(row[2]) > guard
    return F.when(ok, row[0] / row[2]), F.when(ok, row[1] / row[2])


def iou(ax1, ay1, ax2, ay2, bx1, by1, bx2, by2) -> Column:
    """Intersection over union of two boxes, areas at least one."""
    a1, b1, a2, b2, c1, d1, c2, d2 = map(col, (ax1, ay1, ax2, ay2, bx1, by1, bx2, by2))
    w = F.greatest(F.least(a2, c2) - F.greatest(a1, c1), F.lit(0.0))
    h = F.greatest(F.least(b2, d2) - F.greatest(b1, d1), F.lit(0.0))
    inter = w * h
    area = lambda x1, y1, x2, y2: F.greatest((x2 - x1) * (y2 - y1), F.lit(1.0))
    return inter / F.greatest(area(a1, b1, a2, b2) + area(c1, d1, c2, d2) - inter, F.lit(1.0))


def distortion_weight(u, v, width: float, height: float, power: float = 2.0) -> Column:
    """1 / (1 + (distance from the image centre / half diagonal) ^ power)."""
    half = (width**2 + height**2) ** 0.5 / 2
    return 1 / (1 + F.pow(norm(col(u) - width / 2, col(v) - height / 2) / half, F.lit(power)))


def epipolar_distance(f: list[float], ua, va, ub, vb) -> Column:
    """Distance in pixels of (ub, vb) from the epipolar line of (ua, va) by a row-major 3x3 matrix."""
    line = [f[3 * r] * col(ua) + f[3 * r + 1] * col(va) + f[3 * r + 2] for r in range(3)]
    length = F.sqrt(line[0] * line[0] + line[1] * line[1])
    return F.when(length >= 1e-10, F.abs(line[0] * col(ub) + line[1] * col(vb) + line[2]) / length)


def sampson_distance(f: list[float], ua, va, ub, vb) -> Column:
    """The first-order distance of a pair of pixels from the epipolar constraint."""
    fx = [f[3 * r] * col(ua) + f[3 * r + 1] * col(va) + f[3 * r + 2] for r in range(3)]
    ft = [f[r] * col(ub) + f[3 + r] * col(vb) + f[6 + r] for r in range(3)]
    e = col(ub) * fx[0] + col(vb) * fx[1] + fx[2]
    return F.sqrt(e * e / F.greatest(fx[0] * fx[0] + fx[1] * fx[1] + ft[0] * ft[0] + ft[1] * ft[1], F.lit(1e-12)))


def in_frustum(x, y, z, cx, cy, cz, dx, dy, dz, h_fov, v_fov) -> Column:
    """Within a camera's view: the cone of its larger half angle, then the horizontal and vertical angles."""
    px, py, pz = col(x) - col(cx), col(y) - col(cy), col(z) - col(cz)
    dist = F.sqrt(px * px + py * py + pz * pz)
    cos = F.greatest(F.least((px * col(dx) + py * col(dy) + pz * col(dz)) / dist, F.lit(1.0)), F.lit(-1.0))
    half = F.greatest(col(h_fov), col(v_fov)) / 2
    turn = F.degrees(F.atan2(px, pz) - F.atan2(col(dx), col(dz)))
    turn = F.abs(F.pmod(turn + 540, F.lit(360.0)) - 180)
    rise = F.abs(F.degrees(F.asin(py / dist) - F.asin(F.greatest(F.least(col(dy), F.lit(1.0)), F.lit(-1.0)))))
    return (dist < 1e-6) | ((F.degrees(F.acos(cos)) <= half) & (turn <= col(h_fov) / 2) & (rise <= col(v_fov) / 2))


def severity(value, *ladder: tuple[float, str], otherwise: str) -> Column:
    """The name of the first bound that ``value`` exceeds."""
    out = None
    for bound, name in ladder:
        out = F.when(col(value) > bound, name) if out is None else out.when(col(value) > bound, name)
    return out.otherwise(otherwise)
