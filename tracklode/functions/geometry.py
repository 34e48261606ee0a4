"""Plane geometry on small arrays of points, for use inside tasks."""

from __future__ import annotations

import numpy as np


def area(polygon: np.ndarray) -> float:
    """Signed: positive for counter-clockwise corners."""
    x, y = polygon[:, 0], polygon[:, 1]
    return float((x * np.roll(y, -1) - y * np.roll(x, -1)).sum() / 2) if len(polygon) > 2 else 0.0


def convex_hull(points: np.ndarray) -> np.ndarray:
    """Corners in counter-clockwise order from the lowest x (then y); points on edges are left out."""
    p = np.unique(points, axis=0)
    if len(p) < 3:
        return p

    def chain(some: np.ndarray) -> list[np.ndarray]:
        out: list[np.ndarray] = []
        for q in some:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (q[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (q[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(q)
        return out

    return np.array(chain(p)[:-1] + chain(p[::-1])[:-1])


def clipped(polygon: np.ndarray, convex: np.ndarray) -> np.ndarray:
    """The part of a polygon inside a convex one (counter-clockwise)."""
    for a, b in zip(convex, np.roll(convex, -1, axis=0), strict=True):
        if not len(polygon):
            break
        side = (b[0] - a[0]) * (polygon[:, 1] - a[1]) - (b[1] - a[1]) * (polygon[:, 0] - a[0])
        ahead, next_side = np.roll(polygon, -1, axis=0), np.roll(side, -1)
        out = []
        for p, q, s, t in zip(polygon, ahead, side, next_side, strict=True):
            if s >= 0:
                out.append(p)
            if (s > 0 > t) or (s < 0 < t):
                out.append(p + (q - p) * (s / (s - t)))
        polygon = np.array(out).reshape(-1, 2)
    return polygon


def overlap(a: np.ndarray, b: np.ndarray) -> float:
    """Common area of two convex polygons as a share of the smaller; 0 if that is empty."""
    smaller = min(abs(area(a)), abs(area(b)))
    return abs(area(clipped(a, b))) / smaller if smaller > 1e-9 else 0.0


def widened(line: np.ndarray, half_width: float) -> np.ndarray:
    """The points of a line of two or more, moved by half_width to its left, then to its right."""
    way = np.empty_like(line)
    way[0], way[-1], way[1:-1] = line[1] - line[0], line[-1] - line[-2], line[2:] - line[:-2]
    length = np.hypot(way[:, 0], way[:, 1])
    left = np.zeros_like(line)
    ok = length > 1e-9
    left[ok] = np.stack([-way[ok, 1], way[ok, 0]], axis=1) / length[ok, None] * half_width
    return np.concatenate([line + left, line - left])


def crossing(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether some segment of line a cuts some segment of line b inside both."""
    p, q, r, s = a[:-1, None], a[1:, None], b[None, :-1], b[None, 1:]
    turn = lambda u, v, w: (v[..., 0] - u[..., 0]) * (w[..., 1] - u[..., 1]) - (v[..., 1] - u[..., 1]) * (w[..., 0] - u[..., 0])
    return bool(((turn(p, q, r) * turn(p, q, s) < 0) & (turn(r, s, p) * turn(r, s, q) < 0)).any())
