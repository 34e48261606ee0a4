"""Signed distances of boxes to road edges, whose left side is the road: positive off the road, negative on it."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .mapmatch import PAIRS, in_blocks, table_arrays

# How much heights count in the choice of the nearest segment.
Z_STRETCH = 3.0


def edge_chain(edges: DataFrame, keys: list[str], edge: str, points: str) -> DataFrame:
    """keys, edge, segment, x0, y0, z0, ux, uy, uz and the directions of the segments before (px, py) and after (nx, ny) it, null at ends."""
    n = F.size(points)
    spread = edges.where(n >= 2).select(*keys, edge, F.posexplode(F.arrays_zip(F.slice(F.col(points), 1, n - 1).alias("a"), F.slice(F.col(points), 2, n - 1).alias("b"))).alias("segment", "p"))
    d = {f"u{c}": F.col(f"p.b.{c}") - F.col(f"p.a.{c}") for c in "xyz"}
    got = spread.select(*keys, edge, "segment", *[F.col(f"p.a.{c}").alias(f"{c}0") for c in "xyz"], *[v.alias(k) for k, v in d.items()])
    way = Window.partitionBy(*keys, edge).orderBy("segment")
    return got.withColumns({**{f"p{c}": F.lag(f"u{c}").over(way) for c in "xy"}, **{f"n{c}": F.lead(f"u{c}").over(way) for c in "xy"}})


def nearest_signed(x: np.ndarray, y: np.ndarray, z: np.ndarray, chain: dict[str, np.ndarray], reach: float, z_stretch: float) -> np.ndarray:
    """Signed distances of points to the nearest segment of a chain in the order of edge and segment; NaN where none has a distance.

    Points look at the segments near their block first; those with nothing within reach look at all.
    """
    best, number = np.full(len(x), np.inf), np.full(len(x), -1)
    ends = np.stack([chain["x0"] + chain["ux"], chain["y0"] + chain["uy"]], 1)
    starts = np.stack([chain["x0"], chain["y0"]], 1)

    def look(at: np.ndarray, near: np.ndarray) -> None:
        x0, y0, z0, ux, uy, uz = (chain[c][near] for c in ("x0", "y0", "z0", "ux", "uy", "uz"))
        dx, dy, dz = x[at, None] - x0, y[at, None] - y0, z[at, None] - z0
        f = np.clip((dx * ux + dy * uy) / np.maximum(ux * ux + uy * uy, 1e-10), 0.0, 1.0)
        up = z_stretch * (dz - f * uz)
        d = np.sqrt((dx - f * ux) ** 2 + (dy - f * uy) ** 2 + up * up)
        d = np.where(np.isnan(d), np.inf, d)
        k = d.argmin(1)
        best[at], number[at] = d[np.arange(len(k)), k], near[k]

    for block, near in in_blocks(x, y, np.fmin(starts, ends), np.fmax(starts, ends), reach + 1e-6):
        if len(near):
            look(np.arange(block.start, min(block.stop, len(x))), near)
    rest = np.flatnonzero(~(best <= reach))
    every, step = np.arange(len(starts)), max(1, PAIRS // max(1, len(starts)))
    for a in range(0, len(rest) if len(every) else 0, step):
        look(rest[a : a + step], every)
    out, known = np.full(len(x), np.nan), np.flatnonzero(np.isfinite(best))
    x0, y0, ux, uy, px, py, nx, ny = (chain[c][number[known]] for c in ("x0", "y0", "ux", "uy", "px", "py", "nx", "ny"))
    dx, dy = x[known] - x0, y[known] - y0
    t = (dx * ux + dy * uy) / np.maximum(ux * ux + uy * uy, 1e-10)
    f = np.clip(t, 0.0, 1.0)
    side = np.sign(dx * uy - dy * ux)
    # Sides of the neighbours, and whether the chain turns left there.
    before, after = np.sign((dx + px) * py - (dy + py) * px), np.sign((dx - ux) * ny - (dy - uy) * nx)
    both = lambda other, left: np.where(left, np.maximum(side, other), np.minimum(side, other))
    sign = np.where((t < 0) & ~np.isnan(px), both(before, px * uy - py * ux > 0), np.where((t > 1) & ~np.isnan(nx), both(after, ux * ny - uy * nx > 0), side))
    out[known] = sign * np.sqrt((dx - f * ux) ** 2 + (dy - f * uy) ** 2)
    return out


def per_scene(own: DataFrame, chain: DataFrame, keys: list[str], rows: list[str], edge: str, columns: list[str], f: Callable[..., np.ndarray]) -> DataFrame:
    """keys, rows, distance: f of the columns of a scene's rows and of its chain; NaN becomes null.

    keys must name scenes of bounded size: one grouped function holds a scene's rows and chain, and no pair of them leaves it.
    """
    numbers = ["x0", "y0", "z0", "ux", "uy", "uz", "px", "py", "nx", "ny"]
    own = own.select(*keys, *rows, *columns)
    chain = chain.select(*keys, edge, "segment", *numbers).where(" and ".join(f"`{k}` is not null" for k in keys))
    chain = chain.toDF(*chain.columns)  # rows and edges may come from one table
    kinds = {c.name: c.dataType.simpleString() for c in own.schema}

    def run(part: pa.Table, lines: pa.Table) -> pa.Table:
        part = part.sort_by([(c, "ascending") for c in rows])  # neighbours in time are near each other
        lines = lines.sort_by([(edge, "ascending"), ("segment", "ascending")])
        with np.errstate(all="ignore"):
            d = f(*table_arrays(part, *columns), dict(zip(numbers, table_arrays(lines, *numbers), strict=True)))
        return pa.table([*(part.column(k) for k in (*keys, *rows)), pa.array(d, mask=np.isnan(d))], names=[*keys, *rows, "distance"])

    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in (*keys, *rows)), "distance double"])
    return own.groupBy(*keys).cogroup(chain.groupBy(*keys)).applyInArrow(run, schema)


def signed_distances(points: DataFrame, chain: DataFrame, keys: list[str], rows: list[str], edge: str, reach: float = 16.0, z_stretch: float = Z_STRETCH) -> DataFrame:
    """keys, rows, distance: of each point (keys, rows, x, y, z) to the nearest segment of its scene, in the plane; null without any.

    The nearest segment is that of least distance with heights stretched, ties to the first. Its side gives the sign; a point
    before its start or behind its end also asks the neighbour there: off the road if either says so at a left turn, if both do at
    a right turn.
    """
    return per_scene(points, chain, keys, rows, edge, ["x", "y", "z"], lambda x, y, z, lines: nearest_signed(x, y, z, lines, reach, z_stretch))


def road_edge_distances(boxes: DataFrame, chain: DataFrame, keys: list[str], rows: list[str], edge: str, reach: float = 16.0, z_stretch: float = Z_STRETCH) -> DataFrame:
    """keys, rows, distance: the signed distance of the lower corner that is farthest off the road, of each box (x, y, z of the middle, length, width, height, heading)."""

    def farthest(x, y, z, length, width, height, heading, lines) -> np.ndarray:
        c, s = np.cos(heading), np.sin(heading)
        signs = ((1, 1), (-1, 1), (-1, -1), (1, -1))
        px = np.stack([x + i * length / 2 * c - j * width / 2 * s for i, j in signs], 1).ravel()
        py = np.stack([y + i * length / 2 * s + j * width / 2 * c for i, j in signs], 1).ravel()
        return np.fmax.reduce(nearest_signed(px, py, np.repeat(z - height / 2, 4), lines, reach, z_stretch).reshape(-1, 4), axis=1)

    return per_scene(boxes, chain, keys, rows, edge, ["x", "y", "z", "length", "width", "height", "heading"], farthest)
