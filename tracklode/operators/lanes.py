"""Lanes and boxes: nearest lane vertices, lane changes, polylines, distances between rounded boxes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.angles import to_local

# Share of the half width of a box that is rounded, and the distance that stands for "no other object".
CORNER_ROUNDING, FAR_AWAY = 0.7, 1e10
STRIP, BLOCK = 16, 256  # width of a strip in radii; points that are compared at once with 16 times as many


def lane_vertices(lanes: DataFrame, keys: list[str], lane: str, points: str) -> DataFrame:
    """keys, lane, vertex, x, y and the tangent (tx, ty: start; ux, uy: direction) of each point of lanes of two points or more."""
    n = F.size(points)
    start = F.least(F.col("vertex"), n - 2)
    at = lambda i, c: F.get(points, i)[c]
    spread = lanes.where(n >= 2).select(*keys, lane, points, F.posexplode(points).alias("vertex", "_p"))
    return spread.select(*keys, lane, "vertex", F.col("_p.x").alias("x"), F.col("_p.y").alias("y"), at(start, "x").alias("tx"), at(start, "y").alias("ty"), (at(start + 1, "x") - at(start, "x")).alias("ux"), (at(start + 1, "y") - at(start, "y")).alias("uy"))


def lane_offsets(points: DataFrame, vertices: DataFrame, keys: list[str], rows: list[str], lane: str) -> DataFrame:
    """keys, rows, lane, offset, lane_heading: the nearest lane vertex of the scene, ties to the first; left of the lane is positive.

    points: keys, rows, x, y. A scene's map is bounded, and points meet the vertices of their own scene only.
    """
    near = vertices.select(*keys, F.col(lane).alias("_lane"), "vertex", F.col("x").alias("_x"), F.col("y").alias("_y"), "tx", "ty", "ux", "uy")
    dx, dy = F.col("_x") - F.col("x"), F.col("_y") - F.col("y")
    pairs = points.select(*keys, *rows, "x", "y").join(near, keys).withColumn("_d2", dx * dx + dy * dy)
    best = pairs.groupBy(*keys, *rows, "x", "y").agg(F.min(F.struct("_d2", "_lane", "vertex", "tx", "ty", "ux", "uy")).alias("b"))
    side = F.col("b.ux") * (F.col("y") - F.col("b.ty")) - F.col("b.uy") * (F.col("x") - F.col("b.tx"))
    d = F.sqrt("b._d2")
    return best.select(*keys, *rows, F.col("b._lane").alias(lane), F.when(side >= 0, d).otherwise(-d).alias("offset"), F.atan2("b.uy", "b.ux").alias("lane_heading"))


def lane_changes(states: DataFrame, keys: list[str], frame: str, run: int = 8, start_offset: float = 0.75, crossing_offset: float = 1.25, end_heading: float = 0.08726646259971647, end_offset: float = 0.55) -> DataFrame:
    """keys, start, end, direction: lane changes of tracks.

    states: keys, frame, offset (signed distance to the nearest lane), lane_heading, heading; valid frames only. A change
    begins at a turning point of the offset near a lane, from where the offset rises (left) or falls (right) for `run`
    frames; where it stops, it jumps to the other side of the next lane; it ends once heading and offset fit that lane.
    """
    way = Window.partitionBy(*keys).orderBy(frame)
    s = states.withColumns({"_i": F.row_number().over(way), "_n": F.count(F.lit(1)).over(Window.partitionBy(*keys)), "_next": F.lead("offset").over(way)})
    s = s.withColumn("_d", F.col("_next") - F.col("offset"))
    fits = (F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.cos(F.col("heading") - F.col("lane_heading"))))) < end_heading) & (F.abs("offset") < end_offset)
    ahead = way.rowsBetween(0, run - 1)
    # From the end backwards, so that each frame adds one row: frames up to the end take the square of a track's length.
    back = Window.partitionBy(*keys).orderBy(F.desc(frame))
    on, after = back.rowsBetween(Window.unboundedPreceding, 0), back.rowsBetween(Window.unboundedPreceding, -1)
    s = s.withColumns({
        "_turns": (F.col("_i") == 1) | (F.lag("_d").over(way) * F.col("_d") < 0),
        "_up": F.min(F.col("_d")).over(ahead) > 0, "_down": F.max(F.col("_d")).over(ahead) < 0,
        "_stop_up": F.min(F.when(F.col("_d") <= 0, F.col("_i"))).over(on), "_stop_down": F.min(F.when(F.col("_d") >= 0, F.col("_i"))).over(on),
        "_fits": F.min(F.when(fits, F.struct(F.col("_i").alias("i"), F.col(frame).alias("f")))).over(after),
    })
    stop = F.when(F.col("_up"), F.col("_stop_up")).when(F.col("_down"), F.col("_stop_down"))
    begun = s.where(F.col("_turns") & (F.col("_i") + run <= F.col("_n")) & (F.abs("offset") <= start_offset)).select(*keys, F.col(frame).alias("start"), F.when(F.col("_up"), "left").otherwise("right").alias("direction"), stop.alias("_i")).where("_i is not null")
    crossing = (F.col("offset") * F.col("_next") < 0) & (F.abs("offset") >= crossing_offset) & (F.abs("_next") >= crossing_offset)
    # A change ends after the frame behind the jump.
    ends = s.withColumn("_end", F.lead("_fits").over(way)).where(crossing).select(*keys, "_i", F.col("_end.f").alias("end"))
    return begun.join(ends, [*keys, "_i"]).where("end is not null").select(*keys, "start", "end", "direction")


def in_lane_change(frames: DataFrame, changes: DataFrame, keys: list[str], frame: str) -> DataFrame:
    """frames with lane_change: left or right of the earliest change that holds the frame, else null."""
    spread = changes.select(*keys, "start", "direction", F.explode(F.sequence("start", "end")).alias(frame))
    first = spread.groupBy(*keys, frame).agg(F.min_by("direction", "start").alias("lane_change"))
    return frames.join(first, [*keys, frame], "left")


def polyline_gaps(a: Column, b: Column) -> Column:
    """Struct (mean, most, least) of the distances from the points of a to the nearest points of b; arrays of (x, y)."""
    d = lambda p, q: F.sqrt((p["x"] - q["x"]) * (p["x"] - q["x"]) + (p["y"] - q["y"]) * (p["y"] - q["y"]))
    near = F.transform(a, lambda p: F.array_min(F.transform(b, lambda q: d(p, q))))
    return F.struct((F.aggregate(near, F.lit(0.0), lambda s, x: s + x) / F.size(near)).alias("mean"), F.array_max(near).alias("most"), F.array_min(near).alias("least"))


def local_ratio(points: DataFrame, keys: list[str], radius: float, value: str, most: float) -> DataFrame:
    """keys, id, n_local, ratio: points of other ids at most radius apart within a key, and the share with 0 < value <= most among those with value > 0; 0 without any.

    points: keys, id, x, y, value; points without neighbours are left out. Strips of a key, with their borders, are compared in
    blocks of bounded size, and no pair leaves its block; the comparisons still grow with the square of the points of a neighbourhood.
    """
    strip = lambda x: F.floor(F.greatest(F.lit(-1e12), F.least(F.lit(1e12), x / (STRIP * radius))))
    x = F.col("x")
    # A strip's copies of border points reach a little further than the radius, whatever x is rounded to.
    spread = points.select(*keys, "id", "x", "y", value, strip(x).alias("_home")).where("x is not null and y is not null and not isnan(x) and not isnan(y)")
    spread = spread.withColumn("_strip", F.explode(F.array_distinct(F.array("_home", strip(x - 1.01 * radius), strip(x + 1.01 * radius)))))
    spread = spread.withColumn("_own", F.col("_strip") == F.col("_home"))
    kinds = {c.name: c.dataType.simpleString() for c in points.schema}

    def run(part: pa.Table) -> pa.Table:
        part = part.sort_by("x")
        x, y, v = (part.column(c).cast(pa.float64()).to_numpy() for c in ("x", "y", value))
        ids = pc.index_in(part.column("id"), part.column("id").unique()).to_numpy()
        own = np.flatnonzero(part.column("_own").to_numpy())
        n, known, good = (np.zeros(len(own), np.int64) for _ in range(3))
        positive, within = (v > 0).astype(np.float32), ((v > 0) & (v <= most)).astype(np.float32)
        low, high = np.searchsorted(x, x[own] - 1.01 * radius), np.searchsorted(x, x[own] + 1.01 * radius, "right")
        for a in range(0, len(own), BLOCK):
            k = own[a : a + BLOCK]
            for b in range(low[a], high[min(a + BLOCK, len(own)) - 1], 16 * BLOCK):
                other = slice(b, min(b + 16 * BLOCK, len(x)))
                dx, dy = x[k, None] - x[other], y[k, None] - y[other]
                near = (dx * dx + dy * dy <= radius * radius) & (ids[k, None] != ids[other])
                n[a : a + BLOCK] += near.sum(1)
                weights = near.astype(np.float32)  # sums of at most 16 * BLOCK ones are exact
                known[a : a + BLOCK] += (weights @ positive[other]).astype(np.int64)
                good[a : a + BLOCK] += (weights @ within[other]).astype(np.int64)
        some = n > 0
        rows = part.take(pa.array(own[some]))
        ratio = good[some] / np.maximum(known[some], 1)
        return pa.table([*(rows.column(c) for c in (*keys, "id")), pa.array(n[some]), pa.array(ratio)], names=[*keys, "id", "n_local", "ratio"])

    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in (*keys, "id")), "n_local long, ratio double"])
    return spread.groupBy(*keys, "_strip").applyInArrow(run, schema)


def rectangle_gap(px: Column, py: Column, x: Column, y: Column, heading: Column, half_length: Column, half_width: Column) -> Column:
    """Distance of a point from a rectangle, 0 inside."""
    lx, ly = to_local(px, py, x, y, heading)
    dx, dy = F.greatest(F.abs(lx) - half_length, F.lit(0.0)), F.greatest(F.abs(ly) - half_width, F.lit(0.0))
    return F.sqrt(dx * dx + dy * dy)


def box_distance(a: str, b: str, rounding: float = CORNER_ROUNDING) -> Column:
    """Signed distance of two boxes with rounded corners, negative where they overlap.

    a and b: prefixes of the columns x, y, heading, length, width. The core of a box is what is left of it after taking
    `rounding` times half of its smaller side off all sides. Apart, the cores' distance is that of a corner of one from
    the other; overlapping, it is the largest separation along the four directions of their sides.
    """
    col = lambda p, c: F.col(f"{p}{c}")
    off = {p: F.least(col(p, "length"), col(p, "width")) * rounding / 2 for p in (a, b)}
    half = {p: ((col(p, "length") - 2 * off[p]) / 2, (col(p, "width") - 2 * off[p]) / 2) for p in (a, b)}
    dx, dy = col(b, "x") - col(a, "x"), col(b, "y") - col(a, "y")
    turn = col(b, "heading") - col(a, "heading")
    c, s = F.abs(F.cos(turn)), F.abs(F.sin(turn))
    gaps = []
    for p, q in ((a, b), (b, a)):
        ch, sh = F.cos(col(p, "heading")), F.sin(col(p, "heading"))
        gaps += [F.abs(dx * ch + dy * sh) - half[p][0] - (half[q][0] * c + half[q][1] * s), F.abs(dy * ch - dx * sh) - half[p][1] - (half[q][0] * s + half[q][1] * c)]
    corners = []
    for p, q in ((a, b), (b, a)):
        ch, sh = F.cos(col(p, "heading")), F.sin(col(p, "heading"))
        for i in (1, -1):
            for j in (1, -1):
                px = col(p, "x") + i * half[p][0] * ch - j * half[p][1] * sh
                py = col(p, "y") + i * half[p][0] * sh + j * half[p][1] * ch
                corners.append(rectangle_gap(px, py, col(q, "x"), col(q, "y"), col(q, "heading"), *half[q]))
    most = F.greatest(*gaps)
    return F.when(most <= 0, most).otherwise(F.least(*corners)) - off[a] - off[b]


def nearest_object(objects: DataFrame, keys: list[str]) -> DataFrame:
    """keys, id, distance: to the nearest other object of the scene and step; FAR_AWAY without one.

    objects: keys (a scene and step), id, x, y, heading, length, width; valid ones only.
    """
    fields = ["id", "x", "y", "heading", "length", "width"]
    a = objects.select(*keys, *[F.col(c).alias(f"a_{c}") for c in fields])
    b = objects.select(*keys, *[F.col(c).alias(f"b_{c}") for c in fields])
    pairs = a.join(b, keys).where("a_id <> b_id").select(*keys, F.col("a_id").alias("id"), box_distance("a_", "b_").alias("d"))
    near = pairs.groupBy(*keys, "id").agg(F.min("d").alias("distance"))
    return objects.select(*keys, "id").join(near, [*keys, "id"], "left").withColumn("distance", F.coalesce("distance", F.lit(FAR_AWAY)))
