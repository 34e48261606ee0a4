"""Road edges: distances of points from segments, beside, ahead and behind; how neighbouring polylines lie; short detours."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.angles import point_distance

#: A ray meets nothing nearer than this, and segment ends reach a little further.
RAY_START, RAY_SLACK, PARALLEL = 0.25, 1e-6, 1e-9


def edge_segments(edges: DataFrame, keys: list[str], points: str) -> DataFrame:
    """keys, x0, y0, ux, uy: the segments of polylines (arrays of x, y) as start and vector; those without length are left out."""
    at = lambda k, c: F.get(points, F.col("_k") + k)[c]
    spread = edges.where(F.size(points) >= 2).withColumn("_k", F.explode(F.sequence(F.lit(0), F.size(points) - 2)))
    got = spread.select(*keys, at(0, "x").alias("x0"), at(0, "y").alias("y0"), (at(1, "x") - at(0, "x")).alias("ux"), (at(1, "y") - at(0, "y")).alias("uy"))
    return got.where(F.col("ux") * F.col("ux") + F.col("uy") * F.col("uy") > 1e-12)


def road_edge_distances(points: DataFrame, segments: DataFrame, keys: list[str], rows: list[str], most: float) -> DataFrame:
    """keys, rows, nearest, ahead, behind: to the nearest segment, and along the heading and against it up to `most`; null for none.

    points: keys, rows, x, y, heading. Points meet the segments of their own scene only, whose map is bounded.
    """
    pairs = points.select(*keys, *rows, "x", "y", "heading").join(segments, keys, "left")
    x, y, ux, uy = F.col("x") - F.col("x0"), F.col("y") - F.col("y0"), F.col("ux"), F.col("uy")
    share = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (x * ux + y * uy) / (ux * ux + uy * uy)))
    dx, dy = x - share * ux, y - share * uy
    c, s = F.cos("heading"), F.sin("heading")
    cross = c * uy - s * ux
    crosses = F.abs(cross) > PARALLEL
    along, place = (y * ux - x * uy) / cross, (y * c - x * s) / cross
    pairs = pairs.select(*keys, *rows, F.sqrt(dx * dx + dy * dy).alias("_d"), F.when(crosses, along).alias("_r"), F.when(crosses, place).alias("_g"))
    on = (F.col("_g") >= -RAY_SLACK) & (F.col("_g") <= 1 + RAY_SLACK)
    ray = lambda r: F.min(F.when(on & (r > RAY_START) & (r <= most), r))
    return pairs.groupBy(*keys, *rows).agg(F.min("_d").alias("nearest"), ray(F.col("_r")).alias("ahead"), ray(-F.col("_r")).alias("behind"))


def polyline_length(points: Column) -> Column:
    """Length of an array of (x, y); 0 for fewer than two points."""
    steps = F.transform(F.slice(points, 2, F.greatest(F.size(points) - 1, F.lit(0))), lambda p, i: point_distance(p["x"], p["y"], F.get(points, i)["x"], F.get(points, i)["y"]))
    return F.aggregate(steps, F.lit(0.0), lambda s, x: s + x)


def neighbour_relation(a: Column, b: Column, near: float = 5.0, longer: float = 3.0) -> Column:
    """complete, side-start, side-end or other: which ends of polyline b lie by those of a, which is the longer one for the side kinds."""
    first, last = lambda p: F.get(p, F.lit(0)), lambda p: F.element_at(p, -1)
    close = lambda end: point_distance(end(a)["x"], end(a)["y"], end(b)["x"], end(b)["y"]) < near
    start, end = close(first), close(last)
    side = polyline_length(b) + longer < polyline_length(a)
    return F.when(start & end, "complete").when(start & ~end & side, "side-start").when(~start & end & side, "side-end").otherwise("other")


def closed_detours(df: DataFrame, keys: list[str], frame: str, at: str, x: str, y: str, valid: str, most: int = 8, excess: float = 1.0, ratio: float = 2.5, floor: float = 0.75) -> DataFrame:
    """keys, frame: valid rows of detours of at most `most` rows that return to the path.

    A detour's way between the rows around it exceeds their distance by more than `excess` and by more than `ratio`
    times, and one of its rows lies more than `floor` off the straight move between them. A track whose times do not
    rise has none. Each row sees the `most` + 1 rows after it only.
    """
    rows = df.where(F.col(valid)).select(*keys, F.col(frame).alias("_f"), F.col(at).alias("_t"), F.col(x).alias("_x"), F.col(y).alias("_y"))
    way = Window.partitionBy(*keys).orderBy("_f")
    rows = rows.withColumns({"_step": F.coalesce(point_distance(F.col("_x"), F.col("_y"), F.lag("_x").over(way), F.lag("_y").over(way)), F.lit(0.0)), "_still": F.lag("_t").over(way) >= F.col("_t")})
    rows = rows.withColumns({"_s": F.sum("_step").over(way), "_bad": F.max(F.coalesce("_still", F.lit(False))).over(Window.partitionBy(*keys))}).where(~F.col("_bad"))
    rows = rows.withColumn("_next", F.collect_list(F.struct("_f", "_t", "_x", "_y", "_s")).over(way.rowsBetween(0, most + 1)))
    rows = rows.where(F.size("_next") >= 3).select(*keys, "_next", F.explode(F.sequence(F.lit(2), F.size("_next") - 1)).alias("_r"))
    a, b = F.get("_next", F.lit(0)), F.get("_next", F.col("_r"))
    path, direct = b["_s"] - a["_s"], point_distance(a["_x"], a["_y"], b["_x"], b["_y"])
    rows = rows.where((path - direct > excess) & (path > ratio * F.greatest(direct, F.lit(1e-6))))
    share = lambda p: (p["_t"] - a["_t"]) / (b["_t"] - a["_t"])
    off = lambda p: point_distance(p["_x"], p["_y"], a["_x"] + share(p) * (b["_x"] - a["_x"]), a["_y"] + share(p) * (b["_y"] - a["_y"]))
    inside = F.slice("_next", F.lit(2), F.col("_r") - 1)
    rows = rows.where(F.exists(inside, lambda p: off(p) > floor))
    return rows.select(*keys, F.explode(F.transform(inside, lambda p: p["_f"])).alias(frame)).distinct()


def mixture_loss(modes: DataFrame, keys: list[str], sd_position: float, sd_heading: float, hard: bool = False) -> DataFrame:
    """keys, loss: minus the log density of the true pose in a mixture of normals over x, y, cos and sin of the heading.

    modes: keys, mode, logit, x, y, heading and the true pose tx, ty, th. With `hard` the density is that of the mode
    nearest in position (ties to the lowest mode). A key's modes are a bounded number.
    """

    def log_normal(d: Column, sd: float) -> Column:
        return -d * d / (2 * sd * sd) - math.log(sd) - 0.5 * math.log(2 * math.pi)

    col = F.col
    dense = log_normal(col("x") - col("tx"), sd_position) + log_normal(col("y") - col("ty"), sd_position) + log_normal(F.cos("heading") - F.cos("th"), sd_heading) + log_normal(F.sin("heading") - F.sin("th"), sd_heading)
    if hard:
        near = F.struct(point_distance(col("x"), col("y"), col("tx"), col("ty")).alias("d"), "mode")
        return modes.groupBy(*keys).agg((-F.min_by(dense, near)).alias("loss"))
    held = modes.groupBy(*keys).agg(F.collect_list(F.struct("logit", (col("logit") + dense).alias("joint"))).alias("_m"))

    def log_sum(field: str) -> Column:
        values = F.transform("_m", lambda m: m[field].cast("double"))
        top = F.array_max(values)
        return top + F.ln(F.aggregate(values, F.lit(0.0), lambda s, v: s + F.exp(v - top)))

    return held.select(*keys, (log_sum("logit") - log_sum("joint")).alias("loss"))
