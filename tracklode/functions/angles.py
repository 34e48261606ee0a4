"""Angles and rigid transforms as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

TAU = 2 * math.pi


def wrap_angle(a: Column) -> Column:
    """a in [-pi, pi)."""
    return a - F.lit(TAU) * F.floor((a + math.pi) / TAU)


def angle_difference(a: Column, b: Column) -> Column:
    return wrap_angle(a - b)


def angle_between(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """The signed angle from vector a to vector b."""
    return F.atan2(ax * by - ay * bx, ax * bx + ay * by)


def circular_mean(a: Column) -> Column:
    """Aggregate: the direction of the mean unit vector."""
    return F.atan2(F.avg(F.sin(a)), F.avg(F.cos(a)))


def to_local(x: Column, y: Column, x0: Column, y0: Column, heading: Column) -> tuple[Column, Column]:
    """(x, y) in the frame that stands at (x0, y0) and looks along heading."""
    dx, dy = x - x0, y - y0
    return dx * F.cos(heading) + dy * F.sin(heading), dy * F.cos(heading) - dx * F.sin(heading)


def to_global(x: Column, y: Column, x0: Column, y0: Column, heading: Column) -> tuple[Column, Column]:
    """The inverse of to_local."""
    return x * F.cos(heading) - y * F.sin(heading) + x0, x * F.sin(heading) + y * F.cos(heading) + y0


def box_contour(x: Column, y: Column, heading: Column, width: Column, length: Column) -> Column:
    """Array of the corners (x, y): left front, right front, right back, left back."""
    corners = [(0.5, 0.5), (0.5, -0.5), (-0.5, -0.5), (-0.5, 0.5)]
    return F.array(*[F.struct(*(c.alias(n) for c, n in zip(to_global(length * lon, width * lat, x, y, heading), ("x", "y"), strict=True))) for lon, lat in corners])


def mph_to_mps(v: Column) -> Column:
    return v * 0.44704


def parallel(heading_a: Column, heading_b: Column, limit_rad: float = math.radians(15.0)) -> Column:
    """Whether two lines are parallel, whichever way they run."""
    return F.acos(F.least(F.lit(1.0), F.abs(F.cos(heading_a - heading_b)))) < limit_rad


def turn_direction(total: Column) -> Column:
    """straight, left or right by the summed turning angle (30 degrees)."""
    return F.when(total > math.pi / 6, "left").when(total < -math.pi / 6, "right").otherwise("straight")


def point_distance(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    return F.sqrt((ax - bx) * (ax - bx) + (ay - by) * (ay - by))


def side_of_line(px: Column, py: Column, ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """left or right: where the point lies, seen along the line from a to b; on it counts as right."""
    return F.when((bx - ax) * (py - ay) - (by - ay) * (px - ax) > 0, "left").otherwise("right")
