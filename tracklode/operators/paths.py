"""Tracks that jump or face the wrong way: the longest path without teleports, and body headings along or against the motion.

Both look at one track at a time, which is that of a scenario and so of bounded length; scenarios are dealt to tasks.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kernels import polynomial_smooth

# Fixed values, by object type (1 vehicle, 2 pedestrian, 3 cyclist): greatest speed, least limit of typical speeds (m/s);
# the limit's ratio to the typical speed, the distance that is never a jump, the observations that a path may leave out in a row.
TOP_SPEED, LEAST_LIMIT = {1: 70.0, 2: 15.0, 3: 35.0}, {1: 15.0, 2: 5.0, 3: 10.0}
LIMIT_RATIO, MARGIN, MOST_SKIPPED = 4.0, 1.0, 8
# Fixed values of body headings: least speed, runs, cap and evidence of an observed heading, shares that settle the
# direction, weight of turns, and how near and clear a heading before the motion must be.
LEAST_SPEED, LEAST_RUN, REVERSE_RUN, CAP, EVIDENCE = 0.5, 3, 5, math.radians(60.0), math.radians(15.0)
FORWARD_SHARE, REVERSE_SHARE, TURN_WEIGHT, SEED_GAP, SEED_MARGIN, SMOOTHING = 0.60, 0.75, 25.0, 1.0, math.radians(30.0), 5


def per_track(df: DataFrame, group: list[str], track: str, frame: str, columns: list[str], out: dict[str, str], f: Callable[[pd.DataFrame], dict[str, np.ndarray]]) -> DataFrame:
    """group, track, frame and what f returns for each track's rows in the order of frames; one pandas frame for each group."""
    kinds = {c.name: c.dataType.simpleString() for c in df.schema}

    def run(part: pd.DataFrame) -> pd.DataFrame:
        parts = []
        for _, own in part.sort_values([track, frame], kind="stable").groupby(track, sort=False):
            parts.append(own[[*group, track, frame]].assign(**f(own.reset_index(drop=True))))
        return pd.concat(parts)

    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in (*group, track, frame)), *(f"{n} {t}" for n, t in out.items())])
    return df.select(*group, track, frame, *columns).where(F.col(track).isNotNull() & F.col(frame).isNotNull()).groupBy(*group).applyInPandas(run, schema)


def longest_path(t: np.ndarray, x: np.ndarray, y: np.ndarray, top_speed: float, least_limit: float, most_skipped: int = MOST_SKIPPED) -> np.ndarray:
    """Which of a track's observations lie on its longest path without a jump; all, where no neighbours jump.

    Two observations may follow each other if they are MARGIN apart at most, or no faster than a limit from the track's median
    speed and than top_speed allows. Of paths with equally many observations the one that lasts longer wins, then the later.
    """
    n = len(t)
    if n < 3 or (np.round(np.diff(t), 9) <= 0).any():
        return np.ones(n, bool)

    def follows(distance: np.ndarray, duration: np.ndarray) -> np.ndarray:
        return (distance <= MARGIN + top_speed * duration) & ((distance <= MARGIN) | (distance / duration <= limit))

    def between(i: int | np.ndarray, j: int | np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return np.sqrt((x[i] - x[j]) ** 2 + (y[i] - y[j]) ** 2), np.round(t[i] - t[j], 9)  # equal times are equal, whenever they are

    step, gap = between(np.arange(1, n), np.arange(n - 1))
    limit = max(least_limit, LIMIT_RATIO * float(np.median(step / gap)))
    if follows(step, gap).all():
        return np.ones(n, bool)
    length, lasts, before = np.ones(n, np.int64), np.zeros(n), np.full(n, -1)
    for i in range(1, n):
        own = np.arange(max(0, i - most_skipped - 1), i)
        own = own[follows(*between(i, own))]
        if len(own):
            duration = np.round(lasts[own] + between(i, own)[1], 9)
            k = np.lexsort((own, -duration, -length[own]))[0]
            length[i], lasts[i], before[i] = length[own[k]] + 1, duration[k], own[k]
    kept = np.zeros(n, bool)
    at = int(np.lexsort((np.arange(n), lasts, length))[-1])
    while at >= 0:
        kept[at] = True
        at = before[at]
    return kept


def path_members(df: DataFrame, group: list[str], track: str, frame: str, time: str = "t", x: str = "x", y: str = "y", valid: str = "valid", kind: str = "kind") -> DataFrame:
    """group, track, frame, kept: false for invalid and non-finite observations and those off the track's longest path."""

    def run(own: pd.DataFrame) -> dict[str, np.ndarray]:
        t, px, py = (own[c].to_numpy(float) for c in (time, x, y))
        seen = own[valid].fillna(False).to_numpy(bool) & np.isfinite(t) & np.isfinite(px) & np.isfinite(py)
        object_type = own[kind].iloc[0]
        kept = seen.copy()
        kept[seen] = longest_path(t[seen], px[seen], py[seen], TOP_SPEED.get(object_type, TOP_SPEED[1]), LEAST_LIMIT.get(object_type, LEAST_LIMIT[1]))
        return {"kept": kept}

    return per_track(df, group, track, frame, [time, x, y, valid, kind], {"kept": "boolean"}, run)


def long_runs(mask: np.ndarray, least: int) -> np.ndarray:
    """mask without its runs of fewer than least."""
    edges = np.flatnonzero(np.diff(np.concatenate([[0], mask.astype(np.int8), [0]])))
    out = np.zeros(len(mask), bool)
    for a, b in edges.reshape(-1, 2):
        out[a:b] = b - a >= least
    return out


def turned(a: np.ndarray, b: np.ndarray | float) -> np.ndarray:
    return np.abs((a - b + math.pi) % (2 * math.pi) - math.pi)


def two_way_path(ways: np.ndarray, cost: np.ndarray, gaps: np.ndarray, weight: float = TURN_WEIGHT) -> np.ndarray:
    """The state (column) of each row of least total cost: cost of the states, and weight * turn**2 / gap between rows."""
    total, back = cost[0].copy(), np.zeros(cost.shape, np.int64)
    for i in range(1, len(cost)):
        step = total[:, None] + weight * turned(ways[i][None, :], ways[i - 1][:, None]) ** 2 / gaps[i - 1]
        back[i] = step.argmin(axis=0)
        total = cost[i] + step.min(axis=0)
    out = np.zeros(len(cost), np.int64)
    out[-1] = total.argmin()
    for i in range(len(cost) - 1, 0, -1):
        out[i - 1] = back[i, out[i]]
    return out


def body_heading(t: np.ndarray, x: np.ndarray, y: np.ndarray, heading: np.ndarray, heading_valid: np.ndarray, seen: np.ndarray) -> np.ndarray:
    """The body's heading from the motion, for frames in motion; NaN elsewhere.

    A body faces along its way or against it. Where its observed headings say one and the same over long runs, that holds for
    all frames; else the ways of least cost are taken, which fit the observed headings and turn little from frame to frame.
    """
    out = np.full(len(t), np.nan)
    if len(t) < 2:
        return out
    vx, vy = (polynomial_smooth(np.gradient(v, t), SMOOTHING) for v in (x, y))
    speed = np.hypot(vx, vy)
    moving = np.flatnonzero(long_runs(np.isfinite(speed) & (speed >= LEAST_SPEED) & long_runs(seen, LEAST_RUN), LEAST_RUN))
    if not len(moving):
        return out
    along = np.arctan2(vy[moving], vx[moving])
    ways = np.stack([along, (along + 2 * math.pi) % (2 * math.pi) - math.pi], axis=1)
    told = heading_valid[moving]
    off = np.where(told[:, None], turned(ways, heading[moving][:, None]), np.inf)
    cost = np.where(told[:, None], np.minimum(off, CAP) ** 2, 0.0)
    # A heading near the first moving frame: the last before its run of observations, else the last up to it, else the next.
    first, known = moving[0], np.flatnonzero(heading_valid)
    run = first
    while run > 0 and seen[run - 1]:
        run -= 1
    near = lambda i: abs(t[first] - t[i]) <= SEED_GAP
    before_run, up_to, behind = known[known < run], known[known <= first], known[known > first]
    seed = None
    if len(before_run) and near(before_run[-1]):
        seed = before_run[-1]
    elif len(up_to):
        seed = up_to[-1] if near(up_to[-1]) else None
    elif len(behind) and near(behind[0]):
        seed = behind[0]
    seed_off = turned(ways[0], heading[seed]) if seed is not None else np.zeros(2)
    clear = seed is not None and abs(seed_off[0] - seed_off[1]) >= SEED_MARGIN
    side = int(seed_off.argmin())
    says = np.zeros((2, len(t)), bool)
    says[:, moving] = (told[:, None] & (off <= EVIDENCE)).T
    share = says.sum(axis=1) / max(1, int(told.sum()))
    firm = [long_runs(says[0], LEAST_RUN).any(), long_runs(says[1], REVERSE_RUN).any()]
    for way, least in ((0, FORWARD_SHARE), (1, REVERSE_SHARE)):
        if firm[way] and not firm[1 - way] and share[way] >= least and not (clear and side != way):
            out[moving] = ways[:, way]
            return out
    if seed is not None and seed != first:
        cost[0] += np.minimum(seed_off, CAP) ** 2
    if clear:
        cost[0, 1 - side] = np.inf
    steps = np.diff(t)
    usual = float(np.median(steps[steps > 0])) if (steps > 0).any() else 0.1
    gaps = np.maximum(1.0, np.maximum(np.diff(t[moving]), usual) / usual)
    out[moving] = ways[np.arange(len(moving)), two_way_path(ways, cost, gaps)]
    return out


def body_headings(df: DataFrame, group: list[str], track: str, frame: str, time: str = "t", x: str = "x", y: str = "y", heading: str = "heading", valid: str = "valid", kind: str = "kind", types: tuple[int, ...] = (1,)) -> DataFrame:
    """group, track, frame, body: the heading of body_heading() for tracks of the given types, null elsewhere."""

    def run(own: pd.DataFrame) -> dict[str, np.ndarray]:
        t, px, py, h = (own[c].to_numpy(float) for c in (time, x, y, heading))
        seen = own[valid].fillna(False).to_numpy(bool) & np.isfinite(px) & np.isfinite(py)
        none = np.full(len(own), np.nan)
        return {"body": body_heading(t, px, py, h, seen & np.isfinite(h), seen) if own[kind].iloc[0] in types else none}

    got = per_track(df, group, track, frame, [time, x, y, heading, valid, kind], {"body": "double"}, run)
    return got.withColumn("body", F.when(~F.isnan("body"), F.col("body")))
