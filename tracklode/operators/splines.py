"""Frames between control states: natural cubic splines, straight lines, or standing still, by track."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Frames from one control to the next, and the way (metres) below which a frame keeps the heading before.
SHIFT, LEAST_WAY = 5, 1e-3


def second_derivatives(control: np.ndarray) -> np.ndarray:
    """Of the natural cubic through the rows of control, one unit apart: 1, 4, 1 on the diagonals, one sweep each way, all columns at once."""
    m = np.zeros_like(control)
    n = len(control) - 2
    if n < 1:
        return m
    right = 6.0 * (control[2:] - 2.0 * control[1:-1] + control[:-2])
    share = np.zeros(n)
    for i in range(n):
        share[i] = 1.0 / (4.0 - (share[i - 1] if i else 0.0))
        right[i] = (right[i] - (right[i - 1] if i else 0.0)) * share[i]
    for i in range(n - 2, -1, -1):
        right[i] -= share[i] * right[i + 1]
    m[1:-1] = right
    return m


def cubic_frames(control: np.ndarray, shift: int = SHIFT) -> np.ndarray:
    """(segments * shift, columns): the spline at shift places of each segment, the last of which is the next control."""
    m = second_derivatives(control)
    t = (np.arange(1, shift + 1) / shift)[None, :, None]
    u = 1.0 - t
    m0, m1, p0, p1 = m[:-1, None], m[1:, None], control[:-1, None], control[1:, None]
    out = m0 * u**3 / 6.0 + m1 * t**3 / 6.0 + (p0 - m0 / 6.0) * u + (p1 - m1 / 6.0) * t
    out[:, -1] = control[1:]
    return out.reshape(-1, control.shape[1])


def frames_between(xy: np.ndarray, heading: np.ndarray, method: str, shift: int = SHIFT) -> tuple[np.ndarray, np.ndarray]:
    """(positions, headings) of the frames behind the first control.

    cubic: the spline, headed along its steps, a step below LEAST_WAY like the one before. linear: straight lines between controls,
    headings turning the short way with a smooth start and end. static: all as at the first control.
    """
    n = (len(xy) - 1) * shift
    if method == "static":
        return np.repeat(xy[:1], n, axis=0), np.repeat(heading[:1], n)
    t = np.arange(1, shift + 1) / shift
    if method == "linear":
        place = (xy[:-1, None] * (1 - t)[None, :, None] + xy[1:, None] * t[None, :, None]).reshape(-1, 2)
        turn = np.concatenate([heading[:1], heading[0] + np.cumsum((np.diff(heading) + math.pi) % (2 * math.pi) - math.pi)])
        eased = t * t * (3.0 - 2.0 * t)
        ways = (turn[:-1, None] + np.diff(turn)[:, None] * eased[None, :]).ravel()
        return place, (ways + math.pi) % (2 * math.pi) - math.pi
    place = cubic_frames(xy, shift)
    step = np.diff(np.concatenate([xy[:1], place]), axis=0)
    ways = np.arctan2(step[:, 1], step[:, 0])
    last = np.maximum.accumulate(np.where(np.hypot(step[:, 0], step[:, 1]) > LEAST_WAY, np.arange(n), -1))
    return place, np.where(last >= 0, ways[last], heading[0]) if n else ways


def interpolate(controls: DataFrame, group: list[str], track: str, order: str, method: str = "method", shift: int = SHIFT) -> DataFrame:
    """group, track, frame (from 1), x, y, heading: the frames behind the first control of each track.

    controls: group, track, order, x, y, heading and the track's method (cubic, linear or static). A track of one control has no
    frames; controls with a null or non-finite x, y or heading are left out. A group is a scenario and so of bounded size.
    """
    kinds = {f.name: f.dataType.simpleString() for f in controls.schema}

    def run(part: pd.DataFrame) -> pd.DataFrame:
        parts = []
        for name, own in part.sort_values([track, order], kind="stable").groupby(track, sort=False):
            xy, heading = own[["x", "y"]].to_numpy(float), own["heading"].to_numpy(float)
            fine = np.isfinite(xy).all(axis=1) & np.isfinite(heading)
            if fine.sum() > 1:
                place, ways = frames_between(xy[fine], heading[fine], own[method].iloc[0], shift)
                parts.append(pd.DataFrame({**{g: own[g].iloc[0] for g in group}, track: name, "frame": np.arange(1, len(place) + 1), "x": place[:, 0], "y": place[:, 1], "heading": ways}))
        return pd.concat(parts) if parts else pd.DataFrame(columns=[*group, track, "frame", "x", "y", "heading"])

    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in (*group, track)), "frame long, x double, y double, heading double"])
    return controls.select(*group, track, order, "x", "y", "heading", method).where(F.col(track).isNotNull()).groupBy(*group).applyInPandas(run, schema)
