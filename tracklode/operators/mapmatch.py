"""Map matching: projections onto lane segments, and a lane that is kept from frame to frame.

A scenario's states meet its segments in one grouped function, in blocks of bounded size: no pair of a state and a segment
leaves it, only the state's lane. Blocks look only at segments whose box is near theirs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Reach in metres and degrees of a confident match, cost of a radian and of a break, weights of confidence.
REACH, TURN, HEADING_COST, BREAK_COST = 8.0, 60.0, 2.0, 2.0
CONFIDENCE = (0.55, 0.35, 0.10)
BLOCK, PAIRS = 256, 1 << 20  # most points, and pairs of a point and a segment, that are looked at together


def lane_segments(lanes: DataFrame, keys: list[str], lane: str, points: str) -> DataFrame:
    """keys, lane, segment, x0, y0, ux, uy, length, s0 (way along the lane to the segment's start); lanes of two points or more."""
    spread = lanes.where(F.size(points) >= 2).select(*keys, lane, F.posexplode(F.arrays_zip(F.slice(F.col(points), 1, F.size(points) - 1).alias("a"), F.slice(F.col(points), 2, F.size(points) - 1).alias("b"))).alias("segment", "p"))
    got = spread.select(*keys, lane, "segment", F.col("p.a.x").alias("x0"), F.col("p.a.y").alias("y0"), (F.col("p.b.x") - F.col("p.a.x")).alias("ux"), (F.col("p.b.y") - F.col("p.a.y")).alias("uy"))
    got = got.withColumn("length", F.sqrt(F.col("ux") * F.col("ux") + F.col("uy") * F.col("uy")))
    before = Window.partitionBy(*keys, lane).orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    return got.withColumn("s0", F.coalesce(F.sum("length").over(before), F.lit(0.0)))


def in_blocks(x: np.ndarray, y: np.ndarray, low: np.ndarray, high: np.ndarray, reach: float) -> Iterator[tuple[slice, np.ndarray]]:
    """Blocks of points in their order, each with the numbers of the segments whose box (low, high: segments x 2) is at most reach from theirs."""
    at, step = 0, max(1, PAIRS // max(1, len(low)))
    while at < len(x):
        block = slice(at, at + min(step, BLOCK))
        own = np.stack([x[block], y[block]], 1)
        own = own[np.isfinite(own).all(1)]
        near = ((low - reach <= own.max(0)) & (high + reach >= own.min(0))).all(1) if len(own) else np.zeros(len(low), bool)
        yield block, np.flatnonzero(near)
        at = block.stop


def table_arrays(t: pa.Table, *columns: str) -> list[np.ndarray]:
    """Columns as doubles, null as NaN."""
    return [t.column(c).cast(pa.float64()).to_numpy() for c in columns]


def lane_candidates(xy: np.ndarray, heading: np.ndarray, segments: dict[str, np.ndarray], lane_of: np.ndarray, lanes: int, search: float) -> dict[str, np.ndarray]:
    """gap (infinite without a match), turn, s, point of each state and lane at the lane's nearest segment within `search`.

    segments: x0, y0, ux, uy, length, s0, segment in the order of lane_of (numbers of lanes) and segment; the first of equals counts.
    """
    n = len(xy)
    out = {"gap": np.full((n, lanes), np.inf), "turn": np.full((n, lanes), np.nan), "s": np.full((n, lanes), np.nan), "point": np.zeros((n, lanes), np.int64)}
    ends = np.stack([segments["x0"] + segments["ux"], segments["y0"] + segments["uy"]], 1)
    starts = np.stack([segments["x0"], segments["y0"]], 1)
    for block, near in in_blocks(xy[:, 0], xy[:, 1], np.fmin(starts, ends), np.fmax(starts, ends), search + 1e-6):
        if not len(near):
            continue
        x0, y0, ux, uy, length, s0, number = (segments[c][near] for c in ("x0", "y0", "ux", "uy", "length", "s0", "segment"))
        dx, dy = xy[block, :1] - x0, xy[block, 1:] - y0
        length2 = ux * ux + uy * uy
        long = length2 > 1e-12
        f = np.where(long, np.clip((dx * ux + dy * uy) / np.where(long, length2, 1.0), 0.0, 1.0), 0.0)
        gap = np.sqrt((dx - f * ux) * (dx - f * ux) + (dy - f * uy) * (dy - f * uy))
        gap = np.where(gap <= search, gap, np.inf)
        own = lane_of[near]
        first = np.flatnonzero(np.diff(own, prepend=-1))
        for a, b in zip(first, [*first[1:], len(own)], strict=True):
            k = a + gap[:, a:b].argmin(1)
            rows = np.arange(len(k))
            share, place = f[rows, k], (block, own[a])
            out["gap"][place] = gap[rows, k]
            w = np.arctan2(uy[k], ux[k]) - heading[block]
            out["turn"][place] = np.abs(w - 2 * math.pi * np.floor((w + math.pi) / (2 * math.pi)))
            out["s"][place] = s0[k] + share * length[k]
            out["point"][place] = number[k] + (share >= 0.5)
    return out


def followers(links: DataFrame, keys: list[str], lane: str = "lane") -> DataFrame:
    """keys, lane, kin: the lanes from which a track may go on to the lane without a break.

    links: keys, src, dst, kind; entry and exit links hold both ways, links of other kinds (neighbours, branches) from src to dst.
    """
    there = links.select(*keys, F.col("src").alias("from"), F.col("dst").alias(lane))
    back = links.where(F.col("kind").isin("entry", "exit")).select(*keys, F.col("dst").alias("from"), F.col("src").alias(lane))
    return there.unionByName(back).groupBy(*keys, lane).agg(F.collect_set("from").alias("kin"))


def matched_lanes(
    states: DataFrame, segments: DataFrame, links: DataFrame, keys: list[str], track: str, frame: str, lane: str = "lane",
    reach: float = REACH, max_turn: float = TURN, heading_cost: float = HEADING_COST, break_cost: float = BREAK_COST, search: float | None = None,
) -> DataFrame:
    """keys, track, frame, lane, s, point, gap, turn, confident, confidence for every state (keys, track, frame, x, y, heading).

    A state takes the lane of least gap + heading_cost * turn, plus break_cost for lanes that do not follow the lane before,
    among those within reach and max_turn; ties go to the nearer lane, then to the smaller. Without such a lane it takes the
    best within `search` (or null) and is not confident, and the next state starts afresh. keys must name scenarios of bounded
    size: one grouped function holds a scenario's states and segments.
    """
    search = search or 4 * reach
    limit = math.radians(max_turn)
    kin = segments.join(followers(links, keys, lane), [*keys, lane], "left").where(" and ".join(f"`{k}` is not null" for k in keys))
    kin = kin.toDF(*kin.columns)  # states and segments may come from one table
    own = states.select(*keys, track, frame, "x", "y", "heading")
    kinds = {f.name: f.dataType.simpleString() for f in own.schema}
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in (*keys, track, frame)), f"`{lane}` {segments.schema[lane].dataType.simpleString()}", "s double, point int, gap double, turn double, confident boolean, confidence double"])

    def run(points: pa.Table, roads: pa.Table) -> pa.Table:
        points = points.sort_by([(track, "ascending"), (frame, "ascending")])
        roads = roads.sort_by([(lane, "ascending"), ("segment", "ascending")])
        names = roads.column(lane).unique()
        lane_of = pc.index_in(roads.column(lane), names).to_numpy()
        x, y, heading = table_arrays(points, "x", "y", "heading")
        numbers = ["x0", "y0", "ux", "uy", "length", "s0", "segment"]
        with np.errstate(all="ignore"):
            c = lane_candidates(np.stack([x, y], 1), heading, dict(zip(numbers, table_arrays(roads, *numbers), strict=True)), lane_of, len(names), search)
        follows = np.eye(len(names) + 1, len(names), dtype=bool)
        follows[-1] = True  # no lane before
        place = {name: i for i, name in enumerate(names.to_pylist())}
        for i, at in enumerate(np.unique(lane_of, return_index=True)[1].tolist()):
            for name in roads.column("kin")[at].as_py() or ():
                if name in place:
                    follows[place[name], i] = True
        tracks = pc.index_in(points.column(track), points.column(track).unique()).to_numpy()
        at, related = kept_lanes(tracks, c, follows, reach, limit, heading_cost, break_cost)
        rows, found = np.arange(len(at)), at >= 0
        some = lambda v: pa.array(v, mask=~found)
        if len(names):
            got = {k: v[rows, at] for k, v in c.items()}
        else:
            got = {k: np.zeros(len(at), v.dtype) for k, v in c.items()}
        fits = found & (got["gap"] <= reach) & (got["turn"] <= limit)
        sure = CONFIDENCE[0] * np.maximum(0.0, 1.0 - got["gap"] / reach) + CONFIDENCE[1] * np.maximum(0.0, 1.0 - got["turn"] / limit) + CONFIDENCE[2] * related
        columns = [*(points.column(k) for k in (*keys, track, frame)), names.take(pa.array(at, mask=~found)), some(got["s"]), some(got["point"].astype(np.int32)), some(got["gap"]), pa.array(got["turn"], mask=~found | np.isnan(got["turn"])), pa.array(fits), pa.array(np.where(fits, sure, 0.0))]
        return pa.table(columns, names=[*keys, track, frame, lane, "s", "point", "gap", "turn", "confident", "confidence"])

    return own.groupBy(*keys).cogroup(kin.groupBy(*keys)).applyInArrow(run, schema)


def kept_lanes(tracks: np.ndarray, c: dict[str, np.ndarray], follows: np.ndarray, reach: float, limit: float, heading_cost: float, break_cost: float) -> tuple[np.ndarray, np.ndarray]:
    """The lane of each state (-1: none) and whether it follows the one before; states in the order of tracks and frames.

    All tracks go on by one state at a time; those without a lane within search are passed over.
    """
    lane, related = np.full(len(tracks), -1), np.zeros(len(tracks), bool)
    seen = np.flatnonzero(np.isfinite(c["gap"]).any(1))
    first = np.flatnonzero(np.diff(tracks[seen], prepend=-1))
    size = np.diff([*first, len(seen)])
    before = np.full(len(first), -1)
    for step in range(size.max(initial=0)):
        on = np.flatnonzero(size > step)
        at = seen[first[on] + step]
        gap, turn = c["gap"][at], c["turn"][at]
        fits = (gap <= reach) & (turn <= limit)
        mask = np.where(fits.any(1, keepdims=True), fits, np.isfinite(gap))
        kin = follows[before[on]]
        cost = gap + heading_cost * turn + np.where(kin, 0.0, break_cost)
        for key in (np.where(np.isnan(cost), np.inf, cost), gap):
            key = np.where(mask, key, np.inf)
            mask = mask & (key == key.min(1, keepdims=True))
        best = mask.argmax(1)
        rows = np.arange(len(at))
        lane[at], related[at] = best, kin[rows, best]
        before[on] = np.where(fits[rows, best], best, -1)
    return lane, related
