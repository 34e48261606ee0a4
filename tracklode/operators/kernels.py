"""Per-track recurrences and smoothing: sequential in a track, parallel over tracks.

Repaired headings and matched tokens are carried along tracks of any length; smoothing holds one bounded track in a grouped function.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def in_order(df: DataFrame, key: str, frame: str, columns: list[str]) -> DataFrame:
    """key, frame, columns: each track in one partition, in the order of frames, so that a function of batches can carry a state along tracks of any length."""
    return df.select(key, frame, *columns).repartition(key).sortWithinPartitions(key, frame)


def repair_headings(df: DataFrame, key: str, frame: str, heading: str, valid: str, jump: float = 1.5) -> DataFrame:
    """(key, frame, heading): a heading that is off the frame before by more than `jump` becomes that frame's, if both are valid.

    What a frame becomes depends on what the frame before it became.
    """
    kinds = {f.name: f.dataType.simpleString() for f in df.schema}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        track, before, seen, first = None, 0.0, False, True
        for batch in batches:
            keys, headings = batch.column(0).to_pylist(), batch.column(2).cast(pa.float64()).to_numpy(zero_copy_only=False).tolist()
            for i, (own, ok) in enumerate(zip(keys, batch.column(3).to_pylist(), strict=True)):
                if not first and own == track and seen and ok:
                    off = (before - headings[i] + math.pi) % (2 * math.pi) - math.pi
                    if abs(off) > jump:
                        headings[i] = before
                track, before, seen, first = own, headings[i], bool(ok), False
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(headings, pa.float64())], [key, frame, heading])

    return in_order(df, key, frame, [heading, valid]).mapInArrow(run, f"`{key}` {kinds[key]}, `{frame}` {kinds[frame]}, `{heading}` double")


def polynomial_smooth(values: np.ndarray, window: int = 7, order: int = 2) -> np.ndarray:
    """Least-squares polynomial smoothing; the ends take the fit of the first and last full window."""
    n = len(values)
    window = min(window, n if n % 2 else n - 1)
    if window <= order:
        return values.copy()
    half = window // 2
    x = np.arange(-half, half + 1)
    basis = np.vander(x, order + 1, increasing=True)
    fit = np.linalg.pinv(basis)
    out = values.astype(float).copy()
    out[half : n - half] = np.convolve(values, fit[0][::-1], "valid")
    for edge, places in ((values[:window], range(half)), (values[n - window :], range(n - half, n))):
        coef = fit @ edge
        for p in places:
            at = p - half if p < half else p - (n - 1 - half)
            out[p] = np.polyval(coef[::-1], at)
    return out


def smooth_tracks(df: DataFrame, key: str, frame: str, value: str, valid: str, window: int = 7, order: int = 2) -> DataFrame:
    """(key, frame, smoothed): each run of consecutive valid frames smoothed by itself; invalid frames are left out."""
    kinds = {f.name: f.dataType.simpleString() for f in df.schema}

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part[part[valid]].sort_values(frame)
        run_id = (part[frame].diff() != 1).cumsum()
        out = part[[key, frame]].copy()
        out["smoothed"] = part.groupby(run_id)[value].transform(lambda v: polynomial_smooth(v.to_numpy(float), window, order)) if len(part) else pd.Series(dtype=float)
        return out

    return df.select(key, frame, value, valid).groupBy(key).applyInPandas(run, f"`{key}` {kinds[key]}, `{frame}` {kinds[frame]}, smoothed double")


def token_contours(ends: np.ndarray, width: float, length: float) -> np.ndarray:
    """Corners (left front, right front, right back, left back) of boxes at the poses (x, y, heading): tokens x 4 x 2."""
    lon, lat = length * np.array([0.5, 0.5, -0.5, -0.5]), width * np.array([0.5, -0.5, -0.5, 0.5])
    c, s = np.cos(ends[:, 2:3]), np.sin(ends[:, 2:3])
    return np.stack([ends[:, 0:1] + lon * c - lat * s, ends[:, 1:2] + lon * s + lat * c], axis=2)


def match_tokens(steps: DataFrame, contours: np.ndarray, width: float, length: float, key: str, step: str) -> DataFrame:
    """(key, step, token, x, y, heading, matched): each step takes the token whose corners, from the pose reached so far, are nearest to its own.

    steps: key, step, x, y, heading, valid. contours: corners in the local frame (tokens x 4 x 2), a bounded table. Where
    the step and the one before are valid, the pose goes on from the token's corners, else from the step's own pose; the
    choice is sequential in a track. Ties take the lowest token.
    """
    kinds = {f.name: f.dataType.simpleString() for f in steps.schema}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        track, pose, seen = None, None, False
        for batch in batches:
            true = np.stack([batch.column(k).cast(pa.float64()).to_numpy(zero_copy_only=False) for k in (2, 3, 4)], 1)
            own = token_contours(true, width, length)
            at, tokens, poses, matched = [], [], [], []
            for i, (name, ok) in enumerate(zip(batch.column(0).to_pylist(), batch.column(5).to_pylist(), strict=True)):
                if pose is None or name != track:
                    track, pose, seen = name, true[i], bool(ok)
                    continue
                c, s = math.cos(pose[2]), math.sin(pose[2])
                world = contours @ np.array([[c, s], [-s, c]]) + pose[:2]
                token = int(np.linalg.norm(world - own[i], axis=2).sum(axis=1).argmin())
                ahead = world[token][0] - world[token][3]
                goes_on = seen and bool(ok)
                pose = np.array([*world[token].mean(axis=0), math.atan2(ahead[1], ahead[0])]) if goes_on else true[i]
                seen = bool(ok)
                at.append(i), tokens.append(token), poses.append(pose), matched.append(goes_on)
            found = np.array(poses).reshape(-1, 3)
            at = pa.array(at, pa.int64())
            columns = [batch.column(0).take(at), batch.column(1).take(at), pa.array(tokens, pa.int32()), *(pa.array(found[:, k], pa.float64()) for k in range(3)), pa.array(matched, pa.bool_())]
            yield pa.RecordBatch.from_arrays(columns, [key, step, "token", "x", "y", "heading", "matched"])

    return in_order(steps, key, step, ["x", "y", "heading", "valid"]).mapInArrow(run, f"`{key}` {kinds[key]}, `{step}` {kinds[step]}, token int, x double, y double, heading double, matched boolean")


def road_class(valid: Column, region: Column, distance: Column, driveway: Column, approach: float = 30.0, leaving: float = 15.0) -> Column:
    """Category of a frame: UNKNOWN if invalid, then the driveway proxy, then the zone of a junction, else the road.

    region: INTERSECTION, IN_INTERSECTION, NEAR_INTERSECTION_APPROACH, NEAR_INTERSECTION_EXIT, ROAD_SEGMENT or another;
    distance: along the lane to the junction's gate, or from its border.
    """
    near = (region == "NEAR_INTERSECTION_APPROACH") & (distance <= approach) | (region == "NEAR_INTERSECTION_EXIT") & (distance <= leaving)
    zone = region.isin("INTERSECTION", "IN_INTERSECTION") | F.coalesce(near, F.lit(False))
    road = region.isin("ROAD_SEGMENT", "NEAR_INTERSECTION_APPROACH", "NEAR_INTERSECTION_EXIT")
    return F.when(~valid, "UNKNOWN").when(driveway, "PARKING_LOT_PROXY").when(zone, "INTERSECTION").when(road, "ROAD_SEGMENT").otherwise("UNKNOWN")


def road_subtype(category: Column, arms: Column, lanes: Column) -> Column:
    """Subtype of a frame's category by the junction's arms or the number of lanes."""
    junction = F.when(arms == 3, "THREE_ARM_INTERSECTION").when(arms == 4, "FOUR_ARM_INTERSECTION").otherwise("OTHER_INTERSECTION")
    road = F.when(lanes > 0, F.concat(F.lit("LANE_COUNT_"), lanes.cast("string"))).otherwise("UNKNOWN_LANE_COUNT")
    return F.when(category == "PARKING_LOT_PROXY", "DRIVEWAY_POLYGON_PROXY").when(category == "INTERSECTION", junction).when(category == "ROAD_SEGMENT", road).otherwise("UNKNOWN")


def soft_targets(distances: DataFrame, keys: list[str], token: str, distance: str, smoothing: float = 0.1, legacy: bool = False) -> DataFrame:
    """keys, token, weight: 1 - smoothing on the nearest token, the rest over the others by inverse squared distance; sums to 1.

    legacy: the rest is divided by the sum of the inverse squares twice, so the weights do not sum to 1.
    """
    from pyspark.sql import Window

    way = Window.partitionBy(*keys)
    ranked = distances.withColumn("_first", F.row_number().over(way.orderBy(distance, token)) == 1)
    inverse = F.when(~F.col("_first"), 1.0 / ((F.col(distance) + 1e-4) * (F.col(distance) + 1e-4))).otherwise(0.0)
    ranked = ranked.withColumns({"_i": inverse, "_n": F.count(F.lit(1)).over(way)}).withColumn("_s", F.sum("_i").over(way))
    rest = F.when(F.col("_n") > 1, F.lit(smoothing)).otherwise(0.0)
    share = F.col("_i") / F.col("_s") / F.col("_s") if legacy else F.col("_i") / F.col("_s")
    return ranked.select(*keys, token, F.when(F.col("_first"), 1.0 - rest).otherwise(rest * share).alias("weight"))


def first_per_key(df: DataFrame, key: str, order: list[str], shard_rows: int) -> DataFrame:
    """The first row of each key in an order, with the shard of `shard_rows` rows, by key, that it belongs to."""
    from pyspark.sql import Window

    first = df.withColumn("_k", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("_k = 1").drop("_k")
    return first.withColumn("shard", F.floor(F.col(key) / shard_rows))
