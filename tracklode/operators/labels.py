"""Decision lists over states, and tables learned from token pairs."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.angles import wrap_angle

# Thresholds of the size classes, in metres and metres per second (19 ft, 4 ft 9 in, 24 km/h).
MOTORCYCLE_LENGTH_M, MOTORCYCLE_WIDTH_M, LARGE_LENGTH_M = 3.0, 1.2, 5.7912
CHILD_HEIGHT_M, EBIKE_SPEED_MPS = 1.4478, 24.0 / 3.6


# The tags of a frame, what they are called, which comes first, and which later tags an earlier one excludes.
TAG_PHRASES = {
    "Parked": "parked", "Straight": "moving straight", "LeftTurn": "turning left", "RightTurn": "turning right", "LeftLaneChange": "changing lanes left", "RightLaneChange": "changing lanes right",
    "Accelerate": "accelerating", "Decelerate": "decelerating", "Stopping": "slowing down to a stop", "KeepSpeed": "keeping a steady speed",
}
TAG_PRIORITY = {"LeftTurn": 1, "RightTurn": 1, "LeftLaneChange": 1, "RightLaneChange": 1, "Straight": 2, "Accelerate": 3, "Decelerate": 3, "Stopping": 3, "KeepSpeed": 3, "Parked": 4}
TAG_EXCLUDES = {
    "Parked": set(TAG_PHRASES) - {"Parked"}, "Straight": {"LeftTurn", "RightTurn", "Parked", "LeftLaneChange", "RightLaneChange"},
    "LeftTurn": {"RightTurn", "Straight", "LeftLaneChange", "RightLaneChange"}, "RightTurn": {"LeftTurn", "Straight", "LeftLaneChange", "RightLaneChange"},
    "LeftLaneChange": {"RightLaneChange", "Straight", "LeftTurn", "RightTurn", "Parked"}, "RightLaneChange": {"LeftLaneChange", "Straight", "LeftTurn", "RightTurn", "Parked"},
    "Accelerate": {"Parked"}, "Decelerate": {"Parked"}, "Stopping": {"Parked"}, "KeepSpeed": {"Parked"},
}


def size_class(kind: Column, length: Column, width: Column, height: Column, speed: Column) -> Column:
    """Size and speed class of an object: kind 1 vehicle, 2 pedestrian, 3 cyclist."""
    bad = lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")) | (c <= 0)
    pace = F.when(speed.isNull() | F.isnan(speed) | (F.abs(speed) == float("inf")) | (speed < 0), 0.0).otherwise(speed)
    vehicle = F.when((length <= MOTORCYCLE_LENGTH_M) & (width <= MOTORCYCLE_WIDTH_M), "MOTORCYCLE_PROXY").when(length > LARGE_LENGTH_M, "LARGE_VEHICLE_PROXY").otherwise("SMALL_VEHICLE_PROXY")
    walker = F.when(height < CHILD_HEIGHT_M, "CHILD_PEDESTRIAN_PROXY").otherwise("ADULT_PEDESTRIAN_PROXY")
    rider = F.when(pace >= EBIKE_SPEED_MPS, "E_BIKE_PROXY").otherwise("BICYCLE_PROXY")
    return F.when(bad(length) | bad(width) | bad(height), "INVALID_DIMENSIONS").when(kind == 1, vehicle).when(kind == 2, walker).when(kind == 3, rider).otherwise("UNSUPPORTED_OBJECT_TYPE")


def tag_phrase(tag: Column) -> Column:
    """What a tag is called."""
    return F.get(F.array(*map(F.lit, TAG_PHRASES.values())), F.array_position(F.array(*map(F.lit, TAG_PHRASES)), tag).cast("int") - 1)


def tag_rank(tag: Column) -> Column:
    """The priority of a tag; 99 for others."""
    return F.coalesce(F.get(F.array(*map(F.lit, TAG_PRIORITY.values())), F.nullif(F.array_position(F.array(*map(F.lit, TAG_PRIORITY)), tag), F.lit(0)).cast("int") - 1), F.lit(99))


def frame_tags(action: Column, speed: Column, acceleration: Column, stop_speed: float = 0.2, threshold: float = 0.5) -> Column:
    """Array of a direction tag and a speed tag."""
    turning = {"LEFT_TURN": "LeftTurn", "RIGHT_TURN": "RightTurn", "LEFT_LANE_CHANGE": "LeftLaneChange", "RIGHT_LANE_CHANGE": "RightLaneChange"}
    pace = F.abs(speed)
    direction = F.lit(None).cast("string")
    for name, tag in turning.items():
        direction = F.when(action == name, F.lit(tag)).otherwise(direction)
    direction = F.when(direction.isNotNull(), direction).when((action != "U_TURN") & (pace > stop_speed), F.lit("Straight"))
    motion = F.when(pace <= stop_speed, "Parked").when(acceleration > threshold, "Accelerate").when(acceleration < -threshold, "Decelerate").otherwise("KeepSpeed")
    return F.array_compact(F.array(direction, motion))


def action_class(kind: Column, speed: Column, heading: Column, past: Column, future: Column, far: Column, acceleration: Column, lane_change: Column | None = None, stop_speed: float = 0.2, threshold: float = 0.5, turn: float = 0.25, u_turn: float = math.radians(160.0)) -> Column:
    """Action of a frame from its speed, the headings around it and its acceleration; pedestrian limits are half as large.

    lane_change: left or right where the frame lies in a vehicle's lane change, else null.
    """
    lane_change = F.lit(None).cast("string") if lane_change is None else lane_change
    walker, wheels = kind == 2, kind.isin(1, 3)
    ahead, behind = wrap_angle(future - heading), wrap_angle(heading - past)
    half = F.when(walker, 0.5).otherwise(1.0)
    speeds = F.when(acceleration > threshold * half, "ACCELERATE").when(acceleration < -threshold * half, "DECELERATE").otherwise("KEEP_SPEED")
    return (
        F.when(~(wheels | walker), "UNLABELED")
        .when(F.abs(speed) < stop_speed * half, "STOP")
        .when((kind == 1) & (lane_change == "left"), "LEFT_LANE_CHANGE")
        .when((kind == 1) & (lane_change == "right"), "RIGHT_LANE_CHANGE")
        .when((kind == 1) & (F.abs(wrap_angle(far - past)) > u_turn), "U_TURN")
        .when(wheels & ((ahead > turn) | (behind > turn)), "LEFT_TURN")
        .when(wheels & ((ahead < -turn) | (behind < -turn)), "RIGHT_TURN")
        .otherwise(speeds)
    )


def shrunken_transitions(pairs: DataFrame, tokens: DataFrame, kind: str, values: list[str], strength: float) -> DataFrame:
    """Dense table (kind, prev, cur) of mean values, shrunk to the mean of cur, which falls back to the token's own value.

    pairs: kind, prev, cur and values. tokens: kind, token and values, the vocabulary; the table has its square of rows.
    """
    sums = lambda by, tag: pairs.groupBy(kind, *by).agg(F.count(F.lit(1)).alias(f"_n{tag}"), *[F.sum(v).alias(f"_s{tag}_{v}") for v in values])
    dense = tokens.select(kind, F.col("token").alias("prev")).join(tokens.select(kind, F.col("token").alias("cur"), *[F.col(v).alias(f"_own_{v}") for v in values]), kind)
    table = dense.join(sums(["prev", "cur"], "p"), [kind, "prev", "cur"], "left").join(sums(["cur"], "m"), [kind, "cur"], "left")
    n = F.coalesce("_np", F.lit(0))
    mean = lambda v: F.coalesce(F.col(f"_sm_{v}") / F.col("_nm"), F.col(f"_own_{v}"))
    return table.select(kind, "prev", "cur", n.alias("n"), *[((F.coalesce(F.col(f"_sp_{v}"), F.lit(0.0)) + strength * mean(v)) / (n + strength)).alias(v) for v in values])


def disk_cover(rows: DataFrame, kind: str, row_id: str, vector: str, clusters: int, tolerance: float, seed: int = 0) -> DataFrame:
    """Greedy disk cover for each kind: (kind, cluster, pivot, members, mean).

    The first pivot is the row with the smallest id, later ones are drawn from the rows left; a cluster is all rows left
    within the tolerance of its pivot, and its mean is theirs. A sequential choice over a bounded sample of a kind, hence a
    grouped function.
    """
    key = rows.schema[kind].dataType.simpleString()
    pivot = rows.schema[row_id].dataType.simpleString()

    def cover(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(row_id)
        v, ids = np.stack(part[vector].to_numpy()).astype(np.float64), part[row_id].to_numpy()
        rng, left, out = np.random.default_rng(seed), np.arange(len(part)), []
        while len(left) and len(out) < clusters:
            p = left[0] if not out else left[rng.integers(len(left))]
            near = np.sqrt(((v[left] - v[p]) ** 2).sum(axis=1)) <= tolerance
            out.append((part[kind].iloc[0], len(out), ids[p], int(near.sum()), v[left[near]].mean(axis=0).tolist()))
            left = left[~near]
        return pd.DataFrame(out, columns=[kind, "cluster", "pivot", "members", "mean"])

    return rows.select(kind, row_id, vector).groupBy(kind).applyInPandas(cover, f"`{kind}` {key}, cluster int, pivot {pivot}, members int, mean array<double>")
