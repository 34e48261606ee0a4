"""Interaction features between objects of one scene and step."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TTC_CAP_S = 5.0


def time_to_collision(objects: DataFrame, keys: list[str], cap: float = TTC_CAP_S) -> DataFrame:
    """keys, id, ttc: seconds until the nearest followed object is reached at the present speeds, at most cap.

    objects: keys (a scene and step), id, x, y, heading, length, width, speed. An object is followed if it is ahead, its
    heading differs by at most 75 degrees (not wrapped), and it overlaps laterally; where the overlap is under half a
    metre, by at most 10 degrees. Pairs are formed within a scene and step only.
    """
    other = objects.select(*keys, *[F.col(c).alias(f"_{c}") for c in ("id", "x", "y", "heading", "length", "width", "speed")])
    dx, dy = F.col("_x") - F.col("x"), F.col("_y") - F.col("y")
    lon = dx * F.cos("heading") + dy * F.sin("heading")
    lat = dy * F.cos("heading") - dx * F.sin("heading")
    turn = F.abs(F.col("_heading") - F.col("heading"))
    half_l = (F.col("length") + F.abs(F.cos(turn)) * F.col("_length") + F.abs(F.sin(turn)) * F.col("_width")) / 2
    half_w = (F.col("width") + F.abs(F.sin(turn)) * F.col("_length") + F.abs(F.cos(turn)) * F.col("_width")) / 2
    pairs = objects.join(other, keys).where(F.col("id") != F.col("_id")).withColumns({"_gap": lon - half_l, "_over": F.abs(lat) - half_w, "_turn": turn})
    ahead = pairs.where((F.col("_gap") > 0) & (F.col("_turn") <= math.radians(75)) & (F.col("_over") < 0) & ((F.col("_over") < -0.5) | (F.col("_turn") <= math.radians(10))))
    nearest = ahead.groupBy(*keys, "id").agg(F.min(F.struct("_gap", "_id", (F.col("speed") - F.col("_speed")).alias("closing"))).alias("n"))
    ttc = F.when(F.col("n.closing") > 0, F.least(F.lit(cap), F.col("n._gap") / F.col("n.closing"))).otherwise(cap)
    return objects.select(*keys, "id").join(nearest.select(*keys, "id", ttc.alias("ttc")), [*keys, "id"], "left").withColumn("ttc", F.coalesce("ttc", F.lit(cap)))


def displacement(pred: DataFrame, truth: DataFrame, keys: list[str], replica: str, step: str) -> DataFrame:
    """keys, ade (mean over replicas of the mean displacement) and min_ade (the best replica's); valid true steps only."""
    joined = pred.join(truth.where("valid").select(*keys, step, F.col("x").alias("_tx"), F.col("y").alias("_ty")), [*keys, step])
    d = F.sqrt((F.col("x") - F.col("_tx")) * (F.col("x") - F.col("_tx")) + (F.col("y") - F.col("_ty")) * (F.col("y") - F.col("_ty")))
    per = joined.groupBy(*keys, replica).agg(F.avg(d).alias("d"))
    return per.groupBy(*keys).agg(F.avg("d").alias("ade"), F.min("d").alias("min_ade"))
