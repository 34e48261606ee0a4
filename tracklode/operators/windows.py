"""Operators over ordered frames: islands, gradients, differences, gaps, segments.

Every window is partitioned by the track, so a shuffle on the track key serves a whole chain of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def islands(df: DataFrame, keys: list[str], frame: str) -> DataFrame:
    """Half-open runs of consecutive frames for each key: keys, start, end. Repeated frames count once."""
    numbered = df.select(*keys, frame).distinct().withColumn("_island", F.col(frame) - F.row_number().over(Window.partitionBy(*keys).orderBy(frame)))
    return numbered.groupBy(*keys, "_island").agg(F.min(frame).alias("start"), (F.max(frame) + 1).alias("end")).drop("_island")


def run_ids(df: DataFrame, keys: list[str], frame: str, value: Column, name: str = "run") -> DataFrame:
    """df with the number of the run of equal values (null-safe) that each row is in, from 1 for each key."""
    way = Window.partitionBy(*keys).orderBy(frame)
    changed = F.when(F.row_number().over(way) == 1, 1).otherwise((~value.eqNullSafe(F.lag(value).over(way))).cast("int"))
    return df.withColumn("_changed", changed).withColumn(name, F.sum("_changed").over(way)).drop("_changed")


def sustained(df: DataFrame, keys: list[str], frame: str, flag: str, minimum: int, name: str = "sustained") -> DataFrame:
    """df with whether the row's flag is true in a run of at least `minimum` rows."""
    runs = run_ids(df, keys, frame, F.coalesce(F.col(flag), F.lit(False)), "_run")
    size = F.count(F.lit(1)).over(Window.partitionBy(*keys, "_run"))
    return runs.withColumn(name, F.coalesce(F.col(flag), F.lit(False)) & (size >= minimum)).drop("_run")


def motion_modes(df: DataFrame, keys: list[str], frame: str, vx: str = "vx", vy: str = "vy", heading: str = "heading", valid: str = "valid", stationary: float = 0.2, direction: float = 0.3, minimum: int = 3) -> DataFrame:
    """df with mode: UNKNOWN, STATIONARY, LATERAL, and FORWARD or REVERSE where that holds for `minimum` rows in a run."""
    lon = F.col(vx) * F.cos(heading) + F.col(vy) * F.sin(heading)
    speed = F.sqrt(F.col(vx) * F.col(vx) + F.col(vy) * F.col(vy))
    df = df.withColumns({"_lon": lon, "_speed": speed, "_ok": F.col(valid) & speed.isNotNull() & F.col(heading).isNotNull()})
    moving = F.col("_ok") & (F.col("_speed") >= stationary)
    df = df.withColumns({"_fwd": moving & (F.col("_lon") >= direction), "_rev": moving & (F.col("_lon") <= -direction)})
    df = sustained(sustained(df, keys, frame, "_fwd", minimum, "_is_fwd"), keys, frame, "_rev", minimum, "_is_rev")
    mode = F.when(~F.coalesce("_ok", F.lit(False)), "UNKNOWN").when(F.col("_speed") < stationary, "STATIONARY").when(F.col("_is_rev"), "REVERSE").when(F.col("_is_fwd"), "FORWARD").otherwise("LATERAL")
    return df.withColumn("mode", mode).drop("_lon", "_speed", "_ok", "_fwd", "_rev", "_is_fwd", "_is_rev")


def fill_short_gaps(df: DataFrame, keys: list[str], frame: str, valid: str, most: int, name: str = "filled") -> DataFrame:
    """df with validity in which invalid runs of at most `most` rows between valid rows count as valid."""
    runs = run_ids(df, keys, frame, F.col(valid), "_run")
    own = Window.partitionBy(*keys, "_run")
    track = Window.partitionBy(*keys)
    last, first = F.max("_run").over(track), F.lit(1)
    inner = (F.col("_run") > first) & (F.col("_run") < last)
    return runs.withColumn(name, F.col(valid) | (inner & (F.count(F.lit(1)).over(own) <= most))).drop("_run")


def interpolate(df: DataFrame, keys: list[str], at: str, value: str, valid: str, name: str = "interpolated") -> DataFrame:
    """df with value, linear in `at` between the nearest valid rows; the first and the last of them hold beyond the ends."""
    way = Window.partitionBy(*keys).orderBy(at)
    point = F.when(F.col(valid), F.struct(F.col(at).alias("t"), F.col(value).alias("v")))
    before = F.last(point, ignorenulls=True).over(way.rowsBetween(Window.unboundedPreceding, 0))
    after = F.first(point, ignorenulls=True).over(way.rowsBetween(0, Window.unboundedFollowing))
    df = df.withColumns({"_b": before, "_a": after})
    inner = F.col("_b.v") + (F.col("_a.v") - F.col("_b.v")) * (F.col(at) - F.col("_b.t")) / (F.col("_a.t") - F.col("_b.t"))
    return df.withColumn(name, F.when(F.col("_b").isNull(), F.col("_a.v")).when(F.col("_a").isNull(), F.col("_b.v")).when(F.col("_a.t") == F.col("_b.t"), F.col("_b.v")).otherwise(inner)).drop("_b", "_a")


def gradient(df: DataFrame, keys: list[str], at: str, value: str, name: str = "gradient") -> DataFrame:
    """df with d value / d at: second order inside for any spacing, one-sided at the ends, 0 for a single row."""
    way = Window.partitionBy(*keys).orderBy(at)
    f, t = F.col(value), F.col(at)
    df = df.withColumns({"_f0": F.lag(f).over(way), "_f2": F.lead(f).over(way), "_t0": F.lag(t).over(way), "_t2": F.lead(t).over(way)})
    hs, hd = t - F.col("_t0"), F.col("_t2") - t
    inner = (hs * hs * F.col("_f2") + (hd * hd - hs * hs) * f - hd * hd * F.col("_f0")) / (hs * hd * (hs + hd))
    left, right = (f - F.col("_f0")) / hs, (F.col("_f2") - f) / hd
    return df.withColumn(name, F.when(F.col("_t0").isNull() & F.col("_t2").isNull(), F.lit(0.0)).when(F.col("_t0").isNull(), right).when(F.col("_t2").isNull(), left).otherwise(inner)).drop("_f0", "_f2", "_t0", "_t2")


def uniform_gradient(df: DataFrame, keys: list[str], frame: str, value: str, dt: float, name: str = "gradient") -> DataFrame:
    """df with the gradient for uniform spacing, second order at the ends too; null for runs of fewer than 3 rows."""
    way = Window.partitionBy(*keys).orderBy(frame)
    f = F.col(value)
    n = {k: F.lag(f, -k).over(way) if k < 0 else F.lead(f, k).over(way) for k in (-2, -1, 1, 2)}
    df = df.withColumns({f"_n{k + 2}": c for k, c in n.items()} | {"_size": F.count(F.lit(1)).over(Window.partitionBy(*keys)), "_pos": F.row_number().over(way)})
    first = (-3 * f + 4 * F.col("_n3") - F.col("_n4")) / (2 * dt)
    last = (3 * f - 4 * F.col("_n1") + F.col("_n0")) / (2 * dt)
    inner = (F.col("_n3") - F.col("_n1")) / (2 * dt)
    return df.withColumn(name, F.when(F.col("_size") < 3, F.lit(None).cast("double")).when(F.col("_pos") == 1, first).when(F.col("_pos") == F.col("_size"), last).otherwise(inner)).drop("_n0", "_n1", "_n3", "_n4", "_size", "_pos")


def central_difference(df: DataFrame, keys: list[str], frame: str, at: str, value: str, valid: str, name: str) -> DataFrame:
    """df with name = (next - previous) / (their distance in `at`) and name_valid: both neighbours valid; null where not."""
    way = Window.partitionBy(*keys).orderBy(frame)
    span = F.lead(at).over(way) - F.lag(at).over(way)
    ok = F.coalesce(F.lag(valid).over(way) & F.lead(valid).over(way), F.lit(False))
    return df.withColumn(f"{name}_valid", ok).withColumn(name, F.when(F.col(f"{name}_valid") & (span > 0), (F.lead(value).over(way) - F.lag(value).over(way)) / span))


def clamped(df: DataFrame, keys: list[str], frame: str, value: str, back: int, ahead: int) -> DataFrame:
    """df with past and future: value so many rows back and ahead, that of the first or last row beyond the ends."""
    way = Window.partitionBy(*keys).orderBy(frame)
    whole = way.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    first, last = F.first(value).over(whole), F.last(value).over(whole)
    pos, size = F.row_number().over(way), F.count(F.lit(1)).over(Window.partitionBy(*keys))
    past = F.when(pos <= back, first).otherwise(F.lag(value, back).over(way))
    future = F.when(pos > size - ahead, last).otherwise(F.lead(value, ahead).over(way))
    return df.withColumns({"past": past, "future": future})


def hopping_segments(df: DataFrame, keys: list[str], frame: str, value: str, size: int, step: int) -> DataFrame:
    """keys, start, values: the `size` values from every frame that is a multiple of step, where all of them exist."""
    spread = df.select(*keys, frame, value, F.explode(F.sequence(F.greatest(F.lit(0), F.ceil((F.col(frame) - size + 1) / step).cast("int")), F.floor(F.col(frame) / step).cast("int"))).alias("_hop"))
    grouped = spread.groupBy(*keys, (F.col("_hop") * step).alias("start")).agg(F.array_sort(F.collect_list(F.struct(F.col(frame).alias("f"), F.col(value).alias("v")))).alias("_all"))
    return grouped.where(F.size("_all") == size).select(*keys, "start", F.transform("_all", lambda x: x["v"]).alias("values"))


def token_pairs(df: DataFrame, keys: list[str], step: str, token: str) -> DataFrame:
    """Adjacent tokens of each track: keys, step, prev, cur."""
    way = Window.partitionBy(*keys).orderBy(step)
    return df.select(*keys, step, F.lag(token).over(way).alias("prev"), F.col(token).alias("cur")).where(F.col("prev").isNotNull())
