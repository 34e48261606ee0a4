"""Outliers of tracks: residuals to the neighbours, short flips of the heading; difference metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.angles import wrap_angle


def residual_outliers(df: DataFrame, keys: list[str], frame: str, at: str, value: str, valid: str, least: float, sigma: float = 6.0, support: float = 1.0) -> DataFrame:
    """keys, frame, rejected for the valid rows: far from the line between its valid neighbours.

    The residual must exceed `least`, the median by sigma times 1.4826 median deviations, and `support` times the
    distance of the neighbours. The first and the last valid row are never rejected. Medians are those of one track.
    """
    way = Window.partitionBy(*keys).orderBy(frame)
    rows = df.where(F.col(valid)).withColumns({f"_{n}{k}": f(c).over(way) for n, c in (("v", value), ("t", at)) for k, f in ((0, F.lag), (2, F.lead))})
    span = F.col("_t2") - F.col("_t0")
    line = F.col("_v0") + (F.col(at) - F.col("_t0")) / span * (F.col("_v2") - F.col("_v0"))
    rows = rows.withColumns({"_r": F.when(span > 0, F.abs(F.col(value) - line)), "_s": F.abs(F.col("_v2") - F.col("_v0"))})
    track = Window.partitionBy(*keys)
    rows = rows.withColumn("_m", F.median("_r").over(track)).withColumn("_d", F.median(F.abs(F.col("_r") - F.col("_m"))).over(track))
    bar = F.greatest(F.lit(least), F.col("_m") + sigma * 1.4826 * F.col("_d"))
    return rows.select(*keys, frame, F.coalesce((F.col("_r") > bar) & (F.col("_r") > support * F.col("_s")), F.lit(False)).alias("rejected"))


def heading_flips(df: DataFrame, keys: list[str], frame: str, heading: str, valid: str, spike: float, support: float, most: int) -> DataFrame:
    """keys, frame: valid rows in a run of at most `most` between two jumps of more than `spike`, if the headings around it agree within `support` (radians)."""
    way = Window.partitionBy(*keys).orderBy(frame)
    rows = df.where(F.col(valid) & F.col(heading).isNotNull()).select(*keys, frame, F.col(heading).alias("_h"), F.row_number().over(way).alias("_k"), F.lead(heading).over(way).alias("_h2"))
    jumps = rows.where(F.abs(wrap_angle(F.col("_h2") - F.col("_h"))) > spike)
    order = Window.partitionBy(*keys).orderBy("_k")
    pairs = jumps.withColumns({"_k2": F.lead("_k").over(order), "_after": F.lead("_h2").over(order)})
    flips = pairs.where((F.col("_k2") - F.col("_k") <= most) & (F.abs(wrap_angle(F.col("_h") - F.col("_after"))) <= support))
    gone = flips.select(*keys, F.explode(F.sequence(F.col("_k") + 1, F.col("_k2"))).alias("_k")).distinct()
    return rows.join(gone, [*keys, "_k"]).select(*keys, frame)


def third_difference(values: Column, dt: float = 0.1) -> Column:
    """Mean absolute third difference of an array, divided by dt cubed; null for fewer than four values."""
    at = lambda i: F.get(values, i)
    thirds = F.transform(F.sequence(F.lit(0), F.size(values) - 4), lambda i: F.abs(at(i + 3) - 3 * at(i + 2) + 3 * at(i + 1) - at(i)))
    return F.when(F.size(values) >= 4, F.aggregate(thirds, F.lit(0.0), lambda s, x: s + x) / F.size(thirds) / dt**3)
