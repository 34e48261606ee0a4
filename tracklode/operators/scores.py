"""Scores of predictions and reconstructions, and counts that are counted again."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .windows import central_difference


def mode_displacement(modes: DataFrame, keys: list[str], step: str) -> DataFrame:
    """(value, keys): the likeliest mode's displacement, summed over valid steps by their number, as a mean over keys with a valid step.

    modes: keys, step, mode, logit, distance (to the true place), valid. Ties take the lowest mode.
    """
    best = modes.groupBy(*keys, step).agg(F.min_by(F.struct("distance", "valid"), F.struct((-F.col("logit")).alias("l"), "mode")).alias("b"))
    valid = F.col("b.valid")
    per = best.groupBy(*keys).agg(F.sum(F.when(valid, F.col("b.distance"))).alias("s"), F.count_if(valid).alias("n"))
    return per.where("n > 0").agg(F.avg(F.col("s") / (F.col("n") + 1e-6)).alias("value"), F.count(F.lit(1)).alias("keys"))


def cross_entropy(rows: DataFrame, keys: list[str], logit: str, target: str) -> DataFrame:
    """keys, loss: minus the sum over a key's rows of target times the log softmax of logit."""
    top = rows.withColumn("_top", F.max(logit).over(Window.partitionBy(*keys)))
    sums = top.groupBy(*keys, "_top").agg(F.sum(F.exp(F.col(logit) - F.col("_top"))).alias("_z"), F.sum(F.col(target) * F.col(logit)).alias("_s"), F.sum(target).alias("_w"))
    return sums.select(*keys, (F.col("_w") * (F.col("_top") + F.ln("_z")) - F.col("_s")).alias("loss"))


def track_evaluation(df: DataFrame, keys: list[str], frame: str, raw: str, raw_valid: str, new: str, new_valid: str) -> DataFrame:
    """keys, raw_rms, new_rms, full_rms, coverage, rmse: jerk of a raw and a reconstructed series, and their distance.

    raw_rms and new_rms are taken on the raw support, and only if all of it is matched; full_rms on all of the new one.
    """
    for name, value, valid in (("r", raw, raw_valid), ("n", new, new_valid)):
        df = central_difference(df, keys, frame, frame, value, valid, f"_{name}1")
        df = central_difference(df, keys, frame, frame, f"_{name}1", f"_{name}1_valid", f"_{name}2")
        df = central_difference(df, keys, frame, frame, f"_{name}2", f"_{name}2_valid", f"_{name}3")
    r, n = F.col("_r3").isNotNull(), F.col("_n3").isNotNull()
    both = F.when(F.col(raw_valid) & F.col(new_valid), F.col(new) - F.col(raw))
    square = lambda c: c * c
    per = df.groupBy(*keys).agg(
        F.count_if(r).alias("_support"), F.count_if(r & n).alias("_matched"), F.sqrt(F.avg(square(F.col("_r3")))).alias("raw_rms"), F.sqrt(F.avg(F.when(r, square(F.col("_n3"))))).alias("new_rms"),
        F.sqrt(F.avg(square(F.col("_n3")))).alias("full_rms"), F.sqrt(F.avg(square(both))).alias("rmse"),
    )
    whole = F.col("_matched") == F.col("_support")
    coverage = F.when(F.col("_support") > 0, F.col("_matched") / F.col("_support"))
    return per.select(*keys, F.when(whole, F.col("raw_rms")).alias("raw_rms"), F.when(whole, F.col("new_rms")).alias("new_rms"), "full_rms", coverage.alias("coverage"), "rmse")


def shares(df: DataFrame, group: str, values: list[str]) -> DataFrame:
    """group, n, share of all rows, and the mean absolute value of each of values."""
    per = df.groupBy(group).agg(F.count(F.lit(1)).alias("n"), *[F.avg(F.abs(v)).alias(f"mean_{v}") for v in values])
    return per.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy()))  # one row for each group


def recounts(df: DataFrame, keys: list[str], distinct: str) -> DataFrame:
    """keys, n, and how many different values of `distinct` they have."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.countDistinct(distinct).alias(f"n_{distinct}"))


def merged_counts(summaries: DataFrame, counts: str) -> DataFrame:
    """name, n: the sums of map columns of counts."""
    return summaries.select(F.explode(counts).alias("name", "n")).groupBy("name").agg(F.sum("n").alias("n"))


def scenario_summary(df: DataFrame, scenario: str, category: str, subtype: str, reason: str) -> DataFrame:
    """scenario, frames, categories (sorted), counts by category/subtype (sorted), and the reasons of unknown frames with their number."""
    pairs = df.groupBy(scenario, category, subtype).agg(F.count(F.lit(1)).alias("n"))
    name = F.concat_ws("/", category, subtype)
    counted = pairs.groupBy(scenario).agg(F.sum("n").alias("frames"), F.array_sort(F.collect_set(category)).alias("categories"), F.array_sort(F.collect_list(F.struct(name.alias("name"), "n"))).alias("counts"))
    unknown = df.where(F.col(category) == "UNKNOWN").groupBy(scenario, reason).agg(F.count(F.lit(1)).alias("n")).groupBy(scenario).agg(F.array_sort(F.collect_list(F.struct(F.col(reason).alias("name"), "n"))).alias("unknown"))
    return counted.join(unknown, scenario, "left")
