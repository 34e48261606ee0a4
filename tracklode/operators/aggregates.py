"""Moments, percentiles and completed count tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def finite(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))


def unpivot_metrics(df: DataFrame, scope: str, metrics: list[str]) -> DataFrame:
    """scope, metric, value."""
    return df.select(F.col(scope).alias("scope"), F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics])).alias("m")).select("scope", "m.*")


def exact_percentiles(df: DataFrame, keys: list[str], value: str, shares: dict[str, float], buckets: int = 64) -> DataFrame:
    """keys and, for each name in shares, the linearly interpolated percentile of value. Null keys are keys like any other.

    Equal values are counted first. Approximate quantiles of a key only deal its values to `buckets` ranges, in which
    running counts give exact ranks; so neither a key nor a hot value is a task of its own.
    """
    counted = df.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("_v")).agg(F.count(F.lit(1)).alias("_c"))
    bounds = df.groupBy(*keys).agg(F.percentile_approx(value, F.array(*[F.lit(i / buckets) for i in range(1, buckets)]), F.lit(10 * buckets)).alias("_bounds"))
    same = lambda a, b: [F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}")) for k in keys]
    dealt = counted.alias("x").join(bounds.alias("y"), same("x", "y")).select(*[F.col(f"x.{k}").alias(k) for k in keys], "_v", "_c", F.size(F.filter("_bounds", lambda b: b < F.col("_v"))).alias("_bucket"))
    totals = dealt.groupBy(*keys, "_bucket").agg(F.sum("_c").alias("_t"))
    order = Window.partitionBy(*keys).orderBy("_bucket")
    totals = totals.withColumns({"_before": F.sum("_t").over(order) - F.col("_t"), "_n": F.sum("_t").over(Window.partitionBy(*keys))})
    ranked = dealt.alias("x").join(totals.alias("y"), [*same("x", "y"), F.col("x._bucket") == F.col("y._bucket")]).select(*[F.col(f"x.{k}").alias(k) for k in keys], F.col("x._bucket").alias("_bucket"), "_v", "_c", "_before", "_n")
    inside = Window.partitionBy(*keys, "_bucket").orderBy("_v")
    ranked = ranked.withColumn("_first", F.col("_before") + F.sum("_c").over(inside) - F.col("_c"))
    parts = []
    for name, p in shares.items():
        at = (F.col("_n") - 1) * F.lit(p)
        low = F.max(F.when(F.col("_first") <= F.floor(at), F.col("_v")))
        high = F.max(F.when(F.col("_first") <= F.ceil(at), F.col("_v")))
        parts.append((low + (high - low) * F.max(at - F.floor(at))).alias(name))
    return ranked.groupBy(*keys).agg(*parts)


def scoped_moments(samples: DataFrame, low: float = 0.01, high: float = 0.99) -> DataFrame:
    """Per metric, and scope or 'all': count, mean, population deviation, min, max, range, exact percentiles, their spread.

    samples: (scope, metric, value). Only finite values count.
    """
    rows = samples.where(finite(F.col("value")))
    v = F.col("value")
    both = rows.select(F.explode(F.array("scope", F.lit("all"))).alias("scope"), "metric", "value")
    moments = both.groupBy("scope", "metric").agg(F.count(v).alias("n"), F.avg(v).alias("mean"), F.stddev_pop(v).alias("std"), F.min(v).alias("min"), F.max(v).alias("max"))
    p = exact_percentiles(both, ["scope", "metric"], "value", {"p_low": low, "p_high": high})
    out = moments.alias("x").join(p.alias("y"), [F.col(f"x.{k}").eqNullSafe(F.col(f"y.{k}")) for k in ("scope", "metric")])
    return out.select("x.scope", "x.metric", "n", "mean", "std", "min", "max", (F.col("max") - F.col("min")).alias("range"), "p_low", "p_high", (F.col("p_high") - F.col("p_low")).alias("spread"))


def completed_counts(df: DataFrame, outer: str, inner: str, outer_values: list[str], inner_values: list[str]) -> DataFrame:
    """Counts for every pair of listed values, zeros included, with ALL rows over outer, and the share of the outer's rows.

    The value lists are the dimension; they come from the data model, not from the data.
    """
    spark = df.sparkSession
    counted = df.groupingSets([[outer, inner], [inner]], outer, inner).agg(F.grouping(outer).alias("_all"), F.count(F.lit(1)).alias("n"))
    counted = counted.select(F.when(F.col("_all") == 1, "ALL").otherwise(F.col(outer)).alias(outer), inner, "n")
    frame = spark.createDataFrame([(o, i) for o in [*outer_values, "ALL"] for i in inner_values], f"{outer} string, {inner} string")
    full = frame.join(counted, [outer, inner], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    totals = df.groupingSets([[outer], []], outer).agg(F.grouping(outer).alias("_all"), F.count(F.lit(1)).alias("total")).select(F.when(F.col("_all") == 1, "ALL").otherwise(F.col(outer)).alias(outer), "total")
    return full.join(totals, outer, "left").select(outer, inner, "n", F.when(F.col("total") > 0, 100.0 * F.col("n") / F.col("total")).otherwise(0.0).alias("percent"))


def dimension_stats(df: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Per key: rows, and mean, min and max of the positive finite values of each column."""
    out = [F.count(F.lit(1)).alias("n")]
    for c in columns:
        v = F.when(finite(F.col(c).cast("double")) & (F.col(c) > 0), F.col(c).cast("double"))
        out += [F.avg(v).alias(f"mean_{c}"), F.min(v).alias(f"min_{c}"), F.max(v).alias(f"max_{c}")]
    return df.groupBy(*keys).agg(*out)


def hierarchy(df: DataFrame, top: str, child: str) -> DataFrame:
    """Two-level roll-up: top, child, n with ALL at the summed levels."""
    rolled = df.rollup(top, child).agg(F.grouping(top).alias("_t"), F.grouping(child).alias("_c"), F.count(F.lit(1)).alias("n"))
    return rolled.select(F.when(F.col("_t") == 1, "ALL").otherwise(F.col(top).cast("string")).alias(top), F.when(F.col("_c") == 1, "ALL").otherwise(F.col(child).cast("string")).alias(child), "n")


def masked_mean(value: Column, valid: Column) -> Column:
    return F.avg(F.when(valid, value))


def min_over_replicas(df: DataFrame, keys: list[str], replica: str, value: str, valid: str) -> DataFrame:
    """(value, keys): over keys with a valid row, the mean of the smallest sum of valid values of a replica by the number of valid rows."""
    v = F.when(F.col(valid), F.col(value))
    per = df.groupBy(*keys, replica).agg(F.sum(v).alias("s"), F.count(v).alias("n"))
    best = per.where("n > 0").groupBy(*keys).agg(F.min("s").alias("s"), F.max("n").alias("n"))
    return best.agg(F.avg(F.col("s") / (F.col("n") + 1e-6)).alias("value"), F.count(F.lit(1)).alias("keys"))
