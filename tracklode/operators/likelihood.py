"""Log-likelihood estimates of logged values under simulated samples, and weighted meta-metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def bin_of(x: Column, low: float, high: float, bins: int) -> Column:
    """Bin from 0; values outside are clamped, the last bin is closed, null and NaN go to the last bin."""
    clean = F.when(x.isNull() | F.isnan(x), F.lit(high)).otherwise(F.greatest(F.lit(low), F.least(F.lit(high), x)))
    return F.least(F.floor((clean - low) / ((high - low) / bins)), F.lit(bins - 1)).cast("int")


def histogram_log_likelihood(log: DataFrame, sim: DataFrame, keys: list[str], low: float, high: float, bins: int, pseudocount: float) -> DataFrame:
    """log rows (keys, value) with the log probability of their bin in the smoothed histogram of sim's values of the key."""
    cell = bin_of(F.col("value"), low, high, bins)
    counts = sim.groupBy(*keys, cell.alias("_bin")).agg(F.count(F.lit(1)).alias("_n"))
    totals = sim.groupBy(*keys).agg(F.count(F.lit(1)).alias("_all"))
    joined = log.withColumn("_bin", cell).join(totals, keys).join(counts, [*keys, "_bin"], "left")
    p = (F.coalesce("_n", F.lit(0)) + pseudocount) / (F.col("_all") + pseudocount * bins)
    return joined.withColumn("log_likelihood", F.ln(p)).drop("_bin", "_n", "_all")


def bernoulli_log_likelihood(log: DataFrame, sim: DataFrame, keys: list[str], pseudocount: float) -> DataFrame:
    """The same over booleans, two bins."""
    as_number = lambda df: df.withColumn("value", F.col("value").cast("int").cast("double"))
    return histogram_log_likelihood(as_number(log), as_number(sim), keys, 0.0, 1.0, 2, pseudocount)


def kernel_log_likelihood(log: DataFrame, sim: DataFrame, keys: list[str], row: list[str], bandwidth: float) -> DataFrame:
    """log rows with the Gaussian kernel density of sim's values at them, its logarithm relative to the kernel's height;
    densities below 1e-300 count as that.

    Equal values of sim are one with a count, and values meet those of their own and the neighbouring bins of 40 bandwidths:
    the kernel is 0 in doubles beyond 39.
    """
    cell = F.floor(F.greatest(F.lit(-1e15), F.least(F.lit(1e15), F.col("value") / (40.0 * bandwidth))))
    own = sim.select(*keys, "value")
    totals = own.groupBy(*keys).agg(F.count("value").alias("_all"), F.max(F.isnan("value")).alias("_nan"))
    counts = own.where("value is not null and not isnan(value)").groupBy(*keys, "value").agg(F.count(F.lit(1)).alias("_n")).withColumn("_bin", F.explode(F.sequence(cell - 1, cell + 1))).withColumnRenamed("value", "_s")
    z = (F.col("value") - F.col("_s")) / bandwidth
    asked = log.join(totals, keys).withColumn("_bin", cell)
    pairs = asked.join(counts, [*keys, "_bin"], "left")
    total = F.coalesce(F.sum(F.col("_n") * F.exp(-0.5 * z * z)), F.lit(0.0))
    density = F.when(F.col("_nan") | F.isnan("value"), F.lit(float("nan"))).when(F.col("_all") > 0, F.col("_t") / F.col("_all"))
    summed = pairs.groupBy(*keys, *row, "value", "_all", "_nan").agg(total.alias("_t"))
    return summed.select(*keys, *row, "value", F.ln(F.greatest(density, F.lit(1e-300))).alias("log_likelihood"))


def weighted_buckets(metrics: DataFrame, weights: DataFrame, keys: list[str]) -> DataFrame:
    """Per key and bucket: sum(weight * value) / sum(weight), and the meta-metric sum over all in bucket 'meta'.

    metrics: keys, metric, value. weights: metric, bucket, weight.
    """
    joined = metrics.join(weights, "metric")
    per = joined.groupBy(*keys, "bucket").agg((F.sum(F.col("weight") * F.col("value")) / F.sum("weight")).alias("value"))
    meta = joined.groupBy(*keys).agg(F.sum(F.col("weight") * F.col("value")).alias("value")).withColumn("bucket", F.lit("meta"))
    return per.unionByName(meta)
