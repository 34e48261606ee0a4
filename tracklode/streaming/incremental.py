"""Incremental processing of arriving files with checkpoints: each file counts exactly once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def drain(spark: SparkSession, source: str, schema: StructType, checkpoint: str, partials: str, keys: list[str], value: str, files_per_batch: int = 64) -> None:
    """Fold all files that have arrived since the last call into partial moments, then stop.

    Every micro-batch writes its partial rows under its batch number and overwrites them if it is run again, so a
    restart after a failure neither loses nor doubles a file.
    """

    def fold(batch: DataFrame, number: int) -> None:
        v = F.col(value).cast("double")
        rows = batch.where(v.isNotNull() & ~F.isnan(v)).groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.avg(v).alias("mean"), (F.var_pop(v) * F.count(v)).alias("m2"), F.min(v).alias("lo"), F.max(v).alias("hi"))
        rows.write.mode("overwrite").parquet(f"{partials}/batch={number}")

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(source)
    stream.writeStream.foreachBatch(fold).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def moments(spark: SparkSession, partials: str, keys: list[str]) -> DataFrame:
    """keys, n, mean, std, min, max from the partial rows, whose squared deviations are merged about the common mean."""
    rows = spark.read.parquet(partials)
    weighted = (F.sum(F.col("n") * F.col("mean")) / F.sum("n")).alias("mean")
    total = rows.groupBy(*keys).agg(F.sum("n").alias("n"), weighted, F.min("lo").alias("min"), F.max("hi").alias("max"))
    common = total.select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("mean").alias("_mean"))
    same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
    spread = rows.join(common, same).groupBy(*keys).agg(F.sum(F.col("m2") + F.col("n") * F.pow(F.col("mean") - F.col("_mean"), F.lit(2))).alias("_m2"))
    both = total.alias("t").join(spread.alias("s"), [F.col(f"t.{k}").eqNullSafe(F.col(f"s.{k}")) for k in keys])
    return both.select(*[F.col(f"t.{k}").alias(k) for k in keys], "n", "mean", F.sqrt(F.col("_m2") / F.col("n")).alias("std"), "min", "max")


def windowed_counts(events: DataFrame, width: str = "1 hour", lateness: str = "10 minutes") -> DataFrame:
    """Event-time counts and sums by type; late events are dropped after `lateness` when events is a stream."""
    source = events.withWatermark("ts", lateness) if events.isStreaming else events
    return source.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")
