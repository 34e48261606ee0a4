"""Metric values that arrive batch by batch and survive a restart: a batch counts once its commit is written.

A batch is a folder of values and, written after it, a commit with its number of rows. A run that is cut off between the two
leaves a folder without a commit: it is not read, and the next append of that batch overwrites it. A batch that is
committed is not written again, so a batch may be offered as often as a stream or a restarted job likes. A store belongs to
the identity (settings and inputs) it was opened with first. Batches are appended by one writer at a time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .manifests import stable_fingerprint

VALUES = "level string, scope string, metric string, value double"
COMMITS = "rows long, identity string"


class MetricStore:
    def __init__(self, spark: SparkSession, path: str, identity: object):
        self.spark, self.path, self.identity = spark, path.rstrip("/"), stable_fingerprint(identity)
        # A commit without a row, so that the folders exist; it carries no batch number.
        for name, schema in (("values", VALUES), ("commits", COMMITS)):
            spark.createDataFrame([], schema).write.mode("append").parquet(f"{self.path}/{name}/batch=-1")
        other = self.commits().where(F.col("identity") != self.identity).limit(1).collect()
        if other:
            raise ValueError(f"{path} belongs to another run: its identity is {other[0].identity}")

    def commits(self) -> DataFrame:
        """(rows, identity, batch)."""
        return self.spark.read.schema(f"{COMMITS}, batch long").parquet(f"{self.path}/commits")

    def append(self, batch: int, values: DataFrame) -> bool:
        """Write the finite values (level, scope, metric, value) as batch; False if it is committed already."""
        if batch < 0:
            raise ValueError("a batch has a number from 0 on")
        if not self.commits().where(F.col("batch") == batch).isEmpty():
            return False
        v = F.col("value").cast("double")
        finite = values.where(v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
        place = f"{self.path}/values/batch={batch}"
        finite.select("level", "scope", "metric", v.alias("value")).write.mode("overwrite").parquet(place)
        written = self.spark.read.schema(VALUES).parquet(place)
        commit = written.agg(F.count(F.lit(1)).alias("rows")).withColumn("identity", F.lit(self.identity))
        commit.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/commits/batch={batch}")
        return True

    def append_batch(self, values: DataFrame, batch: int) -> None:
        """For foreachBatch of a stream, whose restart offers its last batch again."""
        self.append(batch, values)

    def values(self) -> DataFrame:
        """(level, scope, metric, value, batch) of all committed batches; a batch of other than its committed number of rows is an error."""
        commits = self.commits()
        stored = self.spark.read.schema(f"{VALUES}, batch long").parquet(f"{self.path}/values")
        kept = stored.join(F.broadcast(commits.select("batch")), "batch", "left_semi")  # a row for each batch
        found = kept.groupBy("batch").agg(F.count(F.lit(1)).alias("found"))
        wrong = commits.join(found, "batch", "left").where(F.coalesce("found", F.lit(0)) != F.col("rows")).limit(1).collect()
        if wrong:
            raise ValueError(f"batch {wrong[0].batch}: {wrong[0].found or 0} rows of {wrong[0].rows} that were committed")
        return kept.select("level", "scope", "metric", "value", "batch")

    def counts(self) -> DataFrame:
        """(level, scope, metric, n)."""
        return self.values().groupBy("level", "scope", "metric").agg(F.count(F.lit(1)).alias("n"))
