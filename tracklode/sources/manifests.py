"""Resumable outputs: fingerprints, a manifest of finished shards, audits, bucketed tag files."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import scene_bucket

MANIFEST = "source string, records long, first_index long, last_index long, fingerprint string"


def stable_fingerprint(payload: object) -> str:
    """SHA-256 of canonical JSON: sorted keys, no spaces."""
    return hashlib.sha256(json.dumps(payload, sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()).hexdigest()


def source_fingerprints(spark: SparkSession, path: str) -> DataFrame:
    """(source, fingerprint) of the files under path, from their size and modification time."""
    files = spark.read.format("binaryFile").load(path)
    return files.select(F.col("path").alias("source"), F.sha2(F.concat_ws("|", "path", F.col("length").cast("string"), F.unix_micros("modificationTime").cast("string")), 256).alias("fingerprint"))


def unfinished(current: DataFrame, manifest: DataFrame) -> DataFrame:
    """Sources (source, fingerprint) that no row of the manifest covers as they are now."""
    return current.join(manifest.select("source", "fingerprint"), ["source", "fingerprint"], "left_anti")


def shard_audit(rows: DataFrame, manifest: DataFrame, source: str = "source", index: str = "record_index") -> DataFrame:
    """Per source: ok, or why its rows differ from the manifest (missing, extra, count, range, duplicate)."""
    found = rows.groupBy(F.col(source).alias("source")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct(index).alias("d"), F.min(index).alias("lo"), F.max(index).alias("hi"))
    both = manifest.join(found, "source", "full_outer")
    status = F.when(F.col("n").isNull(), "missing").when(F.col("records").isNull(), "extra").when(F.col("n") != F.col("d"), "duplicate").when(F.col("n") != F.col("records"), "count").when((F.col("lo") != F.col("first_index")) | (F.col("hi") != F.col("last_index")), "range").otherwise("ok")
    return both.select("source", status.alias("status"))


def write_tags(tags: DataFrame, path: str, scene: str = "scene_id", tag: str = "tag_text") -> None:
    """One row of sorted tags per scene, partitioned by the scene's bucket."""
    per = tags.groupBy(scene).agg(F.array_sort(F.collect_list(tag)).alias("tags"))
    per.withColumn("bucket", scene_bucket(F.col(scene))).write.partitionBy("bucket").mode("overwrite").json(path)


def owners_once(mapping: DataFrame, key: str, owner: str) -> DataFrame:
    """Keys that have several owners; an empty result is the assertion."""
    return mapping.groupBy(key).agg(F.count_distinct(owner).alias("owners")).where("owners > 1")
