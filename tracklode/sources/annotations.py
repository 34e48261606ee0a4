"""Readers of per-frame CSV rows and of annotation shards (JSON lines), plain or gz, with checks that stop a bad read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, DoubleType, LongType, StringType, StructType

#: Fixed value: what the name of an annotation shard ends with, behind the name of its source; .gz may follow.
SHARD_SUFFIX = ".map-annotations.jsonl"


def strict(column: Column, kind: DataType, name: str) -> Column:
    """column cast to kind; a value that does not cast, null included, stops the read."""
    cast = column.try_cast(kind)
    return F.when(cast.isNotNull(), cast).otherwise(F.raise_error(F.concat(F.lit(f"invalid {name}="), F.coalesce(column, F.lit("null")))).cast(kind))


def read_rows(spark: SparkSession, paths: list[str], numbers: dict[str, DataType], texts: list[str], key: str) -> DataFrame:
    """The named columns of CSV files with a header, matched by name in each file.

    A file that lacks a column, a number that does not parse and an empty key stop the read. Empty texts are null.
    Files are read by their own headers, one scan each, so their columns may be ordered differently; other columns are not read.
    """
    wanted = [*numbers, *texts]
    if key not in texts:
        raise ValueError(f"{key} is not among the text columns")
    parts = []
    for path in paths:
        df = spark.read.option("header", True).csv(path)
        missing = sorted(set(wanted) - set(df.columns))
        if missing:
            raise ValueError(f"{path}: missing required columns {missing}")
        parts.append(df.select(*[F.col(c).cast("string").alias(c) for c in wanted]))
    if not parts:
        raise ValueError("no files to read")
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part)
    keyed = F.when(F.coalesce(F.col(key), F.lit("")) != "", F.col(key)).otherwise(F.raise_error(F.lit(f"empty {key}")).cast(StringType()))
    return rows.select(*[strict(F.col(c), kind, c).alias(c) for c, kind in numbers.items()], *[(keyed if c == key else F.col(c)).alias(c) for c in texts])


def shard_source(path: Column) -> Column:
    """The source a shard's file name stands for; null for other names."""
    name = F.regexp_extract(path, r"([^/]+)" + SHARD_SUFFIX.replace(".", r"\.") + r"(\.gz)?$", 1)
    return F.when(name != "", F.url_decode(F.replace(name, F.lit("+"), F.lit("%2B"))))


def read_annotations(spark: SparkSession, path: str, body: StructType, version: int) -> tuple[DataFrame, DataFrame]:
    """(records, faults) of all shards under path.

    records: source_file, scenario_index, scenario_id and the fields of body, of the lines without an error of their own.
    faults (source_file, scenario_index, scenario_id, fault): lines of another version, from another source than their
    file's name says, without id or index, or with an index or id that their file holds twice; blank lines are skipped.
    An empty faults is the assertion that all records are sound; records leaves the faulty lines out.
    """
    schema = StructType([*body.fields]).add("schema_version", LongType()).add("source_file", StringType()).add("scenario_index", LongType()).add("scenario_id", StringType()).add("error", StringType())
    lines = spark.read.schema(schema).option("recursiveFileLookup", True).option("pathGlobFilter", f"*{SHARD_SUFFIX}*").json(path).withColumn("_shard", shard_source(F.col("_metadata.file_path")))
    lines = lines.withColumn("_failed", F.coalesce(F.col("error"), F.lit("")) != "")
    fault = (
        F.when(~F.col("schema_version").eqNullSafe(F.lit(version)), "version").when(~F.col("source_file").eqNullSafe(F.col("_shard")), "source").when(F.col("_failed"), None)
        .when(F.coalesce(F.col("scenario_id"), F.lit("")) == "", "scenario_id").when(F.col("scenario_index").isNull(), "scenario_index")
    )
    lines = lines.withColumn("_fault", fault)
    sound = lines.where(F.col("_fault").isNull() & ~F.col("_failed"))
    key = ["source_file", "scenario_index", "scenario_id"]
    twice = lambda c: sound.groupBy("source_file", c).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").drop("_n")
    by_index, by_id = sound.join(twice("scenario_index"), ["source_file", "scenario_index"], "left_semi"), sound.join(twice("scenario_id"), ["source_file", "scenario_id"], "left_semi")
    faults = lines.where(F.col("_fault").isNotNull()).select(*key, F.col("_fault").alias("fault"))
    faults = faults.unionByName(by_index.select(*key, F.lit("duplicate index").alias("fault"))).unionByName(by_id.select(*key, F.lit("duplicate id").alias("fault")))
    records = sound.join(twice("scenario_index"), ["source_file", "scenario_index"], "left_anti").join(twice("scenario_id"), ["source_file", "scenario_id"], "left_anti")
    return records.select(*key, *[f.name for f in body.fields]), faults


def sha256_of(spark: SparkSession, path: str) -> DataFrame:
    """(source, sha256) of the contents of the files under path; a file is one row, so under 2 GB."""
    return spark.read.format("binaryFile").load(path).select(F.col("path").alias("source"), F.sha2("content", 256).alias("sha256"))


#: The number columns of per-frame action rows.
ACTION_NUMBERS: dict[str, DataType] = {"global_index": LongType(), "dataset_current_time_index": LongType(), "frame_index": LongType(), "track_id": LongType(), "absolute_speed_mps": DoubleType(), "longitudinal_acceleration_mps2": DoubleType()}


def read_action_rows(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Per-frame action rows: ACTION_NUMBERS, scenario_id and action."""
    return read_rows(spark, paths, ACTION_NUMBERS, ["scenario_id", "action"], "scenario_id")
