"""Registered queries over framed record files that are written from the trajectories of the events table."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import framed, records
from ..sources.metric_store import MetricStore
from ..sources.store import new_path
from .queries import query, r6
from .tables import table, tracks

SHARDS, FRAMES = 6, 91


def scenes(spark: SparkSession, sf: str) -> DataFrame:
    """Eight tracks over 91 frames: scene, tracks (id, kind, states in the order of frames)."""
    t = tracks(spark, sf).withColumns({"scene": F.floor(F.col("track_id") / 8), "part": F.floor(F.col("frame") / FRAMES)})
    state = F.struct((F.col("frame") % FRAMES).cast("int").alias("step"), "x", "y", "heading", "vx", "vy", "valid", "kind")
    per = t.groupBy("scene", "part", "track_id").agg(F.array_sort(F.collect_list(state)).alias("states"))
    return per.groupBy("scene", "part").agg(F.array_sort(F.collect_list(F.struct("track_id", "states"))).alias("tracks"))


def shard(scene: Column) -> Column:
    return (F.floor(scene / (1 << 28)) + scene % (1 << 28)) % SHARDS


SHARD_SQL = f"(scene // 268435456 + scene % 268435456) % {SHARDS}"


def encode(batches):
    for batch in records.pieces(batches):
        out = []
        for scene, part, group in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            message = {"scenario_id": f"{scene}_{part}", "timestamps_seconds": [k / 10 for k in range(FRAMES)], "current_time_index": 10, "sdc_track_index": 0}
            message["tracks"] = [{"id": t["track_id"] % 8, "object_type": t["states"][0]["kind"], "states": [{"center_x": s["x"], "center_y": s["y"], "heading": s["heading"], "velocity_x": s["vx"], "velocity_y": s["vy"], "valid": s["valid"]} for s in t["states"]]} for t in group]
            out.append(records.encode(message, records.SCENARIO))
        yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(out, pa.binary())], ["scene", "part", "payload"])


def record_index(spark: SparkSession, sf: str) -> DataFrame:
    """The offset index of the scenes, written to numbered files; ranges are small, so that a file has several."""
    payloads = scenes(spark, sf).mapInArrow(encode, "scene long, part long, payload binary")
    file = F.format_string(f"events-%05d-of-{SHARDS:05d}", shard(F.col("scene")))
    folder = new_path(spark, "records")
    framed.write_records(payloads.select(file.alias("file"), F.struct("scene", "part").alias("order"), "payload"), folder, files=SHARDS)
    return framed.index_files(framed.shards(spark, folder), split_bytes=1 << 18)


@query("""
WITH $TRACKS, k AS (SELECT t.*, t.track_id // 8 AS scene, frame // 91 AS part FROM t)
SELECT scene || '_' || part AS scenario_id, track_id % 8 AS track, first_value(kind) OVER (PARTITION BY scene, part, track_id ORDER BY frame) AS object_type, CAST(frame % 91 AS INTEGER) AS frame_index,
  round((frame % 91) / 10.0, 6) AS t, round(x, 6) AS x, round(y, 6) AS y, round(CAST(CAST(heading AS FLOAT) AS DOUBLE), 4) AS heading, round(vx, 6) AS vx, round(vy, 6) AS vy, valid FROM k
""")
def record_states(spark, sf):
    """Files of scenario messages, read in byte ranges, decoded, and exploded into states."""
    states = records.track_states(records.scenarios(framed.read_index(record_index(spark, sf))))
    return states.select("scenario_id", F.col("track_id").cast("long").alias("track"), F.col("object_type").cast("long").alias("object_type"), "frame_index", *r6("t", "x", "y"), F.round(F.col("heading").cast("double"), 4).alias("heading"), *[F.round(F.col(c).cast("double"), 6).alias(c) for c in ("vx", "vy")], "valid")


@query(f"""
WITH $TRACKS, s AS (SELECT DISTINCT track_id // 8 AS scene, frame // 91 AS part FROM t)
SELECT CAST(k AS INTEGER) AS shard, count(scene) AS records FROM range({SHARDS}) r(k) JOIN s ON {SHARD_SQL} = k GROUP BY k
""")
def record_counts(spark, sf):
    """Records of each file, from the lengths alone."""
    got = framed.count_records(record_index(spark, sf))
    return got.select(F.regexp_extract("path", r"(\d{5})-of", 1).cast("int").alias("shard"), "records")


@query(f"""
WITH $TRACKS, s AS (SELECT DISTINCT track_id // 8 AS scene, frame // 91 AS part FROM t),
g AS (SELECT *, row_number() OVER (ORDER BY {SHARD_SQL}, scene, part) - 1 AS global_index FROM s)
SELECT global_index, scene || '_' || part AS scenario_id FROM g WHERE global_index >= 5
""")
def selected_records(spark, sf):
    """Scenario names of the records from the sixth on, by their place in all files."""
    got = framed.read_selected(record_index(spark, sf), start=5)
    return got.select("global_index", records.scenario_name(F.col("payload")).alias("scenario_id"))


@query("""
SELECT event_type AS scope, count(*) AS n, round(sum(value), 4) AS total, round(quantile_cont(value, 0.01), 6) AS p_low, round(quantile_cont(value, 0.99), 6) AS p_high FROM events WHERE isfinite(value) GROUP BY 1
""")
def stored_metrics(spark, sf):
    """Values stored in three batches, with a batch offered twice and one that was cut off before its commit, and summed up."""
    values = table(spark, sf, "events").select(F.lit("frame").alias("level"), F.col("event_type").alias("scope"), F.lit("value").alias("metric"), "value", (F.col("event_id") % 3).alias("k"))
    path = new_path(spark, "metrics")
    for k in (0, 1, 1, 2):
        MetricStore(spark, path, {"source": "events"}).append(k, values.where(F.col("k") == k))
    values.drop("k").write.parquet(f"{path}/values/batch=3")  # as a run leaves it that ends before its commit
    got = MetricStore(spark, path, {"source": "events"}).values().groupBy("scope").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"), F.percentile("value", F.array(F.lit(0.01), F.lit(0.99))).alias("p"))
    return got.select("scope", "n", "total", F.round(F.col("p")[0], 6).alias("p_low"), F.round(F.col("p")[1], 6).alias("p_high"))
