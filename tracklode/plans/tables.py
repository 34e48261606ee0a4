"""The driver's tables as the engine's long tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.angles import wrap_angle


FRAMES = 91


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as trajectories: 91 events of a user in order are the frames of a track, and the state follows from id and value.

    A track is bounded however many events a user has. Its number divided by 8 is that of its scene: the tracks that eight
    neighbouring users have in the same place of their order.
    """
    user, frame = F.col("user_id"), F.col("place") % FRAMES
    track = (F.floor(user / 8) * (1 << 28) + F.floor(F.col("place") / FRAMES)) * 8 + user % 8
    return states(spark, sf_dir, track, frame)


def histories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as trajectories of any length: a user is a track, its events in order are frames."""
    return states(spark, sf_dir, F.col("user_id"), F.col("place"))


def states(spark: SparkSession, sf_dir: str, track: Column, frame: Column) -> DataFrame:
    e = table(spark, sf_dir, "events")
    e = e.withColumn("place", (F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1).cast("long"))
    mod = lambda n: (F.col("event_id") % n).cast("double")
    return e.select(
        track.cast("long").alias("track_id"), frame.cast("long").alias("frame"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("t"), F.col("value").alias("x"), (mod(97) / 10.0).alias("y"),
        wrap_angle(F.col("value") * 0.37).alias("heading"), (mod(11) - 5.0).alias("vx"), (mod(5) - 2.0).alias("vy"), (F.col("event_id") % 7 != 0).alias("valid"), F.col("event_type").alias("type"), (1 + F.col("event_id") % 3).alias("kind"), "event_id",
    )


TRACKS_SQL = """t AS (
  SELECT (user_id // 8 * 268435456 + place // 91) * 8 + user_id % 8 AS track_id, place % 91 AS frame,
    epoch_us(ts) / 1e6 AS t, value AS x, CAST(event_id % 97 AS DOUBLE) / 10.0 AS y,
    value * 0.37 - 2 * pi() * floor((value * 0.37 + pi()) / (2 * pi())) AS heading, CAST(event_id % 11 AS DOUBLE) - 5.0 AS vx, CAST(event_id % 5 AS DOUBLE) - 2.0 AS vy,
    event_id % 7 <> 0 AS valid, event_type AS type, 1 + event_id % 3 AS kind, event_id
  FROM (SELECT *, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS BIGINT) AS place FROM events))"""


HISTORIES_SQL = TRACKS_SQL.replace("(user_id // 8 * 268435456 + place // 91) * 8 + user_id % 8 AS track_id, place % 91 AS frame", "user_id AS track_id, place AS frame")
