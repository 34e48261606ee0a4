"""Shared pieces of the training-data operators: tables, lineage cuts, connected components.

Intermediate tables go to the folder that the session names in ``spark.checkpoint.dir``; every executor and the
driver see that folder, so a lost executor costs a re-read, never a recomputation of a long chain.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Texts go to Python workers in batches of at most so many rows and about so many bytes.
BATCH_ROWS, BATCH_BYTES = 2000, 8 << 20


def small_batches(spark: SparkSession) -> None:
    """Bound the batches that tasks exchange with their Python workers, unless the session sets smaller ones."""
    for name, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        now = spark.conf.get(name, None)
        if now is None or not now.lstrip("-").isdigit() or not 0 < int(now) <= most:
            spark.conf.set(name, str(most))


def shared_dir(spark: SparkSession) -> str:
    """The folder for intermediate tables: spark.checkpoint.dir, or a new temporary one where a local session has none."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors see")
        base = "file://" + tempfile.mkdtemp(prefix="tracklode-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/tracklode/{label}-{uuid.uuid4().hex}"


def cut(df: DataFrame, label: str = "table") -> DataFrame:
    """Write df to the shared folder and read it back: later steps start from files, not from df's lineage."""
    path = new_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: A list of at most so many keys is broadcast to drop rows; a longer one is joined by a shuffle.
BROADCAST_KEYS = 1_000_000


def without(df: DataFrame, keys: DataFrame, on) -> DataFrame:
    """Rows of df that match no row of keys."""
    keys = cut(keys, "keys")
    return df.join(F.broadcast(keys) if keys.count() <= BROADCAST_KEYS else keys, on, "left_anti")


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node that has an edge; component is the smallest node reachable.

    Each round hooks every label to its smallest neighbouring label, flattens the hooks by pointer jumping, relabels
    the edges and drops those inside one label, so the edge list shrinks until it is empty. A hub with very many
    edges is fine: minima are pre-aggregated and the joins read files, which lets AQE split a hot key.
    Self-loops and null ends are ignored; an empty edge list gives an empty result.
    """
    lo, hi = F.least(a, b).alias("lo"), F.greatest(a, b).alias("hi")
    live = cut(edges.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(lo, hi).where("lo < hi").distinct(), "edges")
    mapping = None
    while not live.isEmpty():
        hooks = cut(live.groupBy("hi").agg(F.min("lo").alias("parent")).withColumnRenamed("hi", "node"), "hooks")
        while True:  # pointer jumping: each pass halves the depth of the hook forest
            up = hooks.select(F.col("node").alias("parent"), F.col("parent").alias("grand"))
            jumped = cut(hooks.join(up, "parent", "left").select("node", F.coalesce("grand", "parent").alias("parent"), F.col("grand").isNotNull().alias("moved")), "hooks")
            moved = not jumped.where("moved").isEmpty()
            hooks = jumped.select("node", "parent")
            if not moved:
                break
        if mapping is None:
            roots = live.select(F.col("lo").alias("node")).distinct().join(hooks, "node", "left_anti").select("node", F.col("node").alias("component"))
            mapping = cut(hooks.select("node", F.col("parent").alias("component")).unionByName(roots), "labels")
        else:
            mapping = cut(mapping.join(hooks.select(F.col("node").alias("component"), "parent"), "component", "left").select("node", F.coalesce("parent", "component").alias("component")), "labels")
        for end in ("lo", "hi"):
            live = live.join(hooks.select(F.col("node").alias(end), F.col("parent").alias(f"{end}_to")), end, "left").withColumn(end, F.coalesce(f"{end}_to", end)).drop(f"{end}_to")
        live = cut(live.select(F.least("lo", "hi").alias("lo"), F.greatest("lo", "hi").alias("hi")).where("lo < hi").distinct(), "edges")
    return live.select(F.col("lo").alias("node"), F.col("hi").alias("component")) if mapping is None else mapping
