"""Joins: audited, defaulted, nearest, radius, crossing; global ranges; set audits."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A table of at most so many rows is broadcast.
BROADCAST_ROWS = 200_000
#: Tokens of a vocabulary that are sent to tasks at once.
BLOCK_TOKENS = 16_384


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if it has at most so many rows, else as it is."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def aligned(left: DataFrame, right: DataFrame, keys: list[str], compare: list[str]) -> DataFrame:
    """Full outer audit of a 1:1 join: keys, status (matched, left_only, right_only, duplicate, mismatch)."""
    side = lambda df, s: df.groupBy(*keys).agg(F.count(F.lit(1)).alias(f"_{s}"), *[F.min(c).alias(f"_{s}_{c}") for c in compare])
    both = side(left, "l").join(side(right, "r"), keys, "full_outer")
    differs = ~F.lit(True)
    for c in compare:
        differs = differs | ~F.col(f"_l_{c}").eqNullSafe(F.col(f"_r_{c}"))
    status = F.when(F.col("_r").isNull(), "left_only").when(F.col("_l").isNull(), "right_only").when((F.col("_l") > 1) | (F.col("_r") > 1), "duplicate").when(differs, "mismatch").otherwise("matched")
    return both.select(*keys, status.alias("status"))


def with_default(left: DataFrame, right: DataFrame, key: str, defaults: dict[str, object]) -> DataFrame:
    """Left join with defaults for the right's columns and has_match."""
    picked = right.select(key, *defaults).withColumn("has_match", F.lit(True))
    out = left.join(picked, key, "left").withColumn("has_match", F.coalesce("has_match", F.lit(False)))
    return out.withColumns({c: F.coalesce(c, F.lit(v)) for c, v in defaults.items()})


def prompts_for(agents: DataFrame, mapping: DataFrame, prompts: DataFrame) -> DataFrame:
    """agents (scenario, agent) with prompt, empty if there is none, and has_prompt.

    mapping: scenario, scene. prompts: scene, agent, prompt. A scenario without a scene has no prompts.
    """
    found = agents.join(mapping, "scenario", "left").join(prompts, ["scene", "agent"], "left")
    return found.select(*agents.columns, F.coalesce("prompt", F.lit("")).alias("prompt"), (F.coalesce("prompt", F.lit("")) != "").alias("has_prompt"))


def squared_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x)


def nearest_token(rows: DataFrame, tokens: DataFrame, row_id: str, vector: str, token_id: str, token_vector: str, block: int = BLOCK_TOKENS) -> DataFrame:
    """Per row: the token with the smallest squared distance, the smallest id among equals: row_id, token, d2.

    Rows meet the vocabulary in Arrow batches, block by block of at most `block` tokens, so a block is all that is ever
    sent to the tasks at once; the best of the blocks is taken at the end. Rows without a vector have no token.
    """
    n = tokens.count()
    blocks = max(1, -(-n // block))
    kinds = [rows.schema[row_id].dataType.simpleString(), tokens.schema[token_id].dataType.simpleString()]
    parts = []
    for i in range(blocks):
        own = tokens.where(F.pmod(F.xxhash64(token_id), F.lit(blocks)) == i).orderBy(token_id).select(token_id, token_vector).toPandas()
        if not len(own):
            continue
        ids, words = own[token_id].to_numpy(), np.stack(own[token_vector].to_numpy()).astype(np.float64)

        def nearest(batches: Iterator[pa.RecordBatch], ids=ids, words=words) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                flat = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(batch.num_rows, words.shape[1])
                step = max(1, 4_000_000 // words.size)
                d2 = np.concatenate([((flat[k : k + step, None, :] - words[None]) ** 2).sum(axis=2) for k in range(0, len(flat), step)]) if len(flat) else np.zeros((0, len(words)))
                at = d2.argmin(axis=1)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids[at]), pa.array(d2[np.arange(len(at)), at])], [row_id, "token", "d2"])

        parts.append(rows.where(F.col(vector).isNotNull()).select(row_id, vector).mapInArrow(nearest, f"`{row_id}` {kinds[0]}, token {kinds[1]}, d2 double"))
    if len(parts) == 1:
        return parts[0]
    every = parts[0] if parts else rows.select(row_id, F.lit(None).cast(kinds[1]).alias("token"), F.lit(None).cast("double").alias("d2")).where("false")
    for part in parts[1:]:
        every = every.unionByName(part)
    return every.groupBy(row_id).agg(F.min(F.struct("d2", "token")).alias("b")).select(row_id, "b.token", "b.d2")


def radius_pairs(a: DataFrame, b: DataFrame, keys: list[str], radius: float, most: int | None = None, same_id: bool = True) -> DataFrame:
    """Pairs (keys, id, other, d2) of points at most radius apart within a key; at most the `most` nearest of each a.

    Points meet through grid cells of the radius: b is placed in its own cell and its eight neighbours, so the join is
    an equality on key and cell. a and b: keys, id, x, y.
    """
    cell = lambda c: F.floor(F.col(c) / radius).cast("long")
    left = a.select(*keys, "id", "x", "y", cell("x").alias("_cx"), cell("y").alias("_cy"))
    steps = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    right = b.select(*keys, F.col("id").alias("other"), F.col("x").alias("_x"), F.col("y").alias("_y"), cell("x").alias("_bx"), cell("y").alias("_by"), F.explode(steps).alias("_s"))
    right = right.withColumns({"_cx": F.col("_bx") + F.col("_s.i"), "_cy": F.col("_by") + F.col("_s.j")})
    dx, dy = F.col("x") - F.col("_x"), F.col("y") - F.col("_y")
    pairs = left.join(right, [*keys, "_cx", "_cy"]).withColumn("d2", dx * dx + dy * dy).where(F.col("d2") <= radius * radius)
    pairs = pairs.where(F.col("id") != F.col("other")) if same_id else pairs
    if most is not None:
        pairs = pairs.withColumn("_n", F.row_number().over(Window.partitionBy(*keys, "id").orderBy("d2", "other"))).where(F.col("_n") <= most)
    return pairs.select(*keys, "id", "other", "d2")


def crossings(positions: DataFrame, gates: DataFrame, keys: list[str], gate: str, frame: str, at: str, gate_at: str, stops: list[str]) -> DataFrame:
    """Rows where a track passes its gate while the gate's state is one of stops: behind in the frame before, past it now.

    positions: keys, gate, frame, at. gates: gate, frame, gate_at, state.
    """
    joined = positions.join(gates, [gate, frame])
    rel = F.col(at) - F.col(gate_at)
    way = Window.partitionBy(*keys, gate).orderBy(frame)
    out = joined.withColumns({"_rel": rel, "_before": F.lag(rel).over(way), "_gap": F.col(frame) - F.lag(frame).over(way)})
    return out.where((F.col("_gap") == 1) & (F.col("_before") < 0) & (F.col("_rel") >= 0) & F.col("state").isin(stops)).select(*keys, gate, frame)


def points_in_polygons(points: DataFrame, polygons: DataFrame, point_id: str, polygon_id: str, cell: float = 10.0) -> DataFrame:
    """(point, polygon) pairs: even-odd rule, the border counts as inside.

    points: id, x, y. polygons: id, ring array<struct<x,y>> (not closed). Points and the polygons' bounding boxes meet in
    grid cells of `cell`, so the join is an equality; the box filters before the exact test.
    """
    n = F.size("ring")
    edges = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct(F.get("ring", i).alias("a"), F.get("ring", (i + 1) % n).alias("b")))
    boxes = polygons.select(polygon_id, "ring", edges.alias("_e"), F.array_min(F.transform("ring", lambda p: p["x"])).alias("_x0"), F.array_max(F.transform("ring", lambda p: p["x"])).alias("_x1"), F.array_min(F.transform("ring", lambda p: p["y"])).alias("_y0"), F.array_max(F.transform("ring", lambda p: p["y"])).alias("_y1"))
    x, y = F.col("x"), F.col("y")
    cross = lambda e: (e["b"]["x"] - e["a"]["x"]) * (y - e["a"]["y"]) - (e["b"]["y"] - e["a"]["y"]) * (x - e["a"]["x"])
    on = F.exists("_e", lambda e: (F.abs(cross(e)) <= 1e-7) & (x >= F.least(e["a"]["x"], e["b"]["x"])) & (x <= F.greatest(e["a"]["x"], e["b"]["x"])) & (y >= F.least(e["a"]["y"], e["b"]["y"])) & (y <= F.greatest(e["a"]["y"], e["b"]["y"])))
    crossing = lambda e: ((e["a"]["y"] > y) != (e["b"]["y"] > y)) & (x < (e["b"]["x"] - e["a"]["x"]) * (y - e["a"]["y"]) / (e["b"]["y"] - e["a"]["y"]) + e["a"]["x"])
    inside = F.size(F.filter("_e", crossing)) % 2 == 1
    hit = (x >= F.col("_x0")) & (x <= F.col("_x1")) & (y >= F.col("_y0")) & (y <= F.col("_y1"))
    at = lambda c: F.floor(F.col(c) / cell).cast("long")
    boxes = boxes.withColumn("_cx", F.explode(F.sequence(at("_x0"), at("_x1")))).withColumn("_cy", F.explode(F.sequence(at("_y0"), at("_y1"))))
    placed = points.withColumns({"_cx": at("x"), "_cy": at("y")})
    return placed.join(boxes, ["_cx", "_cy"]).where(hit & (on | inside)).select(point_id, polygon_id)


def global_range(df: DataFrame, source: str, record: str, start: int, count: int) -> DataFrame:
    """Rows start .. start + count of the sources laid end to end in order: source, record, global_index.

    One prefix sum over the sources (a row each) gives the offsets; nothing is sorted globally.
    """
    sizes = df.groupBy(source).agg((F.max(record) + 1).alias("_n"))
    before = sizes.select(source, (F.sum("_n").over(Window.orderBy(source)) - F.col("_n")).alias("_b"))
    return df.join(F.broadcast(before), source).withColumn("global_index", F.col("_b") + F.col(record)).where((F.col("global_index") >= start) & (F.col("global_index") < start + count)).drop("_b")


def key_audit(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """side ('both', 'only_a', 'only_b') and the number of distinct keys on it."""
    x, y = a.select(key), b.select(key)
    sides = [("both", x.intersect(y)), ("only_a", x.distinct().exceptAll(y.distinct())), ("only_b", y.distinct().exceptAll(x.distinct()))]
    parts = [d.agg(F.count(F.lit(1)).alias("n")).withColumn("side", F.lit(s)) for s, d in sides]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def bounded_hops(edges: DataFrame, seeds: DataFrame, hops: int) -> DataFrame:
    """(node, hop): nodes within so many edges of a seed, by their smallest number of edges. edges: src, dst; seeds: node."""
    reached = seeds.select("node").distinct().withColumn("hop", F.lit(0))
    frontier = reached
    for h in range(1, hops + 1):
        step = frontier.select(F.col("node").alias("src")).join(edges, "src").select(F.col("dst").alias("node")).distinct()
        frontier = step.join(reached, "node", "left_anti").withColumn("hop", F.lit(h)).persist()  # read by every later hop
        reached = reached.unionByName(frontier)
    return reached
