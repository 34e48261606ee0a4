"""Agents of a scene: selection, shapes, training targets, history dynamics, edges over time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.angles import wrap_angle
from .aggregates import finite
from .windows import interpolate

# Limits of acceleration along, turning speed and acceleration across the heading.
DYNAMICS_LIMITS = (15.0, 3.0, 15.0)


def unwrapped(df: DataFrame, keys: list[str], frame: str, heading: str, valid: str, name: str = "unwrapped") -> DataFrame:
    """df with the heading of valid frames as a continuous angle, each step the wrapped one from the valid frame before."""
    way = Window.partitionBy(*keys).orderBy(frame)
    before = F.last(F.when(F.col(valid), F.col(heading)), ignorenulls=True).over(way.rowsBetween(Window.unboundedPreceding, -1))
    df = df.withColumn("_turn", F.when(F.col(valid), F.coalesce(wrap_angle(F.col(heading) - before), F.col(heading))))
    return df.withColumn(name, F.when(F.col(valid), F.sum("_turn").over(way))).drop("_turn")


def agent_features(df: DataFrame, keys: list[str], frame: str, history: int, columns: list[str], heading: str = "heading", valid: str = "valid") -> DataFrame:
    """keys, frame, columns, heading, observed for the agents that are valid at frame `history`.

    Frames from the first to the last valid one, linear in between; the heading is left unwrapped.
    """
    track = Window.partitionBy(*keys)
    chosen = F.max(F.when((F.col(frame) == history) & F.col(valid), 1)).over(track)
    first, last = F.min(F.when(F.col(valid), F.col(frame))).over(track), F.max(F.when(F.col(valid), F.col(frame))).over(track)
    kept = df.withColumns({"_chosen": chosen, "_first": first, "_last": last}).where("_chosen = 1")
    kept = unwrapped(kept, keys, frame, heading, valid, "_heading")
    for c in columns:
        kept = interpolate(kept, keys, frame, c, valid, f"_{c}_new")
    kept = interpolate(kept, keys, frame, "_heading", valid, "_heading_new").where(F.col(frame).between(F.col("_first"), F.col("_last")))
    return kept.select(*keys, frame, *[F.col(f"_{c}_new").alias(c) for c in columns], F.col("_heading_new").alias(heading), F.col(valid).alias("observed"))


def causal_shapes(df: DataFrame, keys: list[str], frame: str, valid: str, dimensions: list[str], history: int) -> DataFrame:
    """keys and dimensions: those of frame `history`; one that is not positive and finite is the mean of the usable ones up to there."""
    out = []
    for d in dimensions:
        usable = finite(F.col(d)) & (F.col(d) > 0)
        own = F.max(F.when(F.col(frame) == history, F.struct(F.col(d).alias("v"))))["v"]
        mean = F.avg(F.when(F.col(valid) & (F.col(frame) <= history) & usable, F.col(d)))
        out.append(F.when(finite(own) & (own > 0), own).otherwise(F.coalesce(mean, own)).alias(d))
    seen = df.where(F.col(frame) <= history).groupBy(*keys).agg(F.max(frame).alias("_at"), *out)
    return seen.where(F.col("_at") == history).drop("_at")


def target_mask(df: DataFrame, scene: str, agent: str, frame: str, current: int, most: int, seen_within: float = 150.0, train_within: float = 100.0, future: int = 5) -> DataFrame:
    """scene, agent, chosen: whether the agent is trained on.

    df: scene, agent, frame, x, y, valid, ego, role. States farther than seen_within from the ego do not count. An agent
    is chosen by its role, or if it is within train_within at the current frame and seen in `future` later frames; beyond
    `most` agents only those with a role stay, filled up in the order of a hash of their name.
    """
    ego = df.where("ego").select(scene, frame, F.col("x").alias("_ex"), F.col("y").alias("_ey"))
    dx, dy = F.col("x") - F.col("_ex"), F.col("y") - F.col("_ey")
    near = df.join(ego, [scene, frame]).withColumn("_d", F.sqrt(dx * dx + dy * dy))
    later = F.count_if((F.col(frame) > current) & F.col("valid") & (F.col("_d") < seen_within)) >= future
    close = F.coalesce(F.bool_or((F.col(frame) == current) & (F.col("_d") < train_within)), F.lit(False))
    agents = near.groupBy(scene, agent).agg(F.bool_or("role").alias("_role"), (close & later).alias("_extra"))
    all_ = Window.partitionBy(scene)
    picked = F.row_number().over(Window.partitionBy(scene, F.col("_extra") & ~F.col("_role")).orderBy(F.md5(F.col(agent).cast("string"))))
    agents = agents.withColumns({"_n": F.count_if(F.col("_role") | F.col("_extra")).over(all_), "_roles": F.count_if(F.col("_role")).over(all_), "_k": picked})
    filled = F.col("_role") | (F.col("_extra") & (F.col("_k") <= most - F.col("_roles")))
    return agents.select(scene, agent, F.when(F.col("_n") > most, filled).otherwise(F.col("_role") | F.col("_extra")).alias("chosen"))


def clip(c: Column, limit: float) -> Column:
    return F.greatest(F.lit(-limit), F.least(F.lit(limit), c))


def history_dynamics(df: DataFrame, keys: list[str], frame: str, endpoints: list[int], dt: float = 0.1, limits: tuple[float, float, float] = DYNAMICS_LIMITS) -> DataFrame:
    """keys, frame, along, turning, across, usable: backward differences over the three frames that end at an endpoint.

    df: x, y, heading, valid. Zero where one of the three frames is missing or invalid.
    """
    way = Window.partitionBy(*keys).orderBy(frame)
    back = {f"_{c}{k}": F.lag(c, k).over(way) for c in ("x", "y", "heading", "valid", frame) for k in (1, 2)}
    df = df.withColumns(back)
    usable = F.coalesce(F.col("valid") & F.col("_valid1") & F.col("_valid2") & (F.col(f"_{frame}2") == F.col(frame) - 2), F.lit(False))
    acc = [((F.col(c) - F.col(f"_{c}1")) / dt - (F.col(f"_{c}1") - F.col(f"_{c}2")) / dt) / dt for c in ("x", "y")]
    c, s = F.cos("heading"), F.sin("heading")
    values = {"along": acc[0] * c + acc[1] * s, "turning": wrap_angle(F.col("heading") - F.col("_heading1")) / dt, "across": acc[1] * c - acc[0] * s}
    out = [F.when(usable, clip(v, limit)).otherwise(0.0).alias(n) for (n, v), limit in zip(values.items(), limits, strict=True)]
    return df.where(F.col(frame).isin(endpoints)).select(*keys, frame, *out, usable.alias("usable"))


def endpoint_dynamics(x: Column, y: Column, heading: Column, dt: float = 0.1, limits: tuple[float, float, float] = DYNAMICS_LIMITS) -> Column:
    """Struct (along, turning, across) at the last of six frames, by gradients of second order; x, y and heading are arrays."""
    at = lambda a, i: F.get(a, F.lit(i))

    def end(f: list[Column]) -> Column:  # the gradient at the last of three values
        return (3 * f[2] - 4 * f[1] + f[0]) / (2 * dt)

    def acceleration(a: Column) -> Column:
        inner = [(at(a, i + 1) - at(a, i - 1)) / (2 * dt) for i in (3, 4)]
        return end([*inner, end([at(a, 3), at(a, 4), at(a, 5)])])

    steps = [wrap_angle(at(heading, i + 1) - at(heading, i)) for i in (3, 4)]
    turning = (3 * steps[1] - steps[0]) / (2 * dt)
    ax, ay, c, s = acceleration(x), acceleration(y), F.cos(at(heading, 5)), F.sin(at(heading, 5))
    values = (ax * c + ay * s, turning, ay * c - ax * s)
    return F.struct(*[clip(v, limit).alias(n) for v, limit, n in zip(values, limits, ("along", "turning", "across"), strict=True)])


def looked_up(rows: DataFrame, table: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """rows with the table's values; a row whose keys the table lacks is an error when it is read."""
    from .joins import small

    found = small(table.select(*keys, *values, F.lit(True).alias("_found")))
    missing = F.raise_error(F.concat(F.lit("no entry for "), F.concat_ws(", ", *[F.col(k).cast("string") for k in keys]))).cast("double")
    out = rows.join(found, keys, "left")
    return out.withColumns({v: F.when(F.col("_found"), F.col(v)).otherwise(missing) for v in values}).drop("_found")


def back_filled(df: DataFrame, keys: list[str], frame: str, shift: int = 5, current: int = 10, dt: float = 0.1) -> DataFrame:
    """df with states in front of the first valid frame, back to a multiple of `shift`, at constant velocity.

    df: x, y, vx, vy, heading, valid. A track that becomes valid at the current frame is filled for a whole shift.
    """
    track = Window.partitionBy(*keys)
    first = F.min(F.when(F.col("valid"), F.struct(F.col(frame).alias("f"), "x", "y", "vx", "vy", "heading"))).over(track)
    df = df.withColumn("_first", first)
    back = F.when(F.col("_first.f") == current, F.lit(shift)).otherwise(F.col("_first.f") % shift)
    gap = F.col("_first.f") - F.col(frame)
    fill = F.coalesce((gap > 0) & (gap <= back), F.lit(False))
    moved = {c: F.when(fill, F.col(f"_first.{c}") - gap * dt * F.col(f"_first.v{c}")).otherwise(F.col(c)) for c in ("x", "y")}
    kept = {c: F.when(fill, F.col(f"_first.{c}")).otherwise(F.col(c)) for c in ("vx", "vy", "heading")}
    return df.withColumns(moved | kept | {"valid": F.col("valid") | fill}).drop("_first")


def temporal_edges(df: DataFrame, keys: list[str], step: str, valid: str, span: int) -> DataFrame:
    """keys, src, dst: valid steps of a track that are 1 to `span` apart. An equality join on the later step."""
    own = df.where(F.col(valid)).select(*keys, F.col(step).alias("src"))
    ahead = own.withColumn("dst", F.explode(F.sequence(F.col("src") + 1, F.col("src") + span)))
    return ahead.join(own.withColumnRenamed("src", "dst"), [*keys, "dst"]).select(*keys, "src", "dst")


def sampled_tokens(logits: DataFrame, keys: list[str], token: str, logit: str, most: int, temperature: float = 1.0, seed: int = 0) -> DataFrame:
    """keys, token: one of the `most` likeliest tokens, drawn by its probability; with most = 1 the likeliest.

    The draw adds Gumbel noise from a hash of keys, token and seed, so a task that runs again draws the same.
    """
    way = Window.partitionBy(*keys).orderBy(F.desc(logit), token)
    top = logits.withColumn("_k", F.row_number().over(way)).where(F.col("_k") <= most)
    uniform = (F.pmod(F.xxhash64(*keys, token, F.lit(seed)), F.lit(1 << 30)) + 0.5) / float(1 << 30)
    score = F.col(logit) / temperature - F.log(-F.log(uniform)) if most > 1 else F.col(logit)
    return top.groupBy(*keys).agg(F.max_by(token, F.struct(score.alias("s"), (-F.col("_k")).alias("k"))).alias(token))


def size_records(df: DataFrame, frame: str, at: int, size_class: Column) -> DataFrame:
    """The valid states of one frame with their size class."""
    return df.where((F.col(frame) == at) & F.col("valid")).withColumn("size_class", size_class)

