"""Map tokens: polylines resampled by arc length, cut at gaps, and taken in pieces of three points."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Distance of samples and the gap that cuts a line (metres), samples of a piece, samples between its points,
# and the place of the token of a scene without any.
STEP, GAP, PIECE, HALF = 0.5, 3.0, 10, 5
NOWHERE = 6e4


def line_runs(points: DataFrame, keys: list[str], line: str, place: str, gap: float = GAP) -> DataFrame:
    """points (keys, line, place, x, y) with run (number, from 0, of the stretch without a gap), s (way along it), and the next point of it (nx, ny, ns)."""
    way = Window.partitionBy(*keys, line).orderBy(place)
    step = F.hypot(F.col("x") - F.lag("x").over(way), F.col("y") - F.lag("y").over(way))
    p = points.withColumn("_d", F.coalesce(step, F.lit(0.0))).withColumn("run", F.sum(F.when(F.col("_d") > gap, 1).otherwise(0)).over(way))
    inside = Window.partitionBy(*keys, line, "run").orderBy(place)
    p = p.withColumn("s", F.sum(F.when(F.row_number().over(inside) > 1, F.col("_d")).otherwise(0.0)).over(inside))
    return p.drop("_d").withColumns({f"n{c}": F.lead(c).over(inside) for c in ("x", "y", "s")})


def samples(runs: DataFrame, keys: list[str], line: str, step: float = STEP) -> DataFrame:
    """keys, line, run, j, x, y, n: a sample each `step` along a run (of line_runs()), and its end; n samples in all.

    A segment gives the samples from its start up to before its end, so no point is looked up; runs of one point give none.
    """
    run = [*keys, line, "run"]
    total = F.max("s").over(Window.partitionBy(*run))
    s = runs.withColumn("_total", total).withColumn("n", (F.ceil(F.col("_total") / step) + 1).cast("long"))
    first = F.ceil(F.col("s") / step)
    last = F.least(F.ceil(F.col("ns") / step), F.col("n") - 1) - 1
    inner = s.where(F.col("ns").isNotNull() & (last >= first)).withColumn("j", F.explode(F.sequence(first, last)))
    f = (F.col("j") * step - F.col("s")) / (F.col("ns") - F.col("s"))
    inner = inner.select(*run, "j", (F.col("x") + f * (F.col("nx") - F.col("x"))).alias("x"), (F.col("y") + f * (F.col("ny") - F.col("y"))).alias("y"), "n")
    ends = s.where(F.col("ns").isNull() & (F.col("n") > 1)).select(*run, (F.col("n") - 1).alias("j"), "x", "y", "n")
    return inner.unionByName(ends)


def pieces(sampled: DataFrame, keys: list[str], line: str, piece: int = PIECE, half: int = HALF) -> DataFrame:
    """keys, line, run, piece, points (three of x, y), heading (from the first point's sample to the next).

    Pieces of `piece` steps follow each other, each with its first, middle and last sample; what remains behind the last is a
    piece if it has three further samples or more (or all of them), with its first, middle (rounded down) and last sample.
    """
    n, j = F.col("n"), F.col("j")
    whole = F.when(n >= piece + 1, F.floor((n - piece - 1) / piece) + 1).otherwise(F.lit(0))
    left = F.when(n >= piece + 1, (n - piece - 1) % piece).otherwise(n)
    rest = n - whole * piece  # samples of the remainder, with the one that it shares
    own = F.floor(j / piece)
    at = lambda number, start, off: F.struct(number.cast("long").alias("piece"), F.lit(start).alias("which"), off.alias("hit"))
    here, back = j - own * piece, own - 1
    in_rest = (left >= 3) & (j >= whole * piece)
    middle = whole * piece + F.floor((rest - 1) / 2)
    hits = F.array(
        at(own, 0, (own < whole) & (here == 0)), at(own, 1, (own < whole) & (here == half)), at(back, 2, (here == 0) & (back >= 0) & (back < whole)), at(own, 3, (own < whole) & (here == 1)),
        at(whole, 0, in_rest & (j == whole * piece)), at(whole, 1, in_rest & (j == middle)), at(whole, 2, in_rest & (j == n - 1)), at(whole, 3, in_rest & (j == whole * piece + 1)),
    )
    met = sampled.withColumn("h", F.explode(F.filter(hits, lambda h: h["hit"])))
    pick = lambda k: F.max(F.when(F.col("h.which") == k, F.struct("x", "y")))
    got = met.groupBy(*keys, line, "run", F.col("h.piece").alias("piece")).agg(*[pick(k).alias(f"p{k}") for k in range(4)])
    return got.select(*keys, line, "run", "piece", F.array("p0", "p1", "p2").alias("points"), F.atan2(F.col("p3.y") - F.col("p0.y"), F.col("p3.x") - F.col("p0.x")).alias("heading"))


def map_tokens(points: DataFrame, scenes: DataFrame, keys: list[str], line: str, place: str, attributes: list[str]) -> DataFrame:
    """keys, line, token (number along the line), points, heading, attributes: the pieces of lines of more than two points.

    points: keys, line, place, x, y and the line's attributes. A scene (keys) without a piece has one token far away, with null
    line and attributes of 0.
    """
    many = points.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(*keys, line))).where("_n > 2").drop("_n")
    got = pieces(samples(line_runs(many.select(*keys, line, place, "x", "y"), keys, line, place), keys, line), keys, line)
    token = F.row_number().over(Window.partitionBy(*keys, line).orderBy("run", "piece")) - 1
    named = many.groupBy(*keys, line).agg(*[F.min_by(a, place).alias(a) for a in attributes])
    tokens = got.withColumn("token", token).join(named, [*keys, line]).select(*keys, line, "token", "points", "heading", *attributes)
    empty = scenes.select(*keys).distinct().join(tokens.select(*keys).distinct(), keys, "left_anti")
    far = F.struct(F.lit(NOWHERE).alias("x"), F.lit(NOWHERE).alias("y"))
    kinds = {f.name: f.dataType for f in tokens.schema}
    return tokens.unionByName(empty.select(*keys, F.lit(None).cast(kinds[line]).alias(line), F.lit(0).alias("token"), F.array(far, far, far).alias("points"), F.lit(0.0).alias("heading"), *[F.lit(0).cast(kinds[a]).alias(a) for a in attributes]))
