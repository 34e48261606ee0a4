"""Registered queries of road edges, neighbouring polylines, detours and mixtures over the trajectories of the events table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import edges
from .queries import query, r6
from .tables import tracks

#: The map of a track: a two-point edge for each of its event types, across the box of their states.
EDGE_SQL = "m AS (SELECT track_id, type, min(x) AS x0, min(y) AS y0, max(x) - min(x) AS ux, max(y) - min(y) AS uy FROM t GROUP BY 1, 2)"


def road_map(spark: SparkSession, sf: str) -> DataFrame:
    """track_id, type, points."""
    box = tracks(spark, sf).groupBy("track_id", "type").agg(*[f(c).alias(f"{c}{k}") for k, f in ((0, F.min), (1, F.max)) for c in "xy"])
    return box.select("track_id", "type", F.array(*[F.struct(F.col(f"x{k}").alias("x"), F.col(f"y{k}").alias("y")) for k in (0, 1)]).alias("points"))


@query(f"""
WITH $TRACKS, {EDGE_SQL}, p AS (SELECT track_id, frame, x, y, cos(heading) AS c, sin(heading) AS s FROM t WHERE valid),
j AS (SELECT p.track_id, frame, x - x0 AS dx, y - y0 AS dy, ux, uy, c, s, c * uy - s * ux AS cr FROM p LEFT JOIN (SELECT * FROM m WHERE ux * ux + uy * uy > 1e-12) m ON p.track_id = m.track_id),
k AS (SELECT *, greatest(0.0, least(1.0, (dx * ux + dy * uy) / (ux * ux + uy * uy))) AS f, CASE WHEN abs(cr) > 1e-9 THEN (dy * ux - dx * uy) / cr END AS r, CASE WHEN abs(cr) > 1e-9 THEN (dy * c - dx * s) / cr END AS g FROM j)
SELECT track_id, frame, round(min(sqrt((dx - f * ux) * (dx - f * ux) + (dy - f * uy) * (dy - f * uy))), 6) AS nearest,
  round(min(CASE WHEN g >= -1e-6 AND g <= 1.000001 AND r > 0.25 AND r <= 30.0 THEN r END), 6) AS ahead, round(min(CASE WHEN g >= -1e-6 AND g <= 1.000001 AND -r > 0.25 AND -r <= 30.0 THEN -r END), 6) AS behind
FROM k GROUP BY 1, 2
""")
def road_edges(spark, sf):
    segments = edges.edge_segments(road_map(spark, sf), ["track_id"], "points")
    got = edges.road_edge_distances(tracks(spark, sf).where("valid"), segments, ["track_id"], ["frame"], 30.0)
    return got.select("track_id", "frame", *r6("nearest", "ahead", "behind"))


@query(f"""
WITH $TRACKS, {EDGE_SQL}, n AS (SELECT *, sqrt(ux * ux + uy * uy) AS l, x0 + ux AS x1, y0 + uy AS y1 FROM m),
d AS (SELECT a.track_id, a.type AS a, b.type AS b, sqrt((a.x0 - b.x0) ** 2 + (a.y0 - b.y0) ** 2) < 5 AS s, sqrt((a.x1 - b.x1) ** 2 + (a.y1 - b.y1) ** 2) < 5 AS e, b.l + 3 < a.l AS longer FROM n a JOIN n b ON a.track_id = b.track_id AND a.type <> b.type)
SELECT track_id, a, b, CASE WHEN s AND e THEN 'complete' WHEN s AND NOT e AND longer THEN 'side-start' WHEN NOT s AND e AND longer THEN 'side-end' ELSE 'other' END AS relation FROM d
""")
def neighbour_relations(spark, sf):
    m = road_map(spark, sf)
    pairs = m.withColumnsRenamed({"type": "a", "points": "pa"}).join(m.withColumnsRenamed({"type": "b", "points": "pb"}), "track_id").where("a <> b")
    return pairs.select("track_id", "a", "b", edges.neighbour_relation(F.col("pa"), F.col("pb")).alias("relation"))


@query("""
WITH $TRACKS, v AS (SELECT track_id, frame, x, y, row_number() OVER w AS k, coalesce(sqrt((x - lag(x) OVER w) ** 2 + (y - lag(y) OVER w) ** 2), 0.0) AS step FROM t WHERE valid WINDOW w AS (PARTITION BY track_id ORDER BY frame)),
c AS (SELECT *, sum(step) OVER (PARTITION BY track_id ORDER BY k) AS way FROM v),
p AS (SELECT a.track_id, a.k AS ak, b.k AS bk, a.frame AS fa, b.frame AS fb, a.x AS xa, a.y AS ya, b.x AS xb, b.y AS yb, b.way - a.way AS path, sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) AS direct FROM c a JOIN c b ON a.track_id = b.track_id AND b.k BETWEEN a.k + 2 AND a.k + 9),
q AS (SELECT * FROM p WHERE path - direct > 1.0 AND path > 2.5 * greatest(direct, 1e-6)),
i AS (SELECT q.track_id, ak, bk, frame, sqrt((c.x - xa - (frame - fa) / (fb - fa) * (xb - xa)) ** 2 + (c.y - ya - (frame - fa) / (fb - fa) * (yb - ya)) ** 2) AS gap FROM q JOIN c ON q.track_id = c.track_id AND c.k > ak AND c.k < bk),
w AS (SELECT *, max(gap) OVER (PARTITION BY track_id, ak, bk) AS worst FROM i)
SELECT DISTINCT track_id, frame FROM w WHERE worst > 0.75
""")
def closed_detours(spark, sf):
    t = tracks(spark, sf).withColumn("t", F.col("frame").cast("double"))
    return edges.closed_detours(t, ["track_id"], "frame", "t", "x", "y", "valid")


def pose_modes(spark: SparkSession, sf: str) -> DataFrame:
    """track_id, frame, three modes around each valid state, which is the true pose."""
    m = tracks(spark, sf).where("valid").withColumn("mode", F.explode(F.sequence(F.lit(0), F.lit(2))))
    k = F.col("mode")
    return m.select("track_id", "frame", "mode", ((F.col("event_id") + 2 * k) % 7).alias("logit"), (F.col("x") + 0.3 * k).alias("x"), (F.col("y") - 0.2 * k).alias("y"), (F.col("heading") + 0.1 * k).alias("heading"), F.col("x").alias("tx"), F.col("y").alias("ty"), F.col("heading").alias("th"))


DENSITY_SQL = """n AS (SELECT track_id, frame, mode, (event_id + 2 * mode) % 7 AS logit, 0 - (0.3 * mode) ** 2 / 0.5 - (0.2 * mode) ** 2 / 0.5 - (cos(heading + 0.1 * mode) - cos(heading)) ** 2 / 0.08 - (sin(heading + 0.1 * mode) - sin(heading)) ** 2 / 0.08
  - 2 * ln(0.5) - 2 * ln(0.2) - 2 * ln(2 * pi()) AS dense FROM (SELECT *, unnest(range(0, 3)) AS mode FROM t WHERE valid))"""


@query(f"""
WITH $TRACKS, {DENSITY_SQL}, k AS (SELECT track_id, frame, ln(sum(exp(logit))) - ln(sum(exp(logit + dense))) AS loss FROM n GROUP BY 1, 2)
SELECT track_id, count(*) AS n, round(avg(loss), 5) AS loss FROM k GROUP BY 1
""")
def mixture_loss(spark, sf):
    got = edges.mixture_loss(pose_modes(spark, sf), ["track_id", "frame"], 0.5, 0.2)
    return got.groupBy("track_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("loss"), 5).alias("loss"))


@query(f"""
WITH $TRACKS, {DENSITY_SQL}
SELECT track_id, count(*) AS n, round(avg(-dense), 5) AS loss FROM n WHERE mode = 0 GROUP BY 1
""")
def nearest_mode_loss(spark, sf):
    got = edges.mixture_loss(pose_modes(spark, sf), ["track_id", "frame"], 0.5, 0.2, hard=True)
    return got.groupBy("track_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("loss"), 5).alias("loss"))
