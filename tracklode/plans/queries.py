"""Registered queries of the engine's own operators."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import angles, text
from ..operators import aggregates, intervals, joins, labels, likelihood, windows
from .tables import HISTORIES_SQL, TRACKS_SQL, histories, table, tracks

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name, with the SQL that gives the same rows."""

    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql.replace("$TRACKS", TRACKS_SQL).replace("$HISTORIES", HISTORIES_SQL)
        return f

    return register


def r6(*names: str):
    return [F.round(n, 6).alias(n) for n in names]


EVENT_TYPES = ["view", "click", "cart", "purchase", "signup", "login", "search", "error", "refund", "logout"]
PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


@query("""
WITH s AS (SELECT l_returnflag AS scope, unnest(['l_quantity', 'l_extendedprice', 'l_discount']) AS metric, unnest([l_quantity, l_extendedprice, l_discount]) AS value FROM lineitem),
a AS (SELECT scope, metric, value FROM s UNION ALL SELECT 'all', metric, value FROM s)
SELECT scope, metric, count(value) AS n, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std, round(min(value), 6) AS min, round(max(value), 6) AS max,
  round(max(value) - min(value), 6) AS range, round(quantile_cont(value, 0.01), 6) AS p_low, round(quantile_cont(value, 0.99), 6) AS p_high, round(quantile_cont(value, 0.99) - quantile_cont(value, 0.01), 6) AS spread
FROM a GROUP BY scope, metric
""")
def scoped_moments(spark, sf):
    got = aggregates.scoped_moments(aggregates.unpivot_metrics(table(spark, sf, "lineitem"), "l_returnflag", ["l_quantity", "l_extendedprice", "l_discount"]))
    return got.select("scope", "metric", "n", *r6("mean", "std", "min", "max", "range", "p_low", "p_high", "spread"))


@query("""
WITH o AS (SELECT unnest(['1-URGENT', '2-HIGH', '3-MEDIUM', '4-NOT SPECIFIED', '5-LOW', 'ALL']) AS o_orderpriority), i AS (SELECT unnest(['F', 'O', 'P', 'X']) AS o_orderstatus),
c AS (SELECT o_orderpriority, o_orderstatus, count(*) AS n FROM orders GROUP BY 1, 2 UNION ALL SELECT 'ALL', o_orderstatus, count(*) FROM orders GROUP BY 2),
s AS (SELECT o_orderpriority, count(*) AS total FROM orders GROUP BY 1 UNION ALL SELECT 'ALL', count(*) FROM orders)
SELECT o_orderpriority, o_orderstatus, coalesce(n, 0) AS n, CASE WHEN total > 0 THEN round(100.0 * coalesce(n, 0) / total, 6) ELSE 0.0 END AS percent
FROM o CROSS JOIN i LEFT JOIN c USING (o_orderpriority, o_orderstatus) LEFT JOIN s USING (o_orderpriority)
""")
def completed_counts(spark, sf):
    got = aggregates.completed_counts(table(spark, sf, "orders"), "o_orderpriority", "o_orderstatus", PRIORITIES, ["F", "O", "P", "X"])
    return got.select("o_orderpriority", "o_orderstatus", "n", *r6("percent"))


@query("""
SELECT p_brand, count(*) AS n, round(avg(CASE WHEN p_size > 0 THEN CAST(p_size AS DOUBLE) END), 6) AS mean_p_size, CAST(min(CASE WHEN p_size > 0 THEN p_size END) AS DOUBLE) AS min_p_size, CAST(max(CASE WHEN p_size > 0 THEN p_size END) AS DOUBLE) AS max_p_size,
  round(avg(CASE WHEN p_retailprice > 0 THEN p_retailprice END), 6) AS mean_p_retailprice, min(CASE WHEN p_retailprice > 0 THEN p_retailprice END) AS min_p_retailprice, max(CASE WHEN p_retailprice > 0 THEN p_retailprice END) AS max_p_retailprice
FROM part GROUP BY p_brand
""")
def dimension_stats(spark, sf):
    got = aggregates.dimension_stats(table(spark, sf, "part"), ["p_brand"], ["p_size", "p_retailprice"])
    return got.select("p_brand", "n", *r6("mean_p_size"), "min_p_size", "max_p_size", *r6("mean_p_retailprice"), "min_p_retailprice", "max_p_retailprice")


@query("""
WITH d AS (SELECT p_partkey, p_partkey % 4 AS kind, p_size / 5.0 AS len, p_size / 20.0 AS wid, p_retailprice / 1000.0 AS hei, p_size / 6.0 AS speed FROM part)
SELECT p_partkey, CASE WHEN len <= 0 OR wid <= 0 OR hei <= 0 THEN 'INVALID_DIMENSIONS'
  WHEN kind = 1 THEN CASE WHEN len <= 3.0 AND wid <= 1.2 THEN 'MOTORCYCLE_PROXY' WHEN len > 5.7912 THEN 'LARGE_VEHICLE_PROXY' ELSE 'SMALL_VEHICLE_PROXY' END
  WHEN kind = 2 THEN CASE WHEN hei < 1.4478 THEN 'CHILD_PEDESTRIAN_PROXY' ELSE 'ADULT_PEDESTRIAN_PROXY' END
  WHEN kind = 3 THEN CASE WHEN speed >= 24.0 / 3.6 THEN 'E_BIKE_PROXY' ELSE 'BICYCLE_PROXY' END ELSE 'UNSUPPORTED_OBJECT_TYPE' END AS size_class
FROM d
""")
def size_classes(spark, sf):
    p = table(spark, sf, "part")
    size = F.col("p_size").cast("double")
    return p.select("p_partkey", labels.size_class(F.col("p_partkey") % 4, size / 5.0, size / 20.0, F.col("p_retailprice") / 1000.0, size / 6.0).alias("size_class"))


@query("""
WITH $TRACKS, n AS (SELECT track_id, type, frame, frame - row_number() OVER (PARTITION BY track_id, type ORDER BY frame) AS k FROM t)
SELECT track_id, type, min(frame) AS start, max(frame) + 1 AS "end" FROM n GROUP BY track_id, type, k
""")
def contiguous_runs(spark, sf):
    return windows.islands(tracks(spark, sf), ["track_id", "type"], "frame")


@query("""
WITH $TRACKS, n AS (SELECT track_id, type, frame, frame - row_number() OVER (PARTITION BY track_id, type ORDER BY frame) AS k FROM t),
i AS (SELECT track_id, type, min(frame) AS s, max(frame) + 1 AS e FROM n GROUP BY track_id, type, k),
f AS (SELECT *, CASE WHEN s <= max(e) OVER (PARTITION BY track_id, type ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 5 THEN 0 ELSE 1 END AS fresh FROM i),
g AS (SELECT *, sum(fresh) OVER (PARTITION BY track_id, type ORDER BY s, e) AS run FROM f)
SELECT track_id, type, min(s) AS start, max(e) AS "end" FROM g GROUP BY track_id, type, run HAVING max(e) - min(s) >= 10
""")
def merged_intervals(spark, sf):
    runs = windows.islands(tracks(spark, sf), ["track_id", "type"], "frame")
    return intervals.merge_intervals(runs, ["track_id", "type"], 5).where(F.col("end") - F.col("start") >= 10)


TAGGED_SQL = """
g AS (SELECT track_id, frame, unnest(list_filter([
    CASE WHEN action IN ('LEFT_TURN') THEN 'LeftTurn' WHEN action = 'RIGHT_TURN' THEN 'RightTurn' WHEN action <> 'U_TURN' AND speed > 0.2 THEN 'Straight' END,
    CASE WHEN speed <= 0.2 THEN 'Parked' WHEN acc > 0.5 THEN 'Accelerate' WHEN acc < -0.5 THEN 'Decelerate' ELSE 'KeepSpeed' END], lambda x: x IS NOT NULL)) AS tag
  FROM (SELECT track_id, frame, CASE kind WHEN 1 THEN 'LEFT_TURN' WHEN 2 THEN 'RIGHT_TURN' ELSE 'KEEP_SPEED' END AS action, abs(vx) AS speed, vy AS acc FROM t WHERE frame BETWEEN 1 AND 80)),
n AS (SELECT track_id, tag, frame, frame - row_number() OVER (PARTITION BY track_id, tag ORDER BY frame) AS k FROM g),
i AS (SELECT track_id, tag, min(frame) AS s, max(frame) + 1 AS e FROM n GROUP BY track_id, tag, k)"""


def tagged(spark, sf):
    """Tags of the frames of a scenario's future: the 80 frames after the current one, which is frame 0 here."""
    action = F.when(F.col("kind") == 1, "LEFT_TURN").when(F.col("kind") == 2, "RIGHT_TURN").otherwise("KEEP_SPEED")
    return intervals.horizon(tracks(spark, sf), "frame", F.lit(0), 80).select("track_id", "frame", F.explode(labels.frame_tags(action, F.col("vx"), F.col("vy"))).alias("tag"))


@query(f"""
WITH $TRACKS, {TAGGED_SQL}
SELECT a.track_id, CASE WHEN a.tag = 'Decelerate' AND EXISTS (SELECT 1 FROM i p WHERE p.track_id = a.track_id AND p.tag = 'Parked' AND p.s - a.e BETWEEN 0 AND 5) THEN 'Stopping' ELSE a.tag END AS tag, a.s AS start, a.e AS "end"
FROM i a
""")
def tag_intervals(spark, sf):
    runs = windows.islands(tagged(spark, sf), ["track_id", "tag"], "frame")
    return intervals.rename_before(runs, ["track_id"], "tag", "Decelerate", "Parked", "Stopping", 5)


@query()
def conflict_resolution(spark, sf):
    """A fold over each track's intervals, which SQL has no form for; tests compare it with a loop."""
    runs = windows.islands(tagged(spark, sf), ["track_id", "tag"], "frame").withColumnRenamed("tag", "action")
    got = intervals.resolve_conflicts(runs, "track_id", labels.TAG_PRIORITY, labels.TAG_EXCLUDES)
    return intervals.drop_when_multiple(got, ["track_id"], "action", "Parked")


@query("""
WITH $HISTORIES, g AS (SELECT *, lag(x) OVER w AS f0, lead(x) OVER w AS f2, t - lag(t) OVER w AS hs, lead(t) OVER w - t AS hd FROM t WINDOW w AS (PARTITION BY track_id ORDER BY t))
SELECT track_id, frame, round(CASE WHEN hs IS NULL AND hd IS NULL THEN 0 WHEN hs IS NULL THEN (f2 - x) / hd WHEN hd IS NULL THEN (x - f0) / hs ELSE (hs * hs * f2 + (hd * hd - hs * hs) * x - hd * hd * f0) / (hs * hd * (hs + hd)) END, 6) AS gradient FROM g
""")
def time_gradient(spark, sf):
    return windows.gradient(histories(spark, sf), ["track_id"], "t", "x").select("track_id", "frame", *r6("gradient"))


@query("""
WITH $TRACKS, g AS (SELECT *, lag(x, 2) OVER w AS a, lag(x) OVER w AS b, lead(x) OVER w AS c, lead(x, 2) OVER w AS d, row_number() OVER w AS k, count(*) OVER (PARTITION BY track_id) AS n FROM t WINDOW w AS (PARTITION BY track_id ORDER BY frame))
SELECT track_id, frame, round(greatest(-15.0, least(15.0, CASE WHEN n < 3 THEN NULL WHEN k = 1 THEN (-3 * x + 4 * c - d) / 0.2 WHEN k = n THEN (3 * x - 4 * b + a) / 0.2 ELSE (c - b) / 0.2 END)), 6) AS gradient FROM g
""")
def uniform_gradient(spark, sf):
    got = windows.uniform_gradient(tracks(spark, sf), ["track_id"], "frame", "x", 0.1)
    return got.select("track_id", "frame", F.round(F.greatest(F.lit(-15.0), F.least(F.lit(15.0), "gradient")), 6).alias("gradient"))


@query("""
WITH $TRACKS, g AS (SELECT *, CASE WHEN row_number() OVER w <= 10 THEN first_value(heading) OVER f ELSE lag(heading, 10) OVER w END AS past,
    CASE WHEN row_number() OVER w > count(*) OVER (PARTITION BY track_id) - 10 THEN last_value(heading) OVER f ELSE lead(heading, 10) OVER w END AS future,
    CASE WHEN row_number() OVER w > count(*) OVER (PARTITION BY track_id) - 30 THEN last_value(heading) OVER f ELSE lead(heading, 30) OVER w END AS far
  FROM t WHERE valid WINDOW w AS (PARTITION BY track_id ORDER BY frame), f AS (PARTITION BY track_id ORDER BY frame ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
h AS (SELECT *, (future - heading) - 2 * pi() * floor((future - heading + pi()) / (2 * pi())) AS ahead, (heading - past) - 2 * pi() * floor((heading - past + pi()) / (2 * pi())) AS behind,
    abs((far - past) - 2 * pi() * floor((far - past + pi()) / (2 * pi()))) AS total, CASE WHEN kind = 2 THEN 0.5 ELSE 1.0 END AS half FROM g)
SELECT track_id, frame, CASE WHEN abs(vx) < 0.2 * half THEN 'STOP' WHEN kind = 1 AND total > radians(160.0) THEN 'U_TURN'
  WHEN kind IN (1, 3) AND (ahead > 0.25 OR behind > 0.25) THEN 'LEFT_TURN' WHEN kind IN (1, 3) AND (ahead < -0.25 OR behind < -0.25) THEN 'RIGHT_TURN'
  WHEN vy > 0.5 * half THEN 'ACCELERATE' WHEN vy < -0.5 * half THEN 'DECELERATE' ELSE 'KEEP_SPEED' END AS action FROM h
""")
def frame_actions(spark, sf):
    t = tracks(spark, sf).where("valid")
    t = windows.clamped(t, ["track_id"], "frame", "heading", 10, 30).withColumnRenamed("future", "far").drop("past")
    t = windows.clamped(t, ["track_id"], "frame", "heading", 10, 10)
    return t.select("track_id", "frame", labels.action_class(F.col("kind"), F.col("vx"), F.col("heading"), F.col("past"), F.col("future"), F.col("far"), F.col("vy")).alias("action"))


def difference_sql(level: int) -> str:
    prev, name = ("t", "x") if level == 1 else (f"d{level - 1}", f"v{level - 1}")
    ok = "valid" if level == 1 else f"ok{level - 1}"
    span = "(lead(frame) OVER w - lag(frame) OVER w)"
    return f"d{level} AS (SELECT *, coalesce(lag({ok}) OVER w AND lead({ok}) OVER w, false) AS ok{level}, CASE WHEN lag({ok}) OVER w AND lead({ok}) OVER w THEN (lead({name}) OVER w - lag({name}) OVER w) / {span} END AS v{level} FROM {prev} WINDOW w AS (PARTITION BY track_id ORDER BY frame))"


@query(f"""
WITH $TRACKS, {difference_sql(1)}, {difference_sql(2)}, {difference_sql(3)}
SELECT track_id, frame, ok1 AS speed_valid, ok2 AS acceleration_valid, ok3 AS jerk_valid, round(v1, 6) AS speed, round(v2, 6) AS acceleration, round(v3, 6) AS jerk FROM d3
""")
def kinematic_chain(spark, sf):
    t = tracks(spark, sf)
    t = windows.central_difference(t, ["track_id"], "frame", "frame", "x", "valid", "speed")
    t = windows.central_difference(t, ["track_id"], "frame", "frame", "speed", "speed_valid", "acceleration")
    t = windows.central_difference(t, ["track_id"], "frame", "frame", "acceleration", "acceleration_valid", "jerk")
    return t.select("track_id", "frame", "speed_valid", "acceleration_valid", "jerk_valid", *r6("speed", "acceleration", "jerk"))


@query("""
WITH $TRACKS, m AS (SELECT track_id, frame, valid AND heading IS NOT NULL AS ok, vx * cos(heading) + vy * sin(heading) AS lon, sqrt(vx * vx + vy * vy) AS speed FROM t),
f AS (SELECT *, ok AND speed >= 0.2 AND lon >= 0.3 AS fwd, ok AND speed >= 0.2 AND lon <= -0.3 AS rev FROM m),
r AS (SELECT *, frame - row_number() OVER (PARTITION BY track_id, fwd ORDER BY frame) AS fk, frame - row_number() OVER (PARTITION BY track_id, rev ORDER BY frame) AS rk FROM f),
c AS (SELECT *, count(*) OVER (PARTITION BY track_id, fwd, fk) AS fn, count(*) OVER (PARTITION BY track_id, rev, rk) AS rn FROM r)
SELECT track_id, frame, CASE WHEN NOT ok THEN 'UNKNOWN' WHEN speed < 0.2 THEN 'STATIONARY' WHEN rev AND rn >= 3 THEN 'REVERSE' WHEN fwd AND fn >= 3 THEN 'FORWARD' ELSE 'LATERAL' END AS mode FROM c
""")
def motion_modes(spark, sf):
    return windows.motion_modes(tracks(spark, sf), ["track_id"], "frame").select("track_id", "frame", "mode")


@query("""
WITH $TRACKS, c AS (SELECT *, CASE WHEN row_number() OVER w = 1 OR valid = lag(valid) OVER w THEN 0 ELSE 1 END AS ch FROM t WINDOW w AS (PARTITION BY track_id ORDER BY frame)),
r AS (SELECT *, sum(ch) OVER (PARTITION BY track_id ORDER BY frame) AS run FROM c),
s AS (SELECT *, count(*) OVER (PARTITION BY track_id, run) AS n, max(run) OVER (PARTITION BY track_id) AS top FROM r),
b AS (SELECT *, last_value(CASE WHEN valid THEN frame END IGNORE NULLS) OVER (PARTITION BY track_id ORDER BY frame ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS bt, last_value(CASE WHEN valid THEN x END IGNORE NULLS) OVER (PARTITION BY track_id ORDER BY frame ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS bv,
    first_value(CASE WHEN valid THEN frame END IGNORE NULLS) OVER (PARTITION BY track_id ORDER BY frame ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS ft, first_value(CASE WHEN valid THEN x END IGNORE NULLS) OVER (PARTITION BY track_id ORDER BY frame ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS av FROM s)
SELECT track_id, frame, valid OR (run > 0 AND run < top AND n <= 2) AS filled, round(CASE WHEN bt IS NULL THEN av WHEN ft IS NULL THEN bv WHEN ft = bt THEN bv ELSE bv + (av - bv) * (frame - bt) / (ft - bt) END, 6) AS interpolated FROM b
""")
def gap_fill(spark, sf):
    t = windows.fill_short_gaps(tracks(spark, sf), ["track_id"], "frame", "valid", 2)
    return windows.interpolate(t, ["track_id"], "frame", "x", "valid").select("track_id", "frame", "filled", *r6("interpolated"))


@query("""
WITH $TRACKS, h AS (SELECT track_id, k * 5 AS start, list(round(x, 3) ORDER BY frame) AS v FROM (SELECT track_id, frame, x, unnest(generate_series(greatest(0, CAST(ceil((frame - 5) / 5.0) AS BIGINT)), CAST(floor(frame / 5.0) AS BIGINT))) AS k FROM t) GROUP BY track_id, k HAVING count(*) = 6)
SELECT array_to_string(list_transform(v, lambda z: printf('%.3f', z)), ',') AS segment, min(track_id) AS track_id, count(*) AS n FROM h GROUP BY 1
""")
def hopping_segments(spark, sf):
    got = windows.hopping_segments(tracks(spark, sf), ["track_id"], "frame", "x", 6, 5)
    key = F.array_join(F.transform("values", lambda z: F.format_string("%.3f", F.round(z, 3))), ",")
    return got.groupBy(key.alias("segment")).agg(F.min("track_id").alias("track_id"), F.count(F.lit(1)).alias("n"))


NEAREST_SQL = """d AS (SELECT s.vec_id, s.label, v.vec_id AS token, list_sum(list_transform(list_zip(s.embedding, v.embedding), lambda p: (CAST(p[1] AS DOUBLE) - CAST(p[2] AS DOUBLE)) ** 2)) AS d2 FROM embeddings s, embeddings v WHERE s.vec_id >= 64 AND v.vec_id < 64),
b AS (SELECT vec_id, label, token, d2 FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY d2, token) AS k FROM d) WHERE k = 1)"""


def nearest(spark, sf):
    e = table(spark, sf, "embeddings")
    return joins.nearest_token(e.where("vec_id >= 64"), e.where("vec_id < 64").select(F.col("vec_id").alias("token_id"), F.col("embedding").alias("tv")), "vec_id", "embedding", "token_id", "tv")


@query(f"WITH {NEAREST_SQL} SELECT vec_id, token, round(d2, 6) AS d2 FROM b")
def nearest_token(spark, sf):
    return nearest(spark, sf).select("vec_id", "token", *r6("d2"))


@query(f"WITH {NEAREST_SQL} SELECT label, count(*) AS n, round(avg(sqrt(d2)), 6) AS mean, round(quantile_cont(sqrt(d2), 0.95), 6) AS p95, round(quantile_cont(sqrt(d2), 0.5), 6) AS median FROM b GROUP BY label")
def quantization_error(spark, sf):
    got = nearest(spark, sf).join(table(spark, sf, "embeddings").select("vec_id", "label"), "vec_id")
    e = F.sqrt("d2")
    got = got.select("label", e.alias("e"))
    p = aggregates.exact_percentiles(got, ["label"], "e", {"p95": 0.95, "median": 0.5}).select(F.col("label").alias("_label"), "p95", "median")
    counted = got.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("e"), 6).alias("mean"))
    return counted.join(p, F.col("label").eqNullSafe(F.col("_label"))).select("label", "n", "mean", *r6("p95", "median"))


@query("""
WITH $TRACKS, p AS (SELECT a.track_id // 8 AS scene, a.frame, a.track_id AS id, b.track_id AS other, (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) AS d2 FROM t a JOIN t b ON a.frame = b.frame AND a.track_id // 8 = b.track_id // 8 AND a.track_id <> b.track_id AND (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= 400.0 WHERE a.valid AND b.valid),
n AS (SELECT *, row_number() OVER (PARTITION BY scene, frame, id ORDER BY d2, other) AS k FROM p)
SELECT scene, frame, id, other, round(d2, 6) AS d2 FROM n WHERE k <= 3
""")
def radius_neighbours(spark, sf):
    p = tracks(spark, sf).where("valid").select(F.floor(F.col("track_id") / 8).alias("scene"), "frame", F.col("track_id").alias("id"), "x", "y")
    return joins.radius_pairs(p, p, ["scene", "frame"], 20.0, 3).select("scene", "frame", "id", "other", *r6("d2"))


@query()
def disk_cover(spark, sf):
    """A seeded sequential choice in samples of a bounded number of vectors; tests check the cover."""
    e = table(spark, sf, "embeddings").withColumn("sample", F.concat_ws("-", "label", F.floor(F.col("vec_id") / 500)))
    return labels.disk_cover(e, "sample", "vec_id", "embedding", 16, 1.0)


@query("""
WITH $TRACKS, p AS (SELECT track_id, 1 AS kind, lag(type) OVER (PARTITION BY track_id ORDER BY frame) AS prev, type AS cur, vx AS a, vy AS b FROM t),
q AS (SELECT * FROM p WHERE prev IS NOT NULL), k AS (SELECT 1 AS kind, type AS token, min(vx) AS a, min(vy) AS b FROM t GROUP BY type),
s AS (SELECT kind, prev, cur, count(*) AS n, sum(a) AS a, sum(b) AS b FROM q GROUP BY 1, 2, 3), m AS (SELECT kind, cur, count(*) AS n, sum(a) AS a, sum(b) AS b FROM q GROUP BY 1, 2)
SELECT x.token AS prev, y.token AS cur, coalesce(s.n, 0) AS n, round((coalesce(s.a, 0.0) + 2.0 * coalesce(m.a / m.n, y.a)) / (coalesce(s.n, 0) + 2.0), 6) AS a, round((coalesce(s.b, 0.0) + 2.0 * coalesce(m.b / m.n, y.b)) / (coalesce(s.n, 0) + 2.0), 6) AS b
FROM k x JOIN k y ON x.kind = y.kind LEFT JOIN s ON s.prev = x.token AND s.cur = y.token LEFT JOIN m ON m.cur = y.token
""")
def transition_table(spark, sf):
    t = tracks(spark, sf).select("track_id", "frame", "type", F.lit(1).alias("kind"), F.col("vx").alias("a"), F.col("vy").alias("b"))
    pairs = windows.token_pairs(t, ["track_id"], "frame", "type").join(t.select("track_id", "frame", "kind", "a", "b"), ["track_id", "frame"])
    tokens = t.groupBy("kind", F.col("type").alias("token")).agg(F.min("a").alias("a"), F.min("b").alias("b"))
    return labels.shrunken_transitions(pairs, tokens, "kind", ["a", "b"], 2.0).select("prev", "cur", "n", *r6("a", "b"))


@query("""
WITH s AS (SELECT l_returnflag AS scope, l_quantity AS value FROM lineitem WHERE l_linenumber > 1), l AS (SELECT l_returnflag AS scope, l_orderkey, l_quantity AS value FROM lineitem WHERE l_linenumber = 1),
c AS (SELECT scope, CAST(least(floor((greatest(0.0, least(50.0, value)) - 0.0) / 5.0), 9) AS INTEGER) AS bin, count(*) AS n FROM s GROUP BY 1, 2), a AS (SELECT scope, count(*) AS total FROM s GROUP BY 1)
SELECT l.scope, l_orderkey, round(ln((coalesce(n, 0) + 0.1) / (total + 0.1 * 10)), 6) AS log_likelihood FROM l JOIN a ON l.scope = a.scope LEFT JOIN c ON c.scope = l.scope AND c.bin = CAST(least(floor((greatest(0.0, least(50.0, value)) - 0.0) / 5.0), 9) AS INTEGER)
""")
def histogram_likelihood(spark, sf):
    li = table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("scope"), "l_orderkey", "l_linenumber", F.col("l_quantity").alias("value"))
    got = likelihood.histogram_log_likelihood(li.where("l_linenumber = 1").select("scope", "l_orderkey", "value"), li.where("l_linenumber > 1").select("scope", "value"), ["scope"], 0.0, 50.0, 10, 0.1)
    return got.select("scope", "l_orderkey", *r6("log_likelihood"))


@query("""
WITH s AS (SELECT l_suppkey, l_discount > 0.05 AS v FROM lineitem), a AS (SELECT l_suppkey, count(*) AS total, count(*) FILTER (WHERE v) AS hits FROM s GROUP BY 1)
SELECT l_suppkey, v AS value, round(ln((CASE WHEN v THEN hits ELSE total - hits END + 0.5) / (total + 1.0)), 6) AS log_likelihood FROM (SELECT DISTINCT l_suppkey, v FROM s) JOIN a USING (l_suppkey)
""")
def bernoulli_likelihood(spark, sf):
    s = table(spark, sf, "lineitem").select("l_suppkey", (F.col("l_discount") > 0.05).alias("value"))
    got = likelihood.bernoulli_log_likelihood(s.distinct(), s, ["l_suppkey"], 0.5)
    return got.select("l_suppkey", (F.col("value") == 1.0).alias("value"), *r6("log_likelihood"))


@query("""
WITH $HISTORIES SELECT a.track_id, a.frame, round(ln(greatest(avg(exp(-0.5 * ((a.x - b.x) / 2.0) * ((a.x - b.x) / 2.0))), 1e-300)), 6) AS log_likelihood FROM t a JOIN t b ON a.track_id = b.track_id WHERE NOT a.valid AND b.valid GROUP BY a.track_id, a.frame, a.x
""")
def kernel_likelihood(spark, sf):
    t = histories(spark, sf).withColumnRenamed("x", "value")
    got = likelihood.kernel_log_likelihood(t.where("not valid").select("track_id", "frame", "value"), t.where("valid").select("track_id", "value"), ["track_id"], ["frame"], 2.0)
    return got.select("track_id", "frame", *r6("log_likelihood"))


@query("""
WITH $TRACKS, m AS (SELECT track_id, type AS metric, exp(-avg(CASE WHEN valid THEN abs(vx) END)) AS value FROM t GROUP BY 1, 2),
w AS (SELECT type AS metric, CASE WHEN length(type) % 2 = 0 THEN 'even' ELSE 'odd' END AS bucket, length(type) / 100.0 AS weight FROM (SELECT DISTINCT type FROM t)),
j AS (SELECT * FROM m JOIN w USING (metric) WHERE value IS NOT NULL)
SELECT track_id, bucket, round(sum(weight * value) / sum(weight), 6) AS value FROM j GROUP BY 1, 2 UNION ALL SELECT track_id, 'meta', round(sum(weight * value), 6) FROM j GROUP BY 1
""")
def meta_metric(spark, sf):
    t = tracks(spark, sf)
    metrics = t.groupBy("track_id", F.col("type").alias("metric")).agg(F.exp(-aggregates.masked_mean(F.abs("vx"), F.col("valid"))).alias("value")).where("value is not null")
    weights = t.select(F.col("type").alias("metric")).distinct().select("metric", F.when(F.length("metric") % 2 == 0, "even").otherwise("odd").alias("bucket"), (F.length("metric") / 100.0).alias("weight"))
    return likelihood.weighted_buckets(metrics, weights, ["track_id"]).select("track_id", "bucket", *r6("value"))


@query("""
WITH $TRACKS, p AS (SELECT track_id, kind, sum(CASE WHEN valid THEN abs(x) END) AS s, count(CASE WHEN valid THEN abs(x) END) AS n FROM t GROUP BY 1, 2), b AS (SELECT track_id, min(s) AS s, max(n) AS n FROM p WHERE n > 0 GROUP BY 1)
SELECT round(avg(s / (n + 1e-6)), 6) AS value, count(*) AS keys FROM b
""")
def min_over_replicas(spark, sf):
    got = aggregates.min_over_replicas(tracks(spark, sf).withColumn("d", F.abs("x")), ["track_id"], "kind", "d", "valid")
    return got.select(*r6("value"), "keys")


@query("""
WITH $TRACKS, c AS (SELECT type, n, cur FROM (SELECT lag(type) OVER (PARTITION BY track_id ORDER BY frame) AS type, type AS cur, 1 AS n FROM t) WHERE type IS NOT NULL),
k AS (SELECT type, cur, row_number() OVER (PARTITION BY type ORDER BY count(*) DESC, cur) AS r FROM c GROUP BY type, cur)
SELECT c.type AS prev, count(*) AS n, round(avg(CASE WHEN k.r <= 2 THEN 1.0 ELSE 0.0 END), 6) AS top2 FROM c JOIN k ON c.type = k.type AND c.cur = k.cur GROUP BY c.type
""")
def topk_accuracy(spark, sf):
    pairs = windows.token_pairs(tracks(spark, sf), ["track_id"], "frame", "type")
    ranked = pairs.groupBy("prev", "cur").agg(F.count(F.lit(1)).alias("n")).groupBy("prev").agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), "cur"))), 1, 2).alias("top"))
    hit = F.exists("top", lambda s: s["cur"] == F.col("cur")).cast("double")
    return pairs.join(joins.small(ranked), "prev").groupBy("prev").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(hit), 6).alias("top2"))


@query("""
WITH l AS (SELECT o_orderkey AS k, o_orderstatus AS v FROM orders), r AS (SELECT l_orderkey AS k, min(l_linestatus) AS v FROM lineitem GROUP BY 1),
j AS (SELECT coalesce(l.k, r.k) AS k, CASE WHEN r.k IS NULL THEN 'left_only' WHEN l.k IS NULL THEN 'right_only' WHEN l.v IS DISTINCT FROM r.v THEN 'mismatch' ELSE 'matched' END AS status FROM l FULL JOIN r ON l.k = r.k)
SELECT status, count(*) AS n FROM j GROUP BY status
""")
def aligned_audit(spark, sf):
    left = table(spark, sf, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_orderstatus").alias("v"))
    right = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(F.min("l_linestatus").alias("v"))
    return joins.aligned(left, right, ["k"], ["v"]).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT d.doc_id, coalesce(quality, -1) AS quality, coalesce(toxic, -1) AS toxic, l.doc_id IS NOT NULL AS has_match FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def defaulted_join(spark, sf):
    return joins.with_default(table(spark, sf, "documents").select("doc_id"), table(spark, sf, "labels"), "doc_id", {"quality": -1, "toxic": -1})


@query("""
WITH $TRACKS, g AS (SELECT type AS gate, frame, avg(x) AS gx, CASE WHEN frame % 3 = 0 THEN 'STOP' ELSE 'GO' END AS state FROM t GROUP BY type, frame),
p AS (SELECT track_id, first_value(type) OVER (PARTITION BY track_id ORDER BY frame) AS gate, frame, x FROM t),
j AS (SELECT p.track_id, p.gate, p.frame, x - gx AS rel, state FROM p JOIN g ON p.gate = g.gate AND p.frame = g.frame),
c AS (SELECT *, lag(rel) OVER w AS before, frame - lag(frame) OVER w AS gap FROM j WINDOW w AS (PARTITION BY track_id, gate ORDER BY frame))
SELECT track_id, gate, frame FROM c WHERE gap = 1 AND before < 0 AND rel >= 0 AND state = 'STOP'
""")
def gate_crossings(spark, sf):
    from pyspark.sql import Window

    t = tracks(spark, sf)
    gates = t.groupBy(F.col("type").alias("gate"), "frame").agg(F.avg("x").alias("gx")).withColumn("state", F.when(F.col("frame") % 3 == 0, "STOP").otherwise("GO"))
    own = t.select("track_id", F.first("type").over(Window.partitionBy("track_id").orderBy("frame")).alias("gate"), "frame", "x")
    return joins.crossings(own, gates, ["track_id"], "gate", "frame", "x", "gx", ["STOP"])


@query("""
WITH RECURSIVE e AS (SELECT 'c' || c_custkey AS src, 'n' || c_nationkey AS dst FROM customer UNION ALL SELECT 'n' || s_nationkey, 's' || s_suppkey FROM supplier UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation),
w AS (SELECT 'c1' AS node, 0 AS hop UNION SELECT e.dst, w.hop + 1 FROM w JOIN e ON e.src = w.node WHERE w.hop < 3)
SELECT node, min(hop) AS hop FROM w GROUP BY node
""")
def bounded_hops(spark, sf):
    c, s, n = (table(spark, sf, x) for x in ("customer", "supplier", "nation"))
    name = lambda p, col: F.concat(F.lit(p), F.col(col).cast("string"))
    edges = c.select(name("c", "c_custkey").alias("src"), name("n", "c_nationkey").alias("dst")).union(s.select(name("n", "s_nationkey"), name("s", "s_suppkey"))).union(n.select(name("n", "n_nationkey"), name("r", "n_regionkey")))
    return joins.bounded_hops(edges, c.where("c_custkey = 1").select(name("c", "c_custkey").alias("node")), 3)


@query("""
WITH p AS (SELECT p_partkey, CAST(p_size AS DOUBLE) AS x, p_retailprice / 100.0 AS y FROM part)
SELECT p_partkey, 'square' AS zone FROM p WHERE x BETWEEN 5 AND 20 AND y BETWEEN 5 AND 20
UNION ALL SELECT p_partkey, 'triangle' FROM p WHERE x >= 10 AND y >= 10 AND x + y <= 50
""")
def points_in_polygons(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", F.col("p_size").cast("double").alias("x"), (F.col("p_retailprice") / 100.0).alias("y"))
    rings = {"square": [(5.0, 5.0), (20.0, 5.0), (20.0, 20.0), (5.0, 20.0)], "triangle": [(10.0, 10.0), (40.0, 10.0), (10.0, 40.0)]}
    zones = spark.createDataFrame(list(rings.items()), "zone string, ring array<struct<x:double,y:double>>")
    return joins.points_in_polygons(p, zones, "p_partkey", "zone")


@query("""
SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN CAST(CAST(regexp_extract(c_name, '(\\d+)$', 1) AS HUGEINT) % 100 AS INTEGER) ELSE CAST(CAST('0x' || substr(sha256(c_mktsegment), 1, 8) AS BIGINT) % 100 AS INTEGER) END AS bucket FROM customer
""")
def scene_buckets(spark, sf):
    c = table(spark, sf, "customer")
    return c.select("c_custkey", text.scene_bucket(F.when(F.col("c_custkey") % 2 == 0, F.col("c_name")).otherwise(F.col("c_mktsegment"))).alias("bucket"))


@query(f"""
WITH $TRACKS, {TAGGED_SQL}, d AS (SELECT DISTINCT track_id, s, tag FROM i),
a AS (SELECT track_id, s, list(CASE tag WHEN 'Parked' THEN 'parked' WHEN 'Straight' THEN 'moving straight' WHEN 'LeftTurn' THEN 'turning left' WHEN 'RightTurn' THEN 'turning right' WHEN 'Accelerate' THEN 'accelerating' WHEN 'Decelerate' THEN 'decelerating' WHEN 'KeepSpeed' THEN 'keeping a steady speed' END ORDER BY CASE WHEN tag IN ('LeftTurn', 'RightTurn') THEN 1 WHEN tag = 'Straight' THEN 2 WHEN tag = 'Parked' THEN 4 ELSE 3 END, tag) AS l FROM d GROUP BY 1, 2),
p AS (SELECT track_id, s, CASE WHEN len(l) = 1 THEN l[1] WHEN len(l) = 2 THEN l[1] || ' and ' || l[2] ELSE array_to_string(l[1:len(l) - 1], ', ') || ', and ' || l[len(l)] END AS phrase, row_number() OVER (PARTITION BY track_id ORDER BY s) AS k FROM a)
SELECT track_id, string_agg(CASE WHEN k = 1 THEN 'The' ELSE 'Then, the' END || ' target ' || CASE track_id % 3 WHEN 1 THEN 'pedestrian' WHEN 2 THEN 'cyclist' ELSE 'vehicle' END || ' is ' || phrase || '.', ' ' ORDER BY s) AS prompt FROM p GROUP BY track_id
""")
def ordered_sentences(spark, sf):
    return sentences(windows.islands(tagged(spark, sf), ["track_id", "tag"], "frame"))


def sentences(runs: DataFrame) -> DataFrame:
    """(track_id, prompt): a sentence for each start; the kind of a track follows from its number."""
    at = runs.groupBy("track_id", "start").agg(F.collect_set(F.struct(labels.tag_rank(F.col("tag")).alias("rank"), "tag")).alias("tags"))
    phrase = text.join_phrases(F.transform(F.array_sort("tags"), lambda x: labels.tag_phrase(x["tag"])))
    kind = F.when(F.col("track_id") % 3 == 1, "pedestrian").when(F.col("track_id") % 3 == 2, "cyclist").otherwise("vehicle")
    ordered = F.array_sort(F.collect_list(F.struct("start", phrase.alias("p"))))
    prompts = at.groupBy("track_id").agg(ordered.alias("all"))
    one = lambda x, i: F.concat(F.when(i == 0, "The").otherwise("Then, the"), F.lit(" target "), kind, F.lit(" is "), x["p"], F.lit("."))
    return prompts.select("track_id", F.array_join(F.transform("all", one), " ").alias("prompt"))


@query("""
WITH s AS (SELECT l_suppkey % 10 AS source, row_number() OVER (PARTITION BY l_suppkey % 10 ORDER BY l_orderkey, l_linenumber) - 1 AS record, l_orderkey, l_linenumber FROM lineitem),
b AS (SELECT source, sum(count(*)) OVER (ORDER BY source) - count(*) AS b FROM s GROUP BY source)
SELECT source, record, CAST(b + record AS BIGINT) AS global_index FROM s JOIN b USING (source) WHERE b + record >= 1000 AND b + record < 9000
""")
def global_range(spark, sf):
    from pyspark.sql import Window

    way = Window.partitionBy("source").orderBy("l_orderkey", "l_linenumber")
    s = table(spark, sf, "lineitem").withColumn("source", F.col("l_suppkey") % 10).withColumn("record", (F.row_number().over(way) - 1).cast("long"))
    return joins.global_range(s.select("source", "record"), "source", "record", 1000, 8000)


@query("""
SELECT 'both' AS side, count(*) AS n FROM (SELECT o_custkey FROM orders INTERSECT SELECT c_custkey FROM customer)
UNION ALL SELECT 'only_a', count(*) FROM (SELECT o_custkey FROM orders EXCEPT SELECT c_custkey FROM customer)
UNION ALL SELECT 'only_b', count(*) FROM (SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders)
""")
def key_audit(spark, sf):
    return joins.key_audit(table(spark, sf, "orders").select(F.col("o_custkey").alias("k")), table(spark, sf, "customer").select(F.col("c_custkey").alias("k")), "k")


@query("SELECT coalesce(CAST(p_brand AS VARCHAR), 'ALL') AS p_brand, coalesce(CAST(p_type AS VARCHAR), 'ALL') AS p_type, count(*) AS n FROM part GROUP BY ROLLUP (p_brand, p_type)")
def hierarchy(spark, sf):
    return aggregates.hierarchy(table(spark, sf, "part"), "p_brand", "p_type")


@query("""
WITH $TRACKS, e AS (SELECT frame, x AS ex, y AS ey FROM t WHERE track_id = (SELECT min(track_id) FROM t)),
d AS (SELECT t.track_id, t.frame, t.valid, sqrt((x - ex) * (x - ex) + (y - ey) * (y - ey)) AS dist FROM t JOIN e USING (frame)),
a AS (SELECT track_id, count(*) FILTER (WHERE valid AND dist < 150) AS near, min(dist) AS closest FROM d GROUP BY 1 HAVING count(*) FILTER (WHERE valid AND dist < 150) >= 5)
SELECT track_id, near, round(closest, 6) AS closest FROM (SELECT *, row_number() OVER (ORDER BY closest, track_id) AS k FROM a) WHERE k <= 32
""")
def ego_selection(spark, sf):
    t = tracks(spark, sf)
    ego = t.join(F.broadcast(t.agg(F.min("track_id").alias("track_id"))), "track_id").select("frame", F.col("x").alias("ex"), F.col("y").alias("ey"))
    dist = F.sqrt((F.col("x") - F.col("ex")) * (F.col("x") - F.col("ex")) + (F.col("y") - F.col("ey")) * (F.col("y") - F.col("ey")))
    near = t.join(ego, "frame").withColumn("dist", dist)
    kept = near.groupBy("track_id").agg(F.count_if(F.col("valid") & (F.col("dist") < 150)).alias("near"), F.min("dist").alias("closest")).where("near >= 5")
    return kept.orderBy("closest", "track_id").limit(32).select("track_id", "near", *r6("closest"))


@query("""
WITH $TRACKS, e AS (SELECT track_id, frame, x, y, heading, lead(x) OVER w AS nx, lead(y) OVER w AS ny, lead(heading) OVER w AS nh FROM t WINDOW w AS (PARTITION BY track_id ORDER BY frame))
SELECT track_id, frame, round((nx - x) * cos(heading) + (ny - y) * sin(heading), 6) AS lx, round((ny - y) * cos(heading) - (nx - x) * sin(heading), 6) AS ly,
  round((nh - heading) - 2 * pi() * floor((nh - heading + pi()) / (2 * pi())), 6) AS lh FROM e WHERE nx IS NOT NULL
""")
def next_step_targets(spark, sf):
    from pyspark.sql import Window

    way = Window.partitionBy("track_id").orderBy("frame")
    t = tracks(spark, sf).withColumns({"nx": F.lead("x").over(way), "ny": F.lead("y").over(way), "nh": F.lead("heading").over(way)}).where("nx is not null")
    lx, ly = angles.to_local(F.col("nx"), F.col("ny"), F.col("x"), F.col("y"), F.col("heading"))
    return t.select("track_id", "frame", F.round(lx, 6).alias("lx"), F.round(ly, 6).alias("ly"), F.round(angles.angle_difference(F.col("nh"), F.col("heading")), 6).alias("lh"))


@query("""
WITH $TRACKS, c AS (SELECT track_id, frame, unnest([0.5, 0.5, -0.5, -0.5]) * 4.8 AS lon, unnest([0.5, -0.5, -0.5, 0.5]) * 2.0 AS lat, x, y, heading FROM t)
SELECT track_id, round(min(x + lon * cos(heading) - lat * sin(heading)), 6) AS min_x, round(max(x + lon * cos(heading) - lat * sin(heading)), 6) AS max_x, round(min(y + lon * sin(heading) + lat * cos(heading)), 6) AS min_y, round(max(y + lon * sin(heading) + lat * cos(heading)), 6) AS max_y FROM c GROUP BY track_id
""")
def box_extents(spark, sf):
    t = tracks(spark, sf).withColumn("c", F.explode(angles.box_contour(F.col("x"), F.col("y"), F.col("heading"), F.lit(2.0), F.lit(4.8))))
    return t.groupBy("track_id").agg(*[F.round(f(f"c.{a}"), 6).alias(f"{n}_{a}") for a in ("x", "y") for n, f in (("min", F.min), ("max", F.max))])


@query("""
WITH $TRACKS SELECT track_id, round(atan2(avg(sin(heading)), avg(cos(heading))), 6) AS mean_heading FROM t GROUP BY track_id
""")
def circular_means(spark, sf):
    return tracks(spark, sf).groupBy("track_id").agg(F.round(angles.circular_mean(F.col("heading")), 6).alias("mean_heading"))


@query("""
WITH $TRACKS, d AS (SELECT track_id, frame, x, y, sqrt(pow(x - lag(x) OVER w, 2) + pow(y - lag(y) OVER w, 2)) AS d, (heading - lag(heading) OVER w) - 2 * pi() * floor((heading - lag(heading) OVER w + pi()) / (2 * pi())) AS turn FROM t WINDOW w AS (PARTITION BY track_id ORDER BY frame))
SELECT track_id, round(sum(coalesce(d, 0.0)), 6) AS arc_length, CASE WHEN sum(turn) > pi() / 6 THEN 'left' WHEN sum(turn) < -pi() / 6 THEN 'right' ELSE 'straight' END AS direction FROM d GROUP BY track_id
""")
def path_shape(spark, sf):
    from pyspark.sql import Window

    way = Window.partitionBy("track_id").orderBy("frame")
    dx, dy = F.col("x") - F.lag("x").over(way), F.col("y") - F.lag("y").over(way)
    t = tracks(spark, sf).withColumns({"d": F.sqrt(dx * dx + dy * dy), "turn": angles.wrap_angle(F.col("heading") - F.lag("heading").over(way))})
    return t.groupBy("track_id").agg(F.round(F.sum(F.coalesce("d", F.lit(0.0))), 6).alias("arc_length"), angles.turn_direction(F.sum("turn")).alias("direction"))


@query("""
WITH $TRACKS, o AS (SELECT track_id // 8 AS scene, frame, track_id AS id, x, y, heading, vx AS speed FROM t WHERE valid),
p AS (SELECT a.scene, a.frame, a.id, b.id AS bid, a.speed - b.speed AS closing, abs(b.heading - a.heading) AS turn, (b.x - a.x) * cos(a.heading) + (b.y - a.y) * sin(a.heading) AS lon, (b.y - a.y) * cos(a.heading) - (b.x - a.x) * sin(a.heading) AS lat
  FROM o a JOIN o b ON a.scene = b.scene AND a.frame = b.frame AND a.id <> b.id),
q AS (SELECT *, lon - (4.8 + abs(cos(turn)) * 4.8 + abs(sin(turn)) * 2.0) / 2 AS gap, abs(lat) - (2.0 + abs(sin(turn)) * 4.8 + abs(cos(turn)) * 2.0) / 2 AS ov FROM p),
n AS (SELECT *, row_number() OVER (PARTITION BY scene, frame, id ORDER BY gap, bid) AS k FROM q WHERE gap > 0 AND turn <= radians(75) AND ov < 0 AND (ov < -0.5 OR turn <= radians(10)))
SELECT o.scene, o.frame, o.id, round(CASE WHEN closing > 0 THEN least(5.0, gap / closing) ELSE 5.0 END, 6) AS ttc FROM o LEFT JOIN n ON o.scene = n.scene AND o.frame = n.frame AND o.id = n.id AND n.k = 1
""")
def time_to_collision(spark, sf):
    from ..operators import simulation

    o = tracks(spark, sf).where("valid").select(F.floor(F.col("track_id") / 8).alias("scene"), "frame", F.col("track_id").alias("id"), "x", "y", "heading", F.lit(4.8).alias("length"), F.lit(2.0).alias("width"), F.col("vx").alias("speed"))
    return simulation.time_to_collision(o, ["scene", "frame"]).select("scene", "frame", "id", *r6("ttc"))


@query("""
WITH $TRACKS, p AS (SELECT track_id, frame, kind AS rollout, x + kind / 10.0 AS x, y FROM t), d AS (SELECT t.track_id, p.rollout, avg(sqrt((p.x - t.x) * (p.x - t.x) + (p.y - t.y) * (p.y - t.y))) AS d FROM p JOIN t ON p.track_id = t.track_id AND p.frame = t.frame WHERE t.valid GROUP BY 1, 2)
SELECT track_id, round(avg(d), 6) AS ade, round(min(d), 6) AS min_ade FROM d GROUP BY track_id
""")
def displacement_error(spark, sf):
    from ..operators import simulation

    t = tracks(spark, sf)
    pred = t.select("track_id", "frame", F.col("kind").alias("rollout"), (F.col("x") + F.col("kind") / 10.0).alias("x"), "y")
    return simulation.displacement(pred, t.select("track_id", "frame", "x", "y", "valid"), ["track_id"], "rollout", "frame").select("track_id", *r6("ade", "min_ade"))


@query("SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY 1, 2")
def windowed_counts(spark, sf):
    from ..streaming import incremental

    return incremental.windowed_counts(table(spark, sf, "events")).select("start", "event_type", "n", *r6("total"))


@query("""
WITH $TRACKS SELECT track_id || '_' || (frame // 91) AS scenario_id, CAST(frame % 91 AS INTEGER) AS frame_index, CAST(kind AS INTEGER) AS object_type, x, y, valid FROM t
""")
def scenario_states(spark, sf):
    """Tracks as scenario messages of at most 91 frames and back: encoded, decoded, and exploded into states."""
    from ..sources import records

    t = tracks(spark, sf)
    state = F.struct("frame", "x", "y", "valid", "kind")
    scenario = F.concat_ws("_", "track_id", F.floor(F.col("frame") / 91))
    grouped = t.groupBy(scenario.alias("track_id")).agg(F.array_sort(F.collect_list(state)).alias("s"))

    def encode(batches):
        import pyarrow as pa

        for batch in records.pieces(batches):
            out = []
            for track, states in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows = [{"id": k, "object_type": s["kind"], "states": [{"center_x": s["x"], "center_y": s["y"], "valid": s["valid"]}]} for k, s in enumerate(states)]
                out.append(records.encode({"scenario_id": str(track), "timestamps_seconds": [0.1], "current_time_index": 0, "tracks": rows}, records.SCENARIO))
            yield pa.RecordBatch.from_arrays([pa.array(["events"] * len(out), pa.string()), pa.array(range(len(out)), pa.int64()), pa.array(out, pa.binary())], ["path", "record_index", "payload"])

    states = records.track_states(records.scenarios(grouped.mapInArrow(encode, records.RAW)))
    return states.select("scenario_id", F.col("track_id").alias("frame_index"), "object_type", "x", "y", "valid")


REGIONS = ["INTERSECTION", "NEAR_INTERSECTION_APPROACH", "NEAR_INTERSECTION_EXIT", "ROAD_SEGMENT", "OFF_MAP"]
ROAD_SQL = """r AS (SELECT *, ['INTERSECTION', 'NEAR_INTERSECTION_APPROACH', 'NEAR_INTERSECTION_EXIT', 'ROAD_SEGMENT', 'OFF_MAP'][event_id % 5 + 1] AS region, CASE WHEN vx >= 0 THEN x END AS distance FROM t),
c AS (SELECT *, CASE WHEN NOT valid THEN 'UNKNOWN' WHEN event_id % 13 = 0 THEN 'PARKING_LOT_PROXY' WHEN region = 'INTERSECTION' OR (region = 'NEAR_INTERSECTION_APPROACH' AND distance <= 30.0) OR (region = 'NEAR_INTERSECTION_EXIT' AND distance <= 15.0) THEN 'INTERSECTION'
  WHEN region IN ('ROAD_SEGMENT', 'NEAR_INTERSECTION_APPROACH', 'NEAR_INTERSECTION_EXIT') THEN 'ROAD_SEGMENT' ELSE 'UNKNOWN' END AS road FROM r),
k AS (SELECT *, CASE road WHEN 'PARKING_LOT_PROXY' THEN 'DRIVEWAY_POLYGON_PROXY' WHEN 'INTERSECTION' THEN CASE event_id % 4 + 2 WHEN 3 THEN 'THREE_ARM_INTERSECTION' WHEN 4 THEN 'FOUR_ARM_INTERSECTION' ELSE 'OTHER_INTERSECTION' END
  WHEN 'ROAD_SEGMENT' THEN CASE WHEN event_id % 4 > 0 THEN 'LANE_COUNT_' || (event_id % 4) ELSE 'UNKNOWN_LANE_COUNT' END ELSE 'UNKNOWN' END AS subtype FROM c)"""


@query(f"WITH $TRACKS, {ROAD_SQL} SELECT track_id, frame, road, subtype FROM k")
def road_classes(spark, sf):
    return road_frames(spark, sf).select("track_id", "frame", "road", "subtype")


def road_frames(spark: SparkSession, sf: str) -> DataFrame:
    from ..operators import kernels

    region = F.get(F.array(*map(F.lit, REGIONS)), (F.col("event_id") % 5).cast("int"))
    t = tracks(spark, sf).withColumns({"region": region, "distance": F.when(F.col("vx") >= 0, F.col("x"))})
    t = t.withColumn("road", kernels.road_class(F.col("valid"), F.col("region"), F.col("distance"), F.col("event_id") % 13 == 0))
    return t.withColumn("subtype", kernels.road_subtype(F.col("road"), F.col("event_id") % 4 + 2, F.col("event_id") % 4))


def soft_sql(rest: str) -> str:
    return f"""
WITH {NEAREST_SQL.split(",\nb AS")[0]}, k AS (SELECT vec_id, token, sqrt(d2) AS e, row_number() OVER (PARTITION BY vec_id ORDER BY sqrt(d2), token) AS r FROM d),
i AS (SELECT *, CASE WHEN r > 1 THEN 1.0 / ((e + 1e-4) * (e + 1e-4)) ELSE 0.0 END AS inv FROM k),
z AS (SELECT *, sum(inv) OVER (PARTITION BY vec_id) AS total FROM i)
SELECT vec_id, token, round(CASE WHEN r = 1 THEN 0.9 ELSE 0.1 * {rest} END, 6) AS weight FROM z
"""


@query(soft_sql("(inv / total)"))
def soft_targets(spark, sf):
    return token_weights(spark, sf, False)


@query(soft_sql("(inv / total / total)"))
def soft_targets_legacy(spark, sf):
    return token_weights(spark, sf, True)


@query(f"WITH {NEAREST_SQL}, k AS (SELECT DISTINCT vec_id, token FROM d) SELECT k.vec_id, k.token, CAST(CASE WHEN k.token = b.token THEN 1.0 ELSE 0.0 END AS DOUBLE) AS weight FROM k JOIN b ON k.vec_id = b.vec_id")
def hard_targets(spark, sf):
    got = token_weights(spark, sf, False, 0.0)
    return got.withColumn("weight", F.col("weight").cast("double"))


def token_weights(spark: SparkSession, sf: str, legacy: bool, smoothing: float = 0.1) -> DataFrame:
    """Weights of the vocabulary of nearest_token, which has 64 tokens, for all other vectors."""
    from ..operators import kernels

    e = table(spark, sf, "embeddings")
    words = joins.small(e.where("vec_id < 64").select(F.col("vec_id").alias("token"), F.col("embedding").alias("tv")))
    d = e.where("vec_id >= 64").join(words).select("vec_id", "token", F.sqrt(joins.squared_distance(F.col("embedding"), F.col("tv"))).alias("e"))
    return kernels.soft_targets(d, ["vec_id"], "token", "e", smoothing, legacy).select("vec_id", "token", *r6("weight"))


@query("""
SELECT o_custkey, o_orderkey, CAST(floor(o_custkey / 300.0) AS BIGINT) AS shard FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS k FROM orders) WHERE k = 1
""")
def first_rollouts(spark, sf):
    from ..operators import kernels

    return kernels.first_per_key(table(spark, sf, "orders"), "o_custkey", ["o_orderdate", "o_orderkey"], 300).select("o_custkey", "o_orderkey", "shard")


@query("""
WITH RECURSIVE $HISTORIES, s AS (SELECT track_id, frame, heading, valid FROM t),
r AS (SELECT * FROM s WHERE frame = 0 UNION ALL
  SELECT s.track_id, s.frame, CASE WHEN r.valid AND s.valid AND abs((r.heading - s.heading) - 2 * pi() * floor((r.heading - s.heading + pi()) / (2 * pi()))) > 1.5 THEN r.heading ELSE s.heading END, s.valid
  FROM r JOIN s ON s.track_id = r.track_id AND s.frame = r.frame + 1)
SELECT track_id, frame, round(heading, 6) AS heading FROM r
""")
def heading_repair(spark, sf):
    from ..operators import kernels

    return kernels.repair_headings(histories(spark, sf), "track_id", "frame", "heading", "valid").select("track_id", "frame", *r6("heading"))


@query()
def smoothed_tracks(spark, sf):
    """Least-squares smoothing; tests compare it with polynomial fits."""
    from ..operators import kernels

    return kernels.smooth_tracks(tracks(spark, sf), "track_id", "frame", "x", "valid")


FAN = [(r * math.cos(a), r * math.sin(a), a) for r in (0.0, 5.0, 20.0, 60.0) for a in (-1.0, -0.7, -0.45, -0.2, 0.05, 0.3, 0.55, 0.8, 1.05)]
CORNERS = [(2.4, 1.0), (2.4, -1.0), (-2.4, -1.0), (-2.4, 1.0)]


def corner_sql(x: str, y: str, h: str) -> list[tuple[str, str]]:
    return [(f"({x} + {lon} * cos({h}) - {lat} * sin({h}))", f"({y} + {lon} * sin({h}) + {lat} * cos({h}))") for lon, lat in CORNERS]


def matched_sql() -> str:
    own = corner_sql("s.x", "s.y", "s.heading")
    world = [(f"(r.x + v.cx{i} * cos(r.heading) - v.cy{i} * sin(r.heading))", f"(r.y + v.cx{i} * sin(r.heading) + v.cy{i} * cos(r.heading))") for i in range(4)]
    cost = " + ".join(f"sqrt(pow({a} - {c}, 2) + pow({b} - {d}, 2))" for (a, b), (c, d) in zip(world, own, strict=True))
    corners = ", ".join(f"{a} AS cx{i}, {b} AS cy{i}" for i, (a, b) in enumerate(corner_sql("dx", "dy", "dh")))
    mean = lambda axis: f"({' + '.join(w[axis] for w in world)}) / 4"
    ahead = f"atan2({world[0][1]} - {world[3][1]}, {world[0][0]} - {world[3][0]})"
    values = ", ".join(f"({i}, {dx!r}, {dy!r}, {dh!r})" for i, (dx, dy, dh) in enumerate(FAN))
    return f"""
WITH RECURSIVE $HISTORIES, s AS (SELECT track_id, frame // 5 AS step, x, y, heading, valid FROM t WHERE frame % 5 = 0),
v AS (SELECT token, {corners} FROM (VALUES {values}) AS f(token, dx, dy, dh)),
r AS (SELECT track_id, step, x, y, heading, valid, -1 AS token, false AS matched FROM s WHERE step = 0 UNION ALL
  SELECT track_id, step, CASE WHEN m THEN b.x ELSE sx END, CASE WHEN m THEN b.y ELSE sy END, CASE WHEN m THEN b.h ELSE sh END, sv, b.token, m FROM (
    SELECT s.track_id, s.step, s.x AS sx, s.y AS sy, s.heading AS sh, s.valid AS sv, r.valid AND s.valid AS m, min({{'d': {cost}, 'token': v.token, 'x': {mean(0)}, 'y': {mean(1)}, 'h': {ahead}}}) AS b
    FROM r JOIN s ON s.track_id = r.track_id AND s.step = r.step + 1 CROSS JOIN v GROUP BY ALL))
SELECT track_id, step, token, round(x, 5) AS x, round(y, 5) AS y, round(heading, 5) AS heading, matched FROM r WHERE step > 0
"""


@query(matched_sql())
def matched_tokens(spark, sf):
    """Sequential quantization of every fifth frame with a fan of boxes."""
    import numpy as np

    from ..operators import kernels

    t = histories(spark, sf).where("frame % 5 = 0").withColumn("step", F.floor(F.col("frame") / 5))
    got = kernels.match_tokens(t, kernels.token_contours(np.array(FAN), 2.0, 4.8), 2.0, 4.8, "track_id", "step")
    return got.select("track_id", "step", "token", *[F.round(c, 5).alias(c) for c in ("x", "y", "heading")], "matched")


GROUP_SQL = "CAST(floor(o_custkey / 64.0) AS BIGINT)"  # a group is a scenario: of bounded size, their number grows


@query(f"""
WITH RECURSIVE e AS (SELECT {GROUP_SQL} AS g, o_custkey AS src, o_custkey + o_orderkey % 3 * 7 AS dst FROM orders), u AS (SELECT g, src AS a, dst AS b FROM e UNION SELECT g, dst, src FROM e),
r AS (SELECT g, a AS node, a AS root FROM u UNION SELECT u.g, u.b, r.root FROM r JOIN u ON r.g = u.g AND r.node = u.a AND r.root < u.b)
SELECT g, node, least(node, min(root)) AS component FROM r GROUP BY g, node
""")
def lane_components(spark, sf):
    from ..operators import graph

    e = table(spark, sf, "orders").select(F.floor(F.col("o_custkey") / 64).alias("g"), F.col("o_custkey").alias("src"), (F.col("o_custkey") + F.col("o_orderkey") % 3 * 7).alias("dst"))
    return graph.components(e, "g")


@query(f"""
WITH RECURSIVE e AS (SELECT DISTINCT {GROUP_SQL} AS g, o_custkey AS src, o_custkey + (1 + o_orderkey % 3) * 7 AS dst, 1.0 + o_orderkey % 3 AS w FROM orders),
s AS (SELECT g, min(src) AS node FROM e GROUP BY g), d AS (SELECT g, node, 0.0 AS distance FROM s UNION SELECT e.g, e.dst, d.distance + e.w FROM d JOIN e ON d.g = e.g AND d.node = e.src WHERE d.distance + e.w <= 6.0)
SELECT g, node, CAST(min(distance) AS DOUBLE) AS distance FROM d GROUP BY g, node
""")
def lane_distances(spark, sf):
    from ..operators import graph

    e = table(spark, sf, "orders").select(F.floor(F.col("o_custkey") / 64).alias("g"), F.col("o_custkey").alias("src"), (F.col("o_custkey") + (1 + F.col("o_orderkey") % 3) * 7).alias("dst"), (1.0 + F.col("o_orderkey") % 3).alias("length")).distinct()
    return graph.distances(e, e.groupBy("g").agg(F.min("src").alias("node")), "g", most=6.0)


@query("""
WITH $TRACKS, a AS (SELECT track_id, frame, heading FROM t), g AS (SELECT *, heading - coalesce(lag(heading) OVER (PARTITION BY track_id ORDER BY heading), max(heading) OVER (PARTITION BY track_id) - 2 * pi()) AS gap FROM a),
w AS (SELECT track_id, heading AS origin FROM (SELECT *, row_number() OVER (PARTITION BY track_id ORDER BY gap DESC, heading) AS k FROM g) WHERE k = 1),
u AS (SELECT track_id, frame, CASE WHEN heading >= origin THEN heading ELSE heading + 2 * pi() END AS turned FROM a JOIN w USING (track_id)),
f AS (SELECT *, CASE WHEN turned - lag(turned) OVER (PARTITION BY track_id ORDER BY turned) > 0.5 THEN 1 ELSE 0 END AS fresh FROM u)
SELECT track_id, frame, CAST(sum(fresh) OVER (PARTITION BY track_id ORDER BY turned) AS BIGINT) AS cluster FROM f
""")
def circular_clusters(spark, sf):
    from ..operators import graph

    return graph.circular_clusters(tracks(spark, sf), ["track_id"], "heading", 0.5).select("track_id", "frame", "cluster")
