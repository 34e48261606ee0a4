"""Registered queries of agents, lanes, filters and scores over the trajectories of the events table."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import angles, text
from ..operators import agents, filters, intervals, joins, labels, lanes, scores, windows
from .queries import QUERIES, ROAD_SQL, SQL, TAGGED_SQL, query, r6, road_frames, sentences, tagged
from .tables import histories, table, tracks

#: Tracks of a scene: scenes are of bounded size, their number grows with the tracks.
SCENE_TRACKS = 8


def scenes(spark: SparkSession, sf: str) -> DataFrame:
    return tracks(spark, sf).withColumn("scene", F.floor(F.col("track_id") / SCENE_TRACKS))


def wrap_sql(a: str) -> str:
    return f"(({a}) - 2 * pi() * floor((({a}) + pi()) / (2 * pi())))"


def linear_sql(value: str, name: str) -> str:
    """The last and first valid value around each row, and the line between them by frame."""
    back = "OVER (PARTITION BY track_id ORDER BY frame ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    ahead = "OVER (PARTITION BY track_id ORDER BY frame ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"
    b, a = f"last_value(CASE WHEN valid THEN {value} END IGNORE NULLS) {back}", f"first_value(CASE WHEN valid THEN {value} END IGNORE NULLS) {ahead}"
    bt, at = f"last_value(CASE WHEN valid THEN frame END IGNORE NULLS) {back}", f"first_value(CASE WHEN valid THEN frame END IGNORE NULLS) {ahead}"
    return f"CASE WHEN {bt} = {at} THEN {b} ELSE {b} + ({a} - {b}) * (frame - {bt}) / ({at} - {bt}) END AS {name}"


@query(f"""
WITH $TRACKS, k AS (SELECT *, max(CASE WHEN frame = 10 AND valid THEN 1 END) OVER (PARTITION BY track_id) AS chosen, min(CASE WHEN valid THEN frame END) OVER (PARTITION BY track_id) AS f0, max(CASE WHEN valid THEN frame END) OVER (PARTITION BY track_id) AS f1,
    last_value(CASE WHEN valid THEN heading END IGNORE NULLS) OVER (PARTITION BY track_id ORDER BY frame ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev FROM t),
u AS (SELECT *, sum(CASE WHEN valid THEN CASE WHEN prev IS NULL THEN heading ELSE {wrap_sql("heading - prev")} END END) OVER (PARTITION BY track_id ORDER BY frame) AS turned FROM k WHERE chosen = 1),
l AS (SELECT track_id, frame, f0, f1, valid AS observed, {linear_sql("x", "lx")}, {linear_sql("y", "ly")}, {linear_sql("turned", "lh")} FROM u)
SELECT track_id, frame, round(lx, 6) AS x, round(ly, 6) AS y, round(lh, 5) AS heading, observed FROM l WHERE frame BETWEEN f0 AND f1
""")
def agent_features(spark, sf):
    got = agents.agent_features(tracks(spark, sf), ["track_id"], "frame", 10, ["x", "y"])
    return got.select("track_id", "frame", *r6("x", "y"), F.round("heading", 5).alias("heading"), "observed")


@query("""
WITH $TRACKS, m AS (SELECT track_id, max(frame) FILTER (WHERE frame <= 10) AS seen, max(CASE WHEN frame = 10 THEN vx END) AS l, max(CASE WHEN frame = 10 THEN vy END) AS w,
    avg(CASE WHEN valid AND frame <= 10 AND vx > 0 THEN vx END) AS ml, avg(CASE WHEN valid AND frame <= 10 AND vy > 0 THEN vy END) AS mw FROM t GROUP BY track_id)
SELECT track_id, round(CASE WHEN l > 0 THEN l ELSE coalesce(ml, l) END, 6) AS length, round(CASE WHEN w > 0 THEN w ELSE coalesce(mw, w) END, 6) AS width FROM m WHERE seen = 10
""")
def causal_shapes(spark, sf):
    t = tracks(spark, sf).withColumnsRenamed({"vx": "length", "vy": "width"})
    return agents.causal_shapes(t, ["track_id"], "frame", "valid", ["length", "width"], 10).select("track_id", *r6("length", "width"))


@query("""
WITH $TRACKS, s AS (SELECT *, track_id // 8 AS scene, track_id = min(track_id) OVER (PARTITION BY track_id // 8) AS ego FROM t),
e AS (SELECT scene, frame, x AS ex, y AS ey FROM s WHERE ego),
d AS (SELECT s.scene, track_id, s.frame, valid, ego, sqrt((x - ex) * (x - ex) + (y - ey) * (y - ey)) AS dist FROM s JOIN e ON s.scene = e.scene AND s.frame = e.frame),
a AS (SELECT scene, track_id, bool_or(ego) AS role, coalesce(bool_or(frame = 10 AND dist < 100), false) AND count(*) FILTER (WHERE frame > 10 AND valid AND dist < 150) >= 5 AS extra FROM d GROUP BY 1, 2),
n AS (SELECT *, count(*) FILTER (WHERE role OR extra) OVER (PARTITION BY scene) AS total, count(*) FILTER (WHERE role) OVER (PARTITION BY scene) AS roles, row_number() OVER (PARTITION BY scene, extra AND NOT role ORDER BY md5(CAST(track_id AS VARCHAR))) AS k FROM a)
SELECT scene, track_id, CASE WHEN total > 4 THEN role OR (extra AND k <= 4 - roles) ELSE role OR extra END AS chosen FROM n
""")
def target_mask(spark, sf):
    from pyspark.sql import Window

    s = scenes(spark, sf)
    ego = F.col("track_id") == F.min("track_id").over(Window.partitionBy("scene"))
    return agents.target_mask(s.withColumn("ego", ego).withColumn("role", F.col("ego")), "scene", "track_id", "frame", 10, 4)


@query("""
WITH $TRACKS, d AS (SELECT track_id, kind, x / 10.0 AS len, y / 4.0 AS wid, y / 5.0 AS hei, abs(vx) AS speed FROM t WHERE frame = 10 AND valid)
SELECT track_id, CASE WHEN len <= 0 OR wid <= 0 OR hei <= 0 THEN 'INVALID_DIMENSIONS'
  WHEN kind = 1 THEN CASE WHEN len <= 3.0 AND wid <= 1.2 THEN 'MOTORCYCLE_PROXY' WHEN len > 5.7912 THEN 'LARGE_VEHICLE_PROXY' ELSE 'SMALL_VEHICLE_PROXY' END
  WHEN kind = 2 THEN CASE WHEN hei < 1.4478 THEN 'CHILD_PEDESTRIAN_PROXY' ELSE 'ADULT_PEDESTRIAN_PROXY' END ELSE CASE WHEN speed >= 24.0 / 3.6 THEN 'E_BIKE_PROXY' ELSE 'BICYCLE_PROXY' END END AS size_class FROM d
""")
def size_records(spark, sf):
    size = labels.size_class(F.col("kind"), F.col("x") / 10.0, F.col("y") / 4.0, F.col("y") / 5.0, F.abs("vx"))
    return agents.size_records(tracks(spark, sf), "frame", 10, size).select("track_id", "size_class")


@query(f"""
WITH $TRACKS, g AS (SELECT *, lag(x) OVER w AS x1, lag(x, 2) OVER w AS x2, lag(y) OVER w AS y1, lag(y, 2) OVER w AS y2, lag(heading) OVER w AS h1, valid AND lag(valid) OVER w AND lag(valid, 2) OVER w AS ok FROM t WINDOW w AS (PARTITION BY track_id ORDER BY frame)),
d AS (SELECT track_id, frame, heading, coalesce(ok, false) AS usable, ((x - x1) / 0.1 - (x1 - x2) / 0.1) / 0.1 AS ax, ((y - y1) / 0.1 - (y1 - y2) / 0.1) / 0.1 AS ay, {wrap_sql("heading - h1")} / 0.1 AS turn FROM g WHERE frame IN (5, 10))
SELECT track_id, frame, usable, round(CASE WHEN usable THEN greatest(-15.0, least(15.0, ax * cos(heading) + ay * sin(heading))) ELSE 0.0 END, 6) AS along,
  round(CASE WHEN usable THEN greatest(-3.0, least(3.0, turn)) ELSE 0.0 END, 6) AS turning, round(CASE WHEN usable THEN greatest(-15.0, least(15.0, ay * cos(heading) - ax * sin(heading))) ELSE 0.0 END, 6) AS across FROM d
""")
def history_dynamics(spark, sf):
    got = agents.history_dynamics(tracks(spark, sf), ["track_id"], "frame", [5, 10])
    return got.select("track_id", "frame", "usable", *r6("along", "turning", "across"))


SEGMENT_SQL = """s AS (SELECT track_id, k * 5 AS start, list(x / 100.0 ORDER BY frame) AS xs, list(y / 100.0 ORDER BY frame) AS ys, list(heading ORDER BY frame) AS hs
  FROM (SELECT *, unnest(generate_series(greatest(0, CAST(ceil((frame - 5) / 5.0) AS BIGINT)), CAST(floor(frame / 5.0) AS BIGINT))) AS k FROM t) GROUP BY track_id, k HAVING count(*) = 6)"""


def segments(spark: SparkSession, sf: str) -> DataFrame:
    """track_id, start, values: six states (x, y, heading) from every fifth frame."""
    t = tracks(spark, sf).withColumn("state", F.struct((F.col("x") / 100.0).alias("x"), (F.col("y") / 100.0).alias("y"), "heading"))
    return windows.hopping_segments(t, ["track_id"], "frame", "state", 6, 5)


def acceleration_sql(a: str) -> str:
    v4, v3 = f"({a}[6] - {a}[4]) / 0.2", f"({a}[5] - {a}[3]) / 0.2"
    v5 = f"(3 * {a}[6] - 4 * {a}[5] + {a}[4]) / 0.2"
    return f"(3 * {v5} - 4 * ({v4}) + ({v3})) / 0.2"


@query(f"""
WITH $TRACKS, {SEGMENT_SQL}, a AS (SELECT *, {acceleration_sql("xs")} AS ax, {acceleration_sql("ys")} AS ay, (3 * {wrap_sql("hs[6] - hs[5]")} - {wrap_sql("hs[5] - hs[4]")}) / 0.2 AS turn FROM s)
SELECT track_id, start, round(greatest(-15.0, least(15.0, ax * cos(hs[6]) + ay * sin(hs[6]))), 5) AS along, round(greatest(-3.0, least(3.0, turn)), 5) AS turning, round(greatest(-15.0, least(15.0, ay * cos(hs[6]) - ax * sin(hs[6]))), 5) AS across FROM a
""")
def token_dynamics(spark, sf):
    part = lambda c: F.transform("values", lambda v: v[c])
    got = segments(spark, sf).select("track_id", "start", agents.endpoint_dynamics(part("x"), part("y"), part("heading")).alias("d"))
    return got.select("track_id", "start", *[F.round(f"d.{c}", 5).alias(c) for c in ("along", "turning", "across")])


@query(f"""
WITH $TRACKS, p AS (SELECT track_id, frame, lag(type) OVER (PARTITION BY track_id ORDER BY frame) AS prev, type AS cur FROM t), z AS ({SQL["transition_table"]})
SELECT p.track_id, p.frame, z.a, z.b FROM p JOIN z ON p.prev = z.prev AND p.cur = z.cur
""")
def transition_lookup(spark, sf):
    pairs = windows.token_pairs(tracks(spark, sf), ["track_id"], "frame", "type")
    return agents.looked_up(pairs, QUERIES["transition_table"](spark, sf).select("prev", "cur", "a", "b"), ["prev", "cur"], ["a", "b"]).select("track_id", "frame", "a", "b")


@query("""
WITH $TRACKS, v AS (SELECT track_id, frame, x, y, vx, vy, heading, valid AND frame >= track_id % 13 AS valid FROM t),
f AS (SELECT track_id, min(frame) AS f FROM v WHERE valid GROUP BY 1), b AS (SELECT v.track_id, f, x AS fx, y AS fy, vx AS fvx, vy AS fvy, heading AS fh, CASE WHEN f = 10 THEN 5 ELSE f % 5 END AS back FROM v JOIN f ON v.track_id = f.track_id AND v.frame = f.f),
m AS (SELECT v.*, b.*, coalesce(f - frame > 0 AND f - frame <= back, false) AS fill FROM v LEFT JOIN b ON v.track_id = b.track_id)
SELECT track_id, frame, round(CASE WHEN fill THEN fx - (f - frame) * 0.1 * fvx ELSE x END, 6) AS x, round(CASE WHEN fill THEN fy - (f - frame) * 0.1 * fvy ELSE y END, 6) AS y, round(CASE WHEN fill THEN fh ELSE heading END, 6) AS heading, valid OR fill AS valid FROM m
""")
def back_filled(spark, sf):
    t = tracks(spark, sf).withColumn("valid", F.col("valid") & (F.col("frame") >= F.col("track_id") % 13))
    return agents.back_filled(t, ["track_id"], "frame").select("track_id", "frame", *r6("x", "y", "heading"), "valid")


@query("WITH $HISTORIES SELECT a.track_id, a.frame AS src, b.frame AS dst FROM t a JOIN t b ON a.track_id = b.track_id AND b.frame > a.frame AND b.frame <= a.frame + 3 WHERE a.valid AND b.valid")
def temporal_edges(spark, sf):
    return agents.temporal_edges(histories(spark, sf), ["track_id"], "frame", "valid", 3)


@query()
def sampled_tokens(spark, sf):
    """Seeded draws, which SQL does not reproduce; tests check one and many candidates."""
    t = tracks(spark, sf).select("track_id", "frame", F.posexplode(F.array(*[((F.col("event_id") * (k + 3)) % 11) / 3.0 for k in range(5)])).alias("token", "logit"))
    return agents.sampled_tokens(t, ["track_id", "frame"], "token", "logit", 3)


LANE_SQL = """m AS (SELECT track_id AS scene, type, min(x) AS x0, max(x) AS x1, min(y) AS y0 FROM t GROUP BY 1, 2),
p AS (SELECT *, unnest(range(0, 10)) AS vertex FROM m), q AS (SELECT scene, type, vertex, x0 + (x1 - x0) * vertex / 9.0 AS px, y0 + 0.05 * vertex AS py FROM p),
v AS (SELECT q.*, s.px AS tx, s.py AS ty, n.px - s.px AS ux, n.py - s.py AS uy FROM q JOIN q s ON q.scene = s.scene AND q.type = s.type AND s.vertex = least(q.vertex, 8) JOIN q n ON q.scene = n.scene AND q.type = n.type AND n.vertex = least(q.vertex, 8) + 1)"""


def lane_map(spark: SparkSession, sf: str) -> DataFrame:
    """A lane of ten points for each event type of a track, whose map it is."""
    m = tracks(spark, sf).groupBy(F.col("track_id").alias("scene"), "type").agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"))
    point = lambda k: F.struct((F.col("x0") + (F.col("x1") - F.col("x0")) * k / 9.0).alias("x"), (F.col("y0") + k / 20.0).alias("y"))
    return m.select("scene", "type", F.transform(F.sequence(F.lit(0), F.lit(9)), point).alias("points"))


@query(f"""
WITH $TRACKS, {LANE_SQL},
d AS (SELECT t.track_id, t.frame, v.*, t.x, t.y, row_number() OVER (PARTITION BY t.track_id, t.frame ORDER BY (px - x) * (px - x) + (py - y) * (py - y), v.type, vertex) AS k FROM t JOIN v ON t.track_id = v.scene)
SELECT track_id, frame, type AS lane, round(CASE WHEN ux * (y - ty) - uy * (x - tx) >= 0 THEN 1 ELSE -1 END * sqrt((px - x) * (px - x) + (py - y) * (py - y)), 6) AS lane_offset, round(atan2(uy, ux), 6) AS lane_heading FROM d WHERE k = 1
""")
def lane_offsets(spark, sf):
    points = tracks(spark, sf).select(F.col("track_id").alias("scene"), "frame", "x", "y")
    got = lanes.lane_offsets(points, lanes.lane_vertices(lane_map(spark, sf), ["scene"], "type", "points"), ["scene"], ["frame"], "type")
    return got.select(F.col("scene").alias("track_id"), "frame", F.col("type").alias("lane"), F.round("offset", 6).alias("lane_offset"), *r6("lane_heading"))


DRIFT_SQL = f"""o AS (SELECT track_id, frame, (CASE WHEN p <= 8 THEN p * 0.5 - 0.5 ELSE (p - 9) * 0.5 - 1.5 END) * CASE WHEN track_id % 2 = 0 THEN 1 ELSE -1 END AS off, vy * 0.05 AS turn
  FROM (SELECT track_id, row_number() OVER (PARTITION BY track_id ORDER BY frame) - 1 AS i, frame, vy, (row_number() OVER (PARTITION BY track_id ORDER BY frame) - 1 + track_id) % 14 AS p FROM t WHERE valid)),
s AS (SELECT *, row_number() OVER w AS i, count(*) OVER (PARTITION BY track_id) AS n, lead(off) OVER w AS nxt, lead(off) OVER w - off AS d, acos(cos(turn)) < {math.radians(5.0)!r} AND abs(off) < 0.55 AS fits FROM o WINDOW w AS (PARTITION BY track_id ORDER BY frame)),
g AS (SELECT *, i = 1 OR coalesce(lag(d) OVER w * d < 0, false) AS turns, min(d) OVER f8 > 0 AS up, max(d) OVER f8 < 0 AS down, min(CASE WHEN d <= 0 THEN i END) OVER fo AS stop_up, min(CASE WHEN d >= 0 THEN i END) OVER fo AS stop_down
  FROM s WINDOW w AS (PARTITION BY track_id ORDER BY frame), f8 AS (PARTITION BY track_id ORDER BY frame ROWS BETWEEN CURRENT ROW AND 7 FOLLOWING), fo AS (PARTITION BY track_id ORDER BY frame ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
b AS (SELECT track_id, frame AS start, CASE WHEN up THEN 'left' ELSE 'right' END AS direction, CASE WHEN up THEN stop_up WHEN down THEN stop_down END AS e FROM g WHERE turns AND i + 8 <= n AND abs(off) <= 0.75),
c AS (SELECT b.track_id, start, direction, (SELECT min(z.frame) FROM g z WHERE z.track_id = b.track_id AND z.i > b.e + 1 AND z.fits) AS "end" FROM b JOIN g ON g.track_id = b.track_id AND g.i = b.e WHERE g.off * g.nxt < 0 AND abs(g.off) >= 1.25 AND abs(g.nxt) >= 1.25)"""


def drift(t: DataFrame) -> DataFrame:
    """Lane changes of the valid frames under an offset that drifts out of one lane and into the next."""
    from pyspark.sql import Window

    t = t.where("valid")
    p = (F.row_number().over(Window.partitionBy("track_id").orderBy("frame")) - 1 + F.col("track_id")) % 14
    off = F.when(p <= 8, p * 0.5 - 0.5).otherwise((p - 9) * 0.5 - 1.5) * F.when(F.col("track_id") % 2 == 0, 1).otherwise(-1)
    states = t.select("track_id", "frame", off.alias("offset"), (F.col("vy") * 0.05).alias("heading"), F.lit(0.0).alias("lane_heading"))
    return lanes.lane_changes(states, ["track_id"], "frame", end_heading=math.radians(5.0))


@query(f"""WITH $HISTORIES, {DRIFT_SQL} SELECT track_id, start, "end", direction FROM c WHERE "end" IS NOT NULL""")
def lane_changes(spark, sf):
    return drift(histories(spark, sf))


@query(f"""
WITH $TRACKS, {DRIFT_SQL}, a AS ({SQL["frame_actions"].replace("WITH $TRACKS, g AS", "WITH g AS")}), r AS (SELECT t.track_id, t.frame, t.kind, (SELECT arg_min(direction, start) FROM c WHERE c.track_id = t.track_id AND t.frame BETWEEN c.start AND c."end") AS lane FROM t)
SELECT a.track_id, a.frame, CASE WHEN a.action <> 'STOP' AND kind = 1 AND lane = 'left' THEN 'LEFT_LANE_CHANGE' WHEN a.action <> 'STOP' AND kind = 1 AND lane = 'right' THEN 'RIGHT_LANE_CHANGE' ELSE a.action END AS action FROM a JOIN r ON a.track_id = r.track_id AND a.frame = r.frame
""")
def lane_actions(spark, sf):
    t = tracks(spark, sf).where("valid")
    t = windows.clamped(t, ["track_id"], "frame", "heading", 10, 30).withColumnRenamed("future", "far").drop("past")
    t = lanes.in_lane_change(windows.clamped(t, ["track_id"], "frame", "heading", 10, 10), drift(tracks(spark, sf)), ["track_id"], "frame")
    action = labels.action_class(F.col("kind"), F.col("vx"), F.col("heading"), F.col("past"), F.col("future"), F.col("far"), F.col("vy"), F.col("lane_change"))
    return t.select("track_id", "frame", action.alias("action"))


@query("""
WITH $HISTORIES, p AS (SELECT a.kind, a.frame, a.track_id AS id, b.vx AS v FROM t a JOIN t b ON a.frame = b.frame AND a.kind = b.kind AND a.track_id <> b.track_id AND (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= 9.0)
SELECT kind, frame, id, count(*) AS n_local, round(coalesce(avg(CASE WHEN v > 0 THEN CASE WHEN v <= 2 THEN 1.0 ELSE 0.0 END END), 0.0), 6) AS ratio FROM p GROUP BY ALL
""")
def local_ratio(spark, sf):
    p = histories(spark, sf).select("kind", "frame", F.col("track_id").alias("id"), "x", "y", "vx")
    return lanes.local_ratio(p, ["kind", "frame"], 3.0, "vx", 2.0).select("kind", "frame", "id", "n_local", *r6("ratio"))


def box_sql() -> str:
    """The distance of the rounded boxes a and b, 4.8 x 2.0, as in operators.lanes.box_distance."""
    hl, hw, off = (4.8 - 1.4) / 2, (2.0 - 1.4) / 2, 0.7
    gaps, corners = [], []
    for p, q, sign in (("a", "b", 1), ("b", "a", -1)):
        c, s = f"abs(cos({q}.heading - {p}.heading))", f"abs(sin({q}.heading - {p}.heading))"
        dx, dy = f"({sign} * (b.x - a.x))", f"({sign} * (b.y - a.y))"
        gaps += [f"abs({dx} * cos({p}.heading) + {dy} * sin({p}.heading)) - {hl} - ({hl} * {c} + {hw} * {s})", f"abs({dy} * cos({p}.heading) - {dx} * sin({p}.heading)) - {hw} - ({hl} * {s} + {hw} * {c})"]
        for i in (1, -1):
            for j in (1, -1):
                px = f"({p}.x + {i * hl} * cos({p}.heading) - {j * hw} * sin({p}.heading) - {q}.x)"
                py = f"({p}.y + {i * hl} * sin({p}.heading) + {j * hw} * cos({p}.heading) - {q}.y)"
                lon, lat = f"abs({px} * cos({q}.heading) + {py} * sin({q}.heading)) - {hl}", f"abs({py} * cos({q}.heading) - {px} * sin({q}.heading)) - {hw}"
                corners.append(f"sqrt(pow(greatest({lon}, 0.0), 2) + pow(greatest({lat}, 0.0), 2))")
    most = f"greatest({', '.join(gaps)})"
    return f"CASE WHEN {most} <= 0 THEN {most} ELSE least({', '.join(corners)}) END - {2 * off}"


@query(f"""
WITH $TRACKS, o AS (SELECT track_id // 8 AS scene, frame, track_id AS id, x, y, heading FROM t WHERE valid),
p AS (SELECT a.scene, a.frame, a.id, {box_sql()} AS d FROM o a JOIN o b ON a.scene = b.scene AND a.frame = b.frame AND a.id <> b.id),
m AS (SELECT scene, frame, id, min(d) AS d FROM p GROUP BY ALL)
SELECT o.scene, o.frame, o.id, round(coalesce(d, 1e10), 5) AS distance FROM o LEFT JOIN m ON o.scene = m.scene AND o.frame = m.frame AND o.id = m.id
""")
def nearest_object(spark, sf):
    return object_distances(spark, sf).select("scene", "frame", "id", F.round("distance", 5).alias("distance"))


def object_distances(spark: SparkSession, sf: str) -> DataFrame:
    o = scenes(spark, sf).where("valid").select("scene", "frame", F.col("track_id").alias("id"), "x", "y", "heading", F.lit(4.8).alias("length"), F.lit(2.0).alias("width"))
    return lanes.nearest_object(o, ["scene", "frame"])


@query(f"""
WITH $TRACKS, {SEGMENT_SQL}, p AS (SELECT track_id, start, list_transform(range(1, 7), lambda i: {{'x': xs[i], 'y': ys[i]}}) AS a FROM s),
g AS (SELECT p.track_id, p.start, list_transform(p.a, lambda u: list_min(list_transform(n.a, lambda v: sqrt((u.x - v.x) * (u.x - v.x) + (u.y - v.y) * (u.y - v.y))))) AS d FROM p JOIN p n ON p.track_id = n.track_id AND n.start = p.start + 10)
SELECT track_id, start, round(list_sum(d) / len(d), 6) AS mean, round(list_max(d), 6) AS most, round(list_min(d), 6) AS least FROM g
""")
def polyline_gaps(spark, sf):
    s = segments(spark, sf)
    later = s.select("track_id", (F.col("start") - 10).alias("start"), F.col("values").alias("later"))
    got = s.join(later, ["track_id", "start"]).select("track_id", "start", lanes.polyline_gaps(F.col("values"), F.col("later")).alias("g"))
    return got.select("track_id", "start", *[F.round(f"g.{c}", 6).alias(c) for c in ("mean", "most", "least")])


@query(f"""
WITH $TRACKS, {SEGMENT_SQL}
SELECT track_id, start, round(list_sum(list_transform(range(1, 4), lambda i: abs(xs[i + 3] - 3 * xs[i + 2] + 3 * xs[i + 1] - xs[i]))) / 3 / 0.001, 4) AS jerk FROM s
""")
def third_differences(spark, sf):
    got = segments(spark, sf).select("track_id", "start", filters.third_difference(F.transform("values", lambda v: v["x"])).alias("jerk"))
    return got.select("track_id", "start", F.round("jerk", 4).alias("jerk"))


@query("""
WITH $TRACKS, g AS (SELECT *, lag(x) OVER w AS v0, lead(x) OVER w AS v2, lag(frame) OVER w AS t0, lead(frame) OVER w AS t2 FROM t WHERE valid WINDOW w AS (PARTITION BY track_id ORDER BY frame)),
r AS (SELECT *, abs(x - (v0 + (frame - t0) / (t2 - t0) * (v2 - v0))) AS r, abs(v2 - v0) AS s FROM g), m AS (SELECT *, median(r) OVER (PARTITION BY track_id) AS m FROM r), d AS (SELECT *, median(abs(r - m)) OVER (PARTITION BY track_id) AS d FROM m)
SELECT track_id, frame, coalesce(r > greatest(1.0, m + 0.5 * 1.4826 * d) AND r > 1.0 * s, false) AS rejected FROM d
""")
def residual_outliers(spark, sf):
    return filters.residual_outliers(tracks(spark, sf), ["track_id"], "frame", "frame", "x", "valid", 1.0, 0.5, 1.0)


@query(f"""
WITH $TRACKS, r AS (SELECT track_id, frame, heading AS h, row_number() OVER w AS k, lead(heading) OVER w AS h2 FROM t WHERE valid WINDOW w AS (PARTITION BY track_id ORDER BY frame)),
j AS (SELECT *, lead(k) OVER w AS k2, lead(h2) OVER w AS after FROM r WHERE abs({wrap_sql("h2 - h")}) > {math.radians(120.0)!r} WINDOW w AS (PARTITION BY track_id ORDER BY k)),
f AS (SELECT * FROM j WHERE k2 - k <= 3 AND abs({wrap_sql("h - after")}) <= {math.radians(45.0)!r})
SELECT DISTINCT r.track_id, r.frame FROM r JOIN f ON r.track_id = f.track_id AND r.k > f.k AND r.k <= f.k2
""")
def heading_flips(spark, sf):
    return filters.heading_flips(tracks(spark, sf), ["track_id"], "frame", "heading", "valid", math.radians(120.0), math.radians(45.0), 3)


@query("""
WITH $TRACKS, m AS (SELECT track_id, frame, valid, unnest(range(0, 3)) AS mode, event_id FROM t), k AS (SELECT *, row_number() OVER (PARTITION BY track_id, frame ORDER BY (event_id + 2 * mode) % 7 DESC, mode) AS r FROM m),
p AS (SELECT track_id, sum(CASE WHEN valid THEN mode * 0.5 END) AS s, count(*) FILTER (WHERE valid) AS n FROM k WHERE r = 1 GROUP BY 1)
SELECT round(avg(s / (n + 1e-6)), 6) AS value, count(*) AS keys FROM p WHERE n > 0
""")
def mode_displacement(spark, sf):
    m = tracks(spark, sf).withColumn("mode", F.explode(F.sequence(F.lit(0), F.lit(2))))
    m = m.select("track_id", "frame", "mode", ((F.col("event_id") + 2 * F.col("mode")) % 7).alias("logit"), (F.col("mode") * 0.5).alias("distance"), "valid")
    return scores.mode_displacement(m, ["track_id"], "frame").select(*r6("value"), "keys")


@query("""
WITH $TRACKS, l AS (SELECT track_id, frame, unnest(range(0, 5)) AS token, event_id FROM t WHERE valid), p AS (SELECT *, (event_id * (token + 3)) % 11 / 3.0 AS l, CASE WHEN token = event_id % 5 THEN 0.9 ELSE 0.025 END AS w FROM l),
e AS (SELECT track_id, frame, sum(w) * ln(sum(exp(l))) - sum(w * l) AS loss FROM p GROUP BY 1, 2)
SELECT track_id, count(*) AS n, round(avg(loss), 6) AS loss FROM e GROUP BY 1
""")
def cross_entropy(spark, sf):
    t = tracks(spark, sf).where("valid").withColumn("token", F.explode(F.sequence(F.lit(0), F.lit(4))))
    rows = t.select("track_id", "frame", ((F.col("event_id") * (F.col("token") + 3)) % 11 / 3.0).alias("logit"), F.when(F.col("token") == F.col("event_id") % 5, 0.9).otherwise(0.025).alias("target"))
    return scores.cross_entropy(rows, ["track_id", "frame"], "logit", "target").groupBy("track_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("loss"), 6).alias("loss"))


def jerk_sql(value: str, ok: str, name: str, source: str) -> str:
    """Three central differences of value over source, with the validity of both neighbours each time."""
    parts, prev, good, table_ = [], value, ok, source
    for level in (1, 2, 3):
        here = f"{name}{level}"
        parts.append(f"{here}t AS (SELECT *, coalesce(lag({good}) OVER w AND lead({good}) OVER w, false) AS {here}ok, CASE WHEN lag({good}) OVER w AND lead({good}) OVER w THEN (lead({prev}) OVER w - lag({prev}) OVER w) / (lead(frame) OVER w - lag(frame) OVER w) END AS {here} FROM {table_} WINDOW w AS (PARTITION BY track_id ORDER BY frame))")
        prev, good, table_ = here, f"{here}ok", f"{here}t"
    return ", ".join(parts)


@query(f"""
WITH $TRACKS, n AS (SELECT *, x + 0.1 * (event_id % 3) AS z, event_id % 5 <> 0 OR track_id % 2 = 0 AS ok FROM t), {jerk_sql("x", "valid", "r", "n")}, {jerk_sql("z", "ok", "q", "r3t")},
a AS (SELECT track_id, count(r3) AS support, count(*) FILTER (WHERE r3 IS NOT NULL AND q3 IS NOT NULL) AS matched, sqrt(avg(r3 * r3)) AS rr, sqrt(avg(CASE WHEN r3 IS NOT NULL THEN q3 * q3 END)) AS qr, sqrt(avg(q3 * q3)) AS fr, sqrt(avg(CASE WHEN valid AND ok THEN (z - x) * (z - x) END)) AS e FROM q3t GROUP BY 1)
SELECT track_id, round(CASE WHEN matched = support THEN rr END, 5) AS raw_rms, round(CASE WHEN matched = support THEN qr END, 5) AS new_rms, round(fr, 5) AS full_rms, round(CASE WHEN support > 0 THEN matched / support END, 6) AS coverage, round(e, 6) AS rmse FROM a
""")
def track_evaluation(spark, sf):
    t = tracks(spark, sf).withColumns({"z": F.col("x") + 0.1 * (F.col("event_id") % 3), "ok": (F.col("event_id") % 5 != 0) | (F.col("track_id") % 2 == 0)})
    got = scores.track_evaluation(t, ["track_id"], "frame", "x", "valid", "z", "ok")
    return got.select("track_id", *[F.round(c, 5).alias(c) for c in ("raw_rms", "new_rms", "full_rms")], *r6("coverage", "rmse"))


@query(f"""
WITH $TRACKS, m AS ({SQL["motion_modes"].replace("WITH $TRACKS, m AS", "WITH m AS")})
SELECT mode, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share, round(avg(abs(vx)), 6) AS mean_vx, round(avg(abs(vy)), 6) AS mean_vy FROM m JOIN t ON m.track_id = t.track_id AND m.frame = t.frame GROUP BY mode
""")
def motion_summary(spark, sf):
    t = windows.motion_modes(tracks(spark, sf), ["track_id"], "frame")
    return scores.shares(t, "mode", ["vx", "vy"]).select("mode", "n", *r6("share", "mean_vx", "mean_vy"))


@query(f"""
WITH $TRACKS, a AS ({SQL["frame_actions"].replace("WITH $TRACKS, g AS", "WITH g AS")})
SELECT kind, action, count(*) AS n, count(DISTINCT a.frame) AS n_frame FROM a JOIN t ON a.track_id = t.track_id AND a.frame = t.frame GROUP BY 1, 2
""")
def action_recounts(spark, sf):
    got = QUERIES["frame_actions"](spark, sf).join(tracks(spark, sf).select("track_id", "frame", "kind"), ["track_id", "frame"])
    return scores.recounts(got, ["kind", "action"], "frame")


@query("WITH $TRACKS SELECT type AS name, count(*) AS n FROM t GROUP BY 1")
def summary_maps(spark, sf):
    """Counts kept as a map for each track, summed over the maps."""
    per = tracks(spark, sf).groupBy("track_id", "type").agg(F.count(F.lit(1)).alias("n"))
    maps = per.groupBy("track_id").agg(F.map_from_entries(F.collect_list(F.struct("type", "n"))).alias("counts"))
    return scores.merged_counts(maps, "counts")


@query(f"""
WITH $TRACKS, {ROAD_SQL}, p AS (SELECT track_id, road, subtype, count(*) AS n FROM k GROUP BY ALL), u AS (SELECT track_id, region, count(*) AS n FROM k WHERE road = 'UNKNOWN' GROUP BY ALL),
a AS (SELECT track_id, CAST(sum(n) AS BIGINT) AS frames, array_to_string(list_sort(list_distinct(list(road))), ',') AS categories, string_agg(road || '/' || subtype || '=' || n, ',' ORDER BY road || '/' || subtype) AS counts FROM p GROUP BY 1),
b AS (SELECT track_id, string_agg(region || '=' || n, ',' ORDER BY region) AS unknown FROM u GROUP BY 1)
SELECT a.*, b.unknown FROM a LEFT JOIN b USING (track_id)
""")
def road_summary(spark, sf):
    got = scores.scenario_summary(road_frames(spark, sf), "track_id", "road", "subtype", "region")
    line = lambda c: F.array_join(F.transform(c, lambda x: F.concat_ws("=", x["name"], x["n"].cast("string"))), ",")
    return got.select("track_id", "frames", F.array_join("categories", ",").alias("categories"), line("counts").alias("counts"), F.when(F.col("unknown").isNotNull(), line("unknown")).alias("unknown"))


@query(f"""
WITH $TRACKS, {TAGGED_SQL}, f AS (SELECT *, CASE WHEN s <= max(e) OVER (PARTITION BY track_id, tag ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 5 THEN 0 ELSE 1 END AS fresh FROM i),
h AS (SELECT *, sum(fresh) OVER (PARTITION BY track_id, tag ORDER BY s, e) AS run FROM f)
SELECT CAST(track_id AS VARCHAR) AS agent, tag AS action, min(s) AS start, max(e) AS "end" FROM h GROUP BY track_id, tag, run HAVING max(e) - min(s) >= 10
""")
def tag_parsing(spark, sf):
    """Intervals written as tag texts, then parsed, merged and cut to those that last."""
    runs = windows.islands(tagged(spark, sf), ["track_id", "tag"], "frame")
    texts = runs.select("track_id", F.concat(F.col("tag"), F.lit("Temporal("), F.col("track_id").cast("string"), F.lit(" at "), F.col("start").cast("string"), F.lit("-"), F.col("end").cast("string"), F.lit(")")).alias("entry"))
    parsed = intervals.parsed_tags(texts, "entry", list(labels.TAG_PHRASES)).select("agent", "action", "start", "end")
    return intervals.merge_intervals(parsed, ["agent", "action"], 5).where(F.col("end") - F.col("start") >= 10)


@query(f"""
WITH $TRACKS, z AS ({SQL["ordered_sentences"].replace("WITH $TRACKS, g AS", "WITH g AS")}), a AS (SELECT DISTINCT track_id FROM t)
SELECT a.track_id, CASE WHEN a.track_id % 4 = 0 THEN '' ELSE coalesce(z.prompt, '') END AS prompt, a.track_id % 4 <> 0 AND coalesce(z.prompt, '') <> '' AS has_prompt FROM a LEFT JOIN z ON a.track_id = z.track_id
""")
def agent_prompts(spark, sf):
    """Prompts of agents through a mapping of scenarios to scenes, which a quarter of the scenarios lack."""
    found = sentences(windows.islands(tagged(spark, sf), ["track_id", "tag"], "frame")).select(F.concat(F.lit("scene_"), F.col("track_id")).alias("scene"), F.col("track_id").alias("agent"), "prompt")
    wanted = tracks(spark, sf).select("track_id").distinct().select(F.col("track_id").cast("string").alias("scenario"), F.col("track_id").alias("agent"))
    mapping = wanted.where("agent % 4 <> 0").select("scenario", F.concat(F.lit("scene_"), F.col("agent")).alias("scene"))
    return joins.prompts_for(wanted, mapping, found).select(F.col("agent").alias("track_id"), "prompt", "has_prompt")


@query("""
SELECT c_custkey, c_mktsegment || chr(9) || c_nationkey AS count_key, c_nationkey || chr(9) || c_mktsegment || chr(9) || (c_custkey % 10) AS frame_key, regexp_replace(c_name, '[^A-Za-z0-9_.-]+', '_', 'g') AS safe_id,
  list_sum(list_transform(string_split(c_mktsegment, ''), lambda x: ascii(x))) AS code_sum, TRY_CAST(c_mktsegment AS DOUBLE) IS NULL AS no_number FROM customer
""")
def encoded_keys(spark, sf):
    c = table(spark, sf, "customer")
    codes = F.aggregate(text.code_points(F.col("c_mktsegment")), F.lit(0), lambda s, x: s + x).cast("long")
    return c.select("c_custkey", text.count_key(F.col("c_mktsegment"), F.col("c_nationkey")).alias("count_key"), text.count_key(F.col("c_nationkey"), F.col("c_mktsegment"), F.col("c_custkey") % 10).alias("frame_key"), text.safe_id(F.col("c_name")).alias("safe_id"), codes.alias("code_sum"), F.col("c_mktsegment").try_cast("double").isNull().alias("no_number"))


@query(f"""
WITH $TRACKS, z AS ({SQL["displacement_error"].replace("WITH $TRACKS, p AS", "WITH p AS")}), n AS ({SQL["nearest_object"].replace("WITH $TRACKS, o AS", "WITH o AS")}),
d AS (SELECT track_id // 8 AS scene, avg(ade) AS ade, avg(min_ade) AS min_ade FROM z GROUP BY 1), c AS (SELECT scene, avg(CASE WHEN hit THEN 1.0 ELSE 0.0 END) AS collision_rate FROM (SELECT scene, id, bool_or(distance < 0) AS hit FROM n GROUP BY 1, 2) GROUP BY 1),
b AS (SELECT scene, ade, min_ade, collision_rate, 0.6 * exp(-min_ade) + 0.4 * (1 - collision_rate) AS meta FROM d JOIN c USING (scene))
SELECT CAST(scene AS VARCHAR) AS scene, round(ade, 5) AS ade, round(min_ade, 5) AS min_ade, round(collision_rate, 6) AS collision_rate, round(meta, 5) AS meta FROM b
UNION ALL SELECT 'mean', round(avg(ade), 5), round(avg(min_ade), 5), round(avg(collision_rate), 6), round(avg(meta), 5) FROM b
""")
def metric_bundle(spark, sf):
    """Displacement, collisions and their weighted sum for each scene, and the mean of every metric over the scenes."""
    near = QUERIES["nearest_object"](spark, sf).groupBy("scene", "id").agg(F.bool_or(F.col("distance") < 0).alias("hit"))
    collisions = near.groupBy("scene").agg(F.avg(F.col("hit").cast("double")).alias("collision_rate"))
    errors = QUERIES["displacement_error"](spark, sf).groupBy(F.floor(F.col("track_id") / SCENE_TRACKS).alias("scene")).agg(F.avg("ade").alias("ade"), F.avg("min_ade").alias("min_ade"))
    both = errors.join(collisions, "scene").withColumn("meta", 0.6 * F.exp(-F.col("min_ade")) + 0.4 * (1 - F.col("collision_rate"))).withColumn("scene", F.col("scene").cast("string"))
    names = ["ade", "min_ade", "collision_rate", "meta"]
    mean = both.agg(*[F.avg(c).alias(c) for c in names]).select(F.lit("mean").alias("scene"), *names)
    digits = {"collision_rate": 6}
    return both.select("scene", *names).unionByName(mean).select("scene", *[F.round(c, digits.get(c, 5)).alias(c) for c in names])


@query(f"""
WITH $TRACKS, p AS (SELECT track_id, frame, x, y, lead(x) OVER w AS x1, lead(y) OVER w AS y1, lead(x, 2) OVER w AS x2, lead(y, 2) OVER w AS y2 FROM t WINDOW w AS (PARTITION BY track_id ORDER BY frame))
SELECT track_id, frame, CASE WHEN (x1 - x) * (y2 - y) - (y1 - y) * (x2 - x) > 0 THEN 'left' ELSE 'right' END AS side, round(sqrt((x2 - x) * (x2 - x) + (y2 - y) * (y2 - y)), 6) AS distance,
  acos(least(1.0, abs(cos(atan2(y1 - y, x1 - x) - atan2(y2 - y1, x2 - x1))))) < {math.radians(15.0)!r} AS parallel FROM p WHERE x2 IS NOT NULL
""")
def point_sides(spark, sf):
    """The place two frames on, seen from the line to the next one."""
    from pyspark.sql import Window

    way = Window.partitionBy("track_id").orderBy("frame")
    t = tracks(spark, sf).withColumns({f"{c}{k}": F.lead(c, k).over(way) for c in ("x", "y") for k in (1, 2)}).where("x2 is not null")
    x, y, x1, y1, x2, y2 = map(F.col, ("x", "y", "x1", "y1", "x2", "y2"))
    headings = F.atan2(y1 - y, x1 - x), F.atan2(y2 - y1, x2 - x1)
    return t.select("track_id", "frame", angles.side_of_line(x2, y2, x, y, x1, y1).alias("side"), F.round(angles.point_distance(x2, y2, x, y), 6).alias("distance"), angles.parallel(*headings).alias("parallel"))

