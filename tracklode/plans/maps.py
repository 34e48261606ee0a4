"""Registered queries over maps: a scene of eight tracks is a scenario with a map of its own."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import junctions as crossings
from ..operators import mapmatch, paths, polylines, roadedge, splines
from .queries import query, r6
from .tables import tracks

FRAMES = 91
SCENARIOS_SQL = "k AS MATERIALIZED (SELECT *, track_id // 8 AS scene, frame // 91 AS part, event_id % 10 AS lane FROM t)"


def scenarios(spark: SparkSession, sf: str) -> DataFrame:
    """tracks() with scene and part, and one of ten lanes."""
    return tracks(spark, sf).withColumns({"scene": F.floor(F.col("track_id") / 8), "part": F.floor(F.col("frame") / FRAMES), "lane": F.col("event_id") % 10})


KEYS = ["scene", "part"]
#: The lane map of a scenario: the states of every tenth event, in their order, are a lane's points.
LANE_SQL = """lp AS (SELECT scene, part, lane, row_number() OVER (PARTITION BY scene, part, lane ORDER BY event_id) - 1 AS segment, x AS x0, y AS y0, lead(x) OVER (PARTITION BY scene, part, lane ORDER BY event_id) - x AS ux, lead(y) OVER (PARTITION BY scene, part, lane ORDER BY event_id) - y AS uy FROM k),
ls AS (SELECT *, sqrt(ux * ux + uy * uy) AS length, coalesce(sum(sqrt(ux * ux + uy * uy)) OVER (PARTITION BY scene, part, lane ORDER BY segment ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0) AS s0 FROM lp WHERE ux IS NOT NULL)"""


def lane_map(k: DataFrame) -> DataFrame:
    per = k.groupBy(*KEYS, "lane").agg(F.array_sort(F.collect_list(F.struct("event_id", "x", "y"))).alias("points"))
    return mapmatch.lane_segments(per, KEYS, "lane", "points")


def lane_links(k: DataFrame) -> DataFrame:
    """An even lane exits into the next; each lane has the fifth lane from it as its left neighbour."""
    lane = F.col("lane")
    exits = k.where(lane % 2 == 0).select(*KEYS, lane.alias("src"), ((lane + 1) % 10).alias("dst"), F.lit("exit").alias("kind"))
    left = k.select(*KEYS, lane.alias("src"), ((lane + 5) % 10).alias("dst"), F.lit("left").alias("kind"))
    return exits.unionByName(left).distinct()


@query(f"""
WITH RECURSIVE $TRACKS, {SCENARIOS_SQL}, {LANE_SQL},
n AS (SELECT *, row_number() OVER (PARTITION BY scene, part, track_id ORDER BY frame) AS i FROM k WHERE valid),
q AS (SELECT n.scene, n.part, track_id, frame, i, ls.lane, segment, s0, length, ux, uy, heading, x - x0 AS dx, y - y0 AS dy FROM n JOIN ls ON n.scene = ls.scene AND n.part = ls.part),
g AS (SELECT *, CASE WHEN ux * ux + uy * uy > 1e-12 THEN greatest(0.0, least(1.0, (dx * ux + dy * uy) / (ux * ux + uy * uy))) ELSE 0.0 END AS f FROM q),
h AS (SELECT *, sqrt((dx - f * ux) * (dx - f * ux) + (dy - f * uy) * (dy - f * uy)) AS gap, atan2(uy, ux) - heading AS w FROM g),
b AS (SELECT * FROM h WHERE gap <= 32.0 QUALIFY row_number() OVER (PARTITION BY scene, part, track_id, frame, lane ORDER BY gap, segment) = 1),
c AS (SELECT scene, part, track_id, frame, i, lane, gap, abs(w - 2 * pi() * floor((w + pi()) / (2 * pi()))) AS turn, s0 + f * length AS s, segment + CASE WHEN f >= 0.5 THEN 1 ELSE 0 END AS point FROM b),
d AS (SELECT *, gap <= 8.0 AND turn <= radians(60.0) AS fits, gap + 2.0 * turn AS cost FROM c),
e AS MATERIALIZED (SELECT * FROM d QUALIFY fits OR NOT bool_or(fits) OVER (PARTITION BY scene, part, track_id, frame)),
j AS (SELECT *, dense_rank() OVER (PARTITION BY scene, part, track_id ORDER BY i) AS step FROM e),
r AS (
  SELECT scene, part, track_id, CAST(0 AS BIGINT) AS step, CAST(NULL AS BIGINT) AS frame, CAST(NULL AS BIGINT) AS lane, CAST(NULL AS DOUBLE) AS s, CAST(NULL AS BIGINT) AS point, CAST(NULL AS DOUBLE) AS gap, CAST(NULL AS DOUBLE) AS turn, false AS fits, false AS related FROM (SELECT DISTINCT scene, part, track_id FROM j)
  UNION ALL
  SELECT scene, part, track_id, step, frame, lane, s, point, gap, turn, fits, related FROM (
    SELECT j.scene, j.part, j.track_id, j.step, j.frame, j.lane, j.s, j.point, j.gap, j.turn, j.fits, o.related, row_number() OVER (PARTITION BY j.scene, j.part, j.track_id ORDER BY j.cost + CASE WHEN o.related THEN 0.0 ELSE 2.0 END, j.gap, j.lane) AS place
    FROM r JOIN j ON r.scene = j.scene AND r.part = j.part AND r.track_id = j.track_id AND j.step = r.step + 1,
    LATERAL (SELECT NOT r.fits OR r.lane = j.lane OR j.lane = (r.lane + 5) % 10 OR (r.lane % 2 = 0 AND j.lane = (r.lane + 1) % 10) OR (j.lane % 2 = 0 AND r.lane = (j.lane + 1) % 10) AS related) o) WHERE place = 1)
SELECT n.scene, n.part, n.track_id, n.frame, lane, round(s, 5) AS s, point, round(gap, 6) AS gap, round(turn, 6) AS turn, coalesce(fits, false) AS confident,
  CASE WHEN fits THEN round(0.55 * greatest(0.0, 1 - gap / 8.0) + 0.35 * greatest(0.0, 1 - turn / radians(60.0)) + 0.1 * CAST(related AS INTEGER), 6) ELSE 0.0 END AS confidence
FROM (SELECT scene, part, track_id, frame FROM n) n LEFT JOIN (SELECT * FROM r WHERE step > 0) r ON n.scene = r.scene AND n.part = r.part AND n.track_id = r.track_id AND n.frame = r.frame
""")
def map_matching(spark, sf):
    """Valid states on the lanes of their scenario, with the lane carried along the track."""
    k = scenarios(spark, sf)
    # A lane counts in links only where it has states; links to other lanes change nothing.
    got = mapmatch.matched_lanes(k.where("valid"), lane_map(k), lane_links(k), KEYS, "track_id", "frame")
    return got.select(*KEYS, "track_id", "frame", "lane", F.round("s", 5).alias("s"), F.col("point").cast("long").alias("point"), *r6("gap", "turn"), "confident", *r6("confidence"))


#: The ring map of a scenario: two rings of five lanes, each an arc, a lane that leads to each arc's start
#: and one that leads away from its end. The numbers of events choose radii and which lanes are linked.
RING_SQL = """rn AS MATERIALIZED (SELECT scene, part, lane, count(*) AS n FROM k GROUP BY 1, 2, 3),
ra AS MATERIALIZED (SELECT *, lane // 5 AS ring, lane % 5 AS arc, 10.0 + 3 * (lane // 5) + (n % 3) * 0.2 AS r, 10.0 * (scene // 268435456 % 100) AS ox, 10.0 * (scene % 268435456 % 100) AS oy FROM rn),
rp AS MATERIALIZED (
  SELECT scene, part, lane, i, ox + r * cos(radians(72.0 * arc + 9 * i)) AS x, oy + r * sin(radians(72.0 * arc + 9 * i)) AS y FROM (SELECT *, unnest(range(0, 9)) AS i FROM ra)
  UNION ALL SELECT scene, part, 100 + lane, i, ox + (r + 20 * (1 - i)) * cos(radians(72.0 * arc)), oy + (r + 20 * (1 - i)) * sin(radians(72.0 * arc)) FROM (SELECT *, unnest(range(0, 2)) AS i FROM ra)
  UNION ALL SELECT scene, part, 200 + lane, i, ox + (r + 20 * i) * cos(radians(72.0 * (arc + 1))), oy + (r + 20 * i) * sin(radians(72.0 * (arc + 1))) FROM (SELECT *, unnest(range(0, 2)) AS i FROM ra)),
rl AS (
  SELECT scene, part, lane AS src, ring * 5 + (arc + 1) % 5 AS dst FROM ra WHERE n % 11 <> 0
  UNION ALL SELECT scene, part, 100 + lane, lane FROM ra WHERE n % 2 = 0 UNION ALL SELECT scene, part, lane, 200 + lane FROM ra WHERE n % 2 = 1),
e AS MATERIALIZED (SELECT l.* FROM rl l JOIN (SELECT DISTINCT scene, part, lane FROM rp) a ON a.scene = l.scene AND a.part = l.part AND a.lane = src JOIN (SELECT DISTINCT scene, part, lane FROM rp) b ON b.scene = l.scene AND b.part = l.part AND b.lane = dst),
reach AS (SELECT scene, part, src AS a, dst AS b FROM e UNION SELECT reach.scene, reach.part, a, e.dst FROM reach JOIN e ON reach.scene = e.scene AND reach.part = e.part AND reach.b = e.src),
sc AS MATERIALIZED (SELECT x.scene, x.part, x.a AS lane, min(x.b) AS component FROM reach x JOIN reach y ON x.scene = y.scene AND x.part = y.part AND x.a = y.b AND x.b = y.a GROUP BY 1, 2, 3)"""


def ring_lanes(k: DataFrame) -> DataFrame:
    n = k.groupBy(*KEYS, "lane").agg(F.count(F.lit(1)).alias("n"))
    return n.withColumns({"ring": F.floor(F.col("lane") / 5), "arc": F.col("lane") % 5, "r": 10.0 + 3 * F.floor(F.col("lane") / 5) + (F.col("n") % 3) * 0.2, "ox": 10.0 * (F.floor(F.col("scene") / (1 << 28)) % 100), "oy": 10.0 * (F.col("scene") % (1 << 28) % 100)})


def ring_map(arcs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(KEYS, lane, points), (KEYS, src, dst)."""

    def line(first: int, steps: int, radius, degrees) -> DataFrame:
        at = lambda i: F.struct((F.col("ox") + radius(i) * F.cos(F.radians(degrees(i)))).alias("x"), (F.col("oy") + radius(i) * F.sin(F.radians(degrees(i)))).alias("y"))
        return arcs.select(*KEYS, (F.col("lane") + first).alias("lane"), F.array(*map(at, range(steps))).alias("points"))

    r, arc = F.col("r"), F.col("arc")
    lanes = line(0, 9, lambda i: r, lambda i: 72.0 * arc + 9 * i).unionByName(line(100, 2, lambda i: r + 20 * (1 - i), lambda i: 72.0 * arc)).unionByName(line(200, 2, lambda i: r + 20 * i, lambda i: 72.0 * (arc + 1)))
    lane, n = F.col("lane"), F.col("n")
    link = lambda which, src, dst: arcs.where(which).select(*KEYS, src.alias("src"), dst.alias("dst"))
    links = link(n % 11 != 0, lane, F.col("ring") * 5 + (arc + 1) % 5).unionByName(link(n % 2 == 0, lane + 100, lane)).unionByName(link(n % 2 == 1, lane, lane + 200))
    known = lanes.select(*KEYS, "lane")
    return lanes, links.join(known.withColumnRenamed("lane", "src"), [*KEYS, "src"], "left_semi").join(known.withColumnRenamed("lane", "dst"), [*KEYS, "dst"], "left_semi")


@query(f"""
WITH RECURSIVE $TRACKS, {SCENARIOS_SQL}, {RING_SQL}
SELECT scene, part, component, lane AS node FROM sc
""")
def strong_components(spark, sf):
    """Directed components of the lanes of a scenario."""
    return crossings.strong_components(ring_map(ring_lanes(scenarios(spark, sf)))[1], KEYS)


ROUNDABOUT_SQL = """bx AS MATERIALIZED (SELECT scene, part, component, (min(x) + max(x)) / 2 AS cx, (min(y) + max(y)) / 2 AS cy, max(x) - min(x) AS w, max(y) - min(y) AS h, count(DISTINCT lane) AS lanes FROM sc JOIN rp USING (scene, part, lane) GROUP BY 1, 2, 3),
sp AS MATERIALIZED (SELECT bx.*, sqrt((x - cx) ** 2 + (y - cy) ** 2) AS r, atan2(y - cy, x - cx) - 2 * pi() * floor(atan2(y - cy, x - cx) / (2 * pi())) AS a FROM bx JOIN sc USING (scene, part, component) JOIN rp USING (scene, part, lane)),
sg AS (SELECT *, coalesce(lead(a) OVER (PARTITION BY scene, part, component ORDER BY a), min(a) OVER (PARTITION BY scene, part, component) + 2 * pi()) - a AS gap FROM sp),
sh AS MATERIALIZED (SELECT scene, part, component, cx, cy, max(w) AS w, max(h) AS h, max(lanes) AS lanes, quantile_cont(r, 0.1) AS r1, quantile_cont(r, 0.5) AS r5, quantile_cont(r, 0.9) AS r9, max(gap) AS gap FROM sg GROUP BY 1, 2, 3, 4, 5),
tg AS (SELECT scene, part, component, lane, x, y, lead(x) OVER o - x AS ux, lead(y) OVER o - y AS uy FROM sc JOIN rp USING (scene, part, lane) WINDOW o AS (PARTITION BY scene, part, lane ORDER BY i)),
al AS (SELECT tg.scene, tg.part, tg.component, abs((ux * (x + ux / 2 - cx) + uy * (y + uy / 2 - cy)) / (sqrt(ux * ux + uy * uy) * sqrt((x + ux / 2 - cx) ** 2 + (y + uy / 2 - cy) ** 2))) AS v FROM tg JOIN bx USING (scene, part, component) WHERE ux IS NOT NULL),
rg AS MATERIALIZED (SELECT scene, part, component, cx, cy, r5 FROM sh JOIN (SELECT scene, part, component, quantile_cont(v, 0.5) AS a5, quantile_cont(v, 0.9) AS a9 FROM al GROUP BY 1, 2, 3) USING (scene, part, component)
  WHERE lanes <= 64 AND least(w, h) >= 8 AND least(w, h) >= 0.65 * greatest(w, h) AND r1 >= 3 AND r9 <= 1.5 * r1 AND gap <= radians(45.0) AND a5 <= 0.25 AND a9 <= 0.6),
cc AS MATERIALIZED (SELECT a.scene, a.part, a.component, min(b.component) AS core FROM rg a JOIN rg b ON a.scene = b.scene AND a.part = b.part AND sqrt((a.cx - b.cx) ** 2 + (a.cy - b.cy) ** 2) <= greatest(8.0, 0.25 * least(a.r5, b.r5)) GROUP BY 1, 2, 3),
cl AS MATERIALIZED (SELECT scene, part, core, lane FROM cc JOIN sc USING (scene, part, component)),
ct AS MATERIALIZED (SELECT scene, part, core, (min(x) + max(x)) / 2 AS cx, (min(y) + max(y)) / 2 AS cy, string_agg(DISTINCT lane, ',' ORDER BY lane) AS lanes FROM cl JOIN rp USING (scene, part, lane) GROUP BY 1, 2, 3),
gl AS MATERIALIZED (
  SELECT DISTINCT e.scene, e.part, core, src AS lane, true AS incoming FROM e JOIN cl ON e.scene = cl.scene AND e.part = cl.part AND e.dst = cl.lane WHERE NOT EXISTS (SELECT 1 FROM cl z WHERE z.scene = e.scene AND z.part = e.part AND z.core = cl.core AND z.lane = e.src)
  UNION ALL SELECT DISTINCT e.scene, e.part, core, dst, false FROM e JOIN cl ON e.scene = cl.scene AND e.part = cl.part AND e.src = cl.lane WHERE NOT EXISTS (SELECT 1 FROM cl z WHERE z.scene = e.scene AND z.part = e.part AND z.core = cl.core AND z.lane = e.dst)),
ga AS MATERIALIZED (SELECT gl.*, atan2(y - cy, x - cx) - 2 * pi() * floor(atan2(y - cy, x - cx) / (2 * pi())) AS a FROM gl JOIN ct USING (scene, part, core) JOIN rp ON rp.scene = gl.scene AND rp.part = gl.part AND rp.lane = gl.lane AND i = CASE WHEN incoming THEN 1 ELSE 0 END),
gg AS (SELECT *, coalesce(lead(a) OVER (PARTITION BY scene, part, core ORDER BY a), min(a) OVER (PARTITION BY scene, part, core) + 2 * pi()) - a AS gap FROM ga),
gc AS (SELECT scene, part, core, greatest(1, count(*) FILTER (WHERE gap > radians(30.0))) AS arms, count(*) AS gates, bool_or(incoming) AND bool_or(NOT incoming) AS two_way FROM gg GROUP BY 1, 2, 3),
rb AS (SELECT scene, part, core, lanes, (SELECT count(*) FROM cc WHERE cc.scene = ct.scene AND cc.part = ct.part AND cc.core = ct.core) AS rings, cx, cy, arms, gates FROM ct JOIN gc USING (scene, part, core) WHERE two_way AND arms BETWEEN 3 AND 8)"""


@query(f"""
WITH RECURSIVE $TRACKS, {SCENARIOS_SQL}, {RING_SQL}, {ROUNDABOUT_SQL}
SELECT scene, part, core, lanes, rings, round(cx, 6) AS cx, round(cy, 6) AS cy, CAST(arms AS INTEGER) AS arms FROM rb
""")
def roundabouts(spark, sf):
    """Rings of lanes with ways in and out; here all ways lead straight from the centre, so directions are arms."""
    got = crossings.roundabouts(*ring_map(ring_lanes(scenarios(spark, sf))), KEYS)
    return got.select(*KEYS, "core", F.array_join(F.col("lanes").cast("array<string>"), ",").alias("lanes"), "rings", *r6("cx", "cy"), "arms")


@query(f"""
WITH RECURSIVE $TRACKS, {SCENARIOS_SQL}, {RING_SQL}, {ROUNDABOUT_SQL}
SELECT scene, part, 'roundabout' AS kind, lanes, arms, gates, round(0.88 + CASE WHEN arms IN (3, 4) THEN 0.05 ELSE 0.0 END, 6) AS confidence FROM rb
""")
def junctions(spark, sf):
    """Assembled junctions of the roundabouts of a scenario: cores, gates, arms; a scenario's rings share a centre, so no two cores overlap."""
    lanes, links = ring_map(ring_lanes(scenarios(spark, sf)))
    groups = crossings.roundabouts(lanes, links, KEYS).select(*KEYS, F.lit("roundabout").alias("kind"), "lanes")
    got = crossings.junctions(crossings.junction_cores(groups, lanes, KEYS), lanes, links, KEYS)
    total = F.aggregate("arms", F.lit(0).cast("long"), lambda n, a: n + a["gates"])
    return got.select(*KEYS, "kind", F.array_join(F.col("lanes").cast("array<string>"), ",").alias("lanes"), F.size("arms").cast("long").alias("arms"), total.alias("gates"), *r6("confidence"))


@query(f"""
WITH $TRACKS, {SCENARIOS_SQL},
lp AS (SELECT scene, part, lane, row_number() OVER w - 1 AS segment, x AS x0, y AS y0, (event_id % 7) * 0.1 AS z0, lead(x) OVER w - x AS ux, lead(y) OVER w - y AS uy, lead((event_id % 7) * 0.1) OVER w - (event_id % 7) * 0.1 AS uz FROM k WINDOW w AS (PARTITION BY scene, part, lane ORDER BY event_id)),
ch AS MATERIALIZED (SELECT *, lag(ux) OVER w AS px, lag(uy) OVER w AS py, lead(ux) OVER w AS nx, lead(uy) OVER w AS ny FROM lp WHERE ux IS NOT NULL WINDOW w AS (PARTITION BY scene, part, lane ORDER BY segment)),
bc AS MATERIALIZED (SELECT scene, part, track_id, frame, x + i * 2.4 * cos(heading) - j * 1.0 * sin(heading) AS x, y + i * 2.4 * sin(heading) + j * 1.0 * cos(heading) AS y, i, j FROM k, (VALUES (1, 1), (-1, 1), (-1, -1), (1, -1)) c(i, j) WHERE valid),
pr AS (SELECT bc.*, ch.* EXCLUDE (scene, part), x - x0 AS dx, y - y0 AS dy, 0.0 - z0 AS dz, ((x - x0) * ux + (y - y0) * uy) / greatest(ux * ux + uy * uy, 1e-10) AS t FROM bc JOIN ch ON bc.scene = ch.scene AND bc.part = ch.part),
pf AS (SELECT *, greatest(0.0, least(1.0, t)) AS f FROM pr),
pd AS (SELECT *, sqrt((dx - f * ux) ** 2 + (dy - f * uy) ** 2) AS flat, 3.0 * (dz - f * uz) AS up FROM pf),
ne AS (SELECT * FROM pd QUALIFY row_number() OVER (PARTITION BY scene, part, track_id, frame, i, j ORDER BY sqrt(flat * flat + up * up), lane, segment) = 1),
si AS (SELECT *, sign(dx * uy - dy * ux) AS n, sign((dx + px) * py - (dy + py) * px) AS nb, sign((dx - ux) * ny - (dy - uy) * nx) AS na FROM ne),
sg AS (SELECT *, flat * CASE WHEN t < 0 AND px IS NOT NULL THEN CASE WHEN px * uy - py * ux > 0 THEN greatest(n, nb) ELSE least(n, nb) END WHEN t > 1 AND nx IS NOT NULL THEN CASE WHEN ux * ny - uy * nx > 0 THEN greatest(n, na) ELSE least(n, na) END ELSE n END AS d FROM si)
SELECT scene, part, track_id, frame, round(max(d), 5) AS distance FROM sg GROUP BY ALL
""")
def road_edge_sides(spark, sf):
    """Signed distance to the road edges of the corner of each valid box that is farthest off the road."""
    k = scenarios(spark, sf)
    lines = k.groupBy(*KEYS, "lane").agg(F.array_sort(F.collect_list(F.struct("event_id", "x", "y", ((F.col("event_id") % 7) * 0.1).alias("z")))).alias("points"))
    boxes = k.where("valid").select(*KEYS, "track_id", "frame", "x", "y", F.lit(0.75).alias("z"), F.lit(4.8).alias("length"), F.lit(2.0).alias("width"), F.lit(1.5).alias("height"), "heading")
    got = roadedge.road_edge_distances(boxes, roadedge.edge_chain(lines, KEYS, "lane", "points"), KEYS, ["track_id", "frame"], "lane")
    return got.select(*KEYS, "track_id", "frame", F.round("distance", 5).alias("distance"))


@query(f"""
WITH RECURSIVE $TRACKS, {SCENARIOS_SQL},
o AS (SELECT scene, part, track_id, frame, x, y, frame % 91 * 0.1 AS t, row_number() OVER (PARTITION BY scene, part, track_id ORDER BY frame) AS i FROM k WHERE valid),
kd AS (SELECT scene, part, track_id, arg_min(kind, frame) AS kind FROM k GROUP BY 1, 2, 3),
st AS (SELECT *, sqrt((x - lag(x) OVER w) ** 2 + (y - lag(y) OVER w) ** 2) AS step, t - lag(t) OVER w AS gap FROM o WINDOW w AS (PARTITION BY scene, part, track_id ORDER BY i)),
lm AS MATERIALIZED (SELECT scene, part, track_id, count(*) AS n, CASE kind WHEN 2 THEN 15.0 WHEN 3 THEN 35.0 ELSE 70.0 END AS top, greatest(CASE kind WHEN 2 THEN 5.0 WHEN 3 THEN 10.0 ELSE 15.0 END, 4 * quantile_cont(step / gap, 0.5)) AS lim FROM st JOIN kd USING (scene, part, track_id) GROUP BY scene, part, track_id, kind),
js AS (SELECT scene, part, track_id FROM st JOIN lm USING (scene, part, track_id) GROUP BY 1, 2, 3 HAVING max(n) >= 3 AND bool_or(NOT (step <= 1 + top * gap AND (step <= 1 OR step / gap <= lim)))),
ls AS MATERIALIZED (SELECT scene, part, track_id, list(x ORDER BY i) AS xs, list(y ORDER BY i) AS ys, list(t ORDER BY i) AS ts, any_value(n) AS n, any_value(top) AS top, any_value(lim) AS lim FROM o JOIN lm USING (scene, part, track_id) WHERE (scene, part, track_id) IN (SELECT (scene, part, track_id) FROM js) GROUP BY 1, 2, 3),
r AS (
  SELECT scene, part, track_id, CAST(1 AS BIGINT) AS i, [CAST(1 AS BIGINT)] AS len, [CAST(0 AS DOUBLE)] AS dur, [CAST(0 AS BIGINT)] AS prev FROM ls
  UNION ALL
  SELECT scene, part, track_id, i, list_append(len, coalesce(b.len, 1)), list_append(dur, coalesce(b.dur, 0.0)), list_append(prev, coalesce(-b.j, 0)) FROM (
    SELECT r.scene, r.part, r.track_id, r.i + 1 AS i, len, dur, prev, list_max(list_transform(list_filter(range(greatest(1, r.i - 8), r.i + 1), lambda j:
      sqrt((xs[r.i + 1] - xs[j]) ** 2 + (ys[r.i + 1] - ys[j]) ** 2) <= 1 + top * (ts[r.i + 1] - ts[j]) AND (sqrt((xs[r.i + 1] - xs[j]) ** 2 + (ys[r.i + 1] - ys[j]) ** 2) <= 1 OR sqrt((xs[r.i + 1] - xs[j]) ** 2 + (ys[r.i + 1] - ys[j]) ** 2) / (ts[r.i + 1] - ts[j]) <= lim)),
      lambda j: {{'len': len[j] + 1, 'dur': round(dur[j] + (ts[r.i + 1] - ts[j]), 9), 'j': -j}})) AS b
    FROM r JOIN ls ON r.scene = ls.scene AND r.part = ls.part AND r.track_id = ls.track_id AND r.i < ls.n)),
e AS (SELECT r.*, list_max(list_transform(range(1, n + 1), lambda j: {{'len': len[j], 'dur': dur[j], 'j': j}})).j AS last FROM r JOIN ls ON r.scene = ls.scene AND r.part = ls.part AND r.track_id = ls.track_id AND r.i = ls.n),
b AS (SELECT scene, part, track_id, last AS pos, prev FROM e UNION ALL SELECT scene, part, track_id, prev[pos], prev FROM b WHERE prev[pos] > 0)
SELECT k.scene, k.part, k.track_id, k.frame, k.valid AND ((k.scene, k.part, k.track_id) NOT IN (SELECT (scene, part, track_id) FROM js) OR b.pos IS NOT NULL) AS kept
FROM k LEFT JOIN o ON k.scene = o.scene AND k.part = o.part AND k.track_id = o.track_id AND k.frame = o.frame LEFT JOIN b ON o.scene = b.scene AND o.part = b.part AND o.track_id = b.track_id AND o.i = b.pos
""")
def consistent_paths(spark, sf):
    """Which states lie on the longest path of their track without a jump."""
    k = scenarios(spark, sf).withColumn("t", (F.col("frame") % FRAMES) * 0.1)
    return paths.path_members(k, KEYS, "track_id", "frame")


@query()
def body_headings(spark, sf):
    """Body headings along or against the motion, a least-cost path of two states; tests compare it with exhaustive search."""
    k = scenarios(spark, sf).withColumns({"t": (F.col("frame") % FRAMES) * 0.1, "one": F.lit(1)})
    return paths.body_headings(k, KEYS, "track_id", "frame", kind="one").select(*KEYS, "track_id", "frame", *r6("body"))


@query(f"""
WITH RECURSIVE $TRACKS, {SCENARIOS_SQL}, {RING_SQL},
ln AS (SELECT rp.scene, rp.part, rp.lane, i, x, y, rn.n FROM rp JOIN rn ON rp.scene = rn.scene AND rp.part = rn.part AND rn.lane = rp.lane % 100 UNION ALL SELECT scene, part, 300 + lane, row_number() OVER (PARTITION BY scene, part, lane ORDER BY event_id) - 1, x / 20, y / 5, 3 FROM k),
mn AS (SELECT * FROM ln QUALIFY count(*) OVER (PARTITION BY scene, part, lane) > 2),
ds AS (SELECT *, coalesce(sqrt((x - lag(x) OVER w) ** 2 + (y - lag(y) OVER w) ** 2), 0.0) AS d FROM mn WINDOW w AS (PARTITION BY scene, part, lane ORDER BY i)),
rr AS (SELECT *, sum(CASE WHEN d > 3 THEN 1 ELSE 0 END) OVER (PARTITION BY scene, part, lane ORDER BY i) AS run FROM ds),
ws AS (SELECT *, sum(CASE WHEN first THEN 0.0 ELSE d END) OVER (PARTITION BY scene, part, lane, run ORDER BY i) AS s FROM (SELECT *, row_number() OVER (PARTITION BY scene, part, lane, run ORDER BY i) = 1 AS first FROM rr)),
nx AS MATERIALIZED (SELECT *, lead(x) OVER w AS x1, lead(y) OVER w AS y1, lead(s) OVER w AS s1, CAST(ceil(max(s) OVER (PARTITION BY scene, part, lane, run) / 0.5) AS BIGINT) + 1 AS m FROM ws WINDOW w AS (PARTITION BY scene, part, lane, run ORDER BY i)),
sa AS MATERIALIZED (
  SELECT scene, part, lane, run, m, j, x + (j * 0.5 - s) / (s1 - s) * (x1 - x) AS x, y + (j * 0.5 - s) / (s1 - s) * (y1 - y) AS y FROM (SELECT *, unnest(range(CAST(ceil(s / 0.5) AS BIGINT), least(CAST(ceil(s1 / 0.5) AS BIGINT), m - 1))) AS j FROM nx WHERE s1 IS NOT NULL)
  UNION ALL SELECT scene, part, lane, run, m, m - 1, x, y FROM nx WHERE s1 IS NULL AND m > 1),
pc AS (SELECT DISTINCT scene, part, lane, run, m, CASE WHEN m >= 11 THEN (m - 11) // 10 + 1 ELSE 0 END AS w, CASE WHEN m >= 11 THEN (m - 11) % 10 ELSE m END AS rest FROM sa),
tk AS (SELECT scene, part, lane, run, q AS piece, 10 * q AS a, 10 * q + 5 AS b, 10 * q + 10 AS c FROM (SELECT *, unnest(range(0, w)) AS q FROM pc) UNION ALL SELECT scene, part, lane, run, w, 10 * w, 10 * w + (m - 10 * w - 1) // 2, m - 1 FROM pc WHERE rest >= 3),
tt AS (SELECT tk.scene, tk.part, tk.lane, row_number() OVER (PARTITION BY tk.scene, tk.part, tk.lane ORDER BY tk.run, piece) - 1 AS token, sa.x AS xa, sa.y AS ya, sb.x AS xb, sb.y AS yb, sc.x AS xc, sc.y AS yc, atan2(sh.y - sa.y, sh.x - sa.x) AS heading FROM tk
  JOIN sa ON (sa.scene, sa.part, sa.lane, sa.run, sa.j) = (tk.scene, tk.part, tk.lane, tk.run, tk.a) JOIN sa sb ON (sb.scene, sb.part, sb.lane, sb.run, sb.j) = (tk.scene, tk.part, tk.lane, tk.run, tk.b)
  JOIN sa sc ON (sc.scene, sc.part, sc.lane, sc.run, sc.j) = (tk.scene, tk.part, tk.lane, tk.run, tk.c) JOIN sa sh ON (sh.scene, sh.part, sh.lane, sh.run, sh.j) = (tk.scene, tk.part, tk.lane, tk.run, tk.a + 1)),
lt AS (SELECT scene, part, lane, any_value(n % 4) AS light FROM mn GROUP BY 1, 2, 3)
SELECT scene, part, lane, CAST(token AS INTEGER) AS token, round(xa, 5) AS xa, round(ya, 5) AS ya, round(xb, 5) AS xb, round(yb, 5) AS yb, round(xc, 5) AS xc, round(yc, 5) AS yc, round(cos(heading), 4) AS c, round(sin(heading), 4) AS s, light FROM tt JOIN lt USING (scene, part, lane)
""")
def map_tokens(spark, sf):
    """Three-point tokens of the ring map and of lines through the states, with the light of their lane."""
    k = scenarios(spark, sf)
    arcs = ring_lanes(k)
    lanes = ring_map(arcs)[0].select(*KEYS, "lane", F.posexplode("points").alias("i", "p")).withColumn("of", F.col("lane") % 100)
    lit = lanes.join(arcs.select(*KEYS, F.col("lane").alias("of"), "n"), [*KEYS, "of"]).select(*KEYS, "lane", F.col("i").cast("long").alias("i"), "p.x", "p.y", (F.col("n") % 4).alias("light"))
    through = k.select(*KEYS, (F.col("lane") + 300).alias("lane"), (F.row_number().over(Window.partitionBy(*KEYS, "lane").orderBy("event_id")) - 1).cast("long").alias("i"), (F.col("x") / 20).alias("x"), (F.col("y") / 5).alias("y"), F.lit(3).cast("long").alias("light"))
    got = polylines.map_tokens(lit.unionByName(through), k, KEYS, "lane", "i", ["light"])
    p = lambda i, c: F.round(F.col("points")[i][c], 5).alias(f"{c}{'abc'[i]}")
    return got.select(*KEYS, "lane", "token", *[p(i, c) for i in range(3) for c in "xy"], F.round(F.cos("heading"), 4).alias("c"), F.round(F.sin("heading"), 4).alias("s"), "light")


@query(f"""
WITH RECURSIVE $TRACKS, {SCENARIOS_SQL},
kd AS (SELECT scene, track_id, arg_min(kind, frame) AS kind FROM k GROUP BY 1, 2),
c AS MATERIALIZED (SELECT k.scene, k.track_id, kd.kind, x, y, heading, frame // 5 AS i, max(frame // 5) OVER (PARTITION BY k.scene, k.track_id) AS n FROM k JOIN kd USING (scene, track_id) WHERE frame % 5 = 0),
h AS MATERIALIZED (SELECT a.*, 6 * (z.x - 2 * a.x + b.x) AS rx, 6 * (z.y - 2 * a.y + b.y) AS ry FROM c a JOIN c b ON a.scene = b.scene AND a.track_id = b.track_id AND b.i = a.i - 1 JOIN c z ON a.scene = z.scene AND a.track_id = z.track_id AND z.i = a.i + 1),
f AS (
  SELECT scene, track_id, i, n, CAST(0.25 AS DOUBLE) AS w, rx * 0.25 AS dx, ry * 0.25 AS dy FROM h WHERE i = 1
  UNION ALL SELECT f.scene, f.track_id, h.i, h.n, 1 / (4 - w), (rx - dx) / (4 - w), (ry - dy) / (4 - w) FROM f JOIN h ON f.scene = h.scene AND f.track_id = h.track_id AND h.i = f.i + 1),
b AS (
  SELECT scene, track_id, i, dx AS mx, dy AS my FROM f WHERE i = n - 1
  UNION ALL SELECT f.scene, f.track_id, f.i, f.dx - f.w * mx, f.dy - f.w * my FROM b JOIN f ON f.scene = b.scene AND f.track_id = b.track_id AND f.i = b.i - 1),
s AS (SELECT p.scene, p.track_id, p.kind, p.i, p.x AS x0, q.x AS x1, p.y AS y0, q.y AS y1, coalesce(u.mx, 0.0) AS u0, coalesce(v.mx, 0.0) AS u1, coalesce(u.my, 0.0) AS v0, coalesce(v.my, 0.0) AS v1, unnest([1, 2, 3, 4, 5]) AS j
  FROM c p JOIN c q ON p.scene = q.scene AND p.track_id = q.track_id AND q.i = p.i + 1 LEFT JOIN b u ON u.scene = p.scene AND u.track_id = p.track_id AND u.i = p.i LEFT JOIN b v ON v.scene = p.scene AND v.track_id = p.track_id AND v.i = p.i + 1),
o AS (SELECT scene, track_id, 5 * i + j AS frame, kind, j / 5.0 AS t, x0, x1, y0, y1, u0, u1, v0, v1 FROM s)
SELECT o.scene, o.track_id, o.frame, round(CASE kind WHEN 1 THEN u0 * (1 - t) ** 3 / 6 + u1 * t ** 3 / 6 + (x0 - u0 / 6) * (1 - t) + (x1 - u1 / 6) * t WHEN 2 THEN x0 * (1 - t) + x1 * t ELSE z.x END, 5) AS x,
  round(CASE kind WHEN 1 THEN v0 * (1 - t) ** 3 / 6 + v1 * t ** 3 / 6 + (y0 - v0 / 6) * (1 - t) + (y1 - v1 / 6) * t WHEN 2 THEN y0 * (1 - t) + y1 * t ELSE z.y END, 5) AS y
FROM o JOIN (SELECT scene, track_id, x, y FROM c WHERE i = 0) z ON o.scene = z.scene AND o.track_id = z.track_id
""")
def interpolated_frames(spark, sf):
    """Every frame between each fifth state of a track, by a method that its kind chooses."""
    k = scenarios(spark, sf)
    kind = F.min_by("kind", "frame").over(Window.partitionBy("scene", "track_id").orderBy("frame").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    method = F.when(F.col("first") == 1, "cubic").when(F.col("first") == 2, "linear").otherwise("static")
    controls = k.withColumn("first", kind).where(F.col("frame") % 5 == 0).withColumn("method", method)
    return splines.interpolate(controls, ["scene"], "track_id", "frame").select("scene", "track_id", "frame", F.round("x", 5).alias("x"), F.round("y", 5).alias("y"))
