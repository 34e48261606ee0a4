"""Junctions of lane maps: rings of lanes, cores that are kept and merged, gates, arms.

All of this is inside one scenario, whose map is of bounded size; scenarios are dealt to tasks.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry
from ..sources.store import written
from .graph import circular_clusters, components
from .mapmatch import lane_segments

# What makes a ring of lanes (metres, ratios, radians), and how near to the 1st gate another is its copy.
RING_SPAN, RING_LANES, RING_ASPECT, RING_INNER, RING_RADII = 8.0, 64, 0.65, 3.0, 1.5
RING_ALIGNMENT, RING_ALIGNMENT_P90, RING_GAP = 0.25, 0.6, math.radians(45.0)
GATE_COPY = 1.0
# Junction kinds in order of precedence, share of lanes that makes a copy, share of area that merges, arms, width.
KINDS = ["signalized", "stop_controlled", "roundabout", "geometric"]
COPY_SHARE, MERGE_SHARE, ARM_ANGLE, ARMS, HALF_WIDTH, HEADING_POINTS = 0.8, 0.15, math.radians(30.0), (3, 8), 2.0, 50


def strong_components(edges: DataFrame, keys: list[str], src: str = "src", dst: str = "dst") -> DataFrame:
    """keys, component (its smallest node), node: directed components of several nodes, or of one with an edge to itself."""
    kinds = {f.name: f.dataType.simpleString() for f in edges.schema}

    def run(part: pd.DataFrame) -> pd.DataFrame:
        ahead: dict = {}
        for a, b in zip(part[src], part[dst], strict=True):
            ahead.setdefault(a, set()).add(b)
            ahead.setdefault(b, set())
        number: dict = {}
        low: dict = {}
        path: list = []
        on_path: set = set()
        found: list[tuple] = []
        for root in sorted(ahead):
            if root in number:
                continue
            calls = [(root, iter(ahead[root]))]
            number[root] = low[root] = len(number)
            path.append(root)
            on_path.add(root)
            while calls:
                node, rest = calls[-1]
                for other in rest:
                    if other not in number:
                        number[other] = low[other] = len(number)
                        path.append(other)
                        on_path.add(other)
                        calls.append((other, iter(ahead[other])))
                        break
                    if other in on_path:
                        low[node] = min(low[node], number[other])
                else:
                    calls.pop()
                    if calls:
                        low[calls[-1][0]] = min(low[calls[-1][0]], low[node])
                    if low[node] == number[node]:
                        own = path[path.index(node) :]
                        del path[-len(own) :]
                        on_path.difference_update(own)
                        if len(own) > 1 or node in ahead[node]:
                            found += [(*(part[k].iloc[0] for k in keys), min(own), n) for n in own]
        return pd.DataFrame(found, columns=[*keys, "component", "node"])

    schema = ", ".join(f"`{k}` {kinds[k]}" for k in keys) + f", component {kinds[src]}, node {kinds[src]}"
    return edges.select(*keys, src, dst).where(F.col(src).isNotNull() & F.col(dst).isNotNull()).groupBy(*keys).applyInPandas(run, schema)


def rings(members: DataFrame, segments: DataFrame, keys: list[str]) -> DataFrame:
    """keys, component, cx, cy, radius (the median): the components whose lanes form a ring.

    members: keys, component, lane. segments: of lane_segments(). A ring has at most RING_LANES lanes, a round box, about equal
    radii, lanes that run around the centre rather than from or to it, and no wide gap between the directions of its points.
    """
    group = [*keys, "component"]
    own = written(members.join(segments, [*keys, "lane"]), "ring_segments").withColumn("last", F.row_number().over(Window.partitionBy(*keys, "component", "lane").orderBy(F.desc("segment"))) == 1)
    ends = F.when(F.col("last"), F.array(F.struct(F.col("x0").alias("x"), F.col("y0").alias("y")), F.struct((F.col("x0") + F.col("ux")).alias("x"), (F.col("y0") + F.col("uy")).alias("y")))).otherwise(F.array(F.struct(F.col("x0").alias("x"), F.col("y0").alias("y"))))
    points = own.select(*group, F.explode(ends).alias("p")).select(*group, "p.x", "p.y")
    box = points.groupBy(*group).agg(*[f(c).alias(f"{c}{n}") for n, f in (("l", F.min), ("h", F.max)) for c in "xy"])
    wide, high = F.col("xh") - F.col("xl"), F.col("yh") - F.col("yl")
    round_ = (F.least(wide, high) >= RING_SPAN) & (F.least(wide, high) >= RING_ASPECT * F.greatest(wide, high))
    sizes = members.groupBy(*group).agg(F.count_distinct("lane").alias("lanes"))
    centres = box.where(round_).join(sizes.where(F.col("lanes") <= RING_LANES), group).select(*group, ((F.col("xl") + F.col("xh")) / 2).alias("cx"), ((F.col("yl") + F.col("yh")) / 2).alias("cy"))
    spokes = points.join(centres, group).withColumns({"r": F.hypot(F.col("x") - F.col("cx"), F.col("y") - F.col("cy")), "angle": F.pmod(F.atan2(F.col("y") - F.col("cy"), F.col("x") - F.col("cx")), F.lit(2 * math.pi))})
    turn = Window.partitionBy(*group).orderBy("angle")
    gap = F.coalesce(F.lead("angle").over(turn), F.min("angle").over(Window.partitionBy(*group)) + 2 * math.pi) - F.col("angle")
    radii = spokes.withColumn("gap", gap).groupBy(*group, "cx", "cy").agg(F.percentile("r", F.array(F.lit(0.1), F.lit(0.5), F.lit(0.9))).alias("r"), F.max("gap").alias("gap"))
    mx, my = F.col("x0") + F.col("ux") / 2 - F.col("cx"), F.col("y0") + F.col("uy") / 2 - F.col("cy")
    away = F.hypot(mx, my)
    along = own.join(centres, group).where((F.col("length") > 1e-6) & (away > 1e-6)).groupBy(*group).agg(F.percentile(F.abs((F.col("ux") * mx + F.col("uy") * my) / (F.col("length") * away)), F.array(F.lit(0.5), F.lit(0.9))).alias("a"))
    fine = (F.col("r")[0] >= RING_INNER) & (F.col("r")[2] <= RING_RADII * F.col("r")[0]) & (F.col("gap") <= RING_GAP) & (F.col("a")[0] <= RING_ALIGNMENT) & (F.col("a")[1] <= RING_ALIGNMENT_P90)
    return radii.join(along, group).where(fine).select(*group, "cx", "cy", F.col("r")[1].alias("radius"))


def concentric(found: DataFrame, keys: list[str]) -> DataFrame:
    """keys, component, core: rings (of rings()) about one centre share the smallest component as core."""
    a = found.select(F.struct(*keys).alias("_key"), F.col("component").alias("src"), F.col("cx").alias("ax"), F.col("cy").alias("ay"), F.col("radius").alias("ar"))
    b = a.toDF("_key", "dst", "bx", "by", "br")
    near = F.hypot(F.col("ax") - F.col("bx"), F.col("ay") - F.col("by")) <= F.greatest(F.lit(RING_SPAN), 0.25 * F.least("ar", "br"))
    pairs = a.join(b, "_key").where((F.col("src") <= F.col("dst")) & near)
    flat = pairs.select(F.to_json("_key").alias("key"), "_key", "src", "dst")
    named = components(flat, "key")
    return named.join(flat.select("key", "_key").distinct(), "key").select(*[F.col(f"_key.{k}").alias(k) for k in keys], F.col("node").alias("component"), F.col("component").alias("core"))


def gates(cores: DataFrame, lanes: DataFrame, links: DataFrame, centres: DataFrame, keys: list[str], radial: Column) -> DataFrame:
    """keys, core, lane, incoming, x, y, angle, outer, length: lanes that lead into a core (their last point) or out of it (their first).

    cores: keys, core, lane. lanes: keys, lane, points. links: keys, src, dst (exits). centres: keys, core, cx, cy and what radial
    needs. The angle is that of the gate seen from the centre where radial holds, else that of the way out along the lane;
    outer is that of the lane's other end seen from the centre.
    """
    into = links.select(*keys, F.col("src").alias("lane"), F.col("dst").alias("at"), F.lit(True).alias("incoming"))
    out = links.select(*keys, F.col("dst").alias("lane"), F.col("src").alias("at"), F.lit(False).alias("incoming"))
    beside = into.unionByName(out).join(cores.withColumnRenamed("lane", "at"), [*keys, "at"]).select(*keys, "core", "lane", "incoming").distinct()
    outside = beside.join(cores, [*keys, "core", "lane"], "left_anti").join(lanes.where(F.size("points") > 0), [*keys, "lane"]).join(centres, [*keys, "core"])
    n = F.size("points")
    gate = F.when(F.col("incoming"), F.element_at("points", -1)).otherwise(F.element_at("points", 1))
    far = F.when(F.col("incoming"), F.element_at("points", n - F.least(n, F.lit(HEADING_POINTS)) + 1)).otherwise(F.element_at("points", F.least(n, F.lit(HEADING_POINTS))))
    angle = F.when(radial, F.atan2(gate["y"] - F.col("cy"), gate["x"] - F.col("cx"))).otherwise(F.atan2(far["y"] - gate["y"], far["x"] - gate["x"]))
    end = F.when(F.col("incoming"), F.element_at("points", 1)).otherwise(F.element_at("points", -1))
    outer = F.pmod(F.atan2(end["y"] - F.col("cy"), end["x"] - F.col("cx")), F.lit(2 * math.pi))
    length = F.aggregate(F.sequence(F.lit(2), n), F.lit(0.0), lambda s, i: s + F.hypot(F.element_at("points", i)["x"] - F.element_at("points", i - 1)["x"], F.element_at("points", i)["y"] - F.element_at("points", i - 1)["y"]))
    return outside.select(*keys, "core", "cx", "cy", "lane", "incoming", gate["x"].alias("x"), gate["y"].alias("y"), F.pmod(angle, F.lit(2 * math.pi)).alias("angle"), outer.alias("outer"), F.when(n > 1, length).otherwise(F.lit(0.0)).alias("length"))


def clusters(angles: np.ndarray, threshold: float) -> list[np.ndarray]:
    """Places of the angles by cluster: cut at the widest gap of the circle and at each gap above threshold."""
    order = np.argsort(angles, kind="stable")
    a = angles[order]
    gaps = (np.roll(a, -1) - a) % (2 * math.pi) if len(a) > 1 else np.array([2 * math.pi])
    first = (len(a) - 1 - int(np.argmax(gaps[::-1])) + 1) % len(a)  # of equal gaps, the last
    turned = np.roll(order, -first)
    cuts = np.flatnonzero(np.roll(gaps, -first)[:-1] > threshold) + 1
    return np.split(turned, cuts)


def one_gate_per_place(x: np.ndarray, y: np.ndarray, length: np.ndarray, lane: np.ndarray) -> list[int]:
    """Of gates (in lane order) within GATE_COPY of the mean of those before at a place, the one of the longest lane, then the smallest."""
    places: list[list[int]] = []
    for i in np.argsort(lane, kind="stable"):
        near = next((p for p in places if math.hypot(x[i] - x[p].mean(), y[i] - y[p].mean()) <= GATE_COPY), None)
        if near is None:
            places.append([int(i)])
        else:
            near.append(int(i))
    return [min(p, key=lambda i: (-length[i], lane[i])) for p in places]


def arms(found: DataFrame, keys: list[str], threshold: float = ARM_ANGLE, half_width: float = HALF_WIDTH) -> DataFrame:
    """keys, core, arm (by angle), angle, incoming, outgoing (lanes), gates, stop (ends of the stop line: x1, y1, x2, y2, or null)."""
    kinds = {f.name: f.dataType.simpleString() for f in found.schema}

    def run(part: pd.DataFrame) -> pd.DataFrame:
        x, y, angle, lane, length = (part[c].to_numpy() for c in ("x", "y", "angle", "lane", "length"))
        incoming = part["incoming"].to_numpy(bool)
        mean = lambda a: math.atan2(np.sin(a).sum(), np.cos(a).sum()) % (2 * math.pi)
        out = []
        for k, (turn, own) in enumerate(sorted(((mean(angle[c]), c) for c in clusters(angle, threshold)), key=lambda z: z[0])):
            chosen = [own[z][i] for z in (incoming[own], ~incoming[own]) for i in one_gate_per_place(x[own][z], y[own][z], length[own][z], lane[own][z])]
            enter = [i for i in chosen if incoming[i]]
            stop = None
            if enter:
                centre = np.array([x[enter].mean(), y[enter].mean()])
                spoke = centre - part[["cx", "cy"]].iloc[0].to_numpy(float)
                if (norm := float(np.hypot(*spoke))) > 1e-6:
                    tangent = np.array([-spoke[1], spoke[0]]) / norm
                    on = (np.stack([x[enter], y[enter]], axis=1) - centre) @ tangent
                    stop = [*(centre + (on.min() - half_width) * tangent), *(centre + (on.max() + half_width) * tangent)]
            out.append((*(part[c].iloc[0] for c in (*keys, "core")), k, turn, sorted(lane[enter].tolist()), sorted(lane[i] for i in chosen if not incoming[i]), len(chosen), stop))
        return pd.DataFrame(out, columns=[*keys, "core", "arm", "angle", "incoming", "outgoing", "gates", "stop"])

    schema = ", ".join(f"`{k}` {kinds[k]}" for k in (*keys, "core")) + f", arm int, angle double, incoming array<{kinds['lane']}>, outgoing array<{kinds['lane']}>, gates int, stop array<double>"
    return found.groupBy(*keys, "core").applyInPandas(run, schema)


def roundabouts(lanes: DataFrame, links: DataFrame, keys: list[str], n_arms: tuple[int, int] = ARMS, threshold: float = ARM_ANGLE) -> DataFrame:
    """keys, core (its smallest lane), lanes, rings, cx, cy, arms, corridors: rings of lanes with ways in and out.

    Rings about one centre are one roundabout. It has a permitted number of arms, and if it has one ring only, lanes that
    come from and go to at least that many directions. lanes: keys, lane, points. links: keys, src, dst (exits).
    """
    known = lanes.select(*keys, "lane").distinct()
    inner = links.join(known.withColumnRenamed("lane", "src"), [*keys, "src"], "left_semi").join(known.withColumnRenamed("lane", "dst"), [*keys, "dst"], "left_semi")
    # Each of these tables is read several times below.
    lanes, inner = written(lanes.select(*keys, "lane", "points"), "lanes"), written(inner.select(*keys, "src", "dst"), "links")
    members = written(strong_components(inner, keys).withColumnRenamed("node", "lane"), "members")
    round_ = written(rings(members, lane_segments(lanes, keys, "lane", "points"), keys), "rings")
    named = written(concentric(round_, keys), "named")
    counts = named.groupBy(*keys, "core").agg(F.count(F.lit(1)).alias("rings"))
    spread = written(members.join(named, [*keys, "component"]).select(*keys, "core", "lane"), "cores")
    points = spread.join(lanes, [*keys, "lane"]).select(*keys, "core", F.explode("points").alias("p"))
    middle = lambda c: ((F.min(f"p.{c}") + F.max(f"p.{c}")) / 2).alias(f"c{c}")
    centres = points.groupBy(*keys, "core").agg(middle("x"), middle("y"))
    found = written(gates(spread, lanes, inner, centres, keys, F.lit(True)), "gates")
    number = lambda angle: circular_clusters(found.select(*keys, "core", "incoming", angle), [*keys, "core"], angle, threshold).groupBy(*keys, "core")
    sides = number("angle").agg((F.max("cluster") + 1).cast("int").alias("arms"), F.count_if("incoming").alias("n_in"), F.count_if(~F.col("incoming")).alias("n_out"))
    corridors = number("outer").agg((F.max("cluster") + 1).cast("int").alias("corridors"))
    got = sides.where((F.col("n_in") > 0) & (F.col("n_out") > 0) & F.col("arms").between(*n_arms)).join(corridors, [*keys, "core"]).join(counts, [*keys, "core"]).join(centres, [*keys, "core"])
    got = got.where((F.col("rings") > 1) | (F.col("corridors") >= n_arms[0]))
    return got.join(spread.groupBy(*keys, "core").agg(F.array_sort(F.collect_set("lane")).alias("lanes")), [*keys, "core"]).select(*keys, "core", "lanes", "rings", "cx", "cy", "arms", "corridors")


def kept_groups(groups: list[tuple[int, frozenset]]) -> list[tuple[int, frozenset]]:
    """(kind number, lanes) in order of kind and smallest lane, without those that repeat one before.

    A group repeats another if they share COPY_SHARE of their union; rings and crossings also if they share that of the smaller.
    """
    kept: list[tuple[int, frozenset]] = []
    for kind, lanes in sorted(groups, key=lambda g: (g[0], min(g[1], default=math.inf))):
        share = lambda other, of: len(lanes & other) / max(1, of)  # noqa: B023, E731
        if kind >= KINDS.index("roundabout") and any(share(o, min(len(lanes), len(o))) >= COPY_SHARE for _, o in kept):
            continue
        if any(share(o, len(lanes | o)) >= COPY_SHARE for _, o in kept):
            continue
        kept.append((kind, lanes))
    return kept


def merged_groups(groups: list[tuple[int, frozenset]], hulls: list[np.ndarray], share: float) -> list[tuple[int, frozenset]]:
    """Groups of one kind whose hulls share that much of the smaller's area become one."""
    name = list(range(len(groups)))
    for i in range(len(groups)):
        for j in range(i + 1, len(groups)):
            if groups[i][0] == groups[j][0] and name[i] != name[j] and geometry.overlap(hulls[i], hulls[j]) >= share:
                old, new = max(name[i], name[j]), min(name[i], name[j])
                name = [new if n == old else n for n in name]
    joined = [(groups[n][0], frozenset().union(*(g for g, m in zip((g[1] for g in groups), name, strict=True) if m == n))) for n in sorted(set(name))]
    return sorted(joined, key=lambda g: (g[0], min(g[1], default=math.inf)))


def junction_cores(groups: DataFrame, lanes: DataFrame, keys: list[str], share: float = MERGE_SHARE, half_width: float = HALF_WIDTH) -> DataFrame:
    """keys, core (number), kind, lanes, cx, cy, area, boundary (x1, y1, x2, ..), crossings: candidate cores, deduplicated and merged.

    groups: keys, kind (of KINDS), lanes (array). lanes: keys, lane, points. The boundary is the convex hull of the core's lanes at
    their width, the centre the mean of its corners; crossings tells whether two of its lanes cut each other.
    """
    kinds = {f.name: f.dataType.simpleString() for f in lanes.schema}

    def run(asked: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        lines = {lane: np.array([(p["x"], p["y"]) for p in points], float).reshape(-1, 2) for lane, points in zip(known["lane"], known["points"], strict=True)}
        outline = lambda g: geometry.convex_hull(np.concatenate([np.zeros((0, 2)), *(geometry.widened(lines[n], half_width) for n in sorted(g) if len(lines[n]) > 1)]))
        whole = [(KINDS.index(kind), frozenset(n for n in own if n in lines)) for kind, own in zip(asked["kind"], asked["lanes"], strict=True)]
        kept = kept_groups([g for g in whole if g[1]])
        out = []
        for k, (kind, own) in enumerate(merged_groups(kept, [outline(g) for _, g in kept], share)):
            hull = outline(own)
            centre = hull.mean(axis=0) if len(hull) else np.zeros(2)
            cut = [lines[n] for n in sorted(own) if len(lines[n]) > 1]
            crossings = any(geometry.crossing(a, b) for i, a in enumerate(cut) for b in cut[i + 1 :])
            out.append((*(asked[c].iloc[0] for c in keys), k, KINDS[kind], sorted(own), *centre, abs(geometry.area(hull)), hull.ravel().tolist(), crossings))
        return pd.DataFrame(out, columns=[*keys, "core", "kind", "lanes", "cx", "cy", "area", "boundary", "crossings"])

    schema = ", ".join(f"`{k}` {kinds[k]}" for k in keys) + f", core int, kind string, lanes array<{kinds['lane']}>, cx double, cy double, area double, boundary array<double>, crossings boolean"
    return groups.select(*keys, "kind", "lanes").groupBy(*keys).cogroup(lanes.select(*keys, "lane", "points").groupBy(*keys)).applyInPandas(run, schema)


def junctions(cores: DataFrame, lanes: DataFrame, links: DataFrame, keys: list[str], n_arms: tuple[int, int] = ARMS) -> DataFrame:
    """cores (of junction_cores) with arms (array, by angle) and confidence: those with a permitted number of arms.

    Rings and crossings see their gates from the centre. A crossing needs three lanes of which two cut each other, and
    ways in and out on all arms but one (two arms at least); its arms are then those of the lanes' headings, where their number is permitted.
    """
    cores, lanes, links = (written(t, n) for t, n in ((cores, "cores"), (lanes.select(*keys, "lane", "points"), "lanes"), (links.select(*keys, "src", "dst"), "links")))
    spread = cores.select(*keys, "core", F.explode("lanes").alias("lane"))
    centres = cores.select(*keys, "core", "cx", "cy", "kind")

    def armed(radial: Column) -> DataFrame:
        rows = arms(gates(spread, lanes, links, centres, keys, radial), keys)
        both = F.count_if((F.size("incoming") > 0) & (F.size("outgoing") > 0))
        arm = F.struct("arm", "angle", "incoming", "outgoing", "gates", "stop")
        return rows.groupBy(*keys, "core").agg(F.array_sort(F.collect_list(arm)).alias("arms"), both.alias("both"))

    allowed = F.size("arms").between(*n_arms)
    first = cores.join(armed(F.col("kind").isin("roundabout", "geometric")).where(allowed), [*keys, "core"])
    crossing = F.col("crossings") & (F.size("lanes") >= 3) & (F.col("both") >= F.greatest(F.lit(2), F.size("arms") - 1))
    first = first.where((F.col("kind") != "geometric") | crossing)
    headed = armed(F.lit(False)).where(allowed).select(*keys, "core", F.col("arms").alias("headed"))
    got = first.withColumn("checked", F.size("arms")).join(headed, [*keys, "core"], "left")
    got = got.withColumn("arms", F.when((F.col("kind") == "geometric") & F.col("headed").isNotNull(), F.col("headed")).otherwise(F.col("arms")))
    by_kind = F.when(F.col("kind") == "signalized", 0.20).when(F.col("kind") == "stop_controlled", 0.08).when(F.col("kind") == "roundabout", 0.15).otherwise(0.03)
    sure = 0.70 + by_kind + F.when(F.size("boundary") > 0, 0.03).otherwise(0.0) + F.when(F.col("checked").isin(3, 4), 0.05).otherwise(0.0)
    return got.withColumn("confidence", F.least(F.lit(1.0), sure)).drop("headed", "both", "checked")
