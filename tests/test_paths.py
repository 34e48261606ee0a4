"""Signed road-edge distances, consistent paths and body headings against plain versions."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracklode.operators import paths, polylines, roadedge, splines


def rows(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.select(*columns).collect()), key=repr)


def signed(p, lines):
    """By the definition: the nearest segment's side; at its ends, with the neighbour's."""
    best = None
    for e, line in enumerate(lines):
        seg = [(np.array(a, float), np.array(b, float)) for a, b in itertools.pairwise(line)]
        side = lambda k, seg=seg: np.sign((p - seg[k][0])[0] * (seg[k][1] - seg[k][0])[1] - (p - seg[k][0])[1] * (seg[k][1] - seg[k][0])[0])
        left = lambda k, seg=seg: (seg[k][1] - seg[k][0])[0] * (seg[k + 1][1] - seg[k + 1][0])[1] - (seg[k][1] - seg[k][0])[1] * (seg[k + 1][1] - seg[k + 1][0])[0] > 0
        for k, (a, b) in enumerate(seg):
            u = b - a
            t = (p - a)[:2] @ u[:2] / max(u[:2] @ u[:2], 1e-10)
            g = (p - a) - min(1.0, max(0.0, t)) * u
            d = np.linalg.norm(g * [1, 1, 3.0])
            if best is None or d < best[0] - 1e-12:
                s = side(k)
                if t < 0 and k:
                    s = (max if left(k - 1) else min)(s, side(k - 1))
                elif t > 1 and k + 1 < len(seg):
                    s = (max if left(k) else min)(s, side(k + 1))
                best = d, s * np.linalg.norm(g[:2]), e
    return best[1]


def test_signed_edge_distances(spark):
    rng = np.random.default_rng(7)
    # A square road (left of a counter-clockwise edge), an island in it (clockwise), a bridge above, and a far line.
    lines = [[(0, 0, 0), (40, 0, 0), (40, 40, 0), (0, 40, 0), (0, 0, 0)], [(18, 18, 0), (18, 22, 0), (22, 22, 0), (22, 18, 0), (18, 18, 0)], [(10, -50, 6), (10, 90, 6)], [(500, 0, 0), (500, 100, 0), (450, 150, 0)], [(3, 3, 3)]]
    points = [*rng.uniform(-20, 60, (150, 3)) * [1, 1, 0.05], (41, 41, 0), (-1, -1, 0), (17, 17, 0), (23, 23, 0), (39.5, 39.5, 0), (460.0, 130.0, 0), (900.0, 900.0, 0)]
    edges = spark.createDataFrame([(1, e, [{"x": float(x), "y": float(y), "z": float(z)} for x, y, z in line]) for e, line in enumerate(lines)], "scene long, edge long, points array<struct<x:double,y:double,z:double>>")
    asked = spark.createDataFrame([(1, i, *map(float, p)) for i, p in enumerate(points)] + [(2, 0, 0.0, 0.0, 0.0)], "scene long, id long, x double, y double, z double")
    got = roadedge.signed_distances(asked, roadedge.edge_chain(edges, ["scene"], "edge", "points"), ["scene"], ["id"], "edge")
    found = {r.id: r.distance for r in got.where("scene = 1").collect()}
    assert found == pytest.approx({i: signed(np.array(p, float), lines[:4]) for i, p in enumerate(points)}, abs=1e-9)
    n = len(points)
    assert found[n - 7] > 0 and found[n - 6] > 0 and found[n - 5] < 0 and found[n - 4] < 0 and found[n - 3] < 0  # off at outer corners, on beside the island
    assert rows(got.where("scene = 2"), "distance") == [(None,)]
    box = spark.createDataFrame([(1, 0, 20.0, 1.5, 0.5, 4.0, 2.0, 1.0, 0.0), (1, 1, 20.0, 0.5, 0.5, 4.0, 2.0, 1.0, math.pi / 2)], "scene long, id long, x double, y double, z double, length double, width double, height double, heading double")
    of = roadedge.road_edge_distances(box, roadedge.edge_chain(edges, ["scene"], "edge", "points"), ["scene"], ["id"], "edge")
    assert {r.id: round(r.distance, 6) for r in of.collect()} == {0: -0.5, 1: 1.5}


def best_path(t, x, y, top, least):
    step, gap = np.hypot(np.diff(x), np.diff(y)), np.diff(t)
    limit = max(least, 4 * np.median(step / gap))
    ok = lambda i, j: (d := math.hypot(x[i] - x[j], y[i] - y[j])) <= 1 + top * (t[j] - t[i]) and (d <= 1 or d / (t[j] - t[i]) <= limit)
    if all(ok(i, i + 1) for i in range(len(t) - 1)):
        return len(t), None
    return max((len(c), round(t[c[-1]] - t[c[0]], 9)) for n in range(1, len(t) + 1) for c in itertools.combinations(range(len(t)), n) if all(j - i <= 9 and ok(i, j) for i, j in itertools.pairwise(c)))


def test_longest_paths_against_every_subset():
    rng = np.random.default_rng(1)
    for _ in range(60):
        n = int(rng.integers(3, 10))
        t = np.cumsum(rng.choice([0.1, 0.2], n))
        x, y = np.cumsum(rng.normal(scale=0.5, size=(2, n)), axis=1) + rng.choice([0, 0, 0, 60], (1, n))
        kept = paths.longest_path(t, x, y, 70.0, 15.0)
        length, lasts = best_path(t, x, y, 70.0, 15.0)
        at = np.flatnonzero(kept)
        assert len(at) == length and (lasts is None or round(t[at[-1]] - t[at[0]], 9) == lasts)
    assert paths.longest_path(np.zeros(4), np.arange(4) * 99.0, np.zeros(4), 70.0, 15.0).all()


def test_two_way_paths_against_every_choice():
    rng = np.random.default_rng(2)
    for _ in range(40):
        n = int(rng.integers(1, 9))
        along = rng.uniform(-math.pi, math.pi, n)
        ways, cost, gaps = np.stack([along, along + math.pi], axis=1), rng.uniform(0, 2, (n, 2)), rng.uniform(1, 3, max(0, n - 1))
        total = lambda s: sum(cost[i, k] for i, k in enumerate(s)) + sum(25 * float(paths.turned(ways[i + 1, s[i + 1]], ways[i, s[i]])) ** 2 / gaps[i] for i in range(n - 1))
        assert total(paths.two_way_path(ways, cost, gaps)) == pytest.approx(min(map(total, itertools.product((0, 1), repeat=n))))


def test_body_headings_of_ways_forward_back_and_unknown(spark):
    t = np.arange(40) * 0.1
    out = []
    for track, (speed, heading) in {1: (5.0, 0.0), 2: (-3.0, 0.0), 3: (0.1, 1.0), 4: (6.0, None), 5: (5.0, 0.0)}.items():
        for i, s in enumerate(t):
            told = heading if track != 5 or i % 4 != 2 else math.pi  # 5: every fourth heading is turned around
            out.append((1, track, i, float(s), speed * float(s), 0.0, told, True, 1))
    out += [(1, 6, i, float(s), 5.0 * float(s), 0.0, 0.0, True, 2) for i, s in enumerate(t)] + [(1, 7, 0, 0.0, 0.0, 0.0, 0.0, True, 1)]
    df = spark.createDataFrame(out, "scene long, track long, frame long, t double, x double, y double, heading double, valid boolean, kind long")
    got = paths.body_headings(df, ["scene"], "track", "frame")
    by = lambda k: {None if r.body is None else round(abs(r.body), 6) for r in got.where(F.col("track") == k).collect()}
    assert [by(k) for k in range(1, 8)] == [{0.0}, {0.0}, {None}, {0.0}, {0.0}, {None}, {None}]
    assert got.count() == df.count()
    jumps = df.withColumn("x", F.when((F.col("track") == 1) & F.col("frame").between(10, 12), 500.0).otherwise(F.col("x"))).withColumn("valid", F.when(F.col("frame") == 20, None).otherwise(F.col("valid")))
    lost = paths.path_members(jumps, ["scene"], "track", "frame").where(~F.col("kept"))
    assert rows(lost.where("track = 1"), "frame") == [(10,), (11,), (12,), (20,)] and rows(lost.where("track = 2"), "frame") == [(20,)]


def sampled_by_loop(line):
    """Runs without a gap above 3 m, samples each half metre and at the end, pieces of 10 steps, a rest of three further samples."""
    out, runs = [], [[line[0]]]
    for a, b in itertools.pairwise(line):
        if math.dist(a, b) > 3:
            runs.append([])
        runs[-1].append(b)
    for run in runs:
        s = np.concatenate([[0.0], np.cumsum([math.dist(a, b) for a, b in itertools.pairwise(run)])])
        at = np.append(np.arange(0, s[-1], 0.5), s[-1])
        if len(run) < 2:
            continue
        p = np.stack([np.interp(at, s, [q[i] for q in run]) for i in (0, 1)], axis=1)
        whole = max(0, (len(p) - 11) // 10 + 1)
        places = [(10 * k, 10 * k + 5, 10 * k + 10) for k in range(whole)]
        rest = len(p) - 10 * whole
        if (rest - 1 if whole else rest) >= 3:
            places.append((10 * whole, 10 * whole + (rest - 1) // 2, len(p) - 1))
        out += [[round(float(c), 6) for i in ijk for c in p[i]] + [round(math.atan2(*(p[ijk[0] + 1] - p[ijk[0]])[::-1]), 6)] for ijk in places]
    return out


def test_map_tokens_against_a_loop(spark):
    rng = np.random.default_rng(3)
    lines = {1: [(0.0, 0.0), (2.6, 0.0), (2.6, 0.0), (5.1, 0.7), (9.0, 9.0), (9.5, 9.0), (9.5, 10.5)], 2: [(0.0, 0.0), (1.0, 1.0)], 3: [(0.0, 0.0), (5.0, 0.0), (10.0, 0.0)], 4: [(k * 2.5, 0.0) for k in range(9)]}
    lines |= {10 + k: [(float(x), float(y)) for x, y in np.cumsum(rng.uniform(-1, 2.5, (int(rng.integers(3, 40)), 2)), axis=0)] for k in range(12)}
    table = spark.createDataFrame([(1, n, i, x, y, n % 3) for n, line in lines.items() for i, (x, y) in enumerate(line)], "scene long, line long, i long, x double, y double, light long")
    scenes = spark.createDataFrame([(1,), (2,)], "scene long")
    got = polylines.map_tokens(table, scenes, ["scene"], "line", "i", ["light"])
    found = {}
    for r in got.where("scene = 1").orderBy("line", "token").collect():
        assert r.light == r.line % 3
        found.setdefault(r.line, []).append([round(c, 6) for p in r.points for c in (p.x, p.y)] + [round(r.heading, 6)])
    want = {n: made for n, line in lines.items() if len(line) > 2 and (made := sampled_by_loop(line))}
    assert found.keys() == want.keys()
    for n in want:
        np.testing.assert_allclose(found[n], want[n], atol=2e-6)
    assert [(r.line, r.light, r.points[0].x) for r in got.where("scene = 2").collect()] == [(None, 0, 6e4)]


def test_splines_against_a_dense_solve(spark):
    rng = np.random.default_rng(6)
    for n in (2, 3, 4, 9, 40):
        control = rng.normal(size=(n, 3)) * 10
        want = np.zeros_like(control)
        if n > 2:
            a = 4 * np.eye(n - 2) + np.eye(n - 2, k=1) + np.eye(n - 2, k=-1)
            want[1:-1] = np.linalg.solve(a, 6 * (control[2:] - 2 * control[1:-1] + control[:-2]))
        np.testing.assert_allclose(splines.second_derivatives(control), want, atol=1e-9)
        np.testing.assert_allclose(splines.cubic_frames(control)[4::5], control[1:])
    line = np.stack([np.arange(6.0), 2 * np.arange(6.0)], axis=1)
    place, ways = splines.frames_between(line, np.full(6, 9.0), "cubic")
    np.testing.assert_allclose(place[:, 0], np.arange(1, 26) / 5, atol=1e-12)
    np.testing.assert_allclose(ways, math.atan2(2, 1))
    still, ways = splines.frames_between(np.zeros((3, 2)), np.array([0.4, 1.0, 2.0]), "cubic")
    assert (ways == 0.4).all() and (still == 0).all()
    _, ways = splines.frames_between(line[:2], np.array([3.0, -3.0]), "linear")
    np.testing.assert_allclose(ways[[1, 4]], [3.0 + (2 * math.pi - 6) * 0.4 * 0.4 * 2.2, -3.0])
    data = [(1, t, i, float(i), None if (t, i) == (1, 2) else 1.0, 0.0, m) for t, m in ((1, "cubic"), (2, "static"), (3, "linear")) for i in range(4)] + [(1, 4, 0, 0.0, 0.0, 0.0, "cubic")]
    got = splines.interpolate(spark.createDataFrame(data, "scene long, track long, i long, x double, y double, heading double, method string"), ["scene"], "track", "i")
    assert [got.where(F.col("track") == t).count() for t in (1, 2, 3, 4)] == [10, 15, 15, 0]


def test_steps_at_the_limit_are_no_jumps_at_any_time():
    """Eight metres in a tenth of a second are just within the limit, whichever two frames they lie between (F3)."""
    k = np.arange(40)
    assert paths.longest_path(k * 0.1, 8.0 * k, np.zeros(40), 70.0, 15.0).all()
