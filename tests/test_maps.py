"""Framed files, map matching, geometry and junctions against plain versions."""

import itertools
import math
import os
import random
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracklode.functions import geometry
from tracklode.operators import junctions, mapmatch
from tracklode.sources import framed, metric_store


def rows(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.select(*columns).collect()), key=repr)


def write(path, payloads):
    path.write_bytes(b"".join(struct.pack("<Q", len(p)) + b"abcd" + p + b"efgh" for p in payloads))


def test_framed_files_are_split_counted_and_selected(spark, tmp_path):
    rng = random.Random(1)
    data = {f"s-{k:05d}-of-00003": [rng.randbytes(rng.choice([0, 5, 300_000, 40])) for _ in range(30 * k)] for k in range(3)}
    for name, payloads in data.items():
        write(tmp_path / name, payloads)
    index = framed.index_files(framed.shards(spark, str(tmp_path)), split_bytes=400_000)
    assert index.count() > 8
    base = lambda c="path": F.element_at(F.split(c, "/"), -1).alias("name")
    assert rows(framed.count_records(index).select(base(), "records"), "name", "records") == [(n, len(p)) for n, p in data.items() if p]
    assert [n for _, n in rows(framed.count_records(index, limit=40).select(base(), "records"), "name", "records")] == [30, 10]
    read = framed.read_index(index)
    assert {(r.name, r.record_index): bytes(r.payload) for r in read.select(base(), "record_index", "payload").collect()} == {(n, i): p for n, ps in data.items() for i, p in enumerate(ps)}
    assert read.rdd.getNumPartitions() == index.count()
    every = [p for ps in data.values() for p in ps]
    for start, limit in ((0, None), (25, 20), (89, 5), (95, None), (3, 0)):
        got = framed.read_selected(index, start, limit)
        assert {r.global_index: bytes(r.payload) for r in got.select("global_index", "payload").collect()} == dict(list(enumerate(every))[start : None if limit is None else start + limit])
    ids = spark.createDataFrame([("a",), ("a",), (None,)], "scenario_id string")
    assert rows(framed.with_ids(spark.createDataFrame([("a", 1), ("b", 2), (None, 3)], "scenario_id string, n int"), ids), "n") == [(1,)]


def test_framed_files_that_are_broken_or_changed(spark, tmp_path):
    a = tmp_path / "a"
    a.mkdir()
    with pytest.raises(ValueError, match="no files"):
        framed.shards(spark, str(a))
    write(a / "x", [b"one", b"two"])
    index = framed.index_files(framed.shards(spark, str(a)))
    assert framed.read_index(index).count() == 2
    os.utime(a / "x", (5, 5))
    with pytest.raises(Exception, match="changed"):
        framed.read_index(index).count()
    for cut, what in ((2, "payload"), (5, "payload"), (25, "header")):
        whole = (a / "x").read_bytes()
        (a / f"y{cut}").write_bytes(whole[:-cut] if cut < 20 else whole[: 19 + 4])
        with pytest.raises(Exception, match=f"truncated {what} of record 1"):
            framed.index_files(framed.shards(spark, str(a / f"y{cut}")))
    b = tmp_path / "b"
    b.mkdir()
    write(b / "x", [])
    with pytest.raises(ValueError, match="same name"):
        framed.shards(spark, str(a), str(b))
    write(b / "t-00000-of-00002", [])
    with pytest.raises(ValueError, match="1 of 2 numbered"):
        framed.shards(spark, str(b))
    assert framed.count_records(framed.index_files(framed.shards(spark, str(b), pattern="x"))).count() == 0


def test_written_frames(spark, tmp_path):
    data = spark.createDataFrame([(f"f{i % 3}", -i, str(i).encode()) for i in range(20)], "file string, order int, payload binary")
    made = framed.write_records(data, f"file://{tmp_path}/w", files=2)
    assert rows(made, "file", "records") == [("f0", 7), ("f1", 7), ("f2", 6)]
    got = framed.read_index(framed.index_files(framed.shards(spark, f"{tmp_path}/w")))
    assert [bytes(p).decode() for f, _, p in rows(got, "path", "record_index", "payload") if f.endswith("f1")] == [str(i) for i in range(19, 0, -3)]


def match_by_loop(states, lanes, links, search=32.0):
    kin = set(links) | {(b, a) for a, b in links}
    out, before = [], None
    for frame, x, y, heading in states:
        found = []
        for lane, points in lanes.items():
            best = None
            s0 = 0.0
            for k, (a, b) in enumerate(itertools.pairwise(points)):
                u = (b[0] - a[0], b[1] - a[1])
                n2 = u[0] ** 2 + u[1] ** 2
                f = max(0.0, min(1.0, ((x - a[0]) * u[0] + (y - a[1]) * u[1]) / n2)) if n2 > 1e-12 else 0.0
                d = math.hypot(x - a[0] - f * u[0], y - a[1] - f * u[1])
                if best is None or d < best[0] - 1e-12:
                    best = d, abs((math.atan2(u[1], u[0]) - heading + math.pi) % (2 * math.pi) - math.pi), s0 + f * math.sqrt(n2)
                s0 += math.sqrt(n2)
            if best and best[0] <= search:
                found.append((*best, lane))
        fit = [c for c in found if c[0] <= 8 and c[1] <= math.radians(60)]
        if not found:
            out.append((frame, None, None, False))
            continue
        cost = lambda c: (c[0] + 2 * c[1] + (0 if before is None or before == c[3] or (before, c[3]) in kin else 2), c[0], c[3])  # noqa: B023, E731
        best = min(fit or found, key=cost)
        before = best[3] if fit else None
        out.append((frame, best[3], round(best[2], 6), bool(fit)))
    return out


def test_map_matching_keeps_the_lane(spark):
    rng = np.random.default_rng(5)
    lanes = {1: [(-50, 0), (0, 0), (400, 0)], 2: [(0, -60), (0.5, 0), (0, 60)], 3: [(400, 0), (420, 5)], 4: [(-40, 1.5), (60, -1.5)], 5: [(7, 7)], 6: [(3, 3), (3, 3)]}
    links = [(1, 3)]
    tracks = {7: [(k, -45 + 5.0 * k, float(rng.normal(scale=0.6)), float(rng.normal(scale=0.1))) for k in range(0, 95, 2)], 8: [(k, 0.2, -50 + 2.0 * k, math.pi / 2) for k in range(50)], 9: [(0, 1000.0, 1000.0, 0.0), (1, 0.0, 20.0, 0.0), (2, 3.0, 3.0, 0.0)]}
    states = spark.createDataFrame([(1, t, *s) for t, some in tracks.items() for s in some] + [(2, 7, 0, 0.0, 0.0, 0.0)], "scene long, track long, frame long, x double, y double, heading double")
    table = spark.createDataFrame([(1, n, [{"x": float(x), "y": float(y)} for x, y in p]) for n, p in lanes.items()], "scene long, lane long, points array<struct<x:double,y:double>>")
    exits = spark.createDataFrame([(1, a, b, "exit") for a, b in links], "scene long, src long, dst long, kind string")
    got = mapmatch.matched_lanes(states, mapmatch.lane_segments(table, ["scene"], "lane", "points"), exits, ["scene"], "track", "frame")
    lanes.pop(5)
    for t, some in tracks.items():
        found = got.where((F.col("scene") == 1) & (F.col("track") == t)).withColumn("s", F.round("s", 6))
        assert rows(found, "frame", "lane", "s", "confident") == sorted(match_by_loop(some, lanes, links), key=repr)
    assert rows(got.where("scene = 2"), "lane", "confident", "confidence") == [(None, False, 0.0)]


def test_no_pair_of_state_and_segment_is_shuffled(spark):
    """Long segments everywhere: every state is near every segment of its scenario (F1, F2)."""
    from tracklode.operators import roadedge

    states = spark.range(400).select((F.col("id") % 2).alias("scene"), (F.col("id") % 5).alias("track"), F.col("id").alias("frame"), (F.col("id") % 91 / 7.0).alias("x"), (F.col("id") % 13 / 3.0).alias("y"), F.lit(0.1).alias("heading"))
    lanes = spark.range(2).select(F.col("id").alias("scene"), F.lit(1).cast("long").alias("lane"), F.transform(F.sequence(F.lit(0), F.lit(300)), lambda k: F.struct((k * 7 % 29).cast("double").alias("x"), (k * 3 % 11).cast("double").alias("y"), F.lit(0.0).alias("z"))).alias("points"))
    links = spark.createDataFrame([], "scene long, src long, dst long, kind string")
    matched = mapmatch.matched_lanes(states, mapmatch.lane_segments(lanes, ["scene"], "lane", "points"), links, ["scene"], "track", "frame")
    boxes = states.withColumns({"z": F.lit(0.0), "length": F.lit(4.0), "width": F.lit(2.0), "height": F.lit(1.0)})
    edges = roadedge.road_edge_distances(boxes, roadedge.edge_chain(lanes, ["scene"], "lane", "points"), ["scene"], ["track", "frame"], "lane")
    for got, column in ((matched, "lane"), (edges, "distance")):
        assert got.where(f"{column} is not null").count() == 400
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert "FlatMapCoGroupsInArrow" in plan and "Join" not in plan.split("FlatMapCoGroupsInArrow")[0]


def test_hulls_and_overlaps_against_a_grid():
    rng = np.random.default_rng(2)
    for _ in range(20):
        a, b = (geometry.convex_hull(rng.normal(size=(9, 2)) + rng.normal(scale=0.7, size=2)) for _ in "ab")
        grid = np.stack(np.meshgrid(np.linspace(-5, 5, 401), np.linspace(-5, 5, 401)), axis=-1).reshape(-1, 2)
        inside = [np.all([(q[0] - p[0]) * (grid[:, 1] - p[1]) - (q[1] - p[1]) * (grid[:, 0] - p[0]) >= 0 for p, q in zip(h, np.roll(h, -1, axis=0), strict=True)], axis=0) for h in (a, b)]
        cell = (10 / 400) ** 2
        assert abs(geometry.area(a) - inside[0].sum() * cell) < 0.1
        assert abs(abs(geometry.area(geometry.clipped(a, b))) - (inside[0] & inside[1]).sum() * cell) < 0.1
        assert geometry.overlap(a, a) == pytest.approx(1.0) and geometry.overlap(a, b) == pytest.approx(geometry.overlap(b, a))
    line = np.array([(0.0, 0.0), (4.0, 0.0), (4.0, 0.0), (8.0, 0.0)])
    assert geometry.area(geometry.convex_hull(geometry.widened(line, 2.0))) == pytest.approx(32.0)
    assert geometry.crossing(line, np.array([(1.0, -1.0), (1.0, 1.0)])) and not geometry.crossing(line, np.array([(0.0, 0.0), (0.0, 5.0)]))
    assert len(geometry.convex_hull(np.zeros((4, 2)))) == 1 and geometry.overlap(np.zeros((1, 2)), line) == 0.0


def test_strong_components_against_reachability(spark):
    rng = random.Random(4)
    edges = [(g, rng.randrange(14), rng.randrange(14)) for g in range(8) for _ in range(6 + 3 * g)]
    want = []
    for g in range(8):
        to = {n: {b for h, a, b in edges if h == g and a == n} for n in range(14)}
        for k, i, j in itertools.product(range(14), repeat=3):
            if k in to[i] and j in to[k]:
                to[i].add(j)
        want += [(g, min(m for m in range(14) if m in to[n] and n in to[m]), n) for n in range(14) if n in to[n]]
    table = spark.createDataFrame([*edges, (3, None, 1)], "g int, src int, dst int")
    assert rows(junctions.strong_components(table, ["g"]), "g", "component", "node") == sorted(want, key=repr)


def test_clusters_on_the_circle():
    rng = np.random.default_rng(3)
    for n in (1, 2, 3, 9):
        for _ in range(20):
            a = rng.uniform(0, 2 * math.pi, n)
            got = junctions.clusters(a, 0.6)
            assert sorted(np.concatenate(got).tolist()) == list(range(n))
            gaps = np.diff(np.sort(a), append=np.sort(a)[0] + 2 * math.pi)
            assert len(got) == max(1, int((gaps > 0.6).sum()))
            for c in got:
                assert ((np.diff(a[c]) % (2 * math.pi)) <= 0.6).all()


def ring(cx, cy, r, first, parts=4, gap=0):
    return {first + k: [(cx + r * math.cos(t), cy + r * math.sin(t)) for t in np.linspace(2 * math.pi * k / parts, 2 * math.pi * (k + 1) / parts, 9)] for k in range(parts - gap)}


def lane_table(spark, lanes):
    return spark.createDataFrame([(1, n, [{"x": float(x), "y": float(y)} for x, y in p]) for n, p in lanes.items()], "scene long, lane long, points array<struct<x:double,y:double>>")


def test_roundabouts(spark):
    lanes = ring(0, 0, 12, 10) | ring(1, 0, 16, 20) | ring(200, 0, 5, 30) | {40: [(300, 0), (340, 0)], 41: [(340, 0), (340, 2)], 42: [(340, 2), (300, 0)]} | ring(500, 0, 12, 50)
    loops = [(10, 11), (11, 12), (12, 13), (13, 10), (20, 21), (21, 22), (22, 23), (23, 20), (30, 31), (31, 32), (32, 33), (33, 30), (40, 41), (41, 42), (42, 40), (50, 51), (51, 52), (52, 53), (53, 50)]
    ways = {100: ([(40, 0), (12, 0)], 10, None), 101: ([(0, 12), (0, 40)], None, 10), 102: ([(-40, 0), (-12, 0)], 12, None), 103: ([(60, 0), (17, 0)], 20, None), 104: ([(540, 0), (512, 0)], 50, None), 105: ([(500, 12), (530, 300)], None, 50)}
    lanes |= {n: w[0] for n, w in ways.items()}
    links = loops + [(n, w[1]) if w[1] is not None else (w[2], n) for n, w in ways.items()]
    table = spark.createDataFrame([(1, a, b) for a, b in links] + [(1, 10, 999)], "scene long, src long, dst long")
    got = junctions.roundabouts(lane_table(spark, lanes), table, ["scene"])
    # 30 to 33 have no ways in or out, 40 to 42 are a triangle, 50 to 53 have two directions only.
    assert rows(got, "core", "rings", "arms", "lanes") == [(10, 2, 3, [10, 11, 12, 13, 20, 21, 22, 23])]


def test_junctions_from_groups(spark):
    lanes = {1: [(-30, -2), (-10, -2)], 2: [(-10, 2), (-30, 2)], 3: [(10, 2), (30, 2)][::-1], 4: [(10, -2), (30, -2)], 5: [(-2, 30), (-2, 10)], 6: [(2, 10), (2, 30)]}
    lanes |= {11: [(-10, -2), (10, -2)], 12: [(10, 2), (-10, 2)], 13: [(-2, 10), (-2, 2), (10, -2)], 14: [(-10, -2), (2, 2), (2, 10)], 15: [(-2.2, 30), (-2.2, 10)], 21: [(100, 0), (120, 0)]}
    links = [(1, 11), (11, 4), (3, 12), (12, 2), (5, 13), (13, 4), (1, 14), (14, 6), (15, 13)]
    table = spark.createDataFrame([(1, a, b) for a, b in links], "scene long, src long, dst long")
    groups = [("geometric", [11, 12, 13, 14]), ("signalized", [11, 12]), ("stop_controlled", [11, 12]), ("signalized", [13, 14]), ("stop_controlled", [21]), ("roundabout", [99])]
    asked = spark.createDataFrame([(1, k, own) for k, own in groups], "scene long, kind string, lanes array<long>")
    cores = junctions.junction_cores(asked, lane_table(spark, lanes), ["scene"])
    # The crossing holds the lanes of a signalized core, the stop-controlled one repeats it, and the two signalized ones overlap.
    assert rows(cores, "core", "kind", "lanes") == [(0, "signalized", [11, 12, 13, 14]), (1, "stop_controlled", [21])]
    got = junctions.junctions(cores, lane_table(spark, lanes), table, ["scene"]).collect()
    assert [(r.kind, len(r.arms)) for r in got] == [("signalized", 3)]
    # 5 and 15 enter at one place; the longer (then smaller) one stays.
    assert [(round(math.degrees(a.angle)) % 360, a.incoming, a.outgoing) for a in got[0].arms] == [(0, [3], [4]), (90, [5], [6]), (180, [1], [2])]
    assert got[0].confidence == pytest.approx(0.98)
    assert got[0].crossings and got[0].arms[0].stop is not None
    only = junctions.junction_cores(asked.where("kind = 'geometric'"), lane_table(spark, lanes), ["scene"])
    assert [len(r.arms) for r in junctions.junctions(only, lane_table(spark, lanes), table, ["scene"]).collect()] == [3]


def kept_by_loop(groups):
    out = []
    for kind, own in sorted(groups, key=lambda g: (g[0], min(g[1]))):
        if all(len(own & o) < 0.8 * len(own | o) and (kind < 2 or len(own & o) < 0.8 * min(len(own), len(o))) for _, o in out):
            out.append((kind, own))
    return out


def test_kept_groups_against_a_loop():
    rng = random.Random(9)
    for _ in range(50):
        groups = [(rng.randrange(4), frozenset(rng.sample(range(8), rng.randrange(1, 8)))) for _ in range(9)]
        assert junctions.kept_groups(groups) == kept_by_loop(groups)


def test_metric_store_survives_a_kill_between_values_and_commit(spark, tmp_path, monkeypatch):
    path = f"{tmp_path}/m"
    data = lambda k: spark.createDataFrame([("a", "s", "m", float(k)), ("a", "s", "m", float("nan")), ("b", "s", "m", None), ("b", "t", "m", 2.0 * k), ("b", "t", "m", float("inf"))], "level string, scope string, metric string, value double")
    store = metric_store.MetricStore(spark, path, {"x": 1})
    assert store.values().count() == 0 and store.append(0, data(5)) and not store.append(0, data(9))
    read = spark.read.__class__.schema

    def killed(self, schema):  # after the values, before the commit
        if schema == metric_store.VALUES:
            raise KeyboardInterrupt
        return read(self, schema)

    monkeypatch.setattr(spark.read.__class__, "schema", killed)
    with pytest.raises(KeyboardInterrupt):
        store.append(1, data(7))
    monkeypatch.undo()
    assert spark.read.parquet(f"{path}/values/batch=1").count() == 2
    again = metric_store.MetricStore(spark, path, {"x": 1})
    assert rows(again.values(), "scope", "value", "batch") == [("s", 5.0, 0), ("t", 10.0, 0)]
    again.append_batch(data(8), 1)
    again.append_batch(data(8), 1)
    assert rows(again.values(), "scope", "value", "batch") == [("s", 5.0, 0), ("s", 8.0, 1), ("t", 10.0, 0), ("t", 16.0, 1)]
    assert rows(again.counts(), "level", "scope", "n") == [("a", "s", 2), ("b", "t", 2)]
    with pytest.raises(ValueError, match="another run"):
        metric_store.MetricStore(spark, path, {"x": 2})
    spark.createDataFrame([("a", "s", "m", 1.0)], metric_store.VALUES).write.mode("append").parquet(f"{path}/values/batch=1")
    with pytest.raises(ValueError, match="batch 1: 3 rows of 2"):
        again.values()


def test_a_vertex_shared_by_two_lanes_belongs_to_the_first(spark, tmp_path):
    """The seventh point of lane a and the first of lane b are the place of the second event (F4)."""
    import duckdb

    from tracklode.plans import motion

    con = duckdb.connect()
    con.execute("CREATE TABLE events AS SELECT event_id, TIMESTAMP '2024-01-01' + to_seconds(event_id) AS ts, 1::BIGINT AS user_id, type AS event_type, 1.0::DOUBLE AS value FROM (VALUES (0::BIGINT, 'a'), (3::BIGINT, 'b')) v(event_id, type)")
    con.execute(f"COPY events TO '{tmp_path}/events.parquet' (FORMAT parquet)")
    got = motion.QUERIES["lane_offsets"](spark, str(tmp_path))
    assert sorted(map(tuple, got.collect())) == sorted(con.sql(motion.SQL["lane_offsets"]).fetchall())
    assert {r.lane for r in got.collect()} == {"a"}


def test_messages_become_objects_by_pieces():
    """A batch of any size is taken apart in slices of bounded bytes, in order (F12 to F15)."""
    import pyarrow as pa

    from tracklode.sources import records

    batch = pa.RecordBatch.from_arrays([pa.array([bytes([i % 251]) * 1000 for i in range(5000)], pa.binary())], ["payload"])
    got = list(records.pieces(iter([batch, batch.slice(0, 1)]), 50_000))
    assert max(p.num_rows for p in got) <= 50 and pa.Table.from_batches(got).equals(pa.Table.from_batches([batch, batch.slice(0, 1)]))


@pytest.mark.parametrize("name", ["time_gradient", "kernel_likelihood", "heading_repair", "matched_tokens", "temporal_edges", "lane_changes", "local_ratio"])
def test_tracks_of_any_length_are_whole(spark, tmp_path, name):
    """Two users with 400 and 250 events are two tracks, and nothing ends at frame 91 (F5 to F11)."""
    import duckdb

    from tracklode.plans import motion

    con = duckdb.connect()
    con.execute("CREATE TABLE events AS SELECT i AS event_id, TIMESTAMP '2024-01-01' + to_seconds(i * i % 100003) AS ts, CASE WHEN i % 13 < 5 THEN 3 ELSE 8 END::BIGINT AS user_id, CASE WHEN i % 3 = 0 THEN 'a' ELSE 'b' END AS event_type, (i * 37 % 1009) / 100.0 AS value FROM range(650) r(i)")
    con.execute(f"COPY events TO '{tmp_path}/events.parquet' (FORMAT parquet)")
    got = motion.QUERIES[name](spark, str(tmp_path))
    assert sorted(map(tuple, got.collect())) == sorted(con.sql(motion.SQL[name]).fetchall())
    track, frame = {"local_ratio": ("id", "frame"), "temporal_edges": ("track_id", "src"), "lane_changes": ("track_id", "start"), "matched_tokens": ("track_id", "step * 5")}.get(name, ("track_id", "frame"))
    assert {r[0] for r in got.select(track).distinct().collect()} == {3, 8} and got.where(f"{frame} > 91").count()
