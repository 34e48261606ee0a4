"""The engine's operators against hand-computed values, brute force and their SQL."""

import math
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tracklode.functions import angles, text
from tracklode.operators import agents, aggregates, filters, intervals, joins, labels, lanes, likelihood, simulation, windows
from tracklode.plans import motion  # noqa: F401  registers its queries
from tracklode.plans.queries import QUERIES, SQL
from tracklode.sources import manifests, records
from tracklode.streaming import incremental

SF = "/root/testdata/sf0.001"


def rows(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.select(*columns).collect())


def test_angles(spark):
    values = [0.0, math.pi, -math.pi, 7.0, -7.0, 100.0]
    got = spark.createDataFrame([(v,) for v in values], "a double").select(angles.wrap_angle(F.col("a")).alias("w")).collect()
    for v, r in zip(values, got, strict=True):
        assert -math.pi <= r.w < math.pi and abs(math.sin(r.w) - math.sin(v)) < 1e-9
    one = spark.range(1).select(*[c.alias(n) for n, c in zip("xy", angles.to_local(F.lit(3.0), F.lit(2.0), F.lit(1.0), F.lit(2.0), F.lit(math.pi / 2)), strict=True)]).first()
    assert abs(one.x) < 1e-12 and abs(one.y + 2) < 1e-12
    box = spark.range(1).select(angles.box_contour(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(2.0), F.lit(4.0)).alias("b")).first().b
    assert [(p.x, p.y) for p in box] == [(2, 1), (2, -1), (-2, -1), (-2, 1)]


def test_text_functions(spark):
    got = spark.createDataFrame([("scene_101",), ("x12345",), ("abc",)], "s string").select(text.scene_bucket(F.col("s")).alias("b")).collect()
    assert [r.b for r in got[:2]] == [1, 45] and 0 <= got[2].b < 100
    counts = spark.createDataFrame([(999,), (1250,), (1250000,), (3 * 10**9,)], "n long").select(text.compact_count(F.col("n")).alias("c")).collect()
    assert [r.c for r in counts] == ["999", "1.2K", "1.2M", "3.0B"]
    order = spark.createDataFrame([("b",), ("10",), ("9",), ("a",)], "k string").orderBy(*text.numeric_first(F.col("k"))).collect()
    assert [r.k for r in order] == ["9", "10", "a", "b"]


def test_islands_and_merge(spark):
    frames = spark.createDataFrame([("a", f) for f in [*range(11, 21), *range(24, 36), 15]], "k string, frame int")
    runs = windows.islands(frames, ["k"], "frame")
    assert rows(runs, "start", "end") == [(11, 21), (24, 36)]
    assert rows(intervals.merge_intervals(runs, ["k"], 3), "start", "end") == [(11, 36)]
    assert rows(intervals.merge_intervals(runs, ["k"], 2), "start", "end") == [(11, 21), (24, 36)]


def test_stopping_rule(spark):
    rows_ = [("t", "Decelerate", 11, 26), ("t", "Parked", 27, 42), ("t", "Decelerate", 50, 60), ("t", "Parked", 66, 70), ("u", "Decelerate", 1, 5), ("u", "Parked", 5, 9)]
    got = intervals.rename_before(spark.createDataFrame(rows_, "k string, tag string, start int, end int"), ["k"], "tag", "Decelerate", "Parked", "Stopping", 5)
    assert rows(got, "k", "tag", "start", "end") == sorted([("t", "Stopping", 11, 26), *rows_[1:4], ("u", "Stopping", 1, 5), rows_[5]])


def test_frame_tags(spark):
    got = spark.createDataFrame([("LEFT_TURN", 3.0, 0.6), ("KEEP_SPEED", 0.0, 9.0), ("U_TURN", 3.0, -1.0), ("KEEP_SPEED", 3.0, 0.0)], "a string, s double, c double")
    tags = got.select(labels.frame_tags(F.col("a"), F.col("s"), F.col("c")).alias("t")).collect()
    assert [r.t for r in tags] == [["LeftTurn", "Accelerate"], ["Parked"], ["Decelerate"], ["Straight", "KeepSpeed"]]


def test_conflicts(spark):
    data = [("a", "LeftTurn", 0, 10), ("a", "Straight", 5, 20), ("a", "Straight", 30, 35), ("b", "Parked", 0, 9), ("c", "Parked", 0, 9), ("c", "LeftTurn", 0, 5)]
    got = intervals.resolve_conflicts(spark.createDataFrame(data, "k string, action string, start long, end long"), "k", labels.TAG_PRIORITY, labels.TAG_EXCLUDES)
    assert rows(got, "k", "action", "start", "end") == [("a", "LeftTurn", 0, 10), ("a", "Straight", 10, 20), ("a", "Straight", 30, 35), ("b", "Parked", 0, 9), ("c", "LeftTurn", 0, 5), ("c", "Parked", 0, 9)]
    # Exclusions are directed: Parked excludes a later tag, but LeftTurn does not exclude Parked; at equal rank the later one keeps the overlap.
    more = [("d", "Parked", 0, 9), ("d", "Straight", 5, 20), ("e", "Accelerate", 0, 9), ("e", "Decelerate", 5, 12), ("f", "LeftTurn", 0, 9), ("f", "RightTurn", 4, 12), ("g", "Accelerate", 0, 9), ("g", "Parked", 4, 12)]
    got_more = intervals.resolve_conflicts(spark.createDataFrame(more, "k string, action string, start long, end long"), "k", labels.TAG_PRIORITY, labels.TAG_EXCLUDES)
    assert rows(got_more, "k", "action", "start", "end") == [("d", "Parked", 0, 5), ("d", "Straight", 5, 20), ("e", "Accelerate", 0, 9), ("e", "Decelerate", 5, 12), ("f", "LeftTurn", 0, 4), ("f", "RightTurn", 4, 12), ("g", "Accelerate", 0, 9), ("g", "Parked", 9, 12)]
    assert rows(intervals.drop_when_multiple(got, ["k"], "action", "Parked"), "k", "action") == [("a", "LeftTurn"), ("a", "Straight"), ("a", "Straight"), ("b", "Parked"), ("c", "LeftTurn")]


def test_gradients_match_numpy(spark):
    rng = np.random.default_rng(1)
    t, x = np.cumsum(rng.uniform(0.05, 0.3, 20)), rng.normal(size=20)
    df = spark.createDataFrame([(1, i, float(a), float(b)) for i, (a, b) in enumerate(zip(t, x, strict=True))] + [(2, 0, 0.0, 5.0)], "k int, frame int, t double, x double")
    got = [r[0] for r in windows.gradient(df, ["k"], "t", "x").where("k = 1").orderBy("frame").select("gradient").collect()]
    assert np.allclose(got, np.gradient(x, t))
    got = [r[0] for r in windows.uniform_gradient(df, ["k"], "frame", "x", 0.1).where("k = 1").orderBy("frame").select("gradient").collect()]
    assert np.allclose(got, np.gradient(x, 0.1, edge_order=2))


def test_interpolation_and_gaps(spark):
    valid = [True, False, False, True, False, False, False, True, False]
    df = spark.createDataFrame([(1, i, float(i * i), v) for i, v in enumerate(valid)], "k int, f int, x double, v boolean")
    got = windows.interpolate(windows.fill_short_gaps(df, ["k"], "f", "v", 2), ["k"], "f", "x", "v").orderBy("f").collect()
    assert [r.filled for r in got] == [True, True, True, True, False, False, False, True, False]
    assert [r.interpolated for r in got] == pytest.approx(np.interp(range(9), [0, 3, 7], [0, 9, 49]))
    one = spark.createDataFrame([(1, i, float(i), i == 2) for i in range(5)], "k int, f int, x double, v boolean")
    assert [r.interpolated for r in windows.interpolate(one, ["k"], "f", "x", "v").collect()] == [2.0] * 5


def test_transition_shrinkage(spark):
    pairs = spark.createDataFrame([(1, 0, 1, 4.0), (1, 0, 1, 6.0), (1, 1, 0, 10.0)], "kind int, prev int, cur int, a double")
    tokens = spark.createDataFrame([(1, 0, 2.5), (1, 1, 7.0), (1, 2, 3.0)], "kind int, token int, a double")
    got = {(r.prev, r.cur): r.a for r in labels.shrunken_transitions(pairs, tokens, "kind", ["a"], 1.0).collect()}
    assert len(got) == 9 and got[0, 1] == pytest.approx(5.0) and got[1, 0] == pytest.approx(10.0) and got[0, 2] == pytest.approx(3.0) and got[2, 1] == pytest.approx(5.0)


def test_moments_match_numpy(spark):
    rng = np.random.default_rng(2)
    data = [(s, "m", float(v)) for s, v in zip(rng.choice(["a", "b"], 101), rng.normal(size=101), strict=True)] + [("a", "m", float("nan")), ("a", "m", float("inf")), ("b", "m", None)]
    for r in aggregates.scoped_moments(spark.createDataFrame(data, "scope string, metric string, value double")).collect():
        v = np.array([x for s, _, x in data if x is not None and np.isfinite(x) and r.scope in ("all", s)])
        assert (r.n, r["mean"], r["std"], r.p_low, r.p_high) == pytest.approx((len(v), v.mean(), v.std(), *np.percentile(v, [1, 99])))


def test_histogram_edges(spark):
    log = spark.createDataFrame([("k", 0.0), ("k", 10.0), ("k", -5.0), ("k", None)], "key string, value double")
    sim = spark.createDataFrame([("k", 1.0), ("k", 10.0), ("k", 99.0)], "key string, value double")
    got = likelihood.histogram_log_likelihood(log, sim, ["key"], 0.0, 10.0, 2, 1.0).collect()
    assert sorted(round(math.exp(r.log_likelihood), 9) for r in got) == [0.4, 0.4, 0.6, 0.6]


def test_radius_and_polygons_match_brute_force(spark):
    rng = random.Random(3)
    points = [(1, i, rng.uniform(-9, 9), rng.uniform(-9, 9)) for i in range(80)]
    df = spark.createDataFrame(points, "k int, id int, x double, y double")
    got = {(r.id, r.other) for r in joins.radius_pairs(df, df, ["k"], 2.5).collect()}
    assert got == {(a[1], b[1]) for a in points for b in points if a[1] != b[1] and (a[2] - b[2]) ** 2 + (a[3] - b[3]) ** 2 <= 6.25}
    square = spark.createDataFrame([("s", [(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 4.0)])], "zone string, ring array<struct<x:double,y:double>>")
    probe = spark.createDataFrame([(1, 2.0, 2.0), (2, 4.0, 2.0), (3, 4.1, 2.0), (4, 0.0, 0.0)], "id int, x double, y double")
    assert rows(joins.points_in_polygons(probe, square, "id", "zone"), "id") == [(1,), (2,), (4,)]


def test_time_to_collision(spark):
    objects = spark.createDataFrame([(1, "a", 0.0, 0.0, 0.0, 4.0, 2.0, 10.0), (1, "b", 24.0, 0.0, 0.0, 4.0, 2.0, 5.0), (1, "c", 14.0, 9.0, 0.0, 4.0, 2.0, 0.0)], "step int, id string, x double, y double, heading double, length double, width double, speed double")
    assert {r.id: r.ttc for r in simulation.time_to_collision(objects, ["step"]).collect()} == {"a": pytest.approx(4.0), "b": 5.0, "c": 5.0}


def test_disk_cover_covers(spark):
    rng = np.random.default_rng(4)
    v = rng.normal(size=(60, 3))
    df = spark.createDataFrame([("c", i, x.tolist()) for i, x in enumerate(v)], "kind string, id int, v array<double>")
    got = labels.disk_cover(df, "kind", "id", "v", 100, 1.0).orderBy("cluster").collect()
    assert got[0].pivot == 0 and sum(r.members for r in got) == 60
    assert (np.linalg.norm(v[:, None] - v[[r.pivot for r in got]][None], axis=2).min(axis=1) <= 1.0).all()


def scenario():
    state = lambda i: {"center_x": float(i), "center_y": 0.5, "center_z": 0.0, "length": 4.5, "heading": 0.25, "velocity_x": 2.0, "valid": i != 2}
    lane = {"id": 100, "lane": {"speed_limit_mph": 30.0, "type": 2, "points": [{"x": -20.0, "y": 0.0, "z": 0.0}, {"x": 20.0, "y": 0.0, "z": 0.0}], "exit_lanes": [7, -8], "left_neighbors": [{"feature_id": 9}]}}
    return {"scenario_id": "s1", "timestamps_seconds": [0.0, 0.1, 0.2], "current_time_index": 1, "sdc_track_index": 0, "tracks": [{"id": 5, "object_type": 1, "states": [state(i) for i in range(3)]}], "dynamic_map_states": [{"lane_states": [{"lane": 100, "state": 4, "stop_point": {"x": 1.0}}]}], "map_features": [lane, {"id": 3, "stop_sign": {"stop_lanes": [100], "position": {"x": 1.0, "y": 2.0, "z": 0.0}}}], "tracks_to_predict": [{"track_index": 0, "difficulty": 1}]}


def test_records(spark, tmp_path):
    payload = records.encode(scenario(), records.SCENARIO)
    assert records.decode(payload, records.SCENARIO)["tracks"][0]["states"][1]["center_x"] == 1.0
    (tmp_path / "a.rec").write_bytes(records.frame(payload) + records.frame(b"\xff\xff"))
    (tmp_path / "b.rec").write_bytes(b"")
    raw = records.read_records(spark, str(tmp_path))
    assert rows(raw, "record_index") == [(0,), (1,)]
    found = records.scenarios(raw)
    good = found.where("error is null")
    assert found.where("error is not null").count() == 1
    assert rows(records.track_states(good), "frame_index", "x", "valid", "is_sdc") == [(0, 0.0, True, True), (1, 1.0, True, True), (2, 2.0, False, True)]
    assert rows(records.lane_edges(good), "src", "dst", "kind") == [(100, -8, "exit"), (100, 7, "exit"), (100, 9, "left")]
    assert rows(records.map_points(good), "feature_id", "point_index", "x") == [(3, 0, 1.0), (100, 0, -20.0), (100, 1, 20.0)]
    assert rows(records.signals(good).withColumn("g", records.signal_group("state")), "lane_id", "g", "stop_x") == [(100, "STOP", 1.0)]
    (tmp_path / "c.rec").write_bytes(records.frame(payload)[:-3])
    with pytest.raises(Exception, match="truncated"):
        records.read_records(spark, str(tmp_path)).count()


def test_manifests(spark, tmp_path):
    assert manifests.stable_fingerprint({"b": 1, "a": [1]}) == manifests.stable_fingerprint({"a": [1], "b": 1})
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "x").write_text("1")
    now = manifests.source_fingerprints(spark, str(tmp_path / "in"))
    done = now.selectExpr("source", "1L as records", "0L as first_index", "0L as last_index", "fingerprint")
    assert manifests.unfinished(now, done).count() == 0 and manifests.unfinished(now, done.withColumn("fingerprint", F.lit("old"))).count() == 1
    found = spark.createDataFrame([("a", 0), ("a", 1), ("b", 0), ("b", 0), ("d", 5)], "source string, record_index long")
    plan = spark.createDataFrame([("a", 2, 0, 1, ""), ("b", 2, 0, 1, ""), ("c", 1, 0, 0, ""), ("d", 1, 0, 0, "")], manifests.MANIFEST)
    assert rows(manifests.shard_audit(found, plan), "source", "status") == [("a", "ok"), ("b", "duplicate"), ("c", "missing"), ("d", "range")]
    tags = spark.createDataFrame([("scene_101", "LeftTurn(1 at 1-2)"), ("scene_101", "A"), ("scene_7", "B")], "scene_id string, tag_text string")
    manifests.write_tags(tags, str(tmp_path / "tags"))
    assert rows(spark.read.json(str(tmp_path / "tags")), "bucket", "scene_id") == [(1, "scene_101"), (7, "scene_7")]
    assert manifests.owners_once(spark.createDataFrame([("s", "1"), ("s", "2"), ("t", "1")], "scenario string, scene string"), "scenario", "scene").count() == 1


def test_incremental_moments_count_files_once(spark, tmp_path):
    source, checkpoint, partials = (str(tmp_path / x) for x in ("in", "check", "out"))
    first = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("b", None)], "k string, v double")
    first.coalesce(1).write.parquet(source)
    incremental.drain(spark, source, first.schema, checkpoint, partials, ["k"], "v")
    incremental.drain(spark, source, first.schema, checkpoint, partials, ["k"], "v")
    spark.createDataFrame([("a", 5.0)], first.schema).coalesce(1).write.mode("append").parquet(source)
    incremental.drain(spark, source, first.schema, checkpoint, partials, ["k"], "v")
    assert rows(incremental.moments(spark, partials, ["k"]), "k", "n", "mean", "min", "max") == [("a", 3, 3.0, 1.0, 5.0)]


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.execute(SQL[name])
    columns = [d[0] for d in want.description]
    tidy = lambda v: round(v, 5) + 0.0 if isinstance(v, float) else str(v) if hasattr(v, "year") else v
    expected = sorted((repr([tidy(v) for v in r]) for r in want.fetchall()))
    got = QUERIES[name](spark, SF)
    assert sorted(got.columns) == sorted(columns)
    assert sorted(repr([tidy(r[c]) for c in columns]) for r in got.collect()) == expected


def test_queries_without_sql_run(spark):
    for name in set(QUERIES) - set(SQL):
        assert QUERIES[name](spark, SF).count() > 0


@given(st.lists(st.integers(0, 60), max_size=40))
@settings(max_examples=15, deadline=None)
def test_islands_partition_the_frames(spark, frames):
    got = windows.islands(spark.createDataFrame([("k", f) for f in frames], "k string, frame int"), ["k"], "frame").collect()
    covered = [f for r in got for f in range(r.start, r.end)]
    assert sorted(covered) == sorted(set(frames))


def test_kernels(spark):
    from tracklode.operators import kernels

    rng = np.random.default_rng(5)
    line = 3 + 2 * np.arange(12.0) - 0.5 * np.arange(12.0) ** 2
    assert np.allclose(kernels.polynomial_smooth(line), line)
    noisy = rng.normal(size=15)
    fit = np.polyval(np.polyfit(np.arange(-3, 4), noisy[4:11], 2), 0)
    assert kernels.polynomial_smooth(noisy)[7] == pytest.approx(fit)
    states = [(0.0, True), (3.0, True), (0.1, True), (2.5, False), (3.1, True), (-0.2, True)]
    df = spark.createDataFrame([("a", i, h, v) for i, (h, v) in enumerate(states)], "k string, f int, h double, v boolean")
    assert [r.h for r in kernels.repair_headings(df, "k", "f", "h", "v").orderBy("f").collect()] == [0.0, 0.0, 0.1, 2.5, 3.1, 3.1]
    contours = kernels.token_contours(np.array([(0.0, 0.0, 0.0), (1.0, 0.0, 0.0), (1.0, 1.0, 0.5)]), 2.0, 4.0)
    assert contours[0].tolist() == [[2, 1], [2, -1], [-2, -1], [-2, 1]]
    steps = spark.createDataFrame([("a", 0, 0.0, 0.0, 0.0, True), ("a", 1, 1.1, 0.0, 0.0, True), ("a", 2, 2.0, 1.2, 0.4, True), ("a", 3, 9.0, 9.0, 1.0, False), ("b", 0, 5.0, 5.0, 0.0, True)], "k string, step int, x double, y double, heading double, valid boolean")
    got = kernels.match_tokens(steps, contours, 2.0, 4.0, "k", "step").orderBy("step").collect()
    assert [(r.k, r.step, r.token, round(r.x, 6), round(r.y, 6), round(r.heading, 6), r.matched) for r in got] == [("a", 1, 1, 1.0, 0.0, 0.0, True), ("a", 2, 2, 2.0, 1.0, 0.5, True), ("a", 3, 2, 9.0, 9.0, 1.0, False)]


def test_road_classes(spark):
    from tracklode.operators import kernels

    cases = [(False, "INTERSECTION", None, True), (True, "INTERSECTION", None, True), (True, "IN_INTERSECTION", None, False), (True, "NEAR_INTERSECTION_APPROACH", 30.0, False), (True, "NEAR_INTERSECTION_APPROACH", 31.0, False), (True, "NEAR_INTERSECTION_EXIT", 16.0, False), (True, "NEAR_INTERSECTION_EXIT", None, False), (True, "OFF_MAP", 1.0, False)]
    got = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i int, v boolean, r string, d double, w boolean").orderBy("i").select(kernels.road_class(F.col("v"), F.col("r"), F.col("d"), F.col("w")).alias("c")).collect()
    assert [r.c for r in got] == ["UNKNOWN", "PARKING_LOT_PROXY", "INTERSECTION", "INTERSECTION", "ROAD_SEGMENT", "ROAD_SEGMENT", "ROAD_SEGMENT", "UNKNOWN"]


def test_mean_over_keys_of_the_best_replica(spark):
    df = spark.createDataFrame([("a", 1, 4.0, True), ("a", 1, 2.0, True), ("a", 2, 1.0, True), ("a", 2, 9.0, True), ("b", 1, 3.0, True), ("b", 2, 5.0, True), ("c", 1, 1.0, False)], "k string, r int, d double, v boolean")
    assert aggregates.min_over_replicas(df, ["k"], "r", "d", "v").first().value == pytest.approx((6.0 / 2 + 3.0) / 2, abs=1e-5)


@pytest.mark.parametrize("seed", range(3))
def test_exact_percentiles_match_numpy(spark, seed):
    rng = np.random.default_rng(seed)
    data = {"a": np.round(rng.normal(size=501), 1), "b": rng.normal(size=7), None: np.full(300, 5.0), "d": np.array([1.0])}
    df = spark.createDataFrame([(k, float(v)) for k, own in data.items() for v in own] + [("a", None)], "k string, v double")
    got = {r.k: (r.lo, r.mid, r.hi) for r in aggregates.exact_percentiles(df, ["k"], "v", {"lo": 0.01, "mid": 0.5, "hi": 0.95}, 8).collect()}
    assert set(got) == set(data)
    for k, own in data.items():
        assert got[k] == pytest.approx(tuple(np.percentile(own, [1, 50, 95])))


def test_nearest_token_in_blocks(spark):
    rng = np.random.default_rng(8)
    words, points = rng.normal(size=(37, 4)), rng.normal(size=(50, 4))
    words[9] = words[3]
    points[0] = words[3]
    frame = lambda v: spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id long, v array<double>")
    d2 = ((points[:, None] - words[None]) ** 2).sum(axis=2)
    for block in (5, 100):
        got = joins.nearest_token(frame(points), frame(words).withColumnsRenamed({"id": "t", "v": "w"}), "id", "v", "t", "w", block).orderBy("id").collect()
        assert [r.token for r in got] == d2.argmin(axis=1).tolist() and np.allclose([r.d2 for r in got], d2.min(axis=1))


def test_incremental_spread_keeps_its_digits(spark, tmp_path):
    spark.createDataFrame([("a", 2, 1e9 + 0.5, 0.5, 1e9, 1e9 + 1.0), ("a", 2, 1e9 + 2.5, 0.5, 1e9 + 2, 1e9 + 3.0)], "k string, n long, mean double, m2 double, lo double, hi double").write.parquet(str(tmp_path / "p"))
    got = incremental.moments(spark, str(tmp_path / "p"), ["k"]).first()
    assert got.n == 4 and got["std"] == pytest.approx(np.std([0, 1, 2, 3]), abs=1e-6)


def test_tag_texts(spark):
    texts = ["Stopping(7,ego at 12-30)", "LeftTurnTemporal(5 at 0-9)", "LeftTurn( 5 at 0-9 )", "Jump(1 at 0-9)", "Parked(1 at 9-9)", "Parked 1 at 0-9", None, " KeepSpeed(a,,b at 3-4) "]
    df = spark.createDataFrame([("s", 99, t) for t in texts], "scenario string, me long, entry string")
    want = [("7", "Stopping", 12, 30), ("99", "Stopping", 12, 30), ("5", "LeftTurn", 0, 9), ("a", "KeepSpeed", 3, 4), ("b", "KeepSpeed", 3, 4)]
    assert rows(intervals.parsed_tags(df, "entry", list(labels.TAG_PHRASES), "me"), "agent", "action", "start", "end") == sorted(want)
    assert len(rows(intervals.parsed_tags(df, "entry", list(labels.TAG_PHRASES)), "agent")) == 4


def test_prompts_of_missing_scenes(spark):
    agents_ = spark.createDataFrame([("s1", 1), ("s1", 2), ("s2", 1)], "scenario string, agent long")
    mapping = spark.createDataFrame([("s1", "x")], "scenario string, scene string")
    found = spark.createDataFrame([("x", 1, "go"), ("y", 1, "no")], "scene string, agent long, prompt string")
    assert rows(joins.prompts_for(agents_, mapping, found), "scenario", "agent", "prompt", "has_prompt") == [("s1", 1, "go", True), ("s1", 2, "", False), ("s2", 1, "", False)]


def lane_change_by_loop(d, heading, lane_heading, run=8):
    """(first, last, direction) of the lane changes of one track, frame by frame."""
    n, diff = len(d), np.diff(d)
    out = []
    for c in [0, *[i for i in range(1, n - 1) if diff[i - 1] * diff[i] < 0]]:
        part = diff[c : c + run]
        if c + run >= n or not ((part > 0).all() or (part < 0).all()) or abs(d[c]) > 0.75:
            continue
        up = part[0] > 0
        e = next((i for i in range(c, n - 1) if (diff[i] <= 0 if up else diff[i] >= 0)), None)
        if e is None or e + 1 >= n or d[e] * d[e + 1] >= 0 or abs(d[e]) < 1.25 or abs(d[e + 1]) < 1.25:
            continue
        fits = [i for i in range(e + 2, n) if math.acos(max(-1.0, min(1.0, math.cos(heading[i] - lane_heading[i])))) < math.radians(5) and abs(d[i]) < 0.55]
        if fits:
            out.append((c, fits[0], "left" if up else "right"))
    return out


def test_lane_changes_match_a_loop(spark):
    rng = np.random.default_rng(6)
    data, want = [], []
    for track in range(40):
        d = []
        while len(d) < 60:
            d += [(-0.5 + 0.45 * k) for k in range(rng.integers(7, 12))] + [-1.6 + 0.4 * k for k in range(rng.integers(1, 6))] + rng.normal(0, 0.3, rng.integers(0, 4)).tolist()
        d = np.array(d[:60]) * rng.choice([-1, 1])
        heading = rng.choice([0.0, 0.05, 0.2], 60)
        data += [(track, i, float(d[i]), float(heading[i]), 0.0) for i in range(60)]
        want += [(track, *x) for x in lane_change_by_loop(d, heading, np.zeros(60))]
    df = spark.createDataFrame(data, "k int, f int, offset double, heading double, lane_heading double")
    assert rows(lanes.lane_changes(df, ["k"], "f"), "k", "start", "end", "direction") == sorted(want) and len(want) > 20


def test_lane_offsets_signs_and_ties(spark):
    lane = spark.createDataFrame([("s", 1, [(0.0, 0.0), (10.0, 0.0)]), ("s", 2, [(0.0, 0.0), (0.0, 10.0)]), ("s", 3, [(5.0, 5.0)])], "scene string, lane int, points array<struct<x:double,y:double>>")
    points = spark.createDataFrame([("s", 0, 0.0, 1.0), ("s", 1, 10.0, -2.0), ("s", 2, 1.0, 11.0)], "scene string, frame int, x double, y double")
    got = lanes.lane_offsets(points, lanes.lane_vertices(lane, ["scene"], "lane", "points"), ["scene"], ["frame"], "lane")
    assert rows(got, "frame", "lane", "offset") == [(0, 1, 1.0), (1, 1, -2.0), (2, 2, -math.sqrt(2))]


def box_polygon(x, y, h, length, width):
    c, s = math.cos(h), math.sin(h)
    return [np.array([x + a * c - b * s, y + a * s + b * c]) for a, b in ((length / 2, width / 2), (-length / 2, width / 2), (-length / 2, -width / 2), (length / 2, -width / 2))]


def polygon_distance(a, b):
    """Signed distance of the origin from the convex hull of all differences of corners."""
    points = sorted({(round(float(p[0] - q[0]), 12), round(float(p[1] - q[1]), 12)) for p in a for q in b})
    half = lambda ps: [h for h in [[]] for p in ps if not [h.pop() for _ in iter(lambda: len(h) > 1 and (h[-1][0] - h[-2][0]) * (p[1] - h[-2][1]) - (h[-1][1] - h[-2][1]) * (p[0] - h[-2][0]) <= 0, False)] or True if h.append(p) or True][:1]
    lower, upper = half(points)[0], half(points[::-1])[0]
    hull = lower[:-1] + upper[:-1]
    inside, best = True, math.inf
    for p, q in zip(hull, hull[1:] + hull[:1], strict=True):
        e = np.array(q) - np.array(p)
        t = max(0.0, min(1.0, float(-np.array(p) @ e / (e @ e))))
        best = min(best, float(np.linalg.norm(np.array(p) + t * e)))
        inside &= e[0] * -p[1] - e[1] * -p[0] >= 0
    return -best if inside else best


def test_box_distances_match_polygons(spark):
    rng = np.random.default_rng(9)
    boxes = [(1, i, *rng.uniform(-6, 6, 2).tolist(), float(rng.uniform(-3, 3)), float(rng.uniform(2, 6)), float(rng.uniform(1, 2.5))) for i in range(14)] + [(2, 99, 0.0, 0.0, 0.0, 4.0, 2.0)]
    df = spark.createDataFrame(boxes, "step int, id int, x double, y double, heading double, length double, width double")
    got = {r.id: r.distance for r in lanes.nearest_object(df, ["step"]).collect()}
    for b in boxes[:-1]:
        want = math.inf
        for o in boxes[:-1]:
            if o[1] != b[1]:
                off = [min(x[5], x[6]) * 0.7 / 2 for x in (b, o)]
                want = min(want, polygon_distance(box_polygon(*b[2:5], b[5] - 2 * off[0], b[6] - 2 * off[0]), box_polygon(*o[2:5], o[5] - 2 * off[1], o[6] - 2 * off[1])) - sum(off))
        assert got[b[1]] == pytest.approx(want, abs=1e-6)
    assert got[99] == lanes.FAR_AWAY


def test_features_and_shapes(spark):
    states = [(1, f, float(f * f), [3.0, -3.0, 3.1][f % 3], f not in (2, 5), [0.0, 4.0, 6.0][f % 3]) for f in range(7)] + [(2, f, 0.0, 0.0, f < 3, 1.0) for f in range(7)]
    df = spark.createDataFrame(states, "k int, f int, x double, heading double, valid boolean, length double")
    got = agents.agent_features(df, ["k"], "f", 4, ["x"]).orderBy("f").collect()
    ok = [f for f in range(7) if f not in (2, 5)]
    assert [r.k for r in got] == [1] * 7 and [r.x for r in got] == pytest.approx(np.interp(range(7), ok, [f * f for f in ok]).tolist())
    assert [r.heading for r in got] == pytest.approx(np.interp(range(7), ok, np.unwrap([states[f][3] for f in ok])).tolist())
    shapes = rows(agents.causal_shapes(df, ["k"], "f", "valid", ["length"], 3), "k", "length")
    assert shapes == [(1, 4.0), (2, 1.0)]  # frame 3 has no length: the mean of the valid positive ones before


def test_endpoint_dynamics_match_numpy(spark):
    rng = np.random.default_rng(12)
    x, y, h = rng.normal(0, 0.02, (3, 6)).cumsum(axis=1)
    g = lambda v: np.gradient(v, 0.1, edge_order=2)
    ax, ay, turn = g(g(x))[-1], g(g(y))[-1], g(np.unwrap(h))[-1]
    want = np.clip([ax * np.cos(h[5]) + ay * np.sin(h[5]), turn, ay * np.cos(h[5]) - ax * np.sin(h[5])], [-15, -3, -15], [15, 3, 15])
    got = spark.createDataFrame([(x.tolist(), y.tolist(), h.tolist())], "x array<double>, y array<double>, h array<double>").select(agents.endpoint_dynamics(F.col("x"), F.col("y"), F.col("h")).alias("d")).first().d
    assert list(got) == pytest.approx(want.tolist())


def test_lookup_and_samples(spark):
    table_ = spark.createDataFrame([(1, 2.0), (2, 3.0)], "t int, v double")
    assert rows(agents.looked_up(spark.createDataFrame([(1,), (1,), (2,)], "t int"), table_, ["t"], ["v"]), "t", "v") == [(1, 2.0), (1, 2.0), (2, 3.0)]
    with pytest.raises(Exception, match="no entry for 7"):
        agents.looked_up(spark.createDataFrame([(7,)], "t int"), table_, ["t"], ["v"]).collect()
    logits = spark.createDataFrame([(k, t, [0.0, 2.0, 1.0][t]) for k in range(400) for t in range(3)], "k int, t int, l double")
    assert {r.t for r in agents.sampled_tokens(logits, ["k"], "t", "l", 1).collect()} == {1}
    drawn = [r.t for r in agents.sampled_tokens(logits, ["k"], "t", "l", 2).collect()]
    assert set(drawn) == {1, 2} and abs(drawn.count(1) / 400 - math.e / (1 + math.e)) < 0.1
    assert rows(agents.sampled_tokens(logits, ["k"], "t", "l", 2), "k", "t") == rows(agents.sampled_tokens(logits, ["k"], "t", "l", 2), "k", "t")


def test_heading_flips_and_residuals(spark):
    h = [0.0, 0.1, 3.1, 3.0, 0.2, 0.1, 3.1, 0.1, 0.0, 0.1, 0.0]
    df = spark.createDataFrame([(1, i, x, True) for i, x in enumerate(h)], "k int, f int, h double, v boolean")
    assert rows(filters.heading_flips(df, ["k"], "f", "h", "v", math.radians(120), math.radians(45), 3), "f") == [(2,), (3,), (4,), (5,), (6,)]
    x = [0.0, 1.0, 2.0, 50.0, *[float(i) for i in range(4, 24)]]
    line = spark.createDataFrame([(1, i, v, True) for i, v in enumerate(x)], "k int, f int, x double, v boolean")
    got = filters.residual_outliers(line, ["k"], "f", "f", "x", "v", 1.0)
    assert rows(got.where("rejected"), "f") == [(3,)]
