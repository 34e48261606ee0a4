"""Road edges, relations, detours and mixtures against plain loops; readers of rows and annotations."""

import gzip
import json
import math
import random

import duckdb
import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructType

from tracklode.operators import edges
from tracklode.plans.queries import SQL
from tracklode.plans.roads import closed_detours, mixture_loss, nearest_mode_loss, neighbour_relations, road_edges
from tracklode.sources import annotations

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("query", [road_edges, neighbour_relations, closed_detours, mixture_loss, nearest_mode_loss])
def test_queries_equal_their_sql(spark, query):
    c = duckdb.connect()
    c.execute(f"CREATE VIEW events AS SELECT * FROM '{SF}/events.parquet'")
    want = c.sql(SQL[query.__name__])
    got = query(spark, SF).select(*want.columns).collect()
    assert sorted(map(tuple, got), key=str) == sorted(want.fetchall(), key=str) and got


def test_road_edge_distances(spark):
    line = spark.createDataFrame([("s", [(0.0, 5.0), (10.0, 5.0), (10.0, 5.0), (10.0, -5.0)]), ("one", [(1.0, 1.0)])], "k string, p array<struct<x:double,y:double>>")
    segments = edges.edge_segments(line, ["k"], "p")
    assert segments.count() == 2
    points = spark.createDataFrame([("s", 1, 4.0, 0.0, math.pi / 2), ("s", 2, 4.0, 0.0, 0.0), ("none", 3, 0.0, 0.0, 0.0)], "k string, n int, x double, y double, heading double")
    got = {r.n: tuple(None if v is None else round(v, 6) for v in (r.nearest, r.ahead, r.behind)) for r in edges.road_edge_distances(points, segments, ["k"], ["n"], 30.0).collect()}
    assert got == {1: (5.0, 5.0, None), 2: (5.0, 6.0, None), 3: (None, None, None)}


def test_neighbour_relation(spark):
    long, start, end, apart = [(0.0, 0.0), (20.0, 0.0)], [(0.0, 3.0), (10.0, 3.0)], [(10.0, 3.0), (20.0, 3.0)], [(0.0, 50.0), (5.0, 50.0)]
    rows = [(1, long, [(0.0, 3.0), (20.0, 3.0)]), (2, long, start), (3, long, end), (4, long, apart), (5, start, long)]
    df = spark.createDataFrame(rows, "n int, a array<struct<x:double,y:double>>, b array<struct<x:double,y:double>>")
    got = {r.n: r.r for r in df.select("n", edges.neighbour_relation(F.col("a"), F.col("b")).alias("r")).collect()}
    assert got == {1: "complete", 2: "side-start", 3: "side-end", 4: "other", 5: "other"}


def test_closed_detours_match_loops(spark):
    rng = random.Random(4)
    rows = [(k, f, f * 0.1, f + (rng.random() < 0.2) * rng.uniform(-6, 6), rng.random(), rng.random() < 0.9) for k in range(6) for f in range(30)]
    rows += [(9, 0, 0.0, 0.0, 0.0, True), (9, 1, 0.0, 9.0, 0.0, True), (9, 2, 0.2, 0.0, 0.0, True)]  # times that do not rise
    df = spark.createDataFrame(rows, "k int, f int, t double, x double, y double, v boolean")
    want = set()
    for k in range(6):
        p = [r for r in rows if r[0] == k and r[5]]
        for i in range(len(p)):
            for j in range(i + 2, min(len(p), i + 10)):
                way = sum(math.dist(p[n][3:5], p[n + 1][3:5]) for n in range(i, j))
                direct = math.dist(p[i][3:5], p[j][3:5])
                if way - direct <= 1.0 or way <= 2.5 * max(direct, 1e-6):
                    continue
                off = []
                for q in p[i + 1 : j]:
                    s = (q[2] - p[i][2]) / (p[j][2] - p[i][2])
                    off.append(math.dist(q[3:5], [p[i][c] + s * (p[j][c] - p[i][c]) for c in (3, 4)]))
                if max(off) > 0.75:
                    want |= {(k, q[1]) for q in p[i + 1 : j]}
    got = {tuple(r) for r in edges.closed_detours(df, ["k"], "f", "t", "x", "y", "v").collect()}
    assert got == want and want


def write(path, text):
    with (gzip.open(path, "wt") if str(path).endswith(".gz") else open(path, "w")) as f:
        f.write(text)
    return str(path)


def test_action_rows(spark, tmp_path):
    head = "scenario_id,global_index,dataset_current_time_index,frame_index,track_id,action,absolute_speed_mps,longitudinal_acceleration_mps2\n"
    turned = "action,track_id,frame_index,scenario_id,global_index,dataset_current_time_index,absolute_speed_mps,longitudinal_acceleration_mps2,more\n"
    a = write(tmp_path / "a.csv.gz", head + "s1,1,10,3,7,GO,1.5,0.25\n")
    b = write(tmp_path / "b.csv", turned + "STOP,8,4,s2,2,10,0,-1,x\n")
    got = annotations.read_action_rows(spark, [a, b]).orderBy("scenario_id").collect()
    assert [(r.scenario_id, r.track_id, r.action, r.absolute_speed_mps, r.longitudinal_acceleration_mps2) for r in got] == [("s1", 7, "GO", 1.5, 0.25), ("s2", 8, "STOP", 0.0, -1.0)]
    with pytest.raises(ValueError, match="track_id"):
        annotations.read_action_rows(spark, [write(tmp_path / "c.csv", head.replace("track_id,", ""))])
    for bad in ("s1,1,10,3,seven,GO,1.5,0.25\n", ",1,10,3,7,GO,1.5,0.25\n"):
        with pytest.raises(Exception, match="invalid track_id|empty scenario_id"):
            annotations.read_action_rows(spark, [write(tmp_path / f"d{len(bad)}.csv", head + bad)]).collect()


def test_annotations(spark, tmp_path):
    line = lambda i, s, source="part 1.rec", version=2, **more: json.dumps({"schema_version": version, "source_file": source, "scenario_index": i, "scenario_id": s, **more})
    write(tmp_path / "part 1.rec.map-annotations.jsonl.gz", "\n".join([line(0, "a", lanes=4), "", line(1, "b"), line(2, "c", version=1), line(3, "d", source="other"), line(4, ""), line(None, "e"), line(5, "f", error="failed"), line(6, "g"), line(6, "h"), line(7, "b")]))
    write(tmp_path / "p2.map-annotations.jsonl", line(0, "a", source="p2", lanes=1) + "\n")
    records, faults = annotations.read_annotations(spark, str(tmp_path), StructType().add("lanes", LongType()), 2)
    assert sorted(tuple(r) for r in records.collect()) == [("p2", 0, "a", 1), ("part 1.rec", 0, "a", 4)]
    assert sorted((r.scenario_id, r.fault) for r in faults.collect()) == [("", "scenario_id"), ("b", "duplicate id"), ("b", "duplicate id"), ("c", "version"), ("d", "source"), ("e", "scenario_index"), ("g", "duplicate index"), ("h", "duplicate index")]
    assert annotations.sha256_of(spark, str(tmp_path)).count() == 2
