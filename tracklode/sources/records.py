"""Framed scenario records: splitting files into payloads, decoding payloads, and the long tables.

Files are read by Spark (any store it knows); a file is one row, split in the task that holds it. Frames are a 64-bit
little-endian length, 4 bytes of checksum, the payload and 4 bytes of checksum; checksums are not verified, truncation is
an error. Payloads are protocol-buffer messages; only the fields below are read.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Field numbers of the scenario messages, with their kinds (i: integer, d: double, f: float, b: bool, s: text;
# a nested table for a message; [] for repeated).
POINT = {1: ("x", "d"), 2: ("y", "d"), 3: ("z", "d")}
STATE = {2: ("center_x", "d"), 3: ("center_y", "d"), 4: ("center_z", "d"), 5: ("length", "f"), 6: ("width", "f"), 7: ("height", "f"), 8: ("heading", "f"), 9: ("velocity_x", "f"), 10: ("velocity_y", "f"), 11: ("valid", "b")}
TRACK = {1: ("id", "i"), 2: ("object_type", "i"), 3: ("states", [STATE])}
LANE_STATE = {1: ("lane", "i"), 2: ("state", "i"), 3: ("stop_point", POINT)}
NEIGHBOR = {1: ("feature_id", "i"), 2: ("self_start", "i"), 3: ("self_end", "i"), 4: ("nbr_start", "i"), 5: ("nbr_end", "i")}
LANE = {1: ("speed_limit_mph", "d"), 2: ("type", "i"), 3: ("interpolating", "b"), 8: ("points", [POINT]), 9: ("entry_lanes", ["i"]), 10: ("exit_lanes", ["i"]), 11: ("left_neighbors", [NEIGHBOR]), 12: ("right_neighbors", [NEIGHBOR])}
LINE = {1: ("type", "i"), 2: ("points", [POINT])}
STOP = {1: ("stop_lanes", ["i"]), 2: ("position", POINT)}
AREA = {1: ("points", [POINT])}
FEATURE = {1: ("id", "i"), 3: ("lane", LANE), 4: ("road_line", LINE), 5: ("road_edge", LINE), 7: ("stop_sign", STOP), 8: ("crosswalk", AREA), 9: ("speed_bump", AREA), 10: ("driveway", AREA)}
SCENARIO = {
    1: ("timestamps_seconds", ["d"]), 2: ("tracks", [TRACK]), 4: ("objects_of_interest", ["i"]), 5: ("scenario_id", "s"), 6: ("sdc_track_index", "i"), 7: ("dynamic_map_states", [{1: ("lane_states", [LANE_STATE])}]),
    8: ("map_features", [FEATURE]), 10: ("current_time_index", "i"), 11: ("tracks_to_predict", [{1: ("track_index", "i"), 2: ("difficulty", "i")}]),
}
KINDS = ["lane", "road_line", "road_edge", "stop_sign", "crosswalk", "speed_bump", "driveway"]


def varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = data[at]
        at += 1
        value |= (byte & 127) << shift
        if byte < 128:
            return value, at
        shift += 7


def scalar(kind: str, raw: int | bytes) -> object:
    if kind == "i":
        return raw - (1 << 64) if raw >= 1 << 63 else raw
    if kind == "b":
        return bool(raw)
    return raw.decode() if kind == "s" else struct.unpack("<d" if kind == "d" else "<f", raw)[0]


def decode(data: bytes, fields: dict) -> dict:
    """A message as a dict; repeated fields are lists, packed or not; unknown fields are skipped."""
    out: dict = {name: [] for name, kind in fields.values() if isinstance(kind, list)}
    at = 0
    while at < len(data):
        tag, at = varint(data, at)
        wire = tag & 7
        if wire == 0:
            raw, at = varint(data, at)
        else:
            size, at = varint(data, at) if wire == 2 else (8 if wire == 1 else 4, at)
            if at + size > len(data):
                raise ValueError("truncated message")
            raw, at = data[at : at + size], at + size
        if tag >> 3 not in fields:
            continue
        name, kind = fields[tag >> 3]
        one = kind[0] if isinstance(kind, list) else kind
        if isinstance(one, dict):
            values = [decode(raw, one)]
        elif wire == 2 and one in "idfb":  # packed
            values, p = [], 0
            while p < len(raw):
                if one in "ib":
                    v, p = varint(raw, p)
                else:
                    width = 8 if one == "d" else 4
                    v, p = raw[p : p + width], p + width
                values.append(scalar(one, v))
        else:
            values = [scalar(one, raw)]
        if isinstance(kind, list):
            out[name] += values
        else:
            out[name] = values[-1]
    return out


def encode_varint(value: int) -> bytes:
    value &= (1 << 64) - 1
    out = bytearray()
    while value > 127:
        out.append(value & 127 | 128)
        value >>= 7
    return bytes([*out, value])


def encode(message: dict, fields: dict) -> bytes:
    """The inverse of decode; None is left out."""
    out = b""
    for number, (name, kind) in fields.items():
        one = kind[0] if isinstance(kind, list) else kind
        for value in (message.get(name) or []) if isinstance(kind, list) else [message.get(name)]:
            if value is None:
                continue
            if isinstance(one, dict) or one == "s":
                body = encode(value, one) if isinstance(one, dict) else value.encode()
                out += encode_varint(number << 3 | 2) + encode_varint(len(body)) + body
            elif one in "ib":
                out += encode_varint(number << 3) + encode_varint(int(value))
            else:
                out += encode_varint(number << 3 | (1 if one == "d" else 5)) + struct.pack("<d" if one == "d" else "<f", value)
    return out


def frame(payload: bytes) -> bytes:
    """A record with empty checksums."""
    return struct.pack("<Q", len(payload)) + b"\0\0\0\0" + payload + b"\0\0\0\0"


def frames(data: bytes, path: str) -> Iterator[bytes]:
    at = 0
    while at < len(data):
        if at + 12 > len(data):
            raise ValueError(f"truncated record length in {path}")
        (size,) = struct.unpack_from("<Q", data, at)
        if at + 16 + size > len(data):
            raise ValueError(f"truncated record in {path}")
        yield data[at + 12 : at + 12 + size]
        at += 16 + size


RAW = "path string, record_index long, payload binary"
#: Python objects take some twenty times the bytes of Arrow's, so messages become objects by about so many bytes at a time.
PIECE_BYTES = 1 << 20


def pieces(batches: Iterator[pa.RecordBatch], most: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches, cut into slices of about `most` bytes, of one row at least."""
    for batch in batches:
        step = max(1, batch.num_rows * most // max(1, batch.nbytes))
        for at in range(0, batch.num_rows, step):
            yield batch.slice(at, step)


def split_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            payloads = list(frames(content.as_py(), path))
            yield pa.RecordBatch.from_arrays([pa.array([path] * len(payloads), pa.string()), pa.array(range(len(payloads)), pa.int64()), pa.array(payloads, pa.binary())], ["path", "record_index", "payload"])


def read_records(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(path, record_index, payload) of all records under path; two files with one base name are an error."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path).select("path", "content")
    twice = files.select("path").groupBy(F.element_at(F.split("path", "/"), -1)).count().where("count > 1").limit(1).collect()
    if twice:
        raise ValueError(f"files with the same name: {twice[0][0]}")
    return files.mapInArrow(split_batches, RAW)


_STATE = "center_x double, center_y double, center_z double, length double, width double, height double, heading double, velocity_x double, velocity_y double, valid boolean"
SCENARIOS = (
    "path string, record_index long, error string, scenario_id string, current_time_index int, sdc_track_index int, timestamps_seconds array<double>, objects_of_interest array<int>, "
    "tracks_to_predict array<struct<track_index:int,difficulty:int>>, "
    f"tracks array<struct<id:int,object_type:int,states:array<struct<{', '.join(x.replace(' ', ':') for x in _STATE.split(', '))}>>>>, "
    "dynamic_map_states array<struct<lane_states:array<struct<lane:bigint,state:int,stop_x:double,stop_y:double,stop_z:double>>>>, "
    "map_features array<struct<id:bigint,feature_kind:string,type:int,speed_limit_mph:double,points:array<struct<x:double,y:double,z:double>>,entry_lanes:array<bigint>,exit_lanes:array<bigint>,left_neighbors:array<bigint>,right_neighbors:array<bigint>,stop_lanes:array<bigint>>>"
)


def scenario_row(payload: bytes) -> dict:
    s = decode(payload, SCENARIO)
    s["dynamic_map_states"] = [{"lane_states": [{"lane": x.get("lane"), "state": x.get("state"), **{f"stop_{a}": x.get("stop_point", {}).get(a) for a in "xyz"}} for x in d["lane_states"]]} for d in s["dynamic_map_states"]]
    features = []
    for f in s["map_features"]:
        kind = next((k for k in KINDS if k in f), None)
        body = f.get(kind, {})
        points = [body["position"]] if kind == "stop_sign" and "position" in body else body.get("points", [])
        features.append({"id": f.get("id"), "feature_kind": kind, "type": body.get("type"), "speed_limit_mph": body.get("speed_limit_mph"), "points": points, **{k: body.get(k, []) for k in ("entry_lanes", "exit_lanes", "stop_lanes")}, **{k: [n.get("feature_id") for n in body.get(k, [])] for k in ("left_neighbors", "right_neighbors")}})
    s["map_features"] = features
    return s


def scenario_name(payload: Column) -> Column:
    """The scenario's id alone; null where the payload cannot be decoded."""

    def name(data: bytes) -> str | None:
        try:
            return decode(data, {5: SCENARIO[5]}).get("scenario_id")
        except (ValueError, IndexError, struct.error):
            return None

    @F.arrow_udf("string")
    def names(payloads: pa.Array) -> pa.Array:
        return pa.array((name(p.as_py()) for p in payloads), pa.string())

    return names(payload)


def scenarios(raw: DataFrame) -> DataFrame:
    """One row per record; a payload that cannot be decoded gives a row with its error instead of failing the job."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    schema = to_arrow_schema(StructType.fromDDL(SCENARIOS))

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(it):
            out = []
            for path, index, payload in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                row = dict.fromkeys(schema.names) | {"path": path, "record_index": index}
                try:
                    row |= scenario_row(payload)
                except (ValueError, IndexError, struct.error, UnicodeDecodeError, AttributeError) as fault:
                    row["error"] = f"{type(fault).__name__}: {fault}"
                out.append(row)
            yield pa.RecordBatch.from_pylist(out, schema)

    return raw.select("path", "record_index", "payload").mapInArrow(batches, SCENARIOS)


def track_states(s: DataFrame) -> DataFrame:
    """A row per track and frame."""
    t = s.select("scenario_id", "sdc_track_index", "timestamps_seconds", F.posexplode("tracks").alias("track_index", "t"))
    t = t.select("*", F.posexplode("t.states").alias("frame_index", "s"))
    return t.select(
        "scenario_id", "track_index", F.col("t.id").alias("track_id"), F.col("t.object_type").alias("object_type"), (F.col("track_index") == F.col("sdc_track_index")).alias("is_sdc"), "frame_index", F.get("timestamps_seconds", F.col("frame_index")).alias("t"),
        F.col("s.center_x").alias("x"), F.col("s.center_y").alias("y"), F.col("s.center_z").alias("z"), "s.length", "s.width", "s.height", "s.heading", F.col("s.velocity_x").alias("vx"), F.col("s.velocity_y").alias("vy"), F.coalesce("s.valid", F.lit(False)).alias("valid"),
    )


def map_points(s: DataFrame) -> DataFrame:
    f = s.select("scenario_id", F.explode("map_features").alias("f")).select("scenario_id", F.col("f.id").alias("feature_id"), "f.feature_kind", "f.type", F.posexplode("f.points").alias("point_index", "p"))
    return f.select("scenario_id", "feature_id", "feature_kind", "type", "point_index", "p.x", "p.y", "p.z")


def lane_edges(s: DataFrame) -> DataFrame:
    """(scenario_id, src, dst, kind): entry, exit, left and right."""
    f = s.select("scenario_id", F.explode("map_features").alias("f")).where("f.feature_kind = 'lane'")
    kinds = {"entry": "entry_lanes", "exit": "exit_lanes", "left": "left_neighbors", "right": "right_neighbors"}
    named = lambda kind: lambda d: F.struct(d.alias("dst"), F.lit(kind).alias("kind"))
    links = F.flatten(F.array(*[F.transform(f"f.{c}", named(k)) for k, c in kinds.items()]))
    return f.select("scenario_id", F.col("f.id").alias("src"), F.explode(links).alias("e")).select("scenario_id", "src", "e.dst", "e.kind")


def signals(s: DataFrame) -> DataFrame:
    d = s.select("scenario_id", F.posexplode("dynamic_map_states").alias("frame_index", "d")).select("scenario_id", "frame_index", F.explode("d.lane_states").alias("l"))
    return d.select("scenario_id", "frame_index", F.col("l.lane").alias("lane_id"), "l.state", "l.stop_x", "l.stop_y")


def signal_group(state: str):
    """Nine signal states as STOP, GO, CAUTION or UNKNOWN."""
    return F.when(F.col(state).isin(1, 4, 7), "STOP").when(F.col(state).isin(3, 6), "GO").when(F.col(state).isin(2, 5, 8), "CAUTION").otherwise("UNKNOWN")
