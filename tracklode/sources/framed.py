"""Framed record files of any size, read in byte ranges from an offset index, and written.

A frame is a 64-bit little-endian length, 4 bytes of checksum, the payload and 4 bytes of checksum; checksums are not
verified. Such a file has no marks to start from in its middle, so a first job walks the lengths (it seeks past large
payloads) and writes an index: a row for each range of whole frames of about SPLIT_BYTES, with the size and the time of
the file. Counting needs nothing else. Reading deals the ranges to tasks, so that a file of any size is read by many, and
fails if a file's size or time is not that of the index, before or after the read. Truncated files are an error of the walk.

Files are opened with pyarrow's file systems (local, HDFS, S3, GCS) and listed by Spark.
"""

from __future__ import annotations

import re
import struct
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .store import written

SPLIT_BYTES = 128 << 20
BATCH_BYTES = 8 << 20
WALK_BYTES = 1 << 18  # read at once while walking over short payloads
INDEX = "path string, size long, modified long, first_index long, begin long, end long, records long"
RAW = "path string, record_index long, payload binary"
#: Fixed value: the form of numbered shard names, as in events-00003-of-00012.
NUMBERED = r"^(.*)-(\d{5})-of-(\d{5})([^/]*)$"
#: A list of at most so many keys is broadcast; a longer one is joined by a shuffle.
BROADCAST_KEYS = 1_000_000


def located(path: str) -> tuple[pafs.FileSystem, str]:
    if path.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")
    return pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path)


def require_same(path: str, size: int, modified: int) -> None:
    """modified: milliseconds."""
    fs, place = located(path)
    info = fs.get_file_info(place)
    now = info.size, None if info.mtime_ns is None else info.mtime_ns // 1_000_000
    if now[0] != size or now[1] not in (None, modified):
        raise ValueError(f"{path} changed: size {now[0]}, time {now[1]}, in the index {size}, {modified}")


def shards(spark: SparkSession, *paths: str, pattern: str = "*") -> DataFrame:
    """(path, size, modified in ms) of the files under folders, patterns and files.

    No file, two of one name, or a gap in numbered shards is an error. Files of no bytes hold no record; Spark does not list
    them as rows, but they count as shards.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(list(paths))
    names = [f.rpartition("/")[2] for f in files.inputFiles()]
    if not names:
        raise ValueError(f"no files: {', '.join(paths)}")
    twice = sorted(n for n, k in Counter(names).items() if k > 1)
    if twice:
        raise ValueError(f"files with the same name: {twice[0]}")
    sets: dict[tuple[str, ...], set[int]] = {}
    for m in filter(None, map(re.compile(NUMBERED).match, names)):
        sets.setdefault((m[1], m[3], m[4]), set()).add(int(m[2]))
    for (stem, of, _), found in sets.items():
        if found != set(range(int(of))):
            raise ValueError(f"{stem}: {len(found)} of {int(of)} numbered files")
    return files.select("path", F.col("length").alias("size"), F.unix_millis("modificationTime").alias("modified"))


def walk(path: str, size: int, split: int) -> Iterator[tuple[int, int, int, int]]:
    """(first record, begin, end, records) of ranges of whole frames of at least split bytes (the last may be shorter)."""
    fs, place = located(path)
    with fs.open_input_file(place) as f:
        at = begin = first = n = 0
        block, start, length = b"", 0, 0
        while at < size:
            if at + 12 > size:
                raise ValueError(f"{path}: truncated header of record {first + n}")
            if not start <= at <= start + len(block) - 12:
                block, start = f.read_at(12 if length > WALK_BYTES else min(WALK_BYTES, size - at), at), at
            (length,) = struct.unpack_from("<Q", block, at - start)
            if at + 16 + length > size:
                raise ValueError(f"{path}: truncated payload of record {first + n}")
            at, n = at + 16 + length, n + 1
            if at - begin >= split:
                yield first, begin, at, n
                begin, first, n = at, first + n, 0
        if n:
            yield first, begin, at, n


def walk_batches(batches: Iterator[pa.RecordBatch], split: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, size, modified in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            require_same(path, size, modified)
            found = list(walk(path, size, split))
            require_same(path, size, modified)
            same = [pa.array([x] * len(found), t) for x, t in ((path, pa.string()), (size, pa.int64()), (modified, pa.int64()))]
            yield pa.RecordBatch.from_arrays([*same, *(pa.array(z, pa.int64()) for z in zip(*found, strict=True))], [x.split()[0] for x in INDEX.split(", ")])


def index_files(files: DataFrame, path: str | None = None, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """The index of shards(), written to path (or a new place in the shared folder)."""
    return written(files.select("path", "size", "modified").mapInArrow(lambda it: walk_batches(it, split_bytes), INDEX), "index", path)


def count_records(index: DataFrame, limit: int | None = None) -> DataFrame:
    """(path, records); with limit, the counts of the first so many records in path order."""
    per = index.groupBy("path").agg(F.sum("records").alias("records"))
    if limit is None:
        return per
    before = F.coalesce(F.sum("records").over(Window.orderBy("path").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row for each file
    return per.withColumn("before", before).select("path", F.greatest(F.lit(0), F.least("records", F.lit(limit) - F.col("before"))).cast("long").alias("records"))


def range_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, size, modified, first, begin, end, _ in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            require_same(path, size, modified)
            fs, place = located(path)
            with fs.open_input_file(place) as f:
                f.seek(begin)
                at, number, held, some = begin, first, [], 0
                while at < end:
                    (length,) = struct.unpack("<Q", f.read(12)[:8])
                    held.append(f.read(length))
                    f.read(4)
                    at, some = at + 16 + length, some + length
                    if some >= BATCH_BYTES or at >= end:
                        yield pa.RecordBatch.from_arrays([pa.array([path] * len(held), pa.string()), pa.array(range(number, number + len(held)), pa.int64()), pa.array(held, pa.binary())], ["path", "record_index", "payload"])
                        number, held, some = number + len(held), [], 0
            require_same(path, size, modified)


def read_index(index: DataFrame) -> DataFrame:
    """(path, record_index, payload) of all records, a task for each range."""
    return index.repartition(max(1, index.count())).select([x.split()[0] for x in INDEX.split(", ")]).mapInArrow(range_batches, RAW)


def read_selected(index: DataFrame, start: int = 0, limit: int | None = None) -> DataFrame:
    """read_index() with global_index, the place in path order, of the records from start on, at most limit; other ranges are not read."""
    totals = index.groupBy("path").agg(F.sum("records").alias("n"))
    before = totals.select("path", F.coalesce(F.sum("n").over(Window.orderBy("path").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))  # a row for each file
    placed = written(index.join(F.broadcast(before) if before.count() <= BROADCAST_KEYS else before, "path"), "selected")
    first = F.col("before") + F.col("first_index")
    wanted = placed.where(first + F.col("records") > start)
    if limit is not None:
        wanted = wanted.where(first < start + limit)
    offsets = placed.select("path", "before").distinct()
    got = read_index(wanted).join(F.broadcast(offsets) if offsets.count() <= BROADCAST_KEYS else offsets, "path").withColumn("global_index", F.col("before") + F.col("record_index")).drop("before")
    return got.where(F.col("global_index") >= start) if limit is None else got.where(F.col("global_index").between(start, start + limit - 1))


def with_ids(rows: DataFrame, ids: DataFrame, key: str = "scenario_id") -> DataFrame:
    """Rows whose key is in ids (a table with that column)."""
    ids = ids.select(key).distinct()
    return rows.join(F.broadcast(ids) if ids.count() <= BROADCAST_KEYS else ids, key, "left_semi")


def write_batches(batches: Iterator[pa.RecordBatch], folder: str) -> Iterator[pa.RecordBatch]:
    """file, payload in order -> (file, records, bytes); a file appears under its name when it is whole."""
    fs, place = located(folder)
    fs.create_dir(place, recursive=True)
    name, out, n, total, done = None, None, 0, 0, []

    def close() -> None:
        if out is not None:
            out.close()
            fs.move(f"{place}/_{name}.{n_task}", f"{place}/{name}")
            done.append((name, n, total))

    from pyspark import TaskContext

    n_task = TaskContext.get().taskAttemptId()
    for batch in batches:
        for file, payload in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            if file != name:
                close()
                name, n, total = file, 0, 0
                out = fs.open_output_stream(f"{place}/_{name}.{n_task}")
            data = payload.as_py()
            out.write(struct.pack("<Q", len(data)) + b"\0\0\0\0" + data + b"\0\0\0\0")
            n, total = n + 1, total + 16 + len(data)
    close()
    if done:
        yield pa.RecordBatch.from_arrays([pa.array(z) for z in zip(*done, strict=True)], ["file", "records", "bytes"])


def write_records(rows: DataFrame, folder: str, file: str = "file", order: str = "order", payload: str = "payload", files: int = 1) -> DataFrame:
    """(file, records, bytes): rows become frames of the files they name, in order; each file is written by one task of `files`."""
    dealt = rows.select(F.col(file).alias("file"), F.col(order).alias("order"), F.col(payload).alias("payload")).repartition(files, "file").sortWithinPartitions("file", "order")
    return written(dealt.select("file", "payload").mapInArrow(lambda it: write_batches(it, folder), "file string, records long, bytes long"), "shards")
