"""Ranked lexical search over hashed max-sketches.

A document's term counts are folded into a sketch: a term has HASHES coordinates, by its hash, and a coordinate keeps the
largest count folded into it. A term's impact on the score grows with its count, so once the corpus totals are known, the
impact of the smallest count at a term's coordinates is at least the term's own. The width follows the document's number
of distinct terms, so long documents stay as selective as short ones. Counts are kept in a byte, exact to 128 and rounded
up beyond.

1. One scan of the texts writes the sketches beside the texts and counts the documents that hold each query term.
2. Batched lookups in the sketches alone bound every document's score for every item (a matrix product of impacts and
   query weights). The documents of each item's highest bounds are scored exactly, four times as many in each round, until
   `top` of them have a score above 0, no further bound is above 0, or ROUNDS is reached: the least of those scores is the
   threshold, which is 1 where fewer have one.
3. Documents whose bound reaches their item's threshold are scored exactly; no other document can be among the top.

Items are taken in chunks of bounded size; what is sent to tasks is one chunk. No list of documents passes the driver.

Defined cases: terms are the maximal runs of ASCII letters, digits and characters beyond ASCII, with only A-Z lower-cased;
null and empty texts have no term, and such an item has no result; an empty table of either kind gives an empty result.
Rows of documents that repeat are documents of their own. A document with a null id counts and is ranked, after others of
equal score. Items that repeat (id and text) count once; one id with several texts is several items. A null item id is an
id like any other. Other columns of either table are not read, whatever their names.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, small_batches

#: A chunk has about so many items and characters of them; a longer item makes a larger chunk.
CHUNK_ITEMS, CHUNK_CHARS = 256, 200_000
#: A list of at most so many candidates is broadcast to its texts; a longer one is joined by a shuffle.
BROADCAST_CANDIDATES = 500_000
#: Coordinates for each term, the least ratio of a sketch's width to the document's distinct terms, the least width.
HASHES, SPREAD, LEAST_WIDTH = 3, 8, 512
#: Rounds of exact scores that look for a threshold; results do not depend on it.
ROUNDS = 3

_TERM_BYTES = {*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)}
_FOLD = bytes(b + 32 if 0x41 <= b <= 0x5A else b if b in _TERM_BYTES else 0x20 for b in range(256))
#: Counts that a byte of a sketch stands for, 0 first.
LEVELS = np.concatenate([np.arange(129), np.ceil(128 * 1.2 ** np.arange(1, 127))]).astype(np.int64)


def terms(text: bytes | None) -> list[bytes]:
    return text.translate(_FOLD).split() if text else []


def coordinates(hashes: np.ndarray, width: int) -> np.ndarray:
    """(HASHES, term): coordinates below width, a power of two, by multiplicative hashing of 32-bit hashes."""
    odd = np.array([0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xC2B2AE3D27D4EB4F], np.uint64)[:HASHES, None]
    return ((hashes.astype(np.uint64) * odd) >> np.uint64(65 - width.bit_length())).astype(np.int64)


def sketch(counts: dict[bytes, int]) -> np.ndarray:
    """A byte for each coordinate."""
    n = len(counts)
    out = np.zeros(max(LEAST_WIDTH, 1 << (SPREAD * n - 1).bit_length()), np.uint8)
    level = np.searchsorted(LEVELS, np.fromiter(counts.values(), np.int64, n)).astype(np.uint8)
    at = coordinates(np.fromiter(map(crc32, counts), np.int64, n), len(out))
    for row in at:
        np.maximum.at(out, row, level)
    return out


def sketch_batches(batches: Iterator[pa.RecordBatch], wanted: frozenset[bytes]) -> Iterator[pa.RecordBatch]:
    """place, id, text -> those, n and sketch; the last row of a task holds its document frequencies of the wanted terms."""
    df: Counter[bytes] = Counter()
    schema = None
    for batch in batches:
        ns, sketches = [], []
        for x in batch.column(2).cast(pa.binary()):
            words = terms(x.as_py())
            counts = Counter(words)
            df.update(wanted.intersection(counts))
            ns.append(len(words))
            sketches.append(sketch(counts).tobytes() if words else None)
        nothing = pa.nulls(batch.num_rows, pa.list_(pa.binary()))
        out = pa.RecordBatch.from_arrays([*batch.columns, pa.array(ns, pa.int64()), pa.array(sketches, pa.binary()), nothing, pa.nulls(batch.num_rows, pa.list_(pa.int64()))], ["place", "id", "text", "n", "sketch", "df_terms", "df"])
        schema = out.schema
        yield out
    if schema is not None:
        yield pa.RecordBatch.from_arrays([*(pa.nulls(1, f.type) for f in list(schema)[:5]), pa.array([list(df)], pa.list_(pa.binary())), pa.array([list(df.values())], pa.list_(pa.int64()))], schema=schema)


@dataclass(frozen=True)
class Queries:
    """A chunk's distinct texts: the terms of each with repeats, and the weights of all those terms."""

    names: list[list[bytes]]
    n_docs: int
    n_terms: int
    weight: dict[bytes, int]

    def arrays(self) -> tuple[np.ndarray, np.ndarray]:
        """The hashes of the distinct terms, and (term, item): weight times the term's repeats in the item."""
        known = {t: i for i, t in enumerate(self.weight)}
        w = np.zeros((len(known), len(self.names)))
        for j, q in enumerate(self.names):
            for t, n in Counter(q).items():
                w[known[t], j] = n * self.weight[t]
        return np.fromiter(map(crc32, known), np.int64, len(known)), w

    def damping(self, n: int) -> int:
        """m of a document of n terms."""
        return 100 - 25 + (25 * n * self.n_docs) // self.n_terms

    def score(self, item: int, counts: dict[bytes, int], m: int) -> int:
        return sum(self.weight[t] * ((1_000_000_000 * tf) // (1000 * tf + 12 * m)) for t in self.names[item] if (tf := counts.get(t)))


def bounds(column: pa.Array, ns: np.ndarray, q: Queries, hashes: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """(document, item): an upper bound of the score, exact integers in doubles."""
    out = np.zeros((len(column), weights.shape[1]))
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(column.buffers()[2], np.uint8)
    widths = np.diff(offsets)
    m = np.array([q.damping(int(n)) for n in ns], np.int64)
    for width in np.unique(widths):
        rows, at = np.flatnonzero(widths == width), coordinates(hashes, int(width))
        step = max(1, (1 << 21) // max(int(width), len(hashes)))
        for some in np.split(rows, range(step, len(rows), step)):
            own = raw[offsets[some][:, None] + np.arange(width)]
            level = own[:, at[0]]
            for more in at[1:]:
                np.minimum(level, own[:, more], out=level)
            impact = (1_000_000_000 * LEVELS) // (1000 * LEVELS + 12 * m[some][:, None])
            out[some] = np.take_along_axis(impact.astype(np.float64), level.astype(np.int64), axis=1) @ weights
    return out


def bound_batches(batches: Iterator[pa.RecordBatch], q: Queries, top: int) -> Iterator[pa.RecordBatch]:
    """place, n, sketch -> (item, place, bound): the task's `top` highest bounds of each item."""
    hashes, weights = q.arrays()
    best = np.full((top, len(q.names)), -1.0)
    where = np.zeros((top, len(q.names)), np.int64)
    for batch in batches:
        if batch.num_rows:
            b = np.concatenate([best, bounds(batch.column(2), batch.column(1).to_numpy(), q, hashes, weights)])
            p = np.concatenate([where, np.repeat(batch.column(0).to_numpy()[:, None], len(q.names), axis=1)])
            keep = np.argpartition(-b, top - 1, axis=0)[:top]
            best, where = np.take_along_axis(b, keep, axis=0), np.take_along_axis(p, keep, axis=0)
    row, item = np.nonzero(best > 0)
    yield pa.RecordBatch.from_arrays([pa.array(item.astype(np.int32)), pa.array(where[row, item]), pa.array(best[row, item])], ["item", "place", "bound"])


def reaching_batches(batches: Iterator[pa.RecordBatch], q: Queries, least: np.ndarray) -> Iterator[pa.RecordBatch]:
    """place, n, sketch -> (place, items whose threshold the bound reaches)."""
    hashes, weights = q.arrays()
    for batch in batches:
        if batch.num_rows:
            row, item = np.nonzero(bounds(batch.column(2), batch.column(1).to_numpy(), q, hashes, weights) >= least)
            rows, first = np.unique(row, return_index=True)
            lists = pa.ListArray.from_arrays(pa.array(np.append(first, len(row)).astype(np.int32)), pa.array(item.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), lists], ["place", "items"])


def score_batches(batches: Iterator[pa.RecordBatch], q: Queries, least: np.ndarray) -> Iterator[pa.RecordBatch]:
    """id, text, items -> (item, id, score) of at least the item's threshold."""
    for batch in batches:
        item, at, scores = [], [], []
        for i, (text, items) in enumerate(zip(batch.column(1).cast(pa.binary()), batch.column(2), strict=True)):
            words = terms(text.as_py())
            counts, m = Counter(words), q.damping(len(words))
            for j in items.as_py():
                if (s := q.score(j, counts, m)) >= least[j]:
                    item.append(j)
                    at.append(i)
                    scores.append(s)
        yield pa.RecordBatch.from_arrays([pa.array(item, pa.int32()), batch.column(0).take(pa.array(at, pa.int32())), pa.array(scores, pa.int64())], ["item", "id", "score"])


def ranked(scores: DataFrame, top: int) -> DataFrame:
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("id"))
    return scores.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)


def rank_chunk(docs: DataFrame, texts: list[str], top: int) -> DataFrame | None:
    """(item: place in texts, rank, id, score); None if no document has a term."""
    spark = docs.sparkSession
    names = [terms(t.encode()) for t in texts]
    wanted = frozenset(t for q in names for t in q)
    id_type = docs.schema["id"].dataType.simpleString()
    schema = f"place long, id {id_type}, text string, n long, sketch binary, df_terms array<binary>, df array<long>"
    sketched = cut(docs.withColumn("place", F.monotonically_increasing_id()).select("place", "id", "text").mapInArrow(lambda it: sketch_batches(it, wanted), schema), "sketches")
    totals = sketched.agg(F.count_if(F.col("n") > 0), F.sum("n")).first()
    if not totals[1]:
        return None
    df = {bytes(r.term): r.df for r in sketched.where("df is not null").select(F.explode(F.arrays_zip("df_terms", "df")).alias("x")).groupBy(F.col("x.df_terms").alias("term")).agg(F.sum("x.df").alias("df")).collect()}
    q = Queries(names, totals[0], totals[1], {t: math.floor(1000 * math.log((2 * totals[0] + 2) / (2 * df.get(t, 0) + 1))) for t in wanted})
    light = sketched.where("sketch is not null").select("place", "n", "sketch")

    def scored(found: DataFrame, least: np.ndarray) -> DataFrame:
        found = cut(found, "candidates")
        few = found.count() <= BROADCAST_CANDIDATES
        met = sketched.where("sketch is not null").join(F.broadcast(found) if few else found, "place").select("id", "text", "items")
        return cut(met.mapInArrow(lambda it: score_batches(it, q, least), f"item int, id {id_type}, score long"), "scores")

    least, seeds = np.ones(len(texts), np.int64), 2 * top
    for _ in range(ROUNDS):
        high = light.mapInArrow(lambda it, k=seeds: bound_batches(it, q, k), "item int, place long, bound double")
        high = high.withColumn("k", F.row_number().over(Window.partitionBy("item").orderBy(F.desc("bound"), "place"))).where(F.col("k") <= seeds)
        high = cut(high.select("item", "place"), "seeds")
        first = scored(high.groupBy("place").agg(F.collect_list("item").alias("items")), np.ones(len(texts), np.int64))
        for r in ranked(first, top).where(F.col("rank") == top).select("item", "score").collect():  # at most a row for each item of the chunk
            least[r.item] = r.score
        full = {r.item for r in high.groupBy("item").count().where(F.col("count") == seeds).collect()}
        if all(least[i] > 1 for i in full):
            break
        seeds *= 4
    return ranked(scored(light.mapInArrow(lambda it: reaching_batches(it, q, least), "place long, items array<int>"), least), top)


def top_documents(documents: DataFrame, items: DataFrame, top: int = 20, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", chunk_items: int = CHUNK_ITEMS) -> DataFrame:
    """item_col, rank (from 1), id_col, score: each item's `top` highest-scoring documents with a score above 0."""
    spark = documents.sparkSession
    small_batches(spark)
    docs = documents.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    wanted = cut(items.where(F.col(item_text_col).isNotNull()).select(F.col(item_col).alias("item_id"), F.col(item_text_col).alias("text")).distinct(), "items")
    n, chars = wanted.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.length("text")), F.lit(0))).first()
    chunks = max(1, -(-n // chunk_items), -(-chars // CHUNK_CHARS))
    parts = []
    for k in range(chunks):
        own = wanted.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(chunks)) == k).collect() if n else []
        own = [r for r in own if terms(r.text.encode())]
        texts = sorted({r.text for r in own})
        got = rank_chunk(docs, texts, top) if texts else None
        if got is not None:
            place = {t: i for i, t in enumerate(texts)}
            names = spark.createDataFrame([(place[r.text], r.item_id) for r in own], f"item int, item_id {wanted.schema['item_id'].dataType.simpleString()}")
            parts.append(got.join(F.broadcast(names), "item").select("item_id", "rank", "id", "score"))
    empty = docs.where("false").select(F.lit(None).cast(wanted.schema["item_id"].dataType).alias("item_id"), F.lit(0).alias("rank"), "id", F.lit(0).cast("long").alias("score"))
    return reduce(DataFrame.unionByName, parts, empty).select(F.col("item_id").alias(item_col), F.col("rank").cast("int").alias("rank"), F.col("id").alias(id_col), "score")
