"""Exact top-k search by inner product over multi-resolution segment statistics.

A vector is cut into 1, 4, 16, ... segments. With segments of length L, means m and deviations s, the squared distance of
two vectors is at least the sum of L * ((m - m')**2 + (s - s')**2), and since |q - x|**2 = |q|**2 + |x|**2 - 2 q.x, a
lower bound of the distance is an upper bound of the inner product. Bounds go from coarse to fine; a pair whose bound
falls short of its query's threshold is dropped, and what survives is computed exactly, in integers. A query enters a block
at the coarsest level that drops nearly all of a few rows of the block; where none does, its bounds would cost more than
the exact products, which are taken at once.

Components become floor(scale * x). Rows are ordered by the signs of their segment means, coarse to fine, and written as
blocks of bounded size; the envelope of each level can rule a whole block out for a query. The first threshold of a query
is its k-th best score among the rows of the block that holds it. Groups of query blocks meet groups of row blocks, all of
bounded size, in one grouped function, which raises the thresholds from block to block and gives at most k + 1 rows for each
query.

Of equal vectors only the k + 1 smallest ids can be in a result (ties go to smaller ids, and one may be the query's own),
so a large group of copies is cut to these before it is shuffled to one place, and equal queries are searched once.

Defined cases: rows with a null id, a null vector, or a null or non-finite component take no part; a zero vector and an
empty one do. Vectors of different lengths are not compared. A row that repeats (id and vector) counts once; a query's own
rows are those with its id. Scores beyond 64 bits count as the nearest 64-bit integer. An empty table gives an empty
result. Other columns are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, small_batches

ROWS, QUERIES = 4096, 1024  # most rows and queries of a block, about
BLOCK_NUMBERS = 1 << 19  # most numbers of a block of rows: longer vectors make blocks of fewer rows
GROUP, GROUP_BYTES = 64, 32 << 20  # most blocks and bytes, about, of rows or queries that meet in one group
WAVES = 4  # groups for each core, where the blocks are so many
SLICE = 2048  # rows after which a block's thresholds are raised
PROBES = 64  # rows of a block that choose the level of a query
DENSE = 0.01  # share of surviving pairs above which a matrix product is cheaper than pair by pair
LIMIT = 1 << 63


def integers(vector: Column, scale: int = 256) -> Column:
    """floor(scale * x) of every component; null for vectors that are null or hold null or non-finite components."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.when(fine, F.transform(vector, lambda x: F.floor(F.lit(float(scale)) * x.cast("double"))))


def lengths(v: np.ndarray) -> np.ndarray:
    return np.linalg.norm(v.astype(np.float64), axis=1)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a @ b.T of 64-bit integers, exactly: in floats or doubles where they hold every partial sum, else in unbounded integers, cut to 64 bits."""
    most = float(lengths(a).max(initial=0)) * float(lengths(b).max(initial=0))  # bounds the sum of any of the terms
    for kind, hold in ((np.float32, 2**24), (np.float64, 2**52)):
        if most < hold:
            return a.astype(kind) @ b.astype(kind).T
    return np.clip(a.astype(object) @ b.astype(object).T, -LIMIT, LIMIT - 1).astype(np.int64).reshape(len(a), len(b))


def exact_products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return products(a, b).astype(np.int64)


def exact_pairs(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The same for rows side by side."""
    most = float(lengths(a).max(initial=0)) * float(lengths(b).max(initial=0))
    if most < 2**52:
        return np.einsum("ij,ij->i", a.astype(np.float64), b.astype(np.float64)).astype(np.int64)
    return np.clip((a.astype(object) * b.astype(object)).sum(axis=1), -LIMIT, LIMIT - 1).astype(np.int64)


def levels(d: int) -> list[np.ndarray]:
    """Segment borders of each level, coarse to fine; the finest has segments of about two components."""
    out, n = [], 1
    while n <= max(1, d // 4):
        out.append(np.linspace(0, d, n + 1).astype(np.int64))
        n *= 4
    if d >= 4 and len(out[-1]) - 1 != d // 2:
        out.append(np.linspace(0, d, d // 2 + 1).astype(np.int64))
    return out


def statistics(v: np.ndarray, borders: np.ndarray) -> np.ndarray:
    """Means, then deviations, of the segments, both times the root of their length: products of two rows bound theirs."""
    n = np.diff(borders)
    means = np.add.reduceat(v, borders[:-1], axis=1) / n
    spread = np.add.reduceat((v - np.repeat(means, n, axis=1)) ** 2, borders[:-1], axis=1)
    return np.concatenate([means * np.sqrt(n), np.sqrt(spread)], axis=1)


def sign_code(v: np.ndarray) -> np.ndarray:
    """Signs of the segment means, coarse to fine, as one number: vectors of one code are alike at every level."""
    code = np.zeros(len(v), np.int64)
    for borders in levels(v.shape[1])[:3] if v.shape[1] else []:
        for bit in (statistics(v, borders)[:, : len(borders) - 1] >= 0).T:
            code = code * 2 + bit
    return code


def matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    return flat.reshape(len(column), -1) if len(flat) else np.zeros((len(column), 0), np.int64)


def by_length(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.RecordBatch]]:
    """Rows (.., x) of one length at a time; x is the last column."""
    for batch in batches:
        n = batch.column(batch.num_columns - 1).value_lengths().to_numpy(zero_copy_only=False)
        for d in np.unique(n):
            yield int(d), batch.take(pa.array(np.flatnonzero(n == d)))


def code_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for d, rows in by_length(batches):
        x = rows.column(rows.num_columns - 1)
        yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(sign_code(matrix(x).astype(np.float64))), pa.array(np.full(len(x), d, np.int32))], [*rows.schema.names, "code", "d"])


def packed(ids: np.ndarray, x: np.ndarray) -> tuple[pa.Array, pa.Array]:
    """The ids, and the vectors in the narrowest integers that hold them."""
    kind = next((t for t in ("<i2", "<i4") if not x.size or (x.min() >= np.iinfo(t).min and x.max() <= np.iinfo(t).max)), "<i8")
    return pa.array([ids.astype("<i8").tobytes()], pa.binary()), pa.array([x.astype(kind).tobytes()], pa.binary())


def unpacked(ids: bytes, x: bytes, d: int) -> tuple[np.ndarray, np.ndarray]:
    ids = np.frombuffer(ids, "<i8")
    return ids, np.frombuffer(x, f"<i{len(x) // max(1, len(ids) * d) or 8}").astype(np.int64).reshape(len(ids), d)


def row_blocks(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """id, query (its number, or null), d, x in order -> blocks (d, ids, x) and, in rows of their own, the thresholds of the queries in them."""

    def emit(d: int, held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(held).combine_chunks()
        ids, query = table["id"].to_numpy(), table["query"]
        x = matrix(table["x"].combine_chunks())
        here = np.flatnonzero(query.is_valid().to_numpy())
        names = query.to_numpy()[here].astype(np.int64) if len(here) else np.zeros(0, np.int64)
        least = []
        for row in exact_products(x[here], x) if len(here) else []:
            least.append(int(np.partition(row, len(row) - k)[len(row) - k]) if len(row) >= k else -LIMIT)
        packed_ids, packed_x = packed(ids, x)
        yield pa.RecordBatch.from_arrays([pa.array([d], pa.int32()), packed_ids, packed_x, pa.array([names.tolist()], pa.list_(pa.int64())), pa.array([least], pa.list_(pa.int64()))], ["d", "ids", "x", "queries", "least"])

    last, held, n = -1, [], 0
    for d, rows in by_length(batches):
        room = max(1, min(ROWS, BLOCK_NUMBERS // max(1, d)))
        if d != last and n:
            yield from emit(last, held)
            held, n = [], 0
        last = d
        while rows.num_rows:
            some = rows.slice(0, room - n)
            held.append(some)
            n, rows = n + some.num_rows, rows.slice(some.num_rows)
            if n == room:
                yield from emit(d, held)
                held, n = [], 0
    if n:
        yield from emit(last, held)


def query_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """query, least, d, x in order -> blocks (d, queries, least, x)."""
    for d, rows in by_length(batches):
        for lo in range(0, rows.num_rows, room := max(1, min(QUERIES, BLOCK_NUMBERS // max(1, d)))):
            some = rows.slice(lo, room)
            names, x = packed(some.column(0).to_numpy(), matrix(some.column(3)))
            yield pa.RecordBatch.from_arrays([pa.array([d], pa.int32()), names, pa.array([some.column(1).to_numpy().astype("<i8").tobytes()], pa.binary()), x], ["d", "queries", "least", "q"])


class Best:
    """The k best (score descending, id ascending) rows of each query so far; least is what a row must reach."""

    def __init__(self, least: np.ndarray, k: int):
        self.least, self.held = least.copy(), np.zeros(len(least), np.int64)
        self.ids, self.scores = np.zeros((len(least), k), np.int64), np.zeros((len(least), k), np.int64)

    def add(self, query: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        if not len(query):
            return
        k, met = self.ids.shape[1], np.unique(query)
        old, place = np.nonzero(np.arange(k) < self.held[met, None])
        old = met[old]
        query, ids, scores = np.concatenate([old, query]), np.concatenate([self.ids[old, place], ids]), np.concatenate([self.scores[old, place], scores])
        order = np.lexsort((ids, ~scores, query))
        query, ids, scores = query[order], ids[order], scores[order]
        rank = np.arange(len(query)) - np.searchsorted(query, query)
        query, ids, scores, rank = (z[rank < k] for z in (query, ids, scores, rank))
        self.ids[query, rank], self.scores[query, rank] = ids, scores
        np.maximum.at(self.held, query, rank + 1)
        full = query[rank == k - 1]
        self.least[full] = np.maximum(self.least[full], self.scores[full, k - 1])

    def all(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        query, place = np.nonzero(np.arange(self.ids.shape[1]) < self.held[:, None])
        return query, self.ids[query, place], self.scores[query, place]


class Block:
    """Vectors of one length with their statistics at each level, in floats, if doubles hold the products."""

    def __init__(self, ids: np.ndarray, x: np.ndarray):
        self.ids, self.x, self.norms = ids, x, lengths(x)
        self.longest = float(self.norms.max(initial=0))
        self.floats = x.astype(np.float32) if self.longest < 2**24 else None
        v = x.astype(np.float64)
        self.stats = [statistics(v, b).astype(np.float32) for b in levels(x.shape[1])] if x.shape[1] >= 2 and self.longest < 2**51 else []
        self.low, self.high = [s.min(axis=0) for s in self.stats], [s.max(axis=0) for s in self.stats]


def pairs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """np.nonzero of a mask with few hits: eight places are looked at as one number."""
    flat = mask.ravel()
    whole = len(flat) // 8 * 8
    at = (np.flatnonzero(flat[:whole].view(np.uint64))[:, None] * 8 + np.arange(8)).ravel()
    return np.divmod(np.concatenate([at[flat[at]], whole + np.flatnonzero(flat[whole:])]), max(1, mask.shape[1]))


def search_block(q: Block, best_rows: Best, rows: Block) -> None:
    """Every query of q meets every row; what reaches its threshold goes to best_rows."""
    live, least, d = np.arange(len(q.ids)), best_rows.least, rows.x.shape[1]
    slack = (q.norms * rows.longest * (d + 16) * 2.0**-22 + 1e-3).astype(np.float32)  # of rounding in the bounds
    bounded = bool(q.stats) and bool(rows.stats) and q.longest * rows.longest < 2**52
    bar = lambda own: (least[own] - slack[own].astype(np.float64)).astype(np.float32)[:, None]
    if bounded:
        for sq, low, high in zip(q.stats, rows.low, rows.high, strict=True):  # the envelope of the block: the highest product of each statistic
            live = live[np.maximum(sq[live] * high, sq[live] * low).sum(axis=1, dtype=np.float64) + slack[live] >= least[live]]
    # The coarsest level that leaves few of some rows; queries for which there is none meet the rows in a matrix product.
    level = np.full(len(q.ids), -1)
    if bounded and len(live):
        step = max(1, len(rows.ids) // PROBES)
        for i in reversed(range(len(q.stats))):
            few = (q.stats[i][live] @ rows.stats[i][::step].T >= bar(live)).mean(axis=1) <= DENSE
            level[live[few]] = i
    met = [live[level[live] == i] for i in range(-1, len(q.stats) if bounded else 0)]
    for lo in range(0, len(rows.ids) if len(live) else 0, SLICE):
        part = slice(lo, lo + SLICE)
        if len(own := met[0]):
            if rows.floats is not None and q.floats is not None and q.longest * rows.longest < 2**24:
                scores = q.floats[own] @ rows.floats[part].T  # as in products
            else:
                scores = products(q.x[own], rows.x[part])
            a, b = pairs(scores >= least[own, None].astype(scores.dtype))
            best_rows.add(own[a], rows.ids[part][b], scores[a, b].astype(np.int64))
        for i, own in enumerate(met[1:]):
            if len(own):
                a, b = pairs(q.stats[i][own] @ rows.stats[i][part].T >= bar(own))
                a, b = own[a], b + lo
                for sq, sx in zip(q.stats[i + 1 :], rows.stats[i + 1 :], strict=True):
                    ok = np.einsum("ij,ij->i", sq[a], sx[b]) >= bar(a)[:, 0]
                    a, b = a[ok], b[ok]
                scores = exact_pairs(q.x[a], rows.x[b])
                ok = scores >= least[a]
                best_rows.add(a[ok], rows.ids[b[ok]], scores[ok])


def search_group(queries: pa.Table, rows: pa.Table, k: int) -> pa.Table:
    """Blocks (d, queries, least, q) and (d, ids, x) of one length -> (query, id, score): the k best rows of each query, if not below its threshold."""
    asked = []
    for d, names, least, q in zip(*(queries.column(c).to_pylist() for c in ("d", "queries", "least", "q")), strict=True):
        asked.append((Block(*unpacked(names, q, d)), Best(np.frombuffer(least, "<i8"), k)))
    for i in range(rows.num_rows):
        d, ids, x = (rows.column(c)[i].as_py() for c in ("d", "ids", "x"))
        block = Block(*unpacked(ids, x, d))
        for q, best_rows in asked:
            search_block(q, best_rows, block)
    found = [(q.ids[query], ids, scores) for q, best_rows in asked for query, ids, scores in [best_rows.all()]]
    none = np.zeros(0, np.int64)
    return pa.table([pa.array(np.concatenate(z)) for z in zip((none, none, none), *found, strict=True)], ["query", "id", "score"])


def in_groups(left: DataFrame, right: DataFrame, name: str, count: int) -> tuple[DataFrame, DataFrame]:
    """Both sides dealt by d and the column, so that groups seldom share a task."""
    return tuple(side.repartition(4 * count, "d", name) for side in (left, right))


def top_products(vectors: DataFrame, k: int = 5, every: int = 50, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 256) -> DataFrame:
    """query_id, rank (from 1), id_col, score: for each row whose id is divisible by `every`, its k highest inner products with other rows."""
    spark = vectors.sparkSession
    small_batches(spark)
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), integers(F.col(vector_col), scale).alias("x")).where("id is not null and x is not null")
    asked = cut(rows.where(F.col("id") % every == 0).distinct(), "queries")
    queries = cut(asked.select("x").distinct().withColumn("query", F.monotonically_increasing_id()), "query_vectors")
    # The sizes of vectors are hidden by their encoding in files, so tables of them are joined by a sort, not sent by the driver.
    # Copies beyond the k + 1 smallest ids cannot be in a result; Spark limits each group in the tasks before the shuffle.
    rows = rows.distinct().withColumn("copy", F.row_number().over(Window.partitionBy("x").orderBy("id"))).where(F.col("copy") <= k + 1)
    rows = rows.withColumn("lead", F.col("copy") == 1).join(queries.hint("merge"), "x", "left").select("id", F.when(F.col("lead"), F.col("query")).alias("query"), "x")
    kind = "array<bigint>"
    coded = rows.mapInArrow(code_batches, f"id long, query long, x {kind}, code long, d int")
    ordered = cut(coded, "coded").repartitionByRange("d", "code", "id").sortWithinPartitions("d", "code", "id")
    blocks = ordered.select("id", "query", "d", "x").mapInArrow(lambda it: row_blocks(it, k + 1), "d int, ids binary, x binary, queries array<long>, least array<long>")
    blocks = cut(blocks.withColumn("block", F.monotonically_increasing_id()), "blocks")
    least = blocks.select(F.explode(F.arrays_zip("queries", "least")).alias("z")).select(F.col("z.queries").alias("query"), F.col("z.least").alias("least"))
    coded_queries = queries.join(least.hint("merge"), "query").select("query", "least", "x").mapInArrow(code_batches, f"query long, least long, x {kind}, code long, d int")
    packed_queries = coded_queries.repartitionByRange("d", "code", "query").sortWithinPartitions("d", "code", "query").select("query", "least", "d", "x")
    packed_queries = cut(packed_queries.mapInArrow(query_blocks, "d int, queries binary, least binary, q binary"), "query_blocks")
    # Groups of rows meet groups of queries: each of bounded size, and so many that all tasks have work.
    n, size = blocks.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.length("ids") + F.length("x")), F.lit(0))).first()
    asking, asking_size = packed_queries.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.length("queries") + F.length("q")), F.lit(0))).first()
    across = max(1, -(-asking // GROUP), -(-asking_size // GROUP_BYTES))
    down = max(1, -(-n // GROUP), -(-size // GROUP_BYTES), min(n, -(-WAVES * spark.sparkContext.defaultParallelism // across)))
    # The blocks of a partition are numbered in turn, so they are dealt out evenly.
    dealt = lambda number, groups: F.pmod(F.xxhash64(F.shiftright(number, 33)) + number.bitwiseAND((1 << 33) - 1), F.lit(groups))
    every_group = lambda groups: F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))
    left = packed_queries.withColumn("column", dealt(F.monotonically_increasing_id(), across)).withColumn("row", every_group(down))
    right = blocks.select("d", "ids", "x", dealt(F.col("block"), down).alias("row")).withColumn("column", every_group(across))
    left, right = in_groups(*(side.withColumn("cell", F.col("row") * across + F.col("column")).drop("row", "column") for side in (left, right)), "cell", across * down)
    found = left.groupBy("d", "cell").cogroup(right.groupBy("d", "cell")).applyInArrow(lambda q, x: search_group(q, x, k + 1), "query long, id long, score long")
    order = Window.partitionBy("query").orderBy(F.desc("score"), "id")
    top = cut(found.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k + 1), "found")
    named = asked.join(queries.hint("merge"), "x").select(F.col("id").alias("query_id"), "query")
    met = named.join(top, "query").where("id <> query_id")
    ranked = met.withColumn("rank", F.row_number().over(Window.partitionBy("query_id", "query").orderBy(F.desc("score"), "id")))
    return ranked.where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias(id_col), "score")
