"""Hard negatives from a multiway hyperplane tree whose split points store distance ranges.

Each node of the tree has several split points and gives a row to the nearest one. For each pair of split points the
node stores the least and the greatest distance from the one to all rows under the other. What is asked of the tree is a
set of windows of the inner product around an anchor; on a sphere (each vector gets one more component that makes all
norms equal, an anchor gets a zero there) a window is an annulus of distances. A subtree is passed over if for each window
some split point's range and the anchor's distance to that point cannot meet the annulus. What is left is computed
exactly, in integers, in the leaves.

The split points are fitted on a sample of about SAMPLE rows; every row is then routed to its leaf and widens the ranges
on its way, so the answers are exact whatever the sample. Leaves of more than LEAF_ROWS rows are cut by a hash into parts.
Groups of anchors meet groups of parts, all of bounded size, in one grouped function; an anchor goes to those groups that
hold a part it has to visit, never to the driver, and gives at most k rows for each window and group. An anchor asks its
own leaf first: the k-th best score found there narrows each window before the tree is asked, and what a group has found
narrows it from part to part.

Two questions are asked: the best rows of the anchor's label (no lower end), then, in a window for each of those, the
best rows of other labels. Of rows that share vector and label only as many as a result can hold, by smallest id, are
kept; anchors that share both are asked about once.

Defined cases: rows with a null id, label or vector, or a null or non-finite component take no part; zero and empty
vectors do. Vectors of different lengths are not compared: each length has a tree of its own. A row that repeats (id,
label and vector) counts once; an anchor's own rows are those with its id. Scores beyond 64 bits count as the nearest
64-bit integer. An anchor without positives has no rows. An empty table gives an empty result. Other columns are not
read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, small_batches
from .segments import GROUP_BYTES, LIMIT, WAVES, Best, integers, lengths, matrix, packed, pairs, products, unpacked

SAMPLE = 8192  # rows that split points are chosen from, about
WAYS = 12  # split points of a node
LEAF_ROWS = 2048  # most rows of a part of a leaf, about
LEAF_NUMBERS = 1 << 18  # most numbers of such a part: longer vectors make smaller parts
BLOCK = 256  # anchors that meet a part at a time
ANCHORS = 16384  # anchors that meet a group of parts, about


@dataclass
class Tree:
    """points[n]: the split points of node n; children[n]: what is under each, a node, or -1 - leaf."""

    norm2: float  # the greatest squared norm of a row
    points: list[np.ndarray] = field(default_factory=list)
    children: list[np.ndarray] = field(default_factory=list)
    leaves: int = 1
    low: list[np.ndarray] = field(default_factory=list)  # low[n][i, j]: least distance from split point i to a row under j
    high: list[np.ndarray] = field(default_factory=list)

    def on_sphere(self, x: np.ndarray) -> np.ndarray:
        x = x.astype(np.float64)
        return np.concatenate([x, np.sqrt(np.maximum(0.0, self.norm2 - (x * x).sum(axis=1)))[:, None]], axis=1)


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None, :] - 2 * (a @ b.T)))


def spread_points(sample: np.ndarray, ways: int) -> np.ndarray:
    """Of the first 4 * ways rows, one, then each time that farthest from those chosen; fewer if the rest coincide."""
    some = sample[: 4 * ways]
    chosen, nearest = [0], distances(some, some[:1])[:, 0]
    while len(chosen) < ways and nearest.max() > 1e-6 * np.sqrt((some * some).sum(axis=1).max()):
        chosen.append(int(nearest.argmax()))
        nearest = np.minimum(nearest, distances(some, some[chosen[-1:]])[:, 0])
    return some[chosen]


def fit(sample: np.ndarray, rows: int, norm2: float, leaf_rows: int, ways: int = WAYS) -> Tree:
    """The tree of a sample (in random order) of so many rows: a node is split while its share of the rows exceeds a leaf."""
    tree = Tree(norm2)
    v = tree.on_sphere(sample)
    tree.leaves = 0

    def grow(own: np.ndarray) -> int:
        points = spread_points(own, ways) if len(own) >= 4 * ways and rows * len(own) > leaf_rows * len(v) else own[:0]
        if len(points) < 2:
            tree.leaves += 1
            return -tree.leaves
        n = len(tree.points)
        tree.points.append(points)
        tree.children.append(np.zeros(len(points), np.int64))
        tree.low.append(np.full((len(points), len(points)), np.inf))
        tree.high.append(np.full((len(points), len(points)), -np.inf))
        near = distances(own, points).argmin(axis=1)
        for j in range(len(points)):
            tree.children[n][j] = grow(own[near == j])
        return n

    grow(v)
    return tree


def route(tree: Tree, x: np.ndarray, widen: bool) -> np.ndarray:
    """The leaf of each row; with widen, the ranges on the way take the row in."""
    v, leaf = tree.on_sphere(x), np.zeros(len(x), np.int64)
    todo = [(0, np.arange(len(x)))] if tree.points else []
    while todo:
        n, own = todo.pop()
        d = distances(v[own], tree.points[n])
        near = d.argmin(axis=1)
        for j, child in enumerate(tree.children[n]):
            under = near == j
            if under.any():
                if widen:
                    tree.low[n][:, j] = np.minimum(tree.low[n][:, j], d[under].min(axis=0))
                    tree.high[n][:, j] = np.maximum(tree.high[n][:, j], d[under].max(axis=0))
                if child < 0:
                    leaf[own[under]] = -1 - child
                else:
                    todo.append((int(child), own[under]))
    return leaf


def route_batches(batches: Iterator[pa.RecordBatch], tree: Tree) -> Iterator[pa.RecordBatch]:
    """id, label, x -> those and leaf; the last row of a task has the ranges of its rows: node, place in its table, low, high."""
    schema = None
    for batch in batches:
        leaf = route(tree, matrix(batch.column(2)), widen=True)
        none = [pa.nulls(batch.num_rows, pa.list_(t)) for t in (pa.int32(), pa.int32(), pa.float64(), pa.float64())]
        out = pa.RecordBatch.from_arrays([*batch.columns, pa.array(leaf.astype(np.int32)), *none], ["id", "label", "x", "leaf", "node", "cell", "low", "high"])
        schema = out.schema
        yield out
    if schema is not None and tree.points:
        node = np.concatenate([np.full(t.size, n) for n, t in enumerate(tree.low)]).astype(np.int32)
        cell = np.concatenate([np.arange(t.size) for t in tree.low]).astype(np.int32)
        low, high = (np.concatenate([t.ravel() for t in side]) for side in (tree.low, tree.high))
        seen = high >= low
        yield pa.RecordBatch.from_arrays([*(pa.nulls(1, f.type) for f in list(schema)[:4]), *(pa.array([z[seen].tolist()], f.type) for z, f in zip((node, cell, low, high), list(schema)[4:], strict=True))], schema=schema)


def meeting(tree: Tree, x: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> dict[int, np.ndarray]:
    """leaf -> the anchors (rows of x) for which some window [lo, hi] of the inner product may have a row in it."""
    v = np.concatenate([x.astype(np.float64), np.zeros((len(x), 1))], axis=1)
    total = (v * v).sum(axis=1)[:, None] + tree.norm2
    near, far = (np.sqrt(np.maximum(0.0, total - 2 * np.clip(z.astype(np.float64), -total, total))) for z in (hi, lo))
    slack = 1e-6 * np.sqrt(total) + 1e-6
    out: dict[int, np.ndarray] = {}
    todo = [(0, np.arange(len(x)), lo <= hi)] if tree.points else []
    while todo:
        n, own, alive = todo.pop()
        d = distances(v[own], tree.points[n])[:, None, :, None]  # anchor, window, split point, sibling
        r1, r2 = (near[own] - slack[own])[:, :, None, None], (far[own] + slack[own])[:, :, None, None]
        meets = ((tree.low[n] <= d + r2) & (tree.high[n] >= np.maximum(d - r2, r1 - d))).all(axis=2) & alive[:, :, None]
        for j, child in enumerate(tree.children[n]):
            some = meets[:, :, j].any(axis=1)
            if some.any():
                if child < 0:
                    out[int(-1 - child)] = own[some]
                else:
                    todo.append((int(child), own[some], meets[some, :, j]))
    return out if tree.points else {0: np.flatnonzero((lo <= hi).any(axis=1))}


def window_arrays(batch: pa.RecordBatch, at: int) -> tuple[np.ndarray, np.ndarray]:
    """The columns at and at + 1 as (anchor, window) arrays; places without a window hold an empty one."""
    n = batch.column(at).value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    wide = max(1, int(n.max(initial=0)))
    inside = np.arange(wide) < n[:, None]
    out = [np.full((len(n), wide), z, np.int64) for z in (1, 0)]
    for k in (0, 1):
        out[k][inside] = batch.column(at + k).flatten().to_numpy()
    return out[0], out[1]


@dataclass
class Groups:
    """Where the parts of leaves are: their numbers run through the leaves, so many to a group."""

    parts: np.ndarray  # of each leaf
    size: int = 1

    def number(self, leaf: np.ndarray | int, part: np.ndarray | int) -> np.ndarray:
        return (np.cumsum(self.parts) - self.parts)[leaf] + part


def visit_batches(batches: Iterator[pa.RecordBatch], tree: Tree, groups: Groups, across: int, home: bool) -> Iterator[pa.RecordBatch]:
    """anchor, label, x, lo, hi -> blocks of anchors for each group with the parts they visit: with home, one part of the anchor's own leaf; else all others."""
    names = ["row", "column", "anchors", "labels", "lo", "hi", "visits", "d", "q"]
    for batch in batches:
        for start in range(0, batch.num_rows, BLOCK):
            some = batch.slice(start, BLOCK)
            anchor, label, x = some.column(0).to_numpy(), some.column(1).to_numpy().astype(np.int64), matrix(some.column(2))
            lo, hi = window_arrays(some, 3)
            own_leaf = route(tree, x, widen=False)
            own = groups.number(own_leaf, anchor % groups.parts[own_leaf])
            visits = np.zeros((len(anchor), int(groups.parts.sum())), bool)
            if not home:
                for leaf, met in meeting(tree, x, lo, hi).items():
                    first = int(groups.number(leaf, 0))
                    visits[met, first : first + int(groups.parts[leaf])] = True
            visits[np.arange(len(anchor)), own] = home
            for row in range(-(-visits.shape[1] // groups.size)):
                here = visits[:, row * groups.size : (row + 1) * groups.size]
                if len(at := np.flatnonzero(here.any(axis=1))):
                    packed_ids, packed_x = packed(anchor[at], x[at])
                    data = [pa.array([z[at].astype("<i8").tobytes()], pa.binary()) for z in (label, lo, hi)]
                    seen = pa.array([np.packbits(here[at], axis=1).tobytes()], pa.binary())
                    where = [pa.array([z], pa.int32()) for z in (row, int(anchor[0]) // BLOCK % across)]
                    yield pa.RecordBatch.from_arrays([*where, packed_ids, *data, seen, pa.array([x.shape[1]], pa.int32()), packed_x], names)


class Block:
    """Vectors with labels, and in floats where these hold them."""

    def __init__(self, ids: bytes, labels: bytes, x: bytes, d: int):
        (self.ids, self.x), self.labels = unpacked(ids, x, d), np.frombuffer(labels, "<i8")
        self.longest = float(lengths(self.x).max(initial=0))
        self.floats = self.x.astype(np.float32) if self.longest < 2**24 else None


class Asking(Block):
    """Anchors with the parts of a group that they visit, their windows and what was found in them; a window of an anchor is a query of best."""

    def __init__(self, ids: bytes, labels: bytes, lo: bytes, hi: bytes, visits: bytes, d: int, x: bytes, k: int):
        super().__init__(ids, labels, x, d)
        lo, self.hi = (np.frombuffer(z, "<i8").reshape(len(self.ids), -1) for z in (lo, hi))
        self.visits = np.unpackbits(np.frombuffer(visits, np.uint8).reshape(len(self.ids), -1), axis=1).astype(bool)
        self.best = Best(np.where(lo <= self.hi, lo, LIMIT - 1).ravel(), k)

    def ask(self, own: np.ndarray, part: Block, same: bool) -> None:
        if self.floats is not None and part.floats is not None and self.longest * part.longest < 2**24:
            scores = self.floats[own] @ part.floats.T  # as in products
        else:
            scores = products(self.x[own], part.x)
        least = self.best.least.reshape(self.hi.shape)[own]
        a, b = pairs(scores >= least.min(axis=1)[:, None].astype(scores.dtype))
        fit = (self.labels[own[a]] == part.labels[b]) == same
        a, b = a[fit], b[fit]
        score = scores[a, b].astype(np.int64)
        at, window = np.nonzero((score[:, None] >= least[a]) & (score[:, None] <= self.hi[own[a]]))
        self.best.add(own[a[at]] * self.hi.shape[1] + window, part.ids[b[at]], score[at])


def ask_group(anchors: pa.Table, parts: pa.Table, size: int, k: int, same: bool) -> pa.Table:
    """Blocks of anchors and parts (number, d, ids, labels, x) of a group -> (anchor, hi, id, score): the k best rows of each window."""
    asking = [Asking(*block, k) for block in zip(*(anchors.column(c).to_pylist() for c in ("anchors", "labels", "lo", "hi", "visits", "d", "q")), strict=True)]
    for i in range(parts.num_rows):
        number, d, ids, labels, x = (parts.column(c)[i].as_py() for c in ("number", "d", "ids", "labels", "x"))
        part = Block(ids, labels, x, d)
        for block in asking:
            if len(own := np.flatnonzero(block.visits[:, number % size])):
                block.ask(own, part, same)
    none = np.zeros(0, np.int64)
    found = [(none, none, none, none)]
    for block in asking:
        query, ids, scores = block.best.all()
        found.append((block.ids[query // block.hi.shape[1]], block.hi.ravel()[query], ids, scores))
    return pa.table([pa.array(np.concatenate(z)) for z in zip(*found, strict=True)], ["anchor", "hi", "id", "score"])


def packed_part(rows: pa.Table, groups: Groups) -> pa.Table:
    """leaf, part, id, label, x of a part -> its number, d, ids, labels, x in one row."""
    x = matrix(rows["x"].combine_chunks())
    ids, packed_x = packed(rows["id"].to_numpy(), x)
    labels = pa.array([rows["label"].to_numpy().astype("<i8").tobytes()], pa.binary())
    number = int(groups.number(rows["leaf"][0].as_py(), rows["part"][0].as_py()))
    return pa.table([pa.array([number], pa.int32()), pa.array([x.shape[1]], pa.int32()), ids, labels, packed_x], ["number", "d", "ids", "labels", "x"])


class Index:
    """The tree of the rows (id, label, x) of one length, and its packed leaves."""

    def __init__(self, rows: DataFrame, d: int):
        n, norm2 = rows.agg(F.count(F.lit(1)), F.max(F.aggregate("x", F.lit(0.0), lambda s, y: s + y.cast("double") * y.cast("double")))).first()
        share = F.pmod(F.xxhash64("id", "x"), F.lit(1 << 30)) < F.lit(int((1 << 30) * min(1.0, SAMPLE / n)))
        sample = rows.where(share).orderBy(F.xxhash64("x", "id")).limit(2 * SAMPLE).select("x").toArrow()["x"].combine_chunks()
        leaf_rows = max(1, min(LEAF_ROWS, LEAF_NUMBERS // max(1, d)))
        tree = fit(matrix(sample), n, norm2 * (1 + 1e-12), leaf_rows)
        kind = "id long, label long, x array<bigint>, leaf int, node array<int>, cell array<int>, low array<double>, high array<double>"
        routed = cut(rows.select("id", F.col("label").cast("long").alias("label"), "x").mapInArrow(lambda it: route_batches(it, tree), kind), "routed")
        cells = routed.where("node is not null").select(F.explode(F.arrays_zip("node", "cell", "low", "high")).alias("z")).groupBy("z.node", "z.cell").agg(F.min("z.low").alias("low"), F.max("z.high").alias("high"))
        for r in cells.collect():  # at most WAYS numbers for each split point
            tree.low[r.node].ravel()[r.cell], tree.high[r.node].ravel()[r.cell] = r.low, r.high
        routed = routed.where("leaf is not null")
        sizes = routed.groupBy("leaf").agg(F.ceil(F.count(F.lit(1)) / F.lit(leaf_rows)).cast("int").alias("parts"))
        parts = np.ones(max(1, tree.leaves), np.int64)
        for r in sizes.collect():  # a row for each leaf; leaves are fewer than the sample's rows
            parts[r.leaf] = r.parts
        spread = routed.join(F.broadcast(sizes), "leaf").withColumn("part", F.pmod(F.xxhash64("id", "x"), F.col("parts")).cast("int"))
        self.tree, self.groups = tree, Groups(parts)
        groups = Groups(parts)
        packs = spread.select("leaf", "part", "id", "label", "x").groupBy("leaf", "part").applyInArrow(lambda t: packed_part(t, groups), "number int, d int, ids binary, labels binary, x binary")
        self.leaves = cut(packs, "leaves")
        size = self.leaves.agg(F.sum(F.length("ids") + F.length("labels") + F.length("x"))).first()[0]
        total = int(parts.sum())
        self.groups.size = -(-total // max(1, -(-size // GROUP_BYTES), min(total, WAVES * rows.sparkSession.sparkContext.defaultParallelism)))

    def ask(self, anchors: DataFrame, k: int, same: bool) -> DataFrame:
        """anchors (anchor, label, x, lo, hi: arrays, the windows) -> (anchor, hi, id, score, rank): the k best rows in each window, by (score descending, id)."""
        tree, groups = self.tree, self.groups
        count, size = anchors.agg(F.count(F.lit(1)), F.coalesce(F.sum(8 * F.size("x")), F.lit(0))).first()
        across = max(1, -(-count // ANCHORS), -(-size // GROUP_BYTES))
        down = -(-int(groups.parts.sum()) // groups.size)
        kind = "row int, column int, anchors binary, labels binary, lo binary, hi binary, visits binary, d int, q binary"
        best_first = Window.partitionBy("anchor", "hi").orderBy(F.desc("score"), "id")
        parts = self.leaves.withColumn("row", F.floor(F.col("number") / groups.size).cast("int")).withColumn("column", F.explode(F.sequence(F.lit(0), F.lit(across - 1))))

        def met(asked: DataFrame, home: bool) -> DataFrame:
            visits = asked.select("anchor", "label", "x", "lo", "hi").mapInArrow(lambda it: visit_batches(it, tree, groups, across, home), kind)
            left, right = (side.repartition(4 * across * down, "row", "column").groupBy("row", "column") for side in (visits, parts))
            found = left.cogroup(right).applyInArrow(lambda q, x: ask_group(q, x, groups.size, k, same), "anchor long, hi long, id long, score long")
            return found.withColumn("rank", F.row_number().over(best_first)).where(F.col("rank") <= k)

        first = cut(met(anchors, True), "home")
        bars = first.where(F.col("rank") == k).groupBy("anchor").agg(F.map_from_entries(F.collect_list(F.struct("hi", "score"))).alias("bars"))
        raised = F.transform(F.arrays_zip("lo", "hi"), lambda w: F.greatest(w["lo"], F.element_at("bars", w["hi"])))
        narrowed = cut(anchors.join(bars.hint("merge"), "anchor", "left").withColumn("lo", F.when(F.col("bars").isNotNull(), raised).otherwise(F.col("lo"))), "narrowed")
        every = first.drop("rank").unionByName(met(narrowed, False).drop("rank"))
        return cut(every.withColumn("rank", F.row_number().over(best_first)).where(F.col("rank") <= k), "answers")


def mine_one_length(rows: DataFrame, d: int, anchors: DataFrame, positives: int, negatives: int, low: int, high: int) -> DataFrame:
    """rows and anchors: id, label, x, all of length d."""
    # The sizes of vectors are hidden by their encoding in files, so tables of anchors are joined by a sort, not sent by the driver.
    index = Index(rows, d)
    asked = cut(anchors.select("label", "x").distinct().withColumn("anchor", F.monotonically_increasing_id()), "anchors")
    named = anchors.join(asked.hint("merge"), ["label", "x"]).select(F.col("id").alias("anchor_id"), "anchor")
    whole = asked.withColumn("lo", F.array(F.lit(-LIMIT))).withColumn("hi", F.array(F.lit(LIMIT - 1)))
    friends = index.ask(whole, positives + 1, True).select("anchor", F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    wide = F.col("positive_score").cast("decimal(38,0)")
    ends = friends.where("positive_score >= 0").select("anchor", "positive_score", F.ceil(wide * low / 100).cast("long").alias("lo"), F.floor(wide * high / 100).cast("long").alias("hi")).distinct()
    ends = cut(ends.where("lo <= hi"), "windows")
    # Windows that end at one score start at the lowest of their beginnings here; each row is held against its own below.
    per_end = ends.groupBy("anchor", "hi").agg(F.min("lo").alias("lo"))
    windows = per_end.groupBy("anchor").agg(F.sort_array(F.collect_list(F.struct("hi", "lo"))).alias("w"))
    question = asked.join(windows.hint("merge"), "anchor").select("anchor", "label", "x", F.col("w.lo").alias("lo"), F.col("w.hi").alias("hi"))
    foes = index.ask(question, negatives, False).select("anchor", "hi", F.col("id").alias("negative_id"), F.col("score").alias("negative_score"), "rank")
    own = named.join(friends.hint("merge"), "anchor").where("positive_id <> anchor_id")
    own = own.withColumn("place", F.row_number().over(Window.partitionBy("anchor_id", "anchor").orderBy(F.desc("positive_score"), "positive_id"))).where(F.col("place") <= positives)
    met = own.join(ends.hint("merge"), ["anchor", "positive_score"]).join(foes.hint("merge"), ["anchor", "hi"]).where("negative_score >= lo")
    return met.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")


def hard_negatives(
    vectors: DataFrame, every: int = 100, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, id_col: str = "vec_id", vector_col: str = "embedding", label: Column | str = "label", scale: int = 256
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Anchors are the rows whose id is divisible by `every`; scores are inner products of the integer vectors. For each
    anchor and each of its best `positives` other rows of its label, the best `negatives` rows of other labels whose score
    lies between low and high percent of the positive's, ranked from 1; ties go to smaller ids.
    """
    spark = vectors.sparkSession
    small_batches(spark)
    label = F.col(label) if isinstance(label, str) else label
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), label.alias("label"), integers(F.col(vector_col), scale).alias("x")).where("id is not null and label is not null and x is not null")
    rows = rows.distinct().withColumn("d", F.size("x"))
    anchors = cut(rows.where(F.col("id") % every == 0), "asked")
    # Copies beyond what a result can hold, by smallest id, are left out; Spark limits each group in the tasks before the shuffle.
    copies = Window.partitionBy("x", "label").orderBy("id")
    rows = cut(rows.withColumn("copy", F.row_number().over(copies)).where(F.col("copy") <= max(positives + 1, negatives)).drop("copy"), "rows")
    lengths = [r.d for r in anchors.select("d").distinct().collect()]
    got = [mine_one_length(rows.where(F.col("d") == d), d, anchors.where(F.col("d") == d), positives, negatives, low, high) for d in sorted(lengths)]
    empty = anchors.where("false").select(F.col("id").alias("anchor_id"), F.col("id").alias("positive_id"), F.lit(0).alias("rank"), F.col("id").alias("negative_id"), F.col("id").alias("positive_score"), F.col("id").alias("negative_score"))
    return reduce(DataFrame.unionByName, got, empty)
