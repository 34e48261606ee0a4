"""Embedding near-dedup over a flat robust-pruned graph.

Equal vectors are one node, with a number of its own; components are named by ids at the end. Medoids (chosen from a bounded hash sample, their number following that of the nodes, half by density and half by
farthest distance) define shards; every node goes to its nearest few medoids, which makes the shards overlap, and a shard that is still
too large is split by a hash into parts of bounded size. Each part builds its own neighbour lists with robust pruning; the
lists of a node from all its parts are united, and the united lists are what the search walks: from the part's medoids it
expands greedily, keeps a beam, and once it is inside the similarity range it expands every node of the range. Found
pairs are verified by the cosine in double precision. A pair that meets in several parts is counted in the first one
only, so no pairs leave the tasks: counts do, and one edge for each node and part, which together are a spanning forest
of all pairs the part found. Queries of a split shard visit all its
parts. Recall is audited against brute force on a bounded sample of queries; while it is below the target, the index is
built and searched again with a wider beam and more shards for each node, at last with all.

Vectors of different lengths do not link; each length is a table of its own. The most common length, and any other of more
than a part's nodes, has its own graph; all shorter tables are compared exactly, each in one task.

Defined cases: a vector that is null, zero, or holds null or non-finite components links with nothing; rows with a null id
are dropped; rows that repeat an id are separate vectors under one id; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import connected_components, cut


@dataclass(frozen=True)
class Settings:
    threshold: float = 0.95
    part_nodes: int = 1500  # most nodes of a part, about
    overlap: int = 3  # shards for each node at least
    margin: float = 0.08  # further shards whose medoid is this much less similar than the nearest, up to 3 * overlap in all
    degree: int = 24  # most neighbours a part gives a node
    alpha: float = 1.2  # robust pruning
    beam: int = 24
    max_medoids: int = 4096
    sample: int = 8192  # rows that medoids are chosen from
    audit_queries: int = 400
    target_recall: float = 0.99


def unit(vectors: np.ndarray) -> np.ndarray:
    """Rows of length 1; each is scaled by its largest component first, whose square could leave the range of doubles."""
    vectors = vectors / np.abs(vectors).max(axis=1, keepdims=True, initial=0.0)
    return vectors / np.linalg.norm(vectors, axis=1, keepdims=True)


def matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 1)


def choose_medoids(sample: np.ndarray, wanted: int) -> np.ndarray:
    """Half of the medoids follow the sample's order (and so its density), half are the rows farthest from those before."""
    wanted = min(wanted, len(sample))
    chosen = list(range((wanted + 1) // 2))
    nearest = (sample @ sample[chosen].T).max(axis=1)
    while len(chosen) < wanted:
        chosen.append(int(nearest.argmin()))
        nearest = np.maximum(nearest, sample @ sample[chosen[-1]])
    return sample[chosen]


def assign_batches(batches: Iterator[pa.RecordBatch], medoids: np.ndarray, s: Settings) -> Iterator[pa.RecordBatch]:
    """node, v, shards (nearest first): the nearest few, and those about as near as the nearest."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sims = unit(matrix(batch.column(1))) @ medoids.T
        near = np.argsort(-sims, axis=1, kind="stable")[:, : 3 * s.overlap].astype(np.int32)
        by_rank = np.take_along_axis(sims, near.astype(np.int64), axis=1)
        keep = (np.arange(near.shape[1]) < s.overlap) | (by_rank >= by_rank[:, :1] - s.margin)
        offs = np.concatenate([[0], np.cumsum(keep.sum(axis=1))]).astype(np.int32)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.ListArray.from_arrays(pa.array(offs), pa.array(near[keep]))], ["node", "v", "shards"])


def robust_prune(sims: np.ndarray, degree: int, alpha: float, candidates: int = 96) -> list[np.ndarray]:
    """Neighbour lists: of a node's nearest candidates, one is kept unless a kept one is alpha times nearer to it."""
    m = len(sims)
    k = min(candidates, m - 1)
    dist = np.arccos(np.clip(sims, -1, 1))
    np.fill_diagonal(dist, np.inf)
    lists = []
    for i in range(m):
        near = np.argpartition(dist[i], k - 1)[:k] if k < m - 1 else np.flatnonzero(np.arange(m) != i)
        near = near[np.argsort(dist[i, near], kind="stable")]
        between = dist[np.ix_(near, near)]
        alive = np.ones(len(near), bool)
        kept: list[int] = []
        for c in range(len(near)):
            if alive[c]:
                kept.append(c)
                if len(kept) == degree:
                    break
                alive &= alpha * between[c] > dist[i, near]
        lists.append(near[kept])
    return lists


def build_part(part: pd.DataFrame, degree: int, alpha: float) -> pd.DataFrame:
    """(node, near): the part's neighbour lists."""
    nodes = part["node"].to_numpy()
    if len(nodes) < 2:
        return pd.DataFrame({"node": nodes, "near": [np.zeros(0, np.int64)] * len(nodes)})
    v = unit(np.stack(part["v"].to_numpy()).astype(np.float64))
    return pd.DataFrame({"node": nodes, "near": [nodes[x] for x in robust_prune(v @ v.T, degree, alpha)]})


def search(v: np.ndarray, graph: tuple[np.ndarray, np.ndarray], queries: np.ndarray, entries: np.ndarray, threshold: float, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """Range-expanding greedy search of many queries at once: (query, node) pairs with cosine of at least threshold."""
    offs, near = graph
    n_q, m = len(queries), len(v)
    sims = np.full((n_q, m), -2.0)
    done = np.zeros((n_q, m), bool)
    sims[:, entries] = queries @ v[entries].T
    live = np.arange(n_q)
    while len(live):
        # The beam: the best unexpanded nodes that are among the best `beam` seen, or inside the range.
        own = sims[live]
        cut_at = np.partition(own, m - beam, axis=1)[:, m - beam] if beam < m else np.full(len(live), -2.0)
        bar = np.maximum(np.minimum(cut_at, threshold), -1.5)
        want = (own >= bar[:, None]) & ~done[live]
        q, node = np.nonzero(want)
        if not len(q):
            break
        q = live[q]
        done[q, node] = True
        deg = offs[node + 1] - offs[node]
        at = np.repeat(offs[node], deg) + np.arange(deg.sum()) - np.repeat(np.cumsum(deg) - deg, deg)
        qq, nn = np.repeat(q, deg), near[at]
        new = np.unique((qq * m + nn)[sims[qq, nn] == -2.0])
        qq, nn = new // m, new % m
        sims[qq, nn] = np.einsum("ij,ij->i", queries[qq], v[nn])
        live = np.unique(q)
    return np.nonzero(sims >= threshold)


def merge_labels(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """label (the smallest place of each place's component) once the places a[i] and b[i] are linked too."""
    while True:
        low, high = np.minimum(label[a], label[b]), np.maximum(label[a], label[b])
        apart = low < high
        if not apart.any():
            return label
        parent = np.arange(len(label))
        np.minimum.at(parent, high[apart], low[apart])
        while (parent != parent[parent]).any():
            parent = parent[parent]
        label = parent[label]


def search_part(part: pd.DataFrame, threshold: float, beam: int, shard: int, block: int = 256) -> pd.DataFrame:
    """Links of the part's queries with its members: (node, links, low): links counted here, smallest node reached over all links found here.

    Rows: node, v, mult, shards, near (null for a query from another part of the shard).
    """
    member = part["member"].to_numpy(bool)
    nodes = part["node"].to_numpy()
    v_all = unit(np.stack(part["v"].to_numpy()).astype(np.float64))
    mult = part["mult"].to_numpy(np.int64)
    width = max(len(x) for x in part["shards"])
    shards = np.stack([np.concatenate([x, np.full(width - len(x), -1)]) for x in part["shards"]]).astype(np.int64)
    inside = np.flatnonzero(member)
    place = {n: i for i, n in enumerate(nodes[inside])}
    lists = [[place[x] for x in (near if near is not None else ()) if x in place] for near in part["near"].to_numpy()[inside]]
    v = v_all[inside]
    entry = int((v @ v.mean(axis=0)).argmax())  # the medoid; with it, medoids of hash groups of the part
    group = np.arange(len(inside)) % max(1, int(len(inside) ** 0.5))
    entries = np.unique([entry, *(int(own[(v[own] @ v[own].mean(axis=0)).argmax()]) for g in range(group.max() + 1) if len(own := np.flatnonzero(group == g)))])
    # Walks start at the medoid: nodes that no list leads to from there are linked from it.
    seen, stack = {entry}, [entry]
    extra = 0
    while True:
        while stack:
            for x in lists[stack.pop()]:
                if x not in seen:
                    seen.add(x)
                    stack.append(x)
        lost = next((i for i in range(extra, len(inside)) if i not in seen), None)
        if lost is None:
            break
        extra = lost
        lists[entry].append(lost)
        seen.add(lost)
        stack.append(lost)
    offs = np.concatenate([[0], np.cumsum([len(x) for x in lists])]).astype(np.int64)
    graph = offs, np.array([y for x in lists for y in x], np.int64)
    links = np.zeros(len(nodes), np.int64)
    order, at = np.unique(nodes.astype(np.int64), return_inverse=True)
    label = np.arange(len(order))
    look = lambda rows: search(v, graph, v_all[rows], entries, threshold, beam)
    # What one member finds of another holds for both.
    found = np.zeros((len(inside), len(inside)), bool)
    for lo in range(0, len(inside), block):
        q, node = look(inside[lo : lo + block])
        found[q + lo, node] = True
    found |= found.T
    visitors = np.flatnonzero(~member)
    blocks = [(inside[lo : lo + block], lambda lo=lo: np.nonzero(found[lo : lo + block])) for lo in range(0, len(inside), block)]
    blocks += [(visitors[lo : lo + block], lambda lo=lo: look(visitors[lo : lo + block])) for lo in range(0, len(visitors), block)]
    for rows, pairs in blocks:
        q, node = pairs()
        q, node = rows[q], inside[node]
        real = nodes[q] != nodes[node]
        q, node = q[real], node[real]
        # A pair counts in the first shard, by number, that both are in.
        common = np.full(len(q), np.iinfo(np.int64).max)
        for j in range(shards.shape[1]):
            s = shards[q, j]
            both = (s >= 0) & (shards[node] == s[:, None]).any(axis=1)
            common = np.where(both & (s < common), s, common)
        first = common == shard
        links += np.bincount(q[first], weights=mult[node[first]], minlength=len(nodes)).astype(np.int64)
        label = merge_labels(label, at[q], at[node])
    return pd.DataFrame({"node": nodes, "links": links, "low": order[label[at]]})


def audit_batches(batches: Iterator[pa.RecordBatch], queries: np.ndarray, names: np.ndarray, threshold: float) -> Iterator[pa.RecordBatch]:
    """Brute force: (node, links) of the audited nodes with the vectors of a batch."""
    for batch in batches:
        if not batch.num_rows:
            continue
        hit = (queries @ unit(matrix(batch.column(1))).T) >= threshold
        hit &= names[:, None] != batch.column(0).to_numpy()[None, :]
        yield pa.RecordBatch.from_arrays([pa.array(names), pa.array((hit * batch.column(2).to_numpy()[None, :]).sum(axis=1).astype(np.int64))], ["node", "links"])


def exact_part(part: pd.DataFrame, threshold: float) -> pd.DataFrame:
    """(node, links, low) of a table of at most a part's nodes, by all pairs."""
    nodes = part["node"].to_numpy(np.int64)
    v = unit(np.stack(part["v"].to_numpy()).astype(np.float64))
    hit = v @ v.T >= threshold
    np.fill_diagonal(hit, False)
    order, at = np.unique(nodes, return_inverse=True)
    a, b = np.nonzero(hit)
    label = merge_labels(np.arange(len(order)), at[a], at[b])
    return pd.DataFrame({"node": nodes, "links": (hit * part["mult"].to_numpy(np.int64)[None, :]).sum(axis=1), "low": order[label[at]]})


def graph_links(nodes: DataFrame, s: Settings) -> DataFrame:
    """(node, links, low) for every node (node, v, mult) in each of its parts, by one build and search."""
    spark = nodes.sparkSession
    n = nodes.count()
    sample = nodes.orderBy(F.xxhash64("node", F.lit(11))).limit(s.sample).select("v").toPandas()
    medoids = choose_medoids(unit(np.stack(sample["v"].to_numpy()).astype(np.float64)), min(s.max_medoids, max(1, -(-n * s.overlap // s.part_nodes))))
    assigned = cut(nodes.select("node", "v").mapInArrow(lambda it: assign_batches(it, medoids, s), f"node long, v {nodes.schema['v'].dataType.simpleString()}, shards array<int>").join(nodes.select("node", "mult"), "node"), "assigned")
    spread = assigned.withColumn("shard", F.explode("shards"))
    # A shard above the size of a part is split; its number of parts is bounded by the data, not by a cap.
    sizes = spread.groupBy("shard").agg(F.ceil(F.count(F.lit(1)) / F.lit(2 * s.part_nodes)).cast("int").alias("parts"))
    spread = spread.join(F.broadcast(sizes), "shard").withColumn("part", F.pmod(F.xxhash64("node", "shard"), F.col("parts")).cast("int"))
    spread = cut(spread, "spread")
    near = spread.select("shard", "part", "node", "v").groupBy("shard", "part").applyInPandas(lambda part: build_part(part, s.degree, s.alpha), "node long, near array<long>")
    united = cut(near.groupBy("node").agg(F.array_distinct(F.flatten(F.collect_list("near"))).alias("near")), "graph")
    members = spread.join(united, "node")
    own = members.select("shard", "part", "node", "v", "mult", "shards", "near", F.lit(True).alias("member"))
    # Queries of a split shard go to its other parts too.
    visit = spread.where("parts > 1").withColumn("to", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).where("to <> part")
    visit = visit.select("shard", F.col("to").alias("part"), "node", "v", "mult", "shards", F.lit(None).cast("array<long>").alias("near"), F.lit(False).alias("member"))
    found = own.unionByName(visit).groupBy("shard", "part").applyInPandas(lambda key, part: search_part(part, s.threshold, s.beam, int(key[0])), "node long, links long, low long")
    return cut(found, "found")


def audited_links(nodes: DataFrame, s: Settings) -> tuple[DataFrame, int, int]:
    """(links of nodes of one length; links of the audited nodes that were found; all they have)."""
    sample = nodes.orderBy(F.xxhash64("node", F.lit(23))).limit(s.audit_queries).toPandas()
    queries, names = unit(np.stack(sample["v"].to_numpy()).astype(np.float64)), sample["node"].to_numpy()
    truth = nodes.select("node", "v", "mult").mapInArrow(lambda it: audit_batches(it, queries, names, s.threshold), "node long, links long").agg(F.sum("links").alias("links")).first()
    true = int(truth["links"] or 0)
    while True:
        found = graph_links(nodes, s)
        caught = int(found.where(F.col("node").isin([int(x) for x in names])).agg(F.sum("links").alias("links")).first()["links"] or 0)
        # Once every node is in every shard and the beam holds a part, the search is exhaustive.
        if not true or caught / true >= s.target_recall or (s.overlap >= s.max_medoids and s.beam >= 2 * s.part_nodes):
            return found, caught, true
        s = replace(s, overlap=2 * s.overlap, beam=2 * s.beam)


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", settings: Settings | None = None) -> tuple[DataFrame, float]:
    """(one row per vector: id_col, n_links, component_id, kept; audited recall)."""
    s = settings or Settings()
    # Components keep their precision: only doubles need more than a float.
    kind = "array<double>" if "double" in vectors.schema[vector_col].dataType.simpleString() else "array<float>"
    rows = vectors.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast(kind).alias("v"))
    fine = F.col("v").isNotNull() & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    rows = cut(rows.withColumn("ok", F.coalesce(fine, F.lit(False))), "rows")
    # The number of a node is its place in the written table; its smallest id may also be that of other vectors.
    nodes = cut(rows.where("ok").groupBy("v").agg(F.min("id").alias("low_id"), F.count(F.lit(1)).alias("mult")).sortWithinPartitions("low_id", "v").withColumn("node", F.monotonically_increasing_id()), "nodes")
    sizes = nodes.groupBy(F.size("v").alias("d")).agg(F.count(F.lit(1)).alias("n"), F.sum("mult").alias("rows"))
    common = sizes.where("n > 1").orderBy(F.desc("rows"), "d").first()
    big = {r.d for r in sizes.where(F.col("n") > s.part_nodes).collect()} | ({common.d} if common else set())
    small = nodes.where(~F.size("v").isin(sorted(big))) if big else nodes
    found = cut(small.groupBy(F.size("v").alias("d")).applyInPandas(lambda part: exact_part(part, s.threshold), "node long, links long, low long"), "exact")
    caught = true = 0
    for d in sorted(big):
        more, hits, all_ = audited_links(nodes.where(F.size("v") == d), s)
        found, caught, true = found.unionByName(more), caught + hits, true + all_
    recall = caught / true if true else 1.0
    comps = cut(connected_components(found.where("low < node").select(F.col("low").alias("a"), F.col("node").alias("b"))), "components")
    names = comps.join(nodes.select("node", "low_id"), "node").groupBy("component").agg(F.min("low_id").alias("name"))
    named = comps.join(names, "component").select("node", "name")
    per_node = nodes.join(found.groupBy("node").agg(F.sum("links").alias("links")), "node", "left").join(named, "node", "left")
    per_node = cut(per_node.select("v", "mult", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("name", "low_id").alias("component")), "per_node")
    ok = rows.where("ok").join(per_node, "v", "left").select("id", (F.col("links") + F.col("mult") - 1).alias("n_links"), F.col("component").alias("component_id"))
    out = ok.unionByName(rows.where("not ok").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id")))
    return out.select(F.col("id").alias(id_col), "n_links", "component_id", (F.col("id") == F.col("component_id")).alias("kept")), recall
