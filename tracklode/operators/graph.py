"""Lane graphs: components, distances along lanes, circular clusters. Graphs are those of one scenario, so of bounded size."""

from __future__ import annotations

import heapq
import math

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def components(edges: DataFrame, key: str, src: str = "src", dst: str = "dst") -> DataFrame:
    """(key, node, component): undirected components inside each key, named by their smallest node."""
    kinds = {f.name: f.dataType.simpleString() for f in edges.schema}

    def run(part: pd.DataFrame) -> pd.DataFrame:
        parent: dict = {}

        def find(x):
            while parent.setdefault(x, x) != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        for a, b in zip(part[src], part[dst], strict=True):
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
        return pd.DataFrame([(part[key].iloc[0], n, find(n)) for n in sorted(parent)], columns=[key, "node", "component"])

    return edges.select(key, src, dst).groupBy(key).applyInPandas(run, f"`{key}` {kinds[key]}, node {kinds[src]}, component {kinds[src]}")


def distances(edges: DataFrame, seeds: DataFrame, key: str, length: str = "length", most: float = math.inf) -> DataFrame:
    """(key, node, distance): shortest way along edges from the nearest seed of the key, up to `most`.

    edges: key, src, dst and the length to pass; seeds: key, node. For ways that lead to the seeds, swap src and dst.
    """
    kinds = {f.name: f.dataType.simpleString() for f in edges.schema}

    def run(e: pd.DataFrame, s: pd.DataFrame) -> pd.DataFrame:
        ahead: dict = {}
        for a, b, w in zip(e["src"], e["dst"], e[length], strict=True):
            ahead.setdefault(a, []).append((b, w))
        best: dict = {}
        heap = [(0.0, n) for n in set(s["node"])]
        heapq.heapify(heap)
        while heap:
            d, n = heapq.heappop(heap)
            if n in best or d > most:
                continue
            best[n] = d
            for b, w in ahead.get(n, ()):
                heapq.heappush(heap, (d + w, b))
        name = s[key].iloc[0] if len(s) else None
        return pd.DataFrame([(name, n, d) for n, d in best.items()], columns=[key, "node", "distance"])

    return edges.select(key, "src", "dst", length).groupBy(key).cogroup(seeds.select(key, "node").groupBy(key)).applyInPandas(run, f"`{key}` {kinds[key]}, node {kinds['src']}, distance double")


def circular_clusters(df: DataFrame, keys: list[str], angle: str, threshold: float) -> DataFrame:
    """df with cluster: neighbours on the circle at most threshold apart are together; numbered from the widest gap on."""
    way = Window.partitionBy(*keys).orderBy(angle)
    all_ = Window.partitionBy(*keys)
    before = F.coalesce(F.lag(angle).over(way), F.max(angle).over(all_) - 2 * math.pi)
    gaps = df.withColumn("_gap", F.col(angle) - before).withColumn("_widest", F.max(F.struct("_gap", (-F.col(angle)).alias("a"))).over(all_))
    turned = gaps.withColumn("_turn", F.when(F.col(angle) >= -F.col("_widest.a"), F.col(angle)).otherwise(F.col(angle) + 2 * math.pi))
    order = Window.partitionBy(*keys).orderBy("_turn")
    return turned.withColumn("cluster", F.sum(F.when((F.row_number().over(order) > 1) & (F.col("_turn") - F.lag("_turn").over(order) > threshold), 1).otherwise(0)).over(order)).drop("_gap", "_widest", "_turn")
