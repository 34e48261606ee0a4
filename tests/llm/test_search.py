"""Lexical search, exact top-k and hard negatives against brute force."""

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tracklode.llm import common, gnat, maxsketch, segments

from .helpers import documents, prose, rows

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute_search(docs, items, top):
    bags = [(i, terms(t)) for i, t in docs]
    n, total = sum(1 for _, w in bags if w), sum(len(w) for _, w in bags)
    df = Counter(t for _, w in bags for t in set(w))
    out = []
    for item, text in set(items):
        scores = []
        for i, w in bags:
            m = 75 + (25 * len(w) * n) // total if total else 0
            tf = Counter(w)
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((10**9 * tf[t]) // (1000 * tf[t] + 12 * m)) for t in terms(text) if tf[t])
            if s > 0:
                scores.append((-s, i is None, i))
        out += [(item, k + 1, i, -s) for k, (s, _, i) in enumerate(sorted(scores, key=lambda x: (x[0], x[1], x[2] or 0))[:top])]
    return sorted(out, key=repr)


def benchmark(spark, data):
    return spark.createDataFrame([(*x, 1, "p", None) for x in data], "item_id long, text string, place long, item string, n int")


def search(spark, docs, items, top=20, **kw):
    got = maxsketch.top_documents(documents(spark, docs).repartition(3), benchmark(spark, items), top=top, **kw)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    return rows(got, "item_id", "rank", "doc_id", "score")


def test_search_matches_brute_force(spark):
    docs = [(i, prose(i, 5 + 37 * i % 300, 150)) for i in range(150)]
    docs += [(1000 + i, prose(3, 60, 150)) for i in range(40)]  # copies: ties at the threshold
    docs += [(2000 + i, "aw1 " * (100 * i + 1)) for i in range(6)]  # few terms, high counts
    docs += [(3000, " ".join(prose(k, 4000, 3000) for k in range(8))), (3001, None), (3002, ""), (3003, "?! \x00"), (None, prose(3, 60, 150)), (7, prose(3, 60, 150)), (7, prose(3, 60, 150)), (3004, "ÄÖ é9 bW1"), (3005, "äö É9")]
    items = [(1, prose(3, 30, 150)), (2, prose(5, 40, 150)), (3, "aw1"), (4, "aw1 AW1 aW1 bw2"), (5, None), (6, ""), (7, "unknownword"), (None, prose(8, 10, 150)), (1, prose(3, 30, 150)), (1, prose(9, 4, 150)), (9, "é9 Äö")]
    assert search(spark, docs, items) == brute_search(docs, [x for x in items if x[1]], 20)
    assert search(spark, docs, items, top=3, chunk_items=2) == brute_search(docs, [x for x in items if x[1]], 3)


def test_search_empty(spark):
    some = [(1, "a b"), (2, "b c")]
    assert search(spark, [], some) == search(spark, some, []) == search(spark, [(1, None), (2, "--")], some) == search(spark, some, [(1, None), (2, "...")]) == []
    assert search(spark, some, [(5, "c")]) == brute_search(some, [(5, "c")], 20)


def test_sketches_bound_the_scores():
    rng = np.random.default_rng(0)
    vocabulary = [b"w%d" % i for i in range(5000)]
    for n in (1, 7, 600, 5000):
        counts = {vocabulary[i]: int(c) for i, c in zip(rng.permutation(5000)[:n], rng.integers(1, 10**6, n), strict=True)}
        s = maxsketch.sketch(counts)
        at = maxsketch.coordinates(np.fromiter(map(maxsketch.crc32, counts), np.int64, n), len(s))
        levels = maxsketch.LEVELS[s[at].min(axis=0)]
        assert (levels >= np.array(list(counts.values()))).all() and len(s) >= 8 * n
    assert (np.diff(maxsketch.LEVELS) > 0).all() and len(maxsketch.LEVELS) <= 256


def vectors(spark, data, kind="array<float>"):
    return spark.createDataFrame([(*x, 1, "n") for x in data], f"vec_id long, embedding {kind}, label int, d long, query string")


def fine(v):
    return v is not None and all(x is not None and math.isfinite(x) for x in v)


def quantised(v):
    return [math.floor(256 * x) for x in v]


def product(a, b):
    return max(-(2**63), min(2**63 - 1, sum(x * y for x, y in zip(a, b, strict=True))))


def brute_top(data, k, every):
    known = sorted({(i, tuple(quantised(v))) for i, v, *_ in data if i is not None and fine(v)})
    out = []
    for i, q in known:
        if i % every == 0:
            best = sorted((-product(q, x), j) for j, x in known if j != i and len(x) == len(q))[:k]
            out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(best)]
    return sorted(out, key=repr)


ODD = [(0, None, 3), (50, [0.0] * 6, 3), (100, [float("nan")] * 6, 3), (150, [1.0, None, 0.0, 0.0, 0.0, 0.0], 3), (200, [float("inf")] * 6, 3), (250, [], 3), (251, [], 3), (300, [1.0, -2.0], 3), (301, [0.5, 0.25], 1), (302, [0.5, 1.5], 3), (None, [1.0] * 6, 3)]


def clustered(seed, n, d, copies):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, d))
    points = centres[rng.integers(0, 12, n)] + rng.normal(scale=0.3, size=(n, d))
    points[-copies:] = points[0]
    return [(7 * i % 5003, p.tolist(), int(i % 4)) for i, p in enumerate(points.astype(np.float32))]


@pytest.mark.parametrize("small", [False, True])
def test_topk_matches_brute_force(spark, monkeypatch, small):
    if small:  # several blocks, slices and groups
        for name, value in (("ROWS", 64), ("QUERIES", 4), ("SLICE", 16), ("GROUP", 2)):
            monkeypatch.setattr(segments, name, value)
    data = clustered(1, 500, 6, 150) + ODD + [(50, [0.5] * 6, 3), (50, [0.5] * 6, 3), (51, [0.5] * 6, 3)]
    got = segments.top_products(vectors(spark, data).repartition(5), k=5, every=50)
    assert rows(got, "query_id", "rank", "vec_id", "score") == brute_top(data, 5, 50)


def test_topk_large_components_and_few_rows(spark):
    data = [(0, [1e12, -3e12], 1), (1, [2e12, 1.0], 1), (2, [1e15, 1e15], 1), (50, [-1e30, 1e30], 1), (51, [1e30, -1e30], 1)]
    got = segments.top_products(vectors(spark, data, "array<double>"), k=5, every=50)
    want = [(i, r, j) for i, r, j, _ in brute_top([(i, [max(-(2**55), min(2**55 - 2**-8, x)) for x in v], n) for i, v, n in data], 5, 50)]
    assert rows(got, "query_id", "rank", "vec_id") == want
    assert segments.top_products(vectors(spark, [])).count() == 0
    assert segments.top_products(vectors(spark, [(50, [1.0], 1)])).count() == 0
    assert rows(segments.top_products(vectors(spark, [(50, [1.0], 1), (3, [-1.0], 1)])), "vec_id", "score") == [(3, -65536)]


def test_segment_bounds_hold():
    rng = np.random.default_rng(3)
    for d in (1, 2, 3, 5, 16, 33, 64):
        a, b = rng.normal(size=(20, d)) * 100, rng.normal(size=(30, d)) * 100
        exact = a @ b.T
        last = None
        for borders in segments.levels(d):
            assert borders[0] == 0 and borders[-1] == d and (np.diff(borders) > 0).all()
            bound = segments.statistics(a, borders) @ segments.statistics(b, borders).T
            assert (bound >= exact - 1e-6).all()
            last = bound
        assert last is not None


def blocks(x, ids, room, **more):
    """Packed blocks of so many rows, as search_group takes them."""
    names = ["d", "queries", "least", "q"] if more else ["d", "ids", "x"]
    out = []
    for lo in range(0, len(x), room):
        packed_ids, packed_x = segments.packed(ids[lo : lo + room], x[lo : lo + room])
        extra = [pa.array([v[lo : lo + room].astype("<i8").tobytes()], pa.binary()) for v in more.values()]
        out.append(pa.RecordBatch.from_arrays([pa.array([x.shape[1]], pa.int32()), packed_ids, *extra, packed_x], names))
    return pa.Table.from_batches(out)


@pytest.mark.parametrize("scale", [1, 2**10, 2**30, 2**56])
def test_topk_group_gives_k_rows_a_query(scale):
    """A group of blocks gives each query its k best rows, not k rows for each pair of blocks (F1); copies and lone vectors take different levels."""
    rng = np.random.default_rng(5)
    lone = rng.normal(size=(3000, 64))
    x = np.concatenate([lone, lone[:40].repeat(8, axis=0) + rng.normal(scale=0.02, size=(320, 64))])
    x = np.floor(32 * x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.int64) * scale
    ids = rng.permutation(len(x)).astype(np.int64)
    q = x[::30]
    least = np.full(len(q), -segments.LIMIT)
    got = segments.search_group(blocks(q, np.arange(len(q)), 50, least=least), blocks(x, ids, 300), 6)
    assert got.num_rows == 6 * len(q)
    exact = np.array([[max(-segments.LIMIT, min(segments.LIMIT - 1, z)) for z in row] for row in (q.astype(object) @ x.T.astype(object))], object)
    want = [(i, int(ids[j]), int(exact[i, j])) for i in range(len(q)) for j in sorted(range(len(x)), key=lambda j: (-exact[i, j], ids[j]))[:6]]
    assert sorted(zip(*(c.to_pylist() for c in got.columns), strict=True)) == sorted(want)


def brute_negatives(data, every, n_pos, n_neg, low=30, high=90):
    known = sorted({(i, lab, tuple(quantised(v))) for i, v, lab in data if i is not None and lab is not None and fine(v)})
    out = []
    for i, lab, q in known:
        if i % every == 0:
            scored = sorted((-product(q, x), j, m) for j, m, x in known if len(x) == len(q))
            for s, j in [(-s, j) for s, j, m in scored if m == lab and j != i][:n_pos]:
                foes = [(-t, f) for t, f, m in scored if m != lab and low * s <= -100 * t <= high * s][:n_neg]
                out += [(i, j, r + 1, f, s, t) for r, (t, f) in enumerate(foes)]
    return sorted(out, key=repr)


@pytest.mark.parametrize("sample,leaf", [(8192, 2048), (200, 20), (60, 8)])
def test_negatives_match_brute_force(spark, monkeypatch, sample, leaf):
    for name, value in (("SAMPLE", sample), ("LEAF_ROWS", leaf), ("WAYS", 5), ("BLOCK", 7)):
        monkeypatch.setattr(gnat, name, value)
    monkeypatch.setattr(gnat.fit, "__defaults__", (5,))
    data = clustered(2, 600, 6, 200) + ODD + [(i + 6000, x, None if i % 3 else 2) for i, x, _ in clustered(4, 30, 6, 5)] + [(100, [0.5] * 6, 2), (100, [0.5] * 6, 2)]
    got = gnat.hard_negatives(vectors(spark, data).repartition(5), every=25)
    assert rows(got, "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score") == brute_negatives(data, 25, 5, 10)


def test_negatives_label_expression_and_few_rows(spark):
    assert gnat.hard_negatives(vectors(spark, [])).count() == 0
    assert gnat.hard_negatives(vectors(spark, [(100, [1.0, 0.0], 1)])).count() == 0
    assert gnat.hard_negatives(vectors(spark, [(100, [1.0, 0.0], 1), (5, [0.6, 0.0], 2)])).count() == 0
    data = [(100, [1.0, 0.0], 1), (3, [1.0, 0.0], 1), (5, [0.6, 0.0], 2), (6, [0.95, 0.0], 2), (7, [0.5, 0.0], 1), (8, [-1.0, 0.0], 1)]
    assert rows(gnat.hard_negatives(vectors(spark, data)), "positive_id", "rank", "negative_id") == [(3, 1, 5)]
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    want = brute_negatives([(i, v, (m + 1) % 10 if i % 7 == 0 else m) for i, v, m in data], 100, 5, 10)
    assert rows(gnat.hard_negatives(vectors(spark, data), label=moved), "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score") == want


def test_negatives_send_no_vectors_to_the_driver(spark, monkeypatch):
    """Anchors and what they visit are shuffled, however small their tables look in files; only sizes of leaves are broadcast (F2)."""
    plans = []

    def seen(df, label="table"):
        plans.append((label, df._jdf.queryExecution().executedPlan().toString()))
        return common.cut(df, label)

    monkeypatch.setattr(gnat, "cut", seen)
    got = gnat.hard_negatives(vectors(spark, clustered(2, 300, 6, 20)), every=25)
    plans.append(("result", got._jdf.queryExecution().executedPlan().toString()))
    assert {"home", "answers", "leaves"} <= {label for label, _ in plans}
    assert {label for label, plan in plans if "Broadcast" in plan or "CartesianProduct" in plan} <= {"leaves"}


def test_negatives_group_gives_k_rows_a_window():
    """A group of parts gives each window its k best rows, not k rows for each part (F2)."""
    rng = np.random.default_rng(6)
    x, ids, label = rng.integers(-90, 90, (900, 16)), rng.permutation(900).astype(np.int64), rng.integers(0, 3, 900)
    q, own = x[::60], label[::60]
    lo, hi = np.tile([-(10**6), 0, 1], (len(q), 1)), np.tile([10**6, 20000, 0], (len(q), 1))  # the last window is empty
    pack = lambda z: pa.array([z.astype("<i8").tobytes()], pa.binary())
    parts = [pa.RecordBatch.from_arrays([pa.array([9 + i], pa.int32()), pa.array([16], pa.int32()), *(pack(z[i::9]) for z in (ids, label)), segments.packed(ids, x[i::9])[1]], ["number", "d", "ids", "labels", "x"]) for i in range(9)]
    visits = np.packbits(np.ones((len(q), 9), bool), axis=1).tobytes()
    names, vecs = segments.packed(np.arange(len(q)), q)
    anchors = pa.table([names, pack(own), pack(lo), pack(hi), pa.array([visits], pa.binary()), pa.array([16], pa.int32()), vecs], ["anchors", "labels", "lo", "hi", "visits", "d", "q"])
    got = gnat.ask_group(anchors, pa.Table.from_batches(parts), 9, 10, False)
    want = []
    for i, scores in enumerate(q @ x.T):
        for top in (10**6, 20000):
            inside = [j for j in range(900) if label[j] != own[i] and (top > 20000 or 0 <= scores[j] <= top)]
            want += [(i, top, int(ids[j]), int(scores[j])) for j in sorted(inside, key=lambda j: (-scores[j], ids[j]))[:10]]
    assert sorted(zip(*(c.to_pylist() for c in got.columns), strict=True)) == sorted(want)


def test_tree_ranges_pass_nothing_over():
    rng = np.random.default_rng(8)
    x = np.floor(256 * rng.normal(size=(3000, 5))).astype(np.int64)
    tree = gnat.fit(x[:800], len(x), float((x * x).sum(axis=1).max()), 60, 6)
    leaf = gnat.route(tree, x, widen=True)
    assert tree.leaves > 20
    q = np.floor(256 * rng.normal(size=(40, 5))).astype(np.int64)
    scores = q @ x.T
    lo = np.stack([np.percentile(scores, p, axis=1) for p in (99, 60)], axis=1).astype(np.int64)
    hi = np.stack([np.percentile(scores, p, axis=1) for p in (100, 60.5)], axis=1).astype(np.int64)
    visits = gnat.meeting(tree, q, lo, hi)
    passed = 0
    for a in range(len(q)):
        inside = ((scores[a] >= lo[a, 0]) & (scores[a] <= hi[a, 0])) | ((scores[a] >= lo[a, 1]) & (scores[a] <= hi[a, 1]))
        assert all(a in visits.get(int(k), ()) for k in set(leaf[inside].tolist()))
        passed += tree.leaves - sum(a in own for own in visits.values())
    assert passed > 0
