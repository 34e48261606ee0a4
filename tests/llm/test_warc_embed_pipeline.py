"""WARC round trip, embedding near-dedup, and the pipeline."""

import base64
import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracklode.llm import embed, warc

from .helpers import documents, prose, rows


def pages(spark, data):
    return spark.createDataFrame([(*x, "f", 1) for x in data], "page_id long, url string, html string, file string, offset long")


def test_warc_round_trip(spark):
    trap = "<p>WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nabc\r\n\r\nWARC/1.0\r\n</p>"
    data = [(5, "http://a", "<html>é</html>"), (3, "http://b\r\nWARC-Type: x", "<html>é</html>"), (9, None, trap), (10, "u", trap), (11, "u", None), (12, "u", ""), (13, "u", "\x00\r\n\r\n"), (None, "u", "lost"), (14, "u", "x" * 100_000)]
    got = {r.page_id: r for r in warc.archive_round_trip(pages(spark, data)).collect()}
    first = {}
    for i, _, h in sorted((x for x in data if x[0] is not None), key=lambda x: x[0]):
        body = (h or "").encode()
        r = got.pop(i)
        lead = first.setdefault(body, i)
        assert (r.payload_bytes, r.payload_digest) == (len(body), base64.b32encode(hashlib.sha1(body).digest()).decode())
        assert (r.record_type, r.refers_to) == (("response", None) if lead == i else ("revisit", lead))
    assert not got


def test_warc_payloads_and_several_archives(spark, tmp_path):
    data = [(i, f"u{i}", prose(i, 50) + "WARC/1.1\r\n") for i in range(60)]
    path = f"file://{tmp_path}/w"
    warc.write_archives(warc.records(pages(spark, data)), path, archive_bytes=4000)
    got = warc.read_archives(spark, path)
    assert rows(got.select("page_id", F.decode("payload", "UTF-8").alias("p")), "page_id", "p") == sorted(((i, h) for i, _, h in data), key=repr)
    assert got.select("file").distinct().count() > 3


@pytest.mark.parametrize("harm", ["length", "cut", "head"])
def test_warc_broken_archives_are_errors(spark, tmp_path, harm):
    path = tmp_path / "w"
    warc.write_archives(warc.records(pages(spark, [(i, f"u{i}", prose(i, 30)) for i in range(20)])), f"file://{path}")
    (file,) = path.glob("part-*")
    data = file.read_bytes()
    assert warc.read_archives(spark, f"file://{path}").count() == 20
    (path / f".{file.name}.crc").unlink(missing_ok=True)
    if harm == "length":
        at = data.index(b"Content-Length: ", len(data) // 2) + 16
        data = data[:at] + b"9" + data[at + 1 :]
    file.write_bytes({"length": data, "cut": data[:-9], "head": b"x" + data}[harm])
    with pytest.raises(ValueError, match="do not lead to their end"):
        warc.read_archives(spark, f"file://{path}")


def test_warc_empty(spark):
    assert warc.archive_round_trip(pages(spark, [])).count() == 0


def vectors(spark, data):
    return spark.createDataFrame([(*x, 1, "n") for x in data], "vec_id long, embedding array<float>, label long, node string")


def test_embeddings_match_brute_force(spark):
    rng = np.random.default_rng(6)
    base = rng.normal(size=(60, 16))
    groups = [b + rng.normal(scale=0.12, size=(rng.integers(1, 12), 16)) for b in base]
    points = np.concatenate([*groups, np.repeat(base[:1], 30, axis=0), base[1] + rng.normal(scale=0.05, size=(250, 16))]).astype(np.float32)
    data = [(i + 1, p.tolist()) for i, p in enumerate(points)]
    odd = [(9001, None), (9002, [0.0] * 16), (9003, [float("nan")] * 16), (9004, [1.0, None] + [0.0] * 14), (9005, [float("inf")] * 16), (9006, [1.0, 2.0]), (9007, [])]
    got, recall = embed.near_duplicates(vectors(spark, [*data, *odd, (None, points[0].tolist())]), settings=embed.Settings(part_nodes=120))
    v = points.astype(np.float64)
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    links = v @ v.T >= 0.95
    np.fill_diagonal(links, False)
    found = {r.vec_id: r for r in got.collect()}
    assert len(found) == len(data) + len(odd) and recall >= 0.9
    n = np.array([found[i + 1].n_links for i in range(len(v))])
    assert (n <= links.sum(axis=1)).all() and n.sum() >= 0.97 * links.sum()
    assert all((found[i].n_links, found[i].component_id, found[i].kept) == (0, i, True) for i, _ in odd)


def brute_components(links):
    label = np.arange(len(links))
    for _ in range(len(links)):
        label = np.minimum(label, np.where(links, label[None, :], len(links)).min(axis=1, initial=len(links)))
    return label


def arc(degrees):
    return [(i + 1, [float(np.cos(a)), float(np.sin(a)), 0.0]) for i, a in enumerate(np.deg2rad(degrees))]


@pytest.mark.parametrize("part_nodes", [4, 1500])
def test_embedding_chains_are_one_component(spark, part_nodes):
    # Links (18 degrees at most): 1-3, 2-3, 3's smallest is 1; 4-6, 5-6, 5-7; 8 alone; and a long chain whose ids are shuffled.
    rng = np.random.default_rng(4)
    degrees = [0.0, 24.0, 12.0, 60.0, 84.0, 72.0, 96.0, 130.0, *(160.0 + 12.0 * rng.permutation(12))]
    data = arc(degrees)
    v = np.array([x for _, x in data])
    links = v @ v.T >= 0.95
    np.fill_diagonal(links, False)
    got, recall = embed.near_duplicates(vectors(spark, data), settings=embed.Settings(part_nodes=part_nodes))
    want = brute_components(links)
    assert recall == 1.0
    assert rows(got, "vec_id", "n_links", "component_id") == sorted(((i + 1, int(links[i].sum()), int(want[i]) + 1) for i in range(len(v))), key=repr)
    assert [int(x) + 1 for x in want[:8]] == [1, 1, 1, 4, 4, 4, 4, 8]


def test_embeddings_repeated_ids_and_lengths(spark):
    east, north, flat = [1.0, 0.0, 0.0], [0.0, 1.0, 0.0], [1.0, 2.0]
    # Two different vectors have 5 as their smallest id; equal vectors of the rarer length link with each other.
    data = [(5, east), (5, north), (9, north), (11, [1.0, 0.05, 0.0]), (20, flat), (21, flat), (22, [1.0, 2.1]), (23, [2.0, -1.0])]
    got, recall = embed.near_duplicates(vectors(spark, data))
    assert recall == 1.0
    want = [(5, 1, 5, True), (5, 1, 5, True), (9, 1, 5, False), (11, 1, 5, False), (20, 2, 20, True), (21, 2, 20, False), (22, 2, 20, False), (23, 0, 23, True)]
    assert rows(got, "vec_id", "n_links", "component_id", "kept") == sorted(want, key=repr)
    got, _ = embed.near_duplicates(vectors(spark, [(1, east), (2, flat), (3, north[:1] + [1.0])]), settings=embed.Settings(part_nodes=1))
    assert rows(got, "vec_id", "n_links", "component_id") == [(1, 0, 1), (2, 0, 2), (3, 0, 3)]


def test_embeddings_of_any_magnitude(spark):
    data = [(1, [1e200, 1e200]), (2, [1e200, 1.0001e200]), (3, [1.0, 1.0]), (4, [1e-200, 1e-200]), (5, [5e-324, 5e-324]), (6, [1.7e308, -1.7e308])]
    table = spark.createDataFrame(data, "vec_id long, embedding array<double>")
    got, recall = embed.near_duplicates(table)
    assert recall == 1.0
    assert rows(got, "vec_id", "n_links", "component_id") == [(1, 4, 1), (2, 4, 1), (3, 4, 1), (4, 4, 1), (5, 4, 1), (6, 0, 6)]


def test_embeddings_empty_and_single(spark):
    assert embed.near_duplicates(vectors(spark, []))[0].count() == 0
    got, _ = embed.near_duplicates(vectors(spark, [(4, [1.0, 2.0]), (2, [1.0, 2.0]), (2, [1.0, 2.0])]))
    assert rows(got, "vec_id", "n_links", "component_id", "kept") == [(2, 2, 2, True), (2, 2, 2, True), (4, 2, 2, False)]


def test_pipeline_stages(spark, tmp_path):
    pipeline = pytest.importorskip("corpus_pipeline")
    benchmark = prose(900, 40)
    copy = prose(1, 120)
    data = [(1, copy, "aa"), (2, copy + " more", "aa"), (3, "123 456", "aa"), (4, None, "aa"), (5, benchmark, "aa"), *((i, prose(i, 60), "aa") for i in range(10, 30))]
    documents(spark, data).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, benchmark)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert [n for n, _ in pipeline.STAGES] == ["language_id", "line_dedup", "minhash_near_dedup", "benchmark_decontamination", "packing"]
    got = pipeline.run(spark, str(tmp_path))
    assert {r.doc_id for r in got.select("doc_id").distinct().collect()} == {1, *range(10, 30)}
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for _, stage in pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == documents(spark, []).columns
