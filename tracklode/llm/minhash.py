"""MinHash near-dedup with circulant permutations.

Two permutations of a universe of 2**20 slots make the whole signature: the first scatters the shingles, the second,
shifted circularly by k places, gives coordinate k. A shingle's values for all coordinates are therefore one contiguous
slice of the (wrapped) second permutation, and a signature is the column minimum of the slices of a document's shingles.

Signatures are cut into bands. In each bucket the hub (the smallest id) is compared with the other members, and links
join components. Buckets that still hold several components are then compared exactly across the components, in blocks
of bounded size that emit tree edges only. No bucket is capped, no pairs inside a component are formed, and every link
is confirmed on the full sets of 64-bit shingle hashes.

Defined cases: a text without words (or null) has an empty set and links with nothing; a row with a null id is never
linked, and keep_first leaves it; a link belongs to the row's own set, so rows that repeat an id with different texts are
told apart, and rows that repeat id and text are one document; an empty table gives an empty result; other columns
are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import connected_components, cut, small_batches, without
from .textkit import U64, chunk_words, mix, runs, shingles

UNIVERSE_BITS = 20
BANDS, BAND_ROWS = 20, 5
SET = ["n", "f1", "f2"]  # size and two sums of a set: its name
#: Members of a block when a bucket's components are compared exactly.
BLOCK = 400
#: A list of at most so many ids is broadcast to pick documents; a longer one is joined by a shuffle.
BROADCAST_IDS = 1_000_000


@cache
def permutations(coordinates: int) -> tuple[np.ndarray, np.ndarray]:
    """The scattering permutation, and all circular shifts of the second one as a view: row i is its slice from i on."""
    size = 1 << UNIVERSE_BITS
    rng = np.random.default_rng(7)
    first, second = rng.permutation(size).astype(np.int32), rng.permutation(size).astype(np.int32)
    return first, np.lib.stride_tricks.sliding_window_view(np.concatenate([second, second[:coordinates]]), coordinates)


def chunk_shingles(batch: pa.RecordBatch, column: int, k: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, shingle hashes, offsets of each row's shingles)."""
    for lo, hi, _, _, _, rows, hashes in chunk_words(batch.column(column)):
        got, row = shingles(hashes, runs(rows, hi - lo), k)
        yield lo, hi, got, runs(row, hi - lo)


def signature(hashes: np.ndarray, coordinates: int, block: int = 20_000) -> np.ndarray:
    """Minimum over the shingles of each coordinate; long documents go through in blocks."""
    first, shifted = permutations(coordinates)
    at = first[(hashes >> U64(64 - UNIVERSE_BITS)).astype(np.int64)]
    return np.minimum.reduce([shifted[at[i : i + block]].min(axis=0) for i in range(0, len(at), block)])


def fingerprint(own: np.ndarray) -> tuple[np.uint64, np.uint64]:
    """Two sums over the members of a set."""
    return mix(own).sum(dtype=U64), mix(own ^ U64(0xA5A5A5A5A5A5A5A5)).sum(dtype=U64)


def sign(batches: Iterator[pa.RecordBatch], k: int, bands: int, rows: int) -> Iterator[pa.RecordBatch]:
    salts = mix(np.arange(1, bands + 1, dtype=U64))
    for batch in batches:
        n = np.zeros(batch.num_rows, np.int64)
        marks = np.zeros((batch.num_rows, 2), U64)
        keys = np.zeros((batch.num_rows, bands), U64)
        for lo, hi, got, at in chunk_shingles(batch, 1, k):
            for r in range(lo, hi):
                own = np.sort(got[at[r - lo] : at[r - lo + 1]])
                if len(own):
                    own = own[np.concatenate([[True], own[1:] != own[:-1]])]
                    n[r] = len(own)
                    marks[r] = fingerprint(own)
                    sig = signature(own, bands * rows).astype(U64).reshape(bands, rows)
                    key = salts.copy()
                    for j in range(rows):
                        key = mix(key * U64(0xD6E8FEB86659FD93) + sig[:, j])
                    keys[r] = key
        flat = pa.array(keys[n > 0].reshape(-1).view(np.int64))
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(np.where(n > 0, bands, 0))]).astype(np.int32)), flat)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(n), pa.array(marks[:, 0].view(np.int64)), pa.array(marks[:, 1].view(np.int64)), lists], ["id", "tk", *SET, "bands"])


def sets(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """(id, the set's name, distinct shingle hashes), in output batches of bounded size."""
    for batch in batches:
        for lo, hi, got, at in chunk_shingles(batch, 1, k):
            own = [np.unique(got[at[i] : at[i + 1]]) for i in range(hi - lo)]
            n = np.array([len(x) for x in own], np.int64)
            marks = np.array([fingerprint(x) for x in own], U64).view(np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32)), pa.array(np.concatenate(own).view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(n), pa.array(marks[:, 0]), pa.array(marks[:, 1]), lists], ["id", *SET, "hashes"])


def linked(common: np.ndarray, a: np.ndarray, b: np.ndarray, per: int, hundred: int) -> np.ndarray:
    """Which pairs of set sizes a, b with so many common members reach the similarity."""
    return hundred * common >= per * (a[:, None] + b[None, :] - common)


def common_counts(left: list[np.ndarray], right: list[np.ndarray], columns: int = 4096) -> np.ndarray:
    """Exact intersection sizes of all left with all right sets, by matrix products over the shared members."""
    everything = np.concatenate([*left, *right])
    members, code, n = np.unique(everything, return_inverse=True, return_counts=True)
    shared = np.cumsum(n > 1) - 1
    row = np.repeat(np.arange(len(left) + len(right)), [len(x) for x in (*left, *right)])
    keep = n[code] > 1
    col, row = shared[code[keep]], row[keep]
    out = np.zeros((len(left), len(right)), np.float64)
    for lo in range(0, int((n > 1).sum()), columns):
        part = (col >= lo) & (col < lo + columns)
        block = np.zeros((len(left) + len(right), columns), np.float32)
        block[row[part], col[part] - lo] = 1
        out += block[: len(left)] @ block[len(left) :].T
    return np.rint(out).astype(np.int64)


def block_links(part: pd.DataFrame, per: int, hundred: int) -> pd.DataFrame:
    """Tree edges (a, b) that join what is linked between the left and the right members of a block."""
    left, right = part[part["role"] != 1], part[part["role"] != 0]  # role 2: a block with itself
    if not len(left) or not len(right):
        return pd.DataFrame({"a": np.zeros(0, np.int64), "b": np.zeros(0, np.int64)})
    ls, rs = list(left["hashes"]), list(right["hashes"])
    hit = linked(common_counts(ls, rs), np.array([len(x) for x in ls]), np.array([len(x) for x in rs]), per, hundred)
    li, ri = left["rep"].to_numpy(np.int64), right["rep"].to_numpy(np.int64)
    some = np.flatnonzero(hit.any(axis=1))
    big = np.iinfo(np.int64).max
    label_l, label_r = li.copy(), ri.copy()
    while True:  # the smallest id reachable inside the block
        new_r = np.minimum(label_r, np.where(hit[some], label_l[some, None], big).min(axis=0, initial=big))
        new_l = label_l.copy()
        new_l[some] = np.minimum(label_l[some], np.where(hit[some], new_r[None, :], big).min(axis=1, initial=big))
        if (new_r == label_r).all() and (new_l == label_l).all():
            break
        label_l, label_r = new_l, new_r
    a, b = np.concatenate([label_l, label_r]), np.concatenate([li, ri])
    return pd.DataFrame({"a": a[a < b], "b": b[a < b]}).drop_duplicates()


def residual_links(members: DataFrame, full: DataFrame, per: int, hundred: int) -> DataFrame:
    """Links between different components of a bucket (bucket, rep, comp), block by block.

    Members of the bucket's first component meet only the others, which meet each other too. Blocks hold at most about
    BLOCK members whatever the bucket's size, and only tree edges leave them.
    """
    # Bands that hold the same members are one bucket.
    count = lambda c: F.sum(F.when(c, 1).otherwise(0))
    first = cut(members.groupBy("bucket").agg(F.min(F.struct("rep", "comp")).alias("m"), F.max("rep").alias("last"), F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("rep").cast("decimal(38,0)")).alias("h")), "buckets")
    first = first.groupBy("m", "last", "n", "h").agg(F.min("bucket").alias("bucket")).select("bucket", F.col("m.comp").alias("main"))
    rows = cut(members.join(first, "bucket"), "residual")
    sizes = rows.groupBy("bucket").agg(count(F.col("comp") == F.col("main")).alias("n_main"), count(F.col("comp") != F.col("main")).alias("n_other"))
    blocks = lambda c: F.ceil(F.col(c) / F.lit(BLOCK)).cast("int")
    rows = rows.join(cut(sizes.select("bucket", blocks("n_main").alias("mains"), blocks("n_other").alias("others")), "sizes"), "bucket")
    is_main = F.col("comp") == F.col("main")
    rows = rows.withColumn("own", F.pmod(F.xxhash64("rep", "bucket"), F.when(is_main, F.col("mains")).otherwise(F.col("others"))).cast("int"))
    place = lambda i, kind, j, role: F.struct(i.cast("int").alias("i"), F.lit(kind).alias("kind"), j.cast("int").alias("j"), role.cast("int").alias("role"))
    others = F.sequence(F.lit(0), F.col("others") - 1)
    as_main = F.transform(others, lambda i: place(i, "main", F.col("own"), F.lit(1)))
    with_others = F.transform(others, lambda k: place(F.least(k, F.col("own")), "other", F.greatest(k, F.col("own")), F.when(k == F.col("own"), 2).when(k > F.col("own"), 0).otherwise(1)))
    with_mains = F.transform(F.sequence(F.lit(0), F.col("mains") - 1), lambda j: place(F.col("own"), "main", j, F.lit(0)))
    spread = rows.select("bucket", "rep", F.explode(F.when(is_main, as_main).otherwise(F.concat(with_others, with_mains))).alias("p")).select("bucket", "rep", "p.*")
    loaded = spread.join(full.select(F.col("id").alias("rep"), "hashes"), "rep")
    return loaded.groupBy("bucket", "i", "kind", "j").applyInPandas(lambda part: block_links(part, per, hundred), "a long, b long")


def confirmed(pairs: DataFrame, full: DataFrame, per: int, hundred: int) -> DataFrame:
    """Those pairs (a, b) whose full sets have hundred * intersection >= per * union."""
    both = pairs.join(full.select(F.col("id").alias("b"), F.col("hashes").alias("hb")), "b").join(full.select(F.col("id").alias("a"), F.col("hashes").alias("ha")), "a")
    common = F.size(F.array_intersect("ha", "hb")).cast("long")
    return both.select("a", "b", common.alias("common"), (F.size("ha") + F.size("hb") - common).alias("both")).where(hundred * F.col("common") >= per * F.col("both")).select("a", "b")


def grouped(documents: DataFrame, id_col: str, text_col: str, k: int, per: int, hundred: int, bands: int, rows: int) -> DataFrame:
    """(id, tk: hash of the text, n, component: smallest id reachable, lead: the row is the group's first set under that id)."""
    small_batches(documents.sparkSession)
    docs = documents.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("tk"))
    signed = cut(docs.mapInArrow(lambda it: sign(it, k, bands, rows), "id long, tk long, n long, f1 long, f2 long, bands array<long>"), "signed")
    known = signed.where(F.col("id").isNotNull() & (F.col("n") > 0))
    # Equal sets are one node, whatever their number; its smallest id may also be that of other sets.
    classes = known.groupBy(*SET).agg(F.min("id").alias("low"), F.any_value("bands").alias("bands"))
    nodes = cut(classes.sortWithinPartitions("low", *SET).withColumn("node", F.monotonically_increasing_id()), "nodes")
    members = nodes.select(F.explode("bands").alias("bucket"), F.col("node").alias("rep"), "n")
    hubs = cut(members.groupBy("bucket").agg(F.min("rep").alias("hub"), F.max("rep").alias("last")).where("hub < last").drop("last"), "hubs")
    members = cut(members.join(hubs, "bucket"), "members")

    comps = None
    if not members.isEmpty():
        wanted = cut(nodes.select("node", "low", *SET).join(members.select(F.col("rep").alias("node")).distinct(), "node", "left_semi").withColumnRenamed("low", "id"), "wanted")
        hint = F.broadcast if wanted.count() <= BROADCAST_IDS else (lambda x: x)
        picked = docs.join(hint(wanted.select("id").distinct()), "id", "left_semi")
        full = picked.mapInArrow(lambda it: sets(it, k), "id long, n long, f1 long, f2 long, hashes array<long>").join(hint(wanted), ["id", *SET])
        if not known.groupBy("id").count().where("count > 1").isEmpty():
            full = full.dropDuplicates(["node"])
        full = cut(full.select(F.col("node").alias("id"), "hashes"), "sets")
        sizes = members.select(F.col("rep").alias("hub"), F.col("n").alias("hub_n")).distinct()
        near = hundred * F.least("n", "hub_n") >= per * F.greatest("n", "hub_n")
        pairs = members.where("rep <> hub").select("hub", "rep", "n").distinct().join(sizes, "hub").where(near)
        links = cut(confirmed(cut(pairs.select(F.col("hub").alias("a"), F.col("rep").alias("b")), "pairs"), full, per, hundred), "links")
        comps = connected_components(links)
        # Buckets that still hold several components are compared exactly, in blocks.
        members = cut(members.select("bucket", "rep").join(comps.withColumnRenamed("node", "rep"), "rep", "left").select("bucket", "rep", F.coalesce("component", "rep").alias("comp")), "members")
        apart = cut(members.groupBy("bucket").agg(F.min("comp").alias("low"), F.max("comp").alias("high"), F.count(F.lit(1)).alias("n")).where("low < high and n > 2").select("bucket"), "apart")
        if not apart.isEmpty():
            more = residual_links(cut(members.join(apart, "bucket"), "members"), full, per, hundred)
            comps = connected_components(links.unionByName(cut(more, "more")))

    labels = nodes.select(*SET, "low", "node")
    if comps is not None:
        own = comps.join(labels.select("node", "low"), "node")
        # The group is named by its smallest id; of sets under that id the one with the smallest number leads.
        heads = cut(own.groupBy("component").agg(F.min(F.struct("low", "node")).alias("head")), "heads")
        labels = labels.join(own.join(heads, "component").select("node", "head"), "node", "left")
        labels = labels.select(*SET, "low", F.coalesce("head.low", "low").alias("component"), F.coalesce(F.col("head.node") == F.col("node"), F.lit(True)).alias("first"))
    else:
        labels = labels.select(*SET, "low", F.col("low").alias("component"), F.lit(True).alias("first"))
    out = signed.drop("bands").join(cut(labels, "labels"), SET, "left")
    component = F.when(F.col("id").isNotNull(), F.coalesce("component", "id"))
    lead = F.coalesce(F.col("first") & (F.col("id") == F.col("low")), F.lit(True))
    return out.select("id", "tk", "n", component.alias("component"), lead.alias("lead"))


def near_duplicates(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, per: int = 80, hundred: int = 100, bands: int = BANDS, rows: int = BAND_ROWS) -> DataFrame:
    """One row per document: id_col, n_shingles, component_id, kept (id = component_id).

    Documents are linked where hundred * |A & B| >= per * |A | B| over their sets of k-word shingles.
    """
    got = grouped(documents, id_col, text_col, k, per, hundred, bands, rows)
    return got.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"), F.coalesce(F.col("id") == F.col("component"), F.lit(False)).alias("kept"))


def keep_first(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, per: int = 80, hundred: int = 100, bands: int = BANDS, rows: int = BAND_ROWS) -> DataFrame:
    """documents without the members of each near-duplicate group but the first set of the smallest id; null ids stay."""
    gone = grouped(documents, id_col, text_col, k, per, hundred, bands, rows).where(~F.col("lead") & F.col("id").isNotNull())
    gone = gone.select(F.col("id").alias("_tl_id"), F.col("tk").alias("_tl_tk")).distinct()
    return without(documents, gone, (F.col(id_col) == F.col("_tl_id")) & (F.xxhash64(F.col(text_col)) == F.col("_tl_tk")))
