"""Repeated passages by sparse suffix arrays.

Suffixes are kept only where a minimiser stands: in every window of min_words - GRAM + 1 consecutive word grams the one
with the smallest hash, so any passage of min_words words holds a kept suffix at the same place in all its copies. Kept
suffixes whose gram occurs once are dropped. The others are sorted by the words that follow (then by those before), range
partitioned with the place as the last key, so that a passage in a third of all documents spreads over many tasks, and
each suffix is compared with the few before it. That covers all pairs of a gram with few places only, so under grams with
more, the windows of min_words words that chose the suffix are hashed too, and each is compared with the smallest place of
its hash: every window that a smaller id holds too is found, however common its gram. Of the matches of a suffix all that lie in no other
are kept. A match is extended to the right and to the left over up to
min_words - GRAM words each; the matches of a long passage overlap and are merged along their diagonal. Equal texts are
reported as one match of the whole text with the smallest id; only that one is searched.

Words are maximal runs of [^\\x20\\x09-\\x0D], A-Z taken as a-z; equality is that of 64-bit hashes for grams and of 32-bit
hashes for each word of the extension.

Defined cases: null texts and texts of fewer than min_words words have no passages; rows with a null id are dropped; rows
that repeat id and text count once; different texts under one id are searched one by one, and matches between texts of one
id are not reported; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, small_batches
from .textkit import U64, chunk_words, gram_hashes, mix, runs

MIN_WORDS = 50
GRAM = 10
#: Each suffix is compared with so many before it in the order.
BACK = 8
#: At most so many leading places (about 400 bytes each) are broadcast; more are joined by a shuffle.
BROADCAST_LEADERS = 50_000


def row_words(batch: pa.RecordBatch, column: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, word hashes, offsets of each row's words)."""
    for lo, hi, _, _, _, rows, hashes in chunk_words(batch.column(column)):
        yield lo, hi, hashes, runs(rows, hi - lo)


def text_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, tk, n_words, two hashes of the whole word sequence)."""
    for batch in batches:
        for lo, hi, words, at in row_words(batch, 1):
            keys = np.zeros((hi - lo, 2), U64)
            place = (np.arange(len(words)) - np.repeat(at[:-1], np.diff(at))).astype(U64)
            for j, salt in enumerate((0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)):
                total = np.concatenate([[U64(0)], np.cumsum(mix(words + mix(place * U64(2) + U64(1)) * U64(salt)))])
                keys[:, j] = total[at[1:]] - total[at[:-1]]
            yield pa.RecordBatch.from_arrays([*(batch.column(i).slice(lo, hi - lo) for i in (0, 2)), pa.array(np.diff(at).astype(np.int64)), pa.array(keys[:, 0].view(np.int64)), pa.array(keys[:, 1].view(np.int64))], ["id", "tk", "n_words", "k1", "k2"])


def chosen(words: np.ndarray, at: np.ndarray, min_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first word of each window of min_words words inside a row, the place of its minimiser, row of each word)."""
    width = min_words - GRAM + 1
    grams = gram_hashes(words, GRAM)
    row = np.repeat(np.arange(len(at) - 1), np.diff(at))
    if len(grams) < width:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), row
    first = np.arange(len(grams) - width + 1)
    first = first[row[first] == row[first + min_words - 1]]
    view = np.lib.stride_tricks.sliding_window_view(grams, width)
    best = np.concatenate([first[i : i + 65536] + view[first[i : i + 65536]].argmin(axis=1) for i in range(0, len(first), 65536)]) if len(first) else first
    return first, best, row


def minimisers(words: np.ndarray, at: np.ndarray, min_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word index, row, gram hash) of the kept suffixes."""
    _, best, row = chosen(words, at, min_words)
    best = np.unique(best)
    return best, row[best], gram_hashes(words, GRAM)[best] if len(best) else np.zeros(0, U64)


def minimiser_batches(batches: Iterator[pa.RecordBatch], min_words: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, hi, words, at in row_words(batch, 1):
            place, row, gram = minimisers(words, at, min_words)
            names = [batch.column(i).slice(lo, hi - lo).take(pa.array(row)) for i in (0, 2)]
            yield pa.RecordBatch.from_arrays([*names, pa.array((place - at[row]).astype(np.int32)), pa.array(gram.view(np.int64))], ["id", "tk", "pos", "gram"])


def context_batches(batches: Iterator[pa.RecordBatch], reach: int) -> Iterator[pa.RecordBatch]:
    """(id, tk, pos, gram, after, before, windows): words after the gram and before it, nearest first, 4 bytes each, 0 beyond the text.

    windows: hashes of the windows that chose the place, if it is among the row's places of common grams.
    """
    for batch in batches:
        places, commons = batch.column(2).to_pylist(), batch.column(3).to_pylist()
        for lo, hi, words, at in row_words(batch, 1):
            short = (words >> U64(32)).astype(np.uint32) | np.uint32(1)
            own = [np.asarray(p, np.int64) for p in places[lo:hi]]
            row = np.repeat(np.arange(hi - lo), [len(p) for p in own])
            pos = np.concatenate(own) if own else np.zeros(0, np.int64)
            grams = gram_hashes(words, GRAM)
            heavy = np.concatenate([at[i] + np.asarray(p, np.int64) for i, p in enumerate(commons[lo:hi])]) if hi > lo else np.zeros(0, np.int64)
            first, best, _ = chosen(words, at, reach + GRAM) if len(heavy) else (np.zeros(0, np.int64), np.zeros(0, np.int64), None)
            some = np.isin(best, heavy)
            first, best = first[some], best[some]  # best does not fall: the leftmost minimum moves with its window
            keys = gram_hashes(words, reach + GRAM)[first].view(np.int64) if len(first) else np.zeros(0, np.int64)
            for i in range(0, len(pos), 8192):
                r, p = row[i : i + 8192], pos[i : i + 8192]
                begin, end, here = at[r][:, None], at[r + 1][:, None], (at[r] + p)[:, None]
                sides = []
                for idx in (here + GRAM + np.arange(reach), here - 1 - np.arange(reach)):
                    ok = (idx >= begin) & (idx < end)
                    sides.append(np.where(ok, short[np.clip(idx, 0, len(short) - 1)], 0).astype(">u4"))
                binary = [pa.FixedSizeBinaryArray.from_buffers(pa.binary(4 * reach), len(p), [None, pa.py_buffer(np.ascontiguousarray(x).tobytes())]).cast(pa.binary()) for x in sides]
                from_, to = np.searchsorted(best, here[:, 0]), np.searchsorted(best, here[:, 0], side="right")
                n = to - from_
                offs = np.concatenate([[0], np.cumsum(n)])
                own_keys = keys[np.repeat(from_ - offs[:-1], n) + np.arange(offs[-1])]
                windows = pa.ListArray.from_arrays(pa.array(offs.astype(np.int32)), pa.array(own_keys, pa.int64()))
                names = [batch.column(i).slice(lo, hi - lo).take(pa.array(r)) for i in (0, 4)]
                yield pa.RecordBatch.from_arrays([*names, pa.array(p.astype(np.int32)), pa.array(grams[here[:, 0]].view(np.int64)), *binary, windows], ["id", "tk", "pos", "gram", "after", "before", "windows"])


def same_length(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Length of the common prefix of each row pair; 0 ends a row."""
    differ = (a != b) | (a == 0)
    return np.where(differ.any(axis=1), differ.argmax(axis=1), a.shape[1])


def longest(later: np.ndarray, left: np.ndarray, right: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Places of the matches that lie in no other match of the same suffix; of equal ones that with the smallest other id."""
    order = np.lexsort((other, -right, -left, later))
    group = np.cumsum(np.concatenate([[True], later[order][1:] != later[order][:-1]])) if len(order) else order
    height = group * 2**20 + right[order] + 1
    before = np.concatenate([[0], np.maximum.accumulate(height)[:-1]]) if len(order) else order
    return order[height > before]


def extended_batches(batches: Iterator[pa.RecordBatch], reach: int, min_words: int) -> Iterator[pa.RecordBatch]:
    """Matches of pairs (id, pos, after, before, other, other_pos, other_after, other_before, tk, other_tk)."""
    for batch in batches:
        side = lambda i: np.frombuffer(b"".join(batch.column(i).to_pylist()), ">u4").reshape(batch.num_rows, reach)  # noqa: B023, E731
        left, right = same_length(side(3), side(7)), same_length(side(2), side(6))
        ok = np.flatnonzero(left + GRAM + right >= min_words)
        col = lambda i: batch.column(i).to_numpy().astype(np.int64)[ok]  # noqa: B023, E731
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (col(0), col(1) - left[ok], (left + GRAM + right)[ok], col(4), col(5) - left[ok], col(8), col(9))], ["id", "start", "n_words", "other", "other_start", "tk", "other_tk"])


def neighbour_batches(batches: Iterator[pa.RecordBatch], reach: int, min_words: int) -> Iterator[pa.RecordBatch]:
    """Matches (id, start, n_words, other, other_start, tk, other_tk) with the rows before that lie in no other; and the edge rows.

    Edge rows (edge true, with their columns) are the first and last BACK rows of the partition, for the pairs that
    stand on both sides of a partition's border.
    """
    schema = pa.schema([("id", pa.int64()), ("start", pa.int64()), ("n_words", pa.int64()), ("other", pa.int64()), ("other_start", pa.int64()), ("tk", pa.int64()), ("other_tk", pa.int64()), ("edge", pa.bool_()), ("pos", pa.int32()), ("gram", pa.int64()), ("after", pa.binary()), ("before", pa.binary())])

    def edges(rows: pa.Table) -> pa.RecordBatch:
        n = rows.num_rows
        c = rows.combine_chunks()
        col = lambda name: c[name].combine_chunks() if n else pa.array([], schema.field(name).type)
        none = pa.nulls(n, pa.int64())
        return pa.RecordBatch.from_arrays([col("id"), none, none, none, none, col("tk"), none, pa.array(np.ones(n, bool)), col("pos"), col("gram"), col("after"), col("before")], schema=schema)

    held: pa.Table | None = None
    first = True
    for batch in batches:
        if not batch.num_rows:
            continue
        new = pa.Table.from_batches([batch])
        if first:
            yield edges(new.slice(0, BACK))
        rows = new if held is None else pa.concat_tables([held, new])
        ids, tk, pos, gram = (rows[x].to_numpy() for x in ("id", "tk", "pos", "gram"))
        sides = [np.frombuffer(b"".join(rows[x].to_pylist()), ">u4").reshape(len(ids), reach) for x in ("after", "before")]
        n_rows, skip = len(ids), 0 if held is None else held.num_rows
        found: list[np.ndarray] = [np.zeros((4, 0), np.int64)]
        # Besides its neighbours, a row meets the smallest id so far under its gram: every copy but the first has an earlier one.
        run = np.concatenate([[0], np.cumsum(gram[1:] != gram[:-1])])
        rank = np.unique(ids, return_inverse=True)[1] - run * n_rows
        least = np.maximum.accumulate(np.where(rank == np.minimum.accumulate(rank), np.arange(n_rows), 0))
        new_rows = np.arange(max(skip, 1), n_rows)
        for a, b in [(new_rows - j, new_rows) for j in range(1, BACK + 1)] + [(least[new_rows - 1], new_rows)]:
            a, b = a[a >= 0], b[a >= 0]
            ok = (gram[a] == gram[b]) & (ids[a] != ids[b])
            a, b = a[ok], b[ok]
            if not len(a):
                continue
            left, right = same_length(sides[1][a], sides[1][b]), same_length(sides[0][a], sides[0][b])
            later, earlier = np.where(ids[b] > ids[a], b, a), np.where(ids[b] > ids[a], a, b)
            ok = left + GRAM + right >= min_words
            found.append(np.stack([later, earlier, left, right])[:, ok])
        later, earlier, left, right = np.concatenate(found, axis=1)
        keep = longest(later, left, right, ids[earlier])
        later, earlier, left, right = later[keep], earlier[keep], left[keep], right[keep]
        tail = np.arange(max(0, n_rows - BACK), n_rows)
        first, held = False, rows.take(pa.array(np.unique([least[-1], *tail])))
        n = len(later)
        yield pa.RecordBatch.from_arrays([pa.array(ids[later]), pa.array(pos[later] - left), pa.array(left + GRAM + right), pa.array(ids[earlier]), pa.array(pos[earlier] - left), pa.array(tk[later]), pa.array(tk[earlier]), pa.array(np.zeros(n, bool)), *(pa.nulls(n, schema.field(x).type) for x in ("pos", "gram", "after", "before"))], schema=schema)
    if held is not None:
        yield edges(held)


MATCHES = "id long, start long, n_words long, other long, other_start long, tk long, other_tk long, edge boolean, pos int, gram long, after binary, before binary"


def window_matches(contexts: DataFrame, reach: int, min_words: int) -> DataFrame:
    """Matches (id, start, n_words, other, other_start, tk, other_tk) of every hashed window with the smallest place that holds it."""
    own, others = ["id", "tk", "pos"], ["other", "other_tk", "other_pos"]
    windows = contexts.select(*own, F.explode("windows").alias("window"))
    leads = windows.groupBy("window").agg(F.min(F.struct(*own)).alias("m"), F.max("id").alias("high")).where("m.id < high")
    leads = cut(leads.select("window", F.col("m.id").alias("other"), F.col("m.tk").alias("other_tk"), F.col("m.pos").alias("other_pos")), "leads")
    pairs = cut(windows.join(leads, "window").where("id > other").select(*own, *others).distinct(), "window_pairs")
    sides = contexts.select(*own, "after", "before")
    theirs = sides.withColumnsRenamed(dict(zip([*own, "after", "before"], [*others, "other_after", "other_before"], strict=True)))
    theirs = cut(theirs.join(leads.select(*others).distinct(), others, "left_semi"), "leaders")
    theirs = F.broadcast(theirs) if theirs.count() <= BROADCAST_LEADERS else theirs
    both = pairs.join(sides, own).join(theirs, others).select("id", "pos", "after", "before", "other", "other_pos", "other_after", "other_before", "tk", "other_tk")
    return both.mapInArrow(lambda it: extended_batches(it, reach, min_words), "id long, start long, n_words long, other long, other_start long, tk long, other_tk long")


def repeated_passages(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """One row per repeated passage: id_col, start, n_words, other_<id_col>, other_start (places in words from 0).

    The passage of n_words at start in the document is also at other_start in the other, which has the smaller id.
    """
    if min_words <= GRAM:
        raise ValueError(f"min_words must be above {GRAM}")
    reach = min_words - GRAM
    small_batches(documents.sparkSession)
    text = ["id", "tk"]
    docs = documents.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("tk"))
    keys = cut(docs.mapInArrow(text_batches, "id long, tk long, n_words long, k1 long, k2 long").where(F.col("n_words") >= min_words).distinct(), "texts")
    reps = cut(keys.groupBy("n_words", "k1", "k2").agg(F.min(F.struct(*text)).alias("rep")), "reps")
    copies = cut(keys.join(reps, ["n_words", "k1", "k2"]).where(F.struct(*text) > F.col("rep")), "copies")
    zero = F.lit(0).cast("long")
    whole = copies.where("id > rep.id").select("id", zero.alias("start"), "n_words", F.col("rep.id").alias("other"), zero.alias("other_start"))

    sampled = docs.mapInArrow(lambda it: minimiser_batches(it, min_words), "id long, tk long, pos int, gram long")
    sampled = cut(sampled.join(copies.select(*text).distinct(), text, "left_anti").dropDuplicates([*text, "pos"]), "minimisers")
    grams = cut(sampled.groupBy("gram").agg(F.min("id").alias("low"), F.max("id").alias("high"), F.count(F.lit(1)).alias("n")).where("low < high").select("gram", (F.col("n") > BACK).alias("common")), "grams")
    places = sampled.join(grams, "gram").groupBy(*text).agg(F.collect_list("pos").alias("places"), F.collect_list(F.when(F.col("common"), F.col("pos"))).alias("commons"))
    contexts = docs.dropDuplicates(text).join(places, text).select("id", "text", "places", "commons", "tk").mapInArrow(lambda it: context_batches(it, reach), "id long, tk long, pos int, gram long, after binary, before binary, windows array<long>")
    contexts = cut(contexts, "contexts")
    order = ["gram", "after", "before", "id", "tk", "pos"]
    row = ["id", "tk", "pos", "gram", "after", "before"]
    compare = lambda it: neighbour_batches(it, reach, min_words)
    found = cut(contexts.repartitionByRange(*order).sortWithinPartitions(*order).select(*row).mapInArrow(compare, MATCHES), "matches")
    # At most 2 * BACK edge rows a partition: the borders of the partitions are compared in one small sort.
    border = found.where("edge").select(*row).distinct().coalesce(1).sortWithinPartitions(*order).mapInArrow(compare, MATCHES)
    span = ["id", "start", "n_words", "other", "other_start", "tk", "other_tk"]
    spans = found.where("not edge").unionByName(border.where("not edge")).select(*span).distinct()
    spans = spans.unionByName(cut(window_matches(contexts, reach, min_words), "window_matches")).distinct()
    # Overlapping matches on one diagonal are one passage.
    pair = ["id", "tk", "other", "other_tk", "diagonal"]
    way = Window.partitionBy(*pair).orderBy("start", "n_words")
    spans = spans.withColumn("diagonal", F.col("start") - F.col("other_start")).withColumn("end", F.col("start") + F.col("n_words"))
    spans = spans.withColumn("new", F.coalesce((F.col("start") > F.max("end").over(way.rowsBetween(Window.unboundedPreceding, -1))).cast("int"), F.lit(1)))
    spans = spans.withColumn("run", F.sum("new").over(way)).groupBy(*pair, "run").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.min("other_start").alias("other_start"))
    spans = spans.select("id", "start", (F.col("end") - F.col("start")).alias("n_words"), "other", "other_start")
    return spans.unionByName(whole).distinct().select(F.col("id").alias(id_col), "start", "n_words", F.col("other").alias(f"other_{id_col}"), "other_start")
