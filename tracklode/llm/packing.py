"""Sequence packing by non-negative least squares over shallow length combinations.

Documents become token ids once; a document longer than the window is cut into full windows and a rest, and only
(id, start, length, checksum) goes on. The histogram of lengths in bins (of one token for short pieces, of at most 1/128
of the length for others: under 800 bins, whatever the input) is all the driver sees. Combinations of up to three lengths
that fill the window, the first of them repeated where it is short, are the columns of a non-negative least-squares
problem whose solution says how often to use each; the counts are rounded down, and what is left over is packed best-fit,
largest first, in bulk. Pieces then find their places by their rank within a bin, which is counted in hash groups of
bounded size, so a length that a third of all documents share is spread over many tasks.

Defined cases: null text is empty, and an empty document is the end id alone; rows that repeat an id are packed one by
one; a null id is kept as it is; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, small_batches
from .textkit import U64, chunk_words

WINDOW = 4096
END_ID = 2
#: Bytes of known words and their ids in each Python worker.
CACHE_BYTES = 20 << 20
#: Bytes of text whose words are looked up together.
CHUNK_BYTES = 1 << 19
#: New words in a text.
LIST_WORDS = 4000
#: A combination leaves at most this share of the window empty.
SLACK = 1 / 128
#: Pieces in a hash group within which ranks are counted.
GROUP_PIECES = 50_000

_cache: dict[str, WordIds] = {}
_tokenizers: dict[str, object] = {}


def tokenizer(path: str):
    if path not in _tokenizers:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        _tokenizers[path] = Tokenizer.from_file(path)
    return _tokenizers[path]


def encode_words(words: list[bytes], tokenizer) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all words, number of ids of each) of words without white space, encoded as one text and told apart by offsets."""
    texts = [w.decode() for w in words]
    encoded = tokenizer.encode(" ".join(texts), add_special_tokens=False)
    starts = np.cumsum([0, *(len(t) + 1 for t in texts)])
    return np.array(encoded.ids, np.uint32), np.diff(np.searchsorted(np.array([o[0] for o in encoded.offsets], np.int64), starts))


class WordIds:
    """The ids of known words by the words' 64-bit hashes, about 40 bytes a word, in sorted arrays.

    When they are full, the words used most stay: at most half of the bytes.
    """

    def __init__(self, path: str):
        self.path = path
        self.hashes, self.start, self.count, self.used, self.pool = np.zeros(0, U64), *(np.zeros(0, np.int32) for _ in range(3)), np.zeros(0, np.uint32)

    def evict(self) -> None:
        order = np.argsort(-self.used, kind="stable")
        keep = np.sort(order[np.cumsum(20 + 4 * self.count[order].astype(np.int64)) <= CACHE_BYTES // 2])
        keep = keep[self.used[keep] > 1]
        count = self.count[keep]
        start = np.cumsum(count) - count
        self.pool = self.pool[np.repeat(self.start[keep] - start, count) + np.arange(count.sum())]
        self.hashes, self.start, self.count, self.used = self.hashes[keep], start.astype(np.int32), count, self.used[keep] // 2

    def missing(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places of sorted hashes in the arrays, which of them are not there)."""
        at = np.searchsorted(self.hashes, hashes)
        if not len(self.hashes):
            return at, np.ones(len(hashes), bool)
        return at, self.hashes[np.minimum(at, len(self.hashes) - 1)] != hashes

    def places(self, hashes: np.ndarray, words: Callable[[np.ndarray], list[bytes]]) -> np.ndarray:
        """Places of sorted, distinct hashes; words() gives the words of those that are new."""
        if 20 * len(self.hashes) + 4 * len(self.pool) > CACHE_BYTES:
            self.evict()
        at, new = self.missing(hashes)
        if new.any():
            which = np.flatnonzero(new)
            got = [encode_words(words(which[i : i + LIST_WORDS]), tokenizer(self.path)) for i in range(0, len(which), LIST_WORDS)]
            count = np.concatenate([c for _, c in got])
            start = len(self.pool) + np.cumsum(count) - count
            self.pool = np.concatenate([self.pool, *(ids for ids, _ in got)])
            for name, values in (("hashes", hashes[which]), ("start", start), ("count", count), ("used", np.zeros(len(which), np.int32))):
                setattr(self, name, np.insert(getattr(self, name), at[which], values))
            at = np.searchsorted(self.hashes, hashes)
        self.used[at] += 1
        return at


def encode(texts: pa.Array, path: str, end_id: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(ids, offsets of the rows in them) of runs of texts, the end id last in every row.

    The vocabulary marks word ends and drops white space, so the ids of a text are those of its white-space-separated
    parts in turn, and each part needs the tokenizer only once.
    """
    known = _cache.setdefault(path, WordIds(path))
    for lo, hi, data, starts, ends, row, all_hashes in chunk_words(texts, False, CHUNK_BYTES):
        hashes, first, inverse = np.unique(all_hashes, return_index=True, return_inverse=True)
        at = known.places(hashes, lambda which: [data[starts[i] : ends[i]].tobytes() for i in first[which]])[inverse]
        count = known.count[at].astype(np.int64)
        total = np.cumsum(count)
        ids = known.pool[np.repeat(known.start[at] - (total - count), count) + np.arange(total[-1] if len(total) else 0)]
        per_row = np.bincount(row, weights=count, minlength=hi - lo).astype(np.int64)
        out = np.full(len(ids) + hi - lo, end_id, "<u4")
        out[np.arange(len(ids)) + np.repeat(np.arange(hi - lo), per_row)] = ids
        yield out, np.concatenate([[0], np.cumsum(per_row + 1)])


def piece_batches(batches: Iterator[pa.RecordBatch], path: str, window: int, end_id: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        at, start, length, crc, total = [], [], [], [], []
        row = 0
        for ids, offs in encode(batch.column(1), path, end_id):
            data = memoryview(ids.tobytes())
            for a, b in zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True):
                for s in range(a, b, window):
                    e = min(s + window, b)
                    at.append(row)
                    start.append(s - a)
                    length.append(e - s)
                    crc.append(zlib.crc32(data[4 * s : 4 * e]))
                    total.append(b - a)
                row += 1
        cols = [batch.column(0).take(pa.array(at, pa.int64())), *(pa.array(x, pa.int64()) for x in (start, length, crc, total))]
        yield pa.RecordBatch.from_arrays(cols, ["id", "start", "length", "ids_crc32", "doc_tokens"])


def bin_sizes(window: int) -> np.ndarray:
    """The largest length of each bin, ascending: every length up to 256, then steps of at most 1/128 of the length."""
    sizes, step, at = [], 1, 0
    while at < window:
        at = min(at + step, window)
        sizes.append(at)
        if at >= 256 * step:
            step *= 2
    return np.array(sizes, np.int64)


def combinations(sizes: np.ndarray, present: np.ndarray, window: int) -> np.ndarray:
    """Rows (a, b, c, m): m pieces of bin a, one of bin b and one of bin c (-1: none) that fill the window but for SLACK.

    Only bins that are present take part; the last piece is the largest that fits, so there is at most one row for each
    a, b and m.
    """
    own = np.flatnonzero(present)
    s = sizes[own]
    fits = lambda gap: np.searchsorted(s, gap, "right") - 1
    rows = []
    for i in range(len(own)):
        most = window // int(s[i])
        for m in {1, *range(max(2, most - 3), most + 1)} if most > 1 else {1}:
            gap = window - m * int(s[i])
            b = np.arange(-1, fits(gap) + 1)
            b = b[b <= i] if m == 1 else b[-min(len(b), 8) :]
            left = gap - np.where(b >= 0, s[b], 0)
            c = np.minimum(fits(left), b)
            ok = (left >= 0) & (left - np.where(c >= 0, s[c], 0) <= window * SLACK)
            rows += [np.stack([np.full(ok.sum(), own[i]), np.where(b[ok] >= 0, own[b[ok]], -1), np.where(c[ok] >= 0, own[c[ok]], -1), np.full(ok.sum(), m)], axis=1)]
    return np.concatenate(rows) if rows else np.zeros((0, 4), np.int64)


def nnls(parts: np.ndarray, target: np.ndarray, rounds: int = 600) -> np.ndarray:
    """x >= 0 minimising |A x - target|, A's column j counting the pieces of combination j by bin (active-set method)."""
    n, bins = len(parts), len(target)
    x = np.zeros(n)
    padded = lambda v: np.append(v, 0.0)  # noqa: E731  index -1 is no bin
    active: list[int] = []
    columns = np.zeros((bins, 0))
    barred = np.zeros(n, bool)
    scale = max(1.0, target.max(initial=0))
    for _ in range(rounds):
        rest = padded(target - columns @ x[active])
        gain = rest[parts[:, 0]] * parts[:, 3] + rest[parts[:, 1]] + rest[parts[:, 2]]
        gain[active] = -np.inf
        gain[barred] = -np.inf
        best = int(gain.argmax()) if n else 0
        if not n or gain[best] <= 1e-6 * scale or len(active) >= bins:
            break
        new = np.zeros(bins + 1)
        np.add.at(new, parts[best, :3], [parts[best, 3], 1, 1])
        active.append(best)
        columns = np.concatenate([columns, new[:bins, None]], axis=1)
        while active:
            gram = columns.T @ columns
            s = np.linalg.solve(gram + 1e-10 * np.trace(gram) / len(active) * np.eye(len(active)), columns.T @ target)
            now = x[active]
            if s.min() > 1e-9:
                x[:] = 0
                x[active] = s
                break
            bad = s <= 1e-9
            step = min(1.0, float(np.min(now[bad] / np.maximum(now[bad] - s[bad], 1e-12))))
            now = now + step * (s - now)
            stay = now > 1e-9
            if stay.all():
                stay[int(now.argmin())] = False
            if not stay[-1]:
                barred[active[-1]] = True  # it cannot rise from zero
            x[:] = 0
            active = [j for j, k in zip(active, stay, strict=True) if k]
            x[active] = now[stay]
            columns = columns[:, stay]
    return x


def plan(counts: np.ndarray, sizes: np.ndarray, window: int) -> list[tuple[dict[int, int], int]]:
    """Patterns ({bin: how often in a sequence}, number of sequences) that use up counts (by bin)."""
    left = counts.astype(np.int64).copy()
    out: list[tuple[dict[int, int], int]] = []

    def use(pattern: dict[int, int], times: int) -> None:
        times = min(times, *(int(left[b]) // m for b, m in pattern.items()))
        if times > 0:
            out.append((pattern, times))
            for b, m in pattern.items():
                left[b] -= m * times

    parts = combinations(sizes, counts > 0, window)
    repeats = np.floor(nnls(parts, counts.astype(float)) + 1e-6).astype(np.int64)
    for a, b, c, m, times in np.column_stack([parts, repeats])[repeats > 0].tolist():
        pattern = {a: m}
        for extra in (b, c):
            if extra >= 0:
                pattern[extra] = pattern.get(extra, 0) + 1
        use(pattern, times)
    while left.any():
        pattern = {}
        gap = window
        alive = np.flatnonzero(left)
        at = len(alive)
        while True:  # the largest piece that fits; bins fall along the pattern
            at = min(at, int(np.searchsorted(sizes[alive], gap, "right"))) - 1
            if at < 0:
                break
            b = int(alive[at])
            m = min(gap // int(sizes[b]), int(left[b]))
            pattern[b] = m
            gap -= m * int(sizes[b])
        use(pattern, int(left.max()))
    return out


def place_batches(batches: Iterator[pa.RecordBatch], first: np.ndarray, base: np.ndarray, times: np.ndarray, slot: np.ndarray) -> Iterator[pa.RecordBatch]:
    """bin and rank (columns 0 and 1) become sequence_id, slot and nth: `first` are the keys bin * 2**40 + rank of the runs."""
    for batch in batches:
        key = batch.column(0).to_numpy().astype(np.int64) * 2**40 + batch.column(1).to_numpy()
        run = np.searchsorted(first, key, "right") - 1
        since = key - first[run]
        out = [base[run] + since // times[run], slot[run], since % times[run]]
        yield pa.RecordBatch.from_arrays([*(pa.array(x) for x in out), *batch.columns[2:]], ["sequence_id", "slot", "nth", *batch.schema.names[2:]])


def pack(documents: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, end_id: int = END_ID) -> DataFrame:
    """Per piece: id_col, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    small_batches(documents.sparkSession)
    kind = documents.schema[id_col].dataType.simpleString()
    docs = documents.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    pieces = cut(docs.mapInArrow(lambda it: piece_batches(it, tokenizer_path, window, end_id), f"id {kind}, start long, length long, ids_crc32 long, doc_tokens long"), "pieces")
    sizes = bin_sizes(window)
    # The first bin whose largest length is not below the piece's, in closed form: bins of step 2**k end at 256 * 2**k.
    k = F.greatest(F.lit(0), F.ceil(F.log2(F.col("length") / 256)))
    step = F.pow(F.lit(2.0), k)
    own = F.when(F.col("length") <= 256, F.col("length") - 1).otherwise(256 + 128 * (k - 1) + F.ceil(F.col("length") / step) - 129)
    pieces = pieces.withColumn("bin", own.cast("int"))

    counts = np.zeros(len(sizes), np.int64)
    for row in pieces.groupBy("bin").count().collect():  # one row for each bin
        counts[row["bin"]] = row["count"]
    runs, used, base = [], np.zeros(len(sizes), np.int64), 0
    for pattern, times in plan(counts, sizes, window):
        for slot, (b, m) in enumerate(sorted(pattern.items(), reverse=True)):
            runs.append((b * 2**40 + int(used[b]), base, m, slot))
            used[b] += m * times
        base += times
    first, bases, times, slots = np.array(sorted(runs), np.int64).reshape(-1, 4).T.copy()  # bounded by the bins

    groups = max(1, int(counts.sum()) // GROUP_PIECES)
    pieces = pieces.withColumn("grp", F.pmod(F.xxhash64("id", "start", "ids_crc32"), F.lit(groups)))
    per_group = pieces.groupBy("grp", "bin").agg(F.count(F.lit(1)).alias("n"))
    before = per_group.select("grp", "bin", (F.sum("n").over(Window.partitionBy("bin").orderBy("grp")) - F.col("n")).alias("before"))
    ranked = pieces.withColumn("rank", F.row_number().over(Window.partitionBy("grp", "bin").orderBy("id", "start", "length", "ids_crc32")) - 1)
    ranked = ranked.join(before, ["grp", "bin"]).select("bin", (F.col("rank") + F.col("before")).alias("rank"), "id", "start", "length", "ids_crc32", "doc_tokens")
    placed = ranked.mapInArrow(lambda it: place_batches(it, first, bases, times, slots), f"sequence_id long, slot long, nth long, id {kind}, start long, length long, ids_crc32 long, doc_tokens long")
    order = Window.partitionBy("sequence_id").orderBy("slot", "nth")
    return placed.select(F.col("id").alias(id_col), "start", "length", "ids_crc32", "doc_tokens", "sequence_id", (F.sum("length").over(order) - F.col("length")).alias("offset"))
