"""Language-model scoring with a log-bilinear model trained by noise-contrastive estimation.

Tokens are ASCII-lower-cased words (64-bit hashes of them) and one end for each text. The most frequent words (and the
end) have vectors of their own, and all other words share the vectors of their ending class; the number of words with
vectors grows with the vocabulary, up to MAX_OWN. A context is the weighted sum of the vectors of the CONTEXT tokens
before; the model first gives the class of the next token, then the word within the class, both as a normalised
exponential of the product of context and output vectors. A word without a vector of its own is its class's rest entry
times its add-half share of the training count of the class's rest, so the model is a distribution over all words and one
unknown word.

Training goes over all training texts. A hash of id and text deals them to shards of about SHARD_TOKENS tokens, in an order
by hash, so that what is learned follows from the rows alone and not from how the input is partitioned. Every shard runs
noise-contrastive steps over its own tokens, and the parameters are averaged by tokens, which Spark sums by parameter
row; a small corpus is gone over several times. The driver holds parameters only, whose number is bounded by MAX_OWN.

A text's words need their counts. The counts of the KNOWN_WORDS most frequent words go to the tasks; for the others,
tasks replace words by their place in a dictionary of the task's block of texts, only the distinct words of a block are
joined with the counts, and each block then meets its own dictionary again.

Defined cases: null text is empty, so its only token is the end; rows that repeat are scored one by one; without training
texts every token is unknown; a null id is scored and is not held out; an empty table gives an empty result; other
columns are not read.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, small_batches
from .textkit import U64, chunk_words, mix, runs

CLASSES = 64
#: Words with vectors of their own: those with at least MIN_COUNT occurrences, at most so many.
MAX_OWN, MIN_COUNT = 4096, 8
#: Most words whose counts are sent to the tasks.
KNOWN_WORDS = 1 << 18
CONTEXT, DIMENSIONS, NOISE, CLASS_NOISE, BATCH = 3, 32, 32, 16, 768
#: Training steps see so many tokens at least: in up to MAX_PASSES passes over the texts, each up to MAX_ROUNDS times over a block.
MIN_SEEN, MAX_PASSES, MAX_ROUNDS = 1_500_000, 5, 4
RATE, DECAY, SQUARES = 0.1, 0.5, 0.1  # step size, its fall over the passes, first sum of squares
END_HASH = np.int64(-(1 << 62) + 12345)  # the end's key beside the words' hashes
BLOCK_WORDS = 600_000
SHARD_TOKENS = 2_000_000


def endings(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Class by ending: the last two bytes (A-Z as a-z), whether the word is longer than four bytes."""
    lower = lambda b: b + U64(32) * ((b >= 65) & (b <= 90)).astype(U64)
    last = lower(data[ends - 1].astype(U64))
    second = np.where(ends - starts > 1, lower(data[np.maximum(ends - 2, 0)].astype(U64)), U64(0))
    return (mix(last + second * U64(256) + (ends - starts > 4).astype(U64) * U64(65536)) % U64(CLASSES)).astype(np.uint8)


def block_words(batches: Iterator[pa.RecordBatch], text: int) -> Iterator[tuple[list[pa.RecordBatch], np.ndarray, np.ndarray, np.ndarray]]:
    """(batches of the block, hashes, ending classes, words of each row) of blocks of about BLOCK_WORDS words."""
    held, hashes, classes, counts, size = [], [], [], [], 0
    for batch in batches:
        for lo, hi, data, starts, ends, rows, own in chunk_words(batch.column(text)):
            held.append(batch.slice(lo, hi - lo))
            hashes.append(own.view(np.int64))
            classes.append(endings(data, starts, ends) if len(starts) else np.zeros(0, np.uint8))
            counts.append(np.diff(runs(rows, hi - lo)))
            size += len(starts)
            if size >= BLOCK_WORDS:
                yield held, np.concatenate(hashes), np.concatenate(classes), np.concatenate(counts)
                held, hashes, classes, counts, size = [], [], [], [], 0
    if held:
        yield held, np.concatenate(hashes), np.concatenate(classes), np.concatenate(counts)


def count_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, ending, n) of the distinct tokens of each block."""
    for _, hashes, classes, counts in block_words(batches, 0):
        words, first, n = np.unique(hashes, return_index=True, return_counts=True)
        words, n, ending = np.append(words, END_HASH), np.append(n, len(counts)), np.append(classes[first], 0)
        yield pa.RecordBatch.from_arrays([pa.array(words), pa.array(ending.astype(np.int32)), pa.array(n.astype(np.int64))], ["word", "ending", "n"])


@dataclass
class Vocabulary:
    """Entries: the words with vectors, by falling count, then a rest entry for each class."""

    tokens: int  # N
    distinct: int  # V
    end_count: int
    known: np.ndarray  # sorted hashes of the most frequent words
    known_count: np.ndarray
    known_entry: np.ndarray  # their entries; -1 for the rest of their class
    counts: np.ndarray  # tokens of each entry
    members: np.ndarray  # class of each entry
    rest_log: np.ndarray  # log10 of the add-half total of each class's rest, the unknown word included
    end: int  # the end's entry

    @property
    def own(self) -> int:
        return len(self.counts) - CLASSES

    def look(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place among the known words, whether it is known)."""
        if not len(self.known):
            return np.zeros(len(hashes), np.int64), np.zeros(len(hashes), bool)
        at = np.minimum(np.searchsorted(self.known, hashes), len(self.known) - 1)
        return at, self.known[at] == hashes

    def entries(self, hashes: np.ndarray, ending: np.ndarray, found: tuple[np.ndarray, np.ndarray] | None = None) -> np.ndarray:
        at, there = self.look(hashes) if found is None else found
        out = np.where(there, self.known_entry[at] if len(self.known) else -1, -1)
        return np.where(out < 0, self.own + ending.astype(np.int64), out)


def sequences(v: Vocabulary, hashes: np.ndarray, ending: np.ndarray, counts: np.ndarray, found: tuple[np.ndarray, np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(entry of each token, the ends included, contexts tokens x CONTEXT nearest first, row of each token); texts begin after ends."""
    row = np.repeat(np.arange(len(counts)), counts)
    seq = np.full(len(hashes) + len(counts), v.end, np.int32)
    seq[np.arange(len(hashes)) + row] = v.entries(hashes, ending, found)
    rows = np.repeat(np.arange(len(counts)), counts + 1)
    begin = np.concatenate([[0], np.cumsum(counts + 1)])[:-1][rows]
    at = np.arange(len(seq))
    contexts = np.stack([np.where(at - k >= begin, seq[np.maximum(at - k, 0)], v.end) for k in range(1, CONTEXT + 1)], axis=1)
    return seq, contexts, rows


@dataclass
class LogBilinear:
    """All parameters as one table, a row for each vector; the biases are the last column."""

    table: np.ndarray  # (entries context, entries output, CLASSES class output, CONTEXT weights) x (DIMENSIONS + 1)

    @staticmethod
    def start(v: Vocabulary, seed: int = 3) -> LogBilinear:
        rng = np.random.default_rng(seed)
        e = len(v.counts)
        table = rng.normal(0, 0.1, (2 * e + CLASSES + CONTEXT, DIMENSIONS + 1)).astype(np.float32)
        share = (v.counts + 0.5) / (v.counts + 0.5).sum()
        table[:e, -1] = 0
        table[e : 2 * e, -1] = np.log(share)
        table[2 * e : 2 * e + CLASSES, -1] = np.log(np.bincount(v.members, weights=share, minlength=CLASSES) + 1e-9)
        table[-CONTEXT:] = 0.5
        return LogBilinear(table)

    def parts(self, v: Vocabulary) -> tuple[np.ndarray, ...]:
        """Views: context vectors, output vectors, their biases, class vectors, their biases, weights."""
        e, d = len(v.counts), DIMENSIONS
        t = self.table
        return t[:e, :d], t[e : 2 * e, :d], t[e : 2 * e, d], t[2 * e : 2 * e + CLASSES, :d], t[2 * e : 2 * e + CLASSES, d], t[-CONTEXT:, :d]

    def predicted(self, v: Vocabulary, contexts: np.ndarray) -> np.ndarray:
        return gathered(self.weighted(v), contexts)

    def weighted(self, v: Vocabulary) -> list[np.ndarray]:
        """The context vectors times the weights of each place: a few thousand rows, so weighed once and not for each token."""
        words, *_, weights = self.parts(v)
        return [words * w for w in weights]


def gathered(weighted: list[np.ndarray], contexts: np.ndarray) -> np.ndarray:
    """Sum over the places of a context of their weighted vectors."""
    q = weighted[0][contexts[:, 0]]
    for k in range(1, CONTEXT):
        q += weighted[k][contexts[:, k]]
    return q


def summed(rows: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(distinct rows, sums of the values of each)."""
    order = np.argsort(rows, kind="stable")
    rows = rows[order]
    first = np.flatnonzero(np.concatenate([[True], rows[1:] != rows[:-1]]))
    return rows[first], np.add.reduceat(values[order], first, axis=0)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return np.float32(1) / (np.float32(1) + np.exp(-np.clip(x, np.float32(-30), np.float32(30))))


class Trainer:
    """Noise-contrastive steps with per-element step sizes (AdaGrad)."""

    def __init__(self, v: Vocabulary, model: LogBilinear, number: int, shard: int = 0):
        self.v, self.model = v, model
        self.rate = np.float32(RATE / (1 + number) ** DECAY)
        self.squares = np.full_like(model.table, SQUARES)
        self.rng = np.random.default_rng((number, shard))
        share = (v.counts + 0.5) ** 0.75
        by_class = np.bincount(v.members, weights=v.counts + 0.5, minlength=CLASSES)
        self.heads = []
        for p, k in ((share / share.sum(), NOISE), (by_class / by_class.sum(), CLASS_NOISE)):
            self.heads.append((np.cumsum(p), k, np.log(k * p).astype(np.float32)))

    def step(self, entries: np.ndarray, contexts: np.ndarray) -> None:
        v, m, n = self.v, self.model, len(entries)
        words, out, out_bias, classes, class_bias, weights = m.parts(v)
        e = len(v.counts)
        looked = [words[contexts[:, k]] for k in range(CONTEXT)]
        q = looked[0] * weights[0]
        for x, w in zip(looked[1:], weights[1:], strict=True):
            q += x * w
        g_q = np.zeros_like(q)
        # Gradients of all parameters in one array, its rows named by those of the table; narrow names sort by radix.
        rows = np.empty((2 + CONTEXT) * n + NOISE + CLASS_NOISE + CONTEXT, np.min_scalar_type(len(m.table)))
        grads = np.zeros((len(rows), DIMENSIONS + 1), np.float32)
        at = 0
        for (share, k, odds), vectors, bias, real, first in ((self.heads[0], out, out_bias, entries, e), (self.heads[1], classes, class_bias, v.members[entries], 2 * e)):
            fake = np.minimum(np.searchsorted(share, self.rng.random(k)), len(share) - 1)
            # Gradients of -log s(real) - sum log(1 - s(fake)), s the odds against the noise.
            own = vectors[real]
            up = sigmoid(np.einsum("ij,ij->i", q, own) + bias[real] - odds[real]) - np.float32(1)
            down = sigmoid(q @ vectors[fake].T + (bias[fake] - odds[fake]))
            g_q += up[:, None] * own + down @ vectors[fake]
            for names, by, total in ((real, up[:, None] * q, up), (fake, down.T @ q, down.sum(axis=0))):
                part = slice(at, at + len(names))
                rows[part], grads[part, :-1], grads[part, -1] = first + names, by, total
                at = part.stop
        for k, w in enumerate(weights):
            part = slice(at, at + n)
            rows[part], grads[part, :-1] = contexts[:, k], g_q * w
            at = part.stop
        rows[at:], grads[at:, :-1] = np.arange(len(m.table) - CONTEXT, len(m.table)), [(g_q * x).sum(axis=0) for x in looked]
        changed, g = summed(rows, grads)
        g *= np.float32(32 / n)
        squares = self.squares[changed] + g * g
        self.squares[changed] = squares
        m.table[changed] -= self.rate * g / np.sqrt(squares)


def of_shards(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.RecordBatch]]:
    """(shard, rows) of batches (shard, text) in order of shard, cut where the shard changes."""
    for batch in batches:
        shard = batch.column(0).to_numpy()
        ends = [*(np.flatnonzero(np.diff(shard)) + 1).tolist(), len(shard)]
        for lo, hi in zip([0, *ends[:-1]], ends, strict=True):
            if hi > lo:
                yield int(shard[lo]), batch.slice(lo, hi - lo)


def train_batches(batches: Iterator[pa.RecordBatch], v: Vocabulary, table: np.ndarray, number: int, rounds: int = 1) -> Iterator[pa.RecordBatch]:
    """(row, values, tokens): the parameters after the pass of that number over the tokens of each shard, weighted by them."""
    for shard, own in groupby(of_shards(batches), lambda x: x[0]):
        trainer, seen = Trainer(v, LogBilinear(table.copy()), number, shard), 0
        for _, hashes, ending, counts in block_words((b for _, b in own), 1):
            entries, contexts, _ = sequences(v, hashes, ending, counts)
            for _ in range(rounds):
                order = trainer.rng.permutation(len(entries))
                for i in range(0, len(order), BATCH):
                    trainer.step(entries[order[i : i + BATCH]], contexts[order[i : i + BATCH]])
            seen += len(entries)
        t = trainer.model.table
        for i in range(0, len(t) if seen else 0, 2048):
            part = t[i : i + 2048]
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(part) + 1, dtype=np.int32) * part.shape[1]), pa.array(part.reshape(-1)))
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(i, i + len(part), dtype=np.int32)), lists, pa.array(np.full(len(part), float(seen)))], ["row", "values", "tokens"])


def sum_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(row, values, tokens): the weighted sums of a partition's rows, a few kilobytes a row of the parameters at most."""
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        values = batch.column(1).flatten().to_numpy().reshape(batch.num_rows, -1).astype(np.float64)
        weight = batch.column(2).to_numpy()
        rows, sums = summed(batch.column(0).to_numpy(), np.column_stack([values * weight[:, None], weight])) if batch.num_rows else ([], [])
        for r, s in zip(rows, sums, strict=True):
            total[int(r)] = total[int(r)] + s if int(r) in total else s
    if total:
        rows = sorted(total)
        sums = np.stack([total[r] for r in rows])
        flat = sums[:, :-1].astype(np.float32)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * flat.shape[1]), pa.array(flat.reshape(-1)))
        yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int32()), lists, pa.array(sums[:, -1])], ["row", "values", "tokens"])


PARAMETERS = "row int, values array<float>, tokens double"


def train(spark: SparkSession, texts: DataFrame, v: Vocabulary, shard_tokens: int = SHARD_TOKENS) -> LogBilinear:
    """Passes over all training texts (id, text), the shards' parameters averaged by tokens after each."""
    model = LogBilinear.start(v)
    shards = max(1, v.tokens // shard_tokens)
    dealt = texts.select(F.pmod(F.xxhash64("id", "text"), F.lit(shards)).cast("int").alias("shard"), F.xxhash64(F.lit("order"), "id", "text").alias("h"), "text")
    dealt = dealt.repartition(shards, "shard").sortWithinPartitions("shard", "h").select("shard", "text")
    wanted = max(1, -(-MIN_SEEN // max(1, v.tokens)))
    passes = min(MAX_PASSES, wanted)
    rounds = min(MAX_ROUNDS, -(-wanted // passes))
    for k in range(passes):
        shared = spark.sparkContext.broadcast((v, model.table))
        learned = dealt.mapInArrow(lambda it, shared=shared, k=k: train_batches(it, *shared.value, k, rounds), PARAMETERS)
        summed_rows = learned.repartition(spark.sparkContext.defaultParallelism, "row").mapInArrow(sum_batches, PARAMETERS)
        got = summed_rows.toPandas()  # a row for each row of the parameters
        if len(got):
            table = model.table.copy()
            table[got["row"].to_numpy()] = np.stack(got["values"].to_numpy()) / got["tokens"].to_numpy()[:, None]
            model = LogBilinear(table)
        shared.unpersist()
    return model


def log_probabilities(v: Vocabulary, model: LogBilinear, entries: np.ndarray, contexts: np.ndarray, step: int = 16_384) -> np.ndarray:
    """Normalised natural log probability of each token's entry in its context, by batched matrix products over classes, then within each."""
    _, out, out_bias, classes, class_bias, _ = model.parts(v)
    groups = [np.flatnonzero(v.members == c) for c in range(CLASSES)]
    inside = np.zeros(len(v.counts), np.int64)
    for g in groups:
        inside[g] = np.arange(len(g))
    logs, weighted = np.zeros(len(entries)), model.weighted(v)

    def log_softmax(x: np.ndarray, at: np.ndarray) -> np.ndarray:
        x -= x.max(axis=1, keepdims=True)
        own = x[np.arange(len(x)), at]
        return own - np.log(np.exp(x, out=x).sum(axis=1))

    for i in range(0, len(entries), step):
        own = entries[i : i + step]
        q, kind = gathered(weighted, contexts[i : i + step]), v.members[own]
        logs[i : i + step] = log_softmax(q @ classes.T + class_bias, kind)
        order = np.argsort(kind, kind="stable")
        ends = np.searchsorted(kind[order], np.arange(CLASSES + 1))
        for c, g in enumerate(groups):
            at = order[ends[c] : ends[c + 1]]
            if len(at):
                logs[i + at] += log_softmax(q[at] @ out[g].T + out_bias[g], inside[own[at]])
    return logs


SCORE_COLUMNS = "kind int, block long, id {id}, n_tokens long, n_known long, neural double, base double, rest double, places binary, word long, place int"


def score_batches(batches: Iterator[pa.RecordBatch], v: Vocabulary, model: LogBilinear) -> Iterator[pa.RecordBatch]:
    """Rows of kind 0: a text with its scores so far and its rarer words as (place, count) in the block's dictionary; of kind 1: the dictionary.

    base sums log10(c + 0.5) of the known words and the end; rest what words without vectors add to the neural score:
    their log10(c + 0.5) as far as they are known, less the total of their class's rest.
    """
    names = [x.split()[0] for x in SCORE_COLUMNS.split(", ")]
    logs = np.log10(v.known_count + 0.5)
    for held, hashes, ending, counts in block_words(batches, 1):
        block = np.int64(uuid.uuid4().int >> 65)
        n_rows = len(counts)
        at, there = found = v.look(hashes)
        entries, contexts, row = sequences(v, hashes, ending, counts, found)
        neural = np.bincount(row, weights=log_probabilities(v, model, entries, contexts), minlength=n_rows) / np.log(10)
        own = np.repeat(np.arange(n_rows), counts)
        vector = v.entries(hashes, ending, found) < v.own
        add = lambda rows, values: np.bincount(rows, weights=values, minlength=n_rows).astype(float)
        base = add(own[there], logs[at[there]]) + np.log10(v.end_count + 0.5)
        rest = add(own[there & ~vector], logs[at[there & ~vector]]) - add(own[~vector], v.rest_log[ending[~vector]])
        known = np.bincount(own[there], minlength=n_rows) + (v.end_count > 0)
        words, place = np.unique(hashes[~there], return_inverse=True)
        pairs, n = np.unique(own[~there] * (len(words) + 1) + place, return_counts=True)
        packed = np.stack([pairs % (len(words) + 1), n], axis=1).astype("<u4")
        cuts = np.searchsorted(pairs, np.arange(n_rows + 1) * (len(words) + 1))
        ids = pa.concat_arrays([b.column(0) for b in held])
        binary = pa.array([packed[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)], pa.binary())
        none = lambda kind, size: pa.nulls(size, kind)
        yield pa.RecordBatch.from_arrays([pa.array(np.zeros(n_rows, np.int32)), pa.array(np.full(n_rows, block)), ids, pa.array(counts + 1), pa.array(known.astype(np.int64)), pa.array(neural), pa.array(base), pa.array(rest), binary, none(pa.int64(), n_rows), none(pa.int32(), n_rows)], names)
        size = len(words)
        yield pa.RecordBatch.from_arrays([pa.array(np.ones(size, np.int32)), pa.array(np.full(size, block)), none(ids.type, size), none(pa.int64(), size), none(pa.int64(), size), *(none(pa.float64(), size) for _ in range(3)), none(pa.binary(), size), pa.array(words), pa.array(np.arange(size, dtype=np.int32))], names)


def sum_counts(texts: pd.DataFrame, dictionary: pd.DataFrame, tokens: int, distinct: int) -> pd.DataFrame:
    """Base and model scores of a block's texts once the counts of its dictionary are there."""
    parts = [np.frombuffer(packed, "<u4").reshape(-1, 2) for packed in texts["places"]]
    count = np.zeros(1 + max((int(p[-1, 0]) for p in parts if len(p)), default=0), np.int64)  # places ascend in a text
    count[dictionary["place"]] = dictionary["c"]
    logs = np.log10(count + 0.5)
    total, known = np.zeros(len(texts)), texts["n_known"].to_numpy().copy()
    for i, part in enumerate(parts):
        total[i] = (logs[part[:, 0]] * part[:, 1]).sum()
        known[i] += part[count[part[:, 0]] > 0, 1].sum()
    n = texts["n_tokens"].to_numpy()
    base = texts["base"].to_numpy() + total - n * np.log10(tokens + 0.5 * (distinct + 1))
    return pd.DataFrame({"id": texts["id"], "n_tokens": n, "n_known": known, "base_score": base, "score": texts["neural"].to_numpy() + texts["rest"].to_numpy() + total})


def vocabulary(counted: DataFrame) -> Vocabulary:
    """From the table of counts (word, ending, c)."""
    end = int(END_HASH)
    size = counted.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
    end_count = (counted.where(F.col("word") == end).select("c").first() or [0])[0]
    words = counted.where(F.col("word") != end)
    # The most frequent words by a count from which on there are at most KNOWN_WORDS; only they are collected.
    level = F.floor(F.log2("c") * 16).cast("int")
    levels = words.groupBy(level.alias("level")).count().toPandas().sort_values("level", ascending=False)  # under 1024 rows
    kept = levels["level"][levels["count"].cumsum() <= KNOWN_WORDS]
    top = words.where(level >= int(kept.min()) if len(kept) else F.lit(False)).toPandas().sort_values(["c", "word"], ascending=[False, True], ignore_index=True)
    own = top[top["c"] >= MIN_COUNT].head(MAX_OWN - 1)
    every = words.groupBy("ending").agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("v")).toPandas()  # a row a class
    own_class = own["ending"].to_numpy(np.int64)
    tokens, types = np.zeros(CLASSES), np.zeros(CLASSES)
    tokens[every["ending"]], types[every["ending"]] = every["n"], every["v"]
    tokens -= np.bincount(own_class, weights=own["c"], minlength=CLASSES)
    types -= np.bincount(own_class, minlength=CLASSES)
    counts = np.concatenate([[end_count], own["c"].to_numpy(float), tokens])
    members = np.concatenate([[0], own_class, np.arange(CLASSES)]).astype(np.int64)
    order = np.argsort(top["word"].to_numpy(np.int64))
    entry = np.full(len(top), -1, np.int64)
    entry[: len(own)] = 1 + np.arange(len(own))
    return Vocabulary(int(size[0]), int(size[1]), int(end_count), top["word"].to_numpy(np.int64)[order], top["c"].to_numpy(np.int64)[order], entry[order], counts, members, np.log10(tokens + 0.5 * types + 0.5), 0)


def score(documents: DataFrame, training: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, n_tokens, n_known, train_tokens, base_score, score for every row; `training` marks the rows to learn from."""
    spark = documents.sparkSession
    small_batches(spark)
    texts = documents.where(training).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    counted = texts.select("text").mapInArrow(count_batches, "word long, ending int, n long").groupBy("word").agg(F.first("ending").alias("ending"), F.sum("n").alias("c"))
    counted = cut(counted, "counts")
    v = vocabulary(counted)
    shared = spark.sparkContext.broadcast((v, train(spark, texts, v)))

    kind = documents.schema[id_col].dataType.simpleString()
    parts = cut(documents.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(lambda it: score_batches(it, *shared.value), SCORE_COLUMNS.format(id=kind)), "blocks")
    words = parts.where("kind = 1").select("block", "word", "place")
    dictionary = words.join(counted.select("word", "c"), "word").select("block", "place", "c")  # words without a count stay at 0
    places = F.coalesce(F.col("places"), F.lit(b""))
    rows = parts.where("kind = 0").select(F.col("block").alias("of"), "id", "n_tokens", "n_known", "neural", "base", "rest", places.alias("places"))
    tokens, distinct = v.tokens, v.distinct
    got = rows.groupBy("of").cogroup(dictionary.groupBy("block")).applyInPandas(lambda a, b: sum_counts(a, b, tokens, distinct), f"id {kind}, n_tokens long, n_known long, base_score double, score double")
    return got.select(F.col("id").alias(id_col), "n_tokens", "n_known", F.lit(v.tokens).cast("long").alias("train_tokens"), "base_score", "score")
