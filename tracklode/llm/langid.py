"""Language ID by spans: script ranges narrow the candidates, Viterbi with a switching penalty labels the words.

A word is a run of letters. The scripts seen in its letters leave only languages that use them; a word's score for a
language is the sum of log probabilities of its byte trigrams (A-Z as a-z, word ends as byte 0) under that language's
smoothed, hashed counts. Viterbi over the words of a text, with one penalty for every change of language, gives spans;
the text's language is the one with most letters in them and the score is its share of the letters.

A run of letters of more than 2**18 bytes in a text of more than twice that is taken as several words.

Defined cases: null text or text without letters is 'und' with score 0; ties go to the language that sorts first; a
training table without usable rows makes every text 'und'; rows that repeat are predicted one by one; other columns are
not read. Only ids, texts and labels of training rows are learned from; a prediction reads the text alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches
from .textkit import text_chunks, word_spans

BUCKET_BITS = 16
SWITCH_PENALTY = 12.0
#: Training rows used: about so many, picked by a hash of the id. The counts below them have at most 2**16 rows a language.
TRAIN_ROWS = 20_000
SMOOTHING = 0.5
#: A language is a candidate for a script that holds at least this share of its letters.
SCRIPT_SHARE = 0.002
BLOCK_BYTES = 1 << 20

# Unicode block ranges by script (first, last, script).
SCRIPT_RANGES = [
    (0x0041, 0x024F, "Latin"), (0x0250, 0x02AF, "Latin"), (0x0370, 0x03FF, "Greek"), (0x0400, 0x052F, "Cyrillic"),
    (0x0530, 0x058F, "Armenian"), (0x0590, 0x05FF, "Hebrew"), (0x0600, 0x06FF, "Arabic"), (0x0750, 0x077F, "Arabic"),
    (0x0900, 0x097F, "Devanagari"), (0x0980, 0x09FF, "Bengali"), (0x0A00, 0x0A7F, "Gurmukhi"), (0x0A80, 0x0AFF, "Gujarati"),
    (0x0B80, 0x0BFF, "Tamil"), (0x0C00, 0x0C7F, "Telugu"), (0x0C80, 0x0CFF, "Kannada"), (0x0D00, 0x0D7F, "Malayalam"),
    (0x0E00, 0x0E7F, "Thai"), (0x10A0, 0x10FF, "Georgian"), (0x1100, 0x11FF, "Hangul"), (0x1E00, 0x1EFF, "Latin"),
    (0x1F00, 0x1FFF, "Greek"), (0x3040, 0x30FF, "Kana"), (0x3400, 0x4DBF, "Han"), (0x4E00, 0x9FFF, "Han"), (0xAC00, 0xD7AF, "Hangul"),
]
SCRIPTS = ["Other", *sorted({s for _, _, s in SCRIPT_RANGES})]


@cache
def letter_scripts() -> np.ndarray:
    """For each code point: -1 if it is no letter, else the number of its script."""
    out = np.full(0x110000, -1, np.int8)
    letters = [c for c in range(0x110000) if chr(c).isalpha()]
    out[letters] = 0
    for lo, hi, script in SCRIPT_RANGES:
        part = out[lo : hi + 1]
        part[part == 0] = SCRIPTS.index(script)
    return out


def byte_letters(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(byte belongs to a letter, places of letters' first bytes, their scripts)."""
    lead = np.flatnonzero((data & 0xC0) != 0x80)
    b = [data[np.minimum(lead + i, len(data) - 1)].astype(np.int32) for i in range(4)]
    code = np.where(b[0] < 0x80, b[0], np.where(b[0] < 0xE0, (b[0] & 0x1F) << 6 | b[1] & 0x3F, np.where(b[0] < 0xF0, (b[0] & 0x0F) << 12 | (b[1] & 0x3F) << 6 | b[2] & 0x3F, (b[0] & 0x07) << 18 | (b[1] & 0x3F) << 12 | (b[2] & 0x3F) << 6 | b[3] & 0x3F)))
    script = letter_scripts()[code]
    length = np.diff(np.append(lead, len(data)))
    return np.repeat(script >= 0, length), lead[script >= 0], script[script >= 0]


def trigrams(data: np.ndarray, inside: np.ndarray) -> np.ndarray:
    """The bucket of the trigram around each byte; bytes outside words count as 0."""
    low = data.astype(np.uint32)
    low[(data >= 65) & (data <= 90)] += 32
    low[~inside] = 0
    pad = np.concatenate([[0], low, [0]]).astype(np.uint32)
    key = pad[:-2] << np.uint32(16) | pad[1:-1] << np.uint32(8) | pad[2:]
    return (key * np.uint32(0x9E3779B1)) >> np.uint32(32 - BUCKET_BITS)


def split_rows(inside: np.ndarray, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word spans where a word is a run of letters within a row."""
    marked = inside.astype(np.uint8)
    return word_spans(marked, offs, np.array([True, False]))


@dataclass
class Model:
    languages: list[str]
    logp: np.ndarray  # buckets x languages
    uses: np.ndarray  # scripts x languages, bool


def count_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, bucket, n) summed over the partition; buckets from 2**16 on count letters by script."""
    totals: dict[str, np.ndarray] = {}
    for batch in batches:
        langs = np.array(batch.column(1).to_pylist(), object)
        parts = ((lo + row, part, own) for lo, _, data, offs in text_chunks(batch.column(0)) for row, _, part, own in pieces(data, offs))
        for lo, data, offs in parts:
            if not len(data):
                continue
            inside, at, script = byte_letters(data)
            buckets = trigrams(data, inside)
            row = np.searchsorted(offs, np.arange(len(data)), "right") - 1
            some = langs[lo : lo + len(offs) - 1]
            for lang in set(some):
                own = np.isin(row, np.flatnonzero(some == lang))
                total = totals.setdefault(lang, np.zeros((1 << BUCKET_BITS) + len(SCRIPTS), np.int64))
                total += np.bincount(np.concatenate([buckets[own & inside], (1 << BUCKET_BITS) + script[own[at]].astype(np.int64)]), minlength=len(total))
    for lang, total in totals.items():
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(some), pa.string()), pa.array(some.astype(np.int32)), pa.array(total[some])], ["lang", "bucket", "n"])


def train(rows: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", train_rows: int = TRAIN_ROWS) -> Model:
    """Learn from about train_rows of the rows that have id, text and language (all of them where there are fewer)."""
    small_batches(rows.sparkSession)
    rows = rows.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull() & F.col(lang_col).isNotNull())
    share = min(1.0, train_rows / max(1, rows.count()))
    rows = rows.where(F.pmod(F.xxhash64(F.col(id_col)), F.lit(1 << 20)) < int(share * (1 << 20)))
    counts = rows.select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).mapInArrow(count_batches, "lang string, bucket int, n long")
    got = counts.groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()  # at most 2**16 rows a language
    languages = sorted(got["lang"].unique())
    total = np.zeros(((1 << BUCKET_BITS) + len(SCRIPTS), len(languages)))
    total[got["bucket"], [languages.index(x) for x in got["lang"]]] = got["n"]
    grams, letters = total[: 1 << BUCKET_BITS], total[1 << BUCKET_BITS :]
    logp = np.log((grams + SMOOTHING) / (grams.sum(0) + SMOOTHING * (1 << BUCKET_BITS)))
    return Model(languages, logp.astype(np.float32), letters >= SCRIPT_SHARE * letters.sum(0))


def word_scores(model: Model, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(scores words x languages, start byte, end byte, row, letters) of each word."""
    inside, at, script = byte_letters(data)
    starts, ends, row = split_rows(inside, data, offs)
    if not len(starts):
        return np.zeros((0, len(model.languages)), np.float32), starts, ends, row, starts
    first = np.concatenate([[0], np.cumsum(ends - starts)])[:-1]
    scores = np.add.reduceat(model.logp[trigrams(data, inside)[inside]], first, axis=0)
    letter_at = np.searchsorted(at, starts)
    letters = np.diff(np.append(letter_at, len(at)))
    # Scripts narrow the candidates; a word in a script that no language uses says nothing.
    fits = np.minimum.reduceat(model.uses[script].astype(np.uint8), letter_at, axis=0).astype(bool)
    none = ~fits.any(axis=1)
    scores[~fits] -= 1000
    scores[none] = 0
    return scores, starts, ends, row, letters


def viterbi(scores: np.ndarray, bounds: np.ndarray, penalty: float = SWITCH_PENALTY) -> np.ndarray:
    """The best language of each word, rows in parallel: at step t those rows that have a word t, longest first."""
    n = np.diff(bounds)
    order = np.argsort(-n, kind="stable")
    starts = bounds[:-1][order]
    lengths = n[order]
    many = np.searchsorted(-lengths, -np.arange(1, (lengths[0] if len(lengths) else 0) + 1), "right")
    number = np.min_scalar_type(max(0, scores.shape[1] - 1))
    came = np.zeros(scores.shape, number)
    own = np.arange(scores.shape[1], dtype=number)
    value = np.zeros((len(n), scores.shape[1]), np.float32)
    for t, m in enumerate(many):
        v = value[:m]
        at = starts[:m] + t
        if t:
            best = v.argmax(axis=1)
            change = v[np.arange(m), best][:, None] - penalty
            came[at] = np.where(v >= change, own, best[:, None])
            v = np.maximum(v, change)
        v = v + scores[at]
        value[:m] = v - v.max(axis=1, keepdims=True)
    path = np.zeros(len(scores), number)
    state = value.argmax(axis=1)
    for t in range(len(many) - 1, -1, -1):
        m = many[t]
        at = starts[:m] + t
        path[at] = state[:m]
        state[:m] = came[at, state[:m]]
    return path


def keep_batches(batches: Iterator[pa.RecordBatch], column: int, model: Model, penalty: float, min_score: float) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        got = list(predict_batches(iter([pa.RecordBatch.from_arrays([batch.column(column)], ["text"])]), model, penalty, False))
        if got:
            found = pa.Table.from_batches(got)
            yield batch.filter(pa.array((found["lang_pred"].to_numpy() != "und") & (found["score"].to_numpy() >= min_score)))


def keep_identified(documents: DataFrame, model: Model, text_col: str = "text", penalty: float = SWITCH_PENALTY, min_score: float = 0.5) -> DataFrame:
    """The rows, columns unchanged, whose text has letters and a language that holds at least min_score of them."""
    small_batches(documents.sparkSession)
    at = documents.columns.index(text_col)
    shared = documents.sparkSession.sparkContext.broadcast(model)
    return documents.mapInArrow(lambda it: keep_batches(it, at, shared.value, penalty, min_score), documents.schema)


SPANS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("lang", pa.string())]))


def predict_batches(batches: Iterator[pa.RecordBatch], model: Model, penalty: float, spans: bool) -> Iterator[pa.RecordBatch]:
    """The other columns, then lang_pred, score and, if asked for, spans (byte ranges of the UTF-8 text)."""
    languages = np.array([*model.languages, "und"], object)
    for batch in batches:
        for lo, hi, data, offs in text_chunks(batch.column(0), BLOCK_BYTES):
            rest = [c.slice(lo, hi - lo) for c in batch.columns[1:]]
            got, shift, rows = [], [], []
            for first, at, part, own in pieces(data, offs) if model.languages else ():
                got.append(word_scores(model, part, own))
                shift.append(at)
                rows.append(first)
            n_rows = hi - lo
            if got and sum(len(g[0]) for g in got):
                scores, letters = np.concatenate([g[0] for g in got]), np.concatenate([g[4] for g in got])
                row = np.concatenate([g[3] + r for g, r in zip(got, rows, strict=False)])
                bounds = np.searchsorted(row, np.arange(n_rows + 1))
                path = viterbi(scores, bounds, penalty)
                share = np.zeros((n_rows, len(model.languages)))
                np.add.at(share, (row, path), letters)
                total = share.sum(axis=1)
                pred = np.where(total > 0, share.argmax(axis=1), len(model.languages))
                score = share.max(axis=1) / np.maximum(total, 1)
            else:
                row = path = np.zeros(0, np.int64)
                pred, score = np.full(n_rows, len(model.languages)), np.zeros(n_rows)
            out = [*rest, pa.array(languages[pred], pa.string()), pa.array(score)]
            if spans:
                starts = np.concatenate([g[1] + s for g, s in zip(got, shift, strict=False)]) if got else row
                ends = np.concatenate([g[2] + s for g, s in zip(got, shift, strict=False)]) if got else row
                lists: list[list[dict]] = [[] for _ in range(n_rows)]
                new = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (path[1:] != path[:-1])])) if len(row) else []
                for i, j in zip(new, [*new[1:], len(row)], strict=False):
                    lists[row[i]].append({"start": int(starts[i] - offs[row[i]]), "end": int(ends[j - 1] - offs[row[i]]), "lang": languages[path[i]]})
                out.append(pa.array(lists, SPANS))
            yield pa.RecordBatch.from_arrays(out, [*batch.schema.names[1:], "lang_pred", "score", *["spans"] * spans])


def pieces(data: np.ndarray, offs: np.ndarray, limit: int = 1 << 18) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, first byte, bytes, row offsets) of runs of rows of about limit bytes, so that work arrays stay small.

    A row of more than twice that is several pieces, cut behind the last ASCII byte that is no letter, or in front of a
    character where there is none: a run of letters of more than limit bytes counts as several words.
    """
    row = 0
    while row < len(offs) - 1:
        end = max(row + 1, int(np.searchsorted(offs, offs[row] + limit, "right")) - 1)
        lo, hi = int(offs[row]), int(offs[end])
        if hi - lo <= 2 * limit:
            yield row, lo, data[lo:hi], offs[row : end + 1] - lo
        else:
            while lo < hi:
                cut = min(lo + limit, hi)
                if cut < hi:
                    block = data[lo:cut]
                    plain = np.flatnonzero((block < 65) | ((block > 90) & (block < 97)) | ((block > 122) & (block < 128)))
                    whole = np.flatnonzero((data[lo + 1 : cut + 1] & 0xC0) != 0x80)
                    cut = lo + 1 + int(plain[-1] if len(plain) else whole[-1])
                yield row, lo, data[lo:cut], np.array([0, cut - lo])
                lo = cut
        row = end


def identify(documents: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", penalty: float = SWITCH_PENALTY, spans: bool = False) -> DataFrame:
    """id_col, lang_pred, score and, if asked for, spans, one row per row of documents."""
    small_batches(documents.sparkSession)
    kind = documents.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, lang_pred string, score double" + ", spans array<struct<start:int,end:int,lang:string>>" * spans
    shared = documents.sparkSession.sparkContext.broadcast(model)
    return documents.select(F.col(text_col).alias("_tl_text"), F.col(id_col)).mapInArrow(lambda it: predict_batches(it, shared.value, penalty, spans), schema)
