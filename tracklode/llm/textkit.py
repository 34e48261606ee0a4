"""Vectorised word splitting and hashing over Arrow string buffers.

A batch of texts is treated as one byte array, so the cost per word is a few numpy operations however the words are
spread over documents. Word hashes are 64-bit tabulated polynomials of the ASCII-lower-cased bytes.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 18
U64 = np.uint64
_BASE = 0x9E3779B97F4A7C15  # odd, hence invertible modulo 2**64


@cache
def space_table() -> np.ndarray:
    """Separators of the word class [^\\x20\\x09-\\x0D]+."""
    t = np.zeros(256, bool)
    t[[0x20, *range(0x09, 0x0E)]] = True
    return t


@cache
def byte_values(fold: bool = True) -> np.ndarray:
    """A random 64-bit value for each byte; with fold, A-Z share the values of a-z."""
    v = np.random.default_rng(20240501).integers(0, 1 << 63, 256, dtype=np.int64).astype(U64) * U64(2) + U64(1)
    if fold:
        v[65:91] = v[97:123]
    return v


_powers: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse, modulo 2**64."""
    if len(_powers.get("up", ())) < n:
        size = max(n, CHUNK_BYTES + 1)
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            steps = np.full(size, base, U64)
            steps[0] = 1
            _powers[name] = np.multiply.accumulate(steps)
    return _powers["up"][:n], _powers["down"][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def text_chunks(texts: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, one past the last, bytes, row offsets into them) of runs of rows of about limit bytes; null is empty."""
    texts = texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts
    if texts.null_count:
        texts = texts.fill_null("")
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    _, offsets, data = texts.buffers()
    n = len(texts)
    if not n:
        return
    offs = np.frombuffer(offsets, kind)[texts.offset : texts.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    row = 0
    while row < n:
        end = max(row + 1, int(np.searchsorted(offs, offs[row] + limit, "right")) - 1)
        yield row, end, raw[offs[row] : offs[end]], offs[row : end + 1] - offs[row]
        row = end


def word_spans(data: np.ndarray, offs: np.ndarray, sep: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start byte, end byte, row) of each maximal run of non-separators; a row's end always ends a word."""
    inside = ~sep[data]
    filled = offs[1:] > offs[:-1]
    before = np.empty_like(inside)
    before[1:] = inside[:-1]
    before[offs[:-1][filled]] = False
    after = np.empty_like(inside)
    after[:-1] = inside[1:]
    after[offs[1:][filled] - 1] = False
    starts = np.flatnonzero(inside & ~before)
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(offs, starts, "right") - 1


def raw_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, fold: bool = True) -> np.ndarray:
    """The sum of each byte's value times the base to the power of its place in the run, modulo 2**64."""
    n = len(data)
    up, down = powers(n + 1)
    total = np.zeros(n + 1, U64)
    np.cumsum(byte_values(fold)[data] * up[:n], out=total[1:])
    return (total[ends] - total[starts]) * down[starts]


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, fold: bool = True) -> np.ndarray:
    """64-bit hashes of the byte runs; with fold, A-Z are taken as a-z."""
    return mix(raw_hashes(data, starts, ends, fold) + (ends - starts).astype(U64))


def long_words(data: np.ndarray, sep: np.ndarray, fold: bool, limit: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, hashes) of the words of one long text, in blocks of limit bytes; a word may cross blocks."""
    starts, ends, raws = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, U64)]
    held: tuple[int, int] | None = None  # start and sum of a word that touches the end of the block before
    for lo in range(0, len(data), limit):
        block = data[lo : lo + limit]
        s, e, _ = word_spans(block, np.array([0, len(block)]), sep)
        raw = raw_hashes(block, s, e, fold)
        s, e = s + lo, e + lo
        if held is not None:
            if len(s) and s[0] == lo:
                raw[0] = U64((held[1] + int(raw[0]) * pow(_BASE, lo - held[0], 1 << 64)) % (1 << 64))
                s[0] = held[0]
            else:
                s, e, raw = np.append(held[0], s), np.append(lo, e), np.append(U64(held[1]), raw)
        held = None
        if len(e) and e[-1] == lo + len(block) < len(data):
            held, s, e, raw = (int(s[-1]), int(raw[-1])), s[:-1], e[:-1], raw[:-1]
        starts.append(s)
        ends.append(e)
        raws.append(raw)
    starts, ends = np.concatenate(starts), np.concatenate(ends)
    return starts, ends, mix(np.concatenate(raws) + (ends - starts).astype(U64))


def chunk_words(texts: pa.Array, fold: bool = True, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, starts, ends, rows, hashes) of the words of runs of rows; words are as in space_table().

    Work arrays are those of limit bytes of text at a time, however long a text is.
    """
    for lo, hi, data, offs in text_chunks(texts, limit):
        if len(data) > 2 * limit:  # one row
            starts, ends, hashes = long_words(data, space_table(), fold, limit)
            yield lo, hi, data, starts, ends, np.zeros(len(starts), np.int64), hashes
        else:
            starts, ends, rows = word_spans(data, offs, space_table())
            yield lo, hi, data, starts, ends, rows, word_hashes(data, starts, ends, fold)


def runs(rows: np.ndarray, n_rows: int) -> np.ndarray:
    """Offsets (n_rows + 1) of each row's words in the word arrays."""
    return np.searchsorted(rows, np.arange(n_rows + 1))


def gram_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of words[i : i + k] for every i; the caller drops those that cross rows."""
    if len(words) < k:
        return np.zeros(0, U64)
    out = np.full(len(words) - k + 1, U64(k))
    for j in range(k):
        out = mix(out * U64(0xD6E8FEB86659FD93) + words[j : len(words) - k + 1 + j])
    return out


def shingles(words: np.ndarray, bounds: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, row) of each row's k-word shingles; a row of fewer words, but not none, has its whole sequence as one."""
    n = np.diff(bounds)
    grams = gram_hashes(words, k)
    row = np.repeat(np.arange(len(n)), np.maximum(n - k + 1, 0))
    at = bounds[:-1][row] + (np.arange(len(row)) - np.repeat(np.cumsum(np.maximum(n - k + 1, 0)) - np.maximum(n - k + 1, 0), np.maximum(n - k + 1, 0)))
    got = grams[at] if len(row) else np.zeros(0, U64)
    short = np.flatnonzero((n > 0) & (n < k))
    if len(short):
        whole = np.array([gram_hashes(words[bounds[r] : bounds[r + 1]], int(n[r]))[0] for r in short], U64)
        got, row = np.concatenate([got, whole]), np.concatenate([row, short])
        order = np.argsort(row, kind="stable")
        got, row = got[order], row[order]
    return got, row
