"""Hashes of words and windows over whole texts, in NumPy.

A run of symbols is hashed as a polynomial modulo 2**64 with an odd base: from prefix sums, the hash
of any window is one subtraction and one multiplication by a power of the base's inverse.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
#: Symbols that are hashed in one piece.
PIECE = 1 << 18


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijective scrambling of 64-bit words."""
    x = x + np.uint64((seed * 0xD1342543DE82EF95 + 0x9E3779B97F4A7C15) % (1 << 64))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.ones(n, np.uint64)
    if n > 1:
        out[1:] = np.uint64(base)
        np.multiply.accumulate(out, out=out)
    return out


_POWERS, _INVERSES = _powers(BASE, PIECE), _powers(INVERSE, PIECE)
_OF_BYTE = mix(np.arange(256, dtype=np.uint64), 17)
_BLANK = np.zeros(256, bool)
_BLANK[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def window_hashes(symbols: np.ndarray, length: int, seed: int = 0) -> np.ndarray:
    """The hash of every window of ``length`` 64-bit symbols, by its start."""
    n = len(symbols) - length + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.empty(n, np.uint64)
    step = PIECE - length
    for at in range(0, n, step):
        part = symbols[at : at + step + length - 1]
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(part * _POWERS[: len(part)], out=sums[1:])
        m = len(part) - length + 1
        out[at : at + m] = (sums[length:] - sums[:m]) * _INVERSES[:m]
    return mix(out, seed)


def bytes_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a column of strings, one after the other, and where each starts; the last entry is the end. Null is empty."""
    texts = texts.fill_null("") if texts.null_count else texts
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    _, offsets, data = texts.buffers()
    if not len(texts) or data is None:
        return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    at = np.frombuffer(offsets, kind, len(texts) + 1, texts.offset * np.dtype(kind).itemsize).astype(np.int64)
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]


def in_slices(batches: Iterator[pa.RecordBatch], most: int = 1 << 22) -> Iterator[pa.RecordBatch]:
    """Batches cut so that the texts of each are about ``most`` bytes, or one text."""
    for b in batches:
        _, starts = bytes_of(b.column("text"))
        at = 0
        while at < b.num_rows:
            end = max(at + 1, int(np.searchsorted(starts, starts[at] + most, "right")) - 1)
            yield b.slice(at, end - at)
            at = end


def word_bounds(raw: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words in texts that follow one another."""
    inside = ~_BLANK[raw]
    begins, ends = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    ends[:-1] &= ~inside[1:]
    border = starts[(starts > 0) & (starts < len(raw))]
    begins[border] = inside[border]
    ends[border - 1] = inside[border - 1]
    return np.flatnonzero(begins), np.flatnonzero(ends) + 1


def word_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word."""
    out = np.empty(len(starts), np.uint64)
    k = 0
    while k < len(starts):
        first = int(starts[k])
        # as many words as fit into a piece; a longer word is hashed by its pieces
        j = int(np.searchsorted(ends, first + PIECE - 1, "right"))
        if j <= k:
            word, h = raw[first : int(ends[k])], np.zeros(1, np.uint64)
            for at in range(0, len(word), PIECE):
                part = word[at : at + PIECE]
                h = mix(h + np.sum(_OF_BYTE[part] * _POWERS[: len(part)], dtype=np.uint64), 3)
            out[k] = h[0]
            k += 1
            continue
        part = raw[first : int(ends[j - 1])]
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(_OF_BYTE[part] * _POWERS[: len(part)], out=sums[1:])
        s, e = starts[k:j] - first, ends[k:j] - first
        out[k:j] = (sums[e] - sums[s]) * _INVERSES[s]
        k = j
    return mix(out, 1)


def words_in(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of a column of texts and where each text starts in them; starts, ends and hashes of the words; and each text's first word."""
    raw, starts = bytes_of(texts)
    begins, ends = word_bounds(raw, starts)
    return raw, starts, begins, ends, word_hashes(raw, begins, ends), np.searchsorted(begins, starts)


def words_of(text: str | None) -> np.ndarray:
    """Hashes of a text's words."""
    return words_in(pa.array([text], pa.string()))[4]


def shingles(words: np.ndarray, size: int = 5) -> np.ndarray:
    """Hashes of the word shingles of a text; one of fewer words is one shingle, none has none."""
    return window_hashes(words, min(size, len(words))) if len(words) else np.zeros(0, np.uint64)
