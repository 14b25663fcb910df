"""Hashes of the words of whole Arrow columns, without a Python step for any word."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_rng = np.random.default_rng(20240311)
#: A random number for each byte value; a word's hash is the polynomial of its bytes' numbers in FACTOR, mixed.
BYTES = _rng.integers(0, 2**64, 256, dtype=np.uint64)
FACTOR = np.uint64(0xD1342543DE82EF95)
INVERSE = np.uint64(pow(int(FACTOR), -1, 2**64))
#: Bytes that are hashed at once; a longer word is taken whole.
PIECE = 1 << 21


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def hashed(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """63-bit hashes of the byte runs raw[start:end], which follow each other."""
    out = np.empty(len(starts), np.uint64)
    lo = 0
    while lo < len(starts):
        base = starts[lo]
        hi = max(lo + 1, int(np.searchsorted(ends, base + PIECE, "right")))
        part = raw[base : ends[hi - 1]]
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(BYTES[part] * _powers(FACTOR, len(part)), out=sums[1:])
        a, b = starts[lo:hi] - base, ends[lo:hi] - base
        out[lo:hi] = mixed((sums[b] - sums[a]) * _powers(INVERSE, int(a[-1]) + 1)[a] + (b - a).astype(np.uint64)) >> np.uint64(1)
        lo = hi
    return out


def word_runs(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, starts, ends, number of words of each text): the words of all texts in order, as runs of the bytes.

    A-Z are lowered; words are parted by the six ASCII white-space characters. Null is a text without words.
    """
    parts = [x or b"" for x in texts.cast(pa.large_binary()).to_pylist()]
    at = np.cumsum([0, *map(len, parts)])
    raw = np.frombuffer(b"".join(parts).lower(), np.uint8)
    word = ~((raw == 32) | ((raw >= 9) & (raw <= 13)))
    cut = np.zeros(len(raw) + 1, bool)  # where a text starts or all of them end
    cut[at] = True
    starts = np.flatnonzero(word & (cut[:-1] | np.r_[True, ~word[:-1]]))
    ends = np.flatnonzero(word & (cut[1:] | np.r_[~word[1:], True])) + 1
    return raw, starts, ends, np.diff(np.searchsorted(starts, at))


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of the words of all texts in order, number of words of each text)."""
    raw, starts, ends, lengths = word_runs(texts)
    return hashed(raw, starts, ends), lengths


#: What stands at the end of a text, and before its first word: no word holds a blank.
END, START = (int(hashed(np.frombuffer(x, np.uint8), np.array([0]), np.array([len(x)]))[0]) for x in (b" ", b"  "))
