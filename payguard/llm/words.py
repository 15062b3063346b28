"""Words, word hashes and word n-grams of whole batches of texts, in numpy.

A word is a run of bytes other than 0x20 and 0x09-0x0D. All functions work on
the concatenated UTF-8 bytes of a batch and the row offsets into them.
"""

from __future__ import annotations

import numpy as np

_U = np.uint64
_SEGMENT = 1 << 16
#: Odd multipliers of the polynomial hashes, and the 64-bit inverse of the first.
_P = 0x9E3779B97F4A7C15
_P_INV = pow(_P, -1, 1 << 64)
_Q = 0xD1B54A32D192ED03
_SPACE = np.zeros(256, np.bool_)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit mixer (the finaliser of SplitMix64)."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_TABLE = mix(np.arange(1, 257, dtype=_U) * _U(0x632BE59BD9B4E019))
_TABLE_LOWER = _TABLE[_LOWER]


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, _U)
    out[0] = 1
    return np.cumprod(out)


_POW, _INV = _powers(_P, _SEGMENT + 1), _powers(_P_INV, _SEGMENT + 1)


def split(buffer: np.ndarray, offsets: np.ndarray, gaps: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of all words, and the n+1 offsets of the rows' words. gaps: for each byte value, whether it ends a word."""
    if len(buffer) == 0:
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(offsets), np.int64)
    solid = ~gaps[buffer]
    first, last = solid.copy(), solid.copy()
    first[1:] &= ~solid[:-1]
    last[:-1] &= ~solid[1:]
    cuts = offsets[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < len(buffer))]
    first[cuts] = solid[cuts]
    last[cuts - 1] = solid[cuts - 1]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, offsets)


def hashes(buffer: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = False) -> np.ndarray:
    """A 64-bit hash of each word; with `lower`, A-Z count as a-z."""
    table = _TABLE_LOWER if lower else _TABLE
    out = np.empty(len(starts), _U)
    i = 0
    while i < len(starts):
        lo = starts[i]
        j = max(i + 1, int(np.searchsorted(ends, lo + _SEGMENT, side="right")))
        hi = ends[j - 1]
        n = int(hi - lo)
        power, inverse = (_POW, _INV) if n <= _SEGMENT else (_powers(_P, n + 1), _powers(_P_INV, n + 1))
        sums = np.zeros(n + 1, _U)
        np.cumsum(table[buffer[lo:hi]] * power[:n], out=sums[1:])
        out[i:j] = (sums[ends[i:j] - lo] - sums[starts[i:j] - lo]) * inverse[starts[i:j] - lo]
        i = j
    return mix(out)


def rolling(word_hashes: np.ndarray, n: int) -> np.ndarray:
    """A 64-bit hash of the n words from each position on; positions of the last n-1 words are left out."""
    if len(word_hashes) < n:
        return np.zeros(0, _U)
    total, width, have, q = None, 1, word_hashes, _Q
    done = 0
    rest = n
    while rest:
        if rest & 1:
            piece = have[done : len(have)]
            if total is None:
                total = piece.copy()
            else:
                size = min(len(total), len(piece))
                total = total[:size] + piece[:size] * _U(pow(_Q, done, 1 << 64))
            done += width
        rest >>= 1
        if rest:
            have = have[:-width] + have[width:] * _U(q)
            width, q = 2 * width, q * q % (1 << 64)
    return mix(total[: len(word_hashes) - n + 1])


def valid(rows: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the n-word windows that stay within one row, and their row numbers. rows: word offsets."""
    counts = np.maximum(np.diff(rows) - (n - 1), 0)
    total = int(counts.sum())
    row = np.repeat(np.arange(len(counts)), counts)
    at = np.arange(total) - np.repeat(np.cumsum(counts) - counts, counts) + rows[:-1][row] if total else np.zeros(0, np.int64)
    return at, row


def shingles(buffer: np.ndarray, offsets: np.ndarray, n: int = 5, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-word shingles of each row: row numbers and 64-bit hashes, sorted by both.

    A row of 1 to n-1 words has one shingle, its whole sequence; one without words has none.
    """
    starts, ends, rows = split(buffer, offsets)
    words = hashes(buffer, starts, ends, lower)
    at, row = valid(rows, n)
    got = rolling(words, n)[at] if len(at) else np.zeros(0, _U)
    counts = np.diff(rows)
    extra_rows, extra = [], []
    for r in np.flatnonzero((counts > 0) & (counts < n)):
        extra_rows.append(r)
        extra.append(rolling(words[rows[r] : rows[r + 1]], int(counts[r]))[0] ^ _U(counts[r]))
    if extra:
        row, got = np.concatenate([row, np.array(extra_rows)]), np.concatenate([got, mix(np.array(extra, _U))])
        order = np.argsort(row, kind="stable")
        row, got = row[order], got[order]
    bounds = np.searchsorted(row, np.arange(len(counts) + 1))
    for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        got[lo:hi].sort()
    if len(got):
        keep = np.ones(len(got), np.bool_)
        keep[1:] = (row[1:] != row[:-1]) | (got[1:] != got[:-1])
        row, got = row[keep], got[keep]
    return row, got


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of the `width` values from each position on."""
    have, span = values, 1
    while 2 * span <= width:
        have, span = np.minimum(have[:-span], have[span:]), 2 * span
    return np.minimum(have[: len(values) - width + 1], have[width - span :][: len(values) - width + 1])
