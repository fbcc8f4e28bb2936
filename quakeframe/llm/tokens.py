"""Vectorised word and shingle hashing over UTF-8 buffers.

Words are runs of bytes outside a set of ASCII separators, so code points never straddle a boundary and whole
texts are handled without building Python strings.
"""

from __future__ import annotations

import numpy as np

_SEED = np.random.Generator(np.random.PCG64(20240229))
BYTE = _SEED.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_STEP = np.uint64(0x9E3779B97F4A7C15)
_POWERS = np.ones(1, np.uint64)

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: Separators `[\x20\x09-\x0D]`.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Letters, digits and everything that isn't ASCII.
ALNUM = np.zeros(256, bool)
ALNUM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over the 64 output bits."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _powers(n: int) -> np.ndarray:
    global _POWERS
    if len(_POWERS) < n:
        _POWERS = np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(2 * n, _STEP, np.uint64))])
    return _POWERS


def spans(raw: np.ndarray, off: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of `inside` bytes that don't cross rows: starts, ends, and each row's offset into them."""
    if not len(raw):
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(off), np.int64)
    before = np.empty_like(inside)
    before[0], before[1:] = False, inside[:-1]
    before[off[:-1][off[:-1] < len(raw)]] = False
    after = np.empty_like(inside)
    after[-1], after[:-1] = False, inside[1:]
    ends = off[1:][off[1:] > 0] - 1
    after[ends] = False
    starts = np.flatnonzero(inside & ~before)
    return starts, np.flatnonzero(inside & ~after) + 1, np.searchsorted(starts, off)


def run_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each (non-empty, disjoint, ordered) run of bytes."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    lens = ends - starts
    first = np.cumsum(lens) - lens
    total = int(lens.sum())
    at = np.arange(total) - np.repeat(first, lens)
    codes = BYTE[raw[np.repeat(starts, lens) + at]]
    codes *= _powers(int(lens.max()) + 1)[at]
    return mix(np.add.reduceat(codes, first) + lens.astype(np.uint64))


def words(raw: np.ndarray, off: np.ndarray, separators: np.ndarray = SPACE, lower: bool = True):
    """Word hashes of all rows, with each row's offset into them, and the words' byte starts and ends."""
    low = LOWER[raw] if lower else raw
    starts, ends, at = spans(low, off, ~separators[low])
    return run_hashes(low, starts, ends), at, starts, ends


def windows(hashes: np.ndarray, at: np.ndarray, size: int, whole_if_short: bool = True):
    """Hashes of each row's windows of `size` consecutive words, and the rows' offsets into them.

    A row of fewer words, but not none, has its whole sequence as its only window, unless that is switched off.
    """
    counts = np.diff(at)
    n = len(hashes)
    multiplier = mix(np.arange(1, size + 1, dtype=np.uint64) * _STEP) | np.uint64(1)
    end = np.repeat(at[1:], counts)
    total = np.zeros(n, np.uint64)
    for j in range(size):
        part = hashes[j:] * multiplier[j]
        part[np.arange(j, n) >= end[: n - j]] = 0
        total[: n - j] += part
    place = np.arange(n)
    ok = place + size <= end
    if whole_if_short:
        short = np.repeat(counts < size, counts)
        ok |= short & (place == np.repeat(at[:-1], counts))
        total[short] += np.repeat(counts, counts)[short].astype(np.uint64) * _STEP
    got = np.concatenate([[0], np.cumsum(ok)])
    return mix(total[ok]), got[at]


def rows_of(at: np.ndarray) -> np.ndarray:
    return np.repeat(np.arange(len(at) - 1), np.diff(at))


def distinct(values: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values of each row, and the rows' offsets into them."""
    row = rows_of(at)
    order = np.lexsort((values, row))
    v, r = values[order], row[order]
    new = np.ones(len(v), bool)
    new[1:] = (v[1:] != v[:-1]) | (r[1:] != r[:-1])
    got = np.concatenate([[0], np.cumsum(np.bincount(r[new], minlength=len(at) - 1))]) if len(v) else np.zeros(len(at), np.int64)
    return v[new], got.astype(np.int64)


def row_reduce(ufunc, values: np.ndarray, at: np.ndarray, empty):
    """`ufunc.reduceat` by rows, with `empty` for rows without values."""
    out = np.full(len(at) - 1, empty, values.dtype)
    full = np.flatnonzero(np.diff(at) > 0)
    if len(full):
        out[full] = ufunc.reduceat(values, at[:-1][full])
    return out
