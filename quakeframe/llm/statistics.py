"""Statistics of whole texts, vectorised over UTF-8 buffers."""

from __future__ import annotations

import numpy as np

from quakeframe.llm.tokens import SPACE, distinct, mix, rows_of, run_hashes, spans, words

SYMBOL = np.zeros(256, bool)
SYMBOL[list(b"#*$%&|<>")] = True
UPPER, DIGIT, PUNCTUATION = (np.zeros(256, bool) for _ in range(3))
UPPER[65:91] = True
DIGIT[48:58] = True
PUNCTUATION[list(b".,;:!?'\"()-")] = True
#: Names of what `features` returns, in order.
FEATURES = ("log_words", "log_chars", "word_length", "spread", "symbols", "upper", "digits", "punctuation", "non_ascii", "duplicate_lines", "line_words", "distinct_words", "repeated_words", "bars", "shouts", "short_words", "long_words", "first_upper")


def row_sums(flags: np.ndarray, off: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    return total[off[1:]] - total[off[:-1]]


def repeated_words(hashes: np.ndarray, at: np.ndarray, size: int = 3) -> np.ndarray:
    """Per row: words inside windows of `size` words that occur twice or more in it, first occurrences included."""
    n = len(hashes)
    if n < size:
        return np.zeros(len(at) - 1, np.int64)
    row = rows_of(at)
    last = n - size + 1
    window = hashes[:last].copy()
    for j in range(1, size):
        window = mix(window * np.uint64(0x9E3779B97F4A7C15) + hashes[j : j + last])
    place = np.flatnonzero(row[:last] == row[size - 1 :])
    window, r = window[place], row[place]
    order = np.lexsort((window, r))
    w, r = window[order], r[order]
    same = (w[1:] == w[:-1]) & (r[1:] == r[:-1])
    often = np.zeros(len(w), bool)
    often[1:] |= same
    often[:-1] |= same
    start = np.zeros(n + 1, np.int64)
    begun = place[order[often]]
    np.add.at(start, begun, 1)
    np.add.at(start, begun + size, -1)
    return row_sums(np.cumsum(start)[:n] > 0, at)


def duplicate_lines(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per row: lines with a word, and how many of them equal an earlier line."""
    starts, ends, at = spans(raw, off, raw != 10)
    solid = np.concatenate([[0], np.cumsum(~SPACE[raw])])
    wordy = solid[ends] > solid[starts] if len(starts) else np.zeros(0, bool)
    hashes = run_hashes(raw, starts, ends)
    kept = np.concatenate([[0], np.cumsum(wordy)])[at]
    _, unique = distinct(hashes[wordy], kept)
    return np.diff(kept), np.diff(kept) - np.diff(unique)


def counts(raw: np.ndarray, off: np.ndarray) -> dict[str, np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of each row, and what they were made from."""
    hashes, at, starts, ends = words(raw, off, lower=False)
    lines, dup = duplicate_lines(raw, off)
    chars = row_sums(~SPACE[raw] & ((raw & 0xC0) != 0x80), off)
    return {"n_words": np.diff(at), "word_chars": chars, "n_symbols": row_sums(SYMBOL[raw], off), "n_dup_lines": dup, "n_repeat_words": repeated_words(hashes, at), "lines": lines, "hashes": hashes, "at": at, "starts": starts, "ends": ends}


def features(raw: np.ndarray, off: np.ndarray) -> np.ndarray:
    """One row of FEATURES per text; all zero for a text without words."""
    c = counts(raw, off)
    n = np.maximum(c["n_words"], 1).astype(float)
    size = np.maximum(np.diff(off), 1).astype(float)
    length = (c["ends"] - c["starts"]).astype(float)
    mean = row_sums_f(length, c["at"]) / n
    square = row_sums_f(length**2, c["at"]) / n
    _, unique = distinct(c["hashes"], c["at"])
    first = raw[c["starts"]] if len(raw) else np.zeros(0, np.uint8)
    last = raw[c["ends"] - 1] if len(raw) else np.zeros(0, np.uint8)
    per_word = lambda flags: row_sums(flags, c["at"]) / n
    out = np.stack([
        np.log1p(c["n_words"]), np.log1p(c["word_chars"]), mean, np.sqrt(np.maximum(square - mean**2, 0)), c["n_symbols"] / size, row_sums(UPPER[raw], off) / size, row_sums(DIGIT[raw], off) / size, row_sums(PUNCTUATION[raw], off) / size, row_sums(raw >= 0x80, off) / size,
        c["n_dup_lines"] / np.maximum(c["lines"], 1), np.log1p(n / np.maximum(c["lines"], 1)), np.diff(unique) / n, c["n_repeat_words"] / n, per_word((first == 124) & (length == 1)), per_word(last == 33), per_word(length < 4), per_word(length > 12), per_word(UPPER[first]),
    ], axis=1)
    return np.where(c["n_words"][:, None] > 0, out, 0.0)


def row_sums_f(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0.0], np.cumsum(values)])
    return total[at[1:]] - total[at[:-1]]
