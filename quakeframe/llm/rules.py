"""Quality rules: fixed limits on counts, then a hashed n-gram classifier (operator 8).

Words, pairs of words and trigrams of characters are hashed into a fixed number of cells each. Logistic regression on a bounded sample of labelled
rows is trained in shards, each from the same weights; the shards' weights are averaged, for a few rounds. Platt's
method calibrates it on sampled rows that no shard saw. All texts are then scored in Arrow batches, together with the
counts of the rules.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quakeframe.llm.common import cut, text_chunks
from quakeframe.llm.quality import single_labels
from quakeframe.llm.statistics import counts
from quakeframe.llm.tokens import mix, rows_of

CELLS = 1 << 15  # of words, as many of pairs, and as many of trigrams
#: Labelled rows that are sampled at most; each is trained on whole.
SAMPLE = 6000
SHARDS, ROUNDS, EPOCHS, RATE = 8, 3, 4, 0.5
MIN_WORDS, MAX_REPEATED, LEAST = 50, 50, 0.5
#: The bigram of a word and itself.
REPEATED = np.uint64(0)


def code_points(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each code point of valid UTF-8 begins, and its number."""
    begins = np.flatnonzero((raw & 0xC0) != 0x80)
    padded = np.append(raw, np.zeros(3, np.uint8)).astype(np.uint32)
    lead = padded[begins]
    value = lead.copy()
    for least, mask in ((0xC0, 0x1F), (0xE0, 0x0F), (0xF0, 0x07)):
        value = np.where(lead >= least, lead & mask, value)
    for j, least in ((1, 0xC0), (2, 0xE0), (3, 0xF0)):
        value = np.where(lead >= least, value << 6 | padded[begins + j] & 0x3F, value)
    return begins, value


def hashed(raw: np.ndarray, off: np.ndarray, hashes: np.ndarray, at: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Cells of each row's word unigrams, word bigrams and character trigrams: (cells, offsets) of each, with repeats.

    Characters are code points. One rule is made by hand: a word followed by itself is the bigram REPEATED, whatever the
    word, since hashed n-grams of unseen words can't tell that text repeats itself. Each kind has CELLS cells.
    """
    cells = lambda h, kind: (h >> np.uint64(40)).astype(np.int64) % CELLS + kind * CELLS
    row = rows_of(at)
    together = row[:-1] == row[1:]
    pairs = mix(hashes[:-1] * np.uint64(0x9E3779B97F4A7C15) + hashes[1:])
    pairs = np.where(hashes[:-1] == hashes[1:], REPEATED, pairs)[together]
    pairs_at = np.concatenate([[0], np.cumsum(together)])[np.minimum(at, len(together))]
    begins, points = code_points(raw)
    n = np.searchsorted(begins, off)
    last = max(len(points) - 2, 0)
    a, b, c = (points[i : i + last].astype(np.uint64) for i in range(3))
    trigrams = mix(a << np.uint64(42) | b << np.uint64(21) | c)
    place = rows_of(n)
    inside = place[:last] == place[2 : 2 + last]
    return [(cells(hashes, 0), at), (cells(pairs, 1), pairs_at), (cells(trigrams[inside], 2), np.concatenate([[0], np.cumsum(inside)])[np.minimum(n, last)])]


def raw_scores(weights: np.ndarray, bias: float, grams) -> np.ndarray:
    """bias plus the mean weights of a row's words, of its word pairs and of its character trigrams; none, no part."""
    total = np.full(len(grams[0][1]) - 1, bias)
    for cells, at in grams:
        sums = np.concatenate([[0.0], np.cumsum(weights[cells])])
        total += (sums[at[1:]] - sums[at[:-1]]) / np.maximum(np.diff(at), 1)
    return total


def _examples(batches):
    schema = pa.schema([("y", pa.int32()), ("part", pa.int32()), ("cells", pa.list_(pa.int64())), ("shares", pa.list_(pa.float64()))])
    for batch in batches:
        for lo, hi, raw, off in text_chunks(batch.column("text")):
            c = counts(raw, off)
            cells, shares = [[] for _ in range(hi - lo)], [[] for _ in range(hi - lo)]
            for values, at in hashed(raw, off, c["hashes"], c["at"]):
                for r in range(hi - lo):
                    if at[r + 1] > at[r]:
                        v, n = np.unique(values[at[r] : at[r + 1]], return_counts=True)
                        cells[r].append(v)
                        shares[r].append(n / n.sum())
            join = lambda x, kind: [np.concatenate(v) if v else np.zeros(0, kind) for v in x]
            yield pa.RecordBatch.from_arrays([batch.column("y")[lo:hi], batch.column("part")[lo:hi], pa.array(join(cells, np.int64), pa.list_(pa.int64())), pa.array(join(shares, np.float64), pa.list_(pa.float64()))], schema=schema)


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _trainer(weights: np.ndarray, bias: float):
    def train(pdf: pd.DataFrame) -> pd.DataFrame:
        w, b = weights.copy(), bias
        grown = np.full(len(w), 1e-3)
        rows = [(np.asarray(c), np.asarray(s), y) for c, s, y in zip(pdf["cells"], pdf["shares"], pdf["y"])]
        rows.sort(key=lambda r: (len(r[0]), r[2], r[0].tobytes()))
        rng = np.random.Generator(np.random.PCG64(5))
        for _ in range(EPOCHS):
            for i in rng.permutation(len(rows)):
                cells, shares, y = rows[i]
                miss = y - _sigmoid(b + w[cells] @ shares)
                step = miss * shares
                grown[cells] += step**2
                w[cells] += RATE * step / np.sqrt(grown[cells])
                b += 0.02 * miss
        return pd.DataFrame({"n": [len(rows)], "bias": [b], "weights": [w.astype(np.float32).tobytes()]})

    return train


def platt(raw: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the logistic curve through (raw, y), by Newton steps on smoothed targets."""
    if not len(y) or y.min() == y.max():
        return 1.0, 0.0
    target = np.where(y > 0, (y.sum() + 1) / (y.sum() + 2), 1 / (len(y) - y.sum() + 2))
    slope, offset = 1.0, 0.0
    for _ in range(50):
        p = _sigmoid(slope * raw + offset)
        d, h = p - target, np.maximum(p * (1 - p), 1e-9)
        g = np.array([d @ raw, d.sum()])
        hess = np.array([[h @ raw**2 + 1e-3, h @ raw], [h @ raw, h.sum() + 1e-3]])
        move = np.linalg.solve(hess, g)
        slope, offset = slope - move[0], offset - move[1]
        if np.abs(move).max() < 1e-8:
            break
    return float(slope), float(offset)


def quality_rules(docs: DataFrame, labels: DataFrame, label: str = "quality", sample: int = SAMPLE, least: float = LEAST) -> DataFrame:
    """Counts, rule verdict and classifier verdict of every whole text: one row per input row.

    Returns doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed (fewer than 50 words, or
    over half of them in repeated 3-word windows), kept (not base_failed, and a probability of `least` or more),
    probability. The classifier is fitted on `sample` labelled rows at most, those with the smallest hashes of doc_id.
    Null and empty texts have counts of zero and so fail. Repeated rows get equal results; repeated labels count once,
    the largest; null ids have no label. Very long texts are read whole. Columns other than doc_id, text and the label don't
    matter. An empty table gives an empty result. A fifth of the sample calibrates and the rest trains; without both values
    among the rows that train, the rules alone decide.
    """
    chosen = single_labels(labels, label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    marked = docs.select(F.col("doc_id").cast("long"), "text").join(F.broadcast(chosen), "doc_id")  # `sample` rows at most
    marked = marked.select("text", "y", F.pmod(F.xxhash64("doc_id"), F.lit(5)).cast("int").alias("part"))
    rows = cut(marked.mapInArrow(_examples, "y int, part int, cells array<long>, shares array<double>"))
    weights, bias, slope, offset = np.zeros(3 * CELLS), 0.0, 1.0, 0.0
    training = rows.filter("part > 0")
    decide = {r["y"] for r in training.select("y").distinct().collect()} == {0, 1}
    if decide:
        shards = training.withColumn("shard", F.pmod(F.xxhash64("cells"), F.lit(SHARDS)))
        for _ in range(ROUNDS):
            got = shards.groupBy("shard").applyInPandas(_trainer(weights, bias), "n long, bias double, weights binary").collect()  # SHARDS rows
            got.sort(key=lambda r: r["weights"])
            n = sum(r["n"] for r in got)
            weights = sum(np.frombuffer(r["weights"], np.float32).astype(float) * r["n"] for r in got) / n
            bias = sum(r["bias"] * r["n"] for r in got) / n
        held = rows.filter("part = 0").select("y", "cells", "shares").collect()  # a fifth of the sample
        raw = np.array([bias + weights[np.array(r["cells"], int)] @ np.array(r["shares"], float) for r in held])
        slope, offset = platt(raw, np.array([r["y"] for r in held]))
    light = weights.astype(np.float32)

    def score(batches):
        names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
        for batch in batches:
            for lo, hi, raw, off in text_chunks(batch.column("text")):
                c = counts(raw, off)
                p = _sigmoid(slope * raw_scores(light, bias, hashed(raw, off, c["hashes"], c["at"])) + offset) if decide else np.ones(hi - lo)
                failed = (c["n_words"] < MIN_WORDS) | (100 * c["n_repeat_words"] > MAX_REPEATED * c["n_words"])
                yield pa.RecordBatch.from_arrays([batch.column("doc_id")[lo:hi], *(pa.array(c[k].astype(np.int64)) for k in names), pa.array(failed), pa.array(~failed & (p >= least)), pa.array(p.astype(float))], names=["doc_id", *names, "base_failed", "kept", "probability"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(score, "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, probability double")
