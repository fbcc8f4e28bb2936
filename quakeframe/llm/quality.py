"""Document quality by random Fourier features and ridge regression (operator 5).

Statistics of each whole text are scaled by their mean and deviation over all documents and mapped to cosines of random
directions, which approximate a Gaussian kernel. Each partition sums its share of the normal equations over the labelled
rows; the sums, whose size is fixed, are added up by Spark and solved once. Isotonic regression on labelled rows that
the fit hasn't seen turns raw scores into probabilities.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quakeframe.llm.common import cut, text_chunks
from quakeframe.llm.statistics import FEATURES, features

COSINES = 96
WIDTH = 3.0  # of the Gaussian kernel, in deviations of one statistic
RIDGE = 1e-3  # times the number of rows
STEPS = 400  # raw scores are put in steps of 1 / STEPS for the isotonic fit
_rng = np.random.Generator(np.random.PCG64(11))
_DIRECTIONS = _rng.standard_normal((len(FEATURES), COSINES)) / WIDTH
_PHASES = _rng.uniform(0, 2 * np.pi, COSINES)


def _measure(batches):
    schema = pa.schema([("doc_id", pa.int64()), ("x", pa.list_(pa.float64()))])
    for batch in batches:
        for lo, hi, raw, off in text_chunks(batch.column("text")):
            x = features(raw, off)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id")[lo:hi], pa.ListArray.from_arrays(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32), pa.array(x.reshape(-1)))], schema=schema)


def fourier(x: np.ndarray, mean: np.ndarray, deviation: np.ndarray) -> np.ndarray:
    """The features of scaled statistics, after a constant one; extremes are held at five deviations."""
    z = np.clip((x - mean) / deviation, -5, 5)
    return np.concatenate([np.ones((len(x), 1)), np.sqrt(2 / COSINES) * np.cos(z @ _DIRECTIONS + _PHASES)], axis=1)


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), len(FEATURES))


def pool(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Isotonic fit: the non-decreasing values nearest to y by weighted squares, for x in order."""
    blocks: list[list[float]] = []
    for v, w in zip(y, weight):
        blocks.append([v, w, 1])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            v2, w2, n2 = blocks.pop()
            v1, w1, n1 = blocks[-1]
            blocks[-1] = [(v1 * w1 + v2 * w2) / (w1 + w2), w1 + w2, n1 + n2]
    return np.concatenate([np.full(int(n), v) for v, _, n in blocks]) if blocks else np.zeros(0)


def single_labels(labels: DataFrame, name: str) -> DataFrame:
    """(doc_id, y): one label for each id, the largest where several are given; null labels and ids are left out."""
    known = labels.filter(F.col(name).isNotNull() & F.col("doc_id").isNotNull())
    return known.groupBy("doc_id").agg(F.max(F.col(name).cast("int")).alias("y"))


def remainder(modulus: int):
    return F.crc32(F.col("doc_id").cast("string")) % modulus


def score_quality(docs: DataFrame, labels: DataFrame, label: str = "quality", threshold: float = 0.7) -> DataFrame:
    """Scores every whole text by what the labels mark: one row per input row.

    Labels are learnt only from ids whose crc32 leaves a remainder other than 2 by 4: 0 and 3 for the fit, 1 for the
    calibration. Returns doc_id, held_out (that remainder is 2; false for null ids), score (0 to 1), predicted.
    Null and empty texts have statistics of zero and get a score like any other. Rows are scored by themselves, so
    repeated rows score alike; repeated labels count once, the largest. Very long texts are measured whole. Columns other
    than doc_id, text and the label don't matter. An empty table gives an empty result; without usable labels every score is 0.5.
    """
    measured = cut(docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_measure, "doc_id long, x array<double>"))
    each = range(len(FEATURES))
    sums = measured.agg(*(F.avg(F.col("x")[i]).alias(f"m{i}") for i in each), *(F.stddev_pop(F.col("x")[i]).alias(f"d{i}") for i in each)).first()
    mean = np.array([sums[f"m{i}"] or 0.0 for i in each])
    deviation = np.array([sums[f"d{i}"] or 0.0 for i in each])
    deviation[deviation < 1e-9] = 1.0

    marked = measured.filter(remainder(4) != 2).join(single_labels(labels, label), "doc_id").select("x", "y", remainder(4).alias("part"))
    size = COSINES + 1

    def normal(batches):
        total = np.zeros((size, size + 1))
        for batch in batches:
            if batch.num_rows:
                z, y = fourier(_matrix(batch.column("x")), mean, deviation), batch.column("y").to_numpy().astype(float)
                total += z.T @ np.concatenate([z, y[:, None]], axis=1)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"at": at, "value": total.reshape(-1)[at]}, pa.schema([("at", pa.int64()), ("value", pa.float64())]))

    fit = marked.filter("part <> 1").select("x", "y").mapInArrow(normal, "at long, value double")
    equations = np.zeros(size * (size + 1))
    for row in fit.groupBy("at").agg(F.sum("value").alias("value")).collect():  # COSINES squared rows
        equations[row["at"]] = row["value"]
    equations = equations.reshape(size, size + 1)
    n = equations[0, 0]
    weights = np.linalg.solve(equations[:, :-1] + RIDGE * max(n, 1) * np.diag([1e-6] + [1.0] * COSINES), equations[:, -1]) if n else np.zeros(size)

    def raw_scores(batches):
        for batch in batches:
            raw = fourier(_matrix(batch.column("x")), mean, deviation) @ weights if batch.num_rows else np.zeros(0)
            kept = [c for c in batch.schema.names if c != "x"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(raw, pa.float64())], names=[*kept, "raw"])

    steps = marked.filter("part = 1").select("x", "y").mapInArrow(raw_scores, "y int, raw double")
    step = F.greatest(F.least(F.floor(F.col("raw") * STEPS), F.lit(2 * STEPS)), F.lit(-STEPS))
    steps = steps.groupBy(step.alias("step")).agg(F.count("*").alias("n"), F.avg("y").alias("y")).orderBy("step").collect()  # 3 * STEPS rows at most
    at = (np.array([r["step"] for r in steps], float) + 0.5) / STEPS
    fitted = pool(at, np.array([r["y"] for r in steps]), np.array([r["n"] for r in steps], float)) if steps else np.full(1, 0.5)
    at = at if steps else np.zeros(1)

    def probability(batches):
        for batch in raw_scores(batches):
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.interp(batch.column("raw").to_numpy(), at, fitted))], names=["doc_id", "score"])

    scored = measured.mapInArrow(probability, "doc_id long, score double")
    held_out = F.coalesce(remainder(4) == 2, F.lit(False))
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
