"""Windows, stacking, padding and trend removal on sample arrays: array functions, but for stacking windows that were rows."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quakeframe.functions import arrays as A


def window_starts(n: Column, window: int, step: int) -> Column:
    """0, step, … and, where the tail isn't covered, the last possible start; [0] for traces of a window or less."""
    regular = F.sequence(F.lit(0), F.greatest(n - window, F.lit(0)), F.lit(step))
    last = F.greatest(n - window, F.lit(0))
    return A.let(regular, lambda r: F.when(F.element_at(r, -1) < last, F.array_append(r, last)).otherwise(r))


def window_slices(traces: DataFrame, window: int, step: int) -> DataFrame:
    """One row per window (trace_name, start, x); a short trace is padded with 0."""
    out = traces.select("trace_name", "samples", F.explode(window_starts(F.size("samples"), window, step)).alias("start"))
    return out.select("trace_name", "start", A.pad_or_cut(F.slice("samples", F.col("start") + 1, window), window).alias("x"))


def standardize(x: Column, floor: float = 1e-10) -> Column:
    """Demeaned and divided by the population deviation; a deviation below `floor` counts as 1."""
    return A.let(x, lambda a: A.let(F.struct(A.mean(a).alias("m"), A.std_pop(a).alias("d")), lambda s: F.transform(a, lambda v: (v - s["m"]) / F.when(s["d"] < floor, 1.0).otherwise(s["d"]))))


def standardize_stream(x: Column, n: int) -> Column:
    """Length fixed to n, demeaned and divided by the deviation of finite samples (0 counts as 1); others become 0."""
    finite = lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))

    def run(a: Column) -> Column:
        good = F.filter(a, finite)
        return A.let(F.struct(A.mean(good).alias("m"), A.std_pop(good).alias("d")), lambda s: F.transform(a, lambda v: F.when(finite(v), (v - s["m"]) / F.when(F.coalesce(s["d"], F.lit(0.0)) == 0, 1.0).otherwise(s["d"])).otherwise(0.0)))

    return A.let(A.pad_or_cut(x, n), run)


def position_weights(window: int, kind: str = "gaussian") -> Column:
    """Weights of a window's positions, divided by their mean: gaussian (sigma window / 6), triangular (floor 0.1), cosine, uniform."""
    i = F.sequence(F.lit(0), F.lit(window - 1))
    mid = (window - 1) / 2
    shapes = {
        "gaussian": lambda k: F.exp(-((k - mid) * (k - mid)) / (2 * (window / 6) ** 2)),
        "triangular": lambda k: F.greatest(F.lit(0.1), 1 - F.abs(k - mid) / (window / 2)),
        "cosine": lambda k: 0.5 * (1 - F.cos(2 * math.pi * k / max(window - 1, 1))),
        "uniform": lambda k: F.lit(1.0),
    }
    raw = F.transform(i, lambda k: shapes[kind](k.cast("double")))
    return A.let(raw, lambda w: A.let(A.mean(w), lambda m: F.when(m == 0, w).otherwise(F.transform(w, lambda v: v / m))))


def _stack(windows: list[tuple[int, np.ndarray]], weights: np.ndarray | None, how: str) -> np.ndarray:
    """Windows (start, values) of one trace to the values of the samples that any covers, in order."""
    first, end = min(a for a, _ in windows), max(a + len(x) for a, x in windows)
    covered = np.zeros(end - first + 1, int)
    for a, x in windows:
        covered[a - first] += 1
        covered[a - first + len(x)] -= 1
    covered = np.cumsum(covered)[:-1]
    if how == "median":
        # Each window goes into the first layer that is free from its start on; there are as many as windows ever overlap.
        layers, free = np.full((max(covered.max(initial=0), 1), end - first), np.nan), [first] * max(covered.max(initial=0), 1)
        for a, x in sorted(windows, key=lambda w: w[0]):
            k = next(k for k, at in enumerate(free) if at <= a)
            layers[k, a - first : a - first + len(x)] = x
            free[k] = a + len(x)
        return np.nanmedian(layers[:, covered > 0], axis=0)
    total, weight = np.zeros(end - first), np.zeros(end - first)
    for a, x in windows:
        w = np.ones(len(x)) if weights is None else weights[: len(x)]
        total[a - first : a - first + len(x)] += x * w
        weight[a - first : a - first + len(x)] += w
    return (total / np.maximum(weight, 1e-8))[covered > 0]


def overlap_add(predictions: DataFrame, how: str = "mean", weights: Column | None = None, x: str = "x") -> DataFrame:
    """Windows (trace_name, start, x) back to one curve per trace: weighted mean, or median, of what covers each sample.

    Windows are shuffled whole, once, and stacked where a trace's have met; samples are never rows. Samples that no window
    covers are left out.
    """
    w = F.lit(None).cast("array<double>") if weights is None else weights
    met = predictions.groupBy("trace_name").agg(F.collect_list(F.struct("start", F.col(x).alias("x"))).alias("windows")).withColumn("w", w)  # of one trace

    def run(batches):
        for pdf in batches:
            curves = [_stack([(v["start"], np.asarray(v["x"], float)) for v in windows], None if w is None else np.asarray(w, float), how) for windows, w in zip(pdf["windows"], pdf["w"])]
            yield pd.DataFrame({"trace_name": pdf["trace_name"], "curve": curves})

    return met.mapInPandas(run, "trace_name string, curve array<double>")


def pad_samples(x: Column, n: int, mode: str = "zero") -> Column:
    """To n samples, cut where longer: filled with zeros, the last sample, or the median."""
    fill = {"zero": lambda a: F.lit(0.0), "last": lambda a: F.coalesce(F.element_at(a, -1), F.lit(0.0)), "median": lambda a: F.coalesce(A.median(a), F.lit(0.0))}[mode]
    return A.let(x, lambda a: A.pad_or_cut(a, n, F.when(F.size(a) > 0, fill(a)).otherwise(0.0)))


def align_front(x: Column, missing_s: Column, rate: float) -> Column:
    """Puts the median in front for the time that is missing since a wanted start, rounded up to samples."""
    n = F.greatest(F.ceil(missing_s * rate).cast("int"), F.lit(0))
    return A.let(x, lambda a: F.concat(F.array_repeat(F.coalesce(A.median(a), F.lit(0.0)), n), a))


def _starts(last: Column, step: int) -> Column:
    """Every step-th sample from 0 to `last`; none where that is negative."""
    return F.when(last >= 0, F.sequence(F.lit(0), last, F.lit(step))).otherwise(F.array().cast("array<int>"))


def _distinct(x: Column, start: Column, window: int, digits: int) -> Column:
    """Different values of a window, rounded."""
    return F.size(F.array_distinct(F.transform(F.slice(x, start + 1, window), lambda v: F.round(v, digits))))


def flat_regions(x: Column, window: int = 100, distinct: int = 50, digits: int = 4) -> Column:
    """Merged stretches of whole windows, at a stride of half a window, with fewer than `distinct` values when rounded.

    A trace shorter than a window has none.
    """

    def marked(a: Column) -> Column:
        some = F.filter(_starts(F.size(a) - window, max(window // 2, 1)), lambda s: _distinct(a, s, window, digits) < distinct)
        return F.transform(F.sequence(F.lit(0), F.size(a) - 1), lambda i: F.exists(some, lambda s: (i >= s) & (i < s + window)))

    return F.when(F.size(x) > 0, A.runs(A.let(x, marked))).otherwise(F.array().cast("array<struct<start:int,end:int>>"))


def lively_start(x: Column, window: int, step: int, distinct: int, most: int | None = None, digits: int = 4) -> Column:
    """Start of the first window with `distinct` different values or more when rounded, of those that begin before `most` and
    before the last whole window; NULL if there is none."""
    last = F.size(x) - window - 1
    starts = _starts(last if most is None else F.least(last, F.lit(most - 1)), step)
    return F.get(F.filter(starts, lambda s: _distinct(x, s, window, digits) >= distinct), F.lit(0))


def reference_start(x: Column, window: int = 500, step: int = 100, distinct: int = 300, most: int = 5000, digits: int = 4) -> Column:
    """Start of the first window with more than `distinct` values, of those that begin before `most`; 0 if there is none."""
    return F.coalesce(lively_start(x, window, step, distinct + 1, most, digits), F.lit(0))


def reference(x: Column, window: int = 500, step: int = 100, distinct: int = 300, most: int = 5000, digits: int = 4) -> Column:
    """The window that `reference_start` finds."""
    return F.slice(x, reference_start(x, window, step, distinct, most, digits) + 1, window)


def lively_surroundings(x: Column, window: int = 100, distinct: int = 50, digits: int = 4) -> Column:
    """The first window that isn't flat, with one on either side; else the two in the middle; a shorter trace whole."""
    start = lively_start(x, window, max(window // 2, 1), distinct, digits=digits)
    begin = F.greatest(F.coalesce(start, F.floor(F.size(x) / 2).cast("int")) - window, F.lit(0))
    end = F.coalesce(start + 2 * window, F.floor(F.size(x) / 2).cast("int") + window)
    return F.when(F.size(x) < window, x).otherwise(F.slice(x, begin + 1, F.greatest(end - begin, F.lit(0))))


def demean(x: Column) -> Column:
    return A.let(x, lambda a: A.let(A.mean(a), lambda m: F.transform(a, lambda v: v - m)))


def detrend(x: Column) -> Column:
    """Residuals of the least-squares line through the samples; an array of fewer than two is only demeaned."""

    def run(a: Column) -> Column:
        n = F.size(a).cast("double")
        mid = (n - 1) / 2
        sums = F.aggregate(F.transform(a, lambda v, i: F.struct(v.alias("v"), (i - mid).alias("t"))), F.struct(F.lit(0.0).alias("vt"), F.lit(0.0).alias("tt")), lambda s, p: F.struct((s["vt"] + p["v"] * p["t"]).alias("vt"), (s["tt"] + p["t"] * p["t"]).alias("tt")))
        return A.let(F.struct(A.mean(a).alias("m"), sums.alias("s")), lambda c: F.transform(a, lambda v, i: v - c["m"] - F.when(c["s"]["tt"] > 0, c["s"]["vt"] / F.nullif(c["s"]["tt"], F.lit(0.0)) * (i - mid)).otherwise(0.0)))

    return A.let(x, run)


def validation_error(arrays: Sequence[str], least: int) -> Column:
    """NULL for usable components; else what is wrong: missing, empty, too short, or unequal lengths (a warning)."""
    cols = [F.col(c) for c in arrays]
    missing = [c.isNull() for c in cols]
    sizes = [F.size(c) for c in cols]
    any_ = lambda flags: F.greatest(*[f.cast("int") for f in flags]) == 1 if len(flags) > 1 else flags[0]
    shortest, longest = (F.least(*sizes), F.greatest(*sizes)) if len(sizes) > 1 else (sizes[0], sizes[0])
    return F.when(any_(missing), "missing").when(shortest == 0, "empty").when(shortest < least, "short").when(shortest != longest, "unequal")
