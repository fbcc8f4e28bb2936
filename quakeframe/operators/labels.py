"""Training windows and label curves."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quakeframe.functions import arrays as A


def gaussian_label(n: int, sample: Column, sigma: float) -> Column:
    """exp(−(i − pick)² / 2σ²) over n samples; all 0 without a pick."""
    at = F.sequence(F.lit(0), F.lit(n - 1))
    return F.transform(at, lambda i: F.when(sample.isNull(), 0.0).otherwise(F.exp(-((i - sample) * (i - sample)) / (2 * sigma * sigma))))


def noise_label(p: Column, s: Column) -> Column:
    """1 − P − S, not below 0."""
    return F.zip_with(p, s, lambda a, b: F.greatest(F.lit(0.0), 1 - a - b))


def detection_label(n: int, p: Column, s: Column, factor: float = 1.4) -> Column:
    """1 from P to S + factor (S − P), both inclusive, else 0; all 0 unless both picks exist."""
    end = s + factor * (s - p)
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.when((i >= p) & (i <= end), 1.0).otherwise(0.0))


def pick_of_label(curve: Column, threshold: float = 0.1) -> Column:
    """Sample of the curve's maximum, the first on a tie, if it reaches the threshold, else −1."""
    return A.let(F.array_max(curve), lambda m: F.when(m >= threshold, F.array_position(curve, m).cast("int") - 1).otherwise(-1))


def crop_offset(seed: int, key: Column, epoch: Column | int, most: Column) -> Column:
    """A start in [0, most], the same for the same seed, epoch and key under any partitioning."""
    epoch = F.lit(epoch) if isinstance(epoch, int) else epoch
    return F.pmod(F.xxhash64(F.lit(seed), epoch, key), F.greatest(most, F.lit(0)) + 1).cast("int")


def label_windows(traces: DataFrame, window: int, long: int | None = None, sigma: float = 20.0, factor: float = 1.4, seed: int = 42, epoch: int = 0) -> DataFrame:
    """Training rows (trace_name, x, p, s, n, d): a crop of `window` samples at a seeded place of a `long` one around P.

    traces: trace_name, samples, p_sample, s_sample. The long window starts half of it before P (or S, without P), is
    filled with 0 outside the trace, and the crop is divided by its largest magnitude.
    """
    long = 2 * window if long is None else long
    pick = F.coalesce("p_sample", "s_sample")
    start = (pick - long // 2 + crop_offset(seed, F.col("trace_name"), epoch, F.lit(long - window))).alias("start")
    out = traces.filter(pick.isNotNull()).select("*", start)
    front = F.greatest(-F.col("start"), F.lit(0))
    inside = F.slice("samples", F.greatest(F.col("start"), F.lit(0)) + 1, F.greatest(window - front, F.lit(0)))
    raw = A.pad_or_cut(F.concat(F.array_repeat(F.lit(0.0), front), inside), window)
    x = A.let(raw, lambda a: A.let(F.array_max(F.transform(a, lambda v: F.abs(v))), lambda m: F.transform(a, lambda v: v / F.when(m > 0, m).otherwise(1.0))))
    p, s = F.col("p_sample") - F.col("start"), F.col("s_sample") - F.col("start")
    out = out.select("trace_name", "start", x.alias("x"), gaussian_label(window, p, sigma).alias("p"), gaussian_label(window, s, sigma).alias("s"), detection_label(window, p, s, factor).alias("d"))
    return out.withColumn("n", noise_label(F.col("p"), F.col("s")))


def coda_windows(traces: DataFrame, margin: int, window: int) -> DataFrame:
    """Coda after S as negatives: traces with S and room for margin + window after it, sliced [S + margin, + window)."""
    fits = (F.col("s_sample") >= 0) & (F.size("samples") - F.col("s_sample") >= margin + window)
    return traces.filter(fits).select("trace_name", F.slice("samples", F.col("s_sample") + margin + 1, window).alias("x"))
