"""Waveform quality checks on sample arrays (columns trace_name, samples): one row in, one row out, no shuffle.

`explode_samples` and `islands` give the same answers on the long view (trace_name, i, v), for callers that have one.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quakeframe.functions import arrays as A


def explode_samples(traces: DataFrame, samples: str = "samples") -> DataFrame:
    """The long view: one row per sample (trace_name, i, v), i from 0."""
    return traces.select("trace_name", F.posexplode(samples).alias("i", "v"))


def islands(df: DataFrame, part: Sequence[str], order: str, mask: Column, least: int = 1, most: int | None = None) -> DataFrame:
    """Runs of rows where the mask holds, consecutive in an integer order: (part, start, end, length)."""
    hit = df.filter(mask).withColumn("island", F.col(order) - F.row_number().over(Window.partitionBy(*part).orderBy(order)))
    out = hit.groupBy(*part, "island").agg(F.min(order).alias("start"), F.max(order).alias("end"), F.count("*").alias("length")).filter(F.col("length") >= least)
    return (out if most is None else out.filter(F.col("length") <= most)).drop("island")



def detect_clipping(traces: DataFrame, n_consecutive: int = 5, edge_fraction: float = 0.001) -> DataFrame:
    """Runs at a rail: within a fraction of the range of the largest or smallest value, n_consecutive samples or more.

    A constant trace is all clipped; an empty one isn't.
    """
    x = F.col("samples")
    lo, hi = F.array_min(x), F.array_max(x)
    edge = edge_fraction * (hi - lo)
    with_edges = traces.withColumn("qc_lo", lo + edge).withColumn("qc_hi", hi - edge).withColumn("qc_flat", (hi == lo) & (F.size(x) > 0))
    mask = F.transform(x, lambda v: (v >= F.col("qc_hi")) | (v <= F.col("qc_lo")))
    n = F.size(x)
    whole = F.array(F.struct(F.lit(0).alias("start"), (n - 1).alias("end")))
    r = F.when(F.col("qc_flat"), whole).otherwise(A.runs(mask, n_consecutive))
    out = with_edges.withColumn("clip_runs", r).withColumn("n_clipped", A.covered(F.col("clip_runs")))
    return out.withColumn("clip_fraction", F.when(n > 0, F.col("n_clipped") / n).otherwise(0.0)).withColumn("is_clipped", F.col("n_clipped") > 0).drop("qc_lo", "qc_hi", "qc_flat")


def detect_dead(traces: DataFrame, eps: float = 1e-10) -> DataFrame:
    """Dead: population deviation below eps, all samples equal, or no samples."""
    x = F.col("samples")
    dead = (F.size(x) == 0) | (A.std_pop(x) < eps) | (F.array_min(x) == F.array_max(x))
    return traces.withColumn("is_dead", F.coalesce(dead, F.lit(True)))


def detect_gaps(traces: DataFrame, least: int = 10, eps: float = 1e-15) -> DataFrame:
    """Runs of near-zero samples, `least` or more, off both ends by min(50, samples // 10)."""
    x = F.col("samples")
    n = F.size(x)
    margin = F.least(F.lit(50), F.floor(n / 10).cast("int"))
    inside = F.slice(x, margin + 1, F.greatest(n - 2 * margin, F.lit(0)))
    r = F.transform(A.runs(F.transform(inside, lambda v: F.abs(v) < eps), least), lambda q: F.struct((q["start"] + margin).alias("start"), (q["end"] + margin).alias("end")))
    out = traces.withColumn("gap_runs", r).withColumn("n_gap", A.covered(F.col("gap_runs")))
    return out.withColumn("has_gaps", F.size("gap_runs") > 0)


def detect_spikes(traces: DataFrame, k: float = 50.0, width: int = 3) -> DataFrame:
    """Short runs, `width` samples or fewer, farther from the median than k median absolute deviations; MAD 0: none."""
    with_median = traces.withColumn("qc_median", A.median(F.col("samples")))
    with_mad = with_median.withColumn("qc_mad", A.median(F.transform("samples", lambda v: F.abs(v - F.col("qc_median")))))
    mask = F.transform("samples", lambda v: F.abs(v - F.col("qc_median")) > k * F.col("qc_mad"))
    none = F.array().cast("array<struct<start:int,end:int>>")
    out = with_mad.withColumn("spike_runs", F.when(F.col("qc_mad") > 0, A.runs(mask, 1, width)).otherwise(none)).withColumn("n_spike", A.covered(F.col("spike_runs")))
    return out.withColumn("has_spikes", F.size("spike_runs") > 0).drop("qc_median", "qc_mad")


def snr(samples: Column, phase: Column, rate: Column, before_s: float = 5.0, after_s: float = 5.0) -> Column:
    """(snr, snr_db) of RMS after against before a phase sample; half-open windows, held inside the trace.

    NULL without a phase inside the trace or with an empty window; zero noise gives infinity, zero signal −infinity dB.
    """
    n = F.size(samples)
    lo = F.greatest(phase - F.floor(before_s * rate).cast("int"), F.lit(0))
    hi = F.least(phase + F.floor(after_s * rate).cast("int"), n)
    rms = lambda a: A.let(a, lambda x: F.sqrt(A.total(F.transform(x, lambda v: v * v)) / F.size(x)))
    ok = (phase > 0) & (phase < n) & (hi > phase) & (phase > lo)

    def both(p: Column) -> Column:
        noise, signal = p["noise"], p["signal"]
        r = F.when(noise == 0, F.lit(float("inf"))).otherwise(signal / F.nullif(noise, F.lit(0.0)))
        db = F.when(noise == 0, F.lit(float("inf"))).when(signal == 0, F.lit(float("-inf"))).otherwise(20 * F.log10(r))
        return F.struct(r.alias("snr"), db.alias("snr_db"))

    parts = F.struct(rms(F.slice(samples, lo + 1, phase - lo)).alias("noise"), rms(F.slice(samples, phase + 1, hi - phase)).alias("signal"))
    return F.when(ok, A.let(parts, both))


def quality_report(traces: DataFrame, phase: str = "phase_sample", rate: str = "sampling_rate_hz") -> DataFrame:
    """All checks of each trace, its SNR where the phase sample is positive, the number of issues of four, and pass."""
    out = detect_spikes(detect_gaps(detect_dead(detect_clipping(traces))))
    value = snr(F.col("samples"), F.col(phase), F.col(rate))
    flags = [F.col(c).cast("int") for c in ("is_clipped", "is_dead", "has_gaps", "has_spikes")]
    out = out.withColumn("x", value).withColumn("snr", F.col("x.snr")).withColumn("snr_db", F.col("x.snr_db")).drop("x")
    return out.withColumn("n_issues", sum(flags[1:], flags[0])).withColumn("passes", F.col("n_issues") == 0)


def scoreboard(report: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Counts of each issue, of passing traces and their share, and the median of finite SNR in dB."""
    finite = F.when(~F.isnan("snr_db") & (F.abs("snr_db") < float("inf")), F.col("snr_db"))
    return report.groupBy(*by).agg(
        F.count("*").alias("n"), F.count_if("passes").alias("n_pass"), F.count_if("is_clipped").alias("n_clipped"), F.count_if("is_dead").alias("n_dead"), F.count_if("has_gaps").alias("n_gaps"), F.count_if("has_spikes").alias("n_spikes"),
        F.percentile(finite, 0.5).alias("median_snr_db"), (100 * F.avg(F.col("passes").cast("double"))).alias("pass_percent"),
    )
