"""Probability curves to picks, boxes and pairs; curves are arrays p, s, m of one row per (model, trace)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quakeframe.functions import arrays as A
from quakeframe.operators.match import peaks_in_windows


def trigger(curves: DataFrame, on: float, off: float, curve: str = "m", by: Sequence[str] = ("model",)) -> DataFrame:
    """Boxes of a detection curve by two thresholds: (by, trace_name, box, on_sample, off_sample, peak_value)."""
    out = curves.select(*by, "trace_name", F.posexplode(A.hysteresis(F.col(curve), on, off)).alias("box", "x"))
    return out.select(*by, "trace_name", "box", "x.*")


def smooth(curve: Column, width: int = 10) -> Column:
    """Centred moving average; near the ends, of the samples that are there."""
    half = width // 2
    at = F.sequence(F.lit(0), F.size(curve) - 1)
    return F.when(F.size(curve) > 0, F.transform(at, lambda i: A.mean(F.slice(curve, F.greatest(i - half, F.lit(0)) + 1, F.least(i + width - half, F.size(curve)) - F.greatest(i - half, F.lit(0)))))).otherwise(curve)


def guard(curves: DataFrame) -> DataFrame:
    """Samples where any of the three curves is NaN, infinite or missing become 0 in all three."""
    bad = lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))
    zipped = F.transform(F.arrays_zip(F.col("p").alias("p"), F.col("s").alias("s"), F.col("m").alias("m")), lambda x: F.when(bad(x["p"]) | bad(x["s"]) | bad(x["m"]), F.struct(F.lit(0.0).alias("p"), F.lit(0.0).alias("s"), F.lit(0.0).alias("m"))).otherwise(x))
    out = curves.withColumn("guarded", zipped)
    return out.select(*(F.transform("guarded", lambda x: x[c]).alias(c) if c in ("p", "s", "m") else F.col(c) for c in curves.columns))  # noqa: B023


def interpolate(curve: Column, n: Column | int) -> Column:
    """Linear interpolation to exactly n samples over the same span."""
    n = F.lit(n) if isinstance(n, int) else n
    size = F.size(curve)

    def at(i: Column) -> Column:
        x = i * (size - 1) / F.greatest(n - 1, F.lit(1))
        k = F.floor(x).cast("int")
        f = x - k
        return F.get(curve, k) * (1 - f) + F.coalesce(F.get(curve, k + 1), F.get(curve, k)) * f

    return F.when((size > 0) & (n > 0), F.transform(F.sequence(F.lit(0), n - 1), at))


def pair_picks(peaks: DataFrame, boxes: DataFrame, min_box: int = 50, min_gap: int = 100, by: Sequence[str] = ("model",)) -> DataFrame:
    """A P and an S for each box of min_box samples or more, the S at least min_gap samples after the P.

    Pairs whose P isn't after the S of the pair before them on the trace go (the first always stays); pairs are numbered
    densely in pair_id, and by box in pair_seq.
    """
    long = boxes.filter(F.col("off_sample") - F.col("on_sample") >= min_box)
    pairs = peaks_in_windows(peaks, long, by=by).filter(F.col("s_sample") - F.col("p_sample") >= min_gap)
    w = Window.partitionBy(*by, "trace_name").orderBy("p_sample", "box")
    pairs = pairs.withColumn("s_before", F.lag("s_sample").over(w)).withColumn("pair_seq", F.row_number().over(w) - 1)
    pairs = pairs.filter("s_before IS NULL OR p_sample > s_before").drop("s_before")
    return pairs.withColumn("pair_id", F.row_number().over(w) - 1)


def extract_pairs(pairs: DataFrame, traces: DataFrame, rate: float = 100.0, p_window_s: float = 1.0, s_window_s: float = 3.0) -> DataFrame:
    """Pair rows as picks: time offset to the millisecond, probability to two places, largest amplitude after the pick.

    traces: trace_name, samples (or the largest magnitude over components). Picks before the start or after the end go.
    """
    both = F.array(F.struct(F.lit("P").alias("phase"), F.col("p_sample").alias("sample"), F.col("p_prob").alias("prob"), F.lit(p_window_s).alias("span")), F.struct(F.lit("S").alias("phase"), F.col("s_sample").alias("sample"), F.col("s_prob").alias("prob"), F.lit(s_window_s).alias("span")))
    rows = pairs.join(traces.select("trace_name", "samples"), "trace_name").filter((F.col("p_sample") >= 0) & (F.col("p_sample") < F.size("samples")))
    rows = rows.withColumn("x", F.explode(both))
    part = F.slice("samples", F.col("x.sample") + 1, F.greatest(F.round(F.col("x.span") * rate).cast("int"), F.lit(1)))
    keep = [c for c in pairs.columns if c in ("model", "trace_name", "pair_id", "pair_seq")]
    return rows.select(*keep, F.col("x.phase").alias("phase"), F.col("x.sample").alias("sample"), (F.floor(F.col("x.sample") / rate * 1000) / 1000).alias("offset_s"), F.round("x.prob", 2).alias("prob"), F.array_max(F.transform(part, lambda v: F.abs(v))).alias("amplitude"))


def mask_curves(curves: DataFrame, boxes: DataFrame, margin: int = 50, by: Sequence[str] = ("model",)) -> DataFrame:
    """Curves with 0 outside the surviving boxes; P and S keep `margin` samples more at both ends, held at the start."""
    keys = [*by, "trace_name"]
    mine = boxes.groupBy(*keys).agg(F.collect_list(F.struct("on_sample", "off_sample")).alias("mine"))  # of one trace
    out = curves.join(mine, keys, "left").withColumn("mine", F.coalesce("mine", F.array().cast("array<struct<on_sample:int,off_sample:int>>")))
    kept = lambda c, more: F.transform(c, lambda v, i: F.when(F.exists("mine", lambda b: (i >= b["on_sample"] - more) & (i < b["off_sample"] + more)), v).otherwise(0.0))
    return out.withColumns({"p": kept("p", margin), "s": kept("s", margin), "m": kept("m", 0)}).drop("mine")


def fill_mask(fast: Column, slow: Column, fast_threshold: float, slow_threshold: float, least: int, coverage: float = 0.7) -> Column:
    """Where to fill, by the detection curves of two passes: inside runs of `least` samples or more at which the slow one
    reaches its threshold, if the fast one reaches its own on less than `coverage` of the run, those on which it doesn't."""

    def thin(f: Column, r: Column) -> Column:
        part = F.slice(f, r["start"] + 1, r["end"] - r["start"] + 1)
        return F.size(F.filter(part, lambda v: v >= fast_threshold)) / (r["end"] - r["start"] + 1) < coverage

    bad = F.filter(A.runs(F.transform(slow, lambda v: v >= slow_threshold), least), lambda r: thin(fast, r))
    return A.let(bad, lambda b: F.transform(fast, lambda v, i: (v < fast_threshold) & F.exists(b, lambda r: i.between(r["start"], r["end"]))))


def dual_pass(fast: Column, slow: Column, mask: Column) -> Column:
    """The fast curve, and the larger of both where `mask` says so: one mask serves P, S and detection."""
    return F.transform(F.arrays_zip(fast.alias("f"), slow.alias("s"), mask.alias("m")), lambda x: F.when(x["m"], F.greatest(x["f"], x["s"])).otherwise(x["f"]))


def pick_near_label(peaks: DataFrame, labels: DataFrame, radius: int, by: Sequence[str] = ("model",)) -> DataFrame:
    """For each label the strongest peak strictly within `radius` samples, earliest on a tie, else NULL."""
    keys = [*by, "trace_name", "phase"]
    near = peaks.join(labels.select("trace_name", "phase", F.col("sample").alias("label_sample")), ["trace_name", "phase"]).filter(F.abs(F.col("sample") - F.col("label_sample")) < radius)
    best = near.groupBy(*keys, "label_sample").agg(F.min_by(F.struct("sample", "prob"), F.struct(-F.col("prob"), "sample")).alias("x"))
    all_ = labels.select("trace_name", "phase", F.col("sample").alias("label_sample"))
    if by:  # a row for each model: few, and Spark checks the size before it broadcasts them
        all_ = all_.crossJoin(peaks.select(*by).distinct())
    return all_.join(best, [*keys, "label_sample"], "left").select(*keys, "label_sample", F.col("x.sample").alias("sample"), F.col("x.prob").alias("prob"))


def single_trigger(triggers: Column, start: Column, end: Column) -> Column:
    """1 where exactly one trigger lies strictly inside the true range, else 0."""
    inside = F.filter(triggers, lambda t: (t["on_sample"] > start) & (t["off_sample"] < end))
    return (F.size(inside) == 1).cast("int")


def best_trigger(triggers: Column, least: float = 0.1) -> Column:
    """Largest peak of any trigger, if at least 0.1; NULL without triggers."""
    return F.array_max(F.filter(F.transform(triggers, lambda t: t["peak_value"]), lambda v: v >= least))
