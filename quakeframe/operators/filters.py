"""Row filters on the trace table; all are plain predicates, so scans read only the rows and columns they need."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def browse(traces: DataFrame, min_snr: float = 5.0, min_magnitude: float = 2.5) -> DataFrame:
    """P in the window, P SNR above min_snr, magnitude min_magnitude or more."""
    return traces.filter(F.col("trace_p_in_window") & (F.col("trace_p_snr_db") > min_snr) & (F.col("source_magnitude") >= min_magnitude))


def quality_gate(traces: DataFrame, split: str | None = "test", edge: int = 200, window: int = 6000, min_snr: float = 5.0, min_magnitude: float = 2.5, max_distance: float = 200.0) -> DataFrame:
    """Traces of a split whose P and S lie inside the window by `edge` samples, with SNR, magnitude and distance in bounds.

    A bound of 0 switches its gate off; without a split column all rows count.
    """
    inside = lambda c: F.col(c).between(edge, window - 1 - edge)
    ok = inside("trace_p_arrival_sample") & inside("trace_s_arrival_sample")
    if split is not None and "split" in traces.columns:
        ok = (F.col("split") == split) & ok
    if min_snr:
        ok = ok & (F.col("trace_p_snr_db") >= min_snr) & (F.col("trace_s_snr_db") >= min_snr)
    if min_magnitude:
        ok = ok & (F.col("source_magnitude") >= min_magnitude)
    if max_distance:
        ok = ok & (F.col("path_ep_distance_km") <= max_distance)
    return traces.filter(ok)


def chunks(traces: DataFrame, years: list[str]) -> DataFrame:
    """Partition pruning on trace_chunk."""
    return traces.filter(F.col("trace_chunk").isin(*years))


def coda_eligible(s_sample: Column, npts: Column, margin: int, window: int) -> Column:
    """S exists and leaves room for margin + window samples."""
    return (s_sample >= 0) & (npts - s_sample >= margin + window)


def nearest_station(traces: DataFrame, max_distance: float = 300.0) -> DataFrame:
    """The nearest trace with an S pick within the distance: a top-1 report."""
    return traces.filter((F.col("trace_s_arrival_sample") > 0) & (F.col("path_hyp_distance_km") < max_distance)).orderBy("path_hyp_distance_km", "trace_name").limit(1)


def nearest(df: DataFrame, k: int, distance: str, key: str) -> DataFrame:
    """The k nearest rows, missing distances last: a top-k report."""
    d = F.col(distance)
    return df.orderBy(d.isNull() | F.isnan(d), d, key).limit(k)


def station_spacing(df: DataFrame, by: str, distance: str) -> DataFrame:
    """Median difference between sorted distances of each group; 1.0 where there are fewer than two."""
    step = F.col(distance) - F.lag(distance).over(Window.partitionBy(by).orderBy(distance))
    return df.select(by, step.alias("step")).groupBy(by).agg(F.coalesce(F.percentile("step", 0.5), F.lit(1.0)).alias("spacing"))


def profile(traces: DataFrame) -> DataFrame:
    """Traces, distinct years in order, stations and events."""
    return traces.agg(F.count("*").alias("n_traces"), F.array_sort(F.collect_set("trace_chunk")).alias("years"), F.countDistinct("station_code").alias("n_stations"), F.countDistinct("source_id").alias("n_events"))
