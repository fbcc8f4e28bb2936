"""Ranked tables of models from sweeps and noise tallies."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quakeframe.functions.metrics import mcc, prf, spread


def with_noise(sweep: DataFrame, noise: DataFrame, names: Mapping[str, str] | None = None) -> DataFrame:
    """Sweep rows with the noise tallies of (model, threshold); names maps models to noise keys.

    The literal map is a few rows; combinations that the sweep lacks are skipped.
    """
    if names:
        keys = F.create_map(*(F.lit(x) for pair in names.items() for x in pair))
        sweep = sweep.withColumn("noise_key", F.coalesce(F.try_element_at(keys, F.col("model")), F.col("model")))
    else:
        sweep = sweep.withColumn("noise_key", F.col("model"))
    side = noise.withColumnRenamed("model", "noise_key")
    return sweep.join(side, ["noise_key", "threshold"]).drop("noise_key")


def phases_wide(scores: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """P and S rows side by side: p_<column> and s_<column>."""
    return scores.groupBy(*keys).agg(*(F.max(F.when(F.col("phase") == p, F.col(c))).alias(f"{p.lower()}_{c}") for p in ("P", "S") for c in columns))


def picking_leaderboard(sweep: DataFrame, noise: DataFrame, fp_scope: str = "noise", names: Mapping[str, str] | None = None) -> DataFrame:
    """Per (model, threshold): P and S precision, recall, F1, with false positives of noise traces, event traces or both.

    Unmatched picks of event traces are kept as event_fp.
    """
    rows = with_noise(sweep, noise, names)
    noise_fp = F.when(F.col("phase") == "P", F.col("n_p")).otherwise(F.col("n_s"))
    fp = {"noise": noise_fp, "event": F.col("fp"), "event+noise": F.col("fp") + noise_fp}[fp_scope]
    rows = rows.withColumn("event_fp", F.col("fp")).withColumn("fp", fp)
    scores = prf("tp", "fp", "fn", zero="one")
    rows = rows.withColumns({k: c for k, c in scores.items()})
    return phases_wide(rows, ("model", "threshold"), ("tp", "fp", "fn", "event_fp", "precision", "recall", "f1", "mae_s"))


def detection_leaderboard(detections: DataFrame, noise: DataFrame, heads: DataFrame | None = None) -> DataFrame:
    """Per (model, threshold): tp = detected share of event traces, rounded half to even, fp = noise traces with any pick.

    detections: model, threshold, det_recall, n_event. heads (model, has_detection_head): models without have no metrics.
    """
    rows = detections.join(noise.select("model", "threshold", "n_noise", F.col("n_traces_with_pick").alias("fp")), ["model", "threshold"])
    tp = F.bround(F.col("det_recall") * F.col("n_event"), 0).cast("bigint")
    rows = rows.withColumn("tp", tp).withColumn("fn", F.col("n_event") - F.col("tp")).withColumn("tn", F.col("n_noise") - F.col("fp"))
    metrics = prf("tp", "fp", "fn", zero="one") | {"mcc": mcc("tp", "fp", "fn", "tn")}
    rows = rows.withColumns(metrics)
    if heads is not None:
        rows = rows.join(heads, "model", "left").withColumns({k: F.when(F.coalesce("has_detection_head", F.lit(False)), F.col(k)) for k in metrics}).drop("has_detection_head")
    return rows.select("model", "threshold", "n_event", "n_noise", "tp", "fp", "fn", "tn", *metrics)


def full_leaderboard(sweep: DataFrame, residuals: DataFrame, t1: DataFrame, n_event: int = 103040, n_noise: int = 23526) -> DataFrame:
    """Picking scores of event traces with residual spread, and event-against-noise scores beside them.

    Pool sizes stand in where a model has no t1 row.
    """
    scores = prf("tp", "fp", "fn", zero="one")
    rows = sweep.withColumns(scores).join(residuals.select("model", "phase", "std_s", "mad_s"), ["model", "phase"], "left")
    rows = rows.withColumn("std_s", F.coalesce("std_s", spread("rmse_s", "median_s"))).withColumn("mad_s", F.coalesce("mad_s", F.col("iqr_s") / 2))
    wide = phases_wide(rows, ("model", "threshold"), ("tp", "fp", "fn", "precision", "recall", "f1", "std_s", "mad_s"))
    side = t1.select("model", "threshold", "n_event", "n_noise", F.col("f1").alias("t1_f1"), F.col("mcc").alias("t1_mcc"))
    out = wide.join(side, ["model", "threshold"], "left")
    return out.withColumn("n_event", F.coalesce("n_event", F.lit(n_event))).withColumn("n_noise", F.coalesce("n_noise", F.lit(n_noise)))


def rank_models(board: DataFrame, threshold: float, columns: Sequence[str] = ("p_f1", "s_f1")) -> DataFrame:
    """Rows of one threshold, ranked by the sum of the columns, missing and NaN counting as 0."""
    total = sum((F.coalesce(F.nanvl(F.col(c), F.lit(0.0)), F.lit(0.0)) for c in columns), F.lit(0.0))
    return board.filter(F.col("threshold") == threshold).withColumn("total", total).withColumn("rank", F.rank().over(Window.orderBy(F.desc("total"))))


def to_report(df: DataFrame, digits: int = 4) -> DataFrame:
    """Doubles as strings of fixed digits, '' for NULL and NaN: for files that people read."""
    text = lambda c: F.when(F.col(c).isNull() | F.isnan(c), "").otherwise(F.format_string(f"%.{digits}f", F.col(c)))
    return df.select(*(text(c).alias(c) if kind in ("double", "float") else F.col(c) for c, kind in df.dtypes))
