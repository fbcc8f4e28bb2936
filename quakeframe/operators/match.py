"""Matching picks and detection boxes with catalogue arrivals.

Tables: truth (trace_name, phase, true_s), picks (model, trace_name, phase, emit_order, offset_s, peak_value) and boxes
(model, trace_name, emit_order, start_s, end_s, peak_value). `by` names further grouping columns of the predictions,
such as model and threshold. Nearest matches always join on equal trace (and phase) and reduce by `min_by`, which
combines before the shuffle, so no window sorts a trace's picks and no plan is a nested loop.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DEFAULT_TOLERANCE = 0.5


def tolerance(tol: float | Mapping[str, float], phase: str | Column = "phase") -> Column:
    """One tolerance for all phases or one each; a phase that isn't named has 0.5 s."""
    phase = F.col(phase) if isinstance(phase, str) else phase
    if not isinstance(tol, Mapping):
        return F.lit(float(tol))
    out = F.lit(DEFAULT_TOLERANCE)
    for name, value in tol.items():
        out = F.when(phase == name, F.lit(float(value))).otherwise(out)
    return out


def match_picks(picks: DataFrame, truth: DataFrame, tol, by: Sequence[str] = ("model",)) -> DataFrame:
    """Per (by, trace, phase): the nearest prediction of the true phase, if within the tolerance, inclusive.

    On a tie the first emitted wins. Residual: prediction minus truth. Phases are disjoint, so no pick serves twice.
    """
    keys = [*by, "trace_name", "phase"]
    # Arrivals go to the bins, as wide as the tolerance, around them, so that a long record's picks meet near ones only.
    bin_ = lambda x: F.floor(F.col(x) / F.greatest(tolerance(tol) * (1 + 1e-9), F.lit(1e-6)))
    arrivals = truth.withColumn("near_bin", F.explode(F.array(*(bin_("true_s") + k for k in (-1, 0, 1)))))
    near = picks.withColumn("near_bin", bin_("offset_s")).join(arrivals, ["trace_name", "phase", "near_bin"]).drop("near_bin").withColumn("residual_s", F.col("offset_s") - F.col("true_s"))
    near = near.filter(F.abs("residual_s") <= tolerance(tol))
    best = F.min_by(F.struct("emit_order", "offset_s", "peak_value", "true_s", "residual_s"), F.struct(F.abs("residual_s"), "emit_order"))
    return near.groupBy(*keys).agg(best.alias("x")).select(*keys, "x.*")


def closest_match(picks: DataFrame, truth: DataFrame, tol: float, by: Sequence[str] = ()) -> DataFrame:
    """`match_picks` for curves of one kind: nearest peak within an inclusive tolerance, first on a tie."""
    return match_picks(picks, truth, tol, by)


def unmatched(picks: DataFrame, matched: DataFrame, by: Sequence[str] = ("model",)) -> DataFrame:
    """Predictions that no match consumed, those of a phase without truth on their trace included."""
    return picks.join(matched.select(*by, "trace_name", "phase", "emit_order"), [*by, "trace_name", "phase", "emit_order"], "left_anti")


def match_cross_phase(picks: DataFrame, truth: DataFrame, tol, by: Sequence[str] = ("model",)) -> DataFrame:
    """Truth of P takes the nearest prediction of any phase, then truth of S takes from what is left.

    Returns (by, trace, phase: the true one, predicted_phase, emit_order, offset_s, residual_s).
    """
    keys = [*by, "trace_name"]

    def one(left: DataFrame, phase: str) -> DataFrame:
        t = truth.filter(F.col("phase") == phase).select("trace_name", "true_s")
        near = left.join(t, "trace_name").withColumn("residual_s", F.col("offset_s") - F.col("true_s")).filter(F.abs("residual_s") <= tolerance(tol, F.lit(phase)))
        best = F.min_by(F.struct(F.col("phase").alias("predicted_phase"), "emit_order", "offset_s", "residual_s"), F.struct(F.abs("residual_s"), "emit_order"))
        return near.groupBy(*keys).agg(best.alias("x")).select(*keys, F.lit(phase).alias("phase"), "x.*")

    first = one(picks, "P")
    used = first.select(*keys, F.col("emit_order"), F.col("predicted_phase").alias("phase"))
    return first.unionByName(one(picks.join(used, [*keys, "emit_order", "phase"], "left_anti"), "S"))


def truth_boxes(truth: DataFrame, factor: float = 1.4) -> DataFrame:
    """(trace_name, true_start_s, true_end_s): P to S plus `factor` times S − P, where both exist and S is later."""
    wide = truth.groupBy("trace_name").pivot("phase", ["P", "S"]).agg(F.min("true_s")).filter("S > P")
    return wide.select("trace_name", F.col("P").alias("true_start_s"), (F.col("S") + factor * (F.col("S") - F.col("P"))).alias("true_end_s"))


def match_detections(boxes: DataFrame, truth: DataFrame, factor: float = 1.4, by: Sequence[str] = ("model",)) -> DataFrame:
    """Best box for each truth box of a trace with any box: largest overlap over hull, first emitted on a tie.

    A trace counts as detected by having boxes; where none overlaps, iou and residuals are NULL.
    """
    return match_boxes(boxes, truth_boxes(truth, factor), by)


def match_boxes(boxes: DataFrame, targets: DataFrame, by: Sequence[str] = ("model",)) -> DataFrame:
    """`match_detections` with the truth boxes (trace_name, true_start_s, true_end_s) given."""
    keys = [*by, "trace_name"]
    both = boxes.join(targets, "trace_name")
    overlap = F.greatest(F.lit(0.0), F.least("end_s", "true_end_s") - F.greatest("start_s", "true_start_s"))
    hull = F.greatest("end_s", "true_end_s") - F.least("start_s", "true_start_s")
    both = both.withColumn("iou", F.when(hull > 0, overlap / F.nullif(hull, F.lit(0.0))).otherwise(0.0))
    best = F.min_by(F.struct("iou", (F.col("start_s") - F.col("true_start_s")).alias("start_residual_s"), (F.col("end_s") - F.col("true_end_s")).alias("end_residual_s")), F.struct(-F.col("iou"), "emit_order"))
    out = both.groupBy(*keys).agg(F.count("*").alias("n_boxes"), best.alias("x"))
    hit = F.col("x.iou") > 0
    return out.select(*keys, "n_boxes", *(F.when(hit, F.col(f"x.{c}")).alias(c) for c in ("iou", "start_residual_s", "end_residual_s")))


#: A box is cut into intervals of FAN to the power of a level units each, of LEVELS levels: 16^8 seconds are 136 years.
FAN, LEVELS = 16, 8


def _nodes(low: Column, high: Column) -> Column:
    """The fewest intervals (level, place) that fill the units low..high: at each level, what sticks out of whole parents."""
    none = F.array().cast("array<struct<level:int,place:bigint>>")
    named = lambda level, a, b: F.when(a <= b, F.transform(F.sequence(a, b), lambda p: F.struct(level.cast("int").alias("level"), p.alias("place")))).otherwise(none)

    def up(state: Column, level: Column) -> Column:
        a, b = state["a"], state["b"]
        above, below = F.ceil(a / FAN), F.floor((b + 1) / FAN) - 1  # parents that are whole
        split = (level < LEVELS - 1) & (above <= below)
        both = F.concat(named(level, a, F.when(split, above * FAN - 1).otherwise(b)), F.when(split, named(level, (below + 1) * FAN, b)).otherwise(none))
        return F.struct(F.when(split, above).otherwise(F.lit(0)).cast("bigint").alias("a"), F.when(split, below).otherwise(F.lit(-1)).cast("bigint").alias("b"), F.concat(state["found"], both).alias("found"))

    begin = F.struct(low.cast("bigint").alias("a"), high.cast("bigint").alias("b"), none.alias("found"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(LEVELS - 1)), begin, lambda s, level: F.when(s["a"] <= s["b"], up(s, level)).otherwise(s), lambda s: s["found"])


def gate(picks: DataFrame, boxes: DataFrame, by: Sequence[str] = ("model",), unit_s: float | None = None) -> DataFrame:
    """Picks inside any box of their trace, both ends inclusive; without boxes none stays.

    With unit_s, boxes are an index of intervals: a box is cut into at most 2 * (FAN - 1) nodes a level of 1, 16, 256, ...
    units, whatever its length, and a pick asks for the one node of each level that it would be in. So a long trace compares
    no pick with every box, and a box over years has some hundred rows.
    """
    keys = [*by, "trace_name"]
    b = boxes.select(*keys, F.col("start_s").alias("box_start"), F.col("end_s").alias("box_end"))
    if unit_s is None:
        on = [picks[k] == b[k] for k in keys] + [picks["offset_s"].between(b["box_start"], b["box_end"])]
        return picks.join(b, on, "left_semi")
    unit = lambda x: F.floor(x / unit_s).cast("bigint")
    b = b.filter("box_end >= box_start").withColumn("node", F.explode(_nodes(unit(F.col("box_start")), unit(F.col("box_end")))))
    p = picks.withColumn("pick_row", F.monotonically_increasing_id())
    probes = F.transform(F.sequence(F.lit(0), F.lit(LEVELS - 1)), lambda k: F.struct(k.alias("level"), F.floor(unit(F.col("offset_s")) / F.pow(F.lit(float(FAN)), k)).cast("bigint").alias("place")))
    p = p.withColumn("node", F.explode(probes))
    on = [p[k] == b[k] for k in (*keys, "node")] + [p["offset_s"].between(b["box_start"], b["box_end"])]
    return p.join(b, on, "left_semi").dropDuplicates([*keys, "pick_row"]).select(*picks.columns)  # found in several boxes


def event_residuals(picks: DataFrame, stations: DataFrame, strict: Mapping[str, float] | None = None) -> DataFrame:
    """Picks against the arrivals of their station's last trace, strictly closer than 5 s (P) or 8 s (S).

    stations: station_code, trace_order, p_s, s_s. Picks: station_code, phase, offset_s.
    """
    strict = {"P": 5.0, "S": 8.0} if strict is None else strict
    last = stations.groupBy("station_code").agg(F.max_by(F.struct("p_s", "s_s"), "trace_order").alias("x")).select("station_code", "x.*")
    out = picks.join(last, "station_code").withColumn("residual_s", F.col("offset_s") - F.when(F.col("phase") == "P", F.col("p_s")).otherwise(F.col("s_s")))
    return out.filter(F.abs("residual_s") < tolerance(strict)).drop("p_s", "s_s")


def peaks_in_windows(peaks: DataFrame, windows: DataFrame, margin: int = 100, by: Sequence[str] = ("model",)) -> DataFrame:
    """For each trigger window the strongest P and the strongest S peak in [on − margin, off + margin), earliest on a tie.

    peaks: phase, sample, prob; windows: box, on_sample, off_sample. Windows without both phases go, and so do pairs
    whose S isn't min_gap after P only when `pair_picks` of the curves module asks for it.
    """
    keys = [*by, "trace_name"]
    both = windows.join(peaks, keys).filter((F.col("sample") >= F.col("on_sample") - margin) & (F.col("sample") < F.col("off_sample") + margin))
    side = lambda phase: F.min_by(F.when(F.col("phase") == phase, F.struct("sample", "prob")), F.when(F.col("phase") == phase, F.struct(-F.col("prob"), "sample")))
    out = both.groupBy(*keys, "box", "on_sample", "off_sample").agg(side("P").alias("p"), side("S").alias("s")).filter("p IS NOT NULL AND s IS NOT NULL")
    return out.select(*keys, "box", "on_sample", "off_sample", F.col("p.sample").alias("p_sample"), F.col("p.prob").alias("p_prob"), F.col("s.sample").alias("s_sample"), F.col("s.prob").alias("s_prob"))


def with_truth(df: DataFrame, truth: DataFrame) -> DataFrame:
    """Only traces that have a true pick; the others are neither evaluated nor failed."""
    return df.join(truth.select("trace_name"), "trace_name", "left_semi")


def restrict(df: DataFrame, index: DataFrame, on: str = "trace_name") -> DataFrame:
    """Rows whose key is in a sampled index."""
    return df.join(index.select(on), on, "left_semi")


def not_done(df: DataFrame, results: DataFrame, on: Sequence[str] = ("model", "params_hash", "trace_name")) -> DataFrame:
    """What a resumed run still has to do: rows without a result under the same model and parameters."""
    return df.join(results.select(*on), list(on), "left_anti")
