"""Scores of picks, detections and traces. Every table of scores comes from one plan; thresholds never loop over jobs."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quakeframe.functions.metrics import mcc, prf, ratio, residual_aggregates, spread
from quakeframe.operators.match import gate, match_boxes, match_picks, tolerance, truth_boxes

PHASES = ("P", "S")
#: Ranges that a group's values are counted in before any are sorted: RANGE_ROOT by RANGE_ROOT.
RANGE_ROOT = 32
RANGES = RANGE_ROOT**2
#: Values are ranked to one in so many by the sketch that the ranges' ends come from.
RANK_ERROR = 20_000


def threshold_sweep(predictions: DataFrame, thresholds: Sequence[float]) -> DataFrame:
    """Picks or boxes for every threshold that their peak value reaches, inclusive: one pass, no loop of jobs."""
    reached = F.filter(F.array(*(F.lit(float(t)) for t in thresholds)), lambda t: F.col("peak_value") >= t)
    return predictions.withColumn("threshold", F.explode(reached))


def _grid(truth: DataFrame, models: DataFrame) -> DataFrame:
    """Numbers of true picks for each (model, threshold, ...) row and phase: truth depends on neither."""
    per_phase = truth.groupBy("phase").agg(F.count("*").alias("n_true"), F.countDistinct("trace_name").alias("n_traces"))
    return models.crossJoin(F.broadcast(per_phase))  # two rows


def _per_trace(picks: DataFrame, truth: DataFrame, tol, by: Sequence[str]) -> DataFrame:
    """Per (by, trace, phase), of traces with truth: the number of predictions, and the residual of the match, if any.

    Predictions meet their trace's arrivals, a few for each, in one join, and everything is counted in one aggregation.
    """
    arrivals = truth.groupBy("trace_name").agg(F.collect_list(F.struct("phase", "true_s")).alias("arrivals"))
    both = picks.join(arrivals, "trace_name")
    own = F.transform(F.filter("arrivals", lambda t: t["phase"] == F.col("phase")), lambda t: F.struct(F.abs(F.col("offset_s") - t["true_s"]).alias("distance"), (F.col("offset_s") - t["true_s"]).alias("residual_s")))
    near = both.select(*by, "trace_name", "phase", "emit_order", F.array_min(own).alias("x"))
    order = F.when(F.col("x.distance") <= tolerance(tol), F.struct("x.distance", "emit_order"))
    return near.groupBy(*by, "trace_name", "phase").agg(F.count("*").alias("n_pred"), F.min_by(F.col("x.residual_s"), order).alias("residual_s"))


def score_picking(picks: DataFrame, truth: DataFrame, tol, models: DataFrame, by: Sequence[str] = ("model",), zero: str = "null") -> DataFrame:
    """tp, fp, fn with precision, recall, F1 and residual statistics per (by, phase).

    fp: all unmatched predictions on traces with truth; fn: true picks without a match.
    """
    per = _per_trace(picks, truth, tol, by).groupBy(*by, "phase").agg(F.sum("n_pred").alias("n_pred"), *(c.alias(n) for n, c in residual_aggregates("residual_s").items()))
    out = _grid(truth, models).join(per, [*by, "phase"], "left").fillna(0, ["n_pred", "n_residuals"])
    tp = F.col("n_residuals")
    out = out.withColumns({"tp": tp, "fp": F.col("n_pred") - tp, "fn": F.col("n_true") - tp})
    return out.select(*by, "phase", "tp", "fp", "fn", *(c.alias(n) for n, c in prf("tp", "fp", "fn", zero).items()), *residual_aggregates("residual_s"))


def tally(picks: DataFrame, truth: DataFrame, tol, models: DataFrame, by: Sequence[str] = ("model",)) -> DataFrame:
    """The counts of `score_picking` alone."""
    return score_picking(picks, truth, tol, models, by).select(*by, "phase", "tp", "fp", "fn")


def ranged(values: DataFrame, x: str, by: Sequence[str], *more: Column) -> DataFrame:
    """`values` with the `range` of each, and `more` aggregates of its group.

    A quantile sketch, combined over tasks, gives RANGES - 1 values that part a group's rows into about equal ranges, however
    the numbers are spread; equal values share a range.
    """
    by = list(by)
    shares = F.array(*(F.lit(k / RANGES) for k in range(1, RANGES)))
    ends = values.groupBy(*(F.col(c).alias(f"of_{c}") for c in by)).agg(F.percentile_approx(x, shares, F.lit(RANK_ERROR)).alias("ends"), *more)
    ends = ends.withColumn("coarse", F.filter("ends", lambda _, i: i % RANGE_ROOT == RANGE_ROOT - 1))
    joined = values.join(ends, reduce(and_, [F.col(c).eqNullSafe(F.col(f"of_{c}")) for c in by])) if by else values.crossJoin(F.broadcast(ends))  # one row
    first = F.size(F.filter("coarse", lambda e: e < F.col(x))) * RANGE_ROOT
    joined = joined.withColumn("first", first)
    inside = F.size(F.filter(F.slice("ends", F.col("first") + 1, RANGE_ROOT - 1), lambda e: e < F.col(x)))
    return joined.withColumn("range", F.col("first") + inside).drop("ends", "coarse", "first", *(f"of_{c}" for c in by))


def ordered_elements(values: DataFrame, x: str, n: str, by: Sequence[str], shares: Mapping[str, float], linear: bool = True) -> DataFrame:
    """Elements of sorted values, from how often each occurs: (by, one column for each share), exact whatever the numbers.

    values: (by, x, n) with n occurrences of each distinct x. linear: interpolated at share * (total - 1), else the element
    at int(share * total). Counts are summed over ranges of each group's values first, so that only a range's own
    distinct values are ever sorted in one task.
    """
    by = list(by)
    placed = ranged(values.select(*by, F.col(x).cast("double").alias("x"), F.col(n).alias("n")).filter("x IS NOT NULL"), "x", by, F.sum("n").alias("total"))
    sums = placed.groupBy(*by, "range").agg(F.sum("n").alias("m"))
    below = Window.partitionBy(*by).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # RANGES rows a group
    sums = sums.withColumn("before", F.coalesce(F.sum("m").over(below), F.lit(0)))
    inside = Window.partitionBy(*by, "range").orderBy("x")
    ranked = placed.alias("p").join(sums.alias("s"), reduce(and_, [F.col(f"p.{c}").eqNullSafe(F.col(f"s.{c}")) for c in (*by, "range")]))
    ranked = ranked.select(*(F.col(f"p.{c}") for c in by), F.col("p.range").alias("range"), "x", "n", "total", "before")
    ranked = ranked.withColumn("upto", F.sum("n").over(inside) + F.col("before"))
    at = lambda place: F.min(F.when(F.col("upto") > place, F.col("x")))
    parts = []
    for name, share in shares.items():
        place = F.lit(share) * (F.col("total") - 1) if linear else F.floor(F.lit(share) * F.col("total"))
        low, high = at(F.floor(place)), at(F.ceil(place))
        parts.append((low + (high - low) * F.max(place - F.floor(place)) if linear else low).alias(name))
    return ranked.groupBy(*by).agg(*parts)


def residual_stats(residuals: DataFrame, by: Sequence[str], iqr: str = "index") -> DataFrame:
    """n, MAE, RMSE, population deviation, median, exact MAD and IQR of residual_s.

    iqr='index' takes the elements of the sorted residuals at int(.75 n) and int(.25 n); 'linear' interpolates. Order
    statistics come from counts of distinct values, so that no task holds a group's residuals.
    """
    by, x = list(by), F.col("residual_s")
    sums = residuals.groupBy(*by).agg(F.count("*").alias("n"), F.avg(F.abs(x)).alias("mae_s"), F.sqrt(F.avg(x * x)).alias("rmse_s"), F.stddev_pop(x).alias("std_s"))
    values = residuals.groupBy(*by, "residual_s").agg(F.count("*").alias("n_here"))
    mid = ordered_elements(values, "residual_s", "n_here", by, {"median_s": 0.5})
    quartiles = ordered_elements(values, "residual_s", "n_here", by, {"q3": 0.75, "q1": 0.25}, linear=iqr != "index")
    away = values.join(mid, by).groupBy(*by, F.abs(x - F.col("median_s")).alias("away")).agg(F.sum("n_here").alias("n_here"))
    mad = ordered_elements(away, "away", "n_here", by, {"mad_s": 0.5})
    out = sums.join(mid, by).join(mad, by).join(quartiles, by)
    return out.select(*by, "n", "mae_s", "rmse_s", "std_s", "median_s", "mad_s", (F.col("q3") - F.col("q1")).alias("iqr_s"))


def residuals_or_fallback(summary: DataFrame) -> DataFrame:
    """std_s and mad_s where raw residuals are gone: from RMSE and median, and half the IQR."""
    return summary.withColumn("std_s", F.coalesce("std_s", spread("rmse_s", "median_s"))).withColumn("mad_s", F.coalesce("mad_s", F.col("iqr_s") / 2))


def residual_report(summary: DataFrame) -> DataFrame:
    """std_s, and bounds of the MAD: half the IQR and 0.6745 deviations; rows without residuals go."""
    std = spread("rmse_s", "median_s")
    return summary.filter("n_residuals > 0").select("*", std.alias("std_s"), (0.5 * F.col("iqr_s")).alias("mad_low_s"), (0.6745 * std).alias("mad_high_s"))


def phase_identification(matches: DataFrame, by: Sequence[str] = ("model",)) -> DataFrame:
    """MCC and accuracy of predicted against true phase over cross-phase matches; NULL unless both have both classes."""
    t, p = F.col("phase") == "P", F.col("predicted_phase") == "P"
    n = matches.groupBy(*by).agg(F.count("*").alias("n_pairs"), F.count_if(t & p).alias("pp"), F.count_if(~t & p).alias("sp"), F.count_if(t & ~p).alias("ps"), F.count_if(~t & ~p).alias("ss"))
    both = (F.col("pp") + F.col("ps") > 0) & (F.col("sp") + F.col("ss") > 0) & (F.col("pp") + F.col("sp") > 0) & (F.col("ps") + F.col("ss") > 0)
    return n.select(*by, "n_pairs", (F.col("ps") + F.col("sp")).alias("n_confusions"), F.when(both, mcc("pp", "sp", "ps", "ss")).alias("mcc_phase_id"), ratio(F.col("pp") + F.col("ss"), "n_pairs").alias("phase_accuracy"))


def auc(df: DataFrame, label: str = "label", score: str = "score", by: Sequence[str] = ()) -> DataFrame:
    """Area under the ROC curve by average ranks; NULL for one class only or where every score is 0.

    Scores are first counted by value, then by `ranged` ranges of a group's scores: running sums go over the ranges, and
    inside each over its own distinct values, so that no task sorts a group's scores.
    """
    by = list(by)
    v = df.groupBy(*by, F.col(score).cast("double").alias("x")).agg(F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) != 1).alias("neg"))
    v = ranged(v, "x", by)
    below = Window.partitionBy(*by).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    sums = v.groupBy(*by, "range").agg(F.sum("neg").alias("m")).withColumn("before", F.coalesce(F.sum("m").over(below), F.lit(0)))  # RANGES rows a group
    inside = Window.partitionBy(*by, "range").orderBy("x").rowsBetween(Window.unboundedPreceding, -1)
    v = v.join(sums.drop("m"), [*by, "range"]).withColumn("neg_below", F.coalesce(F.sum("neg").over(inside), F.lit(0)) + F.col("before"))
    wins = F.sum(F.col("pos") * (F.col("neg_below") + F.col("neg") / 2.0))
    out = v.groupBy(*by).agg(F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg"), F.max(F.abs("x")).alias("m"), wins.alias("w"))
    ok = (F.col("n_pos") > 0) & (F.col("n_neg") > 0) & (F.col("m") > 0)
    return out.select(*by, "n_pos", "n_neg", F.when(ok, F.col("w") / F.nullif(F.col("n_pos").cast("double") * F.col("n_neg"), F.lit(0.0))).alias("auc"))


def score_t1(events: DataFrame, noise: DataFrame, picks: DataFrame, thresholds: Sequence[float], models: DataFrame) -> DataFrame:
    """Event against noise traces: positive is any pick at the threshold. events, noise: trace_name."""
    traces = events.select("trace_name", F.lit(1).alias("label")).union(noise.select("trace_name", F.lit(0).alias("label")))
    any_ = threshold_sweep(picks, thresholds).select("model", "threshold", "trace_name").distinct().withColumn("hit", F.lit(1))
    size = traces.groupBy().agg(F.count_if(F.col("label") == 1).alias("n_event"), F.count_if(F.col("label") == 0).alias("n_noise"))
    n = any_.join(traces, "trace_name").groupBy("model", "threshold").agg(F.count_if(F.col("label") == 1).alias("tp"), F.count_if(F.col("label") == 0).alias("fp"))
    grid = models.select("model").crossJoin(models.sparkSession.createDataFrame([(float(t),) for t in thresholds], "threshold double"))
    out = grid.join(n, ["model", "threshold"], "left").fillna(0, ["tp", "fp"]).crossJoin(F.broadcast(size))  # one row
    out = out.withColumn("fn", F.col("n_event") - F.col("tp")).withColumn("tn", F.col("n_noise") - F.col("fp"))
    zero = {k: F.coalesce(c, F.lit(0.0)) for k, c in prf("tp", "fp", "fn").items()}
    return out.select("model", "threshold", "n_event", "n_noise", "tp", "fp", "fn", "tn", *(c.alias(k) for k, c in zero.items()), mcc("tp", "fp", "fn", "tn").alias("mcc"))


def noise_tallies(noise: DataFrame, picks: DataFrame, thresholds: Sequence[float], models: DataFrame) -> DataFrame:
    """Per (model, threshold) over all noise traces: traces with picks, picks by phase, mean, largest, median per trace.

    Only traces with picks are rows; how many have none follows from the number of noise traces, and they are the zeros
    in mean and median. The median comes from how many traces have each number of picks.
    """
    keys = ["model", "threshold"]
    quiet = noise.select("trace_name").distinct()
    swept = threshold_sweep(picks, thresholds).join(quiet, "trace_name", "left_semi")
    per = swept.groupBy(*keys, "trace_name").agg(F.count_if(F.col("phase") == "P").alias("p"), F.count_if(F.col("phase") == "S").alias("s"))
    size = quiet.groupBy().agg(F.count("*").alias("n_noise"))
    grid = models.select("model").crossJoin(models.sparkSession.createDataFrame([(float(t),) for t in thresholds], "threshold double")).crossJoin(F.broadcast(size))  # one row
    sums = per.groupBy(*keys).agg(F.count("*").alias("n_traces_with_pick"), F.sum("p").alias("n_p"), F.sum("s").alias("n_s"), F.max(F.col("p") + F.col("s")).alias("max_per_trace"))
    held = per.groupBy(*keys, (F.col("p") + F.col("s")).alias("n")).agg(F.count("*").alias("traces"))
    upto = F.sum("traces").over(Window.partitionBy(*keys).orderBy("n"))  # a row for each number of picks
    held = held.join(F.broadcast(grid), keys).join(sums.select(*keys, "n_traces_with_pick"), keys).withColumn("upto", upto + F.col("n_noise") - F.col("n_traces_with_pick"))
    zeros = F.max(F.col("n_noise") - F.col("n_traces_with_pick"))
    lower, upper = F.floor((F.col("n_noise") - 1) / 2.0), F.ceil((F.col("n_noise") - 1) / 2.0)
    element = lambda place: F.when(zeros > F.max(place), 0).otherwise(F.min(F.when(F.col("upto") > place, F.col("n"))))
    medians = held.groupBy(*keys).agg(((element(lower) + element(upper)) / 2.0).alias("median_per_trace"))
    counts = ["n_traces_with_pick", "n_p", "n_s", "max_per_trace"]
    out = grid.join(sums, keys, "left").join(medians, keys, "left").fillna(0, [*counts, "median_per_trace"]).withColumn("n_total", F.col("n_p") + F.col("n_s"))
    return out.select(*keys, "n_noise", "n_traces_with_pick", "n_p", "n_s", "n_total", (F.col("n_total") / F.col("n_noise")).alias("mean_per_trace"), "max_per_trace", "median_per_trace", (F.col("n_traces_with_pick") / F.col("n_noise")).alias("fp_rate"))


def noise_trace_maxima(noise: DataFrame, picks: DataFrame) -> DataFrame:
    """Per noise trace and model the largest probability of either phase, 0 without picks; one row per pick-bearing model."""
    top = lambda phase: F.coalesce(F.max(F.when(F.col("phase") == phase, F.col("peak_value"))), F.lit(0.0))
    return picks.join(noise.select("trace_name"), "trace_name", "left_semi").groupBy("model", "trace_name").agg(top("P").alias("max_p"), top("S").alias("max_s"))


def noise_audit(noise: DataFrame, picks: DataFrame, thresholds: Sequence[float]) -> DataFrame:
    """One row per noise trace and model with picks, and a column of counts for each threshold."""
    swept = threshold_sweep(picks, thresholds).join(noise.select("trace_name"), "trace_name", "left_semi")
    wide = swept.groupBy("model", "trace_name").pivot("threshold", [float(t) for t in thresholds]).count().fillna(0)
    return wide.select("model", "trace_name", *(F.col(f"`{float(t)}`").alias(f"n_at_{round(t * 100):03d}") for t in thresholds))


def _detection_sums(boxes: DataFrame, targets: DataFrame, by: Sequence[str]) -> DataFrame:
    return match_boxes(boxes, targets, by).groupBy(*by).agg(F.count("*").alias("n_detected"), F.count("iou").alias("n_overlap"), F.avg(F.coalesce("iou", F.lit(0.0))).alias("det_iou_mean"), F.sum("n_boxes").alias("n_boxes"), F.avg(F.abs("start_residual_s")).alias("det_start_mae_s"), F.avg(F.abs("end_residual_s")).alias("det_end_mae_s"))


def _detection_shares() -> list[Column]:
    n = lambda c: F.coalesce(c, F.lit(0))
    share = lambda c: ratio(n(c), "n_eligible")
    return [F.col("n_eligible"), n("n_detected").alias("n_detected"), share("n_detected").alias("det_recall"), share("n_overlap").alias("det_recall_overlap"), F.col("det_iou_mean"), share("n_boxes").alias("det_per_trace_mean"), F.col("det_start_mae_s"), F.col("det_end_mae_s")]


def detection_stats(boxes: DataFrame, truth: DataFrame, models: DataFrame, factor: float = 1.4, by: Sequence[str] = ("model",)) -> DataFrame:
    """Recall (any box, overlapping or not), recall with overlap, mean IoU, boxes per trace, and errors of both ends."""
    targets = truth_boxes(truth, factor)
    eligible = targets.groupBy().agg(F.count("*").alias("n_eligible"))
    out = models.crossJoin(F.broadcast(eligible)).join(_detection_sums(boxes, targets, by), list(by), "left")  # one row
    return out.select(*by, *_detection_shares())


def trace_score(traces: DataFrame, boxes: DataFrame, by: Sequence[str] = ("model",)) -> DataFrame:
    """The largest box value of each trace and model, 0 without boxes."""
    top = boxes.groupBy(*by, "trace_name").agg(F.max("peak_value").alias("m"))
    return traces.join(top, [*by, "trace_name"], "left").select(*traces.columns, F.coalesce("m", F.lit(0.0)).alias("score"))


def raw_and_gated(picks: DataFrame, boxes: DataFrame, truth: DataFrame, tol, models: DataFrame) -> DataFrame:
    """Picking scores with and without the detector's gate, in one table with a `mode` column."""
    both = picks.withColumn("mode", F.lit("raw")).unionByName(gate(picks, boxes).withColumn("mode", F.lit("gated")))
    modes = models.select("model").crossJoin(models.sparkSession.createDataFrame([("raw",), ("gated",)], "mode string"))
    return score_picking(both, truth, tol, modes, by=("model", "mode"))


def summary(picks: DataFrame, boxes: DataFrame, truth: DataFrame, tol, models: DataFrame, failed: DataFrame | None = None, factor: float = 1.4) -> DataFrame:
    """Per model and phase: picking scores, phase identification, detection scores, n_evaluated and n_failed.

    One pass over picks and one over boxes: each meets its trace's arrivals in a join, is reduced to a row for each model
    and trace, and these to a row for each model. Of several arrivals of one phase on a trace, the first counts.
    """
    first = lambda phase: F.min(F.when(F.col("phase") == phase, F.col("true_s")))
    arrivals = truth.groupBy("trace_name").agg(*(first(p).alias(f"true_{p}") for p in PHASES), *(F.count_if(F.col("phase") == p).alias(f"n_{p}") for p in PHASES))
    targets = arrivals.filter("true_S > true_P").select("trace_name", F.col("true_P").alias("true_start_s"), (F.col("true_S") + factor * (F.col("true_S") - F.col("true_P"))).alias("true_end_s"))
    totals = arrivals.agg(F.count("*").alias("n_evaluated"), F.count_if(F.col("true_S") > F.col("true_P")).alias("n_eligible"), *(F.coalesce(F.sum(f"n_{p}"), F.lit(0)).alias(f"n_true_{p}") for p in PHASES))

    both = picks.join(arrivals, "trace_name")
    distance = {p: F.abs(F.col("offset_s") - F.col(f"true_{p}")) for p in PHASES}
    within = {p: distance[p] <= tolerance(tol, F.lit(p)) for p in PHASES}
    order = {p: F.struct(distance[p], "emit_order") for p in PHASES}
    pick = F.struct("phase", "emit_order")
    aggregates = [F.min_by(pick, F.when(within["P"], order["P"])).alias("cross_P"), F.array_sort(F.collect_list(F.when(within["S"], F.struct(distance["S"].alias("d"), F.col("emit_order").alias("e"), pick.alias("pick"))))).alias("near_S")]
    for p in PHASES:
        own = F.col("phase") == p
        aggregates += [F.count_if(own).alias(f"pred_{p}"), F.min_by(F.col("offset_s") - F.col(f"true_{p}"), F.when(own & within[p], order[p])).alias(f"residual_{p}")]
    per = both.groupBy("model", "trace_name").agg(*aggregates)
    # P has taken its pick; S takes the nearest of what is left.
    rest = F.filter(F.transform("near_S", lambda x: x["pick"]), lambda x: ~F.coalesce(x == F.col("cross_P"), F.lit(False)))
    per = per.withColumns({"as_P": F.col("cross_P.phase"), "as_S": F.get(rest, F.lit(0))["phase"]})
    sums = []
    for p in PHASES:
        sums.append(F.struct(F.lit(p).alias("phase"), F.sum(f"pred_{p}").alias("n_pred"), *(c.alias(n) for n, c in residual_aggregates(f"residual_{p}").items())))
    crossed = [F.count_if(F.col(f"as_{t}") == p).alias(f"{p}{t}".lower()) for t in PHASES for p in PHASES]
    per = per.groupBy("model").agg(F.array(*sums).alias("scores"), *crossed)
    right, wrong = F.col("pp") + F.col("ss"), F.col("ps") + F.col("sp")
    classes = (F.col("pp") + F.col("sp") > 0) & (F.col("ps") + F.col("ss") > 0) & (F.col("pp") + F.col("ps") > 0) & (F.col("sp") + F.col("ss") > 0)
    some = lambda c: F.when(right + wrong > 0, c)
    per = per.select("model", "scores", some(right + wrong).alias("n_pairs"), some(wrong).alias("n_confusions"), F.when(classes, mcc("pp", "ps", "sp", "ss")).alias("mcc_phase_id"), ratio(right, right + wrong).alias("phase_accuracy"))

    rows = models.select("model").crossJoin(F.broadcast(totals)).join(per, "model", "left").join(_detection_sums(boxes, targets, ("model",)), "model", "left")  # one row of totals
    rows = rows.withColumn("phase", F.explode(F.array(*map(F.lit, PHASES)))).withColumn("n_true", F.when(F.col("phase") == "P", F.col("n_true_P")).otherwise(F.col("n_true_S"))).filter("n_true > 0")
    x = F.get(F.filter("scores", lambda v: v["phase"] == F.col("phase")), F.lit(0))
    rows = rows.withColumn("x", x).withColumn("tp", F.coalesce("x.n_residuals", F.lit(0))).withColumn("fp", F.coalesce("x.n_pred", F.lit(0)) - F.col("tp")).withColumn("fn", F.col("n_true") - F.col("tp"))
    names = list(residual_aggregates("tp"))
    out = rows.select("model", "phase", "tp", "fp", "fn", *(c.alias(n) for n, c in prf("tp", "fp", "fn").items()), F.col("tp").alias(names[0]), *(F.col(f"x.{n}").alias(n) for n in names[1:]), "n_pairs", "n_confusions", "mcc_phase_id", "phase_accuracy", *_detection_shares(), "n_evaluated")
    if failed is None:
        return out.withColumn("n_failed", F.lit(0).cast("long"))
    return out.join(failed.groupBy("model").agg(F.count("*").alias("n_failed")), "model", "left").fillna(0, ["n_failed"])


def failure_tally(failures: DataFrame, top: int = 5) -> DataFrame:
    """The most common errors: (stage, error, n), a top-k report."""
    return failures.groupBy("stage", "error").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "stage", "error").limit(top)


def weighted_bce(label: Column, probability: Column, weight: float) -> Column:
    """Mean of −w(y log p + (1 − y) log(1 − p)) over two arrays, p kept 1e-7 away from 0 and 1."""
    each = F.zip_with(label, probability, lambda y, p: _bce(y, F.greatest(F.lit(1e-7), F.least(F.lit(1 - 1e-7), p))))
    return weight * F.aggregate(each, F.lit(0.0), lambda a, x: a + x) / F.size(label)


def _bce(y: Column, p: Column) -> Column:
    return -(y * F.log(p) + (1 - y) * F.log(1 - p))


def cross_entropy(label: Column, probability: Column, eps: float = 1e-5) -> Column:
    """Mean of −y log(p + eps) over two arrays."""
    each = F.zip_with(label, probability, lambda y, p: -y * F.log(p + eps))
    return F.aggregate(each, F.lit(0.0), lambda a, x: a + x) / F.size(label)


def t2_phase_at_arrivals(curves: DataFrame, truth: DataFrame, radius: int, min_threshold: float, by: Sequence[str] = ("model",)) -> DataFrame:
    """Which phase is stronger around each true pick: largest P and S probability within `radius` samples; P wins ties.

    curves: (by, trace_name, p, s); truth: (trace_name, phase, sample). Arrivals where both stay below the least
    threshold are skipped. Returns what `phase_identification` does.
    """
    near = curves.join(truth, "trace_name")
    lo = F.greatest(F.col("sample") - radius, F.lit(0))
    hi = F.least(F.col("sample") + radius, F.size("p") - 1)
    near = near.filter(hi >= lo)
    near = near.withColumn("top_p", F.array_max(F.slice("p", lo + 1, hi - lo + 1))).withColumn("top_s", F.array_max(F.slice("s", lo + 1, hi - lo + 1)))
    near = near.filter(F.greatest("top_p", "top_s") >= min_threshold).withColumn("predicted_phase", F.when(F.col("top_p") >= F.col("top_s"), "P").otherwise("S"))
    return phase_identification(near, by)


def picking_report(picks: DataFrame, truth: DataFrame, tol, by: Sequence[str] = ("model",)) -> DataFrame:
    """Recall, median and MAD of residuals per (by, phase) over traces with truth."""
    hits = match_picks(picks, truth, tol, by)
    stats = residual_stats(hits, [*by, "phase"]).select(*by, "phase", F.col("n").alias("n_hits"), "median_s", "mad_s")
    n = truth.groupBy("phase").agg(F.count("*").alias("n_true"))
    return stats.join(F.broadcast(n), "phase").select(*by, "phase", "n_true", "n_hits", ratio("n_hits", "n_true").alias("recall"), "median_s", "mad_s")


def coda_t1(events: DataFrame, coda: DataFrame, threshold: float, by: Sequence[str] = ("model",)) -> DataFrame:
    """Event traces against coda windows by their largest detection value: AUC, and F1 at a threshold.

    Both tables: (by, trace_name, m). Coda overlaps what detectors are trained to find, so the AUC is a hint only.
    """
    one = lambda df, y: df.select(*by, F.lit(y).alias("label"), F.coalesce(F.array_max("m"), F.lit(0.0)).alias("score"))
    both = one(events, 1).unionByName(one(coda, 0))
    hit = F.col("score") >= threshold
    n = both.groupBy(*by).agg(F.count_if(hit & (F.col("label") == 1)).alias("tp"), F.count_if(hit & (F.col("label") == 0)).alias("fp"), F.count_if(~hit & (F.col("label") == 1)).alias("fn"))
    return auc(both, by=by).join(n.select(*by, "tp", "fp", "fn", *(c.alias(k) for k, c in prf("tp", "fp", "fn").items())), list(by))
