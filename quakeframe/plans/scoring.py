"""Queries and SQL for matching and scoring."""

from __future__ import annotations

from pyspark.sql import functions as F

from quakeframe.operators import match, scoring
from quakeframe.plans import views as v
from quakeframe.plans.views import EVENTS_SQL

TOL = v.TOLERANCE


def rounded(df, digits: int = 6):
    """Doubles rounded, so that the order of additions doesn't show."""
    return df.select(*(F.round(F.col(c), digits).alias(c) if kind in ("double", "float") else F.col(c) for c, kind in df.dtypes))


def _swept(s, d):
    return scoring.threshold_sweep(v.picks(s, d), v.THRESHOLDS)


def _failures(s, d):
    return v.events(s, d).filter("event_type = 'error'").select(F.col("model").alias("stage"), F.concat(F.lit("E"), (F.col("value") % 7).cast("int")).alias("error"))


def _auc_rows(s, d):
    docs = v.table(s, d, "documents").select("doc_id", "n_chars", "lang")
    return v.table(s, d, "labels").join(docs, "doc_id").select("lang", F.col("quality").alias("label"), F.col("n_chars").cast("double").alias("score"))


def flagship(s, d):
    """Predicted and true picks to a ranked table of scores: one plan over all thresholds."""
    out = scoring.score_picking(_swept(s, d), v.truth(s, d), TOL, v.grid(s, d), by=("model", "threshold"))
    return rounded(out)


QUERIES = {
    "j4_match_picks": lambda s, d: rounded(match.match_picks(v.picks(s, d), v.truth(s, d), TOL).drop("peak_value")),
    "j5_unmatched": lambda s, d: match.unmatched(v.picks(s, d), match.match_picks(v.picks(s, d), v.truth(s, d), TOL)).select("model", "trace_name", "phase", "emit_order"),
    "j6_cross_phase": lambda s, d: rounded(match.match_cross_phase(v.picks(s, d), v.truth(s, d), TOL).drop("offset_s")),
    "j7_match_detections": lambda s, d: rounded(match.match_detections(v.boxes(s, d), v.truth(s, d))),
    "j8_gate": lambda s, d: match.gate(v.picks(s, d), v.boxes(s, d), unit_s=60.0).select("model", "trace_name", "phase", "emit_order"),
    "j10_closest": lambda s, d: rounded(match.closest_match(v.picks(s, d).drop("model"), v.truth(s, d), 3600.0).drop("peak_value")),
    "j14_restrict": lambda s, d: match.restrict(v.picks(s, d), v.noise(s, d)).groupBy("trace_name").agg(F.count("*").alias("n")),
    "f7_threshold": lambda s, d: _swept(s, d).filter("threshold = 0.3").select("model", "trace_name", "phase", "emit_order"),
    "f8_with_truth": lambda s, d: match.with_truth(v.picks(s, d), v.truth(s, d)).groupBy("model", "phase").agg(F.count("*").alias("n")),
    "a1_tally": lambda s, d: scoring.tally(v.picks(s, d), v.truth(s, d), TOL, v.models(s, d)),
    "a2_a3_score_picking": lambda s, d: rounded(scoring.score_picking(v.picks(s, d), v.truth(s, d), TOL, v.models(s, d))),
    "a4_residual_stats": lambda s, d: rounded(scoring.residual_stats(match.match_picks(v.picks(s, d), v.truth(s, d), TOL), ["model", "phase"])),
    "a6_residual_report": lambda s, d: rounded(scoring.residual_report(scoring.score_picking(v.picks(s, d), v.truth(s, d), TOL, v.models(s, d))).select("model", "phase", "std_s", "mad_low_s", "mad_high_s")),
    "a8_phase_identification": lambda s, d: rounded(scoring.phase_identification(match.match_cross_phase(v.picks(s, d), v.truth(s, d), TOL))),
    "a9_auc": lambda s, d: rounded(scoring.auc(_auc_rows(s, d), by=("lang",)), 9),
    "a10_t1": lambda s, d: rounded(scoring.score_t1(v.event_traces(s, d), v.noise(s, d), v.picks(s, d), v.THRESHOLDS, v.models(s, d))),
    "a11_noise_tallies": lambda s, d: rounded(scoring.noise_tallies(v.noise(s, d), v.picks(s, d), v.THRESHOLDS, v.models(s, d))),
    "a12_detection_stats": lambda s, d: rounded(scoring.detection_stats(v.boxes(s, d), v.truth(s, d), v.models(s, d)), 5),
    "a23_picking_report": lambda s, d: rounded(scoring.picking_report(v.picks(s, d), v.truth(s, d), TOL)),
    "a26_failures": lambda s, d: scoring.failure_tally(_failures(s, d)),
    "a28_raw_and_gated": lambda s, d: rounded(scoring.raw_and_gated(v.picks(s, d), v.boxes(s, d), v.truth(s, d), TOL, v.models(s, d))),
    "a29_threshold_sweep": flagship,
    "a30_trace_score": lambda s, d: scoring.trace_score(v.event_traces(s, d).crossJoin(v.models(s, d)), v.boxes(s, d)),
    "a31_summary": lambda s, d: rounded(scoring.summary(v.picks(s, d), v.boxes(s, d), v.truth(s, d), TOL, v.models(s, d)), 5),
    "k5_noise_audit": lambda s, d: scoring.noise_audit(v.noise(s, d), v.picks(s, d), v.THRESHOLDS),
}

_M = """
m AS (SELECT * FROM (SELECT p.model, p.trace_name, phase, p.emit_order, p.offset_s, t.true_s, p.offset_s - t.true_s AS residual_s,
  row_number() OVER (PARTITION BY p.model, p.trace_name, phase ORDER BY abs(p.offset_s - t.true_s), p.emit_order) AS rn
  FROM picks p JOIN truth t USING (trace_name, phase) JOIN tol USING (phase) WHERE abs(p.offset_s - t.true_s) <= tol) WHERE rn = 1)"""
_TRUE = """
n_true AS (SELECT phase, count(*) AS n_true FROM truth GROUP BY phase)"""


def _scores(picks: str, m: str, keys: str, grid: str) -> str:
    """tp, fp, fn and statistics of `picks` and its matches `m` for all rows of `grid` and both phases."""
    on = ", ".join([*keys.split(", "), "phase"])
    return f"""
tp AS (SELECT {keys}, phase, count(*) AS tp, avg(abs(residual_s)) AS mae_s, sqrt(avg(residual_s * residual_s)) AS rmse_s, quantile_cont(residual_s, 0.5) AS median_s,
  quantile_cont(residual_s, 0.75) - quantile_cont(residual_s, 0.25) AS iqr_s FROM {m} GROUP BY ALL),
np AS (SELECT {keys}, phase, count(*) AS n_pred FROM {picks} WHERE trace_name IN (SELECT trace_name FROM truth) GROUP BY ALL),
c AS (SELECT {keys}, phase, coalesce(tp, 0) AS tp, coalesce(n_pred, 0) - coalesce(tp, 0) AS fp, n_true - coalesce(tp, 0) AS fn, mae_s, rmse_s, median_s, iqr_s
  FROM {grid} CROSS JOIN n_true LEFT JOIN tp USING ({on}) LEFT JOIN np USING ({on})),
pr AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) END AS p, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) END AS r FROM c),
scores AS (SELECT {keys}, phase, tp, fp, fn, round(p, 6) AS precision, round(r, 6) AS recall, CASE WHEN p + r > 0 THEN round(2 * p * r / (p + r), 6) END AS f1,
  tp AS n_residuals, round(mae_s, 6) AS mae_s, round(rmse_s, 6) AS rmse_s, round(median_s, 6) AS median_s, round(iqr_s, 6) AS iqr_s FROM pr)"""


_SWEPT_M = _M.replace("m AS", "sm AS", 1).replace("p.model, p.trace_name, phase", "p.model, p.threshold, p.trace_name, phase").replace("FROM picks p", "FROM swept p")
_CROSS = """
c1 AS (SELECT * FROM (SELECT p.model, p.trace_name, 'P' AS phase, p.phase AS predicted_phase, p.emit_order, p.offset_s - true_s AS residual_s,
  row_number() OVER (PARTITION BY p.model, p.trace_name ORDER BY abs(p.offset_s - true_s), p.emit_order) AS rn
  FROM picks p JOIN truth t ON p.trace_name = t.trace_name AND t.phase = 'P' WHERE abs(p.offset_s - true_s) <= 43200) WHERE rn = 1),
c2 AS (SELECT * FROM (SELECT p.model, p.trace_name, 'S' AS phase, p.phase AS predicted_phase, p.emit_order, p.offset_s - true_s AS residual_s,
  row_number() OVER (PARTITION BY p.model, p.trace_name ORDER BY abs(p.offset_s - true_s), p.emit_order) AS rn
  FROM picks p JOIN truth t ON p.trace_name = t.trace_name AND t.phase = 'S' WHERE abs(p.offset_s - true_s) <= 86400
  AND NOT EXISTS (SELECT 1 FROM c1 WHERE c1.model = p.model AND c1.trace_name = p.trace_name AND c1.emit_order = p.emit_order)) WHERE rn = 1),
cx AS (SELECT * FROM c1 UNION ALL SELECT * FROM c2),
pid AS (SELECT model, count(*) AS n_pairs, count(*) FILTER (phase <> predicted_phase) AS n_confusions,
  count(*) FILTER (phase = 'P' AND predicted_phase = 'P')::DOUBLE AS pp, count(*) FILTER (phase = 'S' AND predicted_phase = 'P')::DOUBLE AS sp,
  count(*) FILTER (phase = 'P' AND predicted_phase = 'S')::DOUBLE AS ps, count(*) FILTER (phase = 'S' AND predicted_phase = 'S')::DOUBLE AS ss FROM cx GROUP BY model),
pidm AS (SELECT model, n_pairs, n_confusions, CASE WHEN (pp + sp) * (pp + ps) * (ss + sp) * (ss + ps) > 0 THEN (pp * ss - sp * ps) / sqrt((pp + sp) * (pp + ps) * (ss + sp) * (ss + ps)) END AS mcc_phase_id,
  (pp + ss) / n_pairs AS phase_accuracy FROM pid)"""
_DET = """
tb AS (SELECT p.trace_name, p.true_s AS ts, s.true_s + 1.4 * (s.true_s - p.true_s) AS te FROM truth p JOIN truth s ON p.trace_name = s.trace_name AND p.phase = 'P' AND s.phase = 'S' WHERE s.true_s > p.true_s),
di AS (SELECT b.*, ts, te, greatest(0, least(end_s, te) - greatest(start_s, ts)) / (greatest(end_s, te) - least(start_s, ts)) AS iou FROM boxes b JOIN tb USING (trace_name)),
dm AS (SELECT *, count(*) OVER (PARTITION BY model, trace_name) AS n_boxes, row_number() OVER (PARTITION BY model, trace_name ORDER BY iou DESC, emit_order) AS rn FROM di),
dd AS (SELECT model, trace_name, n_boxes, CASE WHEN iou > 0 THEN iou END AS iou, CASE WHEN iou > 0 THEN start_s - ts END AS start_residual_s, CASE WHEN iou > 0 THEN end_s - te END AS end_residual_s FROM dm WHERE rn = 1),
ds AS (SELECT model, count(*) AS n_detected, count(iou) AS n_overlap, avg(coalesce(iou, 0)) AS det_iou_mean, sum(n_boxes)::BIGINT AS n_boxes, avg(abs(start_residual_s)) AS a, avg(abs(end_residual_s)) AS b FROM dd GROUP BY model),
det AS (SELECT model, n_eligible, coalesce(n_detected, 0) AS n_detected, coalesce(n_detected, 0) / n_eligible AS det_recall, coalesce(n_overlap, 0) / n_eligible AS det_recall_overlap, det_iou_mean,
  coalesce(n_boxes, 0) / n_eligible AS det_per_trace_mean, a AS det_start_mae_s, b AS det_end_mae_s FROM models CROSS JOIN (SELECT count(*) AS n_eligible FROM tb) LEFT JOIN ds USING (model))"""
_GATED = "gated AS (SELECT * FROM picks p WHERE EXISTS (SELECT 1 FROM boxes b WHERE b.model = p.model AND b.trace_name = p.trace_name AND p.offset_s BETWEEN start_s AND end_s))"


def _sql(body: str, *ctes: str) -> str:
    return "WITH " + ", ".join([EVENTS_SQL, *ctes]) + "\n" + body


_MODE = _M.replace("m AS", "mm AS", 1).replace("p.model, p.trace_name, phase", "p.model, p.mode, p.trace_name, phase").replace("FROM picks p", "FROM both_modes p")
_NOISE = """
g AS (SELECT model, threshold, trace_name FROM grid, noise),
nt AS (SELECT model, threshold, trace_name, count(*) FILTER (phase = 'P') AS p, count(*) FILTER (phase = 'S') AS s FROM swept GROUP BY ALL),
nn AS (SELECT model, threshold, coalesce(p, 0) AS p, coalesce(s, 0) AS s, coalesce(p, 0) + coalesce(s, 0) AS n FROM g LEFT JOIN nt USING (model, threshold, trace_name))"""
_T1 = """
hits AS (SELECT DISTINCT model, threshold, trace_name FROM swept),
t1 AS (SELECT model, threshold, (SELECT count(*) FROM event_traces) AS n_event, (SELECT count(*) FROM noise) AS n_noise,
  count(e.trace_name) AS tp, count(z.trace_name) AS fp FROM grid LEFT JOIN hits h USING (model, threshold) LEFT JOIN event_traces e ON h.trace_name = e.trace_name LEFT JOIN noise z ON h.trace_name = z.trace_name GROUP BY ALL),
t1c AS (SELECT *, n_event - tp AS fn, n_noise - fp AS tn FROM t1),
t1p AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) END AS p, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) END AS r, sqrt((tp + fp)::DOUBLE * (tp + fn) * (tn + fp) * (tn + fn)) AS d FROM t1c)"""

ORACLE_SQL = {
    "j4_match_picks": _sql("SELECT model, trace_name, phase, emit_order, round(offset_s, 6) AS offset_s, round(true_s, 6) AS true_s, round(residual_s, 6) AS residual_s FROM m", _M),
    "j5_unmatched": _sql("SELECT model, trace_name, phase, emit_order FROM picks WHERE emit_order NOT IN (SELECT emit_order FROM m)", _M),
    "j6_cross_phase": _sql("SELECT model, trace_name, phase, predicted_phase, emit_order, round(residual_s, 6) AS residual_s FROM cx", _CROSS),
    "j7_match_detections": _sql("SELECT model, trace_name, n_boxes, round(iou, 6) AS iou, round(start_residual_s, 6) AS start_residual_s, round(end_residual_s, 6) AS end_residual_s FROM dd", _DET),
    "j8_gate": _sql("SELECT model, trace_name, phase, emit_order FROM gated", _GATED),
    "j10_closest": _sql("""SELECT trace_name, phase, emit_order, round(offset_s, 6) AS offset_s, round(true_s, 6) AS true_s, round(offset_s - true_s, 6) AS residual_s FROM (
SELECT *, row_number() OVER (PARTITION BY trace_name, phase ORDER BY abs(offset_s - true_s), emit_order) AS rn FROM picks JOIN truth USING (trace_name, phase) WHERE abs(offset_s - true_s) <= 3600) WHERE rn = 1"""),
    "j14_restrict": _sql("SELECT trace_name, count(*) AS n FROM picks WHERE trace_name IN (SELECT trace_name FROM noise) GROUP BY 1"),
    "f7_threshold": _sql("SELECT model, trace_name, phase, emit_order FROM picks WHERE peak_value >= 0.3"),
    "f8_with_truth": _sql("SELECT model, phase, count(*) AS n FROM picks WHERE trace_name IN (SELECT trace_name FROM truth) GROUP BY 1, 2"),
    "a1_tally": _sql("SELECT model, phase, tp, fp, fn FROM scores", _M, _TRUE, _scores("picks", "m", "model", "models")),
    "a2_a3_score_picking": _sql("SELECT * FROM scores", _M, _TRUE, _scores("picks", "m", "model", "models")),
    "a4_residual_stats": _sql("""SELECT model, phase, count(*) AS n, round(avg(abs(residual_s)), 6) AS mae_s, round(sqrt(avg(residual_s * residual_s)), 6) AS rmse_s, round(stddev_pop(residual_s), 6) AS std_s, round(any_value(med), 6) AS median_s,
  round(quantile_cont(abs(residual_s - med), 0.5), 6) AS mad_s, round(list_sort(list(residual_s))[1 + floor(count(*) * 0.75)::INT] - list_sort(list(residual_s))[1 + floor(count(*) * 0.25)::INT], 6) AS iqr_s
FROM m JOIN (SELECT model, phase, quantile_cont(residual_s, 0.5) AS med FROM m GROUP BY 1, 2) USING (model, phase) GROUP BY 1, 2""", _M),
    "a6_residual_report": _sql("""SELECT model, phase, round(sd, 6) AS std_s, round(0.5 * iqr_s, 6) AS mad_low_s, round(0.6745 * sd, 6) AS mad_high_s
FROM (SELECT *, sqrt(greatest(0, rmse_s * rmse_s - median_s * median_s)) AS sd FROM c WHERE tp > 0)""", _M, _TRUE, _scores("picks", "m", "model", "models")),
    "a8_phase_identification": _sql("SELECT model, n_pairs, n_confusions, round(mcc_phase_id, 6) AS mcc_phase_id, round(phase_accuracy, 6) AS phase_accuracy FROM pidm", _CROSS),
    "a9_auc": """WITH x AS (SELECT lang, quality AS label, n_chars AS score FROM labels JOIN documents USING (doc_id)),
r AS (SELECT *, rank() OVER (PARTITION BY lang ORDER BY score) + (count(*) OVER (PARTITION BY lang, score) - 1) / 2 AS rk FROM x),
a AS (SELECT lang, count(*) FILTER (label = 1) AS n_pos, count(*) FILTER (label <> 1) AS n_neg, sum(rk) FILTER (label = 1) AS s FROM r GROUP BY lang)
SELECT lang, n_pos, n_neg, CASE WHEN n_pos > 0 AND n_neg > 0 THEN round((s - n_pos * (n_pos + 1) / 2) / (n_pos::DOUBLE * n_neg), 9) END AS auc FROM a""",
    "a10_t1": _sql("""SELECT model, threshold, n_event, n_noise, tp, fp, fn, tn, round(coalesce(p, 0), 6) AS precision, round(coalesce(r, 0), 6) AS recall, CASE WHEN p + r > 0 THEN round(2 * p * r / (p + r), 6) ELSE 0 END AS f1,
  CASE WHEN d > 0 THEN round((tp::DOUBLE * tn - fp::DOUBLE * fn) / d, 6) END AS mcc FROM t1p""", _T1),
    "a11_noise_tallies": _sql("""SELECT model, threshold, count(*) AS n_noise, count(*) FILTER (n > 0) AS n_traces_with_pick, sum(p)::BIGINT AS n_p, sum(s)::BIGINT AS n_s, sum(n)::BIGINT AS n_total, round(avg(n), 6) AS mean_per_trace,
  max(n) AS max_per_trace, quantile_cont(n::DOUBLE, 0.5) AS median_per_trace, round(count(*) FILTER (n > 0) / count(*), 6) AS fp_rate FROM nn GROUP BY 1, 2""", _NOISE),
    "a12_detection_stats": _sql("SELECT model, n_eligible, n_detected, round(det_recall, 5) AS det_recall, round(det_recall_overlap, 5) AS det_recall_overlap, round(det_iou_mean, 5) AS det_iou_mean, round(det_per_trace_mean, 5) AS det_per_trace_mean, round(det_start_mae_s, 5) AS det_start_mae_s, round(det_end_mae_s, 5) AS det_end_mae_s FROM det", _DET),
    "a23_picking_report": _sql("""SELECT model, phase, n_true, count(*) AS n_hits, round(count(*) / n_true, 6) AS recall, round(any_value(med), 6) AS median_s, round(quantile_cont(abs(residual_s - med), 0.5), 6) AS mad_s
FROM m JOIN (SELECT model, phase, quantile_cont(residual_s, 0.5) AS med FROM m GROUP BY 1, 2) USING (model, phase) JOIN n_true USING (phase) GROUP BY model, phase, n_true""", _M, _TRUE),
    "a26_failures": _sql("SELECT model AS stage, 'E' || trunc(value % 7)::INT AS error, count(*) AS n FROM ev WHERE event_type = 'error' GROUP BY 1, 2 ORDER BY n DESC, stage, error LIMIT 5"),
    "a28_raw_and_gated": _sql("SELECT * FROM scores", _GATED, "both_modes AS (SELECT *, 'raw' AS mode FROM picks UNION ALL SELECT *, 'gated' FROM gated)", "modes AS (SELECT model, mode FROM models, (VALUES ('raw'), ('gated')) AS t(mode))", _MODE, _TRUE, _scores("both_modes", "mm", "model, mode", "modes")),
    "a29_threshold_sweep": _sql("SELECT * FROM scores", _SWEPT_M, _TRUE, _scores("swept", "sm", "model, threshold", "grid")),
    "a30_trace_score": _sql("SELECT trace_name, model, coalesce((SELECT max(peak_value) FROM boxes b WHERE b.model = m.model AND b.trace_name = t.trace_name), 0) AS score FROM event_traces t, models m"),
    "a31_summary": _sql("""SELECT s.model, phase, tp, fp, fn, round(p, 5) AS precision, round(r, 5) AS recall, CASE WHEN p + r > 0 THEN round(2 * p * r / (p + r), 5) END AS f1, tp AS n_residuals, round(mae_s, 5) AS mae_s, round(rmse_s, 5) AS rmse_s, round(median_s, 5) AS median_s, round(iqr_s, 5) AS iqr_s,
  n_pairs, n_confusions, round(mcc_phase_id, 5) AS mcc_phase_id, round(phase_accuracy, 5) AS phase_accuracy, n_eligible, n_detected, round(det_recall, 5) AS det_recall, round(det_recall_overlap, 5) AS det_recall_overlap, round(det_iou_mean, 5) AS det_iou_mean,
  round(det_per_trace_mean, 5) AS det_per_trace_mean, round(det_start_mae_s, 5) AS det_start_mae_s, round(det_end_mae_s, 5) AS det_end_mae_s, (SELECT count(DISTINCT trace_name) FROM truth) AS n_evaluated, 0::BIGINT AS n_failed
FROM pr s LEFT JOIN pidm USING (model) LEFT JOIN det USING (model)""", _M, _TRUE, _scores("picks", "m", "model", "models"), _CROSS, _DET),
    "k5_noise_audit": _sql("SELECT model, trace_name, " + ", ".join(f"count(*) FILTER (threshold = {t}) AS n_at_{round(t * 100):03d}" for t in v.THRESHOLDS) + " FROM swept WHERE trace_name IN (SELECT trace_name FROM noise) GROUP BY 1, 2"),
}
