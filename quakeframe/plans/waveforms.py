"""Queries and SQL for sample arrays: quality, windows, curves, labels and motion.

Thresholds suit vectors of 64 samples between −0.6 and 0.6; a trace's own digits place its picks.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from quakeframe.functions import arrays as A
from quakeframe.operators import curves, labels, motion, qc, scoring, signal
from quakeframe.plans import views as v
from quakeframe.plans.scoring import rounded
from quakeframe.plans.views import TRACES_SQL



def _id():
    return F.col("trace_name").cast("bigint")


def _traces(s, d):
    return v.traces(s, d)


def _picked(s, d):
    return _traces(s, d).withColumn("p_sample", F.when(_id() % 11 != 0, (_id() % 20 + 5).cast("int"))).withColumn("s_sample", F.when(_id() % 13 != 0, (_id() % 20 + 5 + _id() % 7 + 3).cast("int")))


def _curves(s, d):
    """Magnitudes as P, negated values held at 0 as S, and their smoothed sum as detection."""
    x = _traces(s, d).select("trace_name", F.lit("m0").alias("model"), F.transform("samples", lambda q: F.abs(q)).alias("p"), F.transform("samples", lambda q: F.greatest(-q, F.lit(0.0))).alias("s"))
    return x.withColumn("m", F.transform("p", lambda q: q * 2))


def _round(c, digits=6):
    return F.transform(c, lambda x: F.round(x, digits) + F.lit(0.0))


def _windows(s, d):
    return signal.window_slices(_traces(s, d), 16, 7)


def _peaks(s, d):
    """Local maxima of P and S curves as the sparse candidate list."""
    c = _curves(s, d)
    one = lambda phase, col: c.select("model", "trace_name", F.lit(phase).alias("phase"), F.explode(A.local_maxima(F.col(col), 0.1)).alias("x"))
    both = one("P", "p").union(one("S", "s"))
    return both.select("model", "trace_name", "phase", F.col("x.sample").alias("sample"), F.col("x.value").alias("prob"))


def _boxes(s, d):
    return curves.trigger(_curves(s, d), 0.4, 0.1)


def _pairs(s, d):
    return curves.pair_picks(_peaks(s, d), _boxes(s, d), min_box=2, min_gap=1)


def _refs(s, d):
    return _traces(s, d).select("trace_name", "samples")


QUERIES = {
    "w1_clipping": lambda s, d: qc.detect_clipping(_traces(s, d), 2, 0.2).select("trace_name", "n_clipped", F.size("clip_runs").alias("n_runs"), F.round("clip_fraction", 6).alias("clip_fraction")),
    "w2_dead": lambda s, d: qc.detect_dead(_traces(s, d), 0.12).select("trace_name", "is_dead"),
    "w3_gaps": lambda s, d: qc.detect_gaps(_traces(s, d), 2, 0.05).select("trace_name", "n_gap", F.size("gap_runs").alias("n_runs")),
    "w4_spikes": lambda s, d: qc.detect_spikes(_traces(s, d), 2.5, 3).select("trace_name", "n_spike", F.size("spike_runs").alias("n_runs")),
    "w5_snr": lambda s, d: rounded(_picked(s, d).select("trace_name", qc.snr(F.col("samples"), F.col("p_sample"), F.lit(2.0)).alias("x")).select("trace_name", "x.snr", "x.snr_db"), 5),
    "w6_quality_report": lambda s, d: rounded(qc.scoreboard(qc.quality_report(_picked(s, d).withColumn("sampling_rate_hz", F.lit(2.0)), "p_sample"), by=("station",)), 5),
    "w7_trigger": lambda s, d: rounded(_boxes(s, d)),
    "w8_smooth": lambda s, d: _traces(s, d).select("trace_name", _round(curves.smooth(F.col("samples"), 10)).alias("x")),
    "w9_local_maxima": lambda s, d: rounded(_peaks(s, d)),
    "w10_windows": lambda s, d: _windows(s, d).select("trace_name", "start", _round("x").alias("x")),
    "w11_standardize": lambda s, d: _windows(s, d).select("trace_name", "start", _round(signal.standardize(F.col("x"))).alias("x")),
    "w12_overlap_add": lambda s, d: signal.overlap_add(_windows(s, d), weights=signal.position_weights(16, "triangular")).select("trace_name", _round("curve").alias("curve")),
    "w13_median_stack": lambda s, d: signal.overlap_add(_windows(s, d).withColumn("x", F.transform("x", lambda q, i: q * i)), how="median").select("trace_name", _round("curve").alias("curve")),
    "w14_weights": lambda s, d: rounded(_traces(s, d).select("trace_name", *(A.total(F.zip_with("samples", signal.position_weights(64, k), lambda a, b: a * b)).alias(k) for k in ("gaussian", "triangular", "cosine")))),
    "w15_padding": lambda s, d: _traces(s, d).select("trace_name", *(_round(signal.pad_samples(F.concat("samples", F.slice("samples", 1, (_id() % 9 + 1).cast("int"))), 69, k)).alias(k) for k in ("zero", "last", "median"))),
    "w16_flat_regions": lambda s, d: _traces(s, d).select("trace_name", F.explode(signal.flat_regions(F.col("samples"), 8, 7, 1)).alias("x")).select("trace_name", "x.*"),
    "w17_reference": lambda s, d: _traces(s, d).select("trace_name", signal.reference_start(F.col("samples"), 16, 4, 6, 64, 1).alias("start")),
    "w19_stream_standardize": lambda s, d: _traces(s, d).select("trace_name", _round(signal.standardize_stream(F.transform("samples", lambda q: F.when(q > 0.25, F.lit(float("nan"))).otherwise(q)), 70)).alias("x")),
    "w21_dual_pass": lambda s, d: _curves(s, d).select("trace_name", _round(curves.dual_pass(F.col("s"), F.col("p"), curves.fill_mask(F.col("s"), F.col("p"), 0.1, 0.08, 3))).alias("x")),
    "w22_interpolate": lambda s, d: _traces(s, d).select("trace_name", _round(curves.interpolate(F.col("samples"), 41)).alias("x")),
    "w24_pairs": lambda s, d: rounded(_pairs(s, d)),
    "w25_extract": lambda s, d: rounded(curves.extract_pairs(_pairs(s, d), _refs(s, d), rate=10.0)),
    "w26_mask_curves": lambda s, d: curves.mask_curves(_curves(s, d), _boxes(s, d), margin=3).select("trace_name", _round("p").alias("p"), _round("s").alias("s"), _round("m").alias("m")),
    "w27_husid": lambda s, d: rounded(_traces(s, d).select("trace_name", motion.husid_d5_95(F.col("samples")).alias("x"), motion.arias(F.col("samples"), 0.01).alias("arias")).select("trace_name", "x.*", "arias"), 9),
    "w30_ground_motion": lambda s, d: rounded(_picked(s, d).filter("p_sample IS NOT NULL").select("trace_name", motion.ground_motion(F.col("samples"), F.col("p_sample"), F.col("p_sample") + 20, 0.1).alias("x")).select("trace_name", "x.*")),
    "w31_detrend": lambda s, d: _traces(s, d).select("trace_name", _round(signal.demean(F.col("samples"))).alias("demeaned"), _round(signal.detrend(F.col("samples"))).alias("detrended")),
    "w32_pick_near_label": lambda s, d: rounded(curves.pick_near_label(_peaks(s, d), _picked(s, d).select("trace_name", F.lit("P").alias("phase"), F.col("p_sample").alias("sample")).filter("sample IS NOT NULL"), 5)),
    "w33_w34_triggers": lambda s, d: rounded(_curves(s, d).select("trace_name", A.hysteresis(F.col("m"), 0.4, 0.1).alias("t")).select("trace_name", curves.single_trigger(F.col("t"), F.lit(5), F.lit(20)).alias("single"), curves.best_trigger(F.col("t"), 0.1).alias("best"))),
    "w35_label_windows": lambda s, d: labels.label_windows(_picked(s, d), 24, 48, sigma=3.0).select("trace_name", *(F.size(c).alias(f"n_{c}") for c in ("x", "p", "s", "d"))),
    "w36_labels": lambda s, d: _picked(s, d).select("trace_name", _round(labels.gaussian_label(64, F.col("p_sample"), 4.0)).alias("p"), _round(labels.noise_label(labels.gaussian_label(64, F.col("p_sample"), 4.0), labels.gaussian_label(64, F.col("s_sample"), 4.0))).alias("n")),
    "w37_detection_label": lambda s, d: _picked(s, d).select("trace_name", labels.detection_label(64, F.col("p_sample"), F.col("s_sample")).alias("d")),
    "w38_pick_of_label": lambda s, d: _traces(s, d).select("trace_name", labels.pick_of_label(F.col("samples"), 0.25).alias("sample")),
    "w40_validation": lambda s, d: _traces(s, d).select("trace_name", F.when(_id() % 5 != 0, F.flatten(F.array_repeat("samples", (_id() % 9).cast("int")))).alias("a"), F.flatten(F.array_repeat("samples", 4)).alias("b")).select("trace_name", signal.validation_error(("a", "b"), 128).alias("error")),
    "w41_guard": lambda s, d: curves.guard(_curves(s, d).withColumn("p", F.transform("p", lambda q: F.when(q > 0.3, F.lit(float("nan"))).otherwise(q)))).select("trace_name", _round("p").alias("p"), _round("s").alias("s"), _round("m").alias("m")),
    "w43_f6_coda": lambda s, d: labels.coda_windows(_picked(s, d), 10, 20).select("trace_name", _round("x").alias("x")),
    "j11_peaks_in_windows": lambda s, d: rounded(curves.peaks_in_windows(_peaks(s, d), _boxes(s, d), margin=2)),
    "j16_best_horizontal": lambda s, d: _traces(s, d).select("trace_name", _round(motion.best_horizontal(F.slice("samples", 1, 22), F.slice("samples", 23, 21), F.slice("samples", 44, 21))).alias("x")),
    "a18_t2": lambda s, d: rounded(scoring.t2_phase_at_arrivals(_curves(s, d), _picked(s, d).select("trace_name", F.explode(F.array(F.struct(F.lit("P").alias("phase"), F.col("p_sample").alias("sample")), F.struct(F.lit("S").alias("phase"), F.col("s_sample").alias("sample")))).alias("x")).select("trace_name", "x.*").filter("sample IS NOT NULL"), 2, 0.05)),
    "a21_scoreboard": lambda s, d: rounded(qc.scoreboard(qc.quality_report(_picked(s, d).withColumn("sampling_rate_hz", F.lit(2.0)), "p_sample")), 5),
    "a22_motion_medians": lambda s, d: rounded(motion.motion_medians(_picked(s, d).filter("p_sample IS NOT NULL").select((F.col("station") % 3).alias("pick_source"), motion.ground_motion(F.col("samples"), F.col("p_sample"), F.col("p_sample") + 20, 0.1).alias("x"), motion.husid_d5_95(F.col("samples")).alias("h")).select("pick_source", "x.pga", "x.pgv", ((F.col("h.i95") - F.col("h.i5")) * 0.1).alias("duration_s")))),
    "a27_loss": lambda s, d: rounded(_curves(s, d).select(scoring.weighted_bce(F.transform("s", lambda q: F.when(q > 0.1, 1.0).otherwise(0.0)), F.col("p"), 0.4).alias("bce"), scoring.cross_entropy(F.transform("s", lambda q: F.when(q > 0.1, 1.0).otherwise(0.0)), F.col("p")).alias("ce")).agg(F.avg("bce").alias("bce"), F.avg("ce").alias("ce"))),
    "r6_islands_long_view": lambda s, d: qc.islands(qc.explode_samples(_traces(s, d)), ["trace_name"], "i", F.col("v") > 0.05, 3),
}


def _sql(body: str, *ctes: str) -> str:
    return "WITH " + ", ".join([TRACES_SQL, *ctes]) + "\n" + body


def _islands(source: str, mask: str, most: str = "TRUE", least: int = 1) -> str:
    return f"isl AS (SELECT trace_name, min(i) AS a, max(i) AS b, count(*) AS n FROM (SELECT trace_name, i, i - row_number() OVER (PARTITION BY trace_name ORDER BY i) AS g FROM {source} WHERE {mask}) GROUP BY trace_name, g HAVING count(*) >= {least} AND {most})"


_IS = "SELECT trace_name, coalesce(sum(n), 0)::INT AS {0}, count(n)::INT AS n_runs FROM traces LEFT JOIN isl USING (trace_name) GROUP BY trace_name"
_PICKED = """
ids AS (SELECT *, trace_name::BIGINT AS id FROM traces),
picked AS (SELECT trace_name, samples, station, CASE WHEN id % 11 <> 0 THEN (id % 20 + 5)::INT END AS p_sample, CASE WHEN id % 13 <> 0 THEN (id % 20 + 5 + id % 7 + 3)::INT END AS s_sample, id FROM ids)"""
_CURVES = """
cl AS (SELECT trace_name, i, abs(v) AS p, greatest(-v, 0) AS s, abs(v) * 2 AS m FROM long)"""
_WIN = """
st AS (SELECT unnest([0, 7, 14, 21, 28, 35, 42, 48]) AS start),
win AS (SELECT trace_name, start, samples[start + 1:start + 16] AS x FROM traces, st)"""
_PEAKS = """
pk0 AS (SELECT trace_name, i, p, s, lag(p) OVER w AS pb, lead(p) OVER w AS pa, lag(s) OVER w AS sb, lead(s) OVER w AS sa FROM cl WINDOW w AS (PARTITION BY trace_name ORDER BY i)),
pk AS (SELECT 'm0' AS model, trace_name, 'P' AS phase, i::INT AS sample, p AS prob FROM pk0 WHERE p > pb AND p > pa AND p >= 0.1 UNION ALL SELECT 'm0', trace_name, 'S', i::INT, s FROM pk0 WHERE s > sb AND s > sa AND s >= 0.1)"""
_BOXES = """
run AS (SELECT trace_name, i, m, i - row_number() OVER (PARTITION BY trace_name ORDER BY i) AS g FROM cl WHERE m > 0.1),
trg AS (SELECT trace_name, min(i) FILTER (m > 0.4) AS on_sample, max(i) AS off_sample, max(m) AS peak_value FROM run GROUP BY trace_name, g HAVING max(m) > 0.4),
box AS (SELECT 'm0' AS model, trace_name, (row_number() OVER (PARTITION BY trace_name ORDER BY on_sample) - 1)::INT AS box, on_sample::INT AS on_sample, off_sample::INT AS off_sample, peak_value FROM trg)"""


def _pw(margin: int, where: str) -> str:
    return f"""
pw0 AS (SELECT b.model, b.trace_name, box, on_sample, off_sample, phase, sample, prob, row_number() OVER (PARTITION BY b.trace_name, box, phase ORDER BY prob DESC, sample) AS rn
  FROM box b JOIN pk p ON b.trace_name = p.trace_name AND sample >= on_sample - {margin} AND sample < off_sample + {margin} WHERE {where}),
pw AS (SELECT p.model, p.trace_name, p.box, p.on_sample, p.off_sample, p.sample AS p_sample, p.prob AS p_prob, s.sample AS s_sample, s.prob AS s_prob
  FROM pw0 p JOIN pw0 s ON p.trace_name = s.trace_name AND p.box = s.box AND p.phase = 'P' AND s.phase = 'S' AND p.rn = 1 AND s.rn = 1)"""


_PAIRS = """
pr0 AS (SELECT *, lag(s_sample) OVER w AS sb, (row_number() OVER w - 1)::INT AS pair_seq FROM pw WHERE s_sample - p_sample >= 1 WINDOW w AS (PARTITION BY trace_name ORDER BY p_sample, box)),
pairs AS (SELECT model, trace_name, box, on_sample, off_sample, p_sample, p_prob, s_sample, s_prob, pair_seq, (row_number() OVER (PARTITION BY trace_name ORDER BY p_sample, box) - 1)::INT AS pair_id FROM pr0 WHERE sb IS NULL OR p_sample > sb)"""
_REPORT = """
mm AS (SELECT trace_name, min(v) AS lo, max(v) AS hi, stddev_pop(v) AS sd, quantile_cont(v, 0.5) AS med FROM long GROUP BY 1),
md AS (SELECT trace_name, quantile_cont(abs(v - med), 0.5) AS mad FROM long JOIN mm USING (trace_name) GROUP BY 1),
f AS (SELECT trace_name, i, v >= hi - 0.001 * (hi - lo) OR v <= lo + 0.001 * (hi - lo) AS clip, abs(v) < 1e-15 AND i BETWEEN 6 AND 57 AS gap, mad > 0 AND abs(v - med) > 50 * mad AS spike FROM long JOIN mm USING (trace_name) JOIN md USING (trace_name)),
fr AS (SELECT trace_name, 'c' AS k, i - row_number() OVER (PARTITION BY trace_name ORDER BY i) AS g FROM f WHERE clip UNION ALL SELECT trace_name, 'g', i - row_number() OVER (PARTITION BY trace_name ORDER BY i) FROM f WHERE gap UNION ALL SELECT trace_name, 's', i - row_number() OVER (PARTITION BY trace_name ORDER BY i) FROM f WHERE spike),
fc AS (SELECT trace_name, k, count(*) AS n FROM fr GROUP BY trace_name, k, g),
rep AS (SELECT p.trace_name, station, p_sample, EXISTS (SELECT 1 FROM fc WHERE fc.trace_name = p.trace_name AND k = 'c' AND n >= 5) AS c, sd < 1e-10 OR lo = hi AS d,
  EXISTS (SELECT 1 FROM fc WHERE fc.trace_name = p.trace_name AND k = 'g' AND n >= 10) AS g, EXISTS (SELECT 1 FROM fc WHERE fc.trace_name = p.trace_name AND k = 's' AND n <= 3) AS s,
  20 * log10(sqrt(list_avg(list_transform(samples[p_sample + 1:p_sample + 10], lambda q: q * q))) / sqrt(list_avg(list_transform(samples[greatest(p_sample - 10, 0) + 1:p_sample], lambda q: q * q)))) AS db FROM picked p JOIN mm USING (trace_name)),
board AS (SELECT station, NOT (c OR d OR g OR s) AS ok, c, d, g, s, db FROM rep)"""
_BOARD = "count(*) AS n, count(*) FILTER (ok) AS n_pass, count(*) FILTER (c) AS n_clipped, count(*) FILTER (d) AS n_dead, count(*) FILTER (g) AS n_gaps, count(*) FILTER (s) AS n_spikes, round(quantile_cont(db, 0.5), 5) AS median_snr_db, round(100 * avg(ok::INT), 5) AS pass_percent FROM board"
_GM = """
seg AS (SELECT trace_name, station, i - p_sample AS k, v FROM long JOIN picked USING (trace_name) WHERE i >= p_sample AND i < p_sample + 20),
gr AS (SELECT *, count(*) OVER (PARTITION BY trace_name) AS n, lag(v) OVER w AS b, lead(v) OVER w AS c, sum(v * 0.1) OVER (PARTITION BY trace_name ORDER BY k) AS dsp FROM seg WINDOW w AS (PARTITION BY trace_name ORDER BY k)),
ac AS (SELECT *, CASE WHEN b IS NULL THEN (c - v) / 0.1 WHEN c IS NULL THEN (v - b) / 0.1 ELSE (c - b) / 0.2 END AS a FROM gr),
gm AS (SELECT trace_name, any_value(station) AS station, max(abs(a)) AS pga, max(abs(v)) AS pgv, max(abs(dsp)) AS pgd, pi() / 19.62 * 0.1 * sum(a * a) AS arias FROM ac GROUP BY 1)"""
_HUSID = """
cu AS (SELECT trace_name, i, sum(v * v) OVER (PARTITION BY trace_name ORDER BY i) AS c, sum(v * v) OVER (PARTITION BY trace_name) AS e FROM long),
hu AS (SELECT trace_name, min(i) FILTER (c >= 0.05 * e)::INT AS i5, min(i) FILTER (c >= 0.95 * e)::INT AS i95, any_value(e) AS e FROM cu GROUP BY 1)"""
_HUSID_GRADIENT = """
nb AS (SELECT trace_name, i, v, lag(v) OVER w AS b, lead(v) OVER w AS c FROM long WINDOW w AS (PARTITION BY trace_name ORDER BY i)),
gra AS (SELECT trace_name, i, CASE WHEN b IS NULL THEN (c - v) / 0.01 WHEN c IS NULL THEN (v - b) / 0.01 ELSE (c - b) / 0.02 END AS v FROM nb),""" + _HUSID.replace("FROM long", "FROM gra")
_R = "list_transform({}, lambda q: round(q, 6) + 0.0)"
_LAB = "list_transform(range(64), lambda i: CASE WHEN {0} IS NULL THEN 0.0 ELSE exp(-((i - {0}) * (i - {0})) / 32.0) END)"

ORACLE_SQL = {
    "w1_clipping": _sql("SELECT trace_name, coalesce(sum(n), 0)::INT AS n_clipped, count(n)::INT AS n_runs, round(coalesce(sum(n), 0) / 64, 6) AS clip_fraction FROM traces LEFT JOIN isl USING (trace_name) GROUP BY trace_name", "e AS (SELECT trace_name, min(v) AS lo, max(v) AS hi FROM long GROUP BY 1)", "x AS (SELECT long.*, lo, hi FROM long JOIN e USING (trace_name))", _islands("x", "v >= hi - 0.2 * (hi - lo) OR v <= lo + 0.2 * (hi - lo)", least=2)),
    "w2_dead": _sql("SELECT trace_name, stddev_pop(v) < 0.12 OR min(v) = max(v) AS is_dead FROM long GROUP BY 1"),
    "w3_gaps": _sql(_IS.format("n_gap"), _islands("long", "abs(v) < 0.05 AND i BETWEEN 6 AND 57", least=2)),
    "w4_spikes": _sql(_IS.format("n_spike"), "md AS (SELECT trace_name, quantile_cont(v, 0.5) AS med FROM long GROUP BY 1)", "mad AS (SELECT trace_name, any_value(med) AS med, quantile_cont(abs(v - med), 0.5) AS mad FROM long JOIN md USING (trace_name) GROUP BY 1)", "x AS (SELECT * FROM long JOIN mad USING (trace_name))", _islands("x", "mad > 0 AND abs(v - med) > 2.5 * mad", most="count(*) <= 3")),
    "w5_snr": _sql("""SELECT trace_name, round(b / a, 5) AS snr, round(20 * log10(b / a), 5) AS snr_db FROM (SELECT trace_name, sqrt(list_avg(list_transform(samples[greatest(p_sample - 10, 0) + 1:p_sample], lambda q: q * q))) AS a,
  sqrt(list_avg(list_transform(samples[p_sample + 1:p_sample + 10], lambda q: q * q))) AS b, p_sample FROM picked)""", _PICKED),
    "w6_quality_report": _sql(f"SELECT station, {_BOARD} GROUP BY station", _PICKED, _REPORT),
    "a21_scoreboard": _sql(f"SELECT {_BOARD}", _PICKED, _REPORT),
    "w7_trigger": _sql("SELECT model, trace_name, box, on_sample, off_sample, round(peak_value, 6) AS peak_value FROM box", _CURVES, _BOXES),
    "w8_smooth": _sql("SELECT trace_name, list(round(a, 6) + 0.0 ORDER BY i) AS x FROM (SELECT trace_name, i, avg(v) OVER (PARTITION BY trace_name ORDER BY i ROWS BETWEEN 5 PRECEDING AND 4 FOLLOWING) AS a FROM long) GROUP BY 1"),
    "w9_local_maxima": _sql("SELECT model, trace_name, phase, sample, round(prob, 6) AS prob FROM pk", _CURVES, _PEAKS),
    "w10_windows": _sql(f"SELECT trace_name, start, {_R.format('x')} AS x FROM win", _WIN),
    "w11_standardize": _sql(f"SELECT trace_name, start, list_transform(x, lambda q: round((q - list_avg(x)) / list_stddev_pop(x), 6) + 0.0) AS x FROM win", _WIN),
    "w12_overlap_add": _sql("SELECT trace_name, list(round(c, 6) + 0.0 ORDER BY i) AS curve FROM (SELECT trace_name, start + j AS i, sum(q * greatest(0.1, 1 - abs(j - 7.5) / 8)) / sum(greatest(0.1, 1 - abs(j - 7.5) / 8)) AS c FROM (SELECT trace_name, start, unnest(range(16)) AS j, unnest(x) AS q FROM win) GROUP BY 1, 2) GROUP BY 1", _WIN),
    "w13_median_stack": _sql("SELECT trace_name, list(round(c, 6) + 0.0 ORDER BY i) AS curve FROM (SELECT trace_name, start + j AS i, quantile_cont(q * j, 0.5) AS c FROM (SELECT trace_name, start, unnest(range(16)) AS j, unnest(x) AS q FROM win) GROUP BY 1, 2) GROUP BY 1", _WIN),
    "w14_weights": _sql("""SELECT trace_name, round(sum(v * g) / any_value(mg), 6) AS gaussian, round(sum(v * t) / any_value(mt), 6) AS triangular, round(sum(v * c) / any_value(mc), 6) AS cosine
FROM long JOIN w USING (i) CROSS JOIN (SELECT avg(g) AS mg, avg(t) AS mt, avg(c) AS mc FROM w) GROUP BY trace_name""", "w AS (SELECT i, exp(-((i - 31.5) * (i - 31.5)) / (2 * power(64 / 6, 2))) AS g, greatest(0.1, 1 - abs(i - 31.5) / 32) AS t, 0.5 * (1 - cos(2 * pi() * i / 63)) AS c FROM (SELECT unnest(range(64)) AS i))"),
    "w15_padding": _sql("""SELECT trace_name, list_transform(range(1, 70), lambda k: round(CASE WHEN k <= len(x) THEN x[k] ELSE 0 END, 6) + 0.0) AS zero, list_transform(range(1, 70), lambda k: round(CASE WHEN k <= len(x) THEN x[k] ELSE x[len(x)] END, 6) + 0.0) AS last,
  list_transform(range(1, 70), lambda k: round(CASE WHEN k <= len(x) THEN x[k] ELSE list_median(x) END, 6) + 0.0) AS median FROM (SELECT trace_name, list_concat(samples, samples[1:(id % 9 + 1)]) AS x FROM picked)""", _PICKED),
    "w16_flat_regions": _sql("SELECT trace_name, a::INT AS start, b::INT AS \"end\" FROM isl", "fl AS (SELECT trace_name, k FROM (SELECT trace_name, samples, unnest(range(0, 57, 4)) AS k FROM traces) WHERE len(list_distinct(list_transform(samples[k + 1:k + 8], lambda q: round(q, 1) + 0.0))) < 7)", "fx AS (SELECT DISTINCT trace_name, i FROM (SELECT trace_name, unnest(range(k, k + 8)) AS i FROM fl))", _islands("fx", "TRUE")),
    "w17_reference": _sql("SELECT trace_name, coalesce(min(k) FILTER (n > 6), 0)::INT AS start FROM (SELECT trace_name, k, len(list_distinct(list_transform(samples[k + 1:k + 16], lambda q: round(q, 1) + 0.0))) AS n FROM (SELECT trace_name, samples, unnest(range(0, 48, 4)) AS k FROM traces)) GROUP BY 1"),
    "w19_stream_standardize": _sql("SELECT trace_name, list_transform(y, lambda q: CASE WHEN q IS NULL THEN 0.0 ELSE round((q - list_avg(y)) / list_stddev_pop(y), 6) + 0.0 END) AS x FROM (SELECT trace_name, list_transform(range(1, 71), lambda k: CASE WHEN k > 64 THEN 0.0 WHEN samples[k] > 0.25 THEN NULL ELSE samples[k] END) AS y FROM traces)"),
    "w21_dual_pass": _sql("""SELECT trace_name, list(round(CASE WHEN s < 0.1 AND EXISTS (SELECT 1 FROM thin WHERE thin.trace_name = cl.trace_name AND i BETWEEN a AND b) THEN greatest(s, p) ELSE s END, 6) + 0.0 ORDER BY i) AS x FROM cl GROUP BY 1""", _CURVES, _islands("cl", "p >= 0.08", least=3), "thin AS (SELECT isl.trace_name, a, b FROM isl JOIN cl ON cl.trace_name = isl.trace_name AND i BETWEEN a AND b GROUP BY ALL HAVING count(*) FILTER (s >= 0.1) / count(*) < 0.7)"),
    "w22_interpolate": _sql("SELECT trace_name, list_transform(range(41), lambda k: round(samples[floor(k * 63 / 40)::INT + 1] * (1 - (k * 63 / 40 - floor(k * 63 / 40))) + coalesce(samples[floor(k * 63 / 40)::INT + 2], samples[64]) * (k * 63 / 40 - floor(k * 63 / 40)), 6) + 0.0) AS x FROM traces"),
    "w24_pairs": _sql("SELECT * REPLACE (round(p_prob, 6) AS p_prob, round(s_prob, 6) AS s_prob) FROM pairs", _CURVES, _PEAKS, _BOXES, _pw(100, "off_sample - on_sample >= 2"), _PAIRS),
    "w25_extract": _sql("""SELECT model, trace_name, pair_id, pair_seq, phase, sample, floor(sample / 10.0 * 1000) / 1000 AS offset_s, round(prob, 2) AS prob, round((SELECT max(abs(v)) FROM long l WHERE l.trace_name = q.trace_name AND i >= sample AND i < sample + span), 6) AS amplitude
FROM (SELECT *, 'P' AS phase, p_sample AS sample, p_prob AS prob, 10 AS span FROM pairs UNION ALL SELECT *, 'S', s_sample, s_prob, 30 FROM pairs) q""", _CURVES, _PEAKS, _BOXES, _pw(100, "off_sample - on_sample >= 2"), _PAIRS),
    "w26_mask_curves": _sql("""SELECT trace_name, list(round(CASE WHEN w THEN p ELSE 0 END, 6) + 0.0 ORDER BY i) AS p, list(round(CASE WHEN w THEN s ELSE 0 END, 6) + 0.0 ORDER BY i) AS s, list(round(CASE WHEN n THEN m ELSE 0 END, 6) + 0.0 ORDER BY i) AS m
FROM (SELECT cl.*, EXISTS (SELECT 1 FROM box b WHERE b.trace_name = cl.trace_name AND i >= on_sample - 3 AND i < off_sample + 3) AS w, EXISTS (SELECT 1 FROM box b WHERE b.trace_name = cl.trace_name AND i >= on_sample AND i < off_sample) AS n FROM cl) GROUP BY 1""", _CURVES, _BOXES),
    "w27_husid": _sql("SELECT trace_name, i5, i95, round(pi() / 19.62 * 0.01 * e, 9) AS arias FROM hu", _HUSID),
    "w30_ground_motion": _sql("SELECT trace_name, round(pga, 6) AS pga, round(pgv, 6) AS pgv, round(pgd, 6) AS pgd, round(arias, 6) AS arias FROM gm", _PICKED, _GM),
    "w31_detrend": _sql("""SELECT trace_name, list(round(v - m, 6) + 0.0 ORDER BY i) AS demeaned, list(round(v - a - b * i, 6) + 0.0 ORDER BY i) AS detrended FROM long JOIN (SELECT trace_name, avg(v) AS m, regr_intercept(v, i) AS a, regr_slope(v, i) AS b FROM long GROUP BY 1) USING (trace_name) GROUP BY 1"""),
    "w32_pick_near_label": _sql("""SELECT 'm0' AS model, trace_name, 'P' AS phase, p_sample AS label_sample, sample, round(prob, 6) AS prob FROM picked LEFT JOIN (SELECT * FROM (SELECT pk.trace_name, sample, prob, row_number() OVER (PARTITION BY pk.trace_name ORDER BY prob DESC, sample) AS rn FROM pk JOIN picked USING (trace_name) WHERE phase = 'P' AND abs(sample - p_sample) < 5) WHERE rn = 1) USING (trace_name) WHERE p_sample IS NOT NULL""", _PICKED, _CURVES, _PEAKS),
    "w33_w34_triggers": _sql("SELECT trace_name, (count(*) FILTER (on_sample > 5 AND off_sample < 20) = 1)::INT AS single, round(max(peak_value) FILTER (peak_value >= 0.1), 6) AS best FROM traces LEFT JOIN box USING (trace_name) GROUP BY 1", _CURVES, _BOXES),
    "w35_label_windows": _sql("SELECT trace_name, 24 AS n_x, 24 AS n_p, 24 AS n_s, 24 AS n_d FROM picked WHERE p_sample IS NOT NULL OR s_sample IS NOT NULL", _PICKED),
    "w36_labels": _sql(f"SELECT trace_name, {_R.format(_LAB.format('p_sample'))} AS p, list_transform(range(1, 65), lambda k: round(greatest(0, 1 - ({_LAB.format('p_sample')})[k] - ({_LAB.format('s_sample')})[k]), 6) + 0.0) AS n FROM picked", _PICKED),
    "w37_detection_label": _sql("SELECT trace_name, list_transform(range(64), lambda i: CASE WHEN i >= p_sample AND i <= s_sample + 1.4 * (s_sample - p_sample) THEN 1.0 ELSE 0.0 END) AS d FROM picked", _PICKED),
    "w38_pick_of_label": _sql("SELECT trace_name, CASE WHEN list_max(samples) >= 0.25 THEN list_position(samples, list_max(samples))::INT - 1 ELSE -1 END AS sample FROM traces"),
    "w40_validation": _sql("SELECT trace_name, CASE WHEN id % 5 = 0 THEN 'missing' WHEN id % 9 = 0 THEN 'empty' WHEN id % 9 < 2 THEN 'short' WHEN id % 9 <> 4 THEN 'unequal' END AS error FROM picked", _PICKED),
    "w41_guard": _sql("SELECT trace_name, list(round(CASE WHEN p > 0.3 THEN 0 ELSE p END, 6) + 0.0 ORDER BY i) AS p, list(round(CASE WHEN p > 0.3 THEN 0 ELSE s END, 6) + 0.0 ORDER BY i) AS s, list(round(CASE WHEN p > 0.3 THEN 0 ELSE m END, 6) + 0.0 ORDER BY i) AS m FROM cl GROUP BY 1", _CURVES),
    "w43_f6_coda": _sql(f"SELECT trace_name, {_R.format('samples[s_sample + 11:s_sample + 30]')} AS x FROM picked WHERE s_sample >= 0 AND 64 - s_sample >= 30", _PICKED),
    "j11_peaks_in_windows": _sql("SELECT * REPLACE (round(p_prob, 6) AS p_prob, round(s_prob, 6) AS s_prob) FROM pw", _CURVES, _PEAKS, _BOXES, _pw(2, "TRUE")),
    "j16_best_horizontal": _sql(f"SELECT trace_name, {_R.format('CASE WHEN list_max(list_transform(n, lambda q: abs(q))) >= list_max(list_transform(e, lambda q: abs(q))) THEN n ELSE e END')} AS x FROM (SELECT trace_name, samples[1:22] AS e, samples[23:43] AS n FROM traces)"),
    "a18_t2": _sql("""SELECT 'm0' AS model, n_pairs, n_confusions, CASE WHEN d > 0 THEN round((pp * ss - sp * ps) / d, 6) END AS mcc_phase_id, round((pp + ss) / n_pairs, 6) AS phase_accuracy FROM (SELECT *, sqrt((pp + sp) * (pp + ps) * (ss + sp) * (ss + ps)) AS d FROM (
SELECT count(*) AS n_pairs, count(*) FILTER (phase <> g) AS n_confusions, count(*) FILTER (phase = 'P' AND g = 'P')::DOUBLE AS pp, count(*) FILTER (phase = 'S' AND g = 'P')::DOUBLE AS sp, count(*) FILTER (phase = 'P' AND g = 'S')::DOUBLE AS ps, count(*) FILTER (phase = 'S' AND g = 'S')::DOUBLE AS ss FROM g))""", _PICKED, _CURVES, "tr AS (SELECT trace_name, 'P' AS phase, p_sample AS k FROM picked WHERE p_sample IS NOT NULL UNION ALL SELECT trace_name, 'S', s_sample FROM picked WHERE s_sample IS NOT NULL)", "g AS (SELECT phase, CASE WHEN max(p) >= max(s) THEN 'P' ELSE 'S' END AS g FROM tr JOIN cl ON cl.trace_name = tr.trace_name AND i BETWEEN k - 2 AND k + 2 GROUP BY tr.trace_name, phase HAVING greatest(max(p), max(s)) >= 0.05)"),
    "a22_motion_medians": _sql("SELECT station % 3 AS pick_source, count(*) AS n, round(quantile_cont(pga, 0.5), 6) AS median_pga, round(quantile_cont(pgv, 0.5), 6) AS median_pgv, round(quantile_cont((i95 - i5) * 0.1::DOUBLE, 0.5), 6) AS median_duration_s FROM gm JOIN hu USING (trace_name) GROUP BY 1", _PICKED, _GM, _HUSID),
    "a27_loss": _sql("""SELECT round(avg(b), 6) AS bce, round(avg(c), 6) AS ce FROM (SELECT trace_name, 0.4 * avg(-CASE WHEN s > 0.1 THEN ln(greatest(1e-7, least(1 - 1e-7, p))) ELSE ln(1 - greatest(1e-7, least(1 - 1e-7, p))) END) AS b, avg(CASE WHEN s > 0.1 THEN -ln(p + 1e-5) ELSE 0 END) AS c FROM cl GROUP BY 1)""", _CURVES),
    "r6_islands_long_view": _sql("SELECT trace_name, a::INT AS start, b::INT AS \"end\", n AS length FROM isl", _islands("long", "v > 0.05", least=3)),
}
