"""Queries for steps that need Arrow batches or streams; SQL only where an engine without them can say the same."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import functions as F

from quakeframe.functions import arrays as A
from quakeframe.functions import tables
from quakeframe.operators import labels, match, models, scoring, spectral
from quakeframe.plans import views as v
from quakeframe.plans.scoring import rounded
from quakeframe.plans.views import EVENTS_SQL, TRACES_SQL
from quakeframe.plans.waveforms import _CURVES, _HUSID_GRADIENT, _PICKED, _curves, _islands, _picked, _round, _traces
from quakeframe.sources.tables import arrival_times
from quakeframe.streaming import jobs


def _folder(s) -> str:
    """A new folder in the shared one that the session names; a local session without one takes its warehouse."""
    named = s.sparkContext.getCheckpointDir() or s.conf.get("spark.checkpoint.dir", None)
    if named is None and not s.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
    named = named or s.conf.get("spark.sql.warehouse.dir").removeprefix("file:") + "/streams"
    return f"{named}/stream-{uuid.uuid4().hex}"


def _three(s, d):
    x = _traces(s, d)
    return x.select("trace_name", F.col("samples").alias("e"), F.transform("samples", lambda q: q * 2).alias("n"), F.transform("samples", lambda q: -q).alias("z"))


def demo_predict(batch: np.ndarray) -> np.ndarray:
    """A stand-in predictor: squashed magnitudes of the three channels."""
    return np.tanh(np.abs(batch))


def linear_predict(batch: np.ndarray) -> np.ndarray:
    """A stand-in predictor that SQL can repeat: half of each standardised channel."""
    return batch / 2


def _annotated(s, d, predict=linear_predict):
    """Curves of one window over the whole trace: nothing is padded."""
    return spectral.annotate(_three(s, d), predict, window=64, step=16, batch_size=4, model="m0", tolerance=0)


def picky_predict(batch: np.ndarray) -> np.ndarray:
    """A stand-in predictor that gives up on windows that begin loud."""
    if (batch[:, 0, 0] > 1.5).any():
        raise ValueError("loud")
    return batch / 2


def _filtered_summary(df, column="samples"):
    """Arrays down to their size, largest magnitude and energy."""
    x = F.col(column)
    return rounded(df.select("trace_name", F.size(x).alias("n"), F.array_max(F.transform(x, lambda q: F.abs(q))).alias("top"), A.total(F.transform(x, lambda q: q * q)).alias("energy")), 5)


def _stream(s, d, name):
    df = v.table(s, d, name)
    return s.readStream.schema(df.schema).parquet(f"{d}/{name}.parquet") if _is_folder(s, f"{d}/{name}.parquet") else s.readStream.schema(df.schema).option("pathGlobFilter", f"{name}.parquet").parquet(d)


def _is_folder(s, path: str) -> bool:
    hadoop = s.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(s.sparkContext._jsc.hadoopConfiguration()).getFileStatus(hadoop).isDirectory()


def t1_stream_windows(s, d):
    """Sliding windows of 6 hours every 2 over the events of each user, as a stream; those that the watermark has closed."""
    at = _folder(s)
    packets = _stream(s, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    out = jobs.stream_windows(packets, "user_id", window="6 hours", step="2 hours", late="3 hours")
    return rounded(jobs.drain(out, f"{at}/out", f"{at}/checkpoint"), 5)


def t2_stream_gate(s, d):
    """Clicks and views inside error boxes, as a stream; a box is state until the watermark has passed its end."""
    at = _folder(s)
    e = _stream(s, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    picks = e.filter("event_type IN ('click', 'view')").select("event_id", F.col("user_id").alias("trace_name"), "ts")
    boxes = _stream(s, d, "events").withColumn("ts", F.col("ts").cast("timestamp")).filter("event_type = 'error'").select(F.col("user_id").alias("box_trace"), F.col("ts").alias("box_start"), F.expr("ts + make_dt_interval(0, 0, 0, value * 60)").alias("box_end"))
    return jobs.drain(jobs.stream_gate(picks, boxes, late="1 hour"), f"{at}/out", f"{at}/checkpoint").select("event_id", "trace_name")


def t1_stream_annotate(s, d):
    """Vectors as packets of ten stations, one after the other in time, annotated as a stream: what is closed by the last packet."""
    at = _folder(s)
    x = _stream(s, d, "embeddings").filter("vec_id IS NOT NULL AND embedding IS NOT NULL").withColumn("samples", F.col("embedding").cast("array<double>"))
    ts = F.timestamp_micros((F.col("vec_id") % 10 + 1) * F.lit(10**12) + F.floor(F.col("vec_id") / 10) * F.lit(64 * 10**6))
    packets = x.select((F.col("vec_id") % 10).cast("string").alias("trace_name"), ts.alias("ts"), F.col("samples").alias("e"), F.transform("samples", lambda q: q * 2).alias("n"), F.transform("samples", lambda q: -q).alias("z"))
    curves = jobs.drain(jobs.stream_annotate(packets, linear_predict, window=64, step=32, rate=1.0, late="0 seconds"), f"{at}/out", f"{at}/checkpoint")
    return rounded(curves.select("trace_name", F.posexplode("p").alias("k", "p"), "start").select("trace_name", (F.col("start") + F.col("k")).alias("sample"), "p"), 6)


def t3_incremental_score(s, d):
    """Counts of streamed predictions, whole for each (model, params, trace)."""
    at = _folder(s)
    e = _stream(s, d, "events").filter("event_type IN ('click', 'view')").select(F.concat(F.lit("m"), F.col("event_id") % 3).alias("model"), F.lit("h1").alias("params_hash"), F.col("user_id").cast("string").alias("trace_name"), "value")
    q = jobs.incremental_score(e, f"{at}/kept", f"{at}/checkpoint", lambda b: b.groupBy("model", "params_hash", "trace_name").agg(F.count("*").alias("n"), F.max("value").alias("top")))
    q.awaitTermination()
    return jobs.scores(s, f"{at}/kept")


def _coda(s, d):
    """Curves of event traces, and what follows S on those that have the room."""
    whole = _curves(s, d).select("model", "trace_name", "m")
    room = whole.withColumnRenamed("m", "samples").join(_picked(s, d).select("trace_name", "s_sample"), "trace_name")
    return whole, labels.coda_windows(room, 10, 20).select(F.lit("m0").alias("model"), "trace_name", F.col("x").alias("m"))


def x8_pick_curve(s, d):
    """Peaks by the SQL table function."""
    tables.register(s)
    _curves(s, d).createOrReplaceTempView("x8_curves")
    return rounded(s.sql("SELECT trace_name, k.sample, k.value FROM x8_curves, LATERAL pick_curve(p, 0.3D, 1) k"))


def x6_registered(s, d):
    """A model run by its name, with the table of models beside it."""
    models.register("demo", demo_predict, has_detection_head=False, window=64, step=16, batch_size=4)
    return models.run(_three(s, d), "demo").join(models.table(s), "model").select("model", "trace_name", "has_detection_head", F.round(F.array_max("p"), 5).alias("top"))


QUERIES = {
    "a20_coda_t1": lambda s, d: rounded(scoring.coda_t1(*_coda(s, d), 0.8)),
    "x6_registered": x6_registered,
    "x8_pick_curve": x8_pick_curve,
    "w9_peaks": lambda s, d: rounded(spectral.peaks(_curves(s, d), 0.1, 5)),
    "a29_retriggered": lambda s, d: rounded(spectral.trigger_sweep(_curves(s, d), [0.05, 0.1, 0.2])),
    "w16_fill_flat": lambda s, d: _filtered_summary(spectral.fill_flat(_traces(s, d), 8, 7, 1)),
    "w18_matching_noise": lambda s, d: _filtered_summary(spectral.pad_with_noise(_traces(s, d), 128)),
    "w18_boundary_pads": lambda s, d: _filtered_summary(spectral.boundary_pads(_traces(s, d), 30, 20)),
    "w20_refine": lambda s, d: _filtered_summary(spectral.refine(_curves(s, d), _three(s, d), linear_predict, 0.35, 0.15, window=24, lead_s=4.0, smooth_s=3.0, rate=1.0), "m"),
    "w29_coda_window": lambda s, d: rounded(spectral.coda_window(_three(s, d).withColumn("s_sample", F.lit(None).cast("int")), "arias", 100.0), 9),
    "w23_resample": lambda s, d: _filtered_summary(spectral.resample(_traces(s, d), 100.0, 50.0)),
    "w28_envelope_coda": lambda s, d: spectral.envelope_coda(_picked(s, d), rate=4.0, share=0.4),
    "w31_bandpass": lambda s, d: _filtered_summary(spectral.bandpass(_traces(s, d), 2.0, 20.0)),
    "f12_failures": lambda s, d: spectral.failures(_annotated(s, d, picky_predict)),
    "s7_arrivals": lambda s, d: arrival_times(_picked(s, d).withColumn("position", F.col("trace_name").cast("bigint")), 4.0),
    # Samples that no window with padding reaches; the padding is noise.
    "x1_annotate": lambda s, d: spectral.annotate(_three(s, d), linear_predict, window=16, step=8, model="m0", tolerance=8).select("trace_name", F.slice(_round("p"), 9, 48).alias("p")),
    "x1_short": lambda s, d: spectral.annotate(_three(s, d), linear_predict, window=80, step=8, batch_size=7).select("trace_name", _round("p").alias("p")),
    "x1_cut": lambda s, d: spectral.annotate(_three(s, d), linear_predict, window=60, step=8, tolerance=4).select("trace_name", _round("p").alias("p")),
    "x3_start_times": lambda s, d: spectral.annotate(_three(s, d).withColumn("trace_start_time", F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, 0, 0, cast(trace_name as int))")), linear_predict, window=64).select("trace_name", "trace_start_time", F.size("p").alias("n")),
    "x2_classify_picks": lambda s, d: rounded(spectral.classify(_annotated(s, d), 0.5, 0.6, 0.5, distance=1)[0]),
    "x2_classify_boxes": lambda s, d: rounded(spectral.classify(_annotated(s, d), 0.5, 0.6, 0.5, distance=5)[1]),
    "x5_dual_pass": lambda s, d: _filtered_summary(spectral.dual_pass(_three(s, d), linear_predict, window=64, step=16, least_s=0.03, tolerance=0), "p"),
    "a19_t3": lambda s, d: rounded(match.closest_match(spectral.peaks(_curves(s, d), 0.1, 1).withColumn("offset_s", F.col("sample").cast("double")), _picked(s, d).filter("p_sample IS NOT NULL").select("trace_name", F.lit("P").alias("phase"), F.col("p_sample").cast("double").alias("true_s")), 10.0)),
    "t1_stream_windows": t1_stream_windows,
    "t1_stream_annotate": t1_stream_annotate,
    "t2_stream_gate": t2_stream_gate,
    "t3_incremental_score": t3_incremental_score,
}

_Z = """
zf AS (SELECT trace_name, i, (v - avg(v) OVER w) / stddev_pop(v) OVER w / 2 AS z FROM long WINDOW w AS (PARTITION BY trace_name))"""
#: Every second sample of a sinc of half the band under a Kaiser window, zeros beyond the ends.
_HALVED = """
kernel AS (SELECT k, CASE WHEN k = 0 THEN 1 ELSE sin(pi() * k / 2) / (pi() * k / 2) END * list_sum(list_transform(range(25), lambda j: pow(2.5 * sqrt(1 - (k / 20) ** 2), 2 * j) / pow(factorial(j::INT)::DOUBLE, 2))) AS w FROM (SELECT unnest(range(-20, 21)) AS k)),
rs AS (SELECT trace_name, t AS i, sum(w * CASE WHEN 2 * t + k BETWEEN 0 AND 63 THEN samples[2 * t + k + 1] ELSE 0 END) / sum(w) AS v FROM traces, (SELECT unnest(range(32)) AS t), kernel GROUP BY 1, 2)"""


def _filtered(name: str, source: str, sections) -> str:
    """Recursive CTE `name` (trace_name, y): lists `x` of `source`, 64 long, through second-order sections one sample at a time."""
    inner = f"SELECT *, x[i + 1] AS o0 FROM {name}_r WHERE i < 64"
    for k, (b0, *_) in enumerate(sections):
        inner = f"SELECT *, {b0!r} * o{k} + s[{2 * k + 1}] AS o{k + 1} FROM ({inner})"
    state = ", ".join(f"{b1!r} * o{k} - {a1!r} * o{k + 1} + s[{2 * k + 2}], {b2!r} * o{k} - {a2!r} * o{k + 1}" for k, (_, b1, b2, a1, a2) in enumerate(sections))
    return f"""{name}_r(trace_name, x, i, y, s) AS (SELECT trace_name, x, 0, []::DOUBLE[], list_transform(range({2 * len(sections)}), lambda j: 0::DOUBLE) FROM {source}
UNION ALL SELECT trace_name, x, i + 1, list_append(y, o{len(sections)}), [{state}] FROM ({inner})),
{name} AS (SELECT trace_name, y FROM {name}_r WHERE i = 64)"""


_SECTIONS = [tuple(map(float, section)) for section in spectral.butterworth_sections(2.0, 20.0, 4, 100.0)]


def _maxima(source: str, x: str, height: float) -> str:
    """Samples above both neighbours and at least `height`, numbered on their trace."""
    around = f"SELECT trace_name, i, {x} AS x, lag({x}) OVER w AS b, lead({x}) OVER w AS c FROM {source} WINDOW w AS (PARTITION BY trace_name ORDER BY i)"
    return f"pk AS (SELECT trace_name, i, x, row_number() OVER (PARTITION BY trace_name ORDER BY i) - 1 AS r, count(*) OVER (PARTITION BY trace_name) AS n FROM ({around}) WHERE x > b AND x > c AND x >= {height})"


_SUMMED = "SELECT trace_name, count(*)::INT AS n, round(max(abs({0})), 5) AS top, round(sum({0} * {0}), 5) AS energy FROM {1} GROUP BY 1"

ORACLE_SQL = {
    "a20_coda_t1": f"""WITH {TRACES_SQL}, {_PICKED},
b AS (SELECT 1 AS y, max(abs(v) * 2) AS sc FROM long GROUP BY trace_name UNION ALL SELECT 0, list_max(list_transform(samples[s_sample + 11:s_sample + 30], lambda q: abs(q) * 2)) FROM picked WHERE s_sample >= 0 AND 64 - s_sample >= 30),
r AS (SELECT *, rank() OVER (ORDER BY sc) + (count(*) OVER (PARTITION BY sc) - 1) / 2 AS rk FROM b),
n AS (SELECT count(*) FILTER (y = 1) AS n_pos, count(*) FILTER (y = 0) AS n_neg, sum(rk) FILTER (y = 1) AS s, count(*) FILTER (y = 1 AND sc >= 0.8) AS tp, count(*) FILTER (y = 0 AND sc >= 0.8) AS fp, count(*) FILTER (y = 1 AND sc < 0.8) AS fn FROM r)
SELECT 'm0' AS model, n_pos, n_neg, round((s - n_pos * (n_pos + 1) / 2) / (n_pos::DOUBLE * n_neg), 6) AS auc, tp, fp, fn, round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall, round(2 * tp / (2 * tp + fp + fn), 6) AS f1 FROM n""",
    "f12_failures": f"""WITH {TRACES_SQL}, {_Z} SELECT 'm0' AS model, trace_name, 'classify' AS stage, 'ValueError: loud' AS error FROM zf WHERE i = 0 AND 2 * z > 1.5""",
    "s7_arrivals": f"""WITH {TRACES_SQL}, {_PICKED}
SELECT trace_name, phase, TIMESTAMP '2000-01-01' + to_microseconds(id * 1000000000 + x * 250000) AS true_time FROM (SELECT trace_name, id, 'P' AS phase, p_sample AS x FROM picked UNION ALL SELECT trace_name, id, 'S', s_sample FROM picked) WHERE x IS NOT NULL""",
    "w20_refine": f"""WITH {TRACES_SQL}, {_CURVES},
sm AS (SELECT trace_name, i, m, avg(m) OVER (PARTITION BY trace_name ORDER BY i ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS q FROM cl),
{_islands("sm", "q > 0.15")},
trg AS (SELECT isl.trace_name, min(i) AS a, b FROM isl JOIN sm ON isl.trace_name = sm.trace_name AND i BETWEEN isl.a AND b AND q > 0.35 GROUP BY isl.trace_name, isl.a, b),
win AS (SELECT trace_name, a, greatest(a - 4, 0) AS lo, least(b, greatest(a - 4, 0) + 24, 64) AS hi, list_resize(samples[greatest(a - 4, 0) + 1:greatest(a - 4, 0) + 24], 24, 0.0) AS x FROM trg JOIN traces USING (trace_name)),
new AS (SELECT trace_name, a, i, -(x[i - lo + 1] - list_avg(x)) / list_stddev_pop(x) / 2 AS y FROM (SELECT *, unnest(range(a, hi)) AS i FROM win WHERE hi > a)),
taken AS (SELECT trace_name, a FROM new JOIN cl USING (trace_name, i) GROUP BY 1, 2 HAVING avg(y) >= avg(m)),
done AS (SELECT cl.trace_name, cl.i, coalesce(r.y, cl.m) AS m FROM cl LEFT JOIN (SELECT new.* FROM new JOIN taken USING (trace_name, a)) r ON r.trace_name = cl.trace_name AND r.i = cl.i)
{_SUMMED.format("m", "done")}""",
    "w23_resample": f"WITH {TRACES_SQL}, {_HALVED} {_SUMMED.format('v', 'rs')}",
    "w29_coda_window": f"WITH {TRACES_SQL}, {_HUSID_GRADIENT} SELECT trace_name, round(i5 / 100, 9) AS start_s, round(i95 / 100, 9) AS end_s FROM hu",
    "w28_envelope_coda": f"""WITH {TRACES_SQL}, {_PICKED},
ht AS (SELECT a.trace_name, a.i, sqrt(any_value(a.v) ** 2 + sum(CASE WHEN (a.i - b.i) % 2 <> 0 THEN b.v / tan(pi() * (a.i - b.i) / 64) / 32 ELSE 0 END) ** 2) AS env FROM long a JOIN long b USING (trace_name) GROUP BY 1, 2),
sm AS (SELECT trace_name, i, sum(env) OVER (PARTITION BY trace_name ORDER BY i ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING) / 4 AS q FROM ht),
af AS (SELECT trace_name, s_sample, i, q, max(q) OVER (PARTITION BY trace_name) AS top FROM sm JOIN picked USING (trace_name) WHERE i >= s_sample)
SELECT trace_name, any_value(picked.s_sample) AS s_sample, CASE WHEN any_value(picked.s_sample) IS NOT NULL THEN coalesce(min(i) FILTER (q < 0.4 * top), 63)::INT END AS coda_end FROM picked LEFT JOIN af USING (trace_name) GROUP BY 1""",
    "w31_bandpass": f"""WITH RECURSIVE {TRACES_SQL}, dm AS (SELECT trace_name, list_transform(samples, lambda q: q - list_avg(samples)) AS x FROM traces),
{_filtered("fw", "dm", _SECTIONS)},
rv AS (SELECT trace_name, list_reverse(y) AS x FROM fw),
{_filtered("bw", "rv", _SECTIONS)},
done AS (SELECT trace_name, unnest(y) AS v FROM bw)
{_SUMMED.format("v", "done")}""",
    "a29_retriggered": f"""WITH {TRACES_SQL}, {_CURVES}, t AS (SELECT unnest([0.05, 0.1, 0.2]) AS threshold),
x AS (SELECT trace_name, threshold, i, m, i - row_number() OVER (PARTITION BY trace_name, threshold ORDER BY i) AS g FROM cl, t WHERE m > threshold)
SELECT 'm0' AS model, trace_name, threshold::DOUBLE AS threshold, (row_number() OVER (PARTITION BY trace_name, threshold ORDER BY min(i)) - 1)::INT AS box, min(i)::INT AS on_sample, max(i)::INT AS off_sample, round(max(m), 6) AS peak_value FROM x GROUP BY trace_name, threshold, g""",
    "w9_peaks": f"""WITH RECURSIVE {TRACES_SQL}, {_CURVES}, {_maxima("(SELECT trace_name || '/P' AS trace_name, i, p FROM cl UNION ALL SELECT trace_name || '/S', i, s FROM cl)", "p", 0.1)},
o AS (SELECT trace_name, list({{'i': i, 'x': x}} ORDER BY x DESC, i DESC) AS l FROM pk GROUP BY 1),
k(trace_name, l, n, kept) AS (SELECT trace_name, l, 0, []::BIGINT[] FROM o UNION ALL
  SELECT trace_name, l, n + 1, CASE WHEN len(list_filter(kept, lambda q: abs(q - l[n + 1].i) < 5)) = 0 THEN list_append(kept, l[n + 1].i) ELSE kept END FROM k WHERE n < len(l)),
f AS (SELECT split_part(trace_name, '/', 1) AS trace_name, split_part(trace_name, '/', 2) AS phase, unnest(kept) AS i FROM k WHERE n = len(l))
SELECT 'm0' AS model, trace_name, phase, (row_number() OVER (PARTITION BY trace_name ORDER BY phase, i) - 1)::INT AS emit_order, i::INT AS sample, round(CASE phase WHEN 'P' THEN p ELSE s END, 6) AS peak_value FROM f JOIN cl USING (trace_name, i)""",
    "x1_annotate": f"""WITH {TRACES_SQL},
win AS (SELECT trace_name, a, samples[a + 1:a + 16] AS x FROM traces, (SELECT unnest([0, 8, 16, 24, 32, 40, 48]) AS a)),
std AS (SELECT trace_name, a, unnest(range(16)) AS j, unnest(list_transform(x, lambda q: (q - list_avg(x)) / CASE WHEN list_stddev_pop(x) < 1e-10 THEN 1 ELSE list_stddev_pop(x) END / 2)) AS q FROM win)
SELECT trace_name, list(round(c, 6) + 0.0 ORDER BY i) AS p FROM (SELECT trace_name, a + j AS i, avg(q) AS c FROM std GROUP BY 1, 2) WHERE i BETWEEN 8 AND 55 GROUP BY 1""",
    "x1_short": f"""WITH {TRACES_SQL}, m AS (SELECT trace_name, sum(v) / 80 AS mean, sqrt(sum(v * v) / 80 - (sum(v) / 80) ** 2) AS dev FROM long GROUP BY 1)
SELECT trace_name, list(round((v - mean) / dev / 2, 6) + 0.0 ORDER BY i) AS p FROM long JOIN m USING (trace_name) GROUP BY 1""",
    "x1_cut": f"""WITH {TRACES_SQL}, m AS (SELECT trace_name, avg(v) AS mean, stddev_pop(v) AS dev FROM long WHERE i < 60 GROUP BY 1)
SELECT trace_name, list(CASE WHEN i < 60 THEN round((v - mean) / dev / 2, 6) ELSE 0 END + 0.0 ORDER BY i) AS p FROM long JOIN m USING (trace_name) GROUP BY 1""",
    "x2_classify_picks": f"""WITH {TRACES_SQL}, {_Z}, {_maxima("zf", "z", 0.5)}
SELECT 'm0' AS model, trace_name, 'P' AS phase, r::INT AS emit_order, i::INT AS sample, round(x, 6) AS peak_value, round(i / 100, 6) AS offset_s FROM pk
UNION ALL SELECT 'm0', trace_name, 'S', (n + r)::INT, i::INT, round(x, 6), round(i / 100, 6) FROM pk WHERE x >= 0.6""",
    "x8_pick_curve": f"WITH {TRACES_SQL}, {_CURVES}, {_maxima('cl', 'p', 0.3)} SELECT trace_name, i::INT AS sample, round(x, 6) AS value FROM pk",
    "a19_t3": f"""WITH {TRACES_SQL}, {_CURVES}, {_PICKED}, {_maxima("cl", "p", 0.1)}
SELECT trace_name, 'P' AS phase, r::INT AS emit_order, i::DOUBLE AS offset_s, round(x, 6) AS peak_value, p_sample::DOUBLE AS true_s, (i - p_sample)::DOUBLE AS residual_s
FROM (SELECT pk.*, p_sample, row_number() OVER (PARTITION BY trace_name ORDER BY abs(i - p_sample), r) AS k FROM pk JOIN picked USING (trace_name) WHERE abs(i - p_sample) <= 10) WHERE k = 1""",
    "x2_classify_boxes": f"""WITH {TRACES_SQL}, {_Z}, {_islands("zf", "-z > 0.5")}
SELECT 'm0' AS model, trace_name, (row_number() OVER (PARTITION BY trace_name ORDER BY a) - 1)::INT AS emit_order, round(a / 100, 6) AS start_s, round(b / 100, 6) AS end_s, round(top, 6) AS peak_value
FROM (SELECT isl.trace_name, a, b, max(-z) AS top FROM isl JOIN zf ON isl.trace_name = zf.trace_name AND i BETWEEN a AND b GROUP BY 1, 2, 3)""",
    "x3_start_times": f"WITH {TRACES_SQL} SELECT trace_name, TIMESTAMP '2024-01-01' + to_seconds(trace_name::BIGINT) AS trace_start_time, 64 AS n FROM traces",
    "x5_dual_pass": f"""WITH {TRACES_SQL}, {_Z}, {_HALVED},
m AS (SELECT trace_name, sum(v) / 64 AS mean, sqrt(sum(v * v) / 64 - (sum(v) / 64) ** 2) AS dev FROM rs GROUP BY 1),
sl AS (SELECT trace_name, list((v - mean) / dev / 2 ORDER BY i) AS s FROM rs JOIN m USING (trace_name) GROUP BY 1),
duo AS (SELECT trace_name, i, z, s[floor(i * 31 / 63)::INT + 1] * (1 - (i * 31 / 63 - floor(i * 31 / 63))) + coalesce(s[floor(i * 31 / 63)::INT + 2], 0) * (i * 31 / 63 - floor(i * 31 / 63)) AS u FROM zf JOIN sl USING (trace_name)),
{_islands("duo", "-u >= 0.25", least=3)},
thin AS (SELECT isl.trace_name, a, b FROM isl JOIN duo ON duo.trace_name = isl.trace_name AND i BETWEEN a AND b GROUP BY 1, 2, 3 HAVING count(*) FILTER (-z >= 0.3) / count(*) < 0.7),
done AS (SELECT CASE WHEN -z < 0.3 AND EXISTS (SELECT 1 FROM thin WHERE thin.trace_name = duo.trace_name AND i BETWEEN a AND b) THEN greatest(z, u) ELSE z END AS p, trace_name FROM duo)
{_SUMMED.format("p", "done")}""",
    "x6_registered": f"WITH {TRACES_SQL}, {_Z} SELECT 'demo' AS model, trace_name, FALSE AS has_detection_head, round(max(tanh(abs(2 * z))), 5) AS top FROM zf GROUP BY 2",
    "t1_stream_windows": """WITH w AS (SELECT user_id, value, unnest([0, 1, 2]) AS k, time_bucket(INTERVAL 2 HOURS, ts) AS b FROM events)
SELECT b - k * INTERVAL 2 HOURS AS start, b - k * INTERVAL 2 HOURS + INTERVAL 6 HOURS AS "end", user_id, count(*) AS n, round(avg(value), 5) AS mean, round(stddev_pop(value), 5) AS std, round(max(abs(value)), 5) AS peak FROM w
WHERE b - k * INTERVAL 2 HOURS + INTERVAL 6 HOURS <= (SELECT date_trunc('milliseconds', max(ts)) FROM events) - INTERVAL 3 HOURS GROUP BY ALL""",
    "t1_stream_annotate": """WITH pk AS (SELECT vec_id % 10 AS st, (vec_id % 10 + 1) * 1000000 + vec_id // 10 * 64 AS t0, embedding::DOUBLE[] AS x FROM embeddings),
seg AS (SELECT st, min(t0) AS lo, max(t0) + 64 AS hi FROM pk WHERE t0 < (SELECT max(t0) FROM pk) GROUP BY 1),
long AS (SELECT st, t0 + i - 1 AS k, x[i] AS v FROM (SELECT *, unnest(range(1, 65)) AS i FROM pk JOIN seg USING (st) WHERE t0 < hi)),
win AS (SELECT st, lo, hi, unnest(range(lo, hi - 63, 32)) AS a FROM seg),
std AS (SELECT st, a, k, (v - avg(v) OVER w) / stddev_pop(v) OVER w / 2 AS y FROM win JOIN long USING (st) WHERE k BETWEEN a AND a + 63 WINDOW w AS (PARTITION BY st, a))
SELECT st::VARCHAR AS trace_name, k AS sample, round(avg(y), 6) AS p FROM std JOIN seg USING (st) WHERE k < hi - CASE WHEN hi < (SELECT max(t0) FROM pk) THEN 0 ELSE 64 END GROUP BY ALL""",
    "t2_stream_gate": f"""WITH {EVENTS_SQL}
SELECT emit_order AS event_id, trace_name::BIGINT AS trace_name FROM picks p WHERE EXISTS (SELECT 1 FROM ev b WHERE event_type = 'error' AND b.trace_name = p.trace_name AND p.offset_s BETWEEN b.offset_s AND b.offset_s + value * 60)""",
    "t3_incremental_score": f"WITH {EVENTS_SQL} SELECT model, 'h1' AS params_hash, trace_name, count(*) AS n, max(value) AS top FROM ev WHERE event_type IN ('click', 'view') GROUP BY ALL",
}
