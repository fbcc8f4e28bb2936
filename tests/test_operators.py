"""Edge cases of the engine's operators on hand-made rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quakeframe.functions import arrays as A
from quakeframe.functions import attrs
from quakeframe.operators import build, curves, filters, labels, leaderboard, match, motion, qc, scoring, signal, spectral, splits
from quakeframe.plans import corpus
from quakeframe.sources import inventory
from quakeframe.sources import tables as io


def trace(spark, *arrays, **extra):
    return spark.createDataFrame([(f"t{i}", [float(v) for v in x], *extra.values()) for i, x in enumerate(arrays)], "trace_name string, samples array<double>" + "".join(f", {k} {'int' if isinstance(v, int) else 'double'}" for k, v in extra.items()))


def rng(seed=0):
    return np.random.default_rng(seed)


# --- quality checks ----------------------------------------------------------------------------------------------

def test_clipping(spark):
    rail = np.linspace(-1, 1, 1000)
    rail[300:500] = 1
    clean = rng().standard_normal(2000)
    rows = {r.trace_name: r for r in qc.detect_clipping(trace(spark, clean, rail, [], np.zeros(100))).collect()}
    assert not rows["t0"].is_clipped
    assert rows["t1"].is_clipped and rows["t1"].n_clipped >= 200 and any(r.start <= 300 and r.end >= 499 for r in rows["t1"].clip_runs)
    assert not rows["t2"].is_clipped and rows["t3"].clip_fraction == 1.0


def test_dead_gaps_and_spikes(spark):
    gap, edge, spike, burst = rng(1).standard_normal(2000) * 0.5, np.ones(2020), rng(2).standard_normal(2000), rng(3).standard_normal(2000)
    gap[600:900], edge[2000:] = 0, 0
    spike[1000], burst[800:1000] = 500, 50
    df = trace(spark, np.zeros(500), np.full(500, 3.14), gap, edge, spike, burst, [])
    dead = {r.trace_name: r.is_dead for r in qc.detect_dead(df).collect()}
    assert [dead[f"t{i}"] for i in range(7)] == [True, True, False, False, False, False, True]
    gaps = {r.trace_name: r for r in qc.detect_gaps(df, 50).collect()}
    assert gaps["t2"].n_gap >= 200 and gaps["t2"].gap_runs[0].start == 600 and not gaps["t3"].has_gaps
    spikes = {r.trace_name: r for r in qc.detect_spikes(df, 10, 3).collect()}
    assert [r.start for r in spikes["t4"].spike_runs] == [1000] and not spikes["t5"].has_spikes and not spikes["t0"].has_spikes


def test_snr_cases(spark):
    x = np.concatenate([rng(4).standard_normal(500), 10 * rng(5).standard_normal(500)])
    value = lambda df, p: df.select(qc.snr(F.col("samples"), F.lit(p), F.lit(100.0)).alias("x")).first().x
    got = value(trace(spark, x), 500)
    assert got.snr == pytest.approx(10, rel=0.3) and abs(got.snr_db - 20) < 2
    assert value(trace(spark, np.zeros(10)), 0) is None
    silent = value(trace(spark, [0.0] * 10 + [1.0] * 10), 10)
    assert silent.snr == float("inf") and silent.snr_db == float("inf")
    gone = value(trace(spark, [1.0] * 10 + [0.0] * 10), 10)
    assert gone.snr == 0 and gone.snr_db == float("-inf")


def test_report_passes_noise_and_fails_silence(spark):
    df = trace(spark, rng(6).standard_normal(3000), np.zeros(1000), phase_sample=500, sampling_rate_hz=100.0)
    rows = {r.trace_name: r for r in qc.quality_report(df).collect()}
    assert rows["t0"].passes and rows["t1"].is_dead and not rows["t1"].passes


def test_array_runs_agree_with_the_long_view(spark):
    df = trace(spark, rng(7).standard_normal(500), rng(8).standard_normal(1), [])
    native = df.select("trace_name", F.explode(A.runs(F.transform("samples", lambda v: v > 0.3), 2, 4)).alias("r")).select("trace_name", "r.start", "r.end")
    long = qc.islands(qc.explode_samples(df), ["trace_name"], "i", F.col("v") > 0.3, 2, 4).select("trace_name", "start", "end")
    assert sorted(map(tuple, native.collect())) == sorted(map(tuple, long.repartition(7).collect())) != []


# --- matching ----------------------------------------------------------------------------------------------------

PICKS = "model string, trace_name string, phase string, emit_order int, offset_s double, peak_value double"
BOXES = "model string, trace_name string, emit_order int, start_s double, end_s double, peak_value double"
TRUTH = "trace_name string, phase string, true_s double"


@pytest.fixture(scope="module")
def scene(spark):
    picks = [("m", "a", "P", 0, 9.5, 0.9), ("m", "a", "P", 1, 10.5, 0.8), ("m", "a", "S", 2, 20.4, 0.7), ("m", "b", "P", 0, 5.5, 0.3), ("m", "b", "S", 1, 7.0, 0.6), ("m", "c", "P", 0, 1.0, 0.9), ("m", "d", "P", 0, 3.2, 0.5)]
    truth = [("a", "P", 10.0), ("a", "S", 20.0), ("b", "P", 5.0), ("d", "P", 3.0), ("d", "S", 3.3), ("e", "P", 1.0), ("e", "S", 1.0)]
    boxes = [("m", "a", 0, 0.0, 5.0, 0.9), ("m", "a", 1, 10.0, 34.0, 0.4), ("m", "d", 0, 50.0, 60.0, 0.9), ("m", "e", 0, 0.0, 9.0, 0.5)]
    return spark.createDataFrame(picks, PICKS), spark.createDataFrame(truth, TRUTH), spark.createDataFrame(boxes, BOXES)


def test_matching_ties_tolerance_and_missing_truth(scene):
    picks, truth, _ = scene
    got = {(r.trace_name, r.phase): r for r in match.match_picks(picks, truth, 0.5).collect()}
    assert got["a", "P"].emit_order == 0 and got["a", "P"].residual_s == -0.5  # a tie, and just at the tolerance
    assert got["b", "P"].residual_s == 0.5 and ("c", "P") not in got
    left = {(r.trace_name, r.emit_order) for r in match.unmatched(picks, match.match_picks(picks, truth, 0.5)).collect()}
    assert left == {("a", 1), ("b", 1), ("c", 0)}


def test_one_pick_serves_one_truth_across_phases(scene):
    picks, truth, _ = scene
    got = {(r.trace_name, r.phase): r.predicted_phase for r in match.match_cross_phase(picks, truth, 0.5).collect()}
    assert got["d", "P"] == "P" and ("d", "S") not in got  # S would take the same pick


def test_detections(scene):
    _, truth, boxes = scene
    got = {r.trace_name: r for r in match.match_detections(boxes, truth).collect()}
    assert got["a"].n_boxes == 2 and got["a"].iou == pytest.approx(1.0)
    assert got["d"].iou is None and got["d"].n_boxes == 1  # a box without overlap still detects
    assert "e" not in got  # no duration


@pytest.mark.parametrize("unit_s", [None, 3.0, 0.01])
def test_gate(scene, unit_s):
    picks, _, boxes = scene
    assert {(r.trace_name, r.emit_order) for r in match.gate(picks, boxes, unit_s=unit_s).collect()} == {("a", 1), ("a", 2)}


def test_sweep_keeps_truth_constant(spark, scene):
    picks, truth, _ = scene
    grid = spark.createDataFrame([("m", t) for t in (0.3, 0.6, 0.95)], "model string, threshold double")
    rows = scoring.score_picking(scoring.threshold_sweep(picks, (0.3, 0.6, 0.95)), truth, 0.5, grid, by=("model", "threshold")).collect()
    for phase, n in (("P", 4), ("S", 3)):
        assert {r.tp + r.fn for r in rows if r.phase == phase} == {n}
    none = next(r for r in rows if r.threshold == 0.95 and r.phase == "P")
    assert (none.tp, none.fp, none.precision, none.recall) == (0, 0, None, 0.0)


def test_metric_policies(spark):
    from quakeframe.functions.metrics import mcc, prf, spread

    row = spark.range(1).select(*(c.alias(f"null_{k}") for k, c in prf(F.lit(0), F.lit(0), F.lit(0)).items()), *(c.alias(f"one_{k}") for k, c in prf(F.lit(0), F.lit(0), F.lit(0), "one").items()), mcc(F.lit(0), F.lit(0), F.lit(5), F.lit(5)).alias("none"), mcc(F.lit(3_000_000), F.lit(0), F.lit(0), F.lit(3_000_000)).alias("best"), spread(F.lit(5.0), F.lit(3.0)).alias("s")).first()
    assert (row.null_precision, row.null_f1, row.one_precision, row.one_recall, row.one_f1) == (None, None, 0.0, 0.0, None)
    assert (row.none, row.best, row.s) == (None, 1.0, 4.0)


def test_auc_with_ties_and_one_class(spark):
    df = spark.createDataFrame([(1, 0.5), (0, 0.5), (1, 0.9), (0, 0.1)], "label int, score double")
    assert scoring.auc(df).first().auc == 0.875
    assert scoring.auc(df.filter("label = 1")).first().auc is None
    assert scoring.auc(df.withColumn("score", F.lit(0.0))).first().auc is None


def test_two_iqrs(spark):
    df = spark.createDataFrame([("m", float(x)) for x in range(1, 6)], "model string, residual_s double")
    assert scoring.residual_stats(df, ["model"]).first().iqr_s == 2.0
    assert scoring.residual_stats(df.limit(4), ["model"], "linear").first().iqr_s == 1.5


def test_leaderboard_ranks_missing_as_zero(spark):
    board = spark.createDataFrame([("a", 0.3, 0.5, None), ("b", 0.3, 0.4, 0.4), ("c", 0.5, 1.0, 1.0), ("d", 0.3, float("nan"), 0.1)], "model string, threshold double, p_f1 double, s_f1 double")
    assert [(r.model, r["rank"]) for r in leaderboard.rank_models(board, 0.3).orderBy("rank").collect()] == [("b", 1), ("a", 2), ("d", 3)]
    assert [r.s_f1 for r in leaderboard.to_report(board).orderBy("model").collect()] == ["", "0.4000", "1.0000", "0.1000"]


# --- splits ------------------------------------------------------------------------------------------------------

def test_hash_split_golden_values_and_shares(spark):
    keys = spark.createDataFrame([("2014_0000001",), ("2014_0000010",), (None,)], "source_id string")
    got = {r.source_id: r.split for r in splits.hash_split(keys, "source_id", "ROMPLUS-singleEQ-v1").collect()}
    assert got == {"2014_0000001": "train", "2014_0000010": "test", None: None}
    many = spark.range(20000).select(F.col("id").cast("string").alias("k"))
    for algo in ("blake2s", "sha2"):
        n = {r.split: r["count"] / 20000 for r in splits.hash_split(many, "k", "s", algo=algo).groupBy("split").count().collect()}
        assert abs(n["train"] - 0.70) < 0.02 and abs(n["val"] - 0.15) < 0.02 and abs(n["test"] - 0.15) < 0.02


@pytest.mark.parametrize("p", [(0, 0.15), (1, 0), (1.5, 0), (0.7, -0.1), (0.7, 0.4)])
def test_bad_proportions(p):
    with pytest.raises(ValueError):
        splits.check_proportions(*p)


def test_draws_do_not_depend_on_partitions(spark):
    df = spark.range(500).select(F.col("id").cast("string").alias("trace_name"), F.when(F.col("id") % 3 == 0, " ").when(F.col("id") % 3 == 1, "NaN").otherwise(F.col("id").cast("string")).alias("source_id"))
    run = lambda n: sorted(map(tuple, splits.assign_split(df.repartition(n)).select("trace_name", "split").collect()))
    assert run(1) == run(7) and {s for _, s in run(1)} == {"train", "dev", "test"}
    assert sorted(r[0] for r in splits.sample_n(df.repartition(1), 20, "trace_name").select("trace_name").collect()) == sorted(r[0] for r in splits.sample_n(df.repartition(7), 20, "trace_name").select("trace_name").collect())
    with pytest.raises(ValueError):
        splits.hash_split(df, "source_id", "a|b")


# --- attributes and building -------------------------------------------------------------------------------------

def test_attributes(spark):
    df = spark.createDataFrame([("None",), (" nan ",), ("",), ("3.0",), ("3",), ("-1",), ("False",), ("1",), (None,)], "v string")
    rows = df.select(attrs.clean(F.col("v")).alias("c"), attrs.to_int(F.col("v")).alias("i"), attrs.to_double(F.col("v")).alias("d"), attrs.to_bool(F.col("v")).alias("b")).collect()
    assert [r.c for r in rows] == [None, None, None, "3.0", "3", "-1", "False", "1", None]
    assert [r.i for r in rows] == [None, None, None, None, 3, None, None, 1, None]
    assert [r.d for r in rows] == [None, None, None, 3.0, 3.0, -1.0, None, 1.0, None]
    assert [r.b for r in rows] == [None, None, None, None, None, None, False, True, None]
    ids = spark.createDataFrame([("RO.MLR..BH",), ("odd",)], "v string").select(attrs.split_station_id(F.col("v")).alias("x")).collect()
    assert [tuple(r.x) for r in ids] == [("RO", "MLR", "", "BH"), ("odd", "", "", "")]
    years = lambda v: spark.createDataFrame([(v,)], "v string").select(attrs.expand_years(F.col("v"))).first()[0]
    assert years("2014, 2018-2020,2019") == [2014, 2018, 2019, 2020]
    with pytest.raises(Exception, match="not a year"):
        years("2014,x")


def records(spark):
    rows = []
    for e in (1, 2):
        for k, code in ((1, "MLR"), (2, "BZS")):
            for i, c in enumerate("ZNE", 1):
                event = {"time": "2099-01-01T00:00:00.5Z", "latitude": str(45 + 0.1 * e), "magnitude": str(3 + 0.1 * e), "depth": "None"}
                station = {"npts": "6000", "p_arrival_sample": "1500", "s_arrival_sample": "-1", "p_arrival_in_trace": "False", "hyp_dist": str(60 * k), "status_physical": "ok"}
                rows.append((f"2099_000000{e}", f"RO.{code}..BH", c, [float(10 * k + i)] * 6000, event, station, {"sensitivity_value": "2.0", "units": "counts" if c == "Z" else "M/S"}))
    rows.append(("2099_0000003", "RO.MLR..BH", "Z", [1.0], {}, {}, {}))
    return spark.createDataFrame(rows, "event_id string, station_id string, component string, samples array<float>, event_attrs map<string,string>, station_attrs map<string,string>, channel_attrs map<string,string>")


def test_build_and_write(spark, tmp_path):
    r = records(spark)
    stations = build.read_station_table(spark.createDataFrame([("MLR", "45.5", "x", "1.2", None, None)], "station string, latitude string, longitude string, elevation string, elevation_m string, region string"))
    traces = build.build_traces(r, stations, build.response_index(r))
    rows = {x.trace_name: x for x in traces.collect()}
    assert len(rows) == 4  # the third event lacks components
    one = rows["2099_0000001_RO.MLR..BH"]
    assert (one.z[0], one.n[0], one.e[0], len(one.z), one.source_magnitude, one.source_depth_km) == (11, 12, 13, 6000, 3.1, None)
    assert (one.trace_p_arrival_sample, one.trace_s_arrival_sample, one.trace_p_in_window, one.station_elevation_m, one.station_region, one.trace_unit_physical) == (1500, None, False, 1200.0, "", "M/S")
    assert rows["2099_0000001_RO.BZS..BH"].station_elevation_m is None and one.source_origin_time.microsecond == 500000
    path = str(tmp_path / "traces")
    io.write_traces(traces, path)
    with pytest.raises(FileExistsError):
        io.write_traces(traces, path)
    io.write_traces(traces, path, overwrite=True)
    back = io.read_traces(spark, path, "ENZ", chunks=["2099"])
    assert back.count() == 4 and back.filter("trace_name = '2099_0000001_RO.MLR..BH'").first().components[0][0] == 13.0
    assert [x.trace_chunk for x in io.chunk_list(back).collect()] == ["2099"]
    with pytest.raises(FileNotFoundError):
        io.read_traces(spark, str(tmp_path / "nothing"))
    assert build.event_channels(traces, "2099_0000001").count() == 6
    with pytest.raises(ValueError):
        build.in_order(traces, "ZNN")


def test_physical_units(spark):
    base = ("t", "ok", 1000.0, 2000.0, 4000.0, [1000.0], [1000.0], [1000.0])
    rows = [base, ("miss", "missing_response", *base[2:]), ("zero", "ok", 0.0, *base[3:]), ("nan", "ok", float("nan"), *base[3:]), ("null", "ok", None, *base[3:])]
    df = spark.createDataFrame(rows, "trace_name string, trace_status_physical string, trace_sensitivity_z double, trace_sensitivity_n double, trace_sensitivity_e double, z array<float>, n array<float>, e array<float>")
    got = {r.trace_name: r for r in build.to_physical(df, "ENZ").collect()}
    assert (got["t"].z_physical, got["t"].n_physical, got["t"].e_physical, got["t"].physical_error) == ([1.0], [0.5], [0.25], None)
    assert [got[k].physical_error for k in ("miss", "zero", "nan", "null")] == ["missing_response", *["bad_sensitivity"] * 3] and got["zero"].z_physical is None
    with pytest.raises(Exception, match="bad_sensitivity"):
        build.to_physical(df.filter("trace_name = 'zero'"), strict=True).collect()


def test_sources(spark, tmp_path):
    (tmp_path / "meta.csv").write_text("a,b,c\n1.5,True,x\nbad,0,y\n")
    rows = io.read_metadata_csv(spark, str(tmp_path / "meta.csv"), {"a": "double", "b": "bool", "c": "string"}).collect()
    assert [tuple(r) for r in rows] == [(1.5, True, "x"), (None, False, "y")]
    (tmp_path / "noise.json").write_text('[{"model": "m", "thresholds": {"0.3": {"n_noise": 4, "n_p": 1, "n_s": 2, "mean_per_trace": 0.75}}}]')
    row = io.read_noise_json(spark, str(tmp_path / "noise.json")).first()
    assert (row.model, row.threshold, row.n_noise, row.n_s) == ("m", 0.3, 4, 2)
    with pytest.raises(FileNotFoundError, match="gone"):
        io.read_sweeps(spark, [str(tmp_path / "gone1.csv"), str(tmp_path / "gone2.csv")])
    pool = tmp_path / "pool"
    pool.mkdir()
    (pool / "good.bin").write_bytes(np.arange(12, dtype="<f4").tobytes())
    (pool / "bad.bin").write_bytes(b"123")
    x = np.arange(12.0).reshape(4, 3)
    for name, array in {"single": x.astype("f4"), "double": x, "columns": np.asfortranarray(x), "whole": x.astype(">i2"), "turned": x.T, "empty": x[:0]}.items():
        np.save(pool / f"{name}.npy", array)
    (pool / "short.npy").write_bytes((pool / "double.npy").read_bytes()[:-1])
    (pool / "garbled.npy").write_bytes((pool / "double.npy").read_bytes().replace(b"descr", b"descx"))
    np.save(pool / "objects.npy", np.array([[None] * 3], object), allow_pickle=True)
    got = {r.trace_name: r for r in io.read_array_pool(spark, str(pool)).collect()}
    for name in ("good", "single", "double", "columns", "whole"):
        assert (got[name].e, got[name].n, got[name].z, got[name].status) == ([0.0, 3.0, 6.0, 9.0], [1.0, 4.0, 7.0, 10.0], [2.0, 5.0, 8.0, 11.0], "ok")
    assert {n: r.status for n, r in got.items() if r.status != "ok"} == {"bad": "shape", "turned": "shape", "empty": "shape", "short": "short", "garbled": "header", "objects": "header"}
    assert all(r.e is None for r in got.values() if r.status != "ok")
    assert io.read_array_pool(spark, str(pool), columns=("z",)).filter("trace_name = 'single'").first().z == [2.0, 5.0, 8.0, 11.0]
    with pytest.raises(ValueError):
        io.test_index(spark.range(1))


def test_inventory(spark, tmp_path):
    xml = '<r><network code="RO"><station code="A"><channel code="BHZ" locationCode="" startDate="2020-01-01T00:00:00"><sensitivity>2.5</sensitivity></channel></station></network></r>'
    (tmp_path / "one.xml").write_text(xml)
    (tmp_path / "two.xml").write_text(xml.replace("BHZ", "BHN"))
    epochs = inventory.read_inventory(spark, str(tmp_path))
    assert sorted((r.network, r.station, r.location, r.channel) for r in epochs.collect()) == [("RO", "A", "", "BHN"), ("RO", "A", "", "BHZ")]
    merged = inventory.merge_stations(epochs).first()
    assert (merged.n_sources, merged.n_channels, merged.is_duplicate) == (2, 2, True)
    df = spark.createDataFrame([(1.0, None, 3.0), (1.0, 2.0, 3.0)], "freq_start double, freq_end double, freq_db double")
    assert [tuple(r) for r in inventory.all_or_none(df).collect()] == [(None, None, None), (1.0, 2.0, 3.0)]
    out = str(tmp_path / "stations")
    io.write_by_station(epochs.select("network", "station", "channel"), out)
    io.write_by_station(epochs.select("network", "station", "channel"), out)
    assert spark.read.parquet(out).count() == 2


# --- windows, noise, prediction ----------------------------------------------------------------------------------

def test_position_weights(spark):
    for kind in ("gaussian", "triangular", "cosine"):
        w = np.array(spark.range(1).select(signal.position_weights(6000, kind)).first()[0])
        assert len(w) == 6000 and w.mean() == pytest.approx(1) and abs(int(w.argmax()) - 3000) <= 1
    assert spark.range(1).select(signal.position_weights(1, "cosine")).first()[0] == [0.0]


def test_noise_is_a_function_of_its_key(spark):
    df = trace(spark, rng(1).standard_normal(1000), rng(2).standard_normal(4))
    run = lambda n, seed: {r.trace_name: r.samples for r in spectral.pad_with_noise(df.repartition(n), 6000, seed).collect()}
    one = run(1, 42)
    assert one == run(2, 42) != run(1, 43) and {len(x) for x in one.values()} == {6000}
    assert np.std(one["t0"][1000:]) == pytest.approx(np.std(one["t0"][:500]))  # its reference window
    wide = spectral.boundary_pads(df, 50, 30).filter("trace_name = 't0'").first().samples
    assert len(wide) == 1080 and wide[-1] == pytest.approx(np.median(one["t0"][:1000]))


def test_window_starts(spark):
    at = lambda n, w, s: spark.range(1).select(signal.window_starts(F.lit(n), w, s)).first()[0]
    assert at(10, 20, 5) == [0] and at(20, 20, 5) == [0] and at(31, 20, 5) == [0, 5, 10, 11] and at(30, 20, 5) == [0, 5, 10]
    for n, w, s in ((10, 20, 5), (31, 20, 5), (30, 20, 5), (101, 10, 7)):
        assert list(spectral.starts(n, w, s)) == at(n, w, s)


def test_prediction_in_one_task_equals_windows_and_stack(spark):
    df = trace(spark, rng(9).standard_normal(300)).select("trace_name", F.col("samples").alias("e"), F.col("samples").alias("n"), F.col("samples").alias("z"))
    got = spectral.annotate(df, lambda b: np.ones_like(b) * 0.25, window=50, step=20, batch_size=3).first()
    assert len(got.p) == 300 and np.allclose(got.p, 0.25) and np.allclose(got.m, 0.25)
    two = spectral.annotate(df, lambda b: b[:, :, :2] * 0, window=50, step=20).first()
    assert two.m == [1.0] * 300


def test_noise_has_the_amplitudes_of_its_reference():
    ref = np.convolve(rng(5).standard_normal(700), np.ones(9), "same")[:500] + 3
    noise = spectral.matching_noise(ref, 500, rng(42))
    assert np.array_equal(noise, spectral.matching_noise(ref, 500, rng(42)))
    assert noise.mean() == pytest.approx(ref.mean()) and noise.std() == pytest.approx(ref.std())
    got, want = np.abs(np.fft.rfft(noise))[1:], np.abs(np.fft.rfft(ref))[1:]
    assert np.allclose(got / got.sum(), want / want.sum(), rtol=1e-6)
    assert np.isfinite(spectral.matching_noise(np.array([1.0, 1.1, 0.9, 1.05]), 100, rng(7))).all()


def test_reference_is_the_first_rich_window():
    x = rng(0).standard_normal(10000)
    assert np.array_equal(spectral.noise_reference(x), x[:500])
    x[:730] = 1.0
    assert np.array_equal(spectral.noise_reference(x), x[600:1100])  # 370 of its values differ
    assert np.array_equal(spectral.noise_reference(np.ones(2000)), np.ones(500))


def test_flat_stretches_become_noise_with_short_fades(spark):
    x = rng(3).standard_normal(1000)
    x[400:600] = 2.0
    x[900:] = 2.0
    got = np.array(spectral.fill_flat(trace(spark, x)).first().samples)
    assert np.array_equal(got[:400], x[:400]) and np.array_equal(got[600:900], x[600:900])
    assert got[400] == 2.0 and got[599] == 2.0 and len(np.unique(got[400:600])) > 190 and got[999] != 2.0


def _waves(spark, *arrays):
    return trace(spark, *arrays).select("trace_name", F.col("samples").alias("e"), F.col("samples").alias("n"), F.col("samples").alias("z"))


def test_long_traces_are_padded_with_noise_and_short_ones_cut():
    seen = []

    def noise(channel, c):
        seen.append(c)
        return np.full(50, 7.0), np.full(50, 8.0)

    wide, at, front = spectral.laid_out(np.arange(300.0)[:, None].repeat(3, 1), 50, 20, 10, noise)
    assert len(wide) == 400 and front == 50 and (wide[:50] == 7).all() and (wide[-50:] == 8).all() and at[-1] == 350 and seen == [0, 1, 2]
    wide, at, front = spectral.laid_out(np.arange(58.0)[:, None], 50, 20, 10, noise)
    assert wide[:, 0].tolist() == list(range(50)) and at.tolist() == [0] and front == 0
    assert spectral.laid_out(np.ones((30, 1)), 50, 20, 10, noise)[0].sum() == 30


def test_batches_span_traces_and_errors_stay_with_theirs(spark):
    sizes = []

    def predict(batch):
        sizes.append(len(batch))
        if (np.abs(batch).max(axis=1) > 6).any():
            raise RuntimeError("spike")
        return np.ones_like(batch)

    loud = rng(2).standard_normal(60)
    loud[30] = 500.0
    rows = [(f"t{i}", rng(i).standard_normal((60, 3))) for i in range(5)] + [("bad", np.stack([loud] * 3, 1)), ("none", TypeError("no samples")), ("late", rng(9).standard_normal((60, 3)))]
    got = spectral._predicted(rows, predict, 60, 10, 4, np.ones(60), 0, 1)
    assert sizes[0] == 4 and [e for _, e in got] == [None] * 5 + ["RuntimeError: spike", "TypeError: no samples", None]
    assert got[7][0].shape == (60, 3) and (got[7][0] == 1).all() and got[5][0] is None


def test_a_failed_trace_is_counted_and_the_rest_stays(spark):
    def predict(batch):
        if (np.abs(batch).max(axis=1) > 6).any():
            raise RuntimeError("spike")
        return np.ones_like(batch) * 0.5

    loud = rng(2).standard_normal(80)
    loud[30] = 500.0
    curves = spectral.annotate(_waves(spark, rng(1).standard_normal(80), loud), predict, window=80)
    assert {r.trace_name: (r.p is None, r.error) for r in curves.collect()} == {"t0": (False, None), "t1": (True, "RuntimeError: spike")}
    picks, boxes = spectral.classify(curves, 0.3, 0.3, 0.3)
    assert {r.trace_name for r in boxes.collect()} == {"t0"} and picks.collect() == []
    truth = spark.createDataFrame([("t0", "P", 0.3)], "trace_name string, phase string, true_s double")
    models = spark.createDataFrame([("model",)], "model string")
    found = scoring.summary(picks, boxes, truth, 0.5, models, spectral.failures(curves)).first()
    assert (found.n_failed, found.n_evaluated, found.fn) == (1, 1, 1)
    assert [(r.error, r.n) for r in scoring.failure_tally(spectral.failures(curves)).collect()] == [("RuntimeError: spike", 1)]


@pytest.mark.parametrize("new,taken", [(0.9, True), (0.5, True), (0.2, False)])
def test_refinement_keeps_the_old_where_the_new_detection_is_lower(spark, new, taken):
    m = np.where((np.arange(200) >= 80) & (np.arange(200) < 120), 0.5, 0.0)
    one = trace(spark, m).select("trace_name", F.lit("m").alias("model"), *(F.col("samples").alias(c) for c in "psm"))
    got = spectral.refine(one, _waves(spark, rng(1).standard_normal(200)), lambda b: np.full(b.shape, new), 0.3, 0.3, window=100, lead_s=0.1).first()
    where = np.flatnonzero(np.array(got.p) != m)
    if not taken or new == 0.5:
        assert not len(where) or new == 0.5
    else:  # the average over ten samples passes 0.3 on 79 to 119, the last of which stays
        assert np.allclose(np.array(got.p)[where], new) and where.min() in (80, 81, 82) and where.max() in range(116, 121)
    free = spectral.refine(one, _waves(spark, rng(1).standard_normal(200)), lambda b: np.full(b.shape, 0.2), 0.3, 0.3, window=100, lead_s=0.1, keep_if_lower=False).first()
    assert 0.2 in free.m


def test_later_triggers_are_judged_on_the_given_curves(spark):
    m = np.zeros(400)
    m[100:150], m[160:200] = 0.6, 0.8
    one = trace(spark, m).select("trace_name", F.lit("m").alias("model"), *(F.col("samples").alias(c) for c in "psm"))
    got = spectral.refine(one, _waves(spark, rng(1).standard_normal(400)), lambda b: np.full(b.shape, 0.7), 0.3, 0.3, window=300, lead_s=0.5, smooth_s=0).first()
    assert set(np.round(got.m[100:149], 3)) == {0.7} and set(np.round(got.m[160:200], 3)) == {0.8}


def test_one_mask_fills_all_three_curves(spark):
    fast, slow = np.zeros(2000), np.zeros(2000)
    slow[500:1400] = 0.25
    fast[500:900] = 0.3
    want = np.zeros(2000, bool)
    want[900:1400] = True
    assert np.array_equal(spectral.fill_places(fast, slow, 0.3, 0.25, 800, 0.7), want)
    assert not spectral.fill_places(fast, slow, 0.3, 0.25, 901, 0.7).any() and not spectral.fill_places(fast, slow, 0.3, 0.25, 800, 0.4).any()
    x = trace(spark, fast).select(curves.fill_mask(F.col("samples"), F.lit(slow.tolist()), 0.3, 0.25, 800).alias("m")).first().m
    assert np.array_equal(x, want)

    def predict(batch):  # the slow pass has half as many samples in its window, the rest being zeros of the padding
        y = np.zeros(batch.shape)
        for k, x in enumerate(batch):
            quiet = (x[1000:, 0] == x[-1, 0]).all()
            y[k, 300:700] = (0.8, 0.1, 0.6) if quiet else (0.0, 0.2, 0.0)
        return y

    got = spectral.dual_pass(_waves(spark, rng(4).standard_normal(2000)), predict, window=2000).first()
    assert got.p[1000] == pytest.approx(0.8) and got.s[1000] == pytest.approx(0.1) and got.m[1000] == pytest.approx(0.6)
    assert got.s[400] == pytest.approx(0.2) and got.p[400] == 0.0


def test_coda_windows_by_both_methods(spark):
    t = np.arange(3000)
    x = np.where(t >= 500, np.exp(-(t - 500) / 200.0), 0) * np.sin(t)
    df = trace(spark, x).select("trace_name", F.transform("samples", lambda v: v / 2).alias("e"), F.col("samples").alias("n"), F.col("samples").alias("z"), F.lit(500).alias("s_sample"))
    a, b = spectral.coda_window(df, "arias").first(), spectral.coda_window(df, "envelope").first()
    assert 5 <= a.start_s < 5.5 < a.end_s < 9 and b.start_s == 5 and b.end_s == pytest.approx(spectral.coda_end(x, 500, 100.0) / 100)
    with pytest.raises(ValueError):
        spectral.coda_window(df, "other")


def test_peaks_follow_height_distance_and_plateaus():
    x = np.array([0, 1, 0, 3, 3, 3, 0, 2, 0, 2.5])
    assert spectral.find_peaks(x, 0.5, 1).tolist() == [1, 4, 7]
    assert spectral.find_peaks(x, 0.5, 4).tolist() == [4]
    assert spectral.find_peaks(x, 2.5, 1).tolist() == [4] and spectral.find_peaks(np.array([1.0, 2]), 0, 1).tolist() == []


def test_native_trigger_equals_numpy(spark):
    x = np.abs(rng(11).standard_normal(400))
    row = trace(spark, x).select(A.hysteresis(F.col("samples"), 1.2, 0.4).alias("t")).first()
    assert [(t.on_sample, t.off_sample) for t in row.t] == spectral.trigger_onsets(x, 1.2, 0.4)


def test_bandpass_keeps_its_band():
    t = np.arange(4000) / 100
    slow, mid = np.sin(2 * np.pi * 0.2 * t), np.sin(2 * np.pi * 5 * t)
    out = spectral.zero_phase((slow + mid)[None], spectral.butterworth_sections(2, 20, 4, 100))[0]
    assert np.abs(out[500:-500] - mid[500:-500]).max() < 0.02
    half = spectral.resample_array(mid, 1, 2)
    assert len(half) == 2000 and np.abs(half[50:-50] - mid[::2][50:-50]).max() < 0.02


def test_flat_regions_are_filled(spark):
    x = rng(12).standard_normal(1000)
    x[400:650] = 0
    out = np.array(spectral.fill_flat(trace(spark, x)).first().samples)
    assert np.allclose(out[:300], x[:300]) and len(np.unique(np.round(out[450:600], 4))) > 100
    found = trace(spark, x).select(signal.flat_regions(F.col("samples")).alias("r")).first().r
    assert any(r.start <= 450 and r.end >= 600 for r in found)


def test_reference_windows_and_short_traces(spark):
    x = np.concatenate([np.zeros(4850), rng(13).standard_normal(3000)])
    short = rng(14).standard_normal(40)
    got = trace(spark, x, short, np.zeros(600)).select(signal.reference_start(F.col("samples")).alias("at"), signal.flat_regions(F.col("samples")).alias("flat"), F.size(signal.lively_surroundings(F.col("samples"))).alias("n")).collect()
    assert [r["at"] for r in got] == [4700, 0, 0] and [len(r["flat"]) for r in got] == [1, 0, 1] and [r["n"] for r in got] == [300, 40, 200]
    for y in (x, short, np.zeros(600), rng(15).standard_normal(500), rng(16).standard_normal(501), np.round(rng(17).standard_normal(7000), 1)):
        at = trace(spark, y).select(signal.reference(F.col("samples")).alias("r")).first().r
        assert np.allclose(at, spectral.noise_reference(y))
    assert np.allclose(trace(spark, short).transform(spectral.fill_flat).first().samples, short)
    assert spectral.faded(8, 20, True, True).tolist() == [0, 1, 1, 1, 1, 1, 1, 0] and spectral.faded(3, 20, True, True).tolist() == [1, 1, 1]


@pytest.mark.parametrize("parts", [1, 7])
def test_ordered_draws_are_those_of_one_generator(spark, parts):
    n = 500
    want = np.random.default_rng(42).random(n)
    df = spark.range(n).select(F.format_string("t%05d", "id").alias("trace_name"), "id").orderBy(F.rand(parts)).repartition(parts)
    got = splits.row_index(df, ["trace_name"]).withColumn("u", splits.ordered_unit(42, F.col("row_index"))).collect()
    assert len(got) == n and all(r.row_index == r.id and r.u == want[r.id] for r in got)
    keyed = df.withColumn("source_id", F.when(F.col("id") % 3 == 0, F.lit("ev")).when(F.col("id") % 3 == 1, F.lit(" ")))
    rows = {r.id: r.split for r in splits.assign_split_in_order(keyed, ["trace_name"]).collect()}
    free = [i for i in range(n) if i % 3]
    assert [rows[i] for i in free] == ["train" if u < 0.7 else "dev" if u < 0.85 else "test" for u in want[: len(free)]]
    assert len({rows[i] for i in range(0, n, 3)}) == 1


def test_sc3ml(spark, tmp_path):
    (tmp_path / "one.xml").write_text("""<?xml version="1.0"?><sc:seiscomp xmlns:sc="http://example.org/x"><sc:Inventory>
<sc:sensor publicID="S/1" response="R/1"><sc:lowFrequency>0.1</sc:lowFrequency><sc:highFrequency>40</sc:highFrequency></sc:sensor>
<sc:datalogger publicID="D/1"><sc:gain>400</sc:gain></sc:datalogger><sc:responsePAZ publicID="R/1"><sc:gain>1500</sc:gain></sc:responsePAZ>
<sc:network code="RO"><sc:station code="A"><sc:sensorLocation><sc:stream code="BHZ" sensor="S/1" datalogger="D/1"><sc:start>2020-01-01T00:00:00Z</sc:start><sc:gain>2.5</sc:gain></sc:stream><sc:stream sensor="S/1" datalogger="D/1"/></sc:sensorLocation>
<sc:sensorLocation code="10"><sc:stream code="HNZ" sensor="S/9" datalogger="D/1"/></sc:sensorLocation></sc:station><sc:station code="B"/></sc:network></sc:Inventory></sc:seiscomp>""")
    (tmp_path / "two.xml").write_text('<seiscomp><Inventory><network code="XX"><station code="C"><sensorLocation><stream code="BHZ" sensor="S/1"/></sensorLocation></station></network></Inventory></seiscomp>')
    (tmp_path / "bad.xml").write_text('<seiscomp><Inventory><network code="YY"><station code="D"')
    rows = {(r.network, r.station, r.location, r.channel): r for r in inventory.read_sc3ml(spark, str(tmp_path)).collect()}
    first, second, third, other = rows["RO", "A", "", "BHZ"], rows["RO", "A", "", ""], rows["RO", "A", "10", "HNZ"], rows["XX", "C", "", "BHZ"]
    assert (first.sensitivity, first.freq_start, first.freq_end, first.dangling, first.start_date.year) == (2.5, 0.1, 40.0, [], 2020)
    assert second.sensitivity == 600_000.0 and (third.sensitivity, third.freq_end, third.dangling) == (None, None, ["S/9"])
    assert other.dangling == ["S/1"] and ("RO", "B", "", "") in rows and not [k for k in rows if k[1] == "D"]  # ids are those of their own file
    merged = {(r.network, r.channel): r.freq_end for r in inventory.merge_channels(inventory.read_sc3ml(spark, str(tmp_path)).filter("channel <> ''")).collect()}
    assert merged["RO", "BHZ"] is None


def test_filters_are_recursions_from_rest(spark):
    sections = spectral.butterworth_sections(2, 20, 4, 100)
    f = np.linspace(0.01, 49.9, 300)
    z, w = np.exp(-2j * np.pi * f / 100), np.tan(np.pi * f / 100)
    response = np.abs(np.prod([(b0 + b1 * z + b2 * z * z) / (1 + a1 * z + a2 * z * z) for b0, b1, b2, a1, a2 in sections], axis=0))
    low, high = np.tan(np.pi * 2 / 100), np.tan(np.pi * 20 / 100)
    assert np.allclose(response, 1 / np.sqrt(1 + ((w * w - low * high) / (w * (high - low))) ** 8), atol=1e-9)

    def slow(x):
        y = x - x.mean()
        for _ in range(2):
            for b0, b1, b2, a1, a2 in sections:
                s1 = s2 = 0.0
                for i, v in enumerate(y.copy()):
                    y[i] = b0 * v + s1
                    s1, s2 = b1 * v - a1 * y[i] + s2, b2 * v - a2 * y[i]
            y = y[::-1].copy()
        return y

    impulse, step, noise = np.eye(1, 200, 90)[0], np.repeat([0.0, 1.0], 65), rng(18).standard_normal(130)
    holes = [None if i in (0, 50, 51, 129) else float(v) for i, v in enumerate(noise)]
    filled = noise.copy()
    filled[[0, 129]], filled[50:52] = noise[[1, 128]], noise[49] + (noise[52] - noise[49]) * np.array([1, 2]) / 3
    df = spark.createDataFrame([("i", impulse.tolist()), ("s", step.tolist()), ("h", holes), ("n", None), ("e", [])], "trace_name string, samples array<double>")
    got = {r.trace_name: r.samples for r in spectral.bandpass(df, 2, 20).collect()}
    for name, x in (("i", impulse), ("s", step), ("h", filled)):
        assert np.allclose(got[name], slow(x.copy()))
    assert got["n"] is None and got["e"] == []
    for bad in ((0, 0), (50, 0), (20, 2)):
        with pytest.raises(ValueError):
            spectral.butterworth_sections(*bad, 4, 100)


@pytest.mark.parametrize("ratio", [(2, 1), (1, 2), (3, 2), (333, 1000), (1000, 333), (4, 2)])
def test_polyphase_is_filtering_between_zeros(ratio):
    up, down = ratio
    x = rng(19).standard_normal(61)
    got = spectral.resample_array(x, up, down)
    up, down = (2, 1) if ratio == (4, 2) else ratio
    h, wide = spectral.polyphase_taps(up, down), np.zeros(61 * up)
    wide[::up] = x
    want = np.convolve(wide, h)[len(h) // 2 :][: len(wide)][::down]
    n = round(61 * up / down)
    assert len(got) == n and np.allclose(got[: len(want)], want[:n]) and np.allclose(got[len(want) :], want[-1])


def test_triggering_anew_at_every_threshold(spark):
    x = np.abs(np.convolve(rng(20).standard_normal(400), np.ones(7) / 7, "same"))
    x[100:103], x[0] = np.nan, 0.9
    levels = [0.5, 0.1, 0.3, 0.3, 2.0]
    df = spark.createDataFrame([("m", "t", [None if np.isnan(v) else float(v) for v in x]), ("m", "none", None), ("m", "low", [0.1, 0.05])], "model string, trace_name string, m array<double>")
    got = sorted(tuple(r)[1:] for r in spectral.trigger_sweep(df, levels).collect())
    want = []
    for t in sorted(set(levels)):
        above = np.concatenate([[False], np.nan_to_num(x, nan=-1) > t, [False]])
        begins, ends = np.flatnonzero(above[1:] & ~above[:-1]), np.flatnonzero(above[:-1] & ~above[1:]) - 1
        want += [("t", t, k, int(a), int(b), float(x[a : b + 1].max())) for k, (a, b) in enumerate(zip(begins, ends))]
    assert got == sorted(want) and len(want) > 30


def test_index_of_intervals_and_near_arrivals_on_long_records(spark):
    year, random = 366 * 86400.0, rng(23)
    boxes = [("m", "t", 10.5, year), ("m", "t", 5.0, 5.0), ("m", "t", 1.0, 1.2), ("m", "t", 9.0, 3.0), ("m", "u", -20.0, -3.0)]
    offsets = [*random.uniform(-50, 50, 300).tolist(), *random.uniform(0, 1.1 * year, 300).tolist(), 5.0, 10.5, year]
    picks = [("m", t, "P", i, x, 0.5) for i, x in enumerate(offsets) for t in ("t", "u")]
    df = spark.createDataFrame(picks, PICKS)
    b = spark.createDataFrame(boxes, "model string, trace_name string, start_s double, end_s double")
    got = sorted(map(tuple, match.gate(df, b, unit_s=1.0).collect()))
    assert got == sorted(p for p in picks if any(p[1] == t and lo <= p[4] <= hi for _, t, lo, hi in boxes)) and len(got) > 300
    nodes = b.select(F.explode(match._nodes(F.floor("start_s").cast("bigint"), F.floor("end_s").cast("bigint")))).count()
    assert nodes < 5 * 2 * (match.FAN - 1) * match.LEVELS
    truth = spark.range(3000).select(F.lit("t").alias("trace_name"), F.lit("P").alias("phase"), (F.col("id") * 20.25).alias("true_s"))
    near = {r.emit_order: r for r in match.match_picks(df.filter("trace_name = 't'").withColumn("model", F.concat(F.lit("m"), "emit_order")), truth, {"P": 3.0}).collect()}
    want = {i: min((abs(x - 20.25 * k), k) for k in range(3000)) for i, x in enumerate(offsets)}
    assert {i: round(r.true_s / 20.25) for i, r in near.items()} == {i: k for i, (d, k) in want.items() if d <= 3.0}


def test_exported_channels_of_other_events_stay(spark, tmp_path):
    at = str(tmp_path / "channels")
    for event in ("ev1", "ev2", "ev1"):
        io.export_channels(spark.createDataFrame([(event, "A", "BHZ", [1.0])], "source_id string, station_code string, channel string, samples array<double>"), at)
    assert sorted((r.source_id, r.channel) for r in spark.read.parquet(at).collect()) == [("ev1", "BHZ"), ("ev2", "BHZ")]


def test_ranges_are_even_beside_an_outlier(spark):
    n = 20_000
    values = spark.range(n).select(F.lit("g").alias("g"), F.when(F.col("id") == 0, F.lit(1e9)).otherwise(F.rand(3)).alias("x"), F.lit(1).alias("n"))
    values = spark.createDataFrame(values.toPandas())
    largest = scoring.ranged(values, "x", ["g"]).groupBy("range").count().agg(F.max("count"), F.count("*")).first()
    assert largest[0] <= 2 * n / scoring.RANGES + 1 and largest[1] > scoring.RANGES / 2
    x = np.sort([r.x for r in values.collect()])
    got = scoring.ordered_elements(values, "x", "n", ["g"], {"a": 0.25, "b": 0.5, "c": 1.0}).first()
    assert np.allclose([got.a, got.b, got.c], np.quantile(x, [0.25, 0.5, 1.0]))


def test_motion_and_coda(spark):
    x = np.concatenate([np.zeros(100), np.ones(100), np.zeros(100)])
    row = trace(spark, x, np.zeros(50), []).select("trace_name", motion.husid_d5_95(F.col("samples")).alias("h")).collect()
    assert [None if r.h is None else tuple(r.h) for r in row] == [(104, 194), (0, 49), None]
    burst = np.concatenate([rng(1).standard_normal(200) * 0.01, rng(2).standard_normal(200), rng(3).standard_normal(600) * 0.001])
    end = spectral.coda_end(burst, 200, 100.0, smooth_s=0.1)
    assert 395 <= end <= 420
    gm = trace(spark, [0, 1, 0, -2, 0]).select(motion.ground_motion(F.col("samples"), F.lit(0), F.lit(5), 1.0).alias("g")).first().g
    assert (gm.pgv, gm.pgd) == (2.0, 1.0) and gm.pga == 2.0
    assert trace(spark, [1.0]).select(motion.ground_motion(F.col("samples"), F.lit(3), F.lit(5), 1.0).alias("g")).first().g is None


def test_label_windows(spark):
    df = trace(spark, rng(3).standard_normal(500)).withColumn("p_sample", F.lit(100)).withColumn("s_sample", F.lit(160))
    row = labels.label_windows(df, 200, 400, sigma=5.0).first()
    assert len(row.x) == 200 and max(map(abs, row.x)) == pytest.approx(1)
    p = 100 - row.start
    if 0 <= p < 200:
        assert int(np.argmax(row.p)) == p and row.d[p] == 1.0
    assert np.allclose(np.array(row.n), np.maximum(0, 1 - np.array(row.p) - np.array(row.s)))
    assert labels.label_windows(df.repartition(3), 200, 400, sigma=5.0).first() == row
    assert labels.coda_windows(df, 20, 300).first().x == df.first().samples[180:480]


def test_pairs_need_order_and_gap(spark):
    peaks = spark.createDataFrame([("m", "t", "P", 200, 0.9), ("m", "t", "S", 350, 0.8), ("m", "t", "P", 330, 0.7), ("m", "t", "S", 600, 0.6)], "model string, trace_name string, phase string, sample int, prob double")
    boxes = spark.createDataFrame([("m", "t", 0, 180, 380, 0.9), ("m", "t", 1, 400, 620, 0.5), ("m", "t", 2, 700, 720, 0.9)], "model string, trace_name string, box int, on_sample int, off_sample int, peak_value double")
    got = curves.pair_picks(peaks, boxes).collect()
    assert [(r.p_sample, r.s_sample, r.pair_id) for r in got] == [(200, 350, 0)]  # the second P isn't after the first S


def test_filters_and_noise_scores(spark):
    df = spark.createDataFrame([("a", "x", 3.0), ("a", "y", None), ("a", "z", 1.0), ("b", "q", 2.0)], "g string, k string, d double")
    assert [r.k for r in filters.nearest(df, 3, "d", "k").collect()] == ["z", "q", "x"]
    assert {r.g: r.spacing for r in filters.station_spacing(df.filter("d IS NOT NULL"), "g", "d").collect()} == {"a": 2.0, "b": 1.0}
    noise = spark.createDataFrame([("n1",), ("n2",), ("n3",)], "trace_name string")
    picks = spark.createDataFrame([("m", "n1", "P", 0, 1.0, 0.4), ("m", "n1", "S", 1, 1.0, 0.6)], PICKS)
    rows = {r.threshold: r for r in scoring.noise_tallies(noise, picks, (0.3, 0.5, 0.9), picks.select("model").distinct()).collect()}
    assert (rows[0.3].n_total, rows[0.5].n_s, rows[0.9].n_traces_with_pick, rows[0.9].mean_per_trace, rows[0.3].median_per_trace) == (2, 1, 0, 0.0, 0.0)


def test_incremental_scoring_is_whole_for_keys_in_several_batches(spark, tmp_path):
    from quakeframe.streaming import jobs

    source, at = str(tmp_path / "in"), str(tmp_path / "out")
    schema = "model string, params_hash string, trace_name string, n int"
    count = lambda b: b.groupBy("model", "params_hash", "trace_name").agg(F.sum("n").alias("n"))
    for part in ([("m", "h", "a", 1), ("m", "h", "b", 2)], [("m", "h", "a", 10), ("m", "h", "c", 3)]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(source)
        jobs.incremental_score(spark.readStream.schema(schema).parquet(source), at, str(tmp_path / "c"), count).awaitTermination()
    assert {r.trace_name: r.n for r in jobs.scores(spark, at).collect()} == {"a": 11, "b": 2, "c": 3}
    # A batch that runs again, here all of them in one, replaces what it had written.
    jobs.incremental_score(spark.readStream.schema(schema).parquet(source), at + "2", str(tmp_path / "d"), count).awaitTermination()
    jobs.incremental_score(spark.readStream.schema(schema).parquet(source), at + "2", str(tmp_path / "e"), count).awaitTermination()
    assert {r.trace_name: r.n for r in jobs.scores(spark, at + "2").collect()} == {"a": 11, "b": 2, "c": 3}


def test_runs_of_kept_batches():
    from quakeframe.streaming import jobs

    for n in range(1, 70):
        runs = jobs.runs_upto(n)
        assert runs[0][0] == 1 and runs[-1][1] == n and all(a[1] + 1 == b[0] for a, b in zip(runs, runs[1:])) and len(runs) <= n.bit_length()
        assert set(runs[:-1]) <= set(jobs.runs_upto(n - 1))  # what isn't merged stays as it was


def test_incremental_scoring_reads_the_buckets_of_its_keys_only(spark, tmp_path):
    from quakeframe.streaming import jobs

    source, at, read = str(tmp_path / "in"), str(tmp_path / "out"), []
    schema = "model string, params_hash string, trace_name string, n int"

    def count(df):
        read.append(len(df.inputFiles()))
        return df.groupBy("model", "params_hash", "trace_name").agg(F.sum("n").alias("n"))

    spark.createDataFrame([("m", "h", f"t{i}", 1) for i in range(300)], schema).coalesce(1).write.mode("append").parquet(source)
    want = {f"t{i}": 1 for i in range(300)}
    for k in range(6):
        if k:
            spark.createDataFrame([("m", "h", f"t{k % 2}", 1)], schema).coalesce(1).write.mode("append").parquet(source)
            want[f"t{k % 2}"] += 1
        jobs.incremental_score(spark.readStream.schema(schema).parquet(source), at, str(tmp_path / "c"), count, buckets=16).awaitTermination()
    assert {r.trace_name: r.n for r in jobs.scores(spark, at).collect()} == want
    rows = {p.name: sum(f.stat().st_size for f in p.rglob("*.parquet")) for p in (tmp_path / "out" / "rows").iterdir()}
    assert set(rows) >= {"1-4", "5-6"} and "1-2" not in rows  # runs that were merged are gone, but for the last batch's
    schema_ = "model string, params_hash string, trace_name string, n int"
    one = jobs.kept_rows(spark, at, jobs.runs_upto(6), schema_, [3])
    assert {r.bucket for r in one.collect()} == {3} and "PartitionFilters: [isnotnull(bucket" in one._jdf.queryExecution().toString().replace("PartitionFilters: [(", "PartitionFilters: [")


@pytest.mark.parametrize("gap", [0, 30])
def test_stream_annotation_equals_batch(spark, tmp_path, gap):
    import datetime as dt

    from quakeframe.streaming import jobs

    def squash(x):
        if (np.abs(x) > 99).any():
            raise ValueError("never")
        return np.tanh(x)

    random, base = rng(21), 1_600_000_000
    schema, packets, segments = "trace_name string, ts timestamp, e array<double>, n array<double>, z array<double>", [], []
    for station in ("a", "b"):
        for first, n in ((0, 203), (225, 17), (400, 64), (900, 150)):
            x = random.standard_normal((n, 3))
            if segments and segments[-1][0] == station and first - segments[-1][1] - len(segments[-1][2]) <= gap:
                _, begin, before = segments.pop()
                share = (np.arange(1, first - begin - len(before) + 1) / (first - begin - len(before) + 1))[:, None]
                segments.append((station, begin, np.concatenate([before, before[-1] * (1 - share) + x[0] * share, x])))
            else:
                segments.append((station, first, x))
            i = 0
            while i < n:
                k = int(random.integers(5, 60))
                packets.append((station, first + i, x[i : i + k]))
                i += k
    packets = sorted([*packets, packets[3]], key=lambda p: p[1] + random.integers(0, 100)) + [("end", 100_000, np.zeros((1, 3)))]  # ten seconds out of order
    for lo in range(0, len(packets), 12):
        rows = [(name, dt.datetime.fromtimestamp(base + at / 10, dt.timezone.utc), *x.T.tolist()) for name, at, x in packets[lo : lo + 12]]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out = jobs.stream_annotate(stream, squash, window=64, step=24, rate=10.0, gap=gap, late="20 seconds", batch_size=4)
    pieces = jobs.drain(out, str(tmp_path / "out"), str(tmp_path / "c")).collect()
    whole = spark.createDataFrame([(f"{s} {at}", *x.T.tolist()) for s, at, x in segments], "trace_name string, e array<double>, n array<double>, z array<double>")
    for row in spectral.annotate(whole, squash, window=64, step=24, tolerance=0, pads=False).collect():
        station, at = row.trace_name.split(" ")
        at = 10 * base + int(at)
        mine = sorted((p for p in pieces if p.trace_name == station and at <= p.start < at + len(row.p)), key=lambda p: p.start)
        assert [p.start for p in mine] == [at + sum(len(q.p) for q in mine[:k]) for k in range(len(mine))]
        for c in "psm":
            assert np.allclose(np.concatenate([p[c] for p in mine]), row[c])
    assert {p.trace_name for p in pieces} == {"a", "b"}


def test_stream_gate_needs_no_longest_box(spark, tmp_path):
    import datetime as dt

    from quakeframe.streaming import jobs

    random, day = rng(22), dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)
    at = lambda s: day + dt.timedelta(seconds=float(s), microseconds=7)
    boxes = [("a", 0.0, 4e5), ("b", 10.0, 20.0), ("b", 15.0, 18.0), ("b", 300.0, 300.0), ("b", 50.0, 40.0)]
    picks = [("a", float(s), i) for i, s in enumerate(random.uniform(-100, 5e5, 60))] + [("b", float(s), 100 + s) for s in (9, 10, 19, 20, 21, 45, 299, 300, 301)] + [("c", 15.0, 999)]
    for name, rows, schema, keys in (("picks", picks, "trace_name string, ts timestamp, n int", lambda r: (r[0], at(r[1]), int(r[2]))), ("boxes", boxes, "box_trace string, box_start timestamp, box_end timestamp", lambda r: (r[0], at(r[1]), at(r[2])))):
        rows = sorted(rows, key=lambda r: r[1])
        for lo in range(0, len(rows), 9):
            spark.createDataFrame([keys(r) for r in rows[lo : lo + 9]], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / name))
    read = lambda name, schema: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / name))
    gated = jobs.stream_gate(read("picks", "trace_name string, ts timestamp, n int"), read("boxes", "box_trace string, box_start timestamp, box_end timestamp"), late="30 days")
    got = {(r.trace_name, r.n, r.ts) for r in jobs.drain(gated, str(tmp_path / "out"), str(tmp_path / "c")).collect()}
    want = {(t, n) for t, s, n in picks if any(t == b and x <= s <= y for b, x, y in boxes)}
    assert {x[:2] for x in got} == want and all(ts.microsecond for _, _, ts in got)


def test_stacking_windows_of_uneven_steps(spark):
    rows = [("a", 0, [1.0, 2.0, 3.0, 4.0]), ("a", 2, [5.0, 6.0, 7.0, 8.0]), ("a", 3, [9.0, 10.0, 11.0, 12.0]), ("a", 9, [1.0, 1.0]), ("b", 5, [2.0])]
    df = spark.createDataFrame(rows, "trace_name string, start int, x array<double>")
    cover = {i: [x[i - s] for t, s, x in rows if t == "a" and s <= i < s + len(x)] for i in range(11)}
    for how, f in (("mean", np.mean), ("median", np.median)):
        got = {r.trace_name: r.curve for r in signal.overlap_add(df, how).collect()}
        assert np.allclose(got["a"], [f(v) for v in cover.values() if v]) and got["b"] == [2.0]


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.1"])
def test_detection_leaderboard_counts_the_event_traces_of_its_table(spark, sf):
    d = f"/root/testdata/{sf}"
    ids = {r.user_id for r in spark.read.parquet(f"{d}/events.parquet").select("user_id").collect()}
    n = len([i for i in ids if i % 5])
    rows = corpus.QUERIES["a16_detection_leaderboard"](spark, d).collect()
    print(sf, n, [tuple(r) for r in rows][:2])
    assert rows and {r.n_event for r in rows} == {n} and all(r.tp + r.fn == n and r.tp <= n for r in rows)


def test_packets_of_a_segment_are_joined_once():
    from quakeframe.streaming import jobs

    x, run = np.random.default_rng(3).normal(size=(300, 20, 3)), (lambda b: b / 2, np.ones(64), 32, 7)
    one, many = jobs.Segment(5, 3), jobs.Segment(5, 3)
    one.feed(x.reshape(-1, 3))
    pieces = []
    for k, packet in enumerate(x):
        many.feed(packet)
        assert len(many.x) < 1000 and many.end == 5 + sum(len(y) for _, y in pieces) + len(many.x) + many.n
        if k % 40 == 39:
            pieces += many.curves(*run)
    whole = one.curves(*run) + one.close(*run)
    pieces += many.curves(*run) + many.close(*run)
    assert [a for a, _ in pieces] == sorted({a for a, _ in pieces}) and pieces[0][0] == 5
    assert np.array_equal(np.concatenate([y for _, y in pieces]), np.concatenate([y for _, y in whole]))
    fed = jobs.Segment(0, 3)
    for packet in x:
        fed.feed(packet)
    assert len(fed.x) == 0 and fed.end == 6000  # nothing is copied before it is asked for


def test_boxes_of_many_traces_are_looked_at_together():
    from quakeframe.streaming import jobs

    rng, n = np.random.default_rng(8), 2000
    trace, box = np.array([f"t{k}" for k in rng.integers(0, 40, n)], object), rng.random(n) < 0.3
    a = rng.integers(0, 3000, n) + 10**15
    b = np.where(box, a + rng.integers(0, 60, n), a)
    want = [not box[i] and bool((box & (trace == trace[i]) & (a <= a[i]) & (b >= a[i])).any()) for i in range(n)]
    assert jobs.inside(trace, a, b, box).tolist() == want and sum(want) > 100


def test_exported_channels_take_as_many_folders_as_buckets(spark, tmp_path):
    at = str(tmp_path / "channels")
    schema = "source_id string, station_code string, channel string, samples array<double>"
    rows = [(f"ev{i}", None if i % 7 == 0 else "" if i % 5 == 0 else "A", c, [float(i)]) for i in range(300) for c in ("BHZ", "BHN")]
    io.export_channels(spark.createDataFrame(rows, schema), at)
    again = [(e, s, "BHZ", [-1.0]) for e, s, c, _ in rows if e in ("ev0", "ev5", "ev8", "ev299") and c == "BHZ"]
    io.export_channels(spark.createDataFrame([*again, ("ev8", "B", "BHZ", [-2.0])], schema), at)
    key = lambda r: tuple(map(repr, r))
    got = sorted((tuple(r) for r in spark.read.parquet(at).select("source_id", "station_code", "channel", "samples").collect()), key=key)
    gone = {(e, s) for e, s, *_ in again}
    assert got == sorted([*(r for r in rows if r[:2] not in gone), *again, ("ev8", "B", "BHZ", [-2.0])], key=key)
    assert len([p for p in (tmp_path / "channels").iterdir() if p.is_dir()]) <= io.EXPORT_BUCKETS
