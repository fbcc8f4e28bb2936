"""Queries and SQL for building, splitting, filtering and ranking.

Component records are vectors: three in a row are Z, N and E of one event and station. Orders with their customer and
nation stand in for traces with magnitude, SNR, distance and arrivals; line items for channel epochs of station files.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from quakeframe.functions import attrs
from quakeframe.operators import build, filters, leaderboard, match, scoring, splits
from quakeframe.plans import views as v
from quakeframe.plans.scoring import TOL, rounded
from quakeframe.plans.views import EVENTS_SQL
from quakeframe.sources import inventory
from quakeframe.sources import tables as io


def _records(s, d):
    e = v.table(s, d, "embeddings").filter("vec_id IS NOT NULL")
    g = F.floor(F.col("vec_id") / 3)
    event = F.concat((2014 + g % 5).cast("string"), F.lit("_"), F.floor(g / 4).cast("string"))
    station = F.concat(F.lit("RO.S"), (g % 40).cast("string"), F.when(g % 6 == 0, "..BH").when(g % 11 == 0, ".BH").otherwise(".00.HH"))
    k = F.col("vec_id") % 3
    return e.select(
        event.alias("event_id"), station.alias("station_id"), F.element_at(F.array(F.lit("Z"), F.lit("N"), F.lit("E")), (k + 1).cast("int")).alias("component"), F.col("embedding").alias("samples"),
        F.create_map(F.lit("magnitude"), ((g % 50) / 10).cast("string"), F.lit("depth"), F.when(g % 7 == 0, "None").otherwise(g.cast("string")), F.lit("Nsta"), F.when(g % 3 == 0, "3.0").otherwise((g % 9).cast("string")), F.lit("source"), F.lit("cat")).alias("event_attrs"),
        F.create_map(F.lit("npts"), F.when(g % 5 == 0, "nan").otherwise((50 + g % 30).cast("string")), F.lit("p_arrival_sample"), F.when(g % 4 == 0, "-1").otherwise((g % 60).cast("string")), F.lit("p_arrival_in_trace"), F.when(g % 2 == 0, "True").otherwise("False"), F.lit("status_physical"), F.when(g % 8 == 0, "missing_response").otherwise("ok")).alias("station_attrs"),
        F.create_map(F.lit("sensitivity_value"), F.when(F.col("vec_id") % 17 == 0, "0").otherwise((F.col("vec_id") % 5 + 1).cast("string")), F.lit("units"), F.when(k == 0, "counts").otherwise(F.concat(F.lit("M/S"), k.cast("string")))).alias("channel_attrs"),
    )


def _stations(s, d):
    return v.table(s, d, "supplier").select(F.concat(F.lit("S"), (F.col("s_suppkey") % 30).cast("string")).alias("station"), F.col("s_acctbal").cast("string").alias("latitude"), F.lit("25.5").alias("longitude"), F.when(F.col("s_suppkey") % 4 != 0, (F.col("s_suppkey") % 30 / 10).cast("string")).otherwise("bad").alias("elevation"), F.lit(None).cast("string").alias("elevation_m"), F.when(F.col("s_suppkey") % 30 % 3 == 0, F.lit(None).cast("string")).otherwise(F.concat(F.lit("R"), (F.col("s_suppkey") % 30).cast("string"))).alias("region"))


def _built(s, d):
    r = _records(s, d)
    return build.build_traces(r, build.read_station_table(_stations(s, d)), build.response_index(r))


def _orders(s, d):
    """Trace metadata from orders."""
    o = v.table(s, d, "orders").join(v.table(s, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(v.table(s, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return o.select(
        F.col("o_orderkey").cast("string").alias("trace_name"), F.col("o_orderkey").alias("key"), F.year("o_orderdate").cast("string").alias("trace_chunk"), F.col("c_name").alias("source_id"), F.col("n_name").alias("station_code"), (F.col("o_orderstatus") == "F").alias("trace_p_in_window"),
        (F.col("c_acctbal") / 500).alias("trace_p_snr_db"), (F.col("c_acctbal") / 400).alias("trace_s_snr_db"), (F.col("o_totalprice") / 1e5).alias("source_magnitude"), (F.col("o_custkey") % 300).cast("double").alias("path_ep_distance_km"), (F.col("o_custkey") % 400 + F.col("o_orderkey") % 7 / 10).alias("path_hyp_distance_km"),
        (F.col("o_orderkey") % 6000).cast("int").alias("trace_p_arrival_sample"), (F.col("o_orderkey") % 6000 + 300).cast("int").alias("trace_s_arrival_sample"), F.col("o_orderpriority").alias("priority"),
    )


def _epochs(s, d):
    x = v.table(s, d, "lineitem")
    return x.select(F.concat(F.lit("f"), F.col("l_linenumber").cast("string")).alias("source_file"), F.col("l_returnflag").alias("network"), (F.col("l_suppkey") % 50).cast("string").alias("station"), F.when(F.col("l_partkey") % 3 != 0, "00").otherwise("").alias("location"), F.concat(F.lit("BH"), (F.col("l_partkey") % 4).cast("string")).alias("channel"), F.year("l_shipdate").alias("start_date"), (F.year("l_shipdate") + 1).alias("end_date"), F.col("l_discount").alias("freq_start"), F.when(F.col("l_linenumber") % 5 != 0, F.col("l_tax")).alias("freq_end"), F.col("l_quantity").alias("freq_db"))


def _sweep(s, d):
    return scoring.score_picking(scoring.threshold_sweep(v.picks(s, d), v.THRESHOLDS), v.truth(s, d), TOL, v.grid(s, d), by=("model", "threshold"))


def _noise(s, d):
    return scoring.noise_tallies(v.noise(s, d), v.picks(s, d), v.THRESHOLDS, v.models(s, d))


def _detections(s, d):
    swept = scoring.threshold_sweep(v.boxes(s, d), v.THRESHOLDS)
    n = v.event_traces(s, d).groupBy().agg(F.count("*").alias("n_event"))
    return scoring.detection_stats(swept, v.truth(s, d), v.grid(s, d), by=("model", "threshold")).select("model", "threshold", "det_recall").crossJoin(F.broadcast(n))  # one row


def _heads(s, d):
    return v.models(s, d).withColumn("has_detection_head", F.col("model") != "m2")


_TRACE_COLUMNS = ("trace_name", "trace_chunk", "trace_npts", "station_network_code", "station_code", "station_location_code", "station_channel", "source_magnitude", "source_depth_km", "source_nsta", "trace_p_arrival_sample", "trace_p_in_window", "trace_completeness", "station_latitude_deg", "station_elevation_m", "station_region", "trace_status_physical", "trace_unit_physical", "trace_sensitivity_z", "trace_sensitivity_e")


def _doubles(c):
    return F.transform(c, lambda x: F.round(x.cast("double"), 5) + F.lit(0.0))


QUERIES = {
    "p1_p2_attrs": lambda s, d: v.table(s, d, "events").select("event_id", F.from_json("props", "map<string,string>").alias("a")).select("event_id", attrs.clean_attr(F.col("a"), "k").alias("k"), attrs.clean_attr(F.col("a"), "missing", "none given").alias("missing"), attrs.to_int(F.element_at("a", "k")).alias("k_int"), attrs.to_double(F.element_at("a", "k")).alias("k_double")),
    "p3_station_id": lambda s, d: _records(s, d).select("station_id", "component", "event_id", attrs.split_station_id(F.col("station_id")).alias("x")).select("station_id", "component", "event_id", "x.*"),
    "p7_years": lambda s, d: v.table(s, d, "orders").select("o_orderkey", attrs.expand_years(F.concat(F.year("o_orderdate").cast("string"), F.lit(","), (F.year("o_orderdate") - 2).cast("string"), F.lit("-"), (F.year("o_orderdate") + 1).cast("string"))).alias("years")),
    "p8_channel_id": lambda s, d: v.table(s, d, "customer").select("c_custkey", attrs.channel_id(F.when(F.col("c_custkey") % 3 == 0, "  ").otherwise("RO"), F.when(F.col("c_custkey") % 4 == 0, F.lit(None).cast("string")).otherwise(F.col("c_name")), F.lit(None).cast("string"), F.col("c_mktsegment")).alias("channel")),
    "p4_p20_j1_j2_build": lambda s, d: rounded(_built(s, d).select(*_TRACE_COLUMNS)),
    "p5_physical": lambda s, d: build.to_physical(_built(s, d)).select("trace_name", "physical_error", _doubles("z_physical").alias("z"), _doubles("e_physical").alias("e")),
    "p20_stack": lambda s, d: build.stack_components(_records(s, d)).select("event_id", "station_id", "npts", _doubles("z").alias("z"), _doubles("n").alias("n"), _doubles("e").alias("e")),
    "p21_event_channels": lambda s, d: build.event_channels(_built(s, d)).select("source_id", "channel", "component", F.size("samples").alias("n"), F.round(F.aggregate("samples", F.lit(0.0), lambda a, x: a + x), 3).alias("total")),
    "p22_prefixed": lambda s, d: _records(s, d).select("event_id", "station_id", "component", F.explode(build.prefixed(F.col("station_attrs"), "p_")).alias("key", "value")),
    "s4_stations": lambda s, d: rounded(build.read_station_table(_stations(s, d))),
    "s6_responses": lambda s, d: build.response_index(_records(s, d)),
    "k2_chunks": lambda s, d: io.chunk_list(_orders(s, d)),
    "p13_hash_split": lambda s, d: splits.hash_split(_orders(s, d).select("trace_name", "source_id"), "source_id", "split-v1", algo="sha2"),
    "p13_blake_split": lambda s, d: splits.hash_split(_orders(s, d).select("trace_name", "source_id"), "source_id", "split-v1"),
    "p17_sha_split": lambda s, d: splits.assign_split(_orders(s, d).select("trace_name", F.when(F.col("key") % 5 != 0, F.col("source_id")).alias("source_id")), algo="sha2"),
    "p17_assign_split": lambda s, d: splits.assign_split(_orders(s, d).select("trace_name", F.when(F.col("key") % 5 != 0, F.col("source_id")).alias("source_id"))),
    "p15_year_split": lambda s, d: _orders(s, d).select("trace_name", splits.year_split(F.col("trace_chunk").cast("int"), range(1992, 1997), (1997, 1998), (1999, 2000)).alias("split")),
    "a14_split_counts": lambda s, d: splits.split_counts(_orders(s, d).select(F.col("trace_chunk").alias("year"), splits.year_split(F.col("trace_chunk").cast("int"), range(1992, 1997), (1997, 1998), (1999, 2000)).alias("split")).filter("split IS NOT NULL")),
    "k6_test_index": lambda s, d: io.test_index(splits.hash_split(_orders(s, d).select("trace_name", "source_id"), "source_id", "split-v1", algo="sha2")),
    "m1_sample": lambda s, d: splits.sample_n(_orders(s, d).select("trace_name"), 200, "trace_name"),
    "m2_shard": lambda s, d: splits.shard(_orders(s, d).select("trace_name", "key"), 2, 5, "key"),
    "f1_browse": lambda s, d: filters.browse(_orders(s, d)).select("trace_name"),
    "f2_quality_gate": lambda s, d: filters.quality_gate(_orders(s, d)).select("trace_name"),
    "f3_chunks": lambda s, d: filters.chunks(_orders(s, d), ["1995", "1996"]).select("trace_name", "trace_chunk"),
    "f11_nearest_station": lambda s, d: rounded(filters.nearest_station(_orders(s, d)).select("trace_name", "path_hyp_distance_km")),
    "r3_nearest": lambda s, d: rounded(filters.nearest(_orders(s, d).select("trace_name", F.when(F.col("key") % 9 != 0, F.col("path_hyp_distance_km")).alias("dist")), 25, "dist", "trace_name")),
    "r4_spacing": lambda s, d: rounded(filters.station_spacing(_orders(s, d).select("source_id", "path_hyp_distance_km"), "source_id", "path_hyp_distance_km")),
    "a13_profile": lambda s, d: filters.profile(_orders(s, d)),
    "j9_event_residuals": lambda s, d: rounded(match.event_residuals(_orders(s, d).select("station_code", F.when(F.col("key") % 2 == 0, "P").otherwise("S").alias("phase"), (F.col("key") % 40).cast("double").alias("offset_s"), "trace_name"), _orders(s, d).select("station_code", F.col("key").alias("trace_order"), (F.col("key") % 30).cast("double").alias("p_s"), (F.col("key") % 30 + 8).cast("double").alias("s_s")))),
    "a24_event_report": lambda s, d: rounded(scoring.residual_stats(match.event_residuals(_orders(s, d).select("station_code", F.when(F.col("key") % 2 == 0, "P").otherwise("S").alias("phase"), (F.col("key") % 40).cast("double").alias("offset_s")), _orders(s, d).select("station_code", F.col("key").alias("trace_order"), (F.col("key") % 30).cast("double").alias("p_s"), (F.col("key") % 30 + 8).cast("double").alias("s_s"))), ["phase"], iqr="linear")),
    "j13_not_done": lambda s, d: match.not_done(v.picks(s, d).select("model", F.lit("h1").alias("params_hash"), "trace_name").distinct(), v.boxes(s, d).filter("peak_value > 0.4").select("model", F.lit("h1").alias("params_hash"), "trace_name")),
    "a15_picking_leaderboard": lambda s, d: rounded(leaderboard.picking_leaderboard(_sweep(s, d), _noise(s, d))),
    "a16_detection_leaderboard": lambda s, d: rounded(leaderboard.detection_leaderboard(_detections(s, d), _noise(s, d), _heads(s, d))),
    "r1_ranking": lambda s, d: rounded(leaderboard.rank_models(leaderboard.picking_leaderboard(_sweep(s, d), _noise(s, d)), 0.3).select("model", "total", "rank")),
    "u2_distinct_channels": lambda s, d: rounded(inventory.merge_channels(_epochs(s, d))),
    "a25_merge_stations": lambda s, d: inventory.merge_stations(_epochs(s, d)),
    "a5_fallback": lambda s, d: rounded(scoring.residuals_or_fallback(scoring.score_picking(v.picks(s, d), v.truth(s, d), TOL, v.models(s, d)).withColumn("std_s", F.lit(None).cast("double")).withColumn("mad_s", F.lit(None).cast("double"))).select("model", "phase", "std_s", "mad_s")),
    "a17_full_leaderboard": lambda s, d: rounded(leaderboard.full_leaderboard(_sweep(s, d), scoring.residual_stats(match.match_picks(v.picks(s, d), v.truth(s, d), TOL), ["model", "phase"]), scoring.score_t1(v.event_traces(s, d), v.noise(s, d), v.picks(s, d), v.THRESHOLDS, v.models(s, d)))),
    "r2_display_slice": lambda s, d: rounded(_sweep(s, d).filter("threshold = 0.3").select("model", "phase", "f1")),
    "k4_report": lambda s, d: leaderboard.to_report(_sweep(s, d).select("model", "phase", F.col("threshold").cast("string").alias("threshold"), "precision", "recall")),
    "j12_with_noise": lambda s, d: leaderboard.with_noise(_sweep(s, d).select("model", "phase", "threshold", "tp"), _noise(s, d).select("model", "threshold", "n_p"), {"m0": "m1"}),
    "j15_wide": lambda s, d: leaderboard.phases_wide(_sweep(s, d), ("model", "threshold"), ("tp", "fn")),
    "p9_true_picks": lambda s, d: attrs.true_picks(v.table(s, d, "orders").select(F.col("o_orderkey").cast("string").alias("trace_name"), F.when(F.col("o_orderkey") % 4 != 0, F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'")).otherwise("nan").alias("trace_p_arrival_time"), F.when(F.col("o_orderkey") % 5 != 0, F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss")).otherwise("not a time").alias("trace_s_arrival_time"))),
    "p10_sample_time": lambda s, d: v.events(s, d).select("emit_order", attrs.time_of_sample(F.col("emit_order") * 1000000, F.col("emit_order") % 977, 0.01).alias("micros"), attrs.sample_of_time(F.lit(0).cast("bigint"), (F.col("offset_s") * 1e6).cast("bigint"), 10.0).alias("sample")),
    "p11_tolerance": lambda s, d: v.truth(s, d).select("trace_name", "phase", match.tolerance({"P": 0.3}).alias("tol")),
    "p19_scaled": lambda s, d: v.table(s, d, "supplier").select("s_suppkey", attrs.scaled(F.col("s_suppkey") / 8, 100.0, 1).alias("x")),
    "p23_curve_offset": lambda s, d: v.events(s, d).select("emit_order", attrs.curve_offset((F.col("emit_order") + 250) * 10000, F.col("emit_order") * 10000, 100.0).alias("shift")),
    "f4_event_subset": lambda s, d: _orders(s, d).filter("source_id = 'Customer#000000007'").select("trace_name"),
    "f5_split_subset": lambda s, d: splits.hash_split(_orders(s, d).select("trace_name", "source_id"), "source_id", "split-v1", algo="sha2").filter("split = 'train'").select("trace_name"),
    "m3_single": lambda s, d: splits.sample_n(_orders(s, d).select("trace_name"), 1, "trace_name", seed=7),
    "u1_union": lambda s, d: v.event_traces(s, d).withColumn("pool", F.lit("event")).unionByName(v.noise(s, d).withColumn("pool", F.lit("noise"))),
    "u4_intersect": lambda s, d: v.picks(s, d).filter("phase = 'P'").select("trace_name").intersect(v.picks(s, d).filter("phase = 'S'").select("trace_name")),
}

_REC = """
g AS (SELECT *, vec_id // 3 AS g, vec_id % 3 AS k FROM embeddings),
rec AS (SELECT (2014 + g % 5)::VARCHAR || '_' || (g // 4)::VARCHAR AS event_id, 'RO.S' || (g % 40)::VARCHAR || CASE WHEN g % 6 = 0 THEN '..BH' WHEN g % 11 = 0 THEN '.BH' ELSE '.00.HH' END AS station_id,
  ['Z', 'N', 'E'][k + 1] AS component, CAST(embedding AS DOUBLE[]) AS samples, g, k, vec_id FROM g),
st AS (SELECT event_id, station_id, g, max(samples) FILTER (k = 0) AS z0, max(samples) FILTER (k = 1) AS n0, max(samples) FILTER (k = 2) AS e0, CASE WHEN g % 5 = 0 THEN 64 ELSE 50 + g % 30 END AS npts,
  max(CASE WHEN vec_id % 17 = 0 THEN 0.0 ELSE vec_id % 5 + 1 END::DOUBLE) FILTER (k = 0) AS sz, max(CASE WHEN vec_id % 17 = 0 THEN 0.0 ELSE vec_id % 5 + 1 END::DOUBLE) FILTER (k = 1) AS sn, max(CASE WHEN vec_id % 17 = 0 THEN 0.0 ELSE vec_id % 5 + 1 END::DOUBLE) FILTER (k = 2) AS se,
  CASE WHEN g % 8 = 0 THEN 'missing_response' ELSE 'ok' END AS status, string_split(station_id, '.') AS parts FROM rec GROUP BY event_id, station_id, g),
full3 AS (SELECT *, list_transform(range(1, npts + 1), lambda i: coalesce(z0[i], 0)) AS z, list_transform(range(1, npts + 1), lambda i: coalesce(n0[i], 0)) AS n, list_transform(range(1, npts + 1), lambda i: coalesce(e0[i], 0)) AS e FROM st WHERE z0 IS NOT NULL AND n0 IS NOT NULL AND e0 IS NOT NULL),
sta AS (SELECT * FROM (SELECT 'S' || (s_suppkey % 30)::VARCHAR AS station, s_acctbal AS lat, CASE WHEN s_suppkey % 4 <> 0 THEN s_suppkey % 30 / 10 * 1000 END AS el, CASE WHEN s_suppkey % 30 % 3 = 0 THEN '' ELSE 'R' || (s_suppkey % 30)::VARCHAR END AS region,
  row_number() OVER (PARTITION BY s_suppkey % 30 ORDER BY s_acctbal) AS rn FROM supplier) WHERE rn = 1),
b AS (SELECT event_id || '_' || station_id AS trace_name, substr(event_id, 1, 4) AS trace_chunk, npts, CASE WHEN len(parts) = 4 THEN parts[1] ELSE station_id END AS net, CASE WHEN len(parts) = 4 THEN parts[2] ELSE '' END AS code, CASE WHEN len(parts) = 4 THEN parts[3] ELSE '' END AS loc, CASE WHEN len(parts) = 4 THEN parts[4] ELSE '' END AS band, * FROM full3)"""
_ORD = """
ord AS (SELECT o_orderkey::VARCHAR AS trace_name, o_orderkey AS key, year(o_orderdate)::VARCHAR AS trace_chunk, c_name AS source_id, n_name AS station_code, o_orderstatus = 'F' AS inw, c_acctbal / 500 AS psnr, c_acctbal / 400 AS ssnr, o_totalprice / 1e5 AS mag,
  (o_custkey % 300)::DOUBLE AS ep, o_custkey % 400 + o_orderkey % 7 / 10 AS hyp, o_orderkey % 6000 AS p, o_orderkey % 6000 + 300 AS s FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)"""
_YS = "CASE WHEN trace_chunk::INT BETWEEN 1992 AND 1996 THEN 'train' WHEN trace_chunk::INT IN (1997, 1998) THEN 'val' WHEN trace_chunk::INT IN (1999, 2000) THEN 'test' END"
_SHA = "CASE WHEN u < 0.7 THEN 'train' WHEN u < 0.7 + 0.15 THEN 'val' ELSE 'test' END AS split FROM (SELECT trace_name, source_id, ('0x' || substr(sha256('split-v1|' || source_id), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE AS u FROM ord)"
_RD = "list_transform({}, lambda q: round(q::FLOAT::DOUBLE, 5) + 0.0)"
_EV = """
last AS (SELECT station_code, arg_max(key % 30, key)::DOUBLE AS ps, arg_max(key % 30 + 8, key)::DOUBLE AS ss FROM ord GROUP BY 1),
er AS (SELECT station_code, trace_name, CASE WHEN key % 2 = 0 THEN 'P' ELSE 'S' END AS phase, (key % 40)::DOUBLE AS offset_s, (key % 40) - CASE WHEN key % 2 = 0 THEN ps ELSE ss END AS residual_s FROM ord JOIN last USING (station_code)),
ev2 AS (SELECT * FROM er WHERE abs(residual_s) < CASE phase WHEN 'P' THEN 5 ELSE 8 END)"""
_EPO = """
ep AS (SELECT 'f' || l_linenumber::VARCHAR AS source_file, l_returnflag AS network, (l_suppkey % 50)::VARCHAR AS station, CASE WHEN l_partkey % 3 <> 0 THEN '00' ELSE '' END AS location, 'BH' || (l_partkey % 4)::VARCHAR AS channel, year(l_shipdate)::INT AS start_date, (year(l_shipdate) + 1)::INT AS end_date,
  l_discount AS freq_start, CASE WHEN l_linenumber % 5 <> 0 THEN l_tax END AS freq_end, l_quantity AS freq_db FROM lineitem)"""


def _with(body: str, *ctes: str) -> str:
    return "WITH " + ", ".join(ctes) + "\n" + body


def _leader(body: str, plain: bool = False) -> str:
    from quakeframe.plans.scoring import _M, _NOISE, _SWEPT_M, _TRUE, _scores

    if plain:
        return _with(body.replace("FROM c2", "FROM c"), EVENTS_SQL, _M, _TRUE, _scores("picks", "m", "model", "models"))

    tall = "nz AS (SELECT model, threshold, count(*) AS n_noise, count(*) FILTER (n > 0) AS hits, sum(p)::BIGINT AS n_p, sum(s)::BIGINT AS n_s FROM nn GROUP BY 1, 2)"
    board = """
lb AS (SELECT model, threshold, phase, tp, CASE phase WHEN 'P' THEN n_p ELSE n_s END AS fp, fn, fp AS event_fp, mae_s FROM c JOIN nz USING (model, threshold)),
lp AS (SELECT *, tp / greatest(tp + fp, 1) AS p, tp / greatest(tp + fn, 1) AS r FROM lb),
lf AS (SELECT *, CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) END AS f1 FROM lp)"""
    return _with(body, EVENTS_SQL, _SWEPT_M, _TRUE, _scores("swept", "sm", "model, threshold", "grid"), _NOISE, tall, board)


_WIDE = ", ".join(f"{'round(max(' + c + ') FILTER (phase = ' + repr(p) + '), 6)' if f else 'max(' + c + ') FILTER (phase = ' + repr(p) + ')'} AS {p.lower()}_{n}" for p in ("P", "S") for c, n, f in (("tp", "tp", 0), ("fp", "fp", 0), ("fn", "fn", 0), ("event_fp", "event_fp", 0), ("p", "precision", 1), ("r", "recall", 1), ("f1", "f1", 1), ("mae_s", "mae_s", 1)))

ORACLE_SQL = {
    "p1_p2_attrs": "SELECT event_id, props->>'k' AS k, 'none given' AS missing, TRY_CAST(props->>'k' AS INT) AS k_int, TRY_CAST(props->>'k' AS DOUBLE) AS k_double FROM events",
    "p3_station_id": _with("SELECT station_id, component, event_id, CASE WHEN len(p) = 4 THEN p[1] ELSE station_id END AS network, CASE WHEN len(p) = 4 THEN p[2] ELSE '' END AS station, CASE WHEN len(p) = 4 THEN p[3] ELSE '' END AS location, CASE WHEN len(p) = 4 THEN p[4] ELSE '' END AS band FROM (SELECT *, string_split(station_id, '.') AS p FROM rec)", _REC),
    "p7_years": "SELECT o_orderkey, [y - 2, y - 1, y, y + 1] AS years FROM (SELECT o_orderkey, year(o_orderdate)::INT AS y FROM orders)",
    "p8_channel_id": "SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'XX' ELSE 'RO' END || '.' || CASE WHEN c_custkey % 4 = 0 THEN 'STA' ELSE c_name END || '..' || substr(c_mktsegment, 1, 2) AS channel FROM customer",
    "p4_p20_j1_j2_build": _with("""SELECT trace_name, trace_chunk, npts::INT AS trace_npts, net AS station_network_code, code AS station_code, loc AS station_location_code, band AS station_channel, round(g % 50 / 10, 6) AS source_magnitude, CASE WHEN g % 7 <> 0 THEN g::DOUBLE END AS source_depth_km, CASE WHEN g % 3 <> 0 THEN (g % 9)::INT END AS source_nsta,
  CASE WHEN g % 4 <> 0 THEN (g % 60)::INT END AS trace_p_arrival_sample, g % 2 = 0 AS trace_p_in_window, 'ok' AS trace_completeness, round(lat, 6) AS station_latitude_deg, round(el, 6) AS station_elevation_m, coalesce(region, '') AS station_region, status AS trace_status_physical, 'M/S1' AS trace_unit_physical, sz AS trace_sensitivity_z, se AS trace_sensitivity_e
FROM b LEFT JOIN sta ON code = station""", _REC),
    "p5_physical": _with(f"SELECT trace_name, er AS physical_error, CASE WHEN er IS NULL THEN {_RD.format('list_transform(z, lambda q: q / sz)')} END AS z, CASE WHEN er IS NULL THEN {_RD.format('list_transform(e, lambda q: q / se)')} END AS e FROM (SELECT *, CASE WHEN status = 'missing_response' THEN status WHEN sz = 0 OR sn = 0 OR se = 0 THEN 'bad_sensitivity' END AS er FROM b)", _REC),
    "p20_stack": _with(f"SELECT event_id, station_id, npts::INT AS npts, {_RD.format('z')} AS z, {_RD.format('n')} AS n, {_RD.format('e')} AS e FROM b", _REC),
    "p21_event_channels": _with("SELECT event_id AS source_id, net || '.' || code || '.' || loc || '.' || band || c AS channel, c AS component, npts::INT AS n, round(list_sum(list_transform(CASE c WHEN 'Z' THEN z WHEN 'N' THEN n ELSE e END, lambda q: q::FLOAT::DOUBLE)), 3) AS total FROM b, (VALUES ('Z'), ('N'), ('E')) AS t(c)", _REC),
    "p22_prefixed": _with("""SELECT event_id, station_id, component, key, value FROM (SELECT event_id, station_id, component, unnest([{'key': 'p_npts', 'value': CASE WHEN g % 5 = 0 THEN 'nan' ELSE (50 + g % 30)::VARCHAR END}, {'key': 'p_p_arrival_sample', 'value': CASE WHEN g % 4 = 0 THEN '-1' ELSE (g % 60)::VARCHAR END},
  {'key': 'p_p_arrival_in_trace', 'value': CASE WHEN g % 2 = 0 THEN 'True' ELSE 'False' END}, {'key': 'p_status_physical', 'value': CASE WHEN g % 8 = 0 THEN 'missing_response' ELSE 'ok' END}], recursive := true) FROM rec)""", _REC),
    "s4_stations": _with("SELECT station, round(lat, 6) AS station_latitude_deg, 25.5::DOUBLE AS station_longitude_deg, round(el, 6) AS station_elevation_m, region AS station_region FROM sta", _REC),
    "s6_responses": _with("SELECT event_id, station_id, status AS trace_status_physical, '' AS trace_missing_response_components, sz AS trace_sensitivity_z, sn AS trace_sensitivity_n, se AS trace_sensitivity_e, CASE WHEN n0 IS NOT NULL THEN 'M/S1' WHEN e0 IS NOT NULL THEN 'M/S2' END AS trace_unit_physical FROM st", _REC),
    "k2_chunks": _with("SELECT DISTINCT trace_chunk FROM ord", _ORD),
    "p13_hash_split": _with(f"SELECT trace_name, source_id, {_SHA}", _ORD),
    "p17_sha_split": _with("""SELECT trace_name, source_id, CASE WHEN u < 0.7 THEN 'train' WHEN u < 0.7 + 0.15 THEN 'dev' ELSE 'test' END AS split
FROM (SELECT trace_name, CASE WHEN key % 5 <> 0 THEN source_id END AS source_id, ('0x' || substr(sha256(CASE WHEN key % 5 <> 0 THEN 'split-v1|' || source_id ELSE '42|' || trace_name END), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE AS u FROM ord)""", _ORD),
    "p15_year_split": _with(f"SELECT trace_name, {_YS} AS split FROM ord", _ORD),
    "a14_split_counts": _with(f"SELECT coalesce(y, '_total') AS year, split, count(*) AS n FROM (SELECT trace_chunk AS y, {_YS} AS split FROM ord) WHERE split IS NOT NULL GROUP BY GROUPING SETS ((y, split), (split))", _ORD),
    "k6_test_index": _with(f"SELECT * FROM (SELECT trace_name, source_id, {_SHA}) WHERE split = 'test'", _ORD),
    "m1_sample": _with("SELECT trace_name FROM ord ORDER BY md5('42|' || trace_name), trace_name LIMIT 200", _ORD),
    "m2_shard": _with("SELECT trace_name, key FROM ord WHERE key % 5 = 2", _ORD),
    "f1_browse": _with("SELECT trace_name FROM ord WHERE inw AND psnr > 5 AND mag >= 2.5", _ORD),
    "f2_quality_gate": _with("SELECT trace_name FROM ord WHERE p BETWEEN 200 AND 5799 AND s BETWEEN 200 AND 5799 AND psnr >= 5 AND ssnr >= 5 AND mag >= 2.5 AND ep <= 200", _ORD),
    "f3_chunks": _with("SELECT trace_name, trace_chunk FROM ord WHERE trace_chunk IN ('1995', '1996')", _ORD),
    "f11_nearest_station": _with("SELECT trace_name, round(hyp, 6) AS path_hyp_distance_km FROM ord WHERE s > 0 AND hyp < 300 ORDER BY hyp, trace_name LIMIT 1", _ORD),
    "r3_nearest": _with("SELECT trace_name, round(dist, 6) AS dist FROM (SELECT trace_name, CASE WHEN key % 9 <> 0 THEN hyp END AS dist FROM ord) ORDER BY dist NULLS LAST, trace_name LIMIT 25", _ORD),
    "r4_spacing": _with("SELECT source_id, round(coalesce(quantile_cont(s, 0.5), 1), 6) AS spacing FROM (SELECT source_id, hyp - lag(hyp) OVER (PARTITION BY source_id ORDER BY hyp) AS s FROM ord) GROUP BY 1", _ORD),
    "a13_profile": _with("SELECT count(*) AS n_traces, list_sort(list(DISTINCT trace_chunk)) AS years, count(DISTINCT station_code) AS n_stations, count(DISTINCT source_id) AS n_events FROM ord", _ORD),
    "j9_event_residuals": _with("SELECT station_code, phase, offset_s, trace_name, residual_s FROM ev2", _ORD, _EV),
    "a24_event_report": _with("""SELECT phase, count(*) AS n, round(avg(abs(residual_s)), 6) AS mae_s, round(sqrt(avg(residual_s * residual_s)), 6) AS rmse_s, round(stddev_pop(residual_s), 6) AS std_s, any_value(med) AS median_s, quantile_cont(abs(residual_s - med), 0.5) AS mad_s, quantile_cont(residual_s, 0.75) - quantile_cont(residual_s, 0.25) AS iqr_s
FROM ev2 JOIN (SELECT phase, quantile_cont(residual_s, 0.5) AS med FROM ev2 GROUP BY 1) USING (phase) GROUP BY phase""", _ORD, _EV),
    "j13_not_done": _with("SELECT DISTINCT model, 'h1' AS params_hash, trace_name FROM picks p WHERE NOT EXISTS (SELECT 1 FROM boxes b WHERE b.model = p.model AND b.trace_name = p.trace_name AND b.peak_value > 0.4)", EVENTS_SQL),
    "a15_picking_leaderboard": _leader(f"SELECT model, threshold, {_WIDE} FROM lf GROUP BY 1, 2"),
    "r1_ranking": _leader("SELECT model, round(t, 6) AS total, rank() OVER (ORDER BY t DESC)::INT AS rank FROM (SELECT model, coalesce(max(f1) FILTER (phase = 'P'), 0) + coalesce(max(f1) FILTER (phase = 'S'), 0) AS t FROM lf WHERE threshold = 0.3 GROUP BY 1)"),
    "a16_detection_leaderboard": _leader("""SELECT model, threshold, (SELECT count(*) FROM event_traces) AS n_event, n_noise, tp, fp, fn, tn, CASE WHEN h THEN round(p, 6) END AS precision, CASE WHEN h THEN round(r, 6) END AS recall, CASE WHEN h AND p + r > 0 THEN round(2 * p * r / (p + r), 6) END AS f1, CASE WHEN h AND d > 0 THEN round((tp::DOUBLE * tn - fp::DOUBLE * fn) / d, 6) END AS mcc
FROM (SELECT *, model <> 'm2' AS h, tp / greatest(tp + fp, 1) AS p, tp / greatest(tp + fn, 1) AS r, sqrt((tp + fp)::DOUBLE * (tp + fn) * (tn + fp) * (tn + fn)) AS d FROM (SELECT *, (SELECT count(*) FROM event_traces) - tp AS fn, n_noise - fp AS tn FROM (
SELECT model, threshold, n_noise, hits AS fp, round_even(coalesce(nd, 0) / ne * (SELECT count(*) FROM event_traces), 0)::BIGINT AS tp FROM nz LEFT JOIN (SELECT model, threshold, count(DISTINCT trace_name) AS nd FROM boxes JOIN thresholds ON peak_value >= threshold WHERE trace_name IN (SELECT trace_name FROM tb) GROUP BY 1, 2) USING (model, threshold), (SELECT count(*) AS ne FROM tb))))"""),
    "u2_distinct_channels": _with("SELECT source_file, network, station, location, channel, start_date, end_date, CASE WHEN freq_end IS NOT NULL THEN round(freq_start, 6) END AS freq_start, round(freq_end, 6) AS freq_end, CASE WHEN freq_end IS NOT NULL THEN round(freq_db, 6) END AS freq_db FROM (SELECT *, row_number() OVER (PARTITION BY network, station, channel, location, start_date, end_date ORDER BY source_file, freq_start, freq_end NULLS FIRST, freq_db) AS rn FROM ep) WHERE rn = 1", _EPO),
    "a25_merge_stations": _with("SELECT network, station, count(DISTINCT source_file) AS n_sources, count(DISTINCT channel || '|' || location) AS n_channels, array_to_string(list_sort(list(DISTINCT source_file)), ',') AS sources, count(DISTINCT source_file) > 1 AS is_duplicate FROM ep GROUP BY 1, 2", _EPO),
    "a5_fallback": _leader("SELECT model, phase, CASE WHEN median_s IS NOT NULL THEN round(sqrt(greatest(0, rmse_s * rmse_s - median_s * median_s)), 6) END AS std_s, round(iqr_s / 2, 6) AS mad_s FROM c2", True),
    "r2_display_slice": _leader("SELECT model, phase, f1 FROM scores WHERE threshold = 0.3"),
    "k4_report": _leader("SELECT model, phase, CAST(threshold AS VARCHAR) AS threshold, coalesce(printf('%.4f', p), '') AS precision, coalesce(printf('%.4f', r), '') AS recall FROM pr"),
    "j12_with_noise": _leader("SELECT c.model, phase, c.threshold, tp, n_p FROM c JOIN nz ON nz.model = CASE c.model WHEN 'm0' THEN 'm1' ELSE c.model END AND nz.threshold = c.threshold"),
    "j15_wide": _leader("SELECT model, threshold, max(tp) FILTER (phase = 'P') AS p_tp, max(fn) FILTER (phase = 'P') AS p_fn, max(tp) FILTER (phase = 'S') AS s_tp, max(fn) FILTER (phase = 'S') AS s_fn FROM c GROUP BY 1, 2"),
    "p9_true_picks": "SELECT o_orderkey::VARCHAR AS trace_name, 'P' AS phase, o_orderdate::TIMESTAMP AS time FROM orders WHERE o_orderkey % 4 <> 0 UNION ALL SELECT o_orderkey::VARCHAR, 'S', o_orderdate::TIMESTAMP FROM orders WHERE o_orderkey % 5 <> 0",
    "p10_sample_time": _with("SELECT emit_order, emit_order * 1000000 + emit_order % 977 * 10000 AS micros, trunc(trunc(offset_s * 1e6) / 1e6 * 10)::BIGINT AS sample FROM ev", EVENTS_SQL),
    "p11_tolerance": _with("SELECT trace_name, phase, CASE phase WHEN 'P' THEN 0.3 ELSE 0.5 END::DOUBLE AS tol FROM truth", EVENTS_SQL),
    "p19_scaled": "SELECT s_suppkey, round(s_suppkey / 8 * 100, 1) AS x FROM supplier",
    "p23_curve_offset": "SELECT event_id AS emit_order, 250 AS shift FROM events",
    "f4_event_subset": _with("SELECT trace_name FROM ord WHERE source_id = 'Customer#000000007'", _ORD),
    "f5_split_subset": _with(f"SELECT trace_name FROM (SELECT trace_name, source_id, {_SHA}) WHERE split = 'train'", _ORD),
    "m3_single": _with("SELECT trace_name FROM ord ORDER BY md5('7|' || trace_name), trace_name LIMIT 1", _ORD),
    "u1_union": _with("SELECT trace_name, 'event' AS pool FROM event_traces UNION ALL SELECT trace_name, 'noise' FROM noise", EVENTS_SQL),
    "u4_intersect": _with("SELECT trace_name FROM picks WHERE phase = 'P' INTERSECT SELECT trace_name FROM picks WHERE phase = 'S'", EVENTS_SQL),
}
_TB = "tb AS (SELECT p.trace_name FROM truth p JOIN truth s ON p.trace_name = s.trace_name AND p.phase = 'P' AND s.phase = 'S' WHERE s.true_s > p.true_s)"
ORACLE_SQL["a16_detection_leaderboard"] = ORACLE_SQL["a16_detection_leaderboard"].replace("swept AS (", _TB + ",\nswept AS (", 1)


def _full_sql() -> str:
    from quakeframe.plans.scoring import _M, _SWEPT_M, _T1, _TRUE, _scores

    rs = "rs AS (SELECT model, phase, stddev_pop(residual_s) AS sd, quantile_cont(abs(residual_s - med), 0.5) AS mad FROM m JOIN (SELECT model, phase, quantile_cont(residual_s, 0.5) AS med FROM m GROUP BY 1, 2) USING (model, phase) GROUP BY 1, 2)"
    lb = "lb AS (SELECT *, CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) END AS f1 FROM (SELECT model, threshold, phase, tp, fp, fn, tp / greatest(tp + fp, 1) AS p, tp / greatest(tp + fn, 1) AS r, sd, mad FROM c LEFT JOIN rs USING (model, phase)))"
    columns = (("tp", "tp"), ("fp", "fp"), ("fn", "fn"), ("p", "precision"), ("r", "recall"), ("f1", "f1"), ("sd", "std_s"), ("mad", "mad_s"))
    wide = ", ".join(f"round(max({c}) FILTER (phase = '{ph}'), 6) AS {ph.lower()}_{n}" if c not in ("tp", "fp", "fn") else f"max({c}) FILTER (phase = '{ph}') AS {ph.lower()}_{n}" for ph in "PS" for c, n in columns)
    t1 = "round(any_value(CASE WHEN t.p + t.r > 0 THEN 2 * t.p * t.r / (t.p + t.r) ELSE 0 END), 6) AS t1_f1, round(any_value(CASE WHEN d > 0 THEN (t.tp::DOUBLE * tn - t.fp::DOUBLE * t.fn) / d END), 6) AS t1_mcc"
    wide = wide.replace("max(", "max(lb.")
    return _with(f"SELECT lb.model, lb.threshold, {wide}, any_value(n_event) AS n_event, any_value(n_noise) AS n_noise, {t1} FROM lb JOIN t1p t ON t.model = lb.model AND t.threshold = lb.threshold GROUP BY 1, 2", EVENTS_SQL, _M, _SWEPT_M, _TRUE, _scores("swept", "sm", "model, threshold", "grid"), rs, lb, _T1)


ORACLE_SQL["a17_full_leaderboard"] = _full_sql()
