"""Queries for sources and sinks: tables are written to the shared folder by a sink, and read again by a source."""

from __future__ import annotations

from pyspark.sql import functions as F

from quakeframe.operators import build, labels, splits
from quakeframe.plans import corpus
from quakeframe.plans import views as v
from quakeframe.plans.arrow_and_streams import _folder
from quakeframe.plans.corpus import _EPO, _ORD, _REC, _YS, _built, _epochs, _orders, _records, _with
from quakeframe.plans.scoring import ORACLE_SQL as SCORING_SQL
from quakeframe.plans.scoring import rounded
from quakeframe.sources import inventory
from quakeframe.sources import tables as io


def _chunks(s, d):
    return _orders(s, d).select("trace_name", "trace_chunk", "source_id")


def k1_write_traces(s, d):
    """Chunks written, one of them replaced, a refused second write, and pruned chunks read back."""
    at = f"{_folder(s)}/traces"
    io.write_traces(_chunks(s, d), at)
    again = _chunks(s, d).filter("trace_chunk = '1995'").withColumn("source_id", F.lit("again"))
    io.write_traces(again, at, overwrite=True)
    try:
        io.write_traces(again, at)
        refused = False
    except FileExistsError:
        refused = True
    read = io.read_traces(s, at, chunks=["1995", "1996"], schema="trace_name string, source_id string, trace_chunk string")
    return read.select("trace_name", "trace_chunk", "source_id", F.lit(refused).alias("refused"))


def s1_read_traces(s, d):
    """The whole trace table, built, written and read in another component order."""
    at = f"{_folder(s)}/traces"
    io.write_traces(_built(s, d), at)
    read = io.read_traces(s, at, component_order="ENZ", chunks=["2014", "2015"])
    total = lambda i: F.round(F.aggregate(F.get("components", F.lit(i)), F.lit(0.0), lambda a, x: a + x), 3)
    return read.select("trace_name", "trace_npts", "trace_component_order", total(0).alias("e"), total(2).alias("z"))


def s2_chunk_files(s, d):
    """Two chunk tables, one without a column, as one."""
    at, df = _folder(s), _chunks(s, d)
    df.filter("trace_chunk = '1994'").drop("source_id").write.parquet(f"{at}/a")
    df.filter("trace_chunk = '1995'").write.parquet(f"{at}/b")
    return io.read_chunk_files(s, [f"{at}/a", f"{at}/b"])


def s3_metadata_csv(s, d):
    """Strings of a CSV coerced to their kinds, bad values NULL."""
    at, key = f"{_folder(s)}/meta", F.col("key")
    raw = _orders(s, d).select("trace_name", F.when(key % 7 == 0, "None").when(key % 5 == 0, "n/a").otherwise((key / 4).cast("string")).alias("snr"), F.when(key % 3 == 0, "x").otherwise((key % 60).cast("string")).alias("npts"), F.when(key % 4 == 0, "True").when(key % 4 == 1, "False").otherwise("maybe").alias("inside"))
    io.write_table(raw, at)
    return rounded(io.read_metadata_csv(s, at, {"trace_name": "string", "snr": "double", "npts": "int", "inside": "bool"}))


def s5_component_records(s, d):
    at = f"{_folder(s)}/records"
    _records(s, d).write.parquet(at)
    read = io.read_component_records(s, at)
    return read.groupBy("component", F.col("channel_attrs")["units"].alias("units")).agg(F.count("*").alias("n"), F.sum(F.size("samples")).alias("samples"), F.countDistinct("station_id").alias("stations"))


def s8_s10_catalogues(s, d):
    """Event and pick catalogues and both indexes, as CSV, read by their schemas."""
    at, o = _folder(s), _orders(s, d)
    time = F.expr("timestamp_ntz'2020-01-01 00:00:00' + make_dt_interval(0, 0, 0, cast(key % 100000 as int))")
    io.write_table(o.select(F.col("trace_name").alias("event_id"), time.alias("time"), F.lit(45.5).alias("latitude"), F.lit(26.25).alias("longitude"), F.col("path_ep_distance_km").alias("depth"), F.lit(None).cast("double").alias("magnitude"), F.lit("cat").alias("source")), f"{at}/events")
    io.write_table(o.select(F.col("trace_name").alias("event_id"), F.col("station_code").alias("station_id"), F.when(F.col("key") % 2 == 0, "P").otherwise("S").alias("phase"), time.alias("time"), F.lit("manual").alias("source"), F.lit(2.5).alias("snr")), f"{at}/picks")
    index = o.select("trace_name", F.col("trace_p_arrival_sample").alias("p_sample"), F.when(F.col("key") % 3 != 0, F.col("trace_s_arrival_sample")).alias("s_sample"), F.lit(None).cast("int").alias("p_sample_original"), F.lit(None).cast("int").alias("s_sample_original"), F.lit(0.5).alias("ps_residual_sec"), F.lit("g").alias("ps_group"))
    io.write_table(index, f"{at}/index")
    io.write_table(o.filter("key % 5 = 0").select("trace_name"), f"{at}/noise")
    read = {kind: io.read_catalogue(s, f"{at}/{name}", kind) for name, kind in (("events", "events"), ("picks", "picks"), ("index", "event_index"), ("noise", "noise_index"))}
    noise = read["noise_index"].withColumn("is_noise", F.lit(True))
    out = read["events"].join(read["picks"].select("event_id", "station_id", "phase"), "event_id").join(read["event_index"].select(F.col("trace_name").alias("event_id"), "p_sample", "s_sample"), "event_id")
    return out.join(noise.withColumnRenamed("trace_name", "event_id"), "event_id", "left").select("event_id", "time", "depth", "magnitude", "station_id", "phase", "p_sample", "s_sample", F.coalesce("is_noise", F.lit(False)).alias("is_noise"))


def s9_sweeps(s, d):
    """Sweep tables of two files as one, and an error that names a missing one."""
    from quakeframe import schemas

    at, sweep = _folder(s), corpus._sweep(s, d)
    names = [c.strip().split(" ") for c in schemas.SWEEP.split(",")]
    whole = sweep.select(*((F.col(c) if c in sweep.columns else F.lit(None)).cast(kind).alias(c) for c, kind in names))
    for phase in ("P", "S"):
        io.write_table(whole.filter(F.col("phase") == phase), f"{at}/{phase}")
    try:
        io.read_sweeps(s, [f"{at}/P", f"{at}/missing"])
        named = ""
    except FileNotFoundError as error:
        named = str(error).rsplit("/", 1)[-1]
    read = io.read_sweeps(s, [f"{at}/P", f"{at}/S"])
    return rounded(read.select(*(c for c in sweep.columns), F.lit(named).alias("missing")))


def k3_write_split(s, d):
    at = _folder(s)
    df = _orders(s, d).select("trace_name", F.col("trace_chunk").alias("year"), splits.year_split(F.col("trace_chunk").cast("int"), range(1992, 1997), (1997, 1998), (1999, 2000)).alias("split")).filter("split IS NOT NULL")
    io.write_split(df, f"{at}/split", f"{at}/audit", f"{at}/record", p_train=0.6, p_val=0.2)
    audit = s.read.option("header", True).schema("year string, split string, n bigint").csv(f"{at}/audit")
    rows = s.read.parquet(f"{at}/split").groupBy("split").agg(F.count("*").alias("written"))
    record = io.read_split_record(s, f"{at}/record").select("p_train", F.col("rename")["val"].alias("val"), F.explode("per_year").alias("year", "x"))
    record = record.select("p_train", "val", "year", F.explode("x").alias("split", "recorded"))
    return audit.join(rows, "split").join(record, ["year", "split"])


def k7_publish(s, d):
    """Tables under their published names; the one that is missing is skipped."""
    at = _folder(s)
    board = _orders(s, d).groupBy("station_code").agg(F.count("*").alias("n"))
    done = io.publish({"board": board}, {"board": "board.csv", "other": "other.csv"}, at)
    return s.read.option("header", True).schema("station_code string, n bigint").csv(f"{at}/board.csv").withColumn("published", F.lit(",".join(done)))


def k8_by_station(s, d):
    """Written by station; those that are there are left alone when all come again."""
    at, x = f"{_folder(s)}/stations", _epochs(s, d).select("network", "station", "channel", "source_file")
    io.write_by_station(x.filter("cast(station as int) < 20"), at)
    io.write_by_station(x.withColumn("source_file", F.lit("again")), at)
    read = s.read.schema("channel string, source_file string, network string, station string").parquet(at)
    return read.groupBy("network", "station").agg(F.count("*").alias("n"), F.count_if(F.col("source_file") == "again").alias("n_again"))


def k9_channels(s, d):
    """Events in two exports, and one of them once more: what the other has written stays."""
    at, channels = f"{_folder(s)}/channels", build.event_channels(_built(s, d))
    for odd in (0, 1, 0):
        io.export_channels(channels.filter(F.pmod(F.xxhash64("source_id"), F.lit(2)) == odd), at)
    return s.read.parquet(at).groupBy("source_id", "station_code").agg(F.count("*").alias("n_channels"), F.sum(F.size("samples")).alias("n_samples")).withColumn("station_code", F.coalesce(F.col("station_code").cast("string"), F.lit("")))  # an empty partition value is read as NULL


def k10_audit(s, d):
    at = f"{_folder(s)}/audit"
    rows = _orders(s, d).groupBy(F.col("trace_chunk").alias("year")).agg(F.count("*").alias("n"))
    io.append_audit(rows, at)
    io.append_audit(rows, at)
    return s.read.option("header", True).schema("year string, n bigint").csv(at).groupBy("year").agg(F.count("*").alias("times"), F.sum("n").alias("n"))


def s11_inventory(s, d):
    """Station files as XML of networks, stations and channels, read as channel epochs."""
    at, x = f"{_folder(s)}/inventory", _epochs(s, d).select("network", "station", "channel", "location").distinct()
    channel = F.struct(F.col("channel").alias("_code"), F.col("location").alias("_locationCode"), F.lit("2020-01-01T00:00:00").alias("_startDate"), F.lit(2.0).alias("sensitivity"))
    stations = x.groupBy("network", "station").agg(F.sort_array(F.collect_list(channel)).alias("channel"))  # channels of one station
    networks = stations.groupBy(F.col("network").alias("_code"), "station").agg(F.first("channel").alias("channel")).select("_code", F.array(F.struct(F.col("station").alias("_code"), "channel")).alias("station"))
    networks.write.option("rowTag", "network").option("rootTag", "inventory").xml(at)
    read = inventory.read_inventory(s, at)
    return read.select("network", "station", "location", "channel", "start_date", "sensitivity")


def s7_array_pool(s, d):
    """Vectors as `.npy` files, some of them cut off, one column of three read again."""
    at = _folder(s)
    x = v.traces(s, d).select("trace_name", F.col("samples").alias("e"), F.transform("samples", lambda q: q * 2).alias("n"), F.transform("samples", lambda q: -q).alias("z"))
    files = io.encode_arrays(x, kind="<f8").withColumn("content", F.when(F.col("path").startswith("1"), F.expr("substring(content, 1, length(content) - 8)")).otherwise(F.col("content")))
    files.write.parquet(at)
    read = io.decode_arrays(s.read.parquet(at), columns=("z", "n"))
    total = lambda c: F.round(F.aggregate(c, F.lit(0.0), lambda a, q: a + q), 5)
    return read.select("trace_name", "status", F.size("z").alias("n_z"), total("z").alias("z"), total("n").alias("n"))


def s11_sc3ml(s, d):
    """Streams with a public id for their sensor, written as XML with a namespace and read again, ids resolved."""
    at, x = f"{_folder(s)}/sc3ml", _epochs(s, d).select("network", "station", "channel", "location").distinct()
    stream = F.struct(F.col("channel").alias("_code"), F.concat(F.lit("Sensor/"), F.col("channel")).alias("_sensor"), F.lit("2020-01-01T00:00:00Z").alias("start"), F.length("channel").cast("double").alias("gain"))
    places = x.groupBy("network", "station", "location").agg(F.sort_array(F.collect_list(stream)).alias("stream"))  # channels of one station
    places = places.groupBy("network", "station").agg(F.collect_list(F.struct(F.when(F.col("location") != "", F.col("location")).alias("_code"), "stream")).alias("sensorLocation"))
    networks = places.select(F.lit("http://example.org/inventory").alias("_xmlns"), F.col("network").alias("_code"), F.array(F.struct(F.col("station").alias("_code"), "sensorLocation")).alias("station"))
    networks.write.option("rowTag", "network").option("rootTag", "inventory").xml(at)
    return inventory.read_sc3ml(s, at).select("network", "station", "location", "channel", "start_date", "sensitivity", F.array_join("dangling", ",").alias("dangling"))


def p14_ordered(s, d):
    """Draws of one generator in the order of trace names, alike under another partitioning."""
    df = _orders(s, d).select("trace_name", F.when(F.col("key") % 2 == 0, F.col("source_id")).alias("source_id"))
    return splits.assign_split_in_order(df.repartition(13, "trace_name"), ["trace_name"])


def p14_drawn(s, d):
    """Draws by key: how many of each split, alike under another partitioning."""
    one = lambda df: df.select("trace_name", splits.choose(splits.bernoulli_unit(42, F.col("trace_name")), 0.7, 0.15).alias("split"))
    df = _orders(s, d).select("trace_name")
    both = one(df).join(one(df.repartition(13)).withColumnRenamed("split", "again"), "trace_name")
    near = {"train": 0.7, "val": 0.15, "test": 0.15}
    n = both.groupBy().agg(F.count("*").alias("n"), F.bool_and(F.col("split") == F.col("again")).alias("alike"), *(F.count_if(F.col("split") == k).alias(k) for k in near))
    return n.select("n", "alike", *((F.abs(F.col(k) / F.col("n") - p) < 0.03).alias(k) for k, p in near.items()))


def w42_align(s, d):
    """Two components of different starts on one axis, the gaps filled with their medians."""
    x = v.traces(s, d).select("trace_name", F.col("samples").alias("z"), F.slice("samples", 1, 50).alias("n"))
    aligned = build.align_components({"z": F.col("z"), "n": F.col("n")}, {"z": F.lit(3), "n": F.lit(0)}, 100.0)
    total = lambda c: F.round(F.aggregate(aligned[c], F.lit(0.0), lambda a, q: a + q), 5)
    return x.select("trace_name", F.size(aligned["z"]).alias("n_z"), F.size(aligned["n"]).alias("n_n"), total("z").alias("z"), total("n").alias("n"))


def p6_reordered(s, d):
    x = v.traces(s, d).select("trace_name", F.col("samples").alias("z"), F.transform("samples", lambda q: q * 2).alias("n"), F.transform("samples", lambda q: -q).alias("e"))
    first = F.transform(build.in_order(x, "ENZ"), lambda c: F.round(F.get(c, F.lit(0)), 6))
    return x.select("trace_name", *(F.get(first, F.lit(i)).alias(f"c{i}") for i in range(3)))


def f6_label_crops(s, d):
    """Crop offsets: inside their range, and the same for a key, seed and epoch."""
    x = v.table(s, d, "orders").select(F.col("o_orderkey").cast("string").alias("k"))
    at = lambda epoch: labels.crop_offset(7, F.col("k"), epoch, F.lit(500))
    return x.groupBy().agg(F.bool_and(at(0).between(0, 500)).alias("inside"), F.bool_and(at(1) == at(1)).alias("fixed"), (F.count_if(at(0) != at(1)) > 0).alias("moves"), F.count("*").alias("n"))


QUERIES = {
    "k1_write_traces": k1_write_traces,
    "s1_read_traces": s1_read_traces,
    "s2_chunk_files": s2_chunk_files,
    "s3_metadata_csv": s3_metadata_csv,
    "s5_component_records": s5_component_records,
    "s8_s10_catalogues": s8_s10_catalogues,
    "s9_sweeps": s9_sweeps,
    "s11_inventory": s11_inventory,
    "s7_array_pool": s7_array_pool,
    "s11_sc3ml": s11_sc3ml,
    "p14_ordered": p14_ordered,
    "k3_write_split": k3_write_split,
    "k7_publish": k7_publish,
    "k8_by_station": k8_by_station,
    "k9_channels": k9_channels,
    "k10_audit": k10_audit,
    "p6_reordered": p6_reordered,
    "p14_drawn": p14_drawn,
    "w35_crops": f6_label_crops,
    "w42_align": w42_align,
}

ORACLE_SQL = {
    "k1_write_traces": _with("SELECT trace_name, trace_chunk, CASE WHEN trace_chunk = '1995' THEN 'again' ELSE source_id END AS source_id, TRUE AS refused FROM ord WHERE trace_chunk IN ('1995', '1996')", _ORD),
    "s1_read_traces": _with("SELECT trace_name, npts::INT AS trace_npts, 'ENZ' AS trace_component_order, round(list_sum(list_transform(e, lambda q: q::FLOAT::DOUBLE)), 3) AS e, round(list_sum(list_transform(z, lambda q: q::FLOAT::DOUBLE)), 3) AS z FROM b WHERE trace_chunk IN ('2014', '2015')", _REC),
    "s2_chunk_files": _with("SELECT trace_name, trace_chunk, CASE WHEN trace_chunk = '1995' THEN source_id END AS source_id FROM ord WHERE trace_chunk IN ('1994', '1995')", _ORD),
    "s3_metadata_csv": _with("SELECT trace_name, CASE WHEN key % 7 <> 0 AND key % 5 <> 0 THEN key / 4 END AS snr, CASE WHEN key % 3 <> 0 THEN (key % 60)::INT END AS npts, CASE key % 4 WHEN 0 THEN TRUE WHEN 1 THEN FALSE END AS inside FROM ord", _ORD),
    "s5_component_records": _with("SELECT component, CASE WHEN k = 0 THEN 'counts' ELSE 'M/S' || k END AS units, count(*) AS n, sum(len(samples))::BIGINT AS samples, count(DISTINCT station_id) AS stations FROM rec GROUP BY 1, 2", _REC),
    "s8_s10_catalogues": _with("SELECT trace_name AS event_id, TIMESTAMP '2020-01-01' + to_seconds(key % 100000) AS time, ep AS depth, NULL::DOUBLE AS magnitude, station_code AS station_id, CASE WHEN key % 2 = 0 THEN 'P' ELSE 'S' END AS phase, p::INT AS p_sample, CASE WHEN key % 3 <> 0 THEN s::INT END AS s_sample, key % 5 = 0 AS is_noise FROM ord", _ORD),
    "s9_sweeps": f"SELECT *, 'missing' AS missing FROM ({SCORING_SQL['a29_threshold_sweep']})",
    "s11_inventory": _with("SELECT DISTINCT network, station, location, channel, TIMESTAMP '2020-01-01' AS start_date, 2.0::DOUBLE AS sensitivity FROM ep", _EPO),
    "s11_sc3ml": _with("SELECT DISTINCT network, station, location, channel, TIMESTAMP '2020-01-01' AS start_date, length(channel)::DOUBLE AS sensitivity, 'Sensor/' || channel AS dangling FROM ep", _EPO),
    "k3_write_split": _with(f"SELECT coalesce(y, '_total') AS year, split, count(*) AS n, any_value(w) AS written, 0.6::DOUBLE AS p_train, 'dev' AS val, count(*) AS recorded FROM (SELECT *, count(*) OVER (PARTITION BY split) AS w FROM (SELECT trace_chunk AS y, {_YS} AS split FROM ord)) WHERE split IS NOT NULL GROUP BY GROUPING SETS ((y, split), (split))", _ORD),
    "s7_array_pool": """SELECT vec_id::VARCHAR AS trace_name, CASE WHEN vec_id::VARCHAR LIKE '1%' THEN 'short' ELSE 'ok' END AS status, CASE WHEN vec_id::VARCHAR NOT LIKE '1%' THEN 64 END AS n_z,
CASE WHEN vec_id::VARCHAR NOT LIKE '1%' THEN round(-list_sum(embedding::DOUBLE[]), 5) END AS z, CASE WHEN vec_id::VARCHAR NOT LIKE '1%' THEN round(2 * list_sum(embedding::DOUBLE[]), 5) END AS n FROM embeddings""",
    "k7_publish": _with("SELECT station_code, count(*) AS n, 'board.csv' AS published FROM ord GROUP BY 1", _ORD),
    "k8_by_station": _with("SELECT network, station, count(*) AS n, CASE WHEN bool_or(station::INT < 20) THEN 0 ELSE count(*) END AS n_again FROM ep GROUP BY 1, 2", _EPO),
    "k9_channels": _with("SELECT event_id AS source_id, code AS station_code, 3 * count(*) AS n_channels, (3 * sum(npts))::BIGINT AS n_samples FROM b GROUP BY 1, 2", _REC),
    "k10_audit": _with("SELECT trace_chunk AS year, 2::BIGINT AS times, 2 * count(*) AS n FROM ord GROUP BY 1", _ORD),
    "p6_reordered": "SELECT vec_id::VARCHAR AS trace_name, round(-embedding[1]::DOUBLE, 6) AS c0, round(embedding[1]::DOUBLE * 2, 6) AS c1, round(embedding[1]::DOUBLE, 6) AS c2 FROM embeddings",
    "p14_drawn": _with("SELECT count(*) AS n, TRUE AS alike, TRUE AS train, TRUE AS val, TRUE AS test FROM ord", _ORD),
    "w35_crops": "SELECT TRUE AS inside, TRUE AS fixed, TRUE AS moves, count(*) AS n FROM orders",
    "w42_align": "SELECT vec_id::VARCHAR AS trace_name, 67 AS n_z, 67 AS n_n, round(list_sum(embedding::DOUBLE[]) + 3 * list_median(embedding::DOUBLE[]), 5) AS z, round(list_sum(embedding[1:50]::DOUBLE[]) + 17 * list_median(embedding[1:50]::DOUBLE[]), 5) AS n FROM embeddings",
}
