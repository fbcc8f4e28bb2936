"""Building the trace table from component records, stations and sensitivities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quakeframe.functions import arrays as A
from quakeframe.functions.attrs import clean_attr, split_station_id, to_bool, to_double, to_int
from quakeframe.schemas import ATTRIBUTES, COMPONENTS

RATE = 100.0


def response_index(records: DataFrame) -> DataFrame:
    """Per (event_id, station_id): status (default 'unknown'), missing components, unit, and each sensitivity.

    The unit is the first that isn't 'counts', in the order Z, N, E.
    """
    rows = records.select(
        "event_id", "station_id", "component", to_double(clean_attr(F.col("channel_attrs"), "sensitivity_value")).alias("sens"), F.nullif(F.lower(clean_attr(F.col("channel_attrs"), "units")), F.lit("counts")).alias("low"), clean_attr(F.col("channel_attrs"), "units").alias("unit"),
        clean_attr(F.col("station_attrs"), "status_physical").alias("status"), clean_attr(F.col("station_attrs"), "missing_response_components").alias("missing"),
    )
    pick = lambda c, what: F.max(F.when(F.col("component") == c, what))
    unit = F.when(F.col("low").isNotNull(), F.col("unit"))
    out = rows.groupBy("event_id", "station_id").agg(
        F.coalesce(F.max("status"), F.lit("unknown")).alias("trace_status_physical"), F.coalesce(F.max("missing"), F.lit("")).alias("trace_missing_response_components"),
        *(pick(c, unit).alias(f"unit_{c}") for c in COMPONENTS), *(pick(c, F.col("sens")).alias(f"trace_sensitivity_{c.lower()}") for c in COMPONENTS),
    )
    return out.withColumn("trace_unit_physical", F.coalesce(*(f"unit_{c}" for c in COMPONENTS))).drop(*(f"unit_{c}" for c in COMPONENTS))


def stack_components(records: DataFrame, keys=("event_id", "station_id")) -> DataFrame:
    """Z, N and E of each (event, station) in one row, cut or zero-filled to npts; a trace lacking one is dropped.

    npts: the station's attribute, or the length of Z. One shuffle on the keys.
    """
    one = lambda c: F.max(F.when(F.col("component") == c, F.col("samples")))
    wide = records.groupBy(*keys).agg(*(one(c).alias(c.lower()) for c in COMPONENTS), F.first("event_attrs", True).alias("event_attrs"), F.first("station_attrs", True).alias("station_attrs"))
    wide = wide.filter(" AND ".join(f"{c.lower()} IS NOT NULL" for c in COMPONENTS))
    wide = wide.withColumn("npts", F.coalesce(to_int(clean_attr(F.col("station_attrs"), "npts")), F.size("z")))
    return wide.withColumns({c.lower(): A.pad_or_cut(F.col(c.lower()), F.col("npts"), F.lit(0.0).cast("float")) for c in COMPONENTS})


def attribute(map_name: str, key: str, kind: str, default: str | None) -> Column:
    value = clean_attr(F.col(map_name), key, default)
    convert = {"string": lambda v: v, "double": to_double, "int": to_int, "bool": to_bool, "time": lambda v: F.try_to_timestamp(F.regexp_replace(v, "Z$", "")).cast("timestamp_ntz")}
    return convert[kind](value)


def read_station_table(stations: DataFrame) -> DataFrame:
    """One row per station: elevation_m, or elevation (km) × 1000; bad numbers are NULL; the first row by latitude wins."""
    number = lambda c: to_double(F.col(c)) if c in stations.columns else F.lit(None).cast("double")
    out = stations.select("station", number("latitude").alias("station_latitude_deg"), number("longitude").alias("station_longitude_deg"), F.coalesce(number("elevation_m"), number("elevation") * 1000).alias("station_elevation_m"), F.coalesce("region", F.lit("")).alias("station_region"))
    rest = [c for c in out.columns if c != "station"]
    return out.groupBy("station").agg(F.min(F.struct(*rest)).alias("x")).select("station", "x.*")


def enrich_stations(traces: DataFrame, stations: DataFrame) -> DataFrame:
    """Left join on the station code; an unknown region is ''. Stations are a dimension: Spark broadcasts it by its size."""
    side = stations.withColumnRenamed("station", "station_code")
    return traces.join(side, "station_code", "left").withColumn("station_region", F.coalesce("station_region", F.lit("")))


def enrich_responses(traces: DataFrame, responses: DataFrame) -> DataFrame:
    """Left join on event and station."""
    return traces.join(responses, ["event_id", "station_id"], "left")


def build_traces(records: DataFrame, stations: DataFrame | None = None, responses: DataFrame | None = None, rate: float = RATE) -> DataFrame:
    """The trace table: stacked components, every attribute column, stations and responses.

    One shuffle on (event_id, station_id) serves the stack and the responses.
    """
    wide = stack_components(records)
    if responses is not None:
        wide = enrich_responses(wide, responses)
    wide = wide.withColumn("id", split_station_id(F.col("station_id")))
    extra = [c for c in ("trace_status_physical", "trace_missing_response_components", "trace_unit_physical", "trace_sensitivity_z", "trace_sensitivity_n", "trace_sensitivity_e") if c in wide.columns]
    out = wide.select(
        F.concat_ws("_", "event_id", "station_id").alias("trace_name"), F.substring("event_id", 1, 4).alias("trace_chunk"), F.lit(float(rate)).alias("trace_sampling_rate_hz"), F.lit(1 / rate).alias("trace_dt_s"), F.col("npts").alias("trace_npts"), F.lit("ZNE").alias("trace_component_order"), F.lit("counts").alias("trace_units"),
        F.col("id.network").alias("station_network_code"), F.col("id.station").alias("station_code"), F.col("id.location").alias("station_location_code"), F.col("id.band").alias("station_channel"), F.col("event_id").alias("source_id"), F.lit("ml").alias("source_magnitude_type"),
        *(attribute(m, k, kind, d).alias(name) for name, m, k, kind, d in ATTRIBUTES), *extra, "z", "n", "e",
    )
    return out if stations is None else enrich_stations(out, stations)


def to_physical(traces: DataFrame, order: str = "ZNE", strict: bool = False) -> DataFrame:
    """Counts divided by each component's sensitivity, in double, as floats, in columns named for the order's components.

    Where the response is missing or a sensitivity is null, NaN, infinite or 0, arrays are NULL and physical_error says
    why; strict=True raises.
    """
    bad = F.lit(False)
    for c in order.lower():
        s = F.col(f"trace_sensitivity_{c}")
        bad = bad | s.isNull() | F.isnan(s) | (F.abs(s) == float("inf")) | (s == 0)
    error = F.when(F.col("trace_status_physical") == "missing_response", "missing_response").when(F.coalesce(bad, F.lit(True)), "bad_sensitivity")
    if strict:
        error = F.when(error.isNotNull(), F.raise_error(F.concat_ws(": ", "trace_name", error)).cast("string"))
    out = traces.withColumn("physical_error", error)
    divided = lambda c: F.when(F.col("physical_error").isNull(), F.transform(c, lambda v: (v.cast("double") / F.nullif(F.col(f"trace_sensitivity_{c}"), F.lit(0.0))).cast("float")))
    return out.withColumns({f"{c}_physical": divided(c) for c in order.lower()}).withColumn("trace_component_order", F.lit(order.upper()))


def in_order(traces: DataFrame, order: str) -> Column:
    """Components as one array of arrays in the given order; must name exactly Z, N and E."""
    if sorted(order.upper()) != ["E", "N", "Z"]:
        raise ValueError(f"an order must name Z, N and E once each: {order!r}")
    return F.array(*(F.col(c) for c in order.lower()))


def event_channels(traces: DataFrame, source_id: str | None = None) -> DataFrame:
    """One row per channel NET.STA.LOC.BAND+component of an event, or of all; KeyError-like check is the caller's."""
    of = traces if source_id is None else traces.filter(F.col("source_id") == source_id)
    channel = F.concat_ws(".", "station_network_code", "station_code", "station_location_code", F.concat("station_channel", "component"))
    keep = [c for c in ("source_id", "station_code", "trace_p_arrival_sample", "trace_s_arrival_sample", "path_ep_distance_km", "path_hyp_distance_km") if c in of.columns]
    pairs = F.array(*(F.struct(F.lit(c).alias("component"), F.col(c.lower()).alias("samples")) for c in COMPONENTS))
    out = of.withColumn("x", F.explode(pairs)).select("*", "x.*")
    return out.select(*keep, channel.alias("channel"), "component", "samples")


def prefixed(attrs: Column, prefix: str) -> Column:
    """Entries of a raw map as they are, under a prefix."""
    return F.transform_keys(attrs, lambda k, v: F.concat(F.lit(prefix), k))


def align_components(components: dict[str, Column], offsets: dict[str, Column], rate_in: float, rate_out: float = RATE) -> dict[str, Column]:
    """Components on a common axis: the union of their spans, each filled with its median outside its own, interpolated.

    offsets: start of each component in samples after the earliest.
    """
    from quakeframe.operators.curves import interpolate

    ends = [offsets[c] + F.size(x) for c, x in components.items()]
    n = F.greatest(*ends) if len(ends) > 1 else ends[0]
    out = {}
    for c, x in components.items():
        fill = F.coalesce(A.median(x), F.lit(0.0))
        whole = F.concat(F.array_repeat(fill, offsets[c]), x, F.array_repeat(fill, n - offsets[c] - F.size(x)))
        out[c] = interpolate(whole, F.round(n * (rate_out / rate_in)).cast("int")) if rate_in != rate_out else whole
    return out
