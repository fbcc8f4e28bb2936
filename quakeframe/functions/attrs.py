"""Cleaning of raw attributes and the scalar functions of the trace table."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Strings that mean nothing, whatever their case.
NULL_STRINGS = ("nan", "none", "")


def clean(value: Column) -> Column:
    """A string that isn't one of NULL_STRINGS when trimmed and lower-cased; else NULL."""
    return F.when(~F.lower(F.trim(value)).isin(*NULL_STRINGS), value)


def clean_attr(attrs: Column, key: str, default: str | None = None) -> Column:
    """An entry of a map, cleaned, or the default where it is missing or means nothing."""
    got = clean(F.try_element_at(attrs, F.lit(key)))
    return got if default is None else F.coalesce(got, F.lit(default))


def to_double(value: Column) -> Column:
    """A number, or NULL for anything else, NaN included."""
    x = clean(value.cast("string")).try_cast("double")
    return F.when(~F.isnan(x), x)


def to_int(value: Column) -> Column:
    """An integer; '3.0' isn't one and gives NULL, as do −1 and anything that isn't a number."""
    x = clean(value.cast("string"))
    n = F.when(x.rlike(r"^\s*[+-]?[0-9]+\s*$"), x).try_cast("int")
    return F.when(n != -1, n)


def to_bool(value: Column) -> Column:
    """True for 'true' and '1', false for 'false' and '0', in any case; else NULL."""
    x = F.lower(F.trim(value.cast("string")))
    return F.when(x.isin("true", "1"), True).when(x.isin("false", "0"), False)


def split_station_id(value: Column) -> Column:
    """(network, station, location, band) of NET.STA.LOC.BAND; an empty location survives, other shapes are all network."""
    parts = F.split(value, r"\.", -1)
    names = ("network", "station", "location", "band")
    four = F.struct(*(F.get(parts, F.lit(i)).alias(n) for i, n in enumerate(names)))
    whole = F.struct(value.alias("network"), *(F.lit("").alias(n) for n in names[1:]))
    return F.when(F.size(parts) == 4, four).otherwise(whole)


def channel_id(network: Column, station: Column, location: Column, channel: Column) -> Column:
    """NET.STA.LOC.PREFIX with defaults XX, STA, '' and the channel's first two characters or HH."""
    of = lambda c, d: F.coalesce(F.nullif(F.trim(c), F.lit("")), F.lit(d))
    return F.concat_ws(".", of(network, "XX"), of(station, "STA"), F.coalesce(F.trim(location), F.lit("")), F.substring(of(channel, "HH"), 1, 2))


def time_of_sample(start_micros: Column, sample: Column, dt: float) -> Column:
    """Microseconds of a sample."""
    return start_micros + F.round(sample * (dt * 1e6)).cast("bigint")


def sample_of_time(start_micros: Column, micros: Column, rate: float) -> Column:
    """Sample of a time, truncated towards 0."""
    return ((micros - start_micros) / F.lit(1e6) * rate).cast("bigint")


def expand_years(spec: Column) -> Column:
    """Sorted distinct years of '2014,2018-2020'; raises on anything else."""
    token = F.transform(F.split(F.regexp_replace(spec, r"\s", ""), ","), lambda t: _years(t))
    return F.array_sort(F.array_distinct(F.flatten(token)))


def _years(token: Column) -> Column:
    ends = F.split(token, "-")
    first = F.get(ends, F.lit(0)).try_cast("int")
    last = F.coalesce(F.get(ends, F.lit(1)), F.get(ends, F.lit(0))).try_cast("int")
    good = token.rlike(r"^[0-9]{4}(-[0-9]{4})?$") & (last >= first)
    return F.when(good, F.sequence(F.when(good, first), F.when(good, last))).otherwise(F.raise_error(F.concat(F.lit("not a year or range: "), token)).cast("array<int>"))


def true_picks(df: DataFrame, columns: Mapping[str, str] | None = None, key: str = "trace_name") -> DataFrame:
    """(key, phase, time) of arrival-time strings, one column each; times that can't be read are left out."""
    columns = {"P": "trace_p_arrival_time", "S": "trace_s_arrival_time"} if columns is None else columns
    pairs = F.array(*(F.struct(F.lit(p).alias("phase"), clean(F.col(c).cast("string")).alias("text")) for p, c in columns.items()))
    out = df.select(key, F.explode(pairs).alias("x"))
    time = F.try_to_timestamp(F.regexp_replace("x.text", "Z$", "")).cast("timestamp_ntz")
    return out.select(key, F.col("x.phase").alias("phase"), time.alias("time")).filter("time IS NOT NULL")


def scaled(value: Column, factor: float = 100.0, digits: int = 3) -> Column:
    """A unit change for reports, such as m/s² to cm/s², rounded."""
    return F.round(value * factor, digits)


def curve_offset(curve_start_micros: Column, trace_start_micros: Column, rate: float) -> Column:
    """Samples by which a curve starts later than its trace."""
    return F.round((curve_start_micros - trace_start_micros) / F.lit(1e6) * rate).cast("int")


def filter_label(low: float, high: float) -> str:
    """How a filter is named in reports; a leg of 0 is off."""
    if low and high:
        return f"band-pass {low:g}-{high:g} Hz"
    return f"high-pass {low:g} Hz" if low else f"low-pass {high:g} Hz" if high else "unfiltered"
