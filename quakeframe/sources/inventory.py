"""Station inventories: channel epochs from XML files, merged over files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_CHANNEL = "_code string, _locationCode string, _startDate string, _endDate string, sensitivity double, freq_start double, freq_end double, freq_db double"


def read_inventory(spark: SparkSession, path: str) -> DataFrame:
    """Channel epochs of network/station/channel XML files; a missing code is '', an unreadable record goes to `corrupt`."""
    schema = f"_code string, station array<struct<_code:string,channel:array<struct<{', '.join(x.replace(' ', ':', 1) for x in _CHANNEL.split(', '))}>>>>, corrupt string"
    raw = spark.read.option("rowTag", "network").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "corrupt").schema(schema).xml(path)
    rows = raw.select(F.input_file_name().alias("source_file"), F.coalesce("_code", F.lit("")).alias("network"), F.explode_outer("station").alias("s"), "corrupt")
    rows = rows.select("source_file", "network", F.coalesce("s._code", F.lit("")).alias("station"), F.explode_outer("s.channel").alias("c"), "corrupt")
    return rows.select("source_file", "network", "station", F.coalesce("c._locationCode", F.lit("")).alias("location"), F.coalesce("c._code", F.lit("")).alias("channel"), F.try_to_timestamp("c._startDate").cast("timestamp_ntz").alias("start_date"), F.try_to_timestamp("c._endDate").cast("timestamp_ntz").alias("end_date"), "c.freq_start", "c.freq_end", "c.freq_db", "c.sensitivity", "corrupt")


_STREAM = "_code string, _sensor string, _datalogger string, start string, end string, gain double"


def _rows(spark: SparkSession, path: str, tag: str, schema: str) -> DataFrame:
    """Elements of a name in XML files, whatever their namespaces; a file that can't be read has a row with `corrupt`."""
    read = spark.read.option("rowTag", tag).option("ignoreNamespace", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "corrupt")
    return read.schema(f"{schema}, corrupt string").xml(path).withColumn("source_file", F.input_file_name())


def read_sc3ml(spark: SparkSession, path: str) -> DataFrame:
    """Channel epochs of inventories with sensor locations and streams: the columns of `read_inventory`, and `dangling`.

    Networks hold stations, these sensor locations, and these streams; a missing code is ''. A stream names its sensor and
    datalogger by public ids: the sensor has the frequency range, the stream the overall gain, or where it says none, the
    product of both parts' own. Ids are resolved by joins within their file. `dangling` lists those that a stream names and
    its file doesn't have; the stream stays, without what they would tell. Frequency ranges are all or none, and no
    variation in dB is ever told, so that merged channels have none.
    """
    nested = lambda schema: ", ".join(x.replace(" ", ":", 1) for x in schema.split(", "))
    networks = _rows(spark, path, "network", f"_code string, station array<struct<_code:string,sensorLocation:array<struct<_code:string,stream:array<struct<{nested(_STREAM)}>>>>>>")
    x = networks.select("source_file", "corrupt", F.coalesce("_code", F.lit("")).alias("network"), F.explode_outer("station").alias("s"))
    x = x.select("source_file", "corrupt", "network", F.coalesce("s._code", F.lit("")).alias("station"), F.explode_outer("s.sensorLocation").alias("l"))
    x = x.select("source_file", "corrupt", "network", "station", F.coalesce("l._code", F.lit("")).alias("location"), F.explode_outer("l.stream").alias("c"))
    x = x.select("source_file", "corrupt", "network", "station", "location", F.coalesce("c._code", F.lit("")).alias("channel"), F.col("c._sensor").alias("sensor"), F.col("c._datalogger").alias("datalogger"), "c.start", "c.end", "c.gain")
    part = lambda tag, schema: _rows(spark, path, tag, f"_publicID string, {schema}").filter("_publicID IS NOT NULL").dropDuplicates(["source_file", "_publicID"])
    sensors = part("sensor", "_response string, lowFrequency double, highFrequency double").select("source_file", F.col("_publicID").alias("sensor"), F.col("_response").alias("response"), F.col("lowFrequency").alias("freq_start"), F.col("highFrequency").alias("freq_end"), F.lit(True).alias("has_sensor"))
    loggers = part("datalogger", "gain double").select("source_file", F.col("_publicID").alias("datalogger"), F.col("gain").alias("logger_gain"), F.lit(True).alias("has_logger"))
    responses = part("responsePAZ", "gain double").select("source_file", F.col("_publicID").alias("response"), F.col("gain").alias("sensor_gain"), F.lit(True).alias("has_response"))
    x = x.join(sensors, ["source_file", "sensor"], "left").join(loggers, ["source_file", "datalogger"], "left").join(responses, ["source_file", "response"], "left")
    gone = [F.when(F.col(c).isNotNull() & (F.col(c) != "") & F.col(has).isNull(), F.col(c)) for c, has in (("sensor", "has_sensor"), ("datalogger", "has_logger"), ("response", "has_response"))]
    time = lambda c: F.try_to_timestamp(F.col(c)).cast("timestamp_ntz")
    sensitivity = F.coalesce(F.col("gain"), F.col("sensor_gain") * F.col("logger_gain"))
    return x.select("source_file", "network", "station", "location", "channel", time("start").alias("start_date"), time("end").alias("end_date"), "freq_start", "freq_end", F.lit(None).cast("double").alias("freq_db"), sensitivity.alias("sensitivity"), "corrupt", F.array_compact(F.array(*gone)).alias("dangling"))


def all_or_none(df: DataFrame, columns: tuple[str, ...] = ("freq_start", "freq_end", "freq_db")) -> DataFrame:
    """Sets a group of fields to NULL unless all of them are given."""
    whole = F.lit(True)
    for c in columns:
        whole = whole & F.col(c).isNotNull()
    return df.withColumns({c: F.when(whole, F.col(c)) for c in columns})


def distinct_channels(epochs: DataFrame) -> DataFrame:
    """One epoch for each (network, station, channel, location, start, end): that of the first source file."""
    keys = ["network", "station", "channel", "location", "start_date", "end_date"]
    others = [c for c in epochs.columns if c not in (*keys, "source_file")]
    first = epochs.groupBy(*keys).agg(F.min(F.struct("source_file", *others)).alias("x"))  # combined before the shuffle
    return first.select(*keys, "x.*").select(*epochs.columns)


def merge_stations(epochs: DataFrame) -> DataFrame:
    """Stations over all files: number of sources, of channels, and whether it is listed in several files."""
    return epochs.groupBy("network", "station").agg(F.countDistinct("source_file").alias("n_sources"), F.countDistinct("channel", "location").alias("n_channels"), F.array_join(F.array_sort(F.collect_set("source_file")), ",").alias("sources")).withColumn("is_duplicate", F.col("n_sources") > 1)


def merge_channels(epochs: DataFrame) -> DataFrame:
    """Distinct channels with their frequency range all or none."""
    return all_or_none(distinct_channels(epochs))
