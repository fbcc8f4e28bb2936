"""The given tables read as traces, picks, boxes and truth, for the registered queries and their SQL.

events: clicks are P predictions, views are S predictions, the first purchase of a user is the true P and the first
signup the true S, an error is a detection box of `value` minutes; the user is the trace and event_id % 3 the model.
embeddings: a vector is a trace of 64 samples. Tolerances are hours here, since the events of a user are that far apart.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TOLERANCE = {"P": 43200.0, "S": 86400.0}
THRESHOLDS = (0.1, 0.3, 0.5, 0.7, 0.9)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, d: str) -> DataFrame:
    micros = F.expr("(datediff(cast(ts as date), date'2024-01-01') * 86400L + hour(ts) * 3600 + minute(ts) * 60) * 1000000L + cast(extract(SECOND FROM ts) * 1000000 as bigint)")
    return table(spark, d, "events").select(F.col("event_id").alias("emit_order"), F.col("user_id").cast("string").alias("trace_name"), F.concat(F.lit("m"), F.col("event_id") % 3).alias("model"), "event_type", "value", (micros / F.lit(1e6)).alias("offset_s"))


def picks(spark, d):
    phase = F.when(F.col("event_type") == "click", "P").otherwise("S")
    return events(spark, d).filter(F.col("event_type").isin("click", "view")).select("model", "trace_name", phase.alias("phase"), "emit_order", "offset_s", (F.col("value") / 500).alias("peak_value"))


def truth(spark, d):
    phase = F.when(F.col("event_type") == "purchase", "P").otherwise("S")
    return events(spark, d).filter(F.col("event_type").isin("purchase", "signup")).groupBy("trace_name", phase.alias("phase")).agg(F.min("offset_s").alias("true_s"))


def boxes(spark, d):
    return events(spark, d).filter("event_type = 'error'").select("model", "trace_name", "emit_order", F.col("offset_s").alias("start_s"), (F.col("offset_s") + F.col("value") * 60).alias("end_s"), (F.col("value") / 500).alias("peak_value"))


def models(spark, d):
    """The three models, read off the events."""
    return events(spark, d).select("model").distinct()


def grid(spark, d, thresholds=THRESHOLDS):
    return models(spark, d).withColumn("threshold", F.explode(F.array(*(F.lit(t) for t in thresholds))))


def noise(spark, d):
    return events(spark, d).filter("cast(trace_name as bigint) % 5 = 0").select("trace_name").distinct()


def event_traces(spark, d):
    return events(spark, d).filter("cast(trace_name as bigint) % 5 <> 0").select("trace_name").distinct()


def traces(spark, d):
    """trace_name, samples in double, and a component: the vector is one component's samples."""
    return table(spark, d, "embeddings").select(F.col("vec_id").cast("string").alias("trace_name"), F.col("embedding").cast("array<double>").alias("samples"), F.col("label").alias("station"))


EVENTS_SQL = """
ev AS (SELECT event_id AS emit_order, CAST(user_id AS VARCHAR) AS trace_name, 'm' || CAST(event_id % 3 AS VARCHAR) AS model, event_type, value,
  (epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01')) / 1e6 AS offset_s FROM events),
picks AS (SELECT model, trace_name, CASE event_type WHEN 'click' THEN 'P' ELSE 'S' END AS phase, emit_order, offset_s, value / 500 AS peak_value
  FROM ev WHERE event_type IN ('click', 'view')),
truth AS (SELECT trace_name, CASE event_type WHEN 'purchase' THEN 'P' ELSE 'S' END AS phase, min(offset_s) AS true_s
  FROM ev WHERE event_type IN ('purchase', 'signup') GROUP BY 1, 2),
boxes AS (SELECT model, trace_name, emit_order, offset_s AS start_s, offset_s + value * 60 AS end_s, value / 500 AS peak_value FROM ev WHERE event_type = 'error'),
models AS (SELECT DISTINCT model FROM ev),
thresholds AS (SELECT unnest([0.1, 0.3, 0.5, 0.7, 0.9]::DOUBLE[]) AS threshold),
grid AS (SELECT model, threshold FROM models, thresholds),
noise AS (SELECT DISTINCT trace_name FROM ev WHERE CAST(trace_name AS BIGINT) % 5 = 0),
event_traces AS (SELECT DISTINCT trace_name FROM ev WHERE CAST(trace_name AS BIGINT) % 5 <> 0),
tol AS (SELECT * FROM (VALUES ('P', 43200.0::DOUBLE), ('S', 86400.0::DOUBLE)) AS t(phase, tol)),
swept AS (SELECT p.*, threshold FROM picks p JOIN thresholds ON peak_value >= threshold)"""

TRACES_SQL = """
traces AS (SELECT CAST(vec_id AS VARCHAR) AS trace_name, CAST(embedding AS DOUBLE[]) AS samples, label AS station FROM embeddings),
long AS (SELECT trace_name, unnest(range(len(samples))) AS i, unnest(samples) AS v FROM traces)"""
