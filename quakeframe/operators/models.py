"""Predictors by name. Weights aren't shipped: a predictor is any function from batches of windows to curves."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quakeframe.operators.spectral import Predictor, annotate

_PREDICTORS: dict[str, tuple[Predictor, bool, dict]] = {}


def register(name: str, predict: Predictor, has_detection_head: bool = True, **settings) -> None:
    """settings: what `annotate` takes, such as window, step and order."""
    _PREDICTORS[name] = predict, has_detection_head, settings


def run(traces: DataFrame, name: str) -> DataFrame:
    """Curves of a registered model; KeyError for others."""
    predict, _, settings = _PREDICTORS[name]
    return annotate(traces, predict, model=name, **settings)


def table(spark: SparkSession) -> DataFrame:
    """(model, has_detection_head), a row for each registered model."""
    return spark.createDataFrame([(n, head) for n, (_, head, _) in _PREDICTORS.items()], "model string, has_detection_head boolean")
