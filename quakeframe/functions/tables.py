"""Table functions for SQL users."""

from __future__ import annotations

import numpy as np
from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf


class PickCurve:
    """pick_curve(curve, height, distance): a row (sample, value) for each peak of a probability curve."""

    def eval(self, curve, height: float, distance: int):
        from quakeframe.operators.spectral import find_peaks

        if curve is not None:
            x = np.asarray(curve, float)
            for i in find_peaks(x, height, distance):
                yield int(i), float(x[i])


def register(spark: SparkSession) -> None:
    spark.udtf.register("pick_curve", udtf(PickCurve, returnType="sample int, value double"))
