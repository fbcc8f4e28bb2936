"""Metric expressions: plain Columns over counts and residuals."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def ratio(a, b, zero: str = "null") -> Column:
    """a / b; where b is 0, NULL, or with zero='one' what a denominator of 1 gives."""
    a, b = _c(a).cast("double"), _c(b).cast("double")
    return a / F.greatest(b, F.lit(1.0)) if zero == "one" else F.when(b != 0, a / F.nullif(b, F.lit(0.0)))


def prf(tp, fp, fn, zero: str = "null") -> dict[str, Column]:
    """Precision, recall and F1. zero='null': undefined shares are NULL; zero='one': denominators are at least 1.

    With 'one', F1 is NULL unless precision + recall is positive; with 'null' a zero sum is NULL as well.
    """
    tp, fp, fn = _c(tp), _c(fp), _c(fn)
    p, r = ratio(tp, tp + fp, zero), ratio(tp, tp + fn, zero)
    return {"precision": p, "recall": r, "f1": F.when(p + r > 0, 2 * p * r / F.nullif(p + r, F.lit(0.0)))}


def mcc(tp, fp, fn, tn) -> Column:
    """Matthews correlation of four counts, in doubles since products overflow integers; NULL for a zero denominator."""
    tp, fp, fn, tn = (_c(x).cast("double") for x in (tp, fp, fn, tn))
    d = F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn))
    return F.when(d > 0, (tp * tn - fp * fn) / F.nullif(d, F.lit(0.0)))


def residual_aggregates(x) -> dict[str, Column]:
    """MAE, RMSE, median and interquartile range by linear interpolation, with the number of residuals."""
    x = _c(x).cast("double")
    return {"n_residuals": F.count(x), "mae_s": F.avg(F.abs(x)), "rmse_s": F.sqrt(F.avg(x * x)), "median_s": F.percentile(x, 0.5), "iqr_s": F.percentile(x, 0.75) - F.percentile(x, 0.25)}


def spread(rmse, median) -> Column:
    """Standard deviation from RMSE and median, sqrt(max(0, rmse² − median²)), or the RMSE where there is no median."""
    rmse, median = _c(rmse), _c(median)
    return F.when(median.isNull(), rmse).otherwise(F.sqrt(F.greatest(F.lit(0.0), rmse * rmse - median * median)))
