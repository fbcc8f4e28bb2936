"""Array expressions for whole traces: one row in, one row out, nothing shuffled.

Helpers take the array as the argument of a higher-order function, never from inside its lambda, so that an expression
passed to them is evaluated once.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def mean(a: Column) -> Column:
    return let(a, lambda x: total(x) / F.nullif(F.size(x), F.lit(0)))


def std_pop(a: Column) -> Column:
    """Population deviation in two passes; NULL for an empty array."""
    return let(a, lambda x: let(mean(x), lambda m: F.sqrt(total(F.transform(x, lambda v: (v - m) * (v - m))) / F.nullif(F.size(x), F.lit(0)))))


def median(a: Column) -> Column:
    """Median, the mean of the middle two for an even size; NULL for an empty array."""
    return let(F.array_sort(a), lambda s: (F.get(s, ((F.size(s) - 1) / 2).cast("int")) + F.get(s, (F.size(s) / 2).cast("int"))) / 2)


def runs(mask: Column, least: int | Column = 1, most: int | Column | None = None) -> Column:
    """Maximal runs of true in a boolean array: array of (start, end), from 0, both inclusive, with lengths in bounds."""

    def found(m: Column) -> Column:
        before = F.concat(F.array(F.lit(False)), F.slice(m, 1, F.greatest(F.size(m) - 1, F.lit(0))))
        after = F.concat(F.slice(m, 2, F.greatest(F.size(m) - 1, F.lit(0))), F.array(F.lit(False)))
        starts = F.array_compact(F.transform(F.arrays_zip(m.alias("m"), before.alias("o")), lambda x, i: F.when(x["m"] & ~x["o"], i)))
        ends = F.array_compact(F.transform(F.arrays_zip(m.alias("m"), after.alias("o")), lambda x, i: F.when(x["m"] & ~x["o"], i)))
        return F.arrays_zip(starts.alias("start"), ends.alias("end"))

    def fits(r: Column) -> Column:
        n = r["end"] - r["start"] + 1
        return (n >= least) if most is None else (n >= least) & (n <= most)

    return F.filter(let(mask, found), fits)


def covered(r: Column) -> Column:
    """Samples in runs."""
    return F.aggregate(r, F.lit(0), lambda n, x: n + x["end"] - x["start"] + 1)


def hysteresis(a: Column, on: float, off: float) -> Column:
    """Triggers: runs above `off` that reach above `on`, from the first sample above `on` to the run's last.

    Array of (on_sample, off_sample, peak_value), the off sample inclusive.
    """

    def trigger(curve: Column, r: Column) -> Column:
        part = F.slice(curve, r["start"] + 1, r["end"] - r["start"] + 1)
        first = F.get(F.array_compact(F.transform(part, lambda v, i: F.when(v > on, i))), F.lit(0))
        return F.when(first.isNotNull(), F.struct((r["start"] + first).alias("on_sample"), r["end"].alias("off_sample"), F.array_max(part).alias("peak_value")))

    return let(a, lambda c: F.array_compact(F.transform(runs(F.transform(c, lambda v: v > off)), lambda r: trigger(c, r))))


def local_maxima(a: Column, height: float) -> Column:
    """Samples higher than both neighbours and at least `height`, as (sample, value); ends never count."""

    def found(c: Column) -> Column:
        n = F.size(c)
        zipped = F.arrays_zip(F.slice(c, 2, F.greatest(n - 2, F.lit(0))).alias("v"), F.slice(c, 1, F.greatest(n - 2, F.lit(0))).alias("p"), F.slice(c, 3, F.greatest(n - 2, F.lit(0))).alias("q"))
        return F.array_compact(F.transform(zipped, lambda x, i: F.when((x["v"] > x["p"]) & (x["v"] > x["q"]) & (x["v"] >= height), F.struct((i + 1).alias("sample"), x["v"].alias("value")))))

    return let(a, found)


def pad_or_cut(a: Column, n: int | Column, fill: Column | None = None) -> Column:
    """The first n samples, or all of them followed by `fill` (0 unless given) up to n."""
    fill = F.lit(0.0) if fill is None else fill
    n = F.lit(n) if isinstance(n, int) else n
    return F.concat(F.slice(a, 1, n), F.array_repeat(fill, F.greatest(n - F.size(a), F.lit(0))))
