"""Ground motion of traces: Arias intensity, its 5–95 % span, coda windows and peak values."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quakeframe.functions import arrays as A

GRAVITY = 9.81


def gradient(x: Column, dt: float) -> Column:
    """Central differences, one-sided at the ends; [0] for a single sample."""

    def run(a: Column) -> Column:
        n = F.size(a)
        before = F.concat(F.slice(a, 1, 1), F.slice(a, 1, F.greatest(n - 1, F.lit(0))))
        after = F.concat(F.slice(a, 2, F.greatest(n - 1, F.lit(0))), F.slice(a, n, 1))
        zipped = F.arrays_zip(before.alias("b"), after.alias("c"))
        return F.when(n < 2, F.transform(a, lambda v: F.lit(0.0))).otherwise(F.transform(zipped, lambda p, i: (p["c"] - p["b"]) / F.when((i == 0) | (i == n - 1), dt).otherwise(2 * dt)))

    return A.let(x, run)


def arias(a: Column, dt: float) -> Column:
    """π / 2g · Σ a² dt."""
    return math.pi / (2 * GRAVITY) * dt * A.total(F.transform(a, lambda v: v * v))


def husid_d5_95(a: Column, low: float = 0.05, high: float = 0.95) -> Column:
    """First samples at which 5 % and 95 % of the energy have arrived; (0, n − 1) without energy.

    A fold over the trace with the running sum as its state: no array of sums is built.
    """

    def run(x: Column) -> Column:
        return A.let(A.total(F.transform(x, lambda v: v * v)), lambda e: F.when(e > 0, A.let(fold(x, e), lambda s: F.struct(s["i5"].alias("i5"), s["i95"].alias("i95")))).otherwise(F.struct(F.lit(0).alias("i5"), (F.size(x) - 1).alias("i95"))))

    def fold(x: Column, e: Column) -> Column:
        start = F.struct(F.lit(0.0).alias("c"), F.lit(0).alias("i"), F.lit(-1).alias("i5"), F.lit(-1).alias("i95"))

        def step(s, v):
            c = s["c"] + v * v
            first = lambda at, share: F.when((s[at] < 0) & (c >= share * e), s["i"]).otherwise(s[at])
            return F.struct(c.alias("c"), (s["i"] + 1).alias("i"), first("i5", low).alias("i5"), first("i95", high).alias("i95"))

        return F.aggregate(x, start, step)

    return F.when(F.size(a) > 0, A.let(a, run))


def best_horizontal(e: Column, n: Column, z: Column) -> Column:
    """Of E and N the one with the larger magnitude, N on a tie; Z where both are missing."""
    top = lambda x: F.coalesce(F.array_max(F.transform(x, lambda v: F.abs(v))), F.lit(-1.0))
    return F.when(e.isNull() & n.isNull(), z).when(top(n) >= top(e), n).otherwise(e)


def ground_motion(x: Column, start: Column, end: Column, dt: float) -> Column:
    """(pga, pgv, pgd, arias) of one velocity component inside [start, end): peaks of derivative, value and running sum.

    The window is cut out first; PGD comes from a fold with the sum as state.
    """

    def run(v: Column) -> Column:
        a = gradient(v, dt)
        state = F.struct(F.lit(0.0).alias("c"), F.lit(0.0).alias("m"))
        pgd = F.aggregate(v, state, lambda s, x: F.struct((s["c"] + x * dt).alias("c"), F.greatest(s["m"], F.abs(s["c"] + x * dt)).alias("m")))["m"]
        top = lambda y: F.array_max(F.transform(y, lambda q: F.abs(q)))
        return A.let(a, lambda acc: F.struct(top(acc).alias("pga"), top(v).alias("pgv"), pgd.alias("pgd"), arias(acc, dt).alias("arias")))

    part = F.slice(x, start + 1, F.greatest(end - start, F.lit(0)))
    return F.when(F.size(part) > 0, A.let(part, run))


def motion_medians(motion: DataFrame, by: Sequence[str] = ("pick_source",), columns: Sequence[str] = ("pga", "pgv", "duration_s")) -> DataFrame:
    """Medians per pick source."""
    return motion.groupBy(*by).agg(F.count("*").alias("n"), *(F.percentile(c, 0.5).alias(f"median_{c}") for c in columns))
