"""Steps that built-in functions can't say: spectra, greedy suppression, seeded noise, batched prediction.

All run in Arrow batches over rows of traces, one row in and one out, without a shuffle; numpy does the arithmetic.
Randomness depends on (seed, trace, component) only, so any partitioning gives the same samples.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Sequence
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quakeframe.operators.signal import flat_regions, lively_surroundings, reference

MAX_DENOMINATOR = 1000


def _map_arrays(df: DataFrame, column: str, out: str, f: Callable[[np.ndarray, dict], np.ndarray], extra: tuple[str, ...] = ()) -> DataFrame:
    """`df` with `out` = f(array, {extra columns}); NULL arrays stay NULL."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = pdf[list(extra)].to_dict("records") if extra else [{}] * len(pdf)
            yield pdf.assign(**{out: [None if x is None else np.asarray(f(np.asarray(x, float), r), float) for x, r in zip(pdf[column], rows)]})

    kept = [f"`{f_.name}` {f_.dataType.simpleString()}" for f_ in df.schema if f_.name != out]
    order = [c for c in df.columns if c != out]
    return df.mapInPandas(lambda it: (p[[*order, out]] for p in run(it)), ", ".join([*kept, f"`{out}` array<double>"]))


# --- peaks -------------------------------------------------------------------------------------------------------


def find_peaks(x: np.ndarray, height: float, distance: int) -> np.ndarray:
    """Samples of local maxima of `height` or more, plateaus by their midpoint, ends never; then, from the highest down,
    peaks closer than `distance` to a higher one go. Equal heights: the later one is kept first, as it is looked at first."""
    if len(x) < 3:
        return np.zeros(0, int)
    edges = np.flatnonzero(np.diff(x) != 0)
    starts = np.concatenate([[0], edges + 1])
    ends = np.concatenate([edges, [len(x) - 1]])
    v = x[starts]
    up = np.zeros(len(v), bool)
    up[1:-1] = (v[1:-1] > v[:-2]) & (v[1:-1] > v[2:])
    peaks = ((starts + ends) // 2)[up & (v >= height)]
    if distance <= 1 or len(peaks) < 2:
        return peaks
    kept = np.ones(len(peaks), bool)
    for i in np.argsort(x[peaks], kind="stable")[::-1]:
        if kept[i]:
            close = np.abs(peaks - peaks[i]) < distance
            close[i] = False
            kept[close] = False
    return peaks[kept]


def trigger_onsets(x: np.ndarray, on: float, off: float) -> list[tuple[int, int]]:
    """Runs above `off` that reach above `on`: (first sample above `on`, last sample of the run)."""
    above = np.concatenate([[False], x > off, [False]])
    starts, ends = np.flatnonzero(above[1:] & ~above[:-1]), np.flatnonzero(above[:-1] & ~above[1:]) - 1
    out = []
    for a, b in zip(starts, ends):
        hit = np.flatnonzero(x[a : b + 1] > on)
        if len(hit):
            out.append((int(a + hit[0]), int(b)))
    return out


def nested_runs(x: np.ndarray, thresholds: np.ndarray) -> list[tuple[int, int, int, float]]:
    """Runs above each of rising thresholds, (threshold's place, first, last, peak), all in one pass over the curve.

    A run above a threshold lies in one above each lower threshold: where the curve rises over thresholds, runs begin, and
    where it falls, the innermost end first and hand their peaks on.
    """
    level = np.searchsorted(thresholds, np.where(np.isfinite(x), x, -np.inf), "left")  # thresholds below each sample
    edges = np.flatnonzero(np.diff(np.concatenate([[0], level, [0]])))
    if not len(edges):
        return []
    top = np.maximum.reduceat(np.append(x, -np.inf), edges)
    out, open_ = [], []
    for at, peak in zip(edges.tolist(), top.tolist()):
        here = int(level[at]) if at < len(x) else 0
        while len(open_) > here:
            first, highest = open_.pop()
            out.append((len(open_), first, at - 1, highest))
            if open_:
                open_[-1][1] = max(open_[-1][1], highest)
        open_ += [[at, peak] for _ in range(here - len(open_))]
        if open_:
            open_[-1][1] = max(open_[-1][1], peak)
    return out


def trigger_sweep(curves: DataFrame, thresholds: Sequence[float], curve: str = "m", by: Sequence[str] = ("model",)) -> DataFrame:
    """The boxes that triggering at each threshold anew gives: (by, trace_name, threshold, box, on_sample, off_sample, peak_value).

    Extents change with the threshold, unlike those of boxes that are only filtered by their peaks. Missing samples are
    below every threshold; a null curve has no boxes.
    """
    levels = np.unique(np.asarray(thresholds, float))
    names = [*by, "trace_name"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for key, x in zip(pdf[names].itertuples(index=False), pdf[curve]):
                count: dict[int, int] = {}
                for k, first, last, peak in sorted(nested_runs(np.asarray(x if x is not None else [], float), levels)):
                    rows.append((*key, levels[k], count.setdefault(k, 0), first, last, peak))
                    count[k] += 1
            yield pd.DataFrame(rows, columns=[*names, "threshold", "box", "on_sample", "off_sample", "peak_value"])

    kinds = ", ".join(f"`{c}` {curves.schema[c].dataType.simpleString()}" for c in names)
    return curves.select(*names, curve).mapInPandas(run, f"{kinds}, threshold double, box int, on_sample int, off_sample int, peak_value double")


PICKS = "phase string, emit_order int, sample int, peak_value double"


def peaks(curves: DataFrame, height: float, distance: int, columns: dict[str, str] | None = None) -> DataFrame:
    """Peaks of the P and S curves: one row per peak (model, trace_name, phase, emit_order, sample, peak_value)."""
    columns = {"P": "p", "S": "s"} if columns is None else columns

    def run(batches):
        for pdf in batches:
            rows = []
            for row in pdf.itertuples(index=False):
                order = 0
                for phase, c in columns.items():
                    if getattr(row, c) is None:  # a trace that failed
                        continue
                    x = np.asarray(getattr(row, c), float)
                    for i in find_peaks(x, height, distance):
                        rows.append((row.model, row.trace_name, phase, order, int(i), float(x[i])))
                        order += 1
            yield pd.DataFrame(rows, columns=["model", "trace_name", "phase", "emit_order", "sample", "peak_value"])

    return curves.select("model", "trace_name", *columns.values()).mapInPandas(run, f"model string, trace_name string, {PICKS}")


def classify(curves: DataFrame, p_threshold: float, s_threshold: float, detection_threshold: float, distance: int = 100, rate: float = 100.0) -> tuple[DataFrame, DataFrame]:
    """Picks (peaks of P and S at their thresholds) and detection boxes of curves, times in seconds from the curve's start.

    Boxes come from the native trigger; both are lazy and independent of each other.
    """
    from quakeframe.operators.curves import trigger

    found = peaks(curves, min(p_threshold, s_threshold), distance)
    least = F.when(F.col("phase") == "P", p_threshold).otherwise(s_threshold)
    picks = found.filter(F.col("peak_value") >= least).withColumn("offset_s", F.col("sample") / rate)
    boxes = trigger(curves, detection_threshold, detection_threshold)
    boxes = boxes.select("model", "trace_name", F.col("box").alias("emit_order"), (F.col("on_sample") / rate).alias("start_s"), (F.col("off_sample") / rate).alias("end_s"), "peak_value")
    return picks, boxes


# --- filters and resampling --------------------------------------------------------------------------------------


#: Samples of a block that a recursive filter takes at once.
FILTER_BLOCK = 64


def butterworth_sections(low: float, high: float, corners: int, rate: float) -> np.ndarray:
    """Second-order sections (b0, b1, b2, a1, a2) of a digital Butterworth filter of `corners` poles for each edge.

    Without `low` it is a low-pass, without `high`, or with one at half the rate or above, a high-pass. The analogue poles
    on the unit circle are moved to the prewarped edges and brought to the z plane by the bilinear transform; conjugate pairs
    make sections, and the gain is 1 in the middle of the band.
    """
    high = 0 if high >= rate / 2 else high
    if not low and not high or low >= rate / 2 or high and low >= high:
        raise ValueError(f"no band from {low} to {high} Hz at {rate} Hz")
    warped = lambda f: 2 * np.tan(np.pi * f / rate)
    poles = np.exp(1j * np.pi * (2 * np.arange(corners) + corners + 1) / (2 * corners))
    if low and high:
        half, centre = poles * (warped(high) - warped(low)) / 2, warped(low) * warped(high)
        root = np.sqrt(half**2 - centre)
        poles, zeros = np.concatenate([half + root, half - root]), np.repeat([1.0, -1.0], corners)
        middle = 2 * np.arctan(np.sqrt(centre) / 2)
    elif high:
        poles, zeros, middle = poles * warped(high), np.full(corners, -1.0), 0.0
    else:
        poles, zeros, middle = warped(low) / poles, np.full(corners, 1.0), np.pi
    poles = (2 + poles) / (2 - poles)
    upper = sorted(poles[poles.imag > 1e-12], key=lambda p: (abs(p), p.real))
    real = sorted(poles[np.abs(poles.imag) <= 1e-12].real)
    pairs = [(2 * p.real, -(abs(p) ** 2)) for p in upper] + [(sum(two), -two[0] * two[1] if len(two) == 2 else 0.0) for two in (real[k : k + 2] for k in range(0, len(real), 2))]
    left, out = sorted(zeros.tolist()), []
    for k, (a1, a2) in enumerate(pairs):
        single = k >= len(upper) and a2 == 0.0
        mine = [left.pop(0)] if single else [left.pop(0), left.pop()]  # one of either kind where there are both
        b = np.poly(mine)
        out.append([*b, *[0.0] * (3 - len(b)), -a1, -a2])
    out = np.array(out)
    z = np.exp(-1j * middle)
    out[:, :3] /= np.abs((out[:, :3] @ [1, z, z * z]) / (1 + out[:, 3:] @ [z, z * z]))[:, None]
    return out


def _run_section(x: np.ndarray, section: np.ndarray) -> np.ndarray:
    """One section over rows of samples, from rest. Blocks of samples are products with the section's impulse responses to
    a sample and to its two states; what a block leaves behind begins the next."""
    b0, b1, b2, a1, a2 = section
    step, into = np.array([[-a1, 1.0], [-a2, 0.0]]), np.array([b1 - a1 * b0, b2 - a2 * b0])
    powers = [np.eye(2)]
    for _ in range(FILTER_BLOCK):
        powers.append(step @ powers[-1])
    seen = np.array([p[0] for p in powers[:-1]])  # what the states say at each sample of a block
    answer = np.concatenate([[b0], [p[0] @ into for p in powers[:-2]]])
    lag = np.arange(FILTER_BLOCK)[:, None] - np.arange(FILTER_BLOCK)
    forced = np.where(lag >= 0, answer[np.maximum(lag, 0)], 0.0)
    kept = np.array([p @ into for p in powers[FILTER_BLOCK - 1 :: -1]])
    n = x.shape[1]
    wide = np.zeros((len(x), -(-n // FILTER_BLOCK) * FILTER_BLOCK))
    wide[:, :n] = x
    state = np.zeros((len(x), 2))
    for k in range(0, wide.shape[1], FILTER_BLOCK):
        part = wide[:, k : k + FILTER_BLOCK]
        wide[:, k : k + FILTER_BLOCK], state = part @ forced.T + state @ seen.T, state @ powers[-1].T + part @ kept
    return wide[:, :n]


def zero_phase(x: np.ndarray, sections: np.ndarray) -> np.ndarray:
    """Rows of samples, demeaned, through all sections forwards, then backwards, from rest both times."""
    x = x - x.mean(axis=1, keepdims=True)
    for _ in range(2):
        for section in sections:
            x = _run_section(x, section)
        x = x[:, ::-1]
    return x


def bridged(x: np.ndarray) -> np.ndarray:
    """Samples with missing ones on straight lines between their neighbours, the ends held; zeros if none is there."""
    there = np.isfinite(x)
    if there.all() or not len(x):
        return x
    at = np.flatnonzero(there)
    return np.interp(np.arange(len(x)), at, x[at]) if len(at) else np.zeros(len(x))


def bandpass(traces: DataFrame, low: float, high: float, corners: int = 4, rate: float = 100.0, column: str = "samples") -> DataFrame:
    """Band-, high- or low-pass by a recursive Butterworth filter run forwards and backwards, from rest.

    Traces of one length of an Arrow batch are filtered together. Missing samples are bridged first; an empty trace stays.
    """
    sections = butterworth_sections(low, high, corners, rate)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [None if x is None else bridged(np.asarray(x, float)) for x in pdf[column]]
            lengths = np.array([0 if x is None else len(x) for x in rows])
            for n in set(lengths.tolist()) - {0}:
                some = np.flatnonzero(lengths == n)
                for i, x in zip(some, zero_phase(np.stack([rows[i] for i in some]), sections)):
                    rows[i] = x
            yield pdf.assign(**{column: rows})

    kept = [f"`{f.name}` {'array<double>' if f.name == column else f.dataType.simpleString()}" for f in traces.schema]
    return traces.mapInPandas(run, ", ".join(kept))


@lru_cache
def polyphase_taps(up: int, down: int) -> np.ndarray:
    """A low-pass at the lower of both rates' halves: a sinc of ten zeros on each side under a Kaiser window (5), of gain `up`."""
    most = max(up, down)
    k = np.arange(-10 * most, 10 * most + 1)
    h = np.sinc(k / most) * np.kaiser(len(k), 5.0)
    return up * h / h.sum()


def resample_array(x: np.ndarray, up: int, down: int) -> np.ndarray:
    """Rational resampling by polyphase branches; length round(n * up / down), zeros beyond the ends.

    Every up-th output is the same branch of the filter: a few multiples of `x` at a stride of `down`, added up tap by tap, so
    that memory is in proportion to the samples. One sample more than the branches give is the last one again.
    """
    common = int(np.gcd(up, down))
    up, down = up // common, down // common
    n = int(round(len(x) * up / down))
    if len(x) == 0 or up == down:
        return x[:n]
    h, out = polyphase_taps(up, down), np.zeros(min(n, -(-len(x) * up // down)))
    middle = len(h) // 2
    for first in range(min(up, len(out))):  # outputs first, first + up, ...
        at = first * down  # in samples of the filter
        places = np.arange(len(out[first::up])) * down
        total = np.zeros(len(places))
        for back in range((at - middle + up - 1) // up, (at + middle) // up + 1):  # x[places + back] is under the filter
            tap = h[at - back * up + middle]
            lo, hi = np.searchsorted(places, (-back, len(x) - back))
            total[lo:hi] += tap * x[places[lo:hi] + back]
        out[first::up] = total
    return np.concatenate([out, np.full(n - len(out), out[-1])]) if n > len(out) > 0 else out


def resample(traces: DataFrame, rate_in: float, rate_out: float, column: str = "samples") -> DataFrame:
    """Traces at another rate, by the nearest ratio of whole numbers up to MAX_DENOMINATOR."""
    from fractions import Fraction

    ratio = Fraction(rate_out / rate_in).limit_denominator(MAX_DENOMINATOR)
    return _map_arrays(traces, column, column, lambda x, _: resample_array(x, ratio.numerator, ratio.denominator))


# --- noise -------------------------------------------------------------------------------------------------------


def _generator(seed: int, *names: str) -> np.random.Generator:
    digest = hashlib.blake2b("|".join([str(seed), *map(str, names)]).encode(), digest_size=8).digest()
    return np.random.Generator(np.random.PCG64(int.from_bytes(digest, "big")))


def matching_noise(reference: np.ndarray, n: int, rng: np.random.Generator) -> np.ndarray:
    """n samples of noise with the reference's amplitude spectrum, mean and deviation; plain normal under 50 samples.

    White noise gives the phases only: each of its frequencies is brought to the reference's amplitude.
    """
    mean, deviation = (reference.mean(), reference.std()) if len(reference) else (0.0, 1.0)
    white = rng.standard_normal(n)
    if len(reference) < 50 or n < 2:
        return mean + max(deviation, 1e-6) * white
    amplitude = np.abs(np.fft.rfft(reference))
    phases = np.fft.rfft(white)
    wanted = np.interp(np.linspace(0, 1, len(phases)), np.linspace(0, 1, len(amplitude)), amplitude)
    shaped = np.fft.irfft(phases / (np.abs(phases) + 1e-10) * wanted, n)
    shaped -= shaped.mean()
    spread = shaped.std()
    return mean + (shaped / spread * deviation if spread > 1e-10 else shaped)


def noise_reference(x: np.ndarray, window: int = 500, step: int = 100, distinct: int = 300, most: int = 5000, digits: int = 4) -> np.ndarray:
    """`signal.reference` of an array that a task has at hand."""
    begins = max(min(len(x) - window, most), 0)
    if begins:
        sorted_ = np.sort(np.lib.stride_tricks.sliding_window_view(np.round(x, digits), window)[:begins:step], axis=1)
        lively = 1 + np.count_nonzero(np.diff(sorted_, axis=1), axis=1) > distinct
        begins = step * int(np.argmax(lively))  # the first one, or 0
    return x[begins : begins + window]


def _beside(traces: DataFrame, column: str, f: Callable[[np.ndarray, dict], np.ndarray], **needed: Column) -> DataFrame:
    """`_map_arrays` in place, with columns that are there for f only."""
    names = {k: f"{k}_for_{column}" for k in needed}
    given = traces.withColumns({names[k]: c for k, c in needed.items()})
    return _map_arrays(given, column, column, lambda x, r: f(x, r | {k: r[n] for k, n in names.items()}), ("trace_name", *names.values())).drop(*names.values()).select(*traces.columns)


def pad_with_noise(traces: DataFrame, n: int, seed: int = 42, component: str = "Z", column: str = "samples") -> DataFrame:
    """Cut to n samples, or filled up behind with noise like the trace's reference window."""

    def padded(x: np.ndarray, r: dict) -> np.ndarray:
        return x[:n] if len(x) >= n else np.concatenate([x, matching_noise(np.asarray(r["like"], float), n - len(x), _generator(seed, r["trace_name"], component))])

    return _beside(traces, column, padded, like=reference(F.col(column)))


def boundary_pads(traces: DataFrame, front: int, back: int, rate: float = 100.0, seed: int = 42, component: str = "Z", column: str = "samples") -> DataFrame:
    """In front, noise like the first second (ten samples at least); behind, the median."""
    first = max(10, round(rate))
    return _map_arrays(traces, column, column, lambda x, r: np.concatenate([matching_noise(x[:first], front, _generator(seed, r["trace_name"], component)), x, np.full(back, np.median(x) if len(x) else 0.0)]), ("trace_name",))


def faded(n: int, fade: int, before: bool, behind: bool) -> np.ndarray:
    """Shares of a filling of n samples: all of it, but for ramps of `fade` samples, a quarter of it at most, where something
    stands before or behind it."""
    k = min(fade, n // 4)
    ramp = np.interp(np.arange(n), [0, max(k - 1, 0.5)], [0, 1]) if k else np.ones(n)
    return (ramp if before else 1) * (ramp[::-1] if behind else 1) * np.ones(n)


def fill_flat(traces: DataFrame, window: int = 100, distinct: int = 50, digits: int = 4, fade: int = 20, seed: int = 42, component: str = "Z", column: str = "samples") -> DataFrame:
    """The stretches of `flat_regions` replaced by noise like the first stretch that isn't flat, faded in and out."""

    def fill(x: np.ndarray, r: dict) -> np.ndarray:
        like, rng, out = np.asarray(r["like"], float), _generator(seed, r["trace_name"], component), x.copy()
        for run in r["flat"]:
            part = slice(run["start"], run["end"] + 1)
            share = faded(part.stop - part.start, fade, part.start > 0, part.stop < len(x))
            out[part] += share * (matching_noise(like, len(share), rng) - x[part])
        return out

    x = F.col(column)
    return _beside(traces, column, fill, flat=flat_regions(x, window, distinct, digits), like=lively_surroundings(x, window, distinct, digits))


# --- envelopes ---------------------------------------------------------------------------------------------------


def envelope(x: np.ndarray) -> np.ndarray:
    """Magnitude of the analytic signal."""
    n = len(x)
    if n == 0:
        return x
    weight = np.zeros(n)
    weight[0] = 1
    weight[1 : (n + 1) // 2] = 2
    if n % 2 == 0:
        weight[n // 2] = 1
    return np.abs(np.fft.ifft(np.fft.fft(x) * weight))


def coda_end(x: np.ndarray, s_sample: int, rate: float, share: float = 0.05, smooth_s: float = 1.0) -> int:
    """First sample from S on at which the smoothed envelope is below `share` of its largest value from S on; else the last."""
    width = max(int(smooth_s * rate), 1)
    after = np.convolve(envelope(x), np.ones(width) / width, mode="same")[s_sample:]
    low = np.flatnonzero(after < share * after.max()) if len(after) else np.zeros(0, int)
    return int(s_sample + low[0]) if len(low) else len(x) - 1


def envelope_coda(traces: DataFrame, rate: float = 100.0, share: float = 0.05, smooth_s: float = 1.0) -> DataFrame:
    """traces with coda_end (samples); NULL without S. Needs trace_name, samples, s_sample."""

    def run(batches):
        for pdf in batches:
            ends = [None if pd.isna(s) or x is None else coda_end(np.asarray(x, float), int(s), rate, share, smooth_s) for x, s in zip(pdf["samples"], pdf["s_sample"])]
            yield pd.DataFrame({"trace_name": pdf["trace_name"], "s_sample": pdf["s_sample"].astype("Int64"), "coda_end": pd.array(ends, "Int64")})

    return traces.select("trace_name", "samples", F.col("s_sample").cast("int").alias("s_sample")).mapInPandas(run, "trace_name string, s_sample int, coda_end int")


def coda_window(traces: DataFrame, method: str = "arias", rate: float = 100.0) -> DataFrame:
    """Where the coda of the stronger horizontal begins and ends: (trace_name, start_s, end_s), seconds from the start.

    arias: from 5 to 95 % of the energy of its derivative. envelope: from S, or the start without one, to the envelope's
    end. Needs trace_name, e, n, z, s_sample; a trace without samples has neither.
    """
    from quakeframe.operators.motion import best_horizontal, gradient, husid_d5_95

    best = traces.select("trace_name", best_horizontal(F.col("e"), F.col("n"), F.col("z")).alias("samples"), "s_sample").filter(F.size("samples") > 0)
    if method == "arias":
        spans = best.select("trace_name", husid_d5_95(gradient(F.col("samples"), 1 / rate)).alias("x"))
        return spans.select("trace_name", (F.col("x.i5") / rate).alias("start_s"), (F.col("x.i95") / rate).alias("end_s"))
    if method != "envelope":
        raise ValueError("method is 'arias' or 'envelope'")
    s = F.greatest(F.least(F.coalesce("s_sample", F.lit(0)), F.size("samples") - 1), F.lit(0))
    spans = envelope_coda(best.withColumn("s_sample", s), rate)
    return spans.select("trace_name", (F.col("s_sample") / rate).alias("start_s"), (F.col("coda_end") / rate).alias("end_s"))


# --- prediction --------------------------------------------------------------------------------------------------

Predictor = Callable[[np.ndarray], np.ndarray]


def starts(n: int, window: int, step: int) -> np.ndarray:
    """0, step, … and the last possible start where the tail isn't covered; [0] for a window or less."""
    if n <= window:
        return np.zeros(1, int)
    at = np.arange(0, n - window + 1, step)
    return at if at[-1] == n - window else np.append(at, n - window)


def standardized(windows: np.ndarray) -> np.ndarray:
    """Each window and channel demeaned and divided by its deviation, tiny ones counting as 1."""
    d = windows.std(axis=1, keepdims=True)
    return (windows - windows.mean(axis=1, keepdims=True)) / np.where(d < 1e-10, 1.0, d)


def laid_out(x: np.ndarray, window: int, step: int, tolerance: int, noise: Callable[[np.ndarray, int], tuple[np.ndarray, np.ndarray]] | None) -> tuple[np.ndarray, np.ndarray, int]:
    """What is predicted for a trace (n, channels): samples, window starts, and where the trace begins in the samples.

    Up to `tolerance` samples more than a window: its first window, followed by zeros where it is shorter. Longer traces
    get a window of noise like their own at both ends, or none.
    """
    n = len(x)
    if noise is None and n > window:
        return x, starts(n, window, step), 0
    if n <= window + tolerance:
        return np.concatenate([x[:window], np.zeros((max(window - n, 0), x.shape[1]))]), np.zeros(1, int), 0
    front, back = zip(*(noise(x[:, c], c) for c in range(x.shape[1])))
    wide = np.concatenate([np.stack(front, axis=1), x, np.stack(back, axis=1)])
    return wide, starts(len(wide), window, step), window


def _ones_for_detection(y: np.ndarray) -> np.ndarray:
    return y if y.shape[2] > 2 else np.concatenate([y[:, :, :2], np.ones((*y.shape[:2], 1))], axis=2)


class Batches:
    """Windows of many traces, predicted in full batches; a failing batch is tried again window by window.

    `add` takes a trace's windows, `results` gives each trace's weighted mean of what its windows say, or the error that
    the predictor raised on one of them.
    """

    def __init__(self, predict: Predictor, size: int, weights: np.ndarray):
        self.predict, self.size, self.weights = predict, size, weights
        self.sums: list[tuple[np.ndarray, np.ndarray]] = []
        self.errors: list[str | None] = []
        self.waiting: list[tuple[int, int, np.ndarray]] = []

    def add(self, wide: np.ndarray, at: np.ndarray) -> None:
        self.sums.append((np.zeros((len(wide), 3)), np.zeros(len(wide))))
        self.errors.append(None)
        for a in at.tolist():
            self.waiting.append((len(self.sums) - 1, a, wide[a : a + len(self.weights)]))
            if len(self.waiting) == self.size:
                self._run()

    def fail(self, error: Exception) -> None:
        self.sums.append((np.zeros((0, 3)), np.zeros(0)))
        self.errors.append(f"{type(error).__name__}: {error}")

    def _run(self) -> None:
        batch, self.waiting = self.waiting, []
        if not batch:
            return
        try:
            self._take(batch)
        except Exception as error:  # a predictor may raise anything, and only the trace it can't do is lost
            if len(batch) == 1:
                self.errors[batch[0][0]] = f"{type(error).__name__}: {error}"
            else:
                for one in batch:
                    self.waiting = [one]
                    self._run()

    def _take(self, batch: list[tuple[int, int, np.ndarray]]) -> None:
        predicted = _ones_for_detection(np.asarray(self.predict(standardized(np.stack([x for _, _, x in batch]))), float))
        if predicted.shape != (len(batch), len(self.weights), 3):
            raise ValueError(f"predicted {predicted.shape} for {len(batch)} windows")
        for (trace, a, _), y in zip(batch, predicted):
            total, weight = self.sums[trace]
            total[a : a + len(y)] += y * self.weights[:, None]
            weight[a : a + len(y)] += self.weights

    def results(self) -> list[tuple[np.ndarray, str | None]]:
        self._run()
        return [(total / np.maximum(weight, 1e-8)[:, None], error) for (total, weight), error in zip(self.sums, self.errors)]


def _predicted(rows: list[tuple[str, np.ndarray | Exception]], predict: Predictor, window: int, step: int, batch_size: int, weights: np.ndarray, tolerance: int, seed: int, pads: bool = True) -> list[tuple[np.ndarray | None, str | None]]:
    """Curves (n, 3), or an error, of named traces (n, channels). Samples where any curve isn't finite are 0 in all."""
    batches, placed = Batches(predict, batch_size, weights), []
    for name, x in rows:
        if isinstance(x, Exception):
            batches.fail(x)
            placed.append((0, 0))
            continue

        def noise(channel: np.ndarray, c: int, name: str = name) -> tuple[np.ndarray, np.ndarray]:
            reference, rng = noise_reference(channel), _generator(seed, name, str(c))
            return matching_noise(reference, window, rng), matching_noise(reference, window, rng)

        wide, at, front = laid_out(x, window, step, tolerance, noise if pads else None)
        batches.add(wide, at if len(x) else at[:0])
        placed.append((front, len(x)))
    out = []
    for (front, n), (y, error) in zip(placed, batches.results()):
        if error is None:
            y = y[front : front + n]
            y = np.concatenate([y, np.zeros((n - len(y), 3))])
            y[~np.isfinite(y).all(axis=1)] = 0.0
        out.append((None if error else y, error))
    return out


def _channels(row, order: str, prefix: str = "") -> np.ndarray | Exception:
    """A row's components (n, channels), or what is wrong with them."""
    try:
        return np.stack([np.asarray(getattr(row, prefix + c), float) for c in order.lower()], axis=1)
    except (TypeError, ValueError) as error:
        return error


CURVES = "p array<double>, s array<double>, m array<double>, error string"


def _curve_schema(df: DataFrame, keep: tuple[str, ...]) -> str:
    kept = [f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema if f.name in keep]
    return ", ".join(["model string, trace_name string", *kept, CURVES])


def _curve_row(y: np.ndarray | None, error: str | None) -> tuple:
    return (None, None, None, error) if y is None else (y[:, 0], y[:, 1], y[:, 2], None)


def annotate(traces: DataFrame, predict: Predictor, window: int = 6000, step: int = 1000, batch_size: int = 32, model: str = "model", order: str = "ENZ", weights: np.ndarray | None = None, tolerance: int = 100, seed: int = 42, keep: tuple[str, ...] = ("trace_start_time",), pads: bool = True) -> DataFrame:
    """P, S and detection curves by sliding-window prediction: (model, trace_name, p, s, m, error), arrays as long as the trace.

    predict: batches (n, window, 3) to (n, window, 3) or (n, window, 2), in which case the missing detection is 1. It is
    sent to the workers; windows of all traces of an Arrow batch share prediction batches and are stacked inside the task,
    without a shuffle. A trace on which the predictor raises, or whose components are missing or of unequal lengths, has
    null curves and the error; the others keep theirs. Longer traces get a window of noise at both ends, unless `pads` is
    false. Of `keep`, columns that the traces have come along: by the start
    time, curves are placed in time.
    """
    w = np.ones(window) if weights is None else np.asarray(weights, float)
    keep = tuple(c for c in traces.columns if c in keep)
    names = ["model", "trace_name", *keep, "p", "s", "m", "error"]

    def run(batches):
        for pdf in batches:
            rows = [(row.trace_name, _channels(row, order)) for row in pdf.itertuples(index=False)]
            got = [_curve_row(*r) for r in _predicted(rows, predict, window, step, batch_size, w, tolerance, seed, pads)]
            yield pd.DataFrame([(model, name, *(pdf[c].iat[i] for c in keep), *r) for i, ((name, _), r) in enumerate(zip(rows, got))], columns=names)

    return traces.select("trace_name", *keep, *order.lower()).mapInPandas(run, _curve_schema(traces, keep))


def failures(curves: DataFrame, stage: str = "classify") -> DataFrame:
    """Traces that prediction gave up on: (model, trace_name, stage, error), what summaries and failure tallies take."""
    return curves.filter("error IS NOT NULL").select("model", "trace_name", F.lit(stage).alias("stage"), "error")


def smoothed(x: np.ndarray, width: int) -> np.ndarray:
    """Centred moving average; near the ends, of the samples that are there."""
    if width <= 1 or not len(x):
        return x
    total = np.concatenate([[0.0], np.cumsum(x)])
    i = np.arange(len(x))
    lo, hi = np.maximum(i - width // 2, 0), np.minimum(i + width - width // 2, len(x))
    return (total[hi] - total[lo]) / (hi - lo)


def refine(curves: DataFrame, traces: DataFrame, predict: Predictor, on: float = 0.3, off: float = 0.3, window: int = 6000, lead_s: float = 5.0, smooth_s: float = 0.1, rate: float = 100.0, order: str = "ENZ", keep_if_lower: bool = True) -> DataFrame:
    """Predicts again from lead_s before each trigger of the smoothed detection and takes the new curves for [on, off).

    With keep_if_lower, a stretch stays as it was where the new mean detection is lower than the old. Triggers and old
    means are those of the given curves, whatever has been replaced before. A trace whose prediction raises has its error
    and null curves. Curves and traces meet in one join by trace_name.
    """
    lead, width = round(lead_s * rate), max(1, round(smooth_s * rate))

    def run(batches):
        for pdf in batches:
            out = []
            for row in pdf.itertuples(index=False):
                x = _channels(row, order, "x_")
                if row.error is not None or isinstance(x, Exception):
                    out.append((row.model, row.trace_name, None, None, None, row.error or f"{type(x).__name__}: {x}"))
                    continue
                old = np.stack([np.array(row.p, float), np.array(row.s, float), np.array(row.m, float)], axis=1)
                new, error = old.copy(), None
                try:
                    for a, b in trigger_onsets(smoothed(old[:, 2], width), on, off):
                        lo = max(a - lead, 0)
                        hi = min(b, lo + window, len(old))
                        if hi <= a:
                            continue
                        part = np.zeros((1, window, x.shape[1]))
                        part[0, : len(x[lo : lo + window])] = x[lo : lo + window]
                        y = _ones_for_detection(np.asarray(predict(standardized(part)), float))[0, a - lo : hi - lo]
                        if not keep_if_lower or y[:, 2].mean() >= old[a:hi, 2].mean():
                            new[a:hi] = y
                except Exception as raised:  # as in prediction: only this trace is lost
                    new, error = None, f"{type(raised).__name__}: {raised}"
                out.append((row.model, row.trace_name, *_curve_row(new, error)))
            yield pd.DataFrame(out, columns=["model", "trace_name", "p", "s", "m", "error"])

    error = F.col("error") if "error" in curves.columns else F.lit(None).cast("string")
    wide = curves.select("model", "trace_name", "p", "s", "m", error.alias("error")).join(traces.select("trace_name", *(F.col(c).alias(f"x_{c}") for c in order.lower())), "trace_name")
    return wide.mapInPandas(run, f"model string, trace_name string, {CURVES}")


def fill_places(fast: np.ndarray, slow: np.ndarray, fast_threshold: float, slow_threshold: float, least: int, coverage: float) -> np.ndarray:
    """Samples to fill, by the two detection curves: inside runs of `least` samples or more at which the slow one reaches
    its threshold, if the fast one reaches its own on less than `coverage` of the run, those on which it doesn't."""
    there, seen = fast >= fast_threshold, np.concatenate([[False], slow >= slow_threshold, [False]])
    fill = np.zeros(len(fast), bool)
    steps = np.flatnonzero(seen[1:] != seen[:-1])
    for a, b in zip(steps[::2], steps[1::2]):
        if b - a >= least and there[a:b].mean() < coverage:
            fill[a:b] = ~there[a:b]
    return fill


def dual_pass(traces: DataFrame, predict: Predictor, fast_threshold: float = 0.3, slow_threshold: float = 0.25, window: int = 6000, step: int = 1000, rate: float = 100.0, slow_rate: float = 50.0, least_s: float = 8.0, coverage: float = 0.7, batch_size: int = 32, model: str = "dual", order: str = "ENZ", tolerance: int = 100, seed: int = 42) -> DataFrame:
    """Curves at full rate, with all three filled where a pass at the slow rate sees a long event that the fast one misses.

    Both passes run in the same Arrow step: one row in, one out. Where to fill is decided by the detection curves alone,
    and there each curve becomes the larger of both. `step` is in samples of either pass.
    """
    from fractions import Fraction

    ratio = Fraction(slow_rate / rate).limit_denominator(MAX_DENOMINATOR)
    w, least = np.ones(window), max(1, round(least_s * rate))

    def run(batches):
        for pdf in batches:
            rows = [(row.trace_name, _channels(row, order)) for row in pdf.itertuples(index=False)]
            slower = [(n, x if isinstance(x, Exception) else np.stack([resample_array(x[:, c], ratio.numerator, ratio.denominator) for c in range(x.shape[1])], axis=1)) for n, x in rows]
            passes = (_predicted(r, predict, window, step, batch_size, w, tolerance, seed) for r in (rows, slower))
            out = []
            for (name, _), (fast, error), (slow, other) in zip(rows, *passes):
                if error is None and other is None and len(slow):
                    at = np.linspace(0, len(fast) - 1, len(slow))
                    slow = np.stack([np.interp(np.arange(len(fast)), at, slow[:, c]) for c in range(3)], axis=1)
                    fill = fill_places(fast[:, 2], slow[:, 2], fast_threshold, slow_threshold, least, coverage)
                    fast[fill] = np.maximum(fast[fill], slow[fill])
                out.append((model, name, *_curve_row(None if other else fast, error or other)))
            yield pd.DataFrame(out, columns=["model", "trace_name", "p", "s", "m", "error"])

    return traces.select("trace_name", *order.lower()).mapInPandas(run, f"model string, trace_name string, {CURVES}")
