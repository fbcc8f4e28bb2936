"""Continuous jobs: windowed summaries, gating in time, annotation of packets, and incremental scoring."""

from __future__ import annotations

import pickle
import uuid
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from quakeframe.operators.spectral import Predictor, _ones_for_detection, standardized


def stream_windows(packets: DataFrame, key: str, time: str = "ts", value: str = "value", window: str = "60 seconds", step: str = "10 seconds", late: str = "2 minutes") -> DataFrame:
    """Sliding windows per key over a stream of packets: n, mean, deviation and peak; packets later than `late` are dropped."""
    w = F.window(time, window, step)
    out = packets.withWatermark(time, late).groupBy(w, key).agg(F.count("*").alias("n"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"), F.max(F.abs(value)).alias("peak"))
    return out.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), key, "n", "mean", "std", "peak")


#: How rows travel as text through a function with state.
_EXACT = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}


# --- gating ------------------------------------------------------------------------------------------------------


#: Buckets of traces that share a state.
GATE_BUCKETS = 1024


def inside(trace: np.ndarray, a: np.ndarray, b: np.ndarray, box: np.ndarray) -> np.ndarray:
    """Which rows are places `a` in any interval of their trace, both ends inclusive; where `box`, a row is the interval a to b.

    The farthest end of those that have begun decides.
    """
    code = pd.factorize(trace)[0]
    order = np.lexsort((~box, a, code))
    farthest = pd.Series(np.where(box, b, np.iinfo(np.int64).min)[order]).groupby(code[order]).cummax().to_numpy()
    found = np.zeros(len(a), bool)
    found[order] = farthest >= a[order]
    return found & ~box


def stream_gate(picks: DataFrame, boxes: DataFrame, late: str = "10 minutes", buckets: int = GATE_BUCKETS) -> DataFrame:
    """Picks of a stream inside any detection box of their trace, both ends inclusive.

    picks: trace_name, ts, …; boxes: box_trace, box_start, box_end. Rows later than `late` are dropped. State is kept by
    buckets of traces, which are looked at together: a box until the watermark has passed its end, however long it is, and
    a pick until its trace's boxes that begin before it must have come. A bucket that nothing comes for is cleared when the
    watermark has passed half of what it holds. A pick without a trace or time is in no box.
    """
    names = [c for c in picks.columns if c not in ("trace_name", "ts")]
    told = picks.filter("trace_name IS NOT NULL AND ts IS NOT NULL").select("trace_name", F.col("ts").alias("at"), F.lit(None).cast("timestamp").alias("upto"), F.struct(F.lit(1).alias("_"), *names).alias("pick"))
    seen = boxes.filter("box_trace IS NOT NULL AND box_end >= box_start").select(F.col("box_trace").alias("trace_name"), F.col("box_start").alias("at"), F.col("box_end").alias("upto"), F.lit(None).cast(told.schema["pick"].dataType).alias("pick"))
    both = told.union(seen).withWatermark("at", late)
    micros = both.select(
        F.pmod(F.xxhash64("trace_name"), F.lit(buckets)).cast("int").alias("bucket"), "trace_name", "at", F.unix_micros("at").alias("a"), F.coalesce(F.unix_micros("upto"), F.unix_micros("at")).alias("b"),
        F.col("upto").isNotNull().alias("box"), F.when(F.col("upto").isNull(), F.to_json(F.struct("pick"), _EXACT)).alias("pick"),
    )
    key, columns = both.schema["trace_name"].dataType.simpleString(), ["trace_name", "a", "b", "box", "pick"]

    def step(bucket, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = [pickle.loads(state.get[0])] if state.exists else []
        rows = pd.concat(held + [pdf[columns] for pdf in batches], ignore_index=True).astype({"a": np.int64, "b": np.int64, "box": bool})
        trace, a, b, box, pick = (rows[c].to_numpy() for c in columns)
        found = inside(trace, a, b, box)
        now = state.getCurrentWatermarkMs() * 1000
        stays = ~found & (b >= now)
        if stays.any():
            state.update((pickle.dumps(rows[stays].reset_index(drop=True)),))
            ends = np.sort(b[stays])
            state.setTimeoutTimestamp(max(now, int(ends[len(ends) // 2])) // 1000 + 1)
        else:
            state.remove()
        yield pd.DataFrame({"trace_name": trace[found], "a": a[found], "pick": pick[found]})

    gated = micros.groupBy("bucket").applyInPandasWithState(step, f"trace_name {key}, a long, pick string", "held binary", "append", GroupStateTimeout.EventTimeTimeout)
    kind = told.schema["pick"].dataType.simpleString()
    return gated.select("trace_name", F.timestamp_micros("a").alias("ts"), F.from_json("pick", f"pick {kind}", _EXACT).alias("x")).select("trace_name", "ts", "x.pick.*").select(*picks.columns)


# --- annotation --------------------------------------------------------------------------------------------------


#: Samples that are annotated at once, or four windows if these are more.
PIECE = 1 << 16


class Segment:
    """Samples without a break of one station, of which no more than the last window and what follows it is held.

    `feed` takes packets in order, `curves` gives what no later window can change, `close` the rest. Windows begin every
    `step` samples from the segment's first, and the last one ends with its last sample, as in batch annotation.
    """

    def __init__(self, at: int, channels: int):
        self.first = self.held = self.next = at
        self.x, self.total, self.weight = np.zeros((0, channels)), np.zeros((0, 3)), np.zeros(0)
        self.fed, self.n, self.last = [], 0, None  # packets that aren't joined with the samples yet, their length, the last sample
        self.error: str | None = None

    @property
    def end(self) -> int:
        return self.held + len(self.x) + self.n

    def feed(self, x: np.ndarray) -> None:
        if len(x):
            self.fed.append(x)
            self.n, self.last = self.n + len(x), x[-1]

    def _join(self) -> None:
        """Joins what was fed, once however many packets it came in."""
        if self.n:
            self.x = np.concatenate([self.x, *self.fed])
            self.total = np.concatenate([self.total, np.zeros((self.n, 3))])
            self.weight = np.concatenate([self.weight, np.zeros(self.n)])
            self.fed, self.n = [], 0

    def _predict(self, starts: Sequence[int], predict: Predictor, weights: np.ndarray, batch_size: int) -> None:
        for lo in range(0, len(starts), batch_size):
            some = starts[lo : lo + batch_size]
            try:
                y = _ones_for_detection(np.asarray(predict(standardized(np.stack([self.x[a - self.held : a - self.held + len(weights)] for a in some]))), float))
            except Exception as error:  # a predictor may raise anything, and only this segment is lost
                self.error = f"{type(error).__name__}: {error}"
                return
            for a, one in zip(some, y):
                part = slice(a - self.held, a - self.held + len(weights))
                self.total[part] += one * weights[:, None]
                self.weight[part] += weights

    def _take(self, n: int) -> list[tuple[int, np.ndarray]]:
        if n <= 0:
            return []
        y = self.total[:n] / np.maximum(self.weight[:n], 1e-8)[:, None]
        y[~np.isfinite(y).all(axis=1)] = 0.0
        out = [(self.held, y)]
        self.x, self.total, self.weight, self.held = self.x[n:], self.total[n:], self.weight[n:], self.held + n
        return out if self.error is None else []

    def curves(self, predict: Predictor, weights: np.ndarray, step: int, batch_size: int) -> list[tuple[int, np.ndarray]]:
        self._join()
        window = len(weights)
        ready = range(self.next, self.end - window + 1, step)
        if self.error is None:
            self._predict(ready, predict, weights, batch_size)
        self.next += step * len(ready)
        return self._take(min(self.next, self.end - window) - self.held)

    def close(self, predict: Predictor, weights: np.ndarray, step: int, batch_size: int) -> list[tuple[int, np.ndarray]]:
        out, n = self.curves(predict, weights, step, batch_size), len(self.x)
        if self.end - self.first < len(weights):  # zeros follow
            self.feed(np.zeros((len(weights) - n, self.x.shape[1])))
            self._join()
        last = self.end - len(weights)
        if self.error is None and last != self.next - step:
            self._predict([last], predict, weights, batch_size)
        return out + self._take(n)


def stream_annotate(packets: DataFrame, predict: Predictor, window: int = 6000, step: int = 1000, rate: float = 100.0, gap: int = 0, late: str = "10 minutes", batch_size: int = 32, model: str = "model", order: str = "ENZ", weights: np.ndarray | None = None) -> DataFrame:
    """P, S and detection curves of a stream of packets: (model, trace_name, start, p, s, m, error), in pieces.

    packets: trace_name (a station), ts (of the first sample) and a column of samples for each letter of `order`, of equal
    lengths. Packets may come in any order and more than once, as long as they aren't later than `late`: they are taken in
    the order of their times when the watermark has passed these, and of samples given twice the first packet's count. A
    pause of up to `gap` samples is bridged by straight lines; a longer one ends a segment, and so does the watermark's
    passing of its end. A segment's pieces together are what `annotate` says of its samples without pads; `start` is a
    piece's first sample, counted from 1970 at `rate`. State is the last window of each station, the sums of the windows
    that reach into it, and packets that wait. Where the predictor raises, a segment ends with a row of its error, and null
    curves, instead of further pieces. Packets without a name, a time or samples, or of unequal lengths, are left out.
    """
    w = np.ones(window) if weights is None else np.asarray(weights, float)
    columns = list(order.lower())
    usable = packets.withWatermark("ts", late).filter("trace_name IS NOT NULL AND ts IS NOT NULL")
    for c in columns:
        usable = usable.filter((F.size(c) > 0) & (F.size(c) == F.size(columns[0])))
    placed = usable.select("trace_name", "ts", F.round(F.unix_micros("ts") * F.lit(rate / 1e6)).cast("long").alias("at"), *columns)
    key = placed.schema["trace_name"].dataType.simpleString()
    run = (predict, w, step, batch_size)

    def advance(trace, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        segment, waiting = pickle.loads(state.get[0]) if state.exists else (None, [])
        for pdf in batches:
            waiting += [(row.at, np.stack([np.asarray(getattr(row, c), float) for c in columns], axis=1)) for row in pdf.itertuples(index=False)]
        waiting.sort(key=lambda p: (p[0], len(p[1]), p[1].tobytes()))
        now, out, taken = state.getCurrentWatermarkMs() * rate / 1000, [], 0

        def curves() -> None:
            out.extend((start, *y.T, None) for start, y in segment.curves(*run))

        def close() -> None:
            nonlocal segment
            out.extend((start, *y.T, None) for start, y in segment.close(*run))
            if segment.error is not None:
                out.append((segment.held, None, None, None, segment.error))
            segment = None

        def frame() -> pd.DataFrame:
            return pd.DataFrame([(model, trace[0], *x) for x in out], columns=["model", "trace_name", "start", "p", "s", "m", "error"])

        for at, x in waiting:
            if at >= now:
                break
            taken += 1
            if segment is not None and at - segment.end > gap:
                close()
            if segment is None:
                segment = Segment(at, len(columns))
            pause = at - segment.end
            if pause > 0:
                share = (np.arange(1, pause + 1) / (pause + 1))[:, None]
                segment.feed(segment.last * (1 - share) + x[0] * share)
            segment.feed(x[max(0, -pause) :])
            if segment.n >= max(PIECE, 4 * window):  # a long run is annotated and given in pieces
                curves()
                yield frame()
                out.clear()
        del waiting[:taken]
        if segment is not None:
            if segment.end + gap < now:
                close()
            else:
                curves()
        if waiting or segment is not None:
            state.update((pickle.dumps((segment, waiting)),))
            upto = min(([segment.end + gap] if segment is not None else []) + [waiting[0][0]] * bool(waiting))
            state.setTimeoutTimestamp(int(max(now, upto) * 1000 / rate) + 1)
        else:
            state.remove()
        yield frame()

    schema = f"model string, trace_name {key}, start long, p array<double>, s array<double>, m array<double>, error string"
    return placed.groupBy("trace_name").applyInPandasWithState(advance, schema, "held binary", "append", GroupStateTimeout.EventTimeTimeout)


# --- scoring -----------------------------------------------------------------------------------------------------

#: Buckets of keys that kept rows are written in.
BUCKETS = 64


def runs_upto(n: int) -> list[tuple[int, int]]:
    """The runs of batches 1 to n that are kept: one for each bit of n, the longest first."""
    out, done = [], 0
    for k in reversed(range(n.bit_length())):
        if n >> k & 1:
            out.append((done + 1, done + (1 << k)))
            done += 1 << k
    return out


def kept_rows(spark: SparkSession, path: str, runs: Sequence[tuple[int, int]], schema: str, buckets: Sequence[int] | None = None) -> DataFrame:
    """Rows of some runs, of all or of some buckets; other buckets' files aren't read."""
    df, *more = (spark.read.schema(f"{schema}, bucket int").parquet(f"{path}/rows/{a}-{b}") for a, b in runs)
    for other in more:  # each has partitions of its own
        df = df.union(other)
    return df if buckets is None else df.filter(F.col("bucket").isin(*buckets))


def incremental_score(stream: DataFrame, path: str, checkpoint: str, score, keys: tuple[str, ...] = ("model", "params_hash", "trace_name"), buckets: int = BUCKETS) -> StreamingQuery:
    """Scores what a stream brings, whole for each key however many micro-batches its rows come in; `scores` reads them.

    score: DataFrame to DataFrame with the keys. Rows are kept under path/rows by buckets of keys, in runs of batches: batch
    n is merged with the runs that it completes, as a binary counter carries, so that after n batches there are no more than
    log2(n) + 1 runs and a row has been written as often at most. A batch reads the buckets that its keys are in, no others,
    and scores its keys over all their rows so far, under path/scores. What a batch writes is named by its number and made
    from runs that stay until the next one has begun, so that a batch that runs again replaces its own and a killed run goes
    on where it stopped.
    """

    def add(batch: DataFrame, number: int) -> None:
        spark, n = batch.sparkSession, number + 1
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in batch.schema)
        before, (first, _) = runs_upto(n - 1), runs_upto(n)[-1]
        merged = [r for r in before if r[0] >= first]
        placed = batch.withColumn("bucket", F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int"))
        placed.write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/new/{n}")
        new = spark.read.schema(f"{schema}, bucket int").parquet(f"{path}/new/{n}")
        rows = new.union(kept_rows(spark, path, merged, schema)) if merged else new
        rows.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/rows/{first}-{n}")
        touched = [r["bucket"] for r in new.select("bucket").distinct().collect()]  # `buckets` at most
        history = kept_rows(spark, path, runs_upto(n), schema, touched).drop("bucket")
        score(history.join(new.select(*keys).distinct(), list(keys), "left_semi")).write.mode("overwrite").parquet(f"{path}/scores/batch={number}")
        if n > 1:  # batch n - 1 is complete: what only its own making needed can go
            for a, b in set(runs_upto(n - 2)) - set(before) - set(runs_upto(n)):
                _delete(spark, f"{path}/rows/{a}-{b}")
            _delete(spark, f"{path}/new/{n - 1}")

    return stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _delete(spark: SparkSession, path: str) -> None:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


def scores(spark: SparkSession, path: str, keys: tuple[str, ...] = ("model", "params_hash", "trace_name")) -> DataFrame:
    """The last score of each key that `incremental_score` kept."""
    kept = spark.read.parquet(f"{path}/scores")
    others = [c for c in kept.columns if c not in (*keys, "batch")]
    return kept.groupBy(*keys).agg(F.max_by(F.struct(*others), "batch").alias("x")).select(*keys, "x.*")


def drain(df: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """Runs a stream over all that is there now, to Parquet, and returns what it wrote."""
    query = df.writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", checkpoint).queryName(f"q{uuid.uuid4().hex}").trigger(availableNow=True).start()
    query.awaitTermination()
    return df.sparkSession.read.schema(df.schema).parquet(path)
