"""Hard negatives by LEMP-style coordinate pruning (operator 11).

Rows are dealt to buckets of like length, longest first. A bucket holds, for each coordinate, the sorted list of its rows'
values over their lengths. An anchor that needs a score of t or more needs a cosine of t / (its length * the bucket's
longest) or more there, hence an angle of at most that cosine's; no value of a coordinate can then be further from the
anchor's own than that angle. The anchor's largest coordinates are its focus: each one's feasible range is cut out of its
sorted list, the sets of rows are intersected, and what is left is scored exactly, in integers.

Anchors travel in blocks: each block meets each bucket once, in a task of its own, which returns no more than the best few
of each anchor. The needed scores come from the rows themselves: a positive has to beat the ones that its anchor has in one
of the buckets, a negative lies between its two bounds.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quakeframe.llm.common import cut, discard, shared_folder

SCALE = 256
BUCKET = 2048  # rows of a bucket
BLOCK = 512  # anchors that meet a bucket in one task
FOCUS = 6  # coordinates whose lists are looked at
LONGEST = 2.0**31  # vectors beyond it, scaled, could have scores that no long holds
_NONE = np.iinfo(np.int64).min


def scaled_rows(embeddings: DataFrame) -> DataFrame:
    """Rows (id, label, v) that take part: v is floor(SCALE * x) for each component x, as longs."""
    x = F.col("embedding").cast("array<double>")
    fine = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    label = F.when(F.col("vec_id") % 7 == 0, F.pmod(F.col("label") + 1, F.lit(10))).otherwise(F.col("label"))
    rows = embeddings.filter("vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL").filter(fine)
    length = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, c: s + c * c))
    rows = rows.select(F.col("vec_id").cast("long").alias("id"), label.cast("long").alias("label"), F.transform(x, lambda c: F.floor(c * SCALE).cast("double")).alias("v"))
    return rows.withColumn("length", length).filter(F.col("length") < LONGEST).withColumn("v", F.col("v").cast("array<long>")).distinct()


def _matrix(rows: pd.Series, width: int) -> np.ndarray:
    """Vectors as rows of a matrix; shorter ones end in zeros."""
    out = np.zeros((len(rows), width), np.int64)
    for k, x in enumerate(rows):
        out[k, : len(x)] = x
    return out


def _packed(per: int):
    """Makes a row (part, ids, labels, v, longest) of each `per` rows in a row."""
    schema = pa.schema([("part", pa.int64()), ("ids", pa.list_(pa.int64())), ("labels", pa.list_(pa.int64())), ("v", pa.list_(pa.list_(pa.int64()))), ("longest", pa.float64())])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n, k = [], 0, 0
        partition = TaskContext.get().partitionId()

        def full(rows: pa.Table) -> pa.RecordBatch:
            one = lambda name, kind: pa.array([rows.column(name).to_pylist()], kind)
            return pa.RecordBatch.from_arrays([pa.array([(partition << 32) + k], pa.int64()), one("id", schema.field("ids").type), one("label", schema.field("labels").type), one("v", schema.field("v").type), pa.array([max(rows.column("length").to_pylist())])], schema=schema)

        for batch in batches:
            held.append(batch)
            n += len(batch)
            while n >= per:
                rows = pa.Table.from_batches(held)
                yield full(rows[:per])
                held, n, k = rows[per:].to_batches(), n - per, k + 1
        if n:
            yield full(pa.Table.from_batches(held))

    return pack


_PACKED = "part long, ids array<long>, labels array<long>, v array<array<long>>, longest double"


class Bucket:
    """Rows of like length with their sorted coordinate lists."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, v: np.ndarray):
        self.ids, self.labels, self.v = ids, labels, v
        self.length = np.sqrt((v.astype(float) ** 2).sum(axis=1))
        self.longest = float(self.length.max(initial=0))
        self.unit = v / np.maximum(self.length, 1)[:, None]
        self.order = np.argsort(self.unit, axis=0, kind="stable")
        self.sorted = np.take_along_axis(self.unit, self.order, axis=0)

    def candidates(self, anchor: np.ndarray, least: int, focus: int = FOCUS) -> np.ndarray:
        """Places of a superset of the rows whose score with `anchor` is `least` or more."""
        length = float(np.sqrt((anchor.astype(float) ** 2).sum()))
        if least <= 0:  # no angle is too wide
            return np.arange(len(self.ids))
        if length * self.longest < least * (1 - 1e-9):
            return np.arange(0)
        angle = np.arccos(min(1.0, least / (length * self.longest)))
        unit = anchor / length
        at = np.argsort(-np.abs(unit), kind="stable")[:focus]
        own = np.arccos(np.clip(unit[at], -1, 1))
        low = np.cos(np.minimum(np.pi, own + angle)) - 1e-6
        high = np.cos(np.maximum(0, own - angle)) + 1e-6
        first = [(np.searchsorted(self.sorted[:, c], lo), np.searchsorted(self.sorted[:, c], hi, "right")) for c, lo, hi in zip(at, low, high)]
        order = np.argsort([b - a for a, b in first], kind="stable")  # the shortest list first
        a, b = first[order[0]]
        rows = self.order[a:b, at[order[0]]]
        for k in order[1:]:
            x = self.unit[rows, at[k]]
            rows = rows[(x >= low[k]) & (x <= high[k])]
        return rows

    def scores(self, rows: np.ndarray, anchor: np.ndarray) -> np.ndarray:
        """Exact inner products: in floating point where these are exact, which is much faster, else in integers."""
        if self.longest * float(np.sqrt((anchor.astype(float) ** 2).sum())) < 2.0**52:
            return (self.v[rows].astype(float) @ anchor.astype(float)).astype(np.int64)
        return self.v[rows] @ anchor


def _best(ids: np.ndarray, scores: np.ndarray, n: int) -> np.ndarray:
    """Places of the first n by score, highest first, ties by smaller id."""
    if len(scores) > 8 * n:  # all that tie with the n-th stay
        some = np.flatnonzero(scores >= np.partition(scores, len(scores) - n)[len(scores) - n])
        return some[np.lexsort((ids[some], -scores[some]))[:n]]
    return np.lexsort((ids, -scores))[:n]


def _searched(find, out: list[str]):
    """Runs `find(anchor row, its vector, bucket)` for each anchor of a block with a bucket; it returns tuples of `out`."""

    def search(anchors: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        found = []
        if len(anchors) and len(rows):
            for row in rows.itertuples():
                width = max(map(len, [*row.v, *anchors["v"]]), default=0)
                bucket = Bucket(np.asarray(row.ids, np.int64), np.asarray(row.labels, np.int64), _matrix(row.v, width))
                v = _matrix(anchors["v"], width)
                for k, anchor in enumerate(anchors.itertuples()):
                    found += find(anchor, v[k], bucket)
        return pd.DataFrame(np.array(found, np.int64).reshape(-1, len(out)), columns=out)

    return search


def _positives(n: int):
    def find(anchor, v: np.ndarray, bucket: Bucket) -> list[tuple]:
        same = bucket.labels == anchor.label
        if not same.any():
            return []
        rows = bucket.candidates(v, anchor.least)
        rows = rows[same[rows] & (bucket.ids[rows] != anchor.id)]
        scores = bucket.scores(rows, v)
        return [(anchor.row, bucket.ids[rows[x]], scores[x]) for x in _best(bucket.ids[rows], scores, n)]

    return find


def _negatives(n: int, low: int, high: int):
    def find(anchor, v: np.ndarray, bucket: Bucket) -> list[tuple]:
        wanted = [int(p) for p in anchor.positives if low * int(p) <= high * int(p)]
        if not wanted:
            return []
        rows = bucket.candidates(v, min(-(-low * p // 100) for p in wanted))
        rows = rows[bucket.labels[rows] != anchor.label]
        scores, found = bucket.scores(rows, v), []
        for p in wanted:
            some = np.flatnonzero((scores >= -(-low * p // 100)) & (scores <= high * p // 100))
            found += [(anchor.row, p, bucket.ids[rows[x]], scores[x]) for x in some[_best(bucket.ids[rows[some]], scores[some], n)]]
        return found

    return find


def _meet(anchors: DataFrame, blocks: int, buckets: DataFrame, find, out: list[str]) -> DataFrame:
    """Each block of anchors with each bucket, a pair a task's group: the stated query set, in blocks, against all rows."""
    each = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    left = anchors.join(buckets.select(F.col("part").alias("of"), each.alias("block")), "block").withColumnRenamed("of", "part")
    right = buckets.withColumn("block", each)
    return left.groupBy("block", "part").cogroup(right.groupBy("block", "part")).applyInPandas(_searched(find, out), ", ".join(f"{c} long" for c in out))


def _ranked(found: DataFrame, by: list[str], score: str, ident: str, n: int) -> DataFrame:
    """The first n of each group; Spark keeps no more of a group in any task before the shuffle."""
    return found.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(score), ident))).filter(F.col("rank") <= n)


def hard_negatives(embeddings: DataFrame, positives: int = 5, negatives: int = 10, every: int = 100, low: int = 30, high: int = 90) -> DataFrame:
    """For each anchor and each of its positives, the different-label rows that score highest within its bounds.

    Reads vec_id, embedding and label; other columns don't matter. Rows with a null vec_id, label or vector, or with any null
    or non-finite component, or with a vector longer than 2^31 after scaling, take no part. Repeated rows count once; rows
    that share a vec_id but differ are rows of their own, but not each other's positives. Vectors may differ in size: shorter
    ones end in zeros; empty ones score 0. Where vec_id is divisible by 7 the label becomes (label + 1) % 10. Anchors are the
    rows whose vec_id is divisible by `every`; a positive is one of the first `positives` other rows of its label; a negative
    scores at least `low` and at most `high` hundredths of the positive's score. Returns anchor_id, positive_id, rank,
    negative_id, positive_score, negative_score; an anchor without positives, or a positive without negatives, has no rows.
    An empty table gives an empty result.
    """
    spark = embeddings.sparkSession
    at = f"{shared_folder(spark)}/negatives-{uuid.uuid4().hex}"
    rows = scaled_rows(embeddings)
    rows.write.parquet(f"{at}/rows")
    rows = spark.read.parquet(f"{at}/rows")
    parts = max(1, -(-rows.count() // BUCKET))
    buckets = rows.repartitionByRange(parts, F.desc("length"), "id").sortWithinPartitions(F.desc("length"), "id")
    buckets.mapInArrow(_packed(BUCKET), _PACKED).write.parquet(f"{at}/buckets")
    buckets = spark.read.parquet(f"{at}/buckets")

    anchors = rows.filter(F.col("id") % every == 0).withColumn("row", F.monotonically_increasing_id())
    blocks = -(-parts * BUCKET // (every * BLOCK))
    anchors = cut(anchors.withColumn("block", F.pmod(F.xxhash64("row"), F.lit(blocks)).cast("int")))
    # The scores that an anchor's positives have to beat: its best ones in the bucket of the longest rows.
    first = buckets.orderBy(F.desc("longest"), "part").limit(1)
    blind = anchors.withColumn("least", F.lit(_NONE))
    tried = _meet(blind, blocks, first, _positives(positives), ["row", "positive_id", "positive_score"])
    least = tried.groupBy("row").agg(F.count("*").alias("n"), F.min("positive_score").alias("least")).filter(F.col("n") >= positives).drop("n")
    bound = cut(anchors.join(least, "row", "left").fillna(_NONE, ["least"]))
    found = _meet(bound, blocks, buckets, _positives(positives), ["row", "positive_id", "positive_score"])
    chosen = cut(_ranked(found, ["row"], "positive_score", "positive_id", positives).drop("rank"))

    wanted = anchors.join(chosen.groupBy("row").agg(F.collect_set("positive_score").alias("positives")), "row")
    found = _meet(wanted, blocks, buckets, _negatives(negatives, low, high), ["row", "positive_score", "negative_id", "negative_score"])
    ranked = cut(_ranked(found, ["row", "positive_score"], "negative_score", "negative_id", negatives))
    named = chosen.join(anchors.select("row", F.col("id").alias("anchor_id")), "row").join(ranked, ["row", "positive_score"])
    discard(spark, at)
    return named.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")
