"""Encoded lengths of whole texts, and what an exact histogram of them answers (operator 7)."""

from __future__ import annotations

import base64

import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quakeframe.llm.common import cut

#: The rank file is read by the driver and sent to the tasks; it is never copied into the repository.
RANKS = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
#: Fixed value: the public pattern that splits text before byte-pair merges of such rank files.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
LIMITS = tuple(2**k for k in range(7, 18))
BUCKET = 1024

_encodings: dict[str, tiktoken.Encoding] = {}


def _encoding(data: bytes) -> tiktoken.Encoding:
    """One encoding for each worker and rank file."""
    name = f"ranks-{hash(data)}"
    if name not in _encodings:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, data.splitlines())}
        _encodings[name] = tiktoken.Encoding(name, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _encodings[name]


def encoded_lengths(docs: DataFrame, ranks: str = RANKS) -> DataFrame:
    """(doc_id, n_tokens) of every whole text; null and empty texts have no tokens."""
    with open(ranks, "rb") as file:
        shared = docs.sparkSession.sparkContext.broadcast(file.read())

    def measure(batches):
        encode = _encoding(shared.value).encode_ordinary
        for batch in batches:
            lengths = [len(encode(text.as_py() or "")) for text in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(lengths, pa.int64())], names=["doc_id", "n_tokens"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(measure, "doc_id long, n_tokens long")


def context_totals(lengths: DataFrame, limits: tuple[int, ...] = LIMITS) -> DataFrame:
    """For every context limit what a histogram of n_tokens answers: one row per distinct length and per given limit.

    Returns context_limit, n_docs (of just that length), n_fitting (that length or less), n_longer, n_tokens (of all
    texts), truncated_tokens (if every text were cut at the limit), lost_tokens, quantile (the share that fits).
    Lengths are exact. Sums over longer texts are taken in buckets of BUCKET lengths, then over buckets, so that no
    window holds the whole histogram. Rows with null n_tokens don't count; an empty table gives zeros for the limits.
    """
    spark = lengths.sparkSession
    given = spark.range(1).select(F.explode(F.array(*(F.lit(x).cast("long") for x in limits))).alias("n_tokens"), F.lit(0).cast("long").alias("docs"))
    counted = lengths.filter("n_tokens IS NOT NULL").groupBy("n_tokens").agg(F.count("*").alias("docs"))
    bins = cut(counted.union(given).groupBy("n_tokens").agg(F.sum("docs").alias("docs"))).withColumn("bucket", F.floor(F.col("n_tokens") / BUCKET))
    tokens = F.col("n_tokens") * F.col("docs")
    above = bins.groupBy("bucket").agg(F.sum("docs").alias("d"), F.sum(tokens).alias("t"))  # a row per BUCKET lengths
    later = Window.orderBy(F.desc("bucket")).rowsBetween(Window.unboundedPreceding, -1)
    later = above.select("bucket", *(F.coalesce(F.sum(c).over(later), F.lit(0)).alias(f"{c}_later") for c in ("d", "t")))
    total = bins.agg(F.coalesce(F.sum("docs"), F.lit(0)).alias("all_docs"), F.coalesce(F.sum(tokens), F.lit(0)).alias("all_tokens"))
    inside = Window.partitionBy("bucket").orderBy(F.desc("n_tokens")).rowsBetween(Window.unboundedPreceding, -1)
    out = bins.select("*", *(F.coalesce(F.sum(c).over(inside), F.lit(0)).alias(n) for c, n in ((F.col("docs"), "d_here"), (tokens, "t_here"))))
    out = out.join(later, "bucket").crossJoin(total)  # one row of totals
    longer, longer_tokens = F.col("d_here") + F.col("d_later"), F.col("t_here") + F.col("t_later")
    truncated = F.col("all_tokens") - longer_tokens + longer * F.col("n_tokens")
    return out.select(
        F.col("n_tokens").alias("context_limit"), F.col("docs").alias("n_docs"), (F.col("all_docs") - longer).alias("n_fitting"), longer.alias("n_longer"), F.col("all_tokens").alias("n_tokens"),
        truncated.alias("truncated_tokens"), (F.col("all_tokens") - truncated).alias("lost_tokens"), F.when(F.col("all_docs") > 0, (F.col("all_docs") - longer) / F.col("all_docs")).alias("quantile"),
    )


def length_quantiles(totals: DataFrame, shares: tuple[float, ...] = (0.5, 0.9, 0.95, 0.99)) -> DataFrame:
    """Of `context_totals`, the least length that holds each share of the texts: (share, length), null without texts."""
    least = [F.struct(F.lit(float(q)).alias("share"), F.min(F.when((F.col("quantile") >= q) & (F.col("n_docs") > 0), F.col("context_limit"))).alias("length")) for q in shares]
    return totals.agg(F.array(*least).alias("x")).select(F.explode("x").alias("x")).select("x.*")


def token_counts(docs: DataFrame, ranks: str = RANKS, limits: tuple[int, ...] = LIMITS) -> DataFrame:
    """`context_totals` of every whole text's encoded length. Repeated rows count each; null ids count like others. Very
    long texts are encoded whole; other columns don't matter."""
    return context_totals(encoded_lengths(docs, ranks), limits)
