"""Splits and samples that don't depend on partitioning: every draw is a function of a row's key."""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType
from pyspark.sql.window import Window

from quakeframe.operators.lineage import cut

SPLITS = ("train", "val", "test")
#: Names in a split column, by the names of draws.
RENAMED = {"train": "train", "val": "dev", "test": "test"}


def check_proportions(p_train: float, p_val: float) -> None:
    if not 0 < p_train < 1 or p_val < 0 or p_train + p_val >= 1:
        raise ValueError(f"proportions must be 0 < train < 1, val >= 0 and train + val < 1: {p_train}, {p_val}")


def choose(u: Column, p_train: float, p_val: float) -> Column:
    """Split of a number in [0, 1)."""
    check_proportions(p_train, p_val)
    return F.when(u < p_train, "train").when(u < p_train + p_val, "val").otherwise("test")


def sha_unit(key: Column, salt: str) -> Column:
    """A number in [0, 1] from the first 13 hexadecimal digits (52 bits) of SHA-256 of 'salt|key'; built-in functions only."""
    head = F.substring(F.sha2(F.concat(F.lit(salt + "|"), key), 256), 1, 13)
    return F.conv(head, 16, 10).cast("bigint") / F.lit(float(2**52))


@F.pandas_udf(DoubleType())
def _blake_unit(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else int.from_bytes(hashlib.blake2s(t.encode(), digest_size=8).digest(), "big") / 2**64)


def hash_split(df: DataFrame, key: str, salt: str, p_train: float = 0.7, p_val: float = 0.15, algo: str = "blake2s", column: str = "split") -> DataFrame:
    """Split by key: BLAKE2s of 'salt|key' (8 bytes, big-endian, over 2^64), or with algo='sha2' by built-in functions.

    The digest of BLAKE2s is made once per distinct key, in Arrow batches, and joined back. A salt with '|' is refused.
    """
    check_proportions(p_train, p_val)
    if "|" in salt:
        raise ValueError("a salt can't hold '|'")
    if algo == "sha2":
        return df.withColumn(column, choose(sha_unit(F.col(key), salt), p_train, p_val))
    keys = df.select(key).filter(F.col(key).isNotNull()).distinct()
    keys = keys.withColumn("split_unit", _blake_unit(F.concat(F.lit(salt + "|"), F.col(key).cast("string")))).select(key, choose(F.col("split_unit"), p_train, p_val).alias(column))
    return df.join(keys, key, "left")


def bernoulli_unit(seed: int, key: Column) -> Column:
    """A draw in [0, 1) for each key and seed; the same under any partitioning, unlike a generator's order."""
    return F.pmod(F.xxhash64(F.lit(seed), key), F.lit(2**52)) / F.lit(float(2**52))


def row_index(df: DataFrame, order: Sequence[str], column: str = "row_index") -> DataFrame:
    """`df` with each row's place, from 0, in the order of some columns, which should leave no ties.

    Rows are sorted over ranges and kept at a checkpoint, so that their places can't change between counting and numbering;
    a place is that within the range and the sizes of the ranges before, of which there is one number each.
    """
    kept = cut(df.sort(*order).withColumn(column, F.monotonically_increasing_id()))
    part = F.shiftright(column, 33)
    sizes = kept.groupBy(part.alias("part")).agg((F.max(column).bitwiseAND((1 << 33) - 1) + 1).alias("size"))
    before = F.coalesce(F.sum("size").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row for each range
    sizes = sizes.select(F.col("part").alias("index_part"), before.alias("index_before"))
    return kept.join(F.broadcast(sizes), part == F.col("index_part")).withColumn(column, F.col("index_before") + F.col(column).bitwiseAND((1 << 33) - 1)).drop("index_part", "index_before")


def ordered_unit(seed: int, index: Column) -> Column:
    """The index-th draw in [0, 1) of the generator that `seed` begins (PCG64), as if all before it had been drawn in turn.

    Each run of consecutive indexes in a batch jumps to its first draw, so that any partitioning gives the same draws.
    """

    @F.pandas_udf(DoubleType())
    def drawn(indexes: pd.Series) -> pd.Series:
        at, out = indexes.to_numpy(np.int64), np.zeros(len(indexes))
        begins = np.flatnonzero(np.diff(at, prepend=at[:1] - 2) != 1)
        for a, b in zip(begins, [*begins[1:], len(at)]):
            state = np.random.PCG64(seed)
            state.advance(int(at[a]))
            out[a:b] = np.random.Generator(state).random(b - a)
        return pd.Series(out)

    return drawn(index)


def assign_split_in_order(df: DataFrame, order: Sequence[str], key: str = "source_id", salt: str = "split-v1", p_train: float = 0.7, p_val: float = 0.15, seed: int = 42, algo: str = "blake2s", column: str = "split") -> DataFrame:
    """`assign_split` with the draws of one generator, one for each row without a usable key, in the order of some columns."""
    usable = F.coalesce((F.trim(F.col(key)) != "") & (F.col(key) != "nan"), F.lit(False))
    hashed = hash_split(df.filter(usable), key, salt, p_train, p_val, algo, column)
    drawn = row_index(df.filter(~usable), order, "draw_index").withColumn(column, choose(ordered_unit(seed, F.col("draw_index")), p_train, p_val)).drop("draw_index")
    return hashed.select(*df.columns, column).unionByName(drawn.select(*df.columns, column)).replace({k: v for k, v in RENAMED.items() if k != v}, subset=[column])


def assign_split(df: DataFrame, key: str = "source_id", row_key: str = "trace_name", salt: str = "split-v1", p_train: float = 0.7, p_val: float = 0.15, seed: int = 42, algo: str = "blake2s", column: str = "split") -> DataFrame:
    """Split by key where it is a non-blank string, else by a draw for the row; 'val' is called 'dev'.

    With algo='sha2' both come from SHA-256, draws with the seed for a salt.
    """
    usable = (F.trim(F.col(key)) != "") & (F.lower(F.trim(F.col(key))) != "nan")
    hashed = hash_split(df, key, salt, p_train, p_val, algo, column)
    drawn = choose(sha_unit(F.col(row_key), str(seed)) if algo == "sha2" else bernoulli_unit(seed, F.col(row_key)), p_train, p_val)
    out = hashed.withColumn(column, F.when(F.coalesce(usable, F.lit(False)), F.col(column)).otherwise(drawn))
    return out.replace({k: v for k, v in RENAMED.items() if k != v}, subset=[column])


def year_split(year: Column, train, val, test) -> Column:
    """The first of train, val and test whose years hold the year; NULL if none does."""
    return F.when(year.isin(*train), "train").when(year.isin(*val), "val").when(year.isin(*test), "test")


def split_counts(df: DataFrame, year: str = "year", split: str = "split") -> DataFrame:
    """Rows per year and split, and per split over all years under '_total': grouping sets, one pass."""
    out = df.groupBy(F.col(year).cast("string").alias("year"), F.col(split).alias("split")).agg(F.count("*").alias("n"))
    return out.unionByName(out.groupBy("split").agg(F.sum("n").alias("n")).select(F.lit("_total").alias("year"), "split", "n"))


def sample_n(df: DataFrame, n: int, key: str, seed: int = 42) -> DataFrame:
    """n rows without replacement: those with the smallest hashes of seed and key, a distributed top-k."""
    return df.orderBy(F.md5(F.concat(F.lit(f"{seed}|"), F.col(key).cast("string"))), key).limit(n)


def shard(df: DataFrame, k: int, n: int, key: str) -> DataFrame:
    """Shard k of n by an integer key."""
    return df.filter(F.pmod(F.col(key), F.lit(n)) == k)
