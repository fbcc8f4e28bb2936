"""Best-fit packing into sequences of several permitted lengths (operator 10).

Texts longer than the largest capacity are cut into pieces of it. Pieces are dealt to shards of about SHARD pieces by
hashes of their keys. A shard's lengths are optimised jointly: each menu of permitted lengths that can hold its longest
piece is tried, and the one of the least total cost is taken, so that no single length does better. With a menu, pieces go,
longest first, into the open bin with the least room that holds them; where none does, the size is opened that costs least
for the tokens it can still hold, by what is left to come that fits beside the piece. In the end each bin is brought down to
the smallest permitted length that holds its contents, and it is by these that menus are compared.
"""

from __future__ import annotations

import math
from bisect import bisect_left, insort
from collections.abc import Iterator
from itertools import combinations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quakeframe.llm.common import cut
from quakeframe.llm.lengths import RANKS, encoded_lengths

CAPACITIES = (512, 1024, 2048, 4096, 8192)
SHARD = 8192
#: Permitted lengths at most: a shard tries each set of them.
MOST_CAPACITIES = 8
#: Cost of a sequence beyond its length: once each, and for attention, length squared over QUADRATIC.
EACH, QUADRATIC = 64, 65536
#: Numbers that repeated pieces are given at a time.
COPIES = 1 << 16


def cost(capacity: int) -> float:
    return EACH + capacity + capacity**2 / QUADRATIC


def menus(capacities: tuple[int, ...], longest: int) -> Iterator[tuple[int, ...]]:
    """Sets of permitted lengths with one that holds the longest piece, smaller sets first."""
    for n in range(1, len(capacities) + 1):
        yield from (menu for menu in combinations(capacities, n) if menu[-1] >= longest)


def smallest(used: int, capacities: tuple[int, ...]) -> int:
    return capacities[bisect_left(capacities, used)]


def fit(lengths: list[int], menu: tuple[int, ...], capacities: tuple[int, ...]) -> tuple[float, list[tuple[int, int]], list[int]]:
    """Best fit of lengths, which don't grow, into bins of a menu: (cost, (bin, offset) of each, final capacities)."""
    shrinking = [-n for n in lengths]  # for bisection
    later = [0] * (len(lengths) + 1)  # tokens from a place on
    for i in range(len(lengths) - 1, -1, -1):
        later[i] = later[i + 1] + lengths[i]
    room: list[tuple[int, int]] = []  # (room, bin), sorted
    used: list[int] = []
    place = []
    for i, n in enumerate(lengths):
        at = bisect_left(room, (n, -1))
        if at < len(room):
            left, b = room.pop(at)
        else:
            best = None
            for capacity in menu:
                if capacity >= n:
                    beside = later[max(i + 1, bisect_left(shrinking, n - capacity))]  # of what is no longer than the room
                    held = min(capacity, n + beside)
                    price = cost(smallest(held, capacities)) / held
                    if best is None or price < best[0]:
                        best = price, capacity
            b, left = len(used), best[1]
            used.append(0)
        place.append((b, used[b]))
        used[b] += n
        if left > n:
            insort(room, (left - n, b))
    final = [smallest(u, capacities) for u in used]
    return sum(map(cost, final)), place, final


def pack(lengths: list[int], capacities: tuple[int, ...]) -> list[tuple[int, int, int]]:
    """(bin, offset, final capacity) of each piece by the menu of least cost; equal lengths are taken in the order given."""
    if not lengths:
        return []
    order = sorted(range(len(lengths)), key=lambda i: (-lengths[i], i))
    falling = [lengths[i] for i in order]
    _, place, final = min((fit(falling, menu, capacities) for menu in menus(capacities, falling[0])), key=lambda x: x[0])
    out = [(0, 0, 0)] * len(lengths)
    for i, (b, offset) in zip(order, place):
        out[i] = b, offset, final[b]
    return out


def pack_lengths(lengths: DataFrame, capacities: tuple[int, ...] = CAPACITIES, shard: int = SHARD) -> DataFrame:
    """Packs rows (doc_id, n_tokens): one row per piece.

    Returns doc_id, piece (from 0), start (in the text's tokens), n_tokens (of the piece), bin (a string, unique over
    all shards), bin_offset, bin_capacity. A text without tokens, or of null length, has one row with n_tokens 0 and no bin.
    Repeated rows are numbered, and packed like others, as are null ids. Shards and the order within them depend on the
    rows alone, not on how they are partitioned. A very long text is many pieces. An empty table gives an empty result.
    ValueError for more than MOST_CAPACITIES lengths.
    """
    capacities = tuple(sorted(set(capacities)))
    if len(capacities) > MOST_CAPACITIES:
        raise ValueError(f"at most {MOST_CAPACITIES} permitted lengths")
    most = capacities[-1]
    rows = lengths.groupBy(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("n_tokens", F.lit(0)).cast("long").alias("all")).agg(F.count("*").alias("rows"))
    # Copies are numbered in runs, so that no array grows with their number.
    rows = rows.withColumn("run", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("rows") - 1) / COPIES))))
    upto = F.least(F.col("rows"), (F.col("run") + 1) * COPIES) - 1
    rows = rows.select("doc_id", "all", F.explode(F.sequence(F.col("run") * COPIES, upto)).alias("copy"))
    pieces = rows.withColumn("piece", F.explode(F.sequence(F.lit(0), F.greatest(F.ceil(F.col("all") / most) - 1, F.lit(0)).cast("int"))))
    start = F.col("piece").cast("long") * most
    pieces = cut(pieces.select("doc_id", "copy", "piece", start.alias("start"), F.least(F.lit(most).cast("long"), F.col("all") - start).alias("n_tokens")))
    shards = max(1, math.ceil(pieces.filter("n_tokens > 0").count() / shard))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["known", "doc_id", "piece", "n_tokens", "copy"]).reset_index(drop=True)
        got = pack(pdf["n_tokens"].tolist(), capacities)
        name = f"{int(pdf['shard'].iloc[0])}-"
        return pdf[["known", "doc_id", "piece", "start", "n_tokens"]].assign(bin=[f"{name}{b}" for b, _, _ in got], bin_offset=[o for _, o, _ in got], bin_capacity=[c for _, _, c in got])

    schema = "known boolean, doc_id long, piece int, start long, n_tokens long, bin string, bin_offset long, bin_capacity long"
    full = pieces.filter("n_tokens > 0").withColumn("shard", F.pmod(F.xxhash64("doc_id", "piece", "n_tokens", "copy"), F.lit(shards)))
    # A null would turn a column of ids into floating-point numbers, which don't hold all of them.
    full = full.withColumns({"known": F.col("doc_id").isNotNull(), "doc_id": F.coalesce("doc_id", F.lit(0).cast("long"))})
    packed = full.groupBy("shard").applyInPandas(run, schema).withColumn("doc_id", F.when(F.col("known"), F.col("doc_id"))).drop("known")
    none = pieces.filter("n_tokens <= 0").select("doc_id", "piece", "start", "n_tokens", F.lit(None).cast("string").alias("bin"), F.lit(None).cast("long").alias("bin_offset"), F.lit(None).cast("long").alias("bin_capacity"))
    return packed.unionByName(none)


def pack_documents(docs: DataFrame, ranks: str = RANKS, capacities: tuple[int, ...] = CAPACITIES, shard: int = SHARD) -> DataFrame:
    """`pack_lengths` of every whole text's encoded length; columns other than doc_id and text don't matter."""
    return pack_lengths(encoded_lengths(docs, ranks), capacities, shard)
