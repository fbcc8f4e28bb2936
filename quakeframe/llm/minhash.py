"""Near-duplicate documents by b-bit MinHash (operator 4).

Each text becomes a set of hashed word shingles. `BANDS * ROWS` minima are taken; bands of full minima give bucket
keys, and of each minimum only the low `BITS` bits are kept, packed in longs. Candidates share a bucket; their
similarity is first estimated from the counts of equal packed cells, corrected for chance collisions of BITS-bit cells,
and whatever the estimate can't rule out by SLACK is confirmed on the full sets.

Texts with equal sets are one class from the start. In each bucket, every class is first compared with one representative.
Only buckets whose classes are then still in different components are looked at again: tasks get packed signatures only,
whole buckets or pairs of blocks of BLOCK rows, and return the pairs that these leave as possible if they are few for the
rows, else just the rows. Sets are made for what has been named by then. Pairs are confirmed by joins; rows are compared in
tasks that return the edges of stars that join components, fewer than the rows they got. So no bucket is ever expanded into
all its pairs, and a set travels for candidates only.
At the default similarity 0.8, 24 bands of 4 rows miss a linking pair with probability (1 - 0.8^4)^24 = 3e-6
(2e-8 at 0.85).
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quakeframe.llm.common import cut, fresh, quoted, text_chunks
from quakeframe.llm.tokens import distinct, mix, row_reduce, windows, words

BANDS, ROWS, BITS = 24, 4, 4
LONGS = BANDS * ROWS * BITS // 64
SLACK = 0.22  # six standard deviations of the estimate from 96 cells
BLOCK = 512  # rows of a large bucket that are compared in one task with another such block
GROUP = 1 << 18  # shingles of small buckets, or of a block, that a task holds at once
PAIRS = 2  # possible pairs for each row up to which a bucket's pairs are returned
CELLS = 1 << 20  # rows of 64 bits each that the broadcast table of wanted ids has at most
_LOW = 0x1111111111111111

_rng = np.random.Generator(np.random.PCG64(7))
_A = _rng.integers(1, 2**63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _rng.integers(0, 2**63, BANDS * ROWS, dtype=np.uint64)


def _sets(raw, off, size):
    hashes, at, _, _ = words(raw, off)
    return distinct(*windows(hashes, at, size))


def _node(values, at):
    """128 bits that stand for a set: two sums of independently mixed members."""
    one = row_reduce(np.add, mix(values ^ np.uint64(0xA5A5A5A5A5A5A5A5)), at, 0)
    two = row_reduce(np.add, mix(values + np.uint64(0x1234567890ABCDEF)), at, 0)
    return np.stack([one, two], 1)


def _signer(size: int):
    schema = pa.schema([("doc_id", pa.int64()), ("text_hash", pa.int64()), ("n_shingles", pa.int64()), ("node", pa.binary()), ("bands", pa.list_(pa.int64())), ("cells", pa.list_(pa.int64()))])

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, raw, off in text_chunks(batch.column("text")):
                values, at = _sets(raw, off, size)
                minima = np.empty((hi - lo, BANDS * ROWS), np.uint64)
                for k in range(BANDS * ROWS):
                    minima[:, k] = row_reduce(np.minimum, mix_light(values, _A[k], _B[k]), at, 0)
                grouped = minima.reshape(hi - lo, BANDS, ROWS)
                keys = np.full((hi - lo, BANDS), 0, np.uint64)
                for j in range(ROWS):
                    keys = mix(keys * np.uint64(31) + grouped[:, :, j] + np.arange(BANDS, dtype=np.uint64))
                low = (mix(minima) & np.uint64(15)).reshape(hi - lo, LONGS, 16)
                packed = np.bitwise_or.reduce(low << (np.arange(16, dtype=np.uint64) * np.uint64(BITS)), axis=2)
                node = _node(values, at)
                flat = lambda m: pa.ListArray.from_arrays(np.arange(0, m.size + 1, m.shape[1], dtype=np.int32), pa.array(np.ascontiguousarray(m).reshape(-1).view(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id")[lo:hi], batch.column("text_hash")[lo:hi], pa.array(np.diff(at)), pa.array([x.tobytes() for x in node], pa.binary()), flat(keys), flat(packed)], schema=schema)

    return sign


def mix_light(values: np.ndarray, a: np.uint64, b: np.uint64) -> np.ndarray:
    """One of a family of multiply-and-fold permutations of already mixed values."""
    h = values * a
    h += b
    h ^= h >> np.uint64(32)
    return h


def _set_maker(size: int):
    schema = pa.schema([("label", pa.int64()), ("node", pa.binary()), ("made", pa.binary()), ("members", pa.list_(pa.int64()))])

    def make(batches):
        for batch in batches:
            for lo, hi, raw, off in text_chunks(batch.column("text")):
                values, at = _sets(raw, off, size)
                made = pa.array([x.tobytes() for x in _node(values, at)], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column("label")[lo:hi], batch.column("node")[lo:hi], made, pa.ListArray.from_arrays(at.astype(np.int32), pa.array(values.view(np.int64)))], schema=schema)

    return make


def estimate(a: str, b: str):
    """Similarity from two packed signatures: equal cells by bit counts, corrected for collisions of BITS-bit cells."""
    differing = []
    for i in range(LONGS):
        x = F.col(a)[i].bitwiseXOR(F.col(b)[i])
        x = x.bitwiseOR(F.shiftrightunsigned(x, 2))
        x = x.bitwiseOR(F.shiftrightunsigned(x, 1)).bitwiseAND(F.lit(_LOW))
        differing.append(F.bit_count(x))
    equal = 1 - reduce(lambda p, q: p + q, differing) / F.lit(float(BANDS * ROWS))
    chance = 2.0**-BITS
    return (equal - chance) / (1 - chance)


def _alike(percent: int):
    """What sizes and signatures of the sides a and b leave as possible."""
    sizes = F.lit(100) * F.least("n_a", "n_b") >= F.lit(percent) * F.greatest("n_a", "n_b")
    return sizes & (estimate("cells_a", "cells_b") >= percent / 100 - SLACK)


def _reached(near: np.ndarray) -> Iterator[np.ndarray]:
    """Connected sets of two or more rows of a symmetric boolean matrix, each with its first row in front."""
    left = near.any(axis=1)
    while left.any():
        seen = np.zeros(len(near), bool)
        front = np.array([int(np.argmax(left))])
        while len(front):
            seen[front] = True
            front = np.flatnonzero(near[front].any(axis=0) & ~seen)
        left &= ~seen
        yield np.flatnonzero(seen)


def _shared(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all pairwise intersections of a few sets, by products of membership columns."""
    sizes = [len(x) for x in sets]
    _, column, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    often = counts > 1
    place = np.cumsum(often) - 1
    row, column = np.repeat(np.arange(len(sets)), sizes)[often[column]], place[column[often[column]]]
    total = np.zeros((len(sets), len(sets)), np.float32)
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    for lo in range(0, int(often.sum()), 4096):
        x, y = np.searchsorted(column, (lo, lo + 4096))
        has = np.zeros((len(sets), 4096), np.float32)
        has[row[x:y], column[x:y] - lo] = 1
        total += has @ has.T
    return np.rint(total).astype(np.int64)


def _possible(rows: pd.DataFrame, percent: int) -> np.ndarray:
    """Which rows of a bucket, in different components, may be alike by their sizes and signatures."""
    chance, low = 2.0**-BITS, np.uint64(_LOW)
    cells, n, component = np.stack(rows["cells"].to_numpy()).view(np.uint64), rows["n"].to_numpy(), rows["component"].to_numpy()
    differing = np.zeros((len(rows), len(rows)), np.int64)
    for k in range(LONGS):
        x = cells[:, k][:, None] ^ cells[:, k][None, :]
        x |= x >> np.uint64(2)
        differing += np.bitwise_count((x | (x >> np.uint64(1))) & low)
    near = ((1 - differing / (BANDS * ROWS)) - chance) / (1 - chance) >= percent / 100 - SLACK
    return near & (100 * np.minimum(n[:, None], n) >= percent * np.maximum(n[:, None], n)) & (component[:, None] != component)


def _candidates(percent: int, most: int):
    """What signatures leave as possible in buckets: pairs (a, b), or rows (a, null, key) where pairs are more than `most` a row.

    Pairs with a bucket's representative have been looked at before.
    """

    def candidates(pdf: pd.DataFrame) -> pd.DataFrame:
        pairs, named = set(), []
        for key, rows in pdf.groupby("key", sort=False):
            rows = rows.drop_duplicates("label")
            if rows["component"].nunique() < 2:
                continue
            near, label = _possible(rows, percent), rows["label"].to_numpy()
            first = rows["first"].to_numpy(bool)
            near[first] = near[:, first] = False
            if near.sum() <= 2 * most * len(rows):
                a, b = np.nonzero(np.triu(near))
                pairs |= {(min(x, y), max(x, y)) for x, y in zip(label[a].tolist(), label[b].tolist())}
            else:
                named += [(x, None, key) for x in label[near.any(axis=1)].tolist()]
        got = [(a, b, None) for a, b in sorted(pairs)] + named
        return pd.DataFrame({name: pd.array([x[i] for x in got], "Int64") for i, name in enumerate(("a", "b", "key"))})  # never as floats

    return candidates


def _bucket_links(rows: pd.DataFrame, percent: int) -> Iterator[tuple[int, int]]:
    """What links the components of some of a bucket's rows: edges of stars, fewer than there are rows."""
    if rows["component"].nunique() < 2:
        return
    near, n = _possible(rows, percent), rows["n"].to_numpy()
    some = np.flatnonzero(near.any(axis=1))
    if len(some):
        shared = _shared([rows["members"].iat[i] for i in some])
        union = n[some][:, None] + n[some] - shared
        label = rows["label"].to_numpy()[some]
        for reached in _reached(near[np.ix_(some, some)] & (100 * shared >= percent * union)):
            for other in reached[1:]:
                yield label[reached[0]], label[other]


def _links(percent: int):
    def links(pdf: pd.DataFrame) -> pd.DataFrame:
        edges = {e for _, rows in pdf.groupby("key", sort=False) for e in _bucket_links(rows.drop_duplicates("label"), percent)}
        return pd.DataFrame(sorted(edges), columns=["a", "b"], dtype="int64")

    return links


def _confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    side = lambda s: sets.select(F.col("label").alias(s), F.col("members").alias(f"set_{s}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    shared = F.size(F.array_intersect("set_a", "set_b"))
    union = F.size("set_a") + F.size("set_b") - shared
    return both.filter(F.lit(100) * shared >= F.lit(percent) * union).select("a", "b")


def components(edges: DataFrame) -> DataFrame:
    """Connected components of `edges` (a, b): rows (label, component), component being the smallest label.

    Each round takes the smallest parent around a vertex, then jumps to that parent's parent, so that chains shrink by
    doubling; rounds end when nothing changes. Sums and minima are combined before any shuffle.
    """
    ways = F.array(F.struct(F.col("a").alias("v"), F.col("b").alias("w")), F.struct(F.col("b").alias("v"), F.col("a").alias("w")))
    both = cut(edges.select(F.explode(ways).alias("x")).select("x.*").distinct())  # a union of both would make the edges twice
    state = cut(both.groupBy("v").agg(F.min("w").alias("m")).select("v", F.least("v", "m").alias("p")))
    while True:
        around = both.join(state.select(F.col("v").alias("w"), "p"), "w").groupBy("v").agg(F.min("p").alias("q"))
        hooked = state.join(around, "v").select("v", F.least("p", "q").alias("p"), F.col("p").alias("old"))
        up = state.select(F.col("v").alias("p"), F.col("p").alias("r"))
        new = cut(hooked.join(up, "p", "left").select("v", F.least("p", F.coalesce("r", "p")).alias("p"), "old"))
        changed = not new.filter("p <> old").isEmpty()
        state = new.select("v", "p")
        if not changed:
            return state.toDF("label", "component")


def _sets_of(wanted: DataFrame, classes: DataFrame, docs: DataFrame, size: int) -> DataFrame:
    """Sets (label, members) of the wanted labels, made again from the texts of one document of each.

    A broadcast table of the bits of wanted ids, of CELLS rows at most, lets hardly any other text into the shuffle while
    there are fewer than some ten million; beyond that more texts pass it, and the join decides.
    """
    ids = cut(classes.select("label", "node", F.col("id").alias("doc_id")).join(wanted, "label", "left_semi"))
    h = F.xxhash64("doc_id")
    cell, bit = F.shiftrightunsigned(h, 6).bitwiseAND(F.lit(CELLS - 1)), h.bitwiseAND(F.lit(63)).cast("int")
    table = ids.select(cell.alias("cell"), bit.alias("bit")).groupBy("cell").agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("bit"))).alias("bits"))
    texts = docs.withColumn("cell", cell).join(F.broadcast(table), "cell").filter(F.bit_get("bits", bit) == 1).select("doc_id", "text")
    made = texts.join(ids, "doc_id").select("label", "node", "text").mapInArrow(_set_maker(size), "label long, node binary, made binary, members array<long>")
    return cut(made.filter("node = made").groupBy("label").agg(F.first("members").alias("members")))  # all of a label are equal


def _linked(classes: DataFrame, docs: DataFrame, percent: int, size: int) -> DataFrame:
    """Edges (a, b) between labels of classes that join what links join: each confirmed on full sets."""
    keyed = classes.select("label", "n", F.explode("bands").alias("key"))
    shared = keyed.groupBy("key").agg(F.min("label").alias("rep"), F.count("*").alias("rows"), F.sum("n").alias("shingles")).filter("rows > 1")
    members = cut(keyed.join(shared, "key"))
    cells = classes.select("label", "n", "cells")
    side = lambda s: cells.select(F.col("label").alias(s), F.col("n").alias(f"n_{s}"), F.col("cells").alias(f"cells_{s}"))
    star = members.filter("label <> rep").select(F.col("rep").alias("a"), F.col("label").alias("b")).distinct()
    star = cut(star.join(side("a"), "a").join(side("b"), "b").filter(_alike(percent)).select("a", "b"))
    named = lambda pairs: pairs.select(F.explode(F.array("a", "b")).alias("label")).filter("label IS NOT NULL").distinct()
    sets = _sets_of(named(star), classes, docs, size)
    links = cut(_confirm(star, sets, percent))
    first = components(links)

    placed = members.join(first, "label", "left").withColumn("component", F.coalesce("component", "label"))
    mixed = placed.groupBy("key").agg(F.min("component").alias("x"), F.max("component").alias("y")).filter("x <> y").select("key")
    blocks = F.greatest(F.ceil(F.col("rows") / BLOCK), F.ceil(F.col("shingles") / GROUP)).cast("int")
    bucket = F.struct("key", blocks.alias("blocks"), (F.col("label") == F.col("rep")).alias("first"))
    # A label has BANDS buckets at most; its signature and set are joined to it once.
    placed = placed.join(mixed, "key", "left_semi").groupBy("label").agg(F.first("n").alias("n"), F.first("component").alias("component"), F.collect_list(bucket).alias("buckets"))
    placed = cut(placed.join(classes.select("label", "cells"), "label"))
    small = placed.select("n", F.explode("buckets").alias("x")).filter("x.blocks = 1").agg(F.sum("n").alias("n"), F.count("*").alias("rows")).first()
    groups = max(1, -(-(small["n"] or 0) // GROUP), -(-small["rows"] // (2 * BLOCK)))
    rest = cut(_dealt(placed, groups).groupBy("of", "i", "j").applyInPandas(_candidates(percent, PAIRS), "a long, b long, key long"))

    more = named(rest).join(sets.select("label"), "label", "left_anti")
    sets = sets.union(_sets_of(more, classes, docs, size))
    pairs = rest.filter("b IS NOT NULL").select("a", "b").distinct()
    dense = rest.filter("b IS NULL").groupBy(F.col("a").alias("label")).agg(F.collect_set("key").alias("keys"))
    dense = placed.join(dense, "label").join(sets, "label").withColumn("buckets", F.filter("buckets", lambda x: F.array_contains("keys", x["key"]))).drop("keys")
    dense = _dealt(dense, groups).groupBy("of", "i", "j").applyInPandas(_links(percent), "a long, b long")
    return links.union(_confirm(pairs, sets, percent)).union(dense)


def _dealt(placed: DataFrame, groups: int) -> DataFrame:
    """Rows of labels in each of their buckets, dealt to what one task compares, (of, i, j): small buckets to `groups`
    groups, large ones to pairs of their blocks."""
    rows = placed.select(*(c for c in placed.columns if c != "buckets"), F.explode("buckets").alias("x")).select("*", "x.*").drop("x")
    few = rows.filter("blocks = 1").withColumns({"of": F.pmod(F.xxhash64("key"), F.lit(groups)), "i": F.lit(0), "j": F.lit(0)})
    many = rows.filter("blocks > 1").withColumn("block", F.pmod(F.xxhash64("label"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    many = many.withColumns({"of": F.col("key"), "i": F.least("block", "other"), "j": F.greatest("block", "other")}).drop("block", "other")
    return few.unionByName(many)


def _grouped(docs: DataFrame, percent: int, size: int) -> DataFrame:
    """Every row's doc_id, text_hash and n_shingles, with its component's label and smallest doc_id, null where alone."""
    docs = docs.select(F.col("doc_id").cast("long"), "text", F.xxhash64("text").alias("text_hash"))
    schema = "doc_id long, text_hash long, n_shingles long, node binary, bands array<long>, cells array<long>"
    signed = cut(docs.mapInArrow(_signer(size), schema))
    placed = signed.filter("n_shingles > 0 AND doc_id IS NOT NULL")
    classes = placed.groupBy("node").agg(F.min("doc_id").alias("id"), F.min_by(F.struct(F.col("n_shingles").alias("n"), "bands", "cells"), "doc_id").alias("x"))
    classes = cut(classes.select(F.monotonically_increasing_id().alias("label"), "node", "id", "x.*"))

    # A doc_id on texts with different sets joins their classes.
    several = placed.groupBy("doc_id").agg(F.min("node").alias("x"), F.max("node").alias("y")).filter("x <> y").select("doc_id")
    own = placed.select("doc_id", "node").join(several, "doc_id", "left_semi").join(classes.select("node", "label"), "node").select("doc_id", F.col("label").alias("b")).distinct()
    own = own.join(own.groupBy("doc_id").agg(F.min("b").alias("a")), "doc_id").filter("a <> b").select("a", "b")

    found = components(_linked(classes, docs.select("doc_id", "text"), percent, size).union(own))
    names = classes.select("node", "id", "label").join(found, "label", "left").withColumn("component", F.coalesce("component", "label"))
    least = names.groupBy("component").agg(F.min("id").alias("component_id"))
    names = names.join(least, "component").select(F.col("node").alias("of"), "component", "component_id")
    mine = (F.col("node") == F.col("of")) & (F.col("n_shingles") > 0) & F.col("doc_id").isNotNull()
    return signed.select("doc_id", "text_hash", "n_shingles", "node").join(names, mine, "left").drop("node", "of")


def near_duplicates(docs: DataFrame, percent: int = 80, size: int = 5) -> DataFrame:
    """Groups documents whose sets of `size`-word shingles overlap by `percent` of their union or more.

    Reads doc_id and text; other columns, whatever their names, don't matter. Returns doc_id, n_shingles, component_id
    (the smallest doc_id reachable over links), kept (doc_id = component_id): one row per input row. Words are runs of
    anything but ASCII white space, A-Z lower-cased; a text of fewer than `size` words has its whole sequence as its
    shingle. Null and empty texts have no shingles and are linked with nothing. Rows with a null doc_id stand alone,
    with component_id null and kept true. Repeated rows are equal sets, hence one component; each is returned. Rows that
    share a doc_id but not their text are one document: what either is linked with is one component. Very long texts are
    hashed whole. An empty table gives an empty result.
    """
    component = F.coalesce("component_id", "doc_id")
    return _grouped(docs, percent, size).select("doc_id", "n_shingles", component.alias("component_id"), component.eqNullSafe(F.col("doc_id")).alias("kept"))


def keep_one(docs: DataFrame, percent: int = 80, size: int = 5) -> DataFrame:
    """One row of each group that `near_duplicates` finds, with all its columns, whatever their names.

    It is that of the smallest doc_id, of several texts the one with the smallest hash, of repeated rows the first by the
    other columns. Rows without words stay once for each doc_id and text; rows with a null doc_id all stay.
    """
    found = _grouped(docs, percent, size).filter("doc_id IS NOT NULL")
    kept = found.filter("component IS NOT NULL").groupBy("component").agg(F.min(F.struct("doc_id", "text_hash")).alias("x")).select("x.*")
    kept = kept.union(found.filter("component IS NULL").select("doc_id", "text_hash").distinct())
    doc_id, text_hash, own_hash, rank = fresh(docs, "doc_id", "text_hash", "own_hash", "rank")
    # Repeated rows are told apart before the join, so that each task sends one of its own copies on, however many there are.
    order = [quoted(c) for c, kind in docs.dtypes if c not in ("doc_id", "text") and "map<" not in kind and kind != "variant"]
    first = F.row_number().over(Window.partitionBy("doc_id", own_hash).orderBy(*order, "text"))
    named = docs.filter("doc_id IS NOT NULL").withColumn(own_hash, F.xxhash64("text")).withColumn(rank, first).filter(quoted(rank) == 1)
    named = named.join(kept.toDF(doc_id, text_hash), (F.col("doc_id") == F.col(doc_id)) & (F.col(own_hash) == F.col(text_hash)), "left_semi").drop(own_hash, rank)
    return named.union(docs.filter("doc_id IS NULL"))
