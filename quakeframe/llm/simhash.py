"""Near-duplicate documents by SimHash and pivot distance tables (operator 13).

A text's fingerprint has a bit for each of 64 places, set if over half of its shingles' hashes have it. Equal fingerprints
are one class from the start. Two fingerprints at most `BITS` bits apart agree on some `AGREE` of `PARTS` parts of their
bits, so each class goes to one bucket for every choice of AGREE parts, and a pair that links meets in one of them.

In a bucket, a table of each fingerprint's Hamming distances to `PIVOTS` reference fingerprints decides: the distances of
two fingerprints to the same pivot differ by no more than they themselves do, so a pair with a coordinate further apart
than BITS is discarded, pivot by pivot, and only survivors are compared. The pivots are rows of a Hadamard matrix, so that
they are 32 bits from each other and no two coordinates tell the same; for unlike fingerprints each discards some 4 in 10.

Small buckets share tasks; one of over BLOCK classes is compared as pairs of its blocks. Tasks return the edges of a
spanning forest of what they linked, fewer than the rows they got, never all pairs of a group.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quakeframe.llm.common import cut
from quakeframe.llm.minhash import components

BITS, PARTS, AGREE, PIVOTS = 4, 6, 2, 24
SIZE, SEED = 4, 42
BLOCK = 1024  # classes of a large bucket that are compared in one task with another such block
GROUP = 1 << 17  # classes of small buckets that a task holds at once
UNPACK = 1 << 14  # hashes whose bits are counted at once
PIECE = 1 << 20  # bytes of a text whose words are held at once
_GAP = re.compile(rb"[\x20\x09-\x0D]")

_i = np.arange(64, dtype=np.uint64)
_WALSH = (np.bitwise_count(np.arange(1, PIVOTS + 1, dtype=np.uint64)[:, None] & _i) & 1).astype(np.uint64)
#: Reference fingerprints: bit i of pivot p is the parity of the bits that i and p share.
REFERENCES = np.bitwise_or.reduce(_WALSH << _i, axis=1)


def shingle_hashes(text: bytes, size: int = SIZE, piece: int = PIECE) -> Iterator[np.ndarray]:
    """XXH64 of a text's shingles, repeats included, of about `piece` bytes at a time."""
    digest = xxhash.xxh64_intdigest
    carried, at, several = [], 0, False
    while at < len(text):
        gap = _GAP.search(text, min(at + piece, len(text)))
        end = gap.end() if gap else len(text)
        words = carried + text[at:end].lower().split()  # of bytes: A-Z only, and at ASCII white space only
        at, n = end, len(words)
        if n < size:
            carried = words
            continue
        joined, ends = b" ".join(words), np.cumsum([len(w) + 1 for w in words]) - 1
        starts = np.concatenate([[0], ends[:-1] + 1])[: n - size + 1].tolist()
        yield np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts, ends[size - 1 :].tolist())), np.uint64, n - size + 1)
        carried, several = words[n - size + 1 :], True
    if carried and not several:
        yield np.array([digest(b" ".join(carried), SEED)], np.uint64)


def fingerprint(text: bytes, size: int = SIZE, piece: int = PIECE) -> int:
    """The bits that over half of the shingles' hashes have; 0 without words."""
    counts, n = np.zeros(64, np.int64), 0
    for hashes in shingle_hashes(text, size, piece):
        n += len(hashes)
        for lo in range(0, len(hashes), UNPACK):
            some = hashes[lo : lo + UNPACK].astype(">u8").view(np.uint8).reshape(-1, 8)
            counts += np.unpackbits(some, axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > n).tobytes(), "big")


def _fingerprints(size: int):
    schema = pa.schema([("doc_id", pa.int64()), ("f", pa.int64())])

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint((x.as_py() or "").encode(), size) for x in batch.column("text")], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found.view(np.int64))], schema=schema)

    return made


def _parts() -> list[int]:
    """Masks of the parts of a fingerprint."""
    edges = [round(64 * k / PARTS) for k in range(PARTS + 1)]
    return [(1 << hi) - (1 << lo) for lo, hi in zip(edges, edges[1:])]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _keyed(classes: DataFrame) -> DataFrame:
    """A row (f, t, bits) for each bucket of each class: choice t of parts, and the bits there."""
    masks = [_signed(sum(chosen)) for chosen in combinations(_parts(), AGREE)]
    ways = F.array(*(F.struct(F.lit(t).alias("t"), F.col("f").bitwiseAND(F.lit(m)).alias("bits")) for t, m in enumerate(masks)))
    return classes.select("f", F.explode(ways).alias("x")).select("f", "x.*")


def distance_table(f: np.ndarray) -> np.ndarray:
    """Hamming distances of fingerprints to the references, a row for each reference."""
    return np.stack([np.bitwise_count(f ^ p) for p in REFERENCES]).astype(np.int8)


def survivors(a: np.ndarray, b: np.ndarray, f: np.ndarray, table: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Of pairs of places (a, b), those at `bits` bits or fewer: pivots discard, then the distance itself decides."""
    for row in table:
        near = np.abs(row[a] - row[b]) <= bits
        a, b = a[near], b[near]
        if not len(a):
            return a, b
    linked = np.bitwise_count(f[a] ^ f[b]) <= bits
    return a[linked], b[linked]


class _Forest:
    """Which places are joined already; `edges` are those that joined two."""

    def __init__(self, n: int):
        self.up, self.edges = list(range(n)), []

    def top(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = x = self.up[self.up[x]]
        return x

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        for x, y in zip(a.tolist(), b.tolist()):
            p, q = self.top(x), self.top(y)
            if p != q:
                self.up[p] = q
                self.edges.append((x, y))


def _links(bits: int):
    def links(pdf: pd.DataFrame) -> pd.DataFrame:
        """Edges that join what links join among rows of equal (t, bits), and of two blocks i and j of a large bucket."""
        i, j = int(pdf["i"].iat[0]), int(pdf["j"].iat[0])
        pdf = pdf.sort_values(["t", "bits"], kind="stable")
        f = pdf["f"].to_numpy().view(np.uint64)
        table, forest = distance_table(f), _Forest(len(f))
        if i == j:  # whole buckets: each row with the next, the next but one, and so on
            new = np.ones(len(f), bool)
            new[1:] = (np.diff(pdf["t"].to_numpy()) != 0) | (np.diff(pdf["bits"].to_numpy()) != 0)
            ends = np.append(np.flatnonzero(new)[1:], len(f))[np.cumsum(new) - 1]
            a, step = np.arange(len(f)), 1
            while len(a := a[a + step < ends[a]]):
                forest.join(*survivors(a, a + step, f, table, bits))
                step += 1
        else:
            block = pdf["block"].to_numpy()
            left, right = np.flatnonzero(block == i), np.flatnonzero(block == j)
            for x in left:
                forest.join(*survivors(np.full(len(right), x), right, f, table, bits))
        edges = np.array(forest.edges, np.int64).reshape(-1, 2)
        named = f.view(np.int64)
        return pd.DataFrame({"a": named[edges[:, 0]], "b": named[edges[:, 1]]})

    return links


def _linked(classes: DataFrame, bits: int) -> DataFrame:
    """Edges (a, b) between fingerprints that join what links join."""
    keyed = _keyed(classes)
    large = keyed.groupBy("t", "bits").agg(F.count("*").alias("n")).filter(F.col("n") > BLOCK)
    large = cut(large.select("t", "bits", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks")))
    groups = max(1, -(-classes.count() * len(list(combinations(range(PARTS), AGREE))) // GROUP))
    # Few buckets are large, and none where fingerprints spread; Spark looks at the size before it broadcasts them.
    placed = keyed.join(large, ["t", "bits"], "left")
    few = placed.filter("blocks IS NULL").withColumns({"of": F.pmod(F.xxhash64("t", "bits"), F.lit(groups)), "block": F.lit(0), "i": F.lit(0), "j": F.lit(0)})
    many = placed.filter("blocks IS NOT NULL").withColumn("block", F.pmod(F.xxhash64("f"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    many = many.withColumns({"of": F.xxhash64("t", "bits"), "i": F.least("block", "other"), "j": F.greatest("block", "other")}).drop("other")
    dealt = few.drop("blocks").withColumn("large", F.lit(False)).unionByName(many.drop("blocks").withColumn("large", F.lit(True)))
    return dealt.groupBy("large", "of", "i", "j").applyInPandas(_links(bits), "a long, b long")


def near_duplicates(docs: DataFrame, bits: int = BITS, size: int = SIZE) -> DataFrame:
    """Groups documents whose fingerprints differ in `bits` bits or fewer, 4 at most.

    Reads doc_id and text; other columns, whatever their names, don't matter. Returns doc_id, fingerprint (16 lowercase hex
    digits) and component_id (the smallest doc_id reachable over links, the row's own included): one row per input row.
    Words are runs of anything but ASCII white space, A-Z lower-cased; shingles are `size` words joined by a space, repeats
    included; a text of fewer words is one shingle. Null, empty and blank texts have fingerprint zero and are linked like any
    other. Rows with a null doc_id stand alone, with component_id null. Repeated rows have equal fingerprints, hence one
    component; each is returned. Rows that share a doc_id but not their text are one document: what either is linked with is
    one component. Very long texts are hashed whole, their bits counted piece by piece. An empty table gives an empty result.
    """
    if not 0 <= bits <= BITS:
        raise ValueError(f"bits must be from 0 to {BITS}: buckets are made for no more")
    signed = cut(docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_fingerprints(size), "doc_id long, f long"))
    placed = signed.filter("doc_id IS NOT NULL")
    classes = cut(placed.groupBy("f").agg(F.min("doc_id").alias("id")))
    several = placed.groupBy("doc_id").agg(F.min("f").alias("a"), F.max("f").alias("b")).filter("a <> b")
    own = placed.join(several, "doc_id").filter("f <> a").select("a", F.col("f").alias("b")).distinct()
    found = components(_linked(classes, bits).union(own)).withColumnRenamed("label", "f")
    names = classes.join(found, "f", "left").withColumn("component", F.coalesce("component", "f"))
    names = names.join(names.groupBy("component").agg(F.min("id").alias("component_id")), "component").select("f", "component_id")
    named = signed.join(names.withColumnRenamed("f", "of"), (F.col("f") == F.col("of")) & F.col("doc_id").isNotNull(), "left")
    return named.select("doc_id", F.lower(F.lpad(F.hex("f"), 16, "0")).alias("fingerprint"), "component_id")
