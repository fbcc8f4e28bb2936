"""Toxicity by the nearest labelled examples under exact TF-IDF cosine (operator 9).

Terms are all whole words of a text, A-Z lower-cased, and as terms of their own the first BEGINNING code points of longer
words, so that other forms of a word are near it in any language. The space has a dimension for every term that any
example holds: none is picked by its label and there is no cap. Term frequencies are dampened by logarithm; document
frequencies count all documents; whole words, most of which are rare, weigh WHOLE times as much as beginnings.

The examples are a bounded sample of distinct labelled texts. Their inverted index holds, for each term, the blocks of
BLOCK examples that have it, with the largest weight in each, and below those the postings themselves. A text's blocks are
bounded by the sums of these maxima; the postings of the most promising are added up first, then those of every block
whose bound reaches the NEIGHBOURS-th best cosine. What is left out can't be among the nearest: results are exactly those
of scoring all examples. Votes are weighted by closeness; isotonic regression of the examples' own votes, with each left
out of its own, calibrates them, and the neighbours with their cosines are the evidence.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quakeframe.llm.common import cut, fresh, text_chunks
from quakeframe.llm.quality import pool, remainder, single_labels
from quakeframe.llm.tokens import ALNUM, LOWER, row_reduce, rows_of, run_hashes, spans

#: Code points of a longer word that are a term beside it, and what a whole word's weight is multiplied by.
BEGINNING, WHOLE = 4, 0.25
#: Distinct labelled texts that serve as examples at most.
SAMPLE = 8_000
NEIGHBOURS, BLOCK = 25, 256
#: Examples of which the best one stands for all when the k-th best is estimated.
GROUP = 32
#: Share of the blocks that are scored before bounds are compared with what has been found.
FIRST = 1 / 2
#: Every how many examples a term's list has to hold to be kept as a full row, and how many texts such rows are multiplied with at once.
LONG, BATCH = 24, 128
#: How many examples have their weights made at once.
SOME = 512
#: More than a cosine of single precision can be wrong by: some thousand additions of 2 ** -24 each.
SLACK = 1e-4


def terms(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all terms, with repeats, and each one's row: words', which are even, then beginnings', which are odd."""
    low = LOWER[raw]
    starts, ends, at = spans(low, off, ALNUM[low])
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    first = np.flatnonzero((low & 0xC0) != 0x80)  # bytes that begin a code point
    beyond = np.append(first, np.full(BEGINNING, len(low)))[np.searchsorted(first, starts) + BEGINNING]
    longer, row = beyond < ends, rows_of(at)
    words = run_hashes(low, starts, ends) & ~np.uint64(1)
    beginnings = run_hashes(low, starts[longer], beyond[longer]) | np.uint64(1)
    return np.concatenate([words, beginnings]).view(np.int64), np.concatenate([row, row[longer]])


def counted(values: np.ndarray, row: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct values of each row in order, how often each occurs, and the rows' offsets into them."""
    order = np.lexsort((values, row))
    v, r = values[order], row[order]
    new = np.ones(len(v), bool)
    new[1:] = (v[1:] != v[:-1]) | (r[1:] != r[:-1])
    begins = np.flatnonzero(new)
    return v[new], np.diff(np.append(begins, len(v))), np.searchsorted(r[new], np.arange(rows + 1))


class Vocabulary:
    """Places of hashes in a sorted list of distinct ones: a table by their highest bits says where to begin to look."""

    BITS = 20

    def __init__(self, values: np.ndarray):
        self.values = values
        self.begin = np.searchsorted(values >> (64 - self.BITS), np.arange(-(1 << (self.BITS - 1)), (1 << (self.BITS - 1)) + 1))

    def __len__(self) -> int:
        return len(self.values)

    def places(self, values: np.ndarray) -> np.ndarray:
        """Each value's place, or -1."""
        cell = (values >> (64 - self.BITS)) + (1 << (self.BITS - 1))
        out, at, end, left = np.full(len(values), -1), self.begin[cell], self.begin[cell + 1], np.arange(len(values))
        while len(left := left[at[left] < end[left]]):
            found = self.values[at[left]] == values[left]
            out[left[found]] = at[left[found]]
            left = left[~found]
            at[left] += 1
        return out


def vectors(raw: np.ndarray, off: np.ndarray, vocabulary: Vocabulary):
    """Places in the vocabulary of the terms of each row that it holds, their counts, and the rows' offsets."""
    values, row = terms(raw, off)
    place = vocabulary.places(values)
    known = place >= 0
    held = np.sort(row[known] * max(len(vocabulary), 1) + place[known])
    begins = np.flatnonzero(np.append(True, held[1:] != held[:-1])[: len(held)])
    row, term = np.divmod(held[begins], max(len(vocabulary), 1))
    return term, np.diff(np.append(begins, len(held))), np.searchsorted(row, np.arange(len(off)))


def _read_examples(batches):
    kinds = {"key": pa.int64(), "doc_id": pa.int64(), "share": pa.float64()}
    schema = pa.schema([*kinds.items(), ("terms", pa.list_(pa.int64())), ("counts", pa.list_(pa.int32()))])
    for batch in batches:
        for lo, hi, raw, off in text_chunks(batch.column("text")):
            t, n, at = counted(*terms(raw, off), hi - lo)
            lists = (pa.ListArray.from_arrays(at.astype(np.int32), pa.array(x)) for x in (t, n.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([*(batch.column(c)[lo:hi] for c in kinds), *lists], schema=schema)


def _distinct_terms(batches):
    """The terms of a partition's examples, each once."""
    found = np.zeros(0, np.int64)
    for batch in batches:
        found = np.union1d(found, _flat(batch.column("terms"))[0])
    yield pa.RecordBatch.from_arrays([pa.array(found)], names=["term"])


def _placed(vocabulary):
    """Examples with the places of their terms, which are half as long as the terms, in the sorted vocabulary."""

    def place(batches):
        known = vocabulary.value
        for batch in batches:
            terms, at = _flat(batch.column("terms"))
            places = np.searchsorted(known, terms).astype(np.int32)
            lists = pa.ListArray.from_arrays(at.astype(np.int32), pa.array(places))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("key", "doc_id", "share")), lists, batch.column("counts")], names=["key", "doc_id", "share", "places", "counts"])

    return place


def _document_frequencies(vocabulary):
    """How many texts of a partition hold each term: one small table for each partition."""

    def count(batches):
        known, total = Vocabulary(vocabulary.value), np.zeros(len(vocabulary.value), np.int64)
        for batch in batches:
            for _, _, raw, off in text_chunks(batch.column("text")):
                total += np.bincount(vectors(raw, off, known)[0], minlength=len(total))
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(total[held])], names=["term", "n"])
        pa.default_memory_pool().release_unused()  # the worker lives on, and has the index next

    return count


def _ranges(starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """The places of all ranges, one after the other."""
    return np.repeat(starts - (np.cumsum(lens) - lens), lens) + np.arange(lens.sum())


class Index:
    """Inverted lists of examples: terms, their blocks with the largest weight in each, and the blocks' postings.

    Weights are kept in single precision, as what is broadcast goes to every executor; they are added up in double.
    Examples are put in order by the commonest term that they hold and by their number of terms, so that a block's
    examples are of one language and length and its bounds are close. Lists of every LONG-th example or more are kept
    as full rows: they reach into every block.
    """

    def __init__(self, term: np.ndarray, count: np.ndarray, at: np.ndarray, df: np.ndarray, n_docs: int, share: np.ndarray, keys: np.ndarray, ids: np.ndarray, scale: float | np.ndarray = 1.0):
        self.idf = np.log((1 + n_docs) / (1 + np.minimum(df, n_docs))) * scale
        lens = np.diff(at)
        common = np.empty(len(df), np.int64)
        common[np.argsort(df, kind="stable")] = np.arange(len(df))
        order = np.lexsort((keys, lens, row_reduce(np.maximum, common[term], at, -1)))
        self.share, self.keys, self.ids, self.size = share[order], keys[order], ids[order], len(order)
        self.width, self.blocks = BLOCK, -(-self.size // BLOCK)
        taken = _ranges(at[:-1][order], lens[order])
        term, count = term[taken], count[taken]
        del taken
        row = np.repeat(np.arange(self.size, dtype=np.int32), lens[order])
        w, begins = np.empty(len(term), np.float32), np.append(0, np.cumsum(lens[order]))
        for lo in range(0, self.size, SOME):  # in double for some examples at a time
            hi = min(lo + SOME, self.size)
            part = slice(begins[lo], begins[hi])
            w[part] = self.weights(term[part], count[part], row[part] - lo, hi - lo)
        del count
        long = np.bincount(term, minlength=len(df)) * LONG >= max(self.size, 1)
        self.long = np.full(len(df), -1)
        held = np.flatnonzero(long)
        self.long[held[np.argsort(-df[held], kind="stable")]] = np.arange(len(held))  # the commonest term's list is the first
        some = long[term]
        self.shape = self.blocks * self.width, int(long.sum())
        self.entries = self.long[term[some]].astype(np.int32), row[some], w[some]
        # Other postings by term, then by row, in whose order they are: a term's blocks are runs of them.
        listed = np.flatnonzero(~some)
        listed = listed[np.argsort(term[listed], kind="stable")]
        term, self.row, self.weight = term[listed], row[listed], w[listed]
        del listed, row, w, some
        place = term * np.int64(max(self.blocks, 1)) + self.row // self.width
        begins = np.flatnonzero(np.append(True, place[1:] != place[:-1])[: len(place)])
        place = place[begins]
        self.posting_at = np.append(begins, len(term)).astype(np.int32)
        self.most = np.maximum.reduceat(self.weight, begins) if len(begins) else np.zeros(0, np.float32)
        self.block = (place % max(self.blocks, 1)).astype(np.int32)
        self.block_at = np.searchsorted(place, np.arange(len(df) + 1) * max(self.blocks, 1)).astype(np.int32)

    @cached_property
    def full(self) -> np.ndarray:
        """The long lists side by side, a row for each example, made where they are used and in single precision as they are."""
        rows = np.zeros(self.shape, np.float32)
        rows[self.entries[1], self.entries[0]] = self.entries[2]
        return rows

    def __getstate__(self) -> dict:
        return {k: x for k, x in vars(self).items() if k != "full"}

    def weights(self, term: np.ndarray, count: np.ndarray, row: np.ndarray, rows: int) -> np.ndarray:
        """TF-IDF weights, frequencies dampened by logarithm, of unit length for each row."""
        w = (1 + np.log(count)) * self.idf[term]
        length = np.sqrt(np.bincount(row, w**2, minlength=rows))[row]
        return np.divide(w, length, out=np.zeros(len(w)), where=length > 0)

    def search(self, term: np.ndarray, count: np.ndarray, at: np.ndarray, rows, k: int = NEIGHBOURS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For each of `rows` of the given vectors, the places and cosines of the k nearest examples, best first.

        Cosines are rounded to six places, so that the order of addition doesn't break ties; these go by the index's
        order. Examples without a common term are never neighbours.
        """
        w = self.weights(term, count, rows_of(at), len(at) - 1)
        asked = [(self.long[term[at[r] : at[r + 1]]], term[at[r] : at[r + 1]], w[at[r] : at[r + 1]]) for r in rows]
        # Texts whose commonest term is the same, those of a language, are multiplied together with the lists that they have.
        order = sorted(range(len(asked)), key=lambda i: asked[i][0][asked[i][0] >= 0].min(initial=self.shape[1]))
        found = [None] * len(asked)
        for lo in range(0, len(order), BATCH):
            some = order[lo : lo + BATCH]
            long = np.zeros((len(some), self.shape[1]))
            for i, r in enumerate(some):
                place, _, x = asked[r]
                long[i, place[place >= 0]] = x[place >= 0]
            lists = np.flatnonzero(long.any(axis=0))
            if 2 * len(lists) > self.shape[1]:
                near = long.astype(np.float32) @ self.full.T
            else:
                near = long[:, lists].astype(np.float32) @ self.full.take(lists, axis=1).T
            for r, v, part in zip(some, long, near):
                place, t, x = asked[r]
                found[r] = self._nearest(v, part, t[place < 0], x[place < 0], k)
        yield from found

    def _nearest(self, long: np.ndarray, near: np.ndarray, term: np.ndarray, w: np.ndarray, k: int):
        """`near`: what the long lists, whose weights are `long`, add up to in single precision. The others are looked at by blocks.

        Cosines that are made from `near` say which examples to look at, and SLACK is more than they are wrong by; those
        that may be among the k best have theirs added up once more, in double.
        """
        lens = self.block_at[term + 1] - self.block_at[term]
        there = _ranges(self.block_at[term], lens)
        weight, block = np.repeat(w, lens), self.block[there]
        bound = near.reshape(-1, self.width).max(axis=1) + np.bincount(block, weight * self.most[there], minlength=self.blocks)
        order = np.argsort(-bound, kind="stable")[: np.count_nonzero(bound)]
        n = max(int(len(order) * FIRST), -(-k // self.width))
        listed = self._listed(order[:n], there, block, weight)
        total = near + listed  # of blocks that aren't looked at less than they have
        least = self._least(total, k)
        rest = order[n:]
        rest = rest[bound[rest] >= least - SLACK]
        if len(rest):
            listed = listed + self._listed(rest, there, block, weight)
            total = near + listed
            least = self._least(total, k)
        rows = np.flatnonzero((total >= least) & (total > 0))
        if len(rows) > k:
            rows = rows[total[rows] >= np.partition(total[rows], len(rows) - k)[len(rows) - k] - SLACK]
        exact = np.round(self.full[rows].astype(float) @ long + listed[rows], 6)
        best = np.lexsort((rows, -exact))[:k]
        best = best[exact[best] > 0]
        return rows[best], exact[best]

    @staticmethod
    def _least(total: np.ndarray, k: int) -> float:
        """What the k-th best reaches at least: as many runs of GROUP places have a best one that does."""
        best = total[: len(total) // GROUP * GROUP].reshape(-1, GROUP).max(axis=1)
        return np.partition(best, len(best) - k)[len(best) - k] - SLACK if len(best) >= k else 0.0

    def _listed(self, blocks: np.ndarray, there: np.ndarray, block: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """What the postings of the given blocks add up to for each place."""
        chosen = np.zeros(self.blocks, bool)
        chosen[blocks] = True
        some = np.flatnonzero(chosen[block])
        runs = there[some]
        begins = self.posting_at[runs]
        lens = self.posting_at[runs + 1] - begins
        postings = _ranges(begins, lens)
        return np.bincount(self.row[postings], np.repeat(weight[some], lens) * self.weight[postings], minlength=self.shape[0])

    def vote(self, places: np.ndarray, cosines: np.ndarray) -> float:
        """Share of the label among the neighbours, weighted by the squares of their cosines."""
        w = cosines**2
        return float(w @ self.share[places] / w.sum())


def _flat(lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All values of a list column, and the rows' offsets into them."""
    return lists.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False), dtype=np.int64)])


def _own_votes(shared):
    """The vote of each example's nearest others; null where it has none."""

    def votes(batches):
        index, vocabulary = shared.value
        place = {key: i for i, key in enumerate(index.keys.tolist())}
        for batch in batches:
            (t, at), (n, _) = _flat(batch.column("terms")), _flat(batch.column("counts"))
            got = []
            for key, (near, cosines) in zip(batch.column("key").to_pylist(), index.search(np.searchsorted(vocabulary, t), n, at, range(batch.num_rows), NEIGHBOURS + 1)):
                other = np.flatnonzero(near != place[key])[:NEIGHBOURS]
                got.append(index.vote(near[other], cosines[other]) if len(other) else None)
            yield pa.RecordBatch.from_arrays([pa.array(got, pa.float64()), batch.column("share")], names=["vote", "share"])

    return votes


def _scorer(shared, calibration):
    """Scores and evidence of texts. Texts with equal vectors within a task are searched for once."""
    schema = pa.schema([("doc_id", pa.int64()), ("text_hash", pa.int64()), ("score", pa.float64()), ("evidence", pa.string())])

    def score(batches):
        (index, vocabulary), (votes, fitted, none), known = shared.value, calibration, {}
        vocabulary = Vocabulary(vocabulary)
        for batch in batches:
            for lo, hi, raw, off in text_chunks(batch.column("text")):
                term, count, at = vectors(raw, off, vocabulary)
                keys = [hash((term[a:b].tobytes(), count[a:b].tobytes())) for a, b in zip(at[:-1].tolist(), at[1:].tolist())]
                if len(known) > 10_000:
                    known.clear()
                new = {key: r for r, key in enumerate(keys) if key not in known}
                for key, (near, cosines) in zip(new, index.search(term, count, at, list(new.values()))):
                    evidence = ",".join(f"{i}:{c:.4f}" for i, c in zip(index.ids[near].tolist(), cosines.tolist()))
                    known[key] = (float(np.interp(index.vote(near, cosines), votes, fitted)), evidence) if len(near) else (none, "")
                got = [known[key] for key in keys]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id")[lo:hi], batch.column("key")[lo:hi], pa.array([s for s, _ in got], pa.float64()), pa.array([e for _, e in got], pa.string())], schema=schema)

    return score


def _scored(docs: DataFrame, labels: DataFrame, label: str, sample: int) -> DataFrame:
    """Every row's doc_id, text_hash, score and evidence."""
    docs = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    sc, key = docs.sparkSession.sparkContext, F.xxhash64("text").alias("key")
    marked = docs.filter(remainder(5) != 0).select("doc_id", key).join(single_labels(labels, label), "doc_id")
    texts = marked.groupBy("key").agg(F.min("doc_id").alias("doc_id"), F.avg("y").alias("share"))
    chosen = cut(texts.orderBy(F.xxhash64("key"), "key").limit(sample))
    # `sample` rows at most are broadcast, and come to the driver as vectors.
    examples = docs.select("doc_id", "text", key).join(F.broadcast(chosen), ["doc_id", "key"]).dropDuplicates(["key"])
    examples = cut(examples.mapInArrow(_read_examples, "key long, doc_id long, share double, terms array<long>, counts array<int>"))
    vocabulary = examples.mapInArrow(_distinct_terms, "term long").distinct().toArrow()
    vocabulary = np.sort(np.asarray(vocabulary.column("term").combine_chunks(), np.int64))
    sent = sc.broadcast(vocabulary)
    placed = examples.mapInArrow(_placed(sent), "key long, doc_id long, share double, places array<int>, counts array<int>")
    held = placed.toArrow().combine_chunks()
    column = lambda c: held.column(c).combine_chunks() if held.num_rows else pa.array([], held.schema.field(c).type)
    (term, at), (count, _) = _flat(column("places")), _flat(column("counts"))
    share, keys, ids = np.array(column("share"), float), np.array(column("key")), np.array(column("doc_id"))
    del held
    pa.default_memory_pool().release_unused()  # the driver holds the examples' lists once

    frequent = docs.select("text").mapInArrow(_document_frequencies(sent), "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    sent.destroy()
    df = np.zeros(len(vocabulary), np.int64)
    df[np.asarray(frequent.column("term").combine_chunks())] = np.asarray(frequent.column("n").combine_chunks())
    index = Index(term, count, at, df, docs.count(), share, keys, ids, np.where(vocabulary & 1, 1.0, WHOLE))
    del term, count, at, frequent
    pa.default_memory_pool().release_unused()
    shared = sc.broadcast((index, vocabulary))

    own = examples.mapInArrow(_own_votes(shared), "vote double, share double").collect()  # `sample` at most
    voted = sorted((r["vote"], r["share"]) for r in own if r["vote"] is not None)
    alone = [r["share"] for r in own if r["vote"] is None]
    prior = float(share.mean()) if len(share) else 0.5
    votes, ys = np.array([v for v, _ in voted] or [0.0]), np.array([y for _, y in voted] or [prior])
    calibration = votes, pool(votes, ys, np.ones(len(ys))), float(np.mean(alone)) if alone else prior

    return docs.select("doc_id", key, "text").mapInArrow(_scorer(shared, calibration), "doc_id long, text_hash long, score double, evidence string")


def score_toxicity(docs: DataFrame, labels: DataFrame, label: str = "toxic", threshold: float = 0.5, sample: int = SAMPLE) -> DataFrame:
    """Scores every whole text by its nearest labelled examples: one row per input row.

    Labels are learnt only from ids whose crc32 leaves a remainder other than 0 by 5. Labelled rows with equal texts are
    one example with the share of them that have the label, whatever their number; of these texts `sample` at most are
    used, those with the smallest hashes. Returns doc_id, held_out (that remainder is 0; false for null ids), score (0 to
    1), predicted, evidence (nearest examples as doc_id:cosine, best first).
    Null and empty texts, and others without any term of an example, score the share of the label among such examples,
    or among all if there are none. Very long texts are read whole, in runs of about a megabyte or one text. Ties between
    examples go by the index's order, not ids. Repeated rows score alike; repeated labels count once, the largest.
    Columns other than doc_id, text and the label don't matter. An empty table gives an empty result; without labels
    every score is 0.5.
    """
    held_out = F.coalesce(remainder(5) == 0, F.lit(False))
    return _scored(docs, labels, label, sample).select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "evidence")


def drop_toxic(docs: DataFrame, labels: DataFrame, label: str = "toxic", threshold: float = 0.5, sample: int = SAMPLE) -> DataFrame:
    """`docs` without the rows that score `threshold` or more, with all columns, whatever their names.

    Rows are told apart by doc_id and text, null ones among them; learning and edge cases are those of `score_toxicity`.
    """
    doc_id, text_hash = fresh(docs, "doc_id", "text_hash")
    rejected = _scored(docs, labels, label, sample).filter(F.col("score") >= threshold).select(F.col("doc_id").alias(doc_id), F.col("text_hash").alias(text_hash)).distinct()
    return docs.join(rejected, F.col("doc_id").eqNullSafe(F.col(doc_id)) & (F.xxhash64(F.coalesce("text", F.lit(""))) == F.col(text_hash)), "left_anti")
