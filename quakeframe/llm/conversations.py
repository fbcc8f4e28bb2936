"""Repair of damaged conversations by a dynamic program with persistent audits (operator 12).

Roles have to read `(s?(ua)+)?`. A program over a conversation's rows keeps the cheapest audit (a letter for each edit) of
every state of that pattern. Audits that share a beginning share its nodes: a node has its letter, its ancestors at powers
of two and a rolling hash of the letters so far, so that two audits of equal cost are compared at the end of their longest
common prefix, found by jumps; equal hashes of different nodes are verified letter by letter. Of audits with equal costs
none is the beginning of another, so the least audit of a state stays the least whatever follows.

Rows are put in order once, over all conversations, by ranges, so that a conversation of any length is a run of rows over as
many tasks as it needs. Each piece of a run of PIECE rows is a table of costs and audits from any state to any; pieces of
one conversation are joined by taking, at each border, the best state. What meets in one task of a long conversation is
those tables, some letters a row, since its audit is one value; its texts are only streamed, through its hash.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quakeframe.llm.common import cut, discard, shared_folder

PIECE = 4096  # rows in order that one task looks at, at once
KEEP, REROLE, DELETE, INSERT = 0, 1, 2, 5
CUT_OFF = 5  # what a truncated row costs that isn't deleted
_PRIME, _BASE = (1 << 61) - 1, 1_000_003
#: States: nothing yet, after s, after u, after a. The letter of a role, and where it leads from a state.
NEXT = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
ENDS = (0, 3)
ROLES = {"u": "user", "a": "assistant"}


class Audits:
    """Audits as nodes that share their beginnings; node 0 is the empty one."""

    def __init__(self, prime: int = _PRIME):
        self.prime, self.letter, self.depth, self.hash, self.up = prime, [""], [0], [0], [[]]

    def add(self, node: int, letter: str) -> int:
        """The audit of `node` and one letter more."""
        up, k = [node], 0
        while k < len(self.up[up[k]]):
            up.append(self.up[up[k]][k])
            k += 1
        self.letter.append(letter)
        self.depth.append(self.depth[node] + 1)
        self.hash.append((self.hash[node] * _BASE + ord(letter)) % self.prime)
        self.up.append(up)
        return len(self.letter) - 1

    def ancestor(self, node: int, depth: int) -> int:
        while (rest := self.depth[node] - depth) > 0:
            node = self.up[node][rest.bit_length() - 1]
        return node

    def text(self, node: int) -> str:
        out = []
        while node:
            out.append(self.letter[node])
            node = self.up[node][0]
        return "".join(reversed(out))

    def _same(self, a: int, b: int) -> bool:
        """Whether two audits of one depth are equal, letter by letter until they share a node."""
        while a != b:
            if self.letter[a] != self.letter[b]:
                return False
            a, b = self.up[a][0], self.up[b][0]
        return True

    def less(self, a: int, b: int) -> bool:
        """Whether audit a comes before audit b; a beginning comes before what goes on."""
        if a == b:
            return False
        depth = min(self.depth[a], self.depth[b])
        x, y = self.ancestor(a, depth), self.ancestor(b, depth)
        if self.hash[x] == self.hash[y] and self._same(x, y):
            return self.depth[a] < self.depth[b]
        common, apart = 0, depth  # equal up to `common` letters, not up to `apart`
        while apart - common > 1:
            jump = 1 << ((apart - common - 1).bit_length() - 1)
            p, q = self.ancestor(x, apart - jump), self.ancestor(y, apart - jump)
            if self.hash[p] == self.hash[q] and self._same(p, q):
                common = apart - jump
            else:
                x, y, apart = p, q, apart - jump
        return self.letter[x] < self.letter[y]


def _better(audits: Audits, new: tuple[int, int], old: tuple[int, int] | None) -> bool:
    return old is None or new[0] < old[0] or new[0] == old[0] and audits.less(new[1], old[1])


def _insert(audits: Audits, best: list) -> None:
    """Insertions of empty rows, as long as one makes a state cheaper."""
    changed = True
    while changed:
        changed = False
        for state, letters in enumerate(NEXT):
            for letter, to in letters.items():
                if letter in ROLES and best[state] is not None and (best[to] is None or best[state][0] + INSERT <= best[to][0]):
                    new = (best[state][0] + INSERT, audits.add(best[state][1], "I"))
                    if _better(audits, new, best[to]):
                        best[to], changed = new, True


@lru_cache(1 << 14)
def transitions(rows: str, start: int, prime: int = _PRIME) -> tuple[tuple[int, str] | None, ...]:
    """The least cost and audit from a state to each, over rows of two letters: role initial (? for others) and fault."""
    audits, best = Audits(prime), [None] * len(NEXT)
    best[start] = (0, 0)
    for initial, fault in zip(rows[::2], rows[1::2]):
        _insert(audits, best)
        after, more = [None] * len(NEXT), CUT_OFF if fault == "t" else 0
        for state, at in enumerate(best):
            if at is None:
                continue
            edits = [(DELETE, "D", state)]
            if fault not in "bd":
                edits += [(KEEP + more, "K", NEXT[state][initial])] if initial in NEXT[state] else []
                edits += [(REROLE + more, "R", to) for letter, to in NEXT[state].items() if letter in ROLES]
            for cost, letter, to in edits:
                if after[to] is None or at[0] + cost <= after[to][0]:
                    new = (at[0] + cost, audits.add(at[1], letter))
                    if _better(audits, new, after[to]):
                        after[to] = new
        best = after
    _insert(audits, best)
    return tuple(None if x is None else (x[0], audits.text(x[1])) for x in best)


def follow(audit: str, rows: str, state: int) -> list[str]:
    """What an audit does at each row: the roles inserted before it (u, a), K, D, or the capital of its new role; after the last, u and a again."""
    does, before, k = [], "", 0
    for edit in audit:
        wanted = "a" if state == 2 else "u"
        if edit == "I":
            before, state = before + wanted, NEXT[state][wanted]
            continue
        if edit == "K":
            state = NEXT[state][rows[2 * k]]
        elif edit == "R":
            edit, state = wanted.upper(), NEXT[state][wanted]
        does.append(before + edit)
        before, k = "", k + 1
    if before and does:
        does[-1] += before
    return does


def damaged_rows(conversations: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text, nth) after damage by crc32(`conv_id:turn`) % 20; null ids, roles and texts count as one space."""
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), name("role").alias("role"), name("text").alias("text"), F.monotonically_increasing_id().alias("nth"))
    kind = F.crc32(F.concat_ws(":", name("conv_id"), name("turn")).cast("binary")) % 20
    text = F.when(kind == 1, F.lit("")).when(kind == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    rows = rows.select("conv_id", "turn", F.when(kind == 4, F.lit("user")).otherwise(F.col("role")).alias("role"), text.alias("text"), "nth", kind.alias("kind")).filter("kind > 0")
    copies = F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy")
    return rows.select("conv_id", "turn", "role", "text", "nth", copies)


def _illegal(initials: str) -> int:
    return sum(initials[k : k + 2] not in ("su", "ua", "au") for k in range(len(initials) - 1))


_TABLES = "conv string, first long, whole boolean, codes string, start int, end int, cost long, audit string, illegal long"
_NAMES = [x.split()[0] for x in _TABLES.split(", ")]


def _pieces(pdf: pd.DataFrame) -> pd.DataFrame:
    """Tables of the runs of conversations in PIECE rows; a run that touches neither end is a whole conversation."""
    pdf, out = pdf.sort_values("place"), []
    ends = set(pdf["place"].iloc[[0, -1]])
    for conv, rows in pdf.groupby("conv", sort=False):
        codes, first = "".join(rows["code"]), int(rows["place"].iat[0])
        whole = not ends & {first, int(rows["place"].iat[-1])}
        found = [(s, e, *x) for s in ([0] if whole else range(len(NEXT))) for e, x in enumerate(transitions(codes, s)) if x is not None]
        if whole:
            found = [min((x for x in found if x[1] in ENDS), key=lambda x: x[2:])]
        out += [(conv, first, whole, codes, *x, _illegal(codes[::2])) for x in found]
    return pd.DataFrame(out, columns=_NAMES)


def _joined(pdf: pd.DataFrame) -> pd.DataFrame:
    """One conversation's pieces: the least audit, cut at the pieces again."""
    best, last, pieces = {0: (0, "", ())}, "", {}
    for first, rows in pdf.groupby("first"):  # in order
        after, codes = {}, rows["codes"].iat[0]
        for row in rows.itertuples():
            if row.start in best:
                cost, audit, path = best[row.start]
                new = (cost + row.cost, audit + row.audit, (path, (row.start, row.end, row.cost, row.audit)))
                if row.end not in after or new[:2] < after[row.end][:2]:
                    after[row.end] = new
        pieces[first] = (codes, int(rows["illegal"].iat[0]) + _illegal(last + codes[0]))
        best, last = after, codes[-2]
    path, out = min((best[e] for e in ENDS if e in best), key=lambda x: x[:2])[2], []
    for first in reversed(pieces):
        path, found = path
        out.append((pdf["conv"].iat[0], first, True, pieces[first][0], *found, pieces[first][1]))
    return pd.DataFrame(out, columns=_NAMES)


def _does(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """A row for each row of a piece: what its audit does there."""
    for pdf in batches:
        out = [(row.conv, row.first + k, x) for row in pdf.itertuples() for k, x in enumerate(follow(row.audit, row.codes, row.start))]
        yield pd.DataFrame(out, columns=["conv", "place", "does"])


_HASHED = pa.schema([("conv", pa.string()), ("repaired_sha256", pa.string())])


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each conversation's repaired lines; of each place comes what to do (kind 0) and then the row (kind 1)."""
    conv, sha, lines, does = None, None, 0, ""

    def said(role: str, text: str) -> None:
        nonlocal lines
        sha.update(f"{chr(10) if lines else ''}{role}:{text}".encode())
        lines += 1

    for batch in batches:
        done = []
        for row in batch.to_pylist():
            if sha is None or row["conv"] != conv:
                if sha is not None:
                    done.append((conv, sha.hexdigest()))
                conv, sha, lines = row["conv"], hashlib.sha256(), 0
            if row["kind"] == 0:
                does = row["role"]
                continue
            for edit in does:
                if edit in ROLES:
                    said(ROLES[edit], "")
                elif edit != "D":
                    said(row["role"] if edit == "K" else ROLES[edit.lower()], row["text"])
        yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in done], f.type) for k, f in enumerate(_HASHED)], schema=_HASHED)
    if sha is not None:
        yield pa.RecordBatch.from_arrays([pa.array([conv], pa.string()), pa.array([sha.hexdigest()])], schema=_HASHED)


def repair_conversations(conversations: DataFrame) -> DataFrame:
    """Damages conversations, counts their faults, and repairs them at the least cost.

    Reads conv_id, turn, role and text; other columns don't matter. Returns a row for each conv_id, null among them: conv_id,
    gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256. Null ids in the hash that decides on damage,
    null roles and null texts count as one space. Rows are taken by turn, nulls first, ties by role, then text, in the order
    of code points. A role's initial is its first letter as it stands; those other than s, u and a fit nowhere, so such a row
    is deleted or gets a new role. Of repeated rows all but the first are duplicates. Very long texts are hashed whole, as a
    stream. Conversations without rows after damage have zeros, an empty audit and the hash of an empty text. An empty table
    gives an empty result.
    """
    spark = conversations.sparkSession
    at = f"{shared_folder(spark)}/conversations-{uuid.uuid4().hex}"
    named = F.coalesce(F.col("conv_id").cast("string"), F.lit("")).alias("conv")
    order = ["conv", F.asc_nulls_first("turn"), "role", "text", "nth", "copy"]
    rows = damaged_rows(conversations).select(named, "*")
    rows = rows.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *order).sortWithinPartitions(*order)
    last = F.substring(F.rtrim("text", F.lit(" \t\n\x0b\x0c\r")), -1, 1)
    fault = F.when(last == "", "b").when(~last.isin(".", "!", "?"), "t").otherwise("-")
    said = F.sha2(F.concat_ws(":", F.length("role").cast("string"), "role", "text"), 256)
    rows.select("conv", "turn", "role", "text", fault.alias("fault"), said.alias("said"), F.monotonically_increasing_id().alias("place")).write.parquet(f"{at}/rows")
    rows = spark.read.parquet(f"{at}/rows")

    repeated = rows.groupBy("conv", "said").agg(F.min("place").alias("earliest"), F.count("*").alias("n")).filter("n > 1").drop("n")
    fault = F.when((F.col("fault") != "b") & (F.col("place") > F.col("earliest")), "d").otherwise(F.col("fault"))
    initial = F.when(F.substring("role", 1, 1).isin("s", "u", "a"), F.substring("role", 1, 1)).otherwise("?")
    codes = rows.join(repeated, ["conv", "said"], "left").select("conv", "place", F.concat(initial, fault).alias("code"))
    tables = cut(codes.groupBy(F.floor(F.col("place") / PIECE).alias("piece")).applyInPandas(_pieces, _TABLES))
    done = cut(tables.filter("whole").union(tables.filter("NOT whole").groupBy("conv").applyInPandas(_joined, _TABLES)))

    does = done.mapInPandas(_does, "conv string, place long, does string").select("conv", "place", F.lit(0).alias("kind"), F.col("does").alias("role"), F.lit("").alias("text"))
    lines = does.union(rows.select("conv", "place", F.lit(1), "role", "text")).repartition("conv").sortWithinPartitions("conv", "place", "kind")
    hashed = lines.mapInArrow(_hashed, "conv string, repaired_sha256 string")

    count = lambda letter: F.sum(F.length("codes") - F.length(F.replace("codes", F.lit(letter), F.lit("")))).cast("long")
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("first", "audit"))), lambda x: x["audit"]), "")
    counted = done.groupBy("conv").agg(count("b").alias("blank"), count("d").alias("duplicate"), count("t").alias("truncated"), F.sum("illegal").alias("illegal"), F.sum("cost").alias("cost"), whole.alias("audit"))
    turns = rows.groupBy("conv", "turn").agg(F.lit(1).alias("one")).groupBy("conv").agg((F.max("turn") - F.min("turn") + 1 - F.count("turn")).alias("gaps"))
    every = conversations.select(F.col("conv_id").cast("long"), named).distinct()
    found = every.join(turns, "conv", "left").join(counted, "conv", "left").join(hashed, "conv", "left")
    longs = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    empty = F.sha2(F.lit("").cast("binary"), 256)
    found = cut(found.select("conv_id", *longs, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", empty).alias("repaired_sha256")))
    discard(spark, at)
    return found
