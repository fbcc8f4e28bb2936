"""Secret scans by corpus-wide ownership frequency (operator 1).

Every text is scanned once for candidates: assignments, access keys, long hexadecimal runs, and other long mixed tokens.
Candidate values are hashed, and the hashes are counted by distinct repositories and owners over the whole corpus.
A value that many owners hold, or a few owners in many repositories, is a widely copied example; one of an owner's own,
in however many of its repositories, that looks random is live-looking.
Of the mixed tokens, only the owner-specific live-looking ones become spans; the three pattern kinds always are spans
and are only classed.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quakeframe.llm.common import cut, fresh, quoted

KINDS = ("assign", "access", "hex", "owned")
#: From this many owners on, a value is a widely copied example; two owners are enough where they hold it in this many repositories.
EXAMPLE_OWNERS, EXAMPLE_REPOSITORIES = 3, 5
#: A value of more than one in this many candidates is joined by broadcast: there are fewer such values than this.
HOT = 1000
#: Bits a character that a live-looking value has at least; a value of one repeated character has none.
LIVE_BITS = 2.5

# Letters of the keywords in either ASCII case only: the case-insensitive flag would also take U+017F and U+212A.
_either = lambda word: "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)
_ASSIGN = re.compile(rf"(?:{'|'.join(map(_either, ('password', 'passwd', 'secret', 'token')))}|{_either('api')}_?{_either('key')})[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
_WORDS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")
_MIXED = re.compile(r"[A-Za-z0-9+/_=-]{24,}")


def bits(value: str) -> float:
    """Shannon entropy of the value's characters."""
    n = len(value)
    return -sum(c / n * math.log2(c / n) for c in Counter(value).values())


def _live(value: str) -> bool:
    return bits(value) >= LIVE_BITS


def candidates(text: str) -> list[tuple[int, int, int, str]]:
    """(start, end, index of the kind, value) of all candidates of a text, in code points, by start, then kind."""
    found = []
    low = text.encode("utf-8", "surrogatepass").lower()
    if any(w in low for w in _WORDS):
        found += [(m.start(), m.end(), 0, m[1]) for m in _ASSIGN.finditer(text) if len(m[1]) >= 6]
    if "AKIA" in text:
        found += [(m.start(), m.end(), 1, m[0]) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [(m.start(), m.end(), 2, m[0]) for m in _HEX.finditer(text)]
    taken = [(a, b) for a, b, _, _ in found]
    for m in _MIXED.finditer(text):
        v = m[0]
        kinds = sum(bool(re.search(p, v)) for p in ("[a-z]", "[A-Z]", "[0-9]"))
        if kinds >= 2 and re.search("[0-9]", v) and _live(v) and not any(a < m.end() and m.start() < b for a, b in taken):
            found.append((m.start(), m.end(), 3, v))
    return sorted(found, key=lambda x: (x[0], x[2]))


def joined(spans) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, b, k in spans)


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    item = pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32()), ("value", pa.string()), ("live", pa.bool_())])
    schema = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("text_hash", pa.int64()), ("repository", pa.string()), ("owner", pa.string()), ("n_assign", pa.int64()), ("n_access", pa.int64()), ("n_hex", pa.int64()), ("base_sha256", pa.string()), ("found", pa.list_(item))])
    for batch in batches:
        rows = []
        for text in batch.column("text"):
            got = candidates(text.as_py() or "")
            base = [(a, b, k) for a, b, k, _ in got if k < 3]
            n = Counter(k for _, _, k in base)
            digest = hashlib.sha256(joined(base).encode()).hexdigest()
            rows.append((n[0], n[1], n[2], digest, [{"start": a, "kind": k, "end": b, "value": hashlib.blake2b(v.encode(), digest_size=16).hexdigest(), "live": k < 3 and _live(v) or k == 3} for a, b, k, v in got]))
        columns = [list(c) for c in zip(*rows)] or [[]] * 5
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("row", "doc_id", "text_hash", "repository", "owner")), *(pa.array(c, f.type) for c, f in zip(columns, list(schema)[5:]))], schema=schema)


def scan(docs: DataFrame, owner: str = "source", repository: tuple[str, ...] = ("source", "lang")) -> tuple[DataFrame, DataFrame]:
    """One row per document with what it holds, and one row per candidate: (row, start, kind, end, class).

    Classes: `example` (held by EXAMPLE_OWNERS owners, or by two in EXAMPLE_REPOSITORIES repositories, or more), `live`
    (any other that looks random), `plain`.
    """
    name = lambda cols: F.concat_ws("\x1f", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in cols))
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long"), F.xxhash64("text").alias("text_hash"), name(repository).alias("repository"), name((owner,)).alias("owner"), "text")
    schema = "row long, doc_id long, text_hash long, repository string, owner string, n_assign long, n_access long, n_hex long, base_sha256 string, found array<struct<start:int,kind:int,end:int,value:string,live:boolean>>"
    rows = cut(rows.mapInArrow(_scan, schema))
    each = rows.select("row", "repository", "owner", F.explode("found").alias("x")).select("row", "repository", "owner", "x.*")
    held = each.groupBy("value", "owner", "repository").agg(F.count("*").alias("copies"))
    held = held.groupBy("value", "owner").agg(F.count("*").alias("repositories"), F.sum("copies").alias("copies"))
    held = cut(held.groupBy("value").agg(F.count("*").alias("owners"), F.sum("repositories").alias("repositories"), F.sum("copies").alias("copies")))
    total = held.agg(F.sum("copies").alias("n")).first()["n"] or 0
    hot = held.filter(F.col("copies") * HOT > total)  # fewer than HOT rows, as their copies add up to `total` at most
    rest = each.join(F.broadcast(hot.select("value")), "value", "left_anti").join(held, "value")
    each = rest.unionByName(each.join(F.broadcast(hot), "value"))
    copied = (F.col("owners") >= EXAMPLE_OWNERS) | (F.col("owners") > 1) & (F.col("repositories") >= EXAMPLE_REPOSITORIES)
    classed = F.when(copied, "example").when(F.col("live"), "live").otherwise("plain")
    return rows.drop("found"), each.select("row", "start", "kind", "end", "value", "owners", "repositories", "copies", classed.alias("class"))


def find_secrets(docs: DataFrame, owner: str = "source", repository: tuple[str, ...] = ("source", "lang")) -> DataFrame:
    """Secrets of every whole text: one row per input row.

    Returns doc_id, n_assign, n_access, n_hex, base_sha256 (of the pattern spans, joined as kind:start:end), spans (these
    and the owner-specific live-looking tokens, kind `owned`), the numbers of spans classed example and live, and by how
    many owners and in how many repositories the most widely held of the spans' values is held (0 without spans).
    Very long texts are scanned whole. Null and empty texts have no spans. Rows are told apart by position, so repeated rows and null ids are kept as they
    are; a null owner or repository counts as one more, unnamed one. Columns other than doc_id, text and those named are
    not looked at. An empty table gives an empty result.
    """
    rows, each = scan(docs, owner, repository)
    taken = each.filter("kind < 3 OR class = 'live'").groupBy("row").agg(F.sort_array(F.collect_list(F.struct("start", "kind", "end"))).alias("x"), F.count_if(F.col("class") == "example").alias("n_example"), F.count_if(F.col("class") == "live").alias("n_live"), F.max("owners").alias("max_owners"), F.max("repositories").alias("max_repositories"))
    kind = lambda x: F.element_at(F.array(*map(F.lit, KINDS)), x["kind"] + 1)
    spans = F.array_join(F.transform("x", lambda x: F.concat_ws(":", kind(x), x["start"], x["end"])), ",")
    out = rows.join(taken, "row", "left")
    return out.select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", F.coalesce(spans, F.lit("")).alias("spans"), *(F.coalesce(c, F.lit(0)).alias(c) for c in ("n_example", "n_live", "max_owners", "max_repositories")))


MARK = "[SECRET]"


def _blotter(text: str, n_chars: str | None, values: str):
    """Replaces in the column `text` what has a hash in the column `values`, and drops that one."""

    def blot(batches):
        for batch in batches:
            texts = batch.column(text).to_pylist()
            lengths = batch.column(n_chars).to_pylist() if n_chars else [None] * len(texts)
            for i, named in enumerate(batch.column(values).to_pylist()):
                if named:
                    parts, at = [], 0
                    for a, b, _, v in candidates(texts[i]):
                        if b > at and hashlib.blake2b(v.encode(), digest_size=16).hexdigest() in named:
                            parts += [texts[i][at : max(a, at)], MARK if a >= at else ""]
                            at = b
                    texts[i] = "".join([*parts, texts[i][at:]])
                    lengths[i] = len(texts[i])
            new = {text: texts, n_chars: lengths}
            kept = [n for n in batch.schema.names if n != values]
            yield pa.RecordBatch.from_arrays([pa.array(new[n], batch.column(n).type) if n in new else batch.column(n) for n in kept], names=kept)

    return blot


def redact(docs: DataFrame, owner: str = "source", repository: tuple[str, ...] = ("source", "lang")) -> DataFrame:
    """`docs` with every secret replaced by MARK, but for widely copied examples; no row is dropped.

    Keeps all columns, also ones named like those used here; n_chars, where there is one, is brought up to date for
    redacted rows. What to redact is found by (doc_id, hash of the text), so that rows that share a doc_id each get their
    own. Null and empty texts stay as they are; very long ones are redacted whole. An empty table gives an empty result.
    """
    rows, each = scan(docs, owner, repository)
    doc_id, text_hash, values = fresh(docs, "doc_id", "text_hash", "values")
    named = each.filter("class = 'live' OR class = 'plain' AND kind < 3").groupBy("row").agg(F.collect_set("value").alias("found"))
    named = rows.join(named, "row").select(F.col("doc_id").alias(doc_id), F.col("text_hash").alias(text_hash), F.col("found").alias(values)).dropDuplicates([doc_id, text_hash])
    at = F.col("doc_id").eqNullSafe(F.col(doc_id)) & (F.xxhash64("text") == F.col(text_hash))
    plain = {c: f"c{i}" for i, c in enumerate(docs.columns)}  # names that Arrow functions can take
    out = docs.join(named, at, "left").select(*(quoted(c).alias(plain[c]) for c in docs.columns), F.col(values).alias("values"))
    blot = _blotter(plain["text"], plain.get("n_chars"), "values")
    return out.mapInArrow(blot, out.drop("values").schema).toDF(*docs.columns)
