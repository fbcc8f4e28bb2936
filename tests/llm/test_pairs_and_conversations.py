"""Hard negatives, conversation repair and SimHash against brute force, with their odd cases."""

import hashlib
import heapq
import itertools
import math
import random
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from quakeframe.llm import conversations, negatives, queries, simhash
from quakeframe.llm.common import table

SPACE = " \t\n\x0b\x0c\r"


# --- hard negatives ----------------------------------------------------------------------------------------------


def best_negatives(rows):
    rows = {(i, (y + 1) % 10 if i % 7 == 0 else y, tuple(math.floor(256 * x) for x in v)) for i, y, v in rows if None not in (i, y, v) and all(x is not None and math.isfinite(x) for x in v)}
    score = lambda a, b: sum(x * y for x, y in zip(a, b))
    out = []
    for i, y, v in rows:
        if i % 100 == 0:
            scored = sorted((-score(v, w), j, z) for j, z, w in rows if j != i)
            for s, j, _ in [x for x in scored if x[2] == y][:5]:
                chosen = [(k, -t) for t, k, z in scored if z != y and 30 * -s <= 100 * -t <= 90 * -s][:10]
                out += [(i, j, rank, k, -s, t) for rank, (k, t) in enumerate(chosen, 1)]
    return sorted(out)


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>")


@pytest.mark.parametrize(("bucket", "block"), [(7, 2), (2048, 512)])
def test_negatives_against_all_rows(spark, monkeypatch, bucket, block):
    monkeypatch.setattr(negatives, "BUCKET", bucket)
    monkeypatch.setattr(negatives, "BLOCK", block)
    rng = np.random.default_rng(4)
    v = (rng.standard_normal((90, 6)) * rng.choice([0.1, 1, 3], (90, 1))).astype(np.float32)
    v[40:60] = v[40]  # a third of the rows is one vector
    rows = [(i * 10, int(rng.integers(0, 3)), [float(x) for x in v[i]]) for i in range(90)]
    rows += [rows[3], (901, None, rows[0][2]), (902, 1, None), (903, 1, [1.0, None] + [0.0] * 4), (904, 1, [float("nan")] * 6), (905, 1, [float("inf")] * 6), (None, 1, rows[0][2]), (700, 1, [0.0] * 6), (906, 1, [0.5, 0.5]), (907, 1, [])]
    got = negatives.hard_negatives(vectors(spark, rows).withColumn("id", F.lit("x")).withColumn("part", F.lit(1)))
    padded = [(i, y, v and v + [0.0] * (6 - len(v))) if v != [] else (i, y, [0.0] * 6) for i, y, v in rows]
    assert sorted(tuple(r) for r in got.collect()) == best_negatives(padded)


def test_negatives_of_empty_tables(spark):
    assert negatives.hard_negatives(vectors(spark, [])).collect() == []
    assert negatives.hard_negatives(vectors(spark, [(100, 1, [0.5]), (101, 2, [0.4])])).collect() == []  # no positives


def test_coordinates_never_lose_a_row():
    rng = np.random.default_rng(5)
    v = rng.integers(-90, 90, (300, 8))
    bucket, left = negatives.Bucket(np.arange(300), np.zeros(300, int), v), 0
    for anchor in v[:40]:
        scores = v @ anchor
        for least in (int(np.sort(scores)[-5]), int(scores.max()), 1, 0, -50, int(scores.max()) + 1):
            rows = bucket.candidates(anchor, least, focus=8)
            assert set(np.flatnonzero(scores >= least)) <= set(rows.tolist())
            assert (bucket.scores(rows, anchor) == scores[rows]).all()
            left += len(rows) if least > np.sort(scores)[-6] else 0
    assert left < 40 * 3 * 300 / 2  # what has to score high is looked for in a part of the rows


# --- conversations -----------------------------------------------------------------------------------------------


def after_damage(rows):
    for conv, turn, role, text in rows:
        name = lambda x: " " if x is None else str(x)
        kind, role, text = zlib.crc32(f"{name(conv)}:{name(turn)}".encode()) % 20, name(role), name(text)
        text = "" if kind == 1 else "".join(c for c in text if c not in ".!?") if kind == 2 else text
        yield from [(conv, turn, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)


def cheapest(codes):
    """The least (cost, audit) of rows of two letters, and the roles it gives, by looking at costs in order."""
    leads = {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}
    heap, seen = [(0, "", 0, "", ())], set()
    while True:
        cost, audit, i, state, roles = heapq.heappop(heap)
        if (i, state) in seen:  # costs and audits come in order
            continue
        seen.add((i, state))
        if 2 * i == len(codes) and state in ("", "a"):
            return cost, audit, roles
        for letter in set(leads[state]) & {"u", "a"}:
            heapq.heappush(heap, (cost + 5, audit + "I", i, letter, (*roles, letter)))
        if 2 * i < len(codes):
            initial, fault = codes[2 * i : 2 * i + 2]
            heapq.heappush(heap, (cost + 2, audit + "D", i + 1, state, roles))
            more = 5 * (fault == "t")
            if fault not in "bd":
                if initial in leads[state]:
                    heapq.heappush(heap, (cost + more, audit + "K", i + 1, initial, (*roles, "keep")))
                for letter in set(leads[state]) & {"u", "a"}:
                    heapq.heappush(heap, (cost + 1 + more, audit + "R", i + 1, letter, (*roles, letter)))


def repaired(rows):
    full = {"u": "user", "a": "assistant"}
    rows = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3]))
    seen, codes = set(), ""
    for _, _, role, text in rows:
        shown = text.rstrip(SPACE)
        codes += (role[:1] if role[:1] in ("s", "u", "a") else "?") + ("b" if not shown else "d" if (role, text) in seen else "t" if shown[-1] not in ".!?" else "-")
        seen.add((role, text))
    cost, audit, roles = cheapest(codes)
    lines, k, at = [], 0, iter(roles)
    for edit in audit:
        if edit != "D":
            role = next(at)
            lines.append((full[role], "") if edit == "I" else (rows[k][2] if role == "keep" else full[role], rows[k][3]))
        k += edit != "I"
    turns = [r[1] for r in rows if r[1] is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    count = [codes[1::2].count(x) for x in "bdt"]
    return (gaps, *count, illegal, cost, audit, hashlib.sha256("\n".join(f"{r}:{t}" for r, t in lines).encode()).hexdigest())


def expected(rows):
    by = {r[0]: [] for r in rows}
    for r in after_damage(rows):
        by[r[0]].append(r)
    return {conv: repaired(rows) for conv, rows in by.items()}


@pytest.mark.parametrize("prime", [(1 << 61) - 1, 7, 2])
def test_audits_are_the_cheapest_and_least(prime):
    rng = random.Random(6)
    for _ in range(300):
        codes = "".join(rng.choice("suuaa?") + rng.choice("---bdt") for _ in range(rng.randint(0, 9)))
        found = conversations.transitions(codes, 0, prime)  # with a small prime, hashes of unequal audits collide
        cost, audit, _ = cheapest(codes)
        assert min(found[e] for e in conversations.ENDS if found[e]) == (cost, audit)


def test_audits_compare_like_strings():
    rng = random.Random(7)
    for prime in ((1 << 61) - 1, 5):
        audits, nodes = conversations.Audits(prime), [0]
        for _ in range(400):
            nodes.append(audits.add(rng.choice(nodes[-20:]), rng.choice("DIK")))
        for a, b in itertools.product(rng.sample(nodes, 60), repeat=2):
            assert audits.less(a, b) == (audits.text(a) < audits.text(b))


def turns(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")


@pytest.mark.parametrize("piece", [3, 4096])
def test_conversations_against_brute_force(spark, monkeypatch, piece):
    monkeypatch.setattr(conversations, "PIECE", piece)
    rng = random.Random(8)
    text = lambda: rng.choice(["Yes.", "No!", "Why?", "cut off", "", " \n", None, "Yes. \t", "é."])
    rows = [(c, rng.choice([None, *range(9)]), rng.choice(["user", "assistant", "system", "tool", "", None]), text()) for c in range(40) for _ in range(rng.randint(1, 7))]
    rows += [(None, t, "user" if t % 2 == 0 else "assistant", "Null." * t) for t in range(6)]
    rows += [(99, t, ["user", "assistant"][t % 2], f"Turn {t}.") for t in range(60)] + [(98, 1, "user", "Same.")] * 20 + [(97, 1, "user", "Long. " * 50_000)]
    got = conversations.repair_conversations(turns(spark, rows).withColumn("place", F.lit(1)).withColumn("codes", F.lit("b")))
    assert {r[0]: tuple(r)[1:] for r in got.collect()} == expected(rows)


def test_no_conversations(spark):
    assert conversations.repair_conversations(turns(spark, [])).collect() == []
    gone = next(t for t in range(99) if zlib.crc32(f"5:{t}".encode()) % 20 == 0)
    [row] = conversations.repair_conversations(turns(spark, [(5, gone, "user", "Hi.")])).collect()
    assert tuple(row) == (5, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())


# --- SimHash -----------------------------------------------------------------------------------------------------


def plain_fingerprint(text, size=4):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))


def linked(f, bits=4):
    """The smallest id that each id reaches."""
    least = {i: i for i in f}
    pairs = [(a, b) for a, b in itertools.combinations(f, 2) if (f[a] ^ f[b]).bit_count() <= bits]
    while any(least[a] != least[b] for a, b in pairs):
        for a, b in pairs:
            least[a] = least[b] = min(least[a], least[b])
    return least


def test_fingerprints_piece_by_piece():
    rng = random.Random(9)
    for _ in range(200):
        text = "".join(rng.choice(["ab", "C", "é", "  ", "\n", " ", "\x1f"]) for _ in range(rng.randint(0, 60)))
        assert {simhash.fingerprint(text.encode(), 4, piece) for piece in (1, 5, 17, 1 << 20)} == {plain_fingerprint(text)}


def test_pivots_discard_no_near_pair():
    rng = np.random.default_rng(10)
    f = rng.integers(0, 2**63, 400, dtype=np.uint64)
    f[200:] = f[:200] ^ (np.uint64(1) << rng.integers(0, 63, (5, 200), dtype=np.uint64)).sum(axis=0, dtype=np.uint64)
    a, b = np.triu_indices(400, 1)
    near = np.bitwise_count(f[a] ^ f[b]) <= 4
    x, y = simhash.survivors(a, b, f, simhash.distance_table(f), 4)
    assert set(zip(x, y)) == set(zip(a[near], b[near])) and len(x) > 10


@pytest.mark.parametrize("block", [3, 1024])
def test_simhash_against_all_pairs(spark, sf_dir, monkeypatch, block):
    monkeypatch.setattr(simhash, "BLOCK", block)  # with 3, nearly all buckets are compared in blocks
    docs = table(spark, sf_dir, "documents")
    f = {r.doc_id: plain_fingerprint(r.text) for r in docs.select("doc_id", "text").collect()}
    least = linked(f)
    got = simhash.near_duplicates(docs.withColumn("f", F.lit("x")).withColumn("block", F.lit(2))).collect()
    assert len(got) == len(f) and all((r.fingerprint, r.component_id) == (f"{f[r.doc_id]:016x}", least[r.doc_id]) for r in got)
    assert len(set(least.values())) < len(f)


def test_simhash_of_odd_rows(spark):
    long = " ".join(f"w{i % 977}" for i in range(100_000))
    rows = [(5, None), (3, ""), (9, " \n"), (4, "one"), (4, long), (8, "ONE"), (None, "one"), (7, long + " end"), (7, long + " end")]
    got = sorted(tuple(r) for r in simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect() if r.doc_id is not None)
    one, whole = f"{plain_fingerprint('one'):016x}", f"{plain_fingerprint(long):016x}"
    assert got == sorted([(5, "0" * 16, 3), (3, "0" * 16, 3), (9, "0" * 16, 3), (4, one, 4), (4, whole, 4), (8, one, 4), (7, f"{plain_fingerprint(long + ' end'):016x}", 4), (7, f"{plain_fingerprint(long + ' end'):016x}", 4)])
    assert [r.component_id for r in simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect() if r.doc_id is None] == [None]
    assert simhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    with pytest.raises(ValueError, match="bits"):
        simhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string"), bits=5)


# --- queries -----------------------------------------------------------------------------------------------------


def test_conversation_query_over_its_table(spark, sf_dir):
    rows = [tuple(r) for r in table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").collect()]
    assert {r[0]: tuple(r)[1:] for r in queries.op12_conversations(spark, sf_dir).collect()} == expected(rows)
