"""Benchmark decontamination with DataFrame functions only (operator 6).

One path at any size. Blocks of a document's words at a stride, such that every window of the benchmark's size holds
exactly one, are hashed with the few words around them and looked up in a table of the bits of the hashes of all blocks
that benchmark windows hold. That table has CELLS rows at most, whatever the benchmark's size, and is broadcast; a fuller
one lets more blocks through. Windows are made around the blocks that pass, joined by hash and words with those of the
benchmark, by whatever join Spark takes for their sizes, and so verified. Text never is shuffled to find hits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quakeframe.llm.common import cut, fresh, quoted

SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WORD = r"[0-9A-Za-z\x{80}-\x{10FFFF}]+"
#: Rows of 64 bits each that the broadcast table of block hashes has at most: 16 MB of cells and bits.
CELLS = 1 << 20
#: Copies of one text that are returned from one array.
COPIES = 4096
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def lower_words(text: Column) -> Column:
    """Words of a text with A-Z, and no other letters, in lower case; null has none."""
    text = F.coalesce(text, F.lit(""))
    low = F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, _UPPER, _UPPER.lower()))
    return F.array_remove(F.split(low, SEPARATORS), "")


def _block(size: int) -> tuple[int, int]:
    """Words of a block, and the stride at which any `size` words in a row hold exactly one."""
    block = (size + 1) // 2
    return block, size - block + 1


def _cell(h: str) -> Column:
    return F.shiftrightunsigned(h, 6).bitwiseAND(F.lit(CELLS - 1))


def _bit(h: str) -> Column:
    return F.col(h).bitwiseAND(F.lit(63)).cast("int")


def benchmark_windows(benchmark: DataFrame, window: int) -> tuple[DataFrame, DataFrame]:
    """Distinct windows of all items, (size, gram, gram_hash, set_id), and the items that hold them, (set_id, items).

    Windows of the same items share a set, so that what travels with a hit is a number, however many items these are.
    """
    words = benchmark.select("item_id", lower_words(F.col("text")).alias("words")).filter(F.size("words") > 0)
    words = words.withColumn("size", F.least(F.lit(window), F.size("words")))
    grams = F.transform(F.sequence(F.lit(1), F.size("words") - F.col("size") + 1), lambda i: F.slice("words", i, F.col("size")))
    held = words.select("item_id", "size", F.explode(grams).alias("gram"))
    held = cut(held.groupBy("size", "gram").agg(F.array_sort(F.collect_set("item_id")).alias("items")))
    sets = cut(held.select("items").distinct().select(F.monotonically_increasing_id().alias("set_id"), "items"))
    return cut(held.join(sets, "items").select("size", "gram", F.xxhash64("gram").alias("gram_hash"), "set_id")), sets


def _blocks(words: Column, size: int) -> Column:
    """Blocks of a text with the words around them that windows of `size` with the block need."""
    block, stride = _block(size)
    n = F.size(words)
    kind = "array<struct<size:int,place:int,first:int,near:array<string>>>"

    def around(p: Column) -> Column:
        first = F.greatest(p - (stride - 1), F.lit(1))
        return F.struct(F.lit(size).alias("size"), p.alias("place"), first.alias("first"), F.slice(words, first, F.least(n, p + size - 1) - first + 1).alias("near"))

    return F.when(n >= size, F.transform(F.sequence(F.lit(1), n - block + 1, F.lit(stride)), around)).otherwise(F.array().cast(kind))


def hits(docs: DataFrame, benchmark: DataFrame, window: int = 10) -> DataFrame:
    """Where benchmark windows occur: doc_id, text_hash, n_words, copies, places (from 1) of hit words, items.

    One row for all rows with the same doc_id and text; copies is their number.
    """
    windows, sets = benchmark_windows(benchmark, window)
    sizes = [r["size"] for r in windows.select("size").distinct().orderBy("size").collect()]  # `window` at most
    base = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), lower_words(F.col("text")).alias("words"))
    own = F.array(F.struct(F.lit(0).alias("size"), F.lit(0).alias("place"), F.lit(0).alias("first"), F.lit(None).cast("array<string>").alias("near")))
    rows = base.select("doc_id", "text_hash", F.size("words").alias("n_words"), F.explode(F.concat(own, *(_blocks(F.col("words"), size) for size in sizes))).alias("x"))
    rows = rows.select("doc_id", "text_hash", "n_words", "x.*")

    seeds = None
    for size in sizes:
        block, stride = _block(size)
        each = windows.filter(F.col("size") == size).select(F.explode(F.transform(F.sequence(F.lit(1), F.lit(stride)), lambda i: F.slice("gram", i, block))).alias("block"))  # noqa: B023
        seeds = each if seeds is None else seeds.union(each)
    if seeds is not None:
        table = seeds.select(F.xxhash64("block").alias("h")).groupBy(_cell("h").alias("cell")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), _bit("h"))).alias("bits"))
        rows = rows.withColumn("h", F.xxhash64(F.slice("near", F.col("place") - F.col("first") + 1, F.floor((F.col("size") + 1) / 2).cast("int"))))
        rows = rows.withColumn("cell", F.when(F.col("place") > 0, _cell("h")))
        rows = rows.join(F.broadcast(table), "cell", "left").filter((F.col("place") == 0) | (F.bit_get("bits", _bit("h")) == 1))  # CELLS rows at most
    made = F.transform(F.sequence("first", F.least(F.col("place"), F.col("n_words") - F.col("size") + 1)), lambda q: F.struct(q.alias("at"), F.slice("near", q - F.col("first") + 1, F.col("size")).alias("gram")))
    none = F.array(F.struct(F.lit(0).alias("at"), F.lit(None).cast("array<string>").alias("gram")))
    each = rows.select("doc_id", "text_hash", "n_words", F.explode(F.when(F.col("place") > 0, made).otherwise(none)).alias("x"))
    spread = F.when(F.col("x.at") > 0, F.xxhash64("x.gram")).otherwise(F.xxhash64("doc_id", "text_hash"))  # a text's own row joins nothing
    each = each.select("doc_id", "text_hash", "n_words", "x.at", "x.gram", spread.alias("gram_hash"))
    found = each.join(windows, ["gram_hash", "gram"], "left").filter("at = 0 OR size IS NOT NULL")
    places = F.collect_set(F.when(F.col("at") > 0, F.struct("at", "size")))
    grouped = found.groupBy("doc_id", "text_hash", "n_words").agg(F.count_if(F.col("at") == 0).alias("copies"), places.alias("found"), F.collect_set("set_id").alias("ids"))
    covered = F.array_distinct(F.flatten(F.transform("found", lambda h: F.sequence(h["at"], h["at"] + h["size"] - 1))))
    grouped = grouped.select("doc_id", "text_hash", "n_words", "copies", covered.alias("places"), F.explode_outer("ids").alias("set_id"))
    named = grouped.join(sets, "set_id", "left").groupBy("doc_id", "text_hash", "n_words").agg(F.first("copies").alias("copies"), F.first("places").alias("places"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"))
    return named.withColumn("n_words", F.col("n_words").cast("long"))


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = 10) -> DataFrame:
    """Which benchmark items occur in each whole text: one row per input row.

    Words are runs of letters, digits and non-ASCII characters, A-Z lower-cased. A window is `window` consecutive words
    of an item, or all of a shorter, not wordless, item. Returns doc_id, n_words, n_hit (words inside any occurrence of
    a window), n_items, items_sha256 (of the item ids sorted as strings), contaminated.
    Null and empty texts have no words and no hits. Rows with the same doc_id and text are counted, worked on once and
    returned as often as they came; null ids are kept. An item without an id hits words but isn't counted as an item;
    repeated items count once. Either table may be empty. Very long texts are one row until blocks are cut from them.
    Other columns, whatever their names, don't matter.
    """
    found = hits(docs, benchmark, window)
    names = F.array_join(F.array_sort(F.transform("items", lambda x: x.cast("string"))), ",")
    n_hit = F.size("places").cast("long")
    runs = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("copies") - 1) / COPIES)))  # no array is as long as a text has copies
    out = found.withColumn("run", runs).withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.least(F.lit(COPIES), F.col("copies") - F.col("run") * COPIES))))
    return out.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(names, 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = 10, remove: str = "documents") -> DataFrame:
    """`docs` without contaminated documents, or, with remove='spans', without the hit words of any.

    All columns stay, also ones named like those used here; a clean document is never changed. Removed words leave the
    text between them as it was. Null, empty and repeated texts are handled as by `contamination`.
    """
    doc_id, text_hash, places = fresh(docs, "doc_id", "text_hash", "places")
    found = hits(docs, benchmark, window).filter(F.size("places") > 0).select(F.col("doc_id").alias(doc_id), F.col("text_hash").alias(text_hash), F.col("places").alias(places))
    same = F.col("doc_id").eqNullSafe(F.col(doc_id)) & (F.xxhash64("text") == F.col(text_hash))
    if remove == "documents":
        return docs.join(found, same, "left_anti")
    between, words = F.split("text", WORD, -1), F.regexp_extract_all("text", F.lit(WORD), F.lit(0))
    kept = F.transform(words, lambda w, i: F.concat(F.when(F.array_contains(places, i + 1), "").otherwise(w), F.get(between, i + 1)))
    text = F.when(F.col(places).isNull(), F.col("text")).otherwise(F.concat(F.get(between, F.lit(0)), F.array_join(kept, "")))
    changed = {"text": text} | ({"n_chars": F.when(F.col(places).isNull(), F.col("n_chars")).otherwise(F.char_length(text).cast("long"))} if "n_chars" in docs.columns else {})
    return docs.join(found, same, "left").select(*(changed[c].alias(c) if c in changed else quoted(c) for c in docs.columns))
