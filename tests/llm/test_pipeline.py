"""The pipeline's stages on a small table: what each decides takes effect, and clean documents come through."""

import collections

import corpus_pipeline
from quakeframe.llm import decontaminate, secrets
from quakeframe.llm.common import table
from tests.llm.test_text_operators import base_secrets, contaminated, groups

SF = "/root/testdata/sf0.01"


def test_stages(spark):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "minhash", "decontamination", "secrets", "packing"]
    docs = table(spark, SF, "documents")
    toxic = {r.doc_id for r in table(spark, SF, "labels").filter("toxic = 1").collect()}

    first = corpus_pipeline.reject_toxic(spark, docs, SF)
    assert first.columns == docs.columns
    kept = {r.doc_id: r.text for r in first.collect()}
    assert len(toxic - set(kept)) > 0.5 * len(toxic) and len(kept) > 0.8 * docs.count()

    second = corpus_pipeline.drop_near_copies(spark, first, SF)
    assert second.columns == docs.columns
    want = {i for i, (_, c) in groups(list(kept.items()), 80).items() if c == i}
    assert {r.doc_id for r in second.collect()} == want

    third = corpus_pipeline.drop_contaminated(spark, second, SF)
    items = [(r.item_id, r.text) for r in table(spark, SF, "benchmark").collect()]
    clean = {r[0] for r in contaminated([(i, kept[i]) for i in want], items) if not r[-1]}
    assert third.columns == docs.columns and {r.doc_id for r in third.collect()} == clean

    fourth = corpus_pipeline.redact_secrets(spark, third, SF)
    assert fourth.columns == docs.columns
    after = {r.doc_id: r for r in fourth.collect()}
    assert set(after) == clean
    for i in clean:
        if not base_secrets(kept[i]):
            assert after[i].text == kept[i]
        assert after[i].n_chars == len(after[i].text)
    examples = secrets.find_secrets(third).filter("n_example > 0").count()
    assert sum(bool(base_secrets(after[i].text)) for i in clean) <= examples

    fifth = corpus_pipeline.pack(spark, fourth, SF).collect()
    assert {r.doc_id for r in fifth} == clean
    room = collections.Counter()
    for r in fifth:
        if r.bin is not None:
            room[r.bin, r.bin_capacity] += r.n_tokens
    assert all(n <= c for (_, c), n in room.items())


def test_spans_can_be_removed_instead(spark):
    docs, items = table(spark, SF, "documents"), table(spark, SF, "benchmark")
    cut = decontaminate.decontaminate(docs, items, remove="spans")
    assert cut.count() == docs.count()
    assert decontaminate.contamination(cut, items).filter("contaminated").count() == 0


def test_run_is_the_stages_one_after_the_other(spark):
    docs, sf = table(spark, "/root/testdata/sf0.001", "documents"), "/root/testdata/sf0.001"
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf)
    want = collections.Counter(map(str, docs.collect()))
    got = corpus_pipeline.run(spark, sf)
    assert collections.Counter(map(str, got.collect())) == want and sum(want.values()) > 50


def test_stages_take_clashing_columns_nulls_and_repeats(spark):
    names = ("rejected_doc_id", "near_duplicate_rank", "hit_doc_id", "secret_doc_id", "text_hash", "doc_id_", "places", "values", "rank", "component")
    text = " ".join(f"word{i % 37}x{i % 11}" for i in range(120))
    rows = [(1, text), (2, text), (None, text), (None, None), (3, ""), (3, ""), (4, text.replace("word", "other") + " token: Zz9Yy8Xx7Ww6Vv5Uu4 end")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or ""), *["x"] * len(names)) for i, t in rows], ", ".join(["doc_id long, text string, lang string, source string, n_chars long", *(f"{c} string" for c in names)]))
    sf = "/root/testdata/sf0.001"
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf)
        assert docs.columns[5:] == list(names)
    got = docs.collect()
    assert sorted(str(r.doc_id) for r in got) == ["1", "3", "4", "None", "None"] and all(r[c] == "x" for r in got for c in names)
    assert all("Zz9Yy8Xx7Ww6Vv5Uu4" not in (r.text or "") for r in got)
    assert {str(r.doc_id) for r in corpus_pipeline.STAGES[-1][1](spark, docs, sf).collect()} == {"1", "3", "4", "None"}
    empty = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        empty = stage(spark, empty, sf)
        assert empty.count() == 0
