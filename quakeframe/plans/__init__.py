"""Registered queries over the given tables, and the SQL that each is compared with.

Queries whose operator returns arrays register them as text, one integer of millionths for each number, so that any tool
can sort and compare their rows.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from quakeframe.plans import arrow_and_streams, corpus, files, scoring, waveforms

MODULES = (scoring, waveforms, corpus, arrow_and_streams, files)

NUMBERS = {
    "w8_smooth": ("x",), "w10_windows": ("x",), "w11_standardize": ("x",), "w12_overlap_add": ("curve",), "w13_median_stack": ("curve",), "w15_padding": ("zero", "last", "median"), "w19_stream_standardize": ("x",),
    "w21_dual_pass": ("x",), "w22_interpolate": ("x",), "w26_mask_curves": ("p", "s", "m"), "w31_detrend": ("demeaned", "detrended"), "w36_labels": ("p", "n"), "w37_detection_label": ("d",), "w41_guard": ("p", "s", "m"),
    "w43_f6_coda": ("x",), "j16_best_horizontal": ("x",), "p5_physical": ("z", "e"), "p20_stack": ("z", "n", "e"), "x1_annotate": ("p",), "x1_short": ("p",), "x1_cut": ("p",),
}
WORDS = {"p7_years": ("years",), "a13_profile": ("years",)}


def _as_text(name, query):
    def number(c):
        return F.array_join(F.transform(c, lambda x: F.round(x * 1000000).cast("bigint").cast("string")), ",")

    def run(spark, sf_dir):
        return query(spark, sf_dir).withColumns({c: number(c) for c in NUMBERS.get(name, ())} | {c: F.array_join(F.col(c).cast("array<string>"), ",") for c in WORDS.get(name, ())})

    return run


def queries():
    found = {name: query for module in MODULES for name, query in module.QUERIES.items()}
    return {name: _as_text(name, query) if name in NUMBERS or name in WORDS else query for name, query in found.items()}


def oracle_sql():
    found = {name: sql for module in MODULES for name, sql in module.ORACLE_SQL.items()}
    for name in found:
        texts = [f"array_to_string(list_transform({c}, lambda q: round(q::DOUBLE * 1000000)::BIGINT), ',') AS {c}" for c in NUMBERS.get(name, ())]
        texts += [f"array_to_string({c}, ',') AS {c}" for c in WORDS.get(name, ())]
        if texts:
            found[name] = f"SELECT * REPLACE ({', '.join(texts)}) FROM (\n{found[name]}\n)"
    return found
