"""Columns with the names that the methods use themselves, nulls, repeats and empty tables, for operators and stages."""

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from pathloom.llm import bpe_count, language, lines, mixing, packing, quality, simhash
from pathloom.llm.queries import tokenizer_path

CLASHES = ["n_words", "n_removed", "kept", "_own", "_host", "_k1", "_k", "_t", "n_near", "n_lines", "component_id", "fingerprint", "_fp", "_node", "size", "target", "taken", "positions", "order", "row", "key", "own", "_position", "turns", "a.b", "_text", "_gone", "_all", "_at", "_s", "_least", "_w", "kept_", "x", "h", "c0", "c1", "c.0"]


def documents(spark):
    long = lambda i: " ".join(f"{chr(97 + i % 26)}{k}x{i}" for k in range(90))
    rows = [(i, f"{long(i)}\nshared line of the host number {i % 3} that stands often\n", "en", f"s{i % 3}", 1) for i in range(40)]
    rows += [(None, long(50), None, None, 1), (41, None, "en", "s0", 0), (42, "", None, None, 0), (7, rows[7][1], "en", "s1", 1), (7, rows[7][1], "en", "s1", 1), (43, long(3).replace("d5x3", "zz"), "en", "s0", 1)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in CLASHES)
    df = spark.createDataFrame([(*r, *[f"{c}!{i}" for c in CLASHES]) for i, r in enumerate(rows)], schema)
    return df


@pytest.mark.parametrize("stage", [n for n, _ in corpus_pipeline.STAGES[:-1]])
def test_stages_pass_on_columns_of_any_name(spark, stage):
    docs = documents(spark)
    out = dict(corpus_pipeline.STAGES)[stage](spark, docs, "")
    assert out.columns == docs.columns
    got = out.collect()
    assert got
    for r in got:
        # what a row brings along stays with it
        assert len({str(r[c]).split("!")[-1] for c in CLASHES}) == 1
        assert all(str(r[c]).startswith(f"{c}!") for c in CLASHES)


def applied(spark, docs):
    """Each operator over documents, by name; those that carry the input's columns on, and whether a dotted name was asked for."""
    sized = docs.withColumn("size", F.length("text"))
    return {
        "lines": lambda: lines.dedup_lines(docs), "mixing": lambda: mixing.assign(sized), "quality": lambda: quality.judge(docs), "tokens": lambda: bpe_count.token_counts(docs, tokenizer_path()), "simhash": lambda: simhash.near_duplicates(docs),
        "language": lambda: language.identify(docs, language.learn(docs)), "packing": lambda: packing.pack_documents(docs, tokenizer_path(), keep=["doc_id", "_text", "own"]),
    }


@pytest.mark.parametrize("name", ["lines", "mixing", "quality", "tokens", "simhash", "language", "packing"])
def test_operators_carry_columns_of_any_name(spark, name):
    docs = documents(spark)
    got = applied(spark, docs)[name]()
    rows = got.collect()
    assert len(rows) >= docs.count()
    carried = [c for c in CLASHES if c in got.columns]
    whole = [c for c in carried if all(r[c] is not None and str(r[c]).startswith(f"{c}!") for r in rows)]
    assert len(carried) - len(whole) <= 7 and len(whole) >= (2 if name == "packing" else len(CLASHES) - 8), set(CLASHES) - set(whole)
    for r in rows:
        assert len({str(r[c]).split("!")[-1] for c in whole}) == 1


@pytest.mark.parametrize("name", ["lines", "mixing", "quality", "tokens", "simhash", "language", "packing"])
def test_operators_of_an_empty_table(spark, name):
    assert applied(spark, documents(spark).where("doc_id < -5"))[name]().count() == 0


def test_pipeline_of_an_empty_table(spark):
    docs = documents(spark).select("doc_id", "text", "lang", "source", "n_chars").where("doc_id < 0")
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, "")
        assert docs.count() == 0, name


def test_pipeline_of_odd_documents(spark):
    docs = documents(spark).select("doc_id", "text", "lang", "source", "n_chars")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, "")
    got = docs.collect()
    assert got and all(0 <= r["offset"] and r["offset"] + r["length"] <= 2048 for r in got)
    assert {r["doc_id"] for r in got} <= {*range(44), None}
    assert docs.select(F.sum("length")).first()[0] > 0
