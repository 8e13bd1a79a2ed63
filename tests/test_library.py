"""The library of flows over several runs: statuses, aborted and repeated runs, versions and what is refused."""

import pytest
from pyspark.sql import functions as F

from pathloom.operators import compare, library

SCHEMA = "ord int, canonical_pattern string, significant_actions array<struct<url:string,type:string,element:string>>, `a.b` string"


def mined(spark, **flows):
    """A flow a pattern, whose only action is on the given element."""
    return spark.createDataFrame([(i, p, e and [("/x", "click", e)], "more") for i, (p, e) in enumerate(flows.items(), 1)], SCHEMA)


def now(spark, folder, run=None):
    return {r["canonical_pattern"]: (r["status"], r["result"], r["first_run"], r["changed_run"], r["seen_run"]) for r in library.library(spark, folder, run).collect()}


def test_runs_in_a_row_with_an_aborted_one(spark, tmp_path, monkeypatch):
    folder = str(tmp_path / "lib")
    assert library.update_library(folder, mined(spark, p="1", q="1", r=None), 1)
    first = now(spark, folder)
    assert first == {k: ("active", "new", 1, 1, 1) for k in "pqr"}

    def fail(*_):
        raise OSError("lost before the manifest was written")

    with monkeypatch.context() as m:
        m.setattr(library, "write_text", fail)
        with pytest.raises(OSError, match="lost"):
            library.update_library(folder, mined(spark, z="9"), 2)
    assert now(spark, folder) == first
    assert library.update_library(folder, mined(spark, p="1", q="2", s="1"), 2)
    assert not library.update_library(folder, mined(spark, z="9"), 2)
    second = {"p": ("active", "unchanged", 1, 1, 2), "q": ("active", "changed", 1, 2, 2), "r": ("inactive", "inactive", 1, 1, 1), "s": ("active", "new", 2, 2, 2)}
    assert now(spark, folder) == second
    assert library.update_library(folder, mined(spark, r=None, s="1"), 5)
    assert now(spark, folder) == {"p": ("inactive", "inactive", 1, 1, 2), "q": ("inactive", "inactive", 1, 2, 2), "r": ("active", "unchanged", 1, 1, 5), "s": ("active", "unchanged", 2, 2, 5)}
    assert now(spark, folder, 2) == second and library.versions(spark, folder) == [1, 2, 5]
    # only what a version names is left, the aborted attempt is not
    assert len(list((tmp_path / "lib" / "rows").iterdir())) == 3
    library.update_library(folder, mined(spark), 6, keep=1)
    assert library.versions(spark, folder) == [6] and len(list((tmp_path / "lib" / "rows").iterdir())) == 1
    assert now(spark, folder)["q"] == ("inactive", "kept", 1, 2, 2) and now(spark, folder)["s"] == ("inactive", "inactive", 2, 2, 5)


def test_statuses_of_the_user_ties_and_refusals(spark, tmp_path):
    folder = str(tmp_path / "lib")
    with pytest.raises(ValueError, match="no version"):
        library.library(spark, folder)
    twice = mined(spark, p="1").unionByName(mined(spark, x="0", p="2")).unionByName(spark.createDataFrame([(9, None, None, None)], SCHEMA))
    library.update_library(folder, twice, 3)
    got = library.library(spark, folder)
    assert {(r["canonical_pattern"], r["ord"], r["a.b"]) for r in got.collect()} == {("p", 2, "more"), ("x", 1, "more")}
    archived = got.withColumn("status", F.when(F.col("canonical_pattern") == "p", "archived").otherwise(F.col("status")))
    after = library.next_version(mined(spark, p="3"), archived, 4)
    assert {(r["canonical_pattern"], r["status"], r["result"]) for r in after.collect()} == {("p", "archived", "changed"), ("x", "inactive", "inactive")}
    after = library.next_version(mined(spark), archived, 4)
    assert {(r["canonical_pattern"], r["status"], r["result"]) for r in after.collect()} == {("p", "archived", "kept"), ("x", "inactive", "inactive")}
    with pytest.raises(ValueError, match="comes after"):
        library.update_library(folder, mined(spark, p="1"), 2)
    with pytest.raises(ValueError, match="of its own"):
        library.update_library(folder, mined(spark, p="1").withColumn("status", F.lit("x")), 4)
    with pytest.raises(ValueError, match="a.b"):
        library.update_library(folder, mined(spark, p="1").select("ord", "canonical_pattern", "significant_actions"), 4)


def test_the_last_flow_of_a_pattern_counts(spark):
    rows = spark.range(1000).select(F.col("id").cast("int").alias("ord"), F.lit("hot").alias("canonical_pattern"))
    assert [(r["_flow"]["ord"], r["_place"]) for r in compare.last_by_pattern(rows, "ord").collect()] == [(999, 0)]
