"""The script sink: round trips, tasks that fail and are repeated, aborted jobs, and names that are refused."""

import os

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from pathloom.operators import render
from pathloom.plans import queries
from pathloom.sources import scripts
from pathloom.sources.scripts import ScriptWriter, Written, current, opened

SCHEMA = "file_name string, content string"


def read(spark, folder):
    return {r["file_name"]: r["content"] for r in scripts.load_scripts(spark, folder).collect()}


def attempts(folder):
    return sorted(os.listdir(f"{folder}/_attempts"))


def test_round_trip_overwrite_and_append(spark, tmp_path):
    folder = str(tmp_path / "out")
    with pytest.raises(PySparkException, match="no scripts"):
        read(spark, folder)
    rows = spark.range(200).select(F.format_string("d%d/t%d.spec.ts", F.col("id") % 3, "id").alias("file_name"), F.when(F.col("id") % 50 > 0, F.repeat(F.lit("ä\n"), F.col("id").cast("int"))).alias("content"), F.col("id").alias("a.b"))
    scripts.save_scripts(rows, folder)
    want = {f"d{i % 3}/t{i}.spec.ts": "ä\n" * i if i % 50 else "" for i in range(200)}
    assert read(spark, folder) == want
    scripts.save_scripts(spark.createDataFrame([("more.spec.ts", "x")], SCHEMA), folder, "append")
    assert read(spark, folder) == want | {"more.spec.ts": "x"}
    m = current(*opened(folder))
    assert (m["version"], m["files"], m["size"]) == (2, 201, sum(len(v.encode()) for v in want.values()) + 1)
    scripts.save_scripts(spark.createDataFrame([("only.spec.ts", "y")], SCHEMA), folder)
    assert read(spark, folder) == {"only.spec.ts": "y"} and len(attempts(folder)) == 1 and len(os.listdir(f"{folder}/_versions")) == 1
    scripts.save_scripts(spark.createDataFrame([], SCHEMA), folder)
    assert read(spark, folder) == {} and attempts(folder) == []


def test_failed_and_repeated_tasks_leave_one_set(spark, tmp_path):
    """A task that dies halfway, its repetition, and one that ran twice: only what the driver was told of is left."""
    folder = str(tmp_path / "out")
    schema = spark.createDataFrame([], SCHEMA).schema
    writer = ScriptWriter(folder, schema, overwrite=True)

    def dies():
        yield {"file_name": "a", "content": "1"}
        raise RuntimeError("executor lost")

    with pytest.raises(RuntimeError):
        writer.write(dies())
    again = writer.write(iter([{"file_name": "a", "content": "1"}, {"file_name": "b", "content": "2"}]))
    writer.write(iter([{"file_name": "c", "content": "speculative"}]))
    other = writer.write(iter([{"file_name": "c", "content": "3"}]))
    assert len(attempts(folder)) == 4
    with pytest.raises(PySparkException, match="no scripts"):
        read(spark, folder)
    writer.commit([again, None, other, writer.write(iter([]))])
    assert read(spark, folder) == {"a": "1", "b": "2", "c": "3"} and len(attempts(folder)) == 2
    assert isinstance(again, Written) and (again.files, again.size) == (2, 2)

    second = ScriptWriter(folder, schema, overwrite=True)
    second.abort([second.write(iter([{"file_name": "z", "content": "9"}]))])
    assert read(spark, folder) == {"a": "1", "b": "2", "c": "3"} and len(attempts(folder)) == 2


@pytest.mark.parametrize("name", [None, "", "/etc/x", "../x", "a/../x", "a//b", "_files.json", "a\\b"])
def test_names_that_leave_the_folder_are_refused(spark, tmp_path, name):
    """The job fails and the version before stays."""
    folder = str(tmp_path / "out")
    scripts.save_scripts(spark.createDataFrame([("kept", "1")], SCHEMA), folder)
    with pytest.raises(PySparkException, match="not a name"):
        scripts.save_scripts(spark.createDataFrame([("new", "2"), (name, "3")], SCHEMA), folder)
    assert read(spark, folder) == {"kept": "1"} and len(attempts(folder)) == 1


def test_equal_names_and_changed_files_are_refused(spark, tmp_path):
    folder = str(tmp_path / "out")
    with pytest.raises(PySparkException, match="two scripts"):
        scripts.save_scripts(spark.createDataFrame([("same", "1"), ("other", "0"), ("same", "2")], SCHEMA).repartition(3), folder)
    scripts.save_scripts(spark.createDataFrame([("kept", "1")], SCHEMA), folder)
    (tmp_path / "out" / "_attempts" / attempts(folder)[0] / "kept").write_text("2")
    with pytest.raises(PySparkException, match="isn't what was written"):
        read(spark, folder)


def test_many_small_scripts_take_few_files(spark, tmp_path):
    """As a file each, with a folder for every four, these took 2,500 inodes and a block of the disk for each."""
    folder = str(tmp_path / "out")
    name = F.format_string("d%d/t%d.spec.ts", F.col("id") % 500, "id")
    scripts.save_scripts(spark.range(2000).select(name.alias("file_name"), F.concat(F.lit("text "), F.col("id").cast("string")).alias("content")), folder)
    assert read(spark, folder) == {f"d{i % 500}/t{i}.spec.ts": f"text {i}" for i in range(2000)}
    kept = [os.path.join(at, n) for at, _, files in os.walk(folder) for n in files]
    assert len(kept) < 50 and sum(os.lstat(f).st_blocks * 512 for f in kept) < 500_000


def test_long_and_foreign_names_come_back(spark, tmp_path):
    rows = {"a" * 150 + "/" + "b" * 150: "long", "ä/日本 x.spec.ts": "ä\r\n\0`${x}`", "empty": ""}
    scripts.save_scripts(spark.createDataFrame(list(rows.items()), SCHEMA), str(tmp_path))
    assert read(spark, str(tmp_path)) == rows


@pytest.mark.parametrize("change", [lambda b: b[:-9], lambda b: b + b"x", lambda b: b[:20] + bytes([b[20] ^ 1]) + b[21:]])
def test_changed_archives_are_refused(spark, tmp_path, change):
    folder = str(tmp_path / "out")
    scripts.save_scripts(spark.createDataFrame([("kept", "1")], SCHEMA), folder)
    path = tmp_path / "out" / "_attempts" / attempts(folder)[0] / scripts.ARCHIVE
    path.write_bytes(change(path.read_bytes()))
    with pytest.raises(PySparkException, match="isn't what was written"):
        read(spark, folder)


def test_scripts_without_file_names_are_rendered_without_numbering(spark, monkeypatch):
    """The query's own names are all it needs: its events are neither stored nor shuffled once more."""
    stored = []
    monkeypatch.setattr(queries, "written", lambda df: stored.append(df) or df)
    monkeypatch.setattr(render, "file_numbers", lambda df: stored.append(df))
    assert queries._scripts(spark, "/root/testdata/sf0.001").count() > 0 and not stored
