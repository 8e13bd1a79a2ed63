"""The graph merged batch by batch against the batch graph: rows between earlier ones, repeats, aborted batches."""

import random
from datetime import UTC, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from pathloom.operators import graph, merged_graph
from pathloom.schema import TARGET
from pathloom.streaming import sessions as streaming

T0 = datetime(2026, 1, 1, tzinfo=UTC)
KEYS = ["session_id", "group_tab"]


def frame(spark, rows):
    df = spark.createDataFrame(rows, "event_id string, session_id string, group_tab string, sequence long, timestamp timestamp, event_type string, url string")
    return df.withColumn("target", F.from_json(F.lit(None).cast("string"), TARGET)).withColumn("payload", F.lit(None).cast("string"))


def log(seed, n=240):
    rng = random.Random(seed)
    at = [T0 + timedelta(seconds=20 * i - rng.choice([0, 0, 100, 400])) for i in range(n)]
    rows = [(f"e{i:04}", rng.choice(["s", "t", None, f"x{i}"]), rng.choice([None, "a"]), i, t, rng.choice(["click", "fill", "scroll"]), rng.choice(["/a", "/b", "/c"])) for i, t in enumerate(at)]
    return rows


def same(got, want):
    nodes = lambda df: sorted((r["node"], r["count"], r["url"], r["event_type"]) for r in df.collect())
    edges = lambda df: sorted((r["src"], r["dst"], r["weight"]) for r in df.collect())
    assert nodes(got[0]) == nodes(want[0])
    assert edges(got[1]) == edges(want[1])


@pytest.mark.parametrize("seed", [0, 1])
def test_batches_equal_the_whole(spark, tmp_path, seed):
    rows, folder = log(seed), str(tmp_path / "g")
    cuts = [0, 1, 90, 91, 170, 240]
    for i, (a, b) in enumerate(zip(cuts, cuts[1:])):
        if i == 3:  # an aborted batch leaves tables without a marker
            frame(spark, rows[:5]).select(F.lit("zzz").alias("node"), F.lit(1).cast("long").alias("count"), "url", "event_type", F.struct("session_id").alias("first")).write.parquet(f"{folder}/nodes/3")
        assert merged_graph.merge_batch(folder, frame(spark, rows[a:b]), i, keys=KEYS, fold=3)
    assert not merged_graph.merge_batch(folder, frame(spark, rows[a:b]), i, keys=KEYS)
    same(merged_graph.merged_graph(spark, folder), graph.build_graph(frame(spark, rows), KEYS))
    # rows behind the mark and rows without a time are left out
    behind = [("late", "s", None, 1, T0, "click", "/z"), ("none", "s", None, 1, None, "click", "/z")]
    assert merged_graph.merge_batch(folder, frame(spark, behind), 9, keys=KEYS)
    same(merged_graph.merged_graph(spark, folder), graph.build_graph(frame(spark, rows), KEYS))
    with pytest.raises(ValueError, match="after"):
        merged_graph.merge_batch(folder, frame(spark, behind), 7, keys=KEYS)


def test_empty_batches_and_closed_sub_sessions(spark, tmp_path):
    folder = str(tmp_path / "g")
    with pytest.raises(ValueError, match="no batch"):
        merged_graph.merged_graph(spark, folder)
    merged_graph.merge_batch(folder, frame(spark, []), 0, keys=KEYS)
    assert [df.count() for df in merged_graph.merged_graph(spark, folder)] == [0, 0]
    rows = [(f"e{i}", "s" if i < 3 else "t", None, i, T0 + timedelta(days=i // 3 * 3, minutes=i), "click", f"/{i}") for i in range(6)]
    merged_graph.merge_batch(folder, frame(spark, rows[:3]), 1, keys=KEYS)
    merged_graph.merge_batch(folder, frame(spark, rows[3:]), 2, keys=KEYS)
    same(merged_graph.merged_graph(spark, folder), graph.build_graph(frame(spark, rows), KEYS))
    assert {r["session_id"] for r in spark.read.parquet(f"{folder}/seen/2").collect()} == {"t"}
    assert {r["session_id"] for r in spark.read.parquet(f"{folder}/open/2").collect()} == {"t"}


def test_stream_of_events_merges(spark, tmp_path):
    rows, folder = log(5), str(tmp_path / "g")
    for a in range(0, 240, 80):
        frame(spark, rows[a : a + 80]).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(frame(spark, []).schema).parquet(str(tmp_path / "in"))
        streaming.merge_stream(stream, folder, str(tmp_path / "cp"), keys=KEYS).awaitTermination()
    same(merged_graph.merged_graph(spark, folder), graph.build_graph(frame(spark, rows), KEYS))
