"""The streamed split with tabs against the batch split: late rows, micro-batches, a restart."""

import random
from datetime import UTC, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from pathloom.operators import sessions
from pathloom.schema import TARGET
from pathloom.streaming import tabs

T0 = datetime(2026, 1, 1, tzinfo=UTC)
SCHEMA = "event_id string, session_id string, tab_id string, sequence long, timestamp timestamp, url string"


def log(seed, n=300):
    rng, rows, minute = random.Random(seed), [], 0.0
    for i in range(n):
        minute += rng.choice([0, 0, 0.5, 2, 5, 31 if rng.random() < 0.2 else 1, 150 if rng.random() < 0.1 else 0])
        at = T0 + timedelta(minutes=minute - rng.choice([0, 0, 3, 8]), microseconds=rng.randint(0, 999_999))
        rows.append((f"e{i:04}", rng.choice(["s", "t", "u", None]), rng.choice(["a", "b", "c", None]), i, at, "/x"))
    return rows


def streamed(spark, rows, folder, cuts, extra=()):
    """Runs the stream over the parts between ``cuts`` and begins a new query, from the checkpoint, for each."""
    tabs.keep_state_on_disk(spark)
    edges, schema = [0, *cuts, len(rows)], None
    for i, (a, b) in enumerate(zip(edges, edges[1:])):
        part = [*rows[a:b], *(extra if i == len(cuts) else ())]
        df = spark.createDataFrame(part, SCHEMA).withColumn("target", F.from_json(F.lit('{"tag":"A","selectors":{"role":{"role":"link"}}}'), TARGET))
        df.coalesce(1).write.mode("append").parquet(f"{folder}/in")
        schema = df.schema
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
        out = tabs.split_stream(stream, "30 minutes", "10 minutes", "2 hours")
        query = out.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/cp").trigger(availableNow=True).start()
        query.awaitTermination()
        assert query.exception() is None
    return spark.read.parquet(f"{folder}/out")


@pytest.mark.parametrize(("seed", "cuts"), [(0, [100, 200]), (1, [150])])
def test_stream_equals_batch(spark, tmp_path, seed, cuts):
    rows = log(seed)
    end = max(r[4] for r in rows)
    last = ("end", "end", "a", 0, end + timedelta(hours=9), "/x")
    none = ("none", "s", "a", 0, None, "/x")
    behind = ("behind", "s", "a", 0, T0 - timedelta(days=1), "/x")
    out = streamed(spark, [*rows, last, none], tmp_path, [*cuts, len(rows) + 1], [behind])
    got = {r["event_id"]: (r["visit_start"], r["is_concurrent"], r["group_tab"], r["sub_idx"]) for r in out.collect()}
    assert out.count() == len(got)
    assert got.pop("none") == (None, False, None, 0)
    assert "behind" not in got and "end" not in got
    # by Spark's watermark only the row behind it is lost; the visits by the batch operators
    df = sessions.split_idle(spark.createDataFrame(rows, SCHEMA), ["session_id"], "2 hours").withColumnRenamed("sub_idx", "visit")
    df = df.withColumn("session_id", F.concat_ws("#", F.coalesce("session_id", F.lit("?")), "visit"))
    want = sessions.split_sessions(df, "30 minutes").collect()
    starts = {}
    for r in want:
        starts[r["session_id"]] = min(r["timestamp"], starts.get(r["session_id"], r["timestamp"]))
    assert got == {r["event_id"]: (starts[r["session_id"]], r["is_concurrent"], r["group_tab"], r["sub_idx"]) for r in want}
    assert len({v[0] for v in got.values()}) > 3 and {v[1] for v in got.values()} == {True, False}
    first = out.where("target is not null").first()
    assert first["target"]["selectors"]["role"]["role"] == "link"


def test_expiry_below_the_gap_is_refused(spark):
    with pytest.raises(ValueError, match="expiry"):
        tabs.split_stream(spark.createDataFrame([], SCHEMA), "30 minutes", expiry="5 minutes")
