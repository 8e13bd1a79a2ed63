"""Hourly carried splits and the tab sweep against plain Python; hot sessions; the native look-ahead."""

import random
from datetime import UTC, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from pathloom.operators import sessions, steps
from pathloom.schema import TARGET

T0 = datetime(2026, 1, 1, 9, 40, tzinfo=UTC)
SCHEMA = "event_id string, session_id string, tab_id string, sequence long, timestamp timestamp, url string"


def log(seed, n=400):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        tab = rng.choice(["a", "b", "c", "d", None])
        at = None if rng.random() < 0.03 else T0 + timedelta(minutes=rng.choice([0, 1, 5, 29, 30, 31, 59, 60, 61, 200]) * rng.randint(0, 12))
        rows.append((f"e{i:04}", rng.choice(["s", "t", None]), tab, rng.randint(0, 5), at, rng.choice(["/x", "/y", "/admin"])))
    # tabs of one moment, alone and beside others
    rows += [(f"p{i}", "u", f"t{i}", 0, T0 + timedelta(minutes=m), "/x") for i, m in enumerate([5, 5, 0, 9])] + [("q0", "u", "w", 0, T0, "/x"), ("q1", "u", "w", 1, T0 + timedelta(minutes=9), "/x")]
    return rows


def in_order(rows):
    least = datetime(1, 1, 1, tzinfo=UTC)
    return sorted(rows, key=lambda r: (r[4] is not None, r[4] or least, r[3], r[0]))


@pytest.mark.parametrize("seed", range(3))
def test_tab_sweep_equals_pairs(spark, seed):
    rows = log(seed)
    times = {}
    for r in rows:
        times.setdefault((r[1], r[2]), []).append(r[4])
    ends = {k: (min(t), max(t)) if (t := [x for x in v if x]) else None for k, v in times.items()}
    want = {k: sum(k != j and k[0] == j[0] and bool(v and w) and v[0] < w[1] and w[0] < v[1] for j, w in ends.items()) for k, v in ends.items()}
    got = {(r["session_id"], r["tab_id"]): r["n_overlaps"] for r in sessions.concurrent_tabs(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == want


@pytest.mark.parametrize("seed", range(3))
def test_idle_and_exclusion_splits_across_hours(spark, seed):
    rows, idle, cut = log(seed), {}, {}
    for s in {r[1] for r in rows}:
        before, sub, segment, parts = None, 0, 0, {}
        for r in in_order([r for r in rows if r[1] == s]):
            sub += bool(before and r[4] and r[4] - before > timedelta(minutes=30))
            before, idle[r[0]] = r[4], sub
            segment += r[5] == "/admin"
            if r[5] != "/admin":
                parts.setdefault(segment, []).append(r[0])
        cut |= {e: k for k, v in parts.items() if len(v) >= 3 for e in v}
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    assert {r["event_id"]: r["sub_idx"] for r in sessions.split_idle(df, ["session_id"]).collect()} == idle
    out = sessions.split_exclusions(df, ["/admin"], ["session_id"])
    assert out.columns == [*df.columns, "segment"]
    assert {r["event_id"]: r["segment"] for r in out.collect()} == cut
    none = df.where("sequence > 9")
    assert sessions.split_sessions(none).count() == 0 and sessions.split_exclusions(none, ["/admin"], ["session_id"]).count() == 0


def test_a_session_of_very_many_tabs(spark):
    n = 100_000
    at = lambda s: F.timestamp_seconds(s)
    tabs = spark.range(n).select(F.lit("bot").alias("session_id"), F.col("id").cast("string").alias("tab_id"), F.explode(F.array(at(F.col("id")), at(F.col("id") + F.when(F.col("id") % 2 == 0, 3).otherwise(1)))).alias("timestamp"))
    met = sessions.concurrent_tabs(tabs)
    got = met.groupBy("n_overlaps").count().collect()
    # even tabs last 3 seconds and meet the even ones about them and the odd one inside; odd ones meet the even one they lie in
    assert {r["n_overlaps"]: r["count"] for r in got} == {1: n // 2, 3: n // 2 - 2, 2: 2}
    some = {int(r["tab_id"]): r["n_overlaps"] for r in met.where("cast(tab_id as int) between 50 and 80").collect()}
    span = lambda i: (i, i + (3 if i % 2 == 0 else 1))
    assert some == {i: sum(j != i and span(i)[0] < span(j)[1] and span(j)[0] < span(i)[1] for j in range(40, 90)) for i in range(50, 81)}


def test_look_ahead_is_native_and_equals_the_builder(spark):
    rng = random.Random(4)
    kinds = ["click", "navigation", "scroll", "api_error", "fill", "hover", None]
    rows = [(f"e{i}", f"s{i % 3}", "t", i, T0 + timedelta(seconds=rng.randint(0, 40)), rng.choice(["/x", "/y", None]), rng.choice(kinds), '{"to_url":"/to"}') for i in range(120)]
    df = spark.createDataFrame(rows, SCHEMA + ", event_type string, payload string").withColumn("target", F.from_json(F.lit(None).cast("string"), TARGET))
    made = steps.prepared(df)
    out = steps.look_ahead(made, ["session_id"], ["timestamp", "sequence"])
    assert "Python" not in out._jdf.queryExecution().toString() and "Arrow" not in out._jdf.queryExecution().toString()
    got = {r["event_id"]: (r["next_url"], r["to_navigation"]) for r in out.collect()}
    want = {}
    for flow in steps.gathered(made, ["session_id"], ["timestamp", "sequence"]).collect():
        b = steps.Builder([e.asDict(True) for e in flow["events"]])
        want |= {e["event_id"]: ((b.next_place[i] or {}).get("url"), b.next_nav[i] is not None) for i, e in enumerate(b.events, 1)}
    assert got == want
