"""Steps whose work or memory must grow no faster than their input."""

import time

import pyarrow as pa
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from pathloom.functions import text, url
from pathloom.operators import flows, gate, graph, render, sessions, steps, variables
from pathloom.plans import queries
from pathloom.schema import TARGET
from pathloom.streaming.tabs import TabSplitter


def seconds(run):
    began = time.time()
    run()
    return time.time() - began


def test_a_long_sequence_of_urls_is_normalised_once(spark):
    n = 8000
    urls = F.transform(F.sequence(F.lit(1), F.lit(n)), lambda i: F.concat(F.lit("/p"), F.floor(i / 2).cast("string"), F.lit("x/"), i.cast("string")))
    got = []
    # element by element with its predecessor this is 64 million normalisations
    assert seconds(lambda: got.append(spark.range(1).select(url.url_sequence(urls).alias("p")).first()["p"])) < 20
    assert got[0].split(" → ") == [f"/p{i}x/:id" for i in range(n // 2 + 1)]


def test_the_file_of_a_long_pattern(spark):
    n = 20_000
    pattern = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(n)), lambda i: F.concat(F.lit("/p"), i.cast("string"))), url.ARROW)
    got = []
    assert seconds(lambda: got.append(spark.range(1).select(text.flow_file(pattern, F.lit(2)).alias("f")).first()["f"])) < 20
    assert got[0].startswith("p1-to-p2-to-") and got[0].endswith("-3.spec.ts")


def test_slices_hold_few_events_and_all_rows():
    batch = pa.RecordBatch.from_arrays([pa.array(range(6)), pa.array([[0] * n for n in (3, 3, 20, 1, 0, 4)])], names=["k", "events"])
    parts = [p.column(0).to_pylist() for p in steps.slices(batch, 1, 8)]
    assert parts == [[0, 1], [2], [3, 4, 5]]


def test_equal_file_names_are_numbered_without_events(spark):
    flows = spark.range(40).select(((F.col("id") * 7) % 40).alias("flow_ord"), F.when(F.col("id") % 4 == 0, "b").otherwise("a").alias("file"), F.array(F.lit("x")).alias("events"))
    found = render.file_numbers(flows)
    got = {r["flow_ord"]: r["_k"] for r in found.collect()}
    by = {}
    for r in flows.collect():
        by.setdefault(r["file"], []).append(r["flow_ord"])
    assert got == {o: k for v in by.values() for k, o in enumerate(sorted(v))}
    assert found.columns == ["flow_ord", "_k"]
    unnamed = spark.createDataFrame([(1, None), (2, None)], "flow_ord long, file string")
    assert sorted(tuple(r) for r in render.file_numbers(unnamed).collect()) == [(1, 0), (2, 1)]


def test_variables_are_named_once_for_each_locator(spark):
    row = [("fill", '{"tag":"INPUT","selectors":{"testid":"user name"}}'), ("fill", '{"tag":"INPUT"}'), ("click", '{"tag":"A","selectors":{"testid":"x"}}'), ("fill", None)]
    e = spark.createDataFrame(row * 3, "event_type string, t string").select("event_type", F.from_json("t", TARGET).alias("target"))
    out = variables.variable_map(e)
    assert [tuple(r) for r in out.collect()] == [('getByTestId("user name")', "userName")]
    # with the filter pushed down the locator stood in the plan many times
    assert len(out._jdf.queryExecution().optimizedPlan().toString()) < 20_000


def test_the_split_by_wide_gaps_equals_the_split_by_tabs_and_gaps(spark):
    at = F.when(F.col("id") % 17 > 0, F.timestamp_seconds(F.pmod(F.xxhash64("id"), F.lit(40)) * 1700))
    e = spark.range(300).select(F.col("id").alias("sequence"), F.col("id").cast("string").alias("event_id"), F.when(F.col("id") % 5 > 0, (F.col("id") % 3).cast("string")).alias("session_id"), F.when(F.col("id") % 7 > 0, (F.col("id") % 6).cast("string")).alias("tab_id"), at.alias("timestamp"))
    want = sessions.split_idle(sessions.split_tabs(e), ["session_id", "is_concurrent", "group_tab"], "2 hours")
    got = sessions.split_sessions(e, "2 hours")
    assert got.columns == want.columns
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))


def mixed(spark):
    """Sessions of three sizes and one without a name, with tabs of one moment, ties and rows without a time."""
    at = F.when(F.col("id") % 17 > 0, F.timestamp_seconds(F.pmod(F.xxhash64("id"), F.lit(40)) * 1700))
    return spark.range(300).select(F.col("id").alias("sequence"), F.col("id").cast("string").alias("event_id"), F.when(F.col("id") % 5 > 0, (F.col("id") % 3).cast("string")).alias("session_id"), F.when(F.col("id") % 7 > 0, (F.col("id") % 6).cast("string")).alias("tab_id"), at.alias("timestamp"))


@pytest.mark.parametrize("gap", ["30 minutes", "2 hours"])
@pytest.mark.parametrize("large", [0, 70, 1000])
def test_the_split_of_small_and_large_sessions_equals_the_split_by_tabs_and_gaps(spark, gap, large):
    e = mixed(spark)
    want = sessions.split_idle(sessions.split_tabs(e), ["session_id", "is_concurrent", "group_tab"], gap)
    got = sessions.split_sessions(e, gap, large)
    assert got.columns == want.columns
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))


def test_small_sessions_are_split_with_one_shuffle(spark):
    plan = sessions.split_sessions(mixed(spark), "2 hours")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Join" not in plan


def test_nodes_and_edges_read_the_events_once(spark):
    e = sessions.split_sessions(mixed(spark), "2 hours").withColumns({"event_type": F.lit("click"), "url": F.concat(F.lit("/x"), F.col("sequence") % 3), "payload": F.lit(None).cast("string"), "target": F.lit(None).cast(TARGET)})
    for part in graph.build_graph(e):
        assert "Window" not in part._jdf.queryExecution().optimizedPlan().toString() and part.count() > 0


def test_patterns_are_made_without_the_events(spark):
    e = sessions.split_sessions(mixed(spark), "2 hours").withColumns({"event_type": F.lit("click"), "url": F.concat(F.lit("/x"), F.col("sequence") % 3), "payload": F.lit(None).cast("string"), "page_context": F.lit("{}"), "target": F.lit(None).cast(TARGET)})
    subs = flows.sub_sessions(e)
    plan = subs.select("pattern")._jdf.queryExecution().optimizedPlan().toString()
    # neither fingerprints nor events are gathered, the nodes are sorted once
    assert plan.count("collect_list(") == 1 and plan.count("sort_array(") == 1 and "is_action" not in plan
    assert subs.count() > 0


@pytest.mark.parametrize("name", ["compare_flows", "flow_library"])
def test_all_runs_of_a_query_are_mined_in_one_pass(spark, monkeypatch, name):
    calls, split = [], sessions.split_sessions
    monkeypatch.setattr(sessions, "split_sessions", lambda *a: calls.append(1) or split(*a))
    assert queries.queries()[name](spark, "/root/testdata/sf0.001").count() > 0
    assert len(calls) == 1


def test_spans_mined_together_equal_spans_mined_alone(spark, tmp_path):
    # some sessions without a name, and one with an empty span
    e = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    e.withColumn("user_id", F.when(F.col("user_id") % 4 > 0, F.col("user_id"))).where((F.dayofmonth("ts") <= 10) | (F.dayofmonth("ts") > 12)).write.parquet(f"{tmp_path}/events.parquet")
    spans = [(20, 31), (10, 12), (0, 10)]
    got = [sorted(map(repr, m.collect())) for m in queries._mined(spark, str(tmp_path), *spans)]
    assert got == [sorted(map(repr, queries._mined(spark, str(tmp_path), s)[0].collect())) for s in spans]
    assert got[0] and not got[1] and got[2]
    assert [r["ord"] for r in queries._mined(spark, str(tmp_path), *spans)[2].orderBy("ord").collect()] == list(range(1, len(got[2]) + 1))


def test_scripts_of_one_file_are_judged_on_all_cores(spark):
    one = spark.range(200).coalesce(1).select("id", F.when(F.col("id") % 2 == 0, "const a = 1;").otherwise("eval(1);").alias("content"))
    out = gate.judged(one)
    assert {(r["id"] % 2, r["v"]["ok"]) for r in out.collect()} == {(0, True), (1, False)} and out.count() == 200
    counts = out.groupBy(F.spark_partition_id().alias("p")).count().collect()
    assert len(counts) >= 4 * 4 and max(r["count"] for r in counts) < 50


class Calls:
    """A store of state that counts the calls to it; everything in it is empty."""

    def __init__(self):
        self.n = 0

    def __getattr__(self, name):
        def call(*args):
            self.n += 1
            return self if name.startswith("get") and args else iter(()) if name == "listTimers" else None

        return call


def test_state_is_called_as_often_for_many_tabs_as_for_one():
    schema, made = StructType.fromDDL("session_id string, tab_id string, _at bigint"), []
    for tabs in (1, 500):
        store, splitter = Calls(), TabSplitter(schema, 10, 100)
        splitter.init(store)
        assert list(splitter.handleInputRows(("s",), iter([Row(session_id="s", tab_id=f"t{i % tabs}", _at=i) for i in range(500)]), None)) == []
        made.append(store.n)
    assert made[0] == made[1] < 12
