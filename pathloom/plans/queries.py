"""Registered queries: each applies operators of the library to whole driver tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pathloom.functions import element, text, url
from pathloom.operators import checkpoints as cps
from pathloom.operators import compare, dedup, flows, gate, graph, library, merged_graph, render, sessions, steps, validation, variables
from pathloom.operators.numbering import numbered
from pathloom.schema import ELEMENT, TARGET
from pathloom.session import new_folder, table, written
from pathloom.sources import derived, scripts
from pathloom.streaming.tabs import keep_state_on_disk, split_stream

#: Idle gap by which the driver's events make sub-sessions of several events.
GAP = "12 hours"
THRESHOLD = 0.5
KEY = sessions.SUB_KEY


def _split(spark: SparkSession, d: str, gap: str = GAP) -> DataFrame:
    # split before the events get their shape: only slim rows are shuffled
    return derived.shaped(sessions.split_sessions(derived.slim_events(spark, d), gap))


def _idle(spark: SparkSession, d: str, gap: str) -> DataFrame:
    e = sessions.split_idle(derived.events(spark, d), ["session_id"], gap)
    return e.groupBy("session_id", "sub_idx").agg(F.count(F.lit(1)).alias("n_events"), F.min("sequence").alias("first_event"))


def idle_sessions_30m(spark, d):
    return _idle(spark, d, "30 minutes")


def idle_sessions_12h(spark, d):
    return _idle(spark, d, GAP)


def concurrent_tabs(spark, d):
    return sessions.concurrent_tabs(derived.events(spark, d)).select("session_id", "tab_id", "n_overlaps")


def full_session_split(spark, d):
    return _split(spark, d).select("event_id", "is_concurrent", "group_tab", "sub_idx")


def exclusion_segments(spark, d):
    e = sessions.split_exclusions(derived.events(spark, d), ["/error/*"], ["session_id"])
    return e.groupBy("session_id", "segment").agg(F.count(F.lit(1)).alias("n_events"), F.min("sequence").alias("first_event"))


def url_normalise(spark, d):
    return table(spark, d, "pages").select("page_id", url.normalise_url(F.col("url")).alias("norm"), url.path(F.col("url")).alias("path"), url.escape_regex(F.col("url")).alias("escaped"), url.path_to_name(url.path(F.col("url"))).alias("name"))


def url_pattern_topk(spark, d):
    p = table(spark, d, "pages").groupBy(url.normalise_url(F.col("url")).alias("norm")).agg(F.count(F.lit(1)).alias("n"))
    return p.orderBy(F.desc("n"), "norm").limit(10)


def url_sequences(spark, d):
    # normalised row by row: a host's task sorts and joins only
    p = table(spark, d, "pages").select("page_id", url.origin(F.col("url")).alias("host"), "url", url.normalise_url(F.col("url")).alias("norm"))
    return p.groupBy("host").agg(F.transform(F.sort_array(F.collect_list(F.struct("page_id", "url", "norm"))), lambda x: x["norm"]).alias("u")).select("host", url.joined(F.col("u")).alias("pattern"))


def url_origin_mode(spark, d):
    return url.base_url(table(spark, d, "pages").withColumn("flow", F.col("page_id") % 50), "flow", "page_id")


def link_destination(spark, d):
    """Links as they stand and, by their number, as relative references of three kinds."""
    rest = F.expr("substr(href, 2)")
    kind = F.col("n") % 4
    href = F.when(~F.col("href").startswith("/") | (kind == 0), F.col("href")).when(kind == 1, rest).when(kind == 2, F.concat(F.lit("../"), rest)).otherwise(F.concat(F.lit("./x/../"), rest, F.lit("?a=1#b")))
    links = derived.links(spark, d).withColumn("href", href).withColumn("target", F.struct(F.lit("a").alias("tag"), F.create_map(F.lit("href"), F.col("href")).alias("attributes")))
    return links.select("page_id", "n", url.is_link_nav().alias("is_nav"), url.link_destination().alias("dest"))


def glob_exclude_filter(spark, d):
    hit = url.is_excluded(F.col("url"), ["*/[0-9]*", "/blog/*", "https://*.example/p?ge*"])
    return table(spark, d, "pages").select("page_id", hit.alias("excluded"))


def event_nodes(spark, d):
    return derived.events(spark, d).select("event_id", graph.event_node().alias("node"))


def flow_nodes(spark, d):
    return graph.build_graph(_split(spark, d))[0].select("node", "count", "url", "event_type")


def flow_edges(spark, d):
    return graph.build_graph(_split(spark, d))[1]


def _merged(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """The graph merged from the events of four equal spans of time."""
    slim, folder = written(sessions.split_sessions(derived.slim_events(spark, d), GAP)), new_folder(spark, "graph")
    split = derived.shaped(slim)
    first, last = split.agg(F.min(F.unix_micros("timestamp")), F.max(F.unix_micros("timestamp"))).first()
    for i in range(4):
        part = F.floor((F.unix_micros("timestamp") - F.lit(first)) * 4 / F.lit(max(last - first, 1) + 1)) == i
        merged_graph.merge_batch(folder, split.where(part), i, keep="12 hours", fold=3)
    return merged_graph.merged_graph(spark, folder)


def merged_nodes(spark, d):
    return _merged(spark, d)[0].select("node", "count", "url", "event_type")


def merged_edges(spark, d):
    return _merged(spark, d)[1]


def streamed_splits(spark, d):
    """The events as a stream to its end; visits that the watermark has passed by then."""
    keep_state_on_disk(spark)
    folder = new_folder(spark, "splits")
    out = split_stream(derived.slim_events(spark, d, stream=True).select("event_id", "session_id", "tab_id", "timestamp"), GAP, "10 minutes", "24 hours").select("event_id", "is_concurrent", "group_tab", "sub_idx", F.date_format("visit_start", "yyyy-MM-dd HH:mm:ss").alias("visit_start"))
    query = out.writeStream.format("parquet").option("path", f"{folder}/rows").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{folder}/rows")


def flow_sources_sinks(spark, d):
    starts, ends = graph.entries_and_exits(*[written(x) for x in graph.build_graph(_split(spark, d))])
    return starts.select(F.lit("entry").alias("kind"), "node", "entry_ord").unionByName(ends.select(F.lit("exit").alias("kind"), "node", F.lit(0).alias("entry_ord")))


def flow_paths(spark, d):
    nodes, edges = graph.build_graph(_split(spark, d))
    return graph.flow_paths(nodes, edges).select("path_ord", F.array_join("path", " > ").alias("path"), "weight", "min_weight")


def path_popularity(spark, d):
    nodes, edges = graph.build_graph(_split(spark, d))
    total = derived.events(spark, d).select("session_id").distinct().count()
    return graph.popular_paths(nodes, edges, total).select("ord", "canonical_pattern", "session_count", "popularity_score", F.array_join("path_nodes", " > ").alias("path"), F.size("significant_actions").cast("long").alias("n_actions"))


def viewport_class(spark, d):
    return _split(spark, d).groupBy(*KEY).agg(flows.viewport_class().alias("viewport")).select("session_id", "is_concurrent", "group_tab", "sub_idx", "viewport")


def _subs(spark, d):
    return flows.sub_sessions(_split(spark, d))


def canonical_patterns(spark, d):
    return _subs(spark, d).groupBy("pattern").agg(F.count(F.lit(1)).alias("n"))


def session_fingerprints(spark, d):
    return _subs(spark, d).select(*KEY, "fingerprint", "page_set", "n_actions", "n_nodes")


def _flows(spark, d, threshold=THRESHOLD):
    total = derived.events(spark, d).select("session_id").distinct().count()
    return flows.popular_flows(_subs(spark, d), total, threshold)


def popular_flows(spark, d):
    return _flows(spark, d).select("ord", "canonical_pattern", "fingerprint", "session_count", "popularity_score", F.array_join("path_nodes", " > ").alias("path"), "rescued")


def flows_and_rescued(spark, d):
    """Flows at the operator's own threshold, which few patterns reach, so that most rows are rescued ones."""
    return _flows(spark, d, flows.THRESHOLD).select("ord", "canonical_pattern", "fingerprint", "session_count", "popularity_score", F.array_join("path_nodes", " > ").alias("path"), "rescued")


def rescued_flows(spark, d):
    return _flows(spark, d).where("rescued").select("canonical_pattern", "fingerprint", "session_count", "popularity_score")


def _flow_set(spark, d):
    """Sub-sessions' patterns as flows with their first events, for the strategies."""
    subs = _subs(spark, d).withColumn("page", F.split_part(F.split_part("pattern", F.lit(" → "), F.lit(1)), F.lit("] "), F.lit(-1)))
    f = subs.groupBy("page", "fingerprint").agg(F.count(F.lit(1)).alias("n"), F.min_by("events", F.struct(*KEY)).alias("events"), F.min(F.struct(*KEY)).alias("o"))
    f = numbered(f, "flow_ord", "o")
    events = F.transform("events", lambda e: F.struct(e["event_type"].alias("event_type"), e["url"].alias("url"), e["element"].alias("element"), e["link"].alias("link")))
    return f.select("flow_ord", F.col("page").alias("canonical_pattern"), (F.col("n") % 7).cast("double").alias("popularity_score"), events.alias("events"))


def flow_facts(spark, d):
    return dedup.with_facts(_flow_set(spark, d)).select("flow_ord", "canonical_pattern", "popularity_score", "action_fingerprint", "has_interactions", F.col("_page").alias("page_url"), "single_page", "nav_prefix")


def _strategy(name):
    def run(spark, d):
        out = dedup.apply_strategy(_flow_set(spark, d), name)
        return out.select("out_ord", "flow_ord", "canonical_pattern", "test_mode", "interaction_page_url", F.array_join("behaviors", ",").alias("behaviors"))

    return run


def _mined(spark: SparkSession, d: str, *spans: tuple[int, int]) -> list[DataFrame]:
    """For each span of days of the month (after the first, up to the second) the patterns of its events, as flows with the actions of the first sub-session.

    All spans are mined in one pass over the events: a session of one span is a session of its own.
    """
    day = F.dayofmonth("timestamp")
    span = F.coalesce(*[F.when((day > low) & (day <= high), i) for i, (low, high) in enumerate(spans)])
    e = derived.slim_events(spark, d).withColumn("_span", span).where("_span is not null")
    # a prefix: within a span, sessions stand in the order of their names, the one without a name first
    e = e.withColumn("session_id", F.concat(F.col("_span").cast("string"), F.coalesce(F.concat(F.lit(":"), F.col("session_id")), F.lit(""))))
    s = flows.sub_sessions(derived.shaped(sessions.split_sessions(e, GAP)), ["_span", *KEY])
    at = F.struct(*KEY)
    g = s.groupBy("_span", "pattern").agg(F.min_by("nodes", at).alias("nodes"), F.min(at).alias("o"), F.count(F.lit(1)).alias("n"))
    actions = F.filter(F.transform("nodes", graph.node_action), lambda a: a.isNotNull())
    rows = numbered(g, "_ord", "_span", "o").select("_span", "_ord", F.col("pattern").alias("canonical_pattern"), actions.alias("significant_actions"), F.when(F.col("n") > 1, "active").otherwise("archived").alias("status"))
    firsts = {r["_span"]: r["first"] for r in rows.groupBy("_span").agg(F.min("_ord").alias("first")).collect()}  # one row for each span
    return [rows.where(F.col("_span") == i).select((F.col("_ord") - (firsts.get(i, 1) - 1)).cast("int").alias("ord"), "canonical_pattern", "significant_actions", "status") for i in range(len(spans))]


def compare_flows(spark, d):
    new, old = _mined(spark, d, (15, 31), (0, 15))
    return compare.compare_flows(new.drop("status"), old).select("canonical_pattern", "status", F.col("new_flow.ord").alias("new_ord"), F.col("existing_flow.ord").alias("existing_ord"))


def flow_library(spark, d):
    """The library after three runs, each over some days of the month; its own rows are read after the last."""
    folder = new_folder(spark, "library")
    for run, mined in enumerate(_mined(spark, d, (0, 10), (10, 20), (20, 31)), 1):
        library.update_library(folder, mined.drop("status"), run)
    return library.library(spark, folder).select("canonical_pattern", "ord", "status", "result", "first_run", "changed_run", "seen_run")


def _gathered(spark, d):
    return steps.gathered(steps.prepared(_split(spark, d)), KEY, ["timestamp", "sequence"])


def next_significant_event(spark, d):
    return steps.look_ahead(steps.prepared(_split(spark, d)), KEY, ["timestamp", "sequence"])


def flow_steps(spark, d):
    s = steps.steps_of(_gathered(spark, d), KEY)
    return s.select(*KEY, "step_no", "type", "locator", "url", "value", "repeat_count", F.array_join("assertions", " | ").alias("assertions"))


def route_steps(spark, d):
    s = steps.steps_of(_gathered(spark, d), KEY, "nav_only")
    return s.select(*KEY, "step_no", "type", "locator", "url", F.array_join("assertions", " | ").alias("assertions"))


def interaction_steps(spark, d):
    s = steps.steps_of(_gathered(spark, d), KEY, "interaction_only")
    return s.select(*KEY, "step_no", "type", "locator", "repeat_count", F.array_join("assertions", " | ").alias("assertions"))


def collapse_pairs(spark, d):
    """Fills as checks of the button that is clicked with the same number."""
    e = derived.events(spark, d).where("event_type in ('click', 'fill')")
    button = F.from_json(F.concat(F.lit('{"tag":"BUTTON","selectors":{"role":{"role":"button","name":"Go '), (F.col("k") % 3).cast("string"), F.lit('"}}}')), TARGET)
    e = e.withColumns({"target": button, "payload": F.lit('{"checked":true}'), "event_type": F.when(F.col("event_type") == "fill", "check").otherwise("click")})
    return steps.plain_steps(steps.gathered(steps.prepared(e), ["session_id"], ["timestamp", "sequence"]), ["session_id"]).select("session_id", "step_no", "type", "locator")


def _scripts(spark, d):
    """Each sub-session as a flow of its own, rendered in full."""
    e = _gathered(spark, d).withColumns({"canonical_pattern": F.lit("/session/:id → /done"), "popularity_score": F.lit(5), "test_mode": F.lit("full")})
    return render.contents(e, KEY)


def render_scripts(spark, d):
    return _scripts(spark, d).withColumn("content", F.md5("content"))


def script_files(spark, d):
    """The rendered sub-sessions as files of the script sink, read back from it."""
    folder = new_folder(spark, "scripts")
    name = F.concat_ws("/", F.col("session_id"), F.concat(F.when(F.col("is_concurrent"), "c").otherwise("s"), F.coalesce("group_tab", F.lit("")), F.lit("-"), F.col("sub_idx").cast("string"), F.lit(".spec.ts")))
    scripts.save_scripts(_scripts(spark, d).select(name.alias("file_name"), "content"), folder)
    return scripts.load_scripts(spark, folder).select("file_name", F.length("content").alias("n_chars"), F.md5("content").alias("content"))


def checkpoint_prev_diff(spark, d):
    c = cps.with_previous(derived.checkpoints(spark, d))
    diff = cps.diff_visible(F.col("before.visible_elements"), F.col("visible_elements"))
    return c.select("checkpoint_id", F.col("before.checkpoint_id").alias("before_id"), F.array_join(diff, " | ").alias("assertions"))


def _changing(spark, d):
    """Pages as checkpoints whose elements, named by their number, differ from page to page: by number in value, expansion, visibility, width or text."""
    page, n = F.col("page_id"), F.col("n")
    value = F.when(n % 5 == 0, (page % 7).cast("string")).when(n % 5 < 3, F.when(page % 2 == 0, "true").otherwise("false")).when(n % 5 == 3, F.concat(F.lit("width: "), (page % 9 * 10).cast("string"), F.lit("%")))
    key = F.element_at(F.array(*[F.lit(x) for x in ("aria-valuenow", "aria-expanded", "aria-hidden", "style")]), n % 5 + 1)
    json = F.to_json(F.struct(
        F.struct(F.concat(F.lit("e"), n.cast("string")).alias("testid"), F.when(n % 2 == 0, F.struct(F.lit("link").alias("role"), F.concat(F.lit("go "), n.cast("string")).alias("name"))).alias("role")).alias("selectors"), F.lit("A").alias("tag"),
        F.when(n % 5 == 4, F.concat(F.lit("text "), (page % 4).cast("string"))).otherwise("same").alias("text_content"), F.when(n % 5 < 4, F.create_map(F.when(n % 5 < 4, key).otherwise("none"), value)).alias("attributes"),
    ))
    e = derived.links(spark, d).select("page_id", "url", F.regexp_extract("url", "^https?://([^/]*)", 1).alias("session_id"), F.struct("n", json.alias("json")).alias("e"))
    c = e.groupBy("page_id", "url", "session_id").agg(F.transform(F.sort_array(F.collect_list("e")), lambda x: F.from_json(x["json"], ELEMENT)).alias("visible_elements"))
    return c.withColumns({"checkpoint_id": page.cast("string"), "timestamp": F.timestamp_seconds("page_id"), "click_context": F.col("visible_elements")})


def context_changes(spark, d):
    c = cps.with_previous(_changing(spark, d))
    return c.select("checkpoint_id", F.array_join(cps.diff_context(F.col("before.click_context"), F.col("click_context")), " | ").alias("assertions"))


def page_assertions(spark, d):
    page = F.col("page_id")
    title = F.when(page % 3 > 0, F.concat(F.lit("Page (no. "), page.cast("string"), F.lit(")")))
    found = cps.url_assertions(F.when(page % 2 == 0, "navigation").otherwise("click"), F.col("url"), F.col("visible_elements"), title)
    return _changing(spark, d).select("checkpoint_id", F.array_join(found, " | ").alias("assertions"))


def click_assertions(spark, d):
    c = derived.checkpoints(spark, d)
    clicks = c.select(F.col("trigger_event_id").alias("event_id"))
    return cps.click_assertions(clicks, c).select("event_id", F.array_join("assertions", " | ").alias("assertions"))


def global_elements(spark, d):
    c = derived.checkpoints(spark, d)
    by_host = c.withColumn("url", F.col("session_id"))
    return cps.global_elements(by_host)


def checkpoint_kth_assignment(spark, d):
    c = derived.checkpoints(spark, d).withColumn("url", F.col("session_id"))
    calls = table(spark, d, "pages").select((F.col("page_id") % 3).alias("flow_id"), F.regexp_extract("url", "^https?://([^/]*)", 1).alias("url"), F.col("page_id").alias("call_ord"))
    return cps.kth_assignment(calls, c)


def _targets(spark, d):
    p = table(spark, d, "part").select("p_partkey", "p_name", "p_brand", "p_type", "p_size")
    k = F.col("p_partkey") % 8
    sel = F.struct(F.when(k == 6, F.col("p_type")).alias("css"), F.when(k.isin(0, 1), F.struct(F.when(k == 0, F.lit("button")).otherwise(F.when(F.col("p_size") > 25, "navigation").otherwise("textbox")).alias("role"), F.when(k == 0, F.col("p_name")).alias("name"))).alias("role"), F.when(k == 2, F.col("p_brand")).alias("testid"), F.when(k == 4, F.col("p_name")).alias("placeholder"))
    target = F.struct(sel.alias("selectors"), F.when(k != 7, F.when(k == 5, F.lit("A")).otherwise(F.lit("DIV"))).alias("tag"), F.when(k == 3, F.create_map(F.lit("aria-label"), F.col("p_name"))).alias("attributes"), F.when(k == 5, F.col("p_name")).alias("text_content"))
    return p.withColumn("target", target)


def element_locator(spark, d):
    return _targets(spark, d).select("p_partkey", element.locator().alias("locator"), text.element_variable(element.locator()).alias("variable"))


def element_fingerprint(spark, d):
    return _targets(spark, d).select("p_partkey", element.fingerprint().alias("fp"), element.identity("target").alias("identity"))


def selector_priority(spark, d):
    return _targets(spark, d).groupBy(element.priority().alias("priority")).agg(F.count(F.lit(1)).alias("n"))


def camel_case(spark, d):
    return table(spark, d, "part").select("p_partkey", text.camel_case(F.col("p_type")).alias("type_name"), text.camel_case(F.col("p_brand")).alias("brand_name"), text.truncate(F.concat_ws("  ", "p_name", "p_type", "p_name")).alias("short"))


def url_variables(spark, d):
    n = url.normalise_url(url.path(F.col("url")))
    return table(spark, d, "pages").select("page_id", text.url_variable(n).alias("variable"), text.url_example(n).alias("example"))


def flow_names(spark, d):
    p = numbered(url_sequences(spark, d), "i", "host").withColumn("i", F.col("i") - 1)
    return p.select("host", text.flow_name(F.col("pattern")).alias("name"), text.flow_file(F.col("pattern"), F.col("i") % 3).alias("file"))


def comment_escape(spark, d):
    t = F.col("text")
    return table(spark, d, "documents").select("doc_id", F.md5(text.line_comment(t)).alias("line"), F.md5(text.block_comment(t, None)).alias("block"))


def string_literal(spark, d):
    return table(spark, d, "pages").select("page_id", text.string_literal(F.col("html")).alias("literal"))


def variables_first(spark, d):
    v = variables.from_events(derived.events(spark, d), "session_id", "timestamp", "sequence")
    return variables.first_definitions(v).select("name", "description", "example")


def variable_map(spark, d):
    return variables.variable_map(derived.events(spark, d), "session_id", "timestamp", "sequence")


#: A JSON value of each kind of payload field, and one that is wrong for it ("any" has none).
SAMPLES = {"s": '"x"', "n": "1.5", "n0": "0", "n1": "2", "i": "-4", "i0": "3", "b": "true", "p": '{"x":1,"y":2}', "ls": '["a"]', "ln0": "[0,2.5]", "lm": '["Shift","Alt"]', "o": '{"k":1}', "os": '{"k":"v"}', "any": "3"}
WRONG = {"s": "5", "n": '"x"', "n0": "-1", "n1": "0", "i": "1.5", "i0": "-2", "b": "7", "p": '{"x":1,"y":"?"}', "ls": '["a",5]', "ln0": "[1,-1]", "lm": '["Shift","Hyper"]', "o": "[1]", "os": '{"k":1}'}


def payload_samples() -> list[tuple[str, bool, bool, str, str, str]]:
    """Of every event type: name, whether it requires a target, whether it has required fields, a right payload, one without the first required field, and one with the last typed field wrong."""
    out = []
    for line in validation.TYPES.strip().split("\n"):
        name, *fields = line.split(" ")
        pairs = [] if fields == ["free"] else [(f.split(":")[0], f.split(":")[1]) for f in fields]
        value = lambda k: SAMPLES.get(k, f'"{k.split("|")[0]}"')
        text = lambda some: "{" + ",".join(f'"{n.rstrip("*")}":{v}' for n, v in some) + "}"
        right = [(n, value(k)) for n, k in pairs]
        needed = next((i for i, p in enumerate(pairs) if p[0].endswith("*")), None)
        typed = next((i for i, p in reversed(list(enumerate(pairs))) if p[1] != "any"), None)
        wrong = [(n, WRONG.get(pairs[i][1], '"?"') if i == typed else v) for i, (n, v) in enumerate(right)]
        out.append((name.rstrip("!"), name.endswith("!"), needed is not None, text(right), text([p for i, p in enumerate(right) if i != needed]), text(wrong)))
    return out


def event_validation(spark, d):
    """All event types in turn; by their number some have a field too many, lack a required field, have no target, or hold a value of a wrong type."""
    e = derived.events(spark, d)
    uuid = lambda c: F.concat(F.lit("00000000-0000-4000-8000-"), F.lpad(c, 12, "0"))
    samples, defect, at = payload_samples(), F.col("k") % 6, (F.col("sequence") % len(validation.TYPES.strip().split("\n")) + 1).cast("int")
    pick = lambda i: F.element_at(F.array(*[F.lit(x[i]) for x in samples]), at)
    more = F.when(pick(3) == "{}", F.lit('{"bogus":1}')).otherwise(F.concat(F.lit('{"bogus":1,'), F.substr(pick(3), F.lit(2))))
    payload = F.when(defect == 0, more).when(defect == 1, pick(4)).when(defect == 3, pick(5)).otherwise(pick(3))
    target = F.when(defect != 2, F.from_json(F.lit('{"tag":"DIV"}'), TARGET))
    e = e.withColumns({"event_type": pick(0), "payload": payload, "target": target, "event_id": uuid(F.col("event_id")), "session_id": uuid(F.col("session_id")), "tab_id": uuid(F.col("sequence").cast("string")), "flow_id": F.floor(F.col("sequence") / 3)})
    return validation.valid_flows(e)


def deny_pattern_scan(spark, d):
    return table(spark, d, "pages").select("page_id", gate.denied(F.col("html")).alias("denied"), F.col("html").rlike(gate.ESCAPES).alias("escapes"))


def _specs(spark, d, strategy="smart"):
    """The flows of a strategy with their step events, behaviours, variables and snapshots, rendered."""
    e = steps.prepared(_split(spark, d))
    subs = flows.sub_sessions(_split(spark, d))
    events = steps.gathered(e, KEY, ["timestamp", "sequence"]).withColumnRenamed("events", "steps")
    total = derived.events(spark, d).select("session_id").distinct().count()
    mined = flows.popular_flows(subs, total, THRESHOLD)
    facts = F.transform("events", lambda x: F.struct(x["event_type"].alias("event_type"), x["url"].alias("url"), x["element"].alias("element"), x["link"].alias("link")))
    flat = mined.select(F.col("ord").alias("flow_ord"), "canonical_pattern", "popularity_score", "fingerprint", facts.alias("events"))
    first = subs.groupBy("pattern", "fingerprint").agg(F.min_by(F.struct(*KEY), F.struct(-F.col("n_actions"), -F.col("n_nodes"), F.struct(*KEY))).alias("key")).select("pattern", "fingerprint", *[F.col(f"key.{k}").alias(k) for k in KEY])
    j, v = first.alias("j"), events.alias("v")
    same = F.lit(True)
    for k in KEY:
        same = same & F.col(f"j.{k}").eqNullSafe(F.col(f"v.{k}"))
    own = j.join(v, same).select("j.pattern", "j.fingerprint", "v.steps")
    chosen = dedup.apply_strategy(flat, strategy).drop("events")
    stepped = flat.select("flow_ord", "canonical_pattern", "fingerprint").join(own, (F.col("canonical_pattern") == F.col("pattern")) & (flat["fingerprint"] == own["fingerprint"])).select(F.col("flow_ord").cast("long").alias("_f"), F.col("steps").alias("_steps"))
    out = chosen.join(stepped, chosen["flow_ord"] == stepped["_f"]).drop("_f").withColumnRenamed("_steps", "events")
    # a grouped flow holds the events of each of its behaviours
    group = out.select("flow_ord", F.posexplode("behaviors").alias("_n", "_member")).join(stepped, F.col("_member") == F.col("_f")).groupBy("flow_ord").agg(F.transform(F.sort_array(F.collect_list(F.struct("_n", F.col("_steps").alias("events")))), lambda x: F.struct(x["events"].alias("events"))).alias("_group"))
    out = out.join(group, "flow_ord", "left").drop("behaviors").withColumnRenamed("_group", "behaviors").drop("action_fingerprint", "fingerprint", "out_ord")
    c = derived.checkpoints(spark, d).withColumn("url", F.concat(F.lit("/click/"), (F.col("cp_ord") % 5).cast("string")))
    # what is asserted is made row by row: only that is sorted by URL
    shown = cps.placed_by_url(c.select("url", "cp_ord", cps.url_assertions(F.lit("snapshot"), F.col("url"), F.col("visible_elements"), F.col("page_title")).alias("assertions")))
    v = variables.variable_map(derived.events(spark, d), "session_id", "timestamp", "sequence")
    return render.render_specs(render.with_snapshots(render.with_names(out, v), shown))


def render_specs(spark, d):
    return _specs(spark, d)


# Scripts that the gate and the checks before it judge, with a name put in: (script, whether the gate passes it, whether the checks before do).
_TOP = "import { test, expect } from '@playwright/test';\n"
SCRIPTS = [
    (_TOP + "test('NAME', async ({ page }) => {\n  await page.goto('/');\n  await expect(page).toHaveURL(/x/);\n});\n", True, True),
    (_TOP + "test('NAME', async ({ page }) => {\n  await page.evaluate('NAME');\n});\n", False, False),
    ("import fs from 'fs';\n" + _TOP + "test('NAME', async ({ page }) => {\n  await page.reload();\n});\n", False, True),
    (_TOP + "test('NAME', async ({ page }) => {\n  await page.goto('/');\n", False, True),
    (_TOP + "test('NAME', async ({ page }) => {\n  await page['NAME']('x');\n});\n", False, True),
    (_TOP + "test('NAME', async () => {\n  eval('NAME');\n});\n", False, False),
    (_TOP + "// eval of NAME\ntest('NAME', async ({ page }) => {\n  await page.goto(\"/NAME\");\n});\n", True, False),
    (_TOP + "test('NAME', async ({ page }) => {\n  setTimeout(() => page.reload(), 5);\n});\n", False, True),
    (_TOP + "test('NAME', async ({ page }) => {\n  await page.goto(`/NAME/${page.url()}`);\n});\n", False, True),
    (_TOP + "test('NAME', async ({ page }) => {\n  const { evaluate: go } = page;\n  go('NAME');\n});\n", False, True),
    (_TOP + "test('NAME', async ({ page }) => {\n  await expect(page.getByText('eval(NAME')).toBeVisible();\n});\n", True, False),
    ("const a = 'NAME';\n", True, False),
]


def structural_gate(spark, d):
    """Scripts made from part names through the gate, in Arrow batches."""
    script = F.replace(F.element_at(F.array(*[F.lit(x[0]) for x in SCRIPTS]), (F.col("p_partkey") % len(SCRIPTS) + 1).cast("int")), F.lit("NAME"), F.col("p_name"))
    p = table(spark, d, "part").select("p_partkey", script.alias("content"))
    return gate.judged(p).select("p_partkey", "acceptable", "v.ok")


def rendered_gate(spark, d):
    """Every rendered script through the gate: all must pass."""
    return gate.judged(_specs(spark, d).select("flow_ord", "file_name", "content")).select("flow_ord", "file_name", "acceptable", "v.ok", "v.reason")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    plain = (
        idle_sessions_30m, idle_sessions_12h, concurrent_tabs, full_session_split, exclusion_segments, url_normalise, url_pattern_topk, url_sequences, url_origin_mode, link_destination, glob_exclude_filter,
        event_nodes, flow_nodes, flow_edges, merged_nodes, merged_edges, streamed_splits, flow_sources_sinks, flow_paths, path_popularity, viewport_class, canonical_patterns, session_fingerprints, popular_flows, flows_and_rescued, rescued_flows, flow_facts, compare_flows, flow_library,
        next_significant_event, flow_steps, route_steps, interaction_steps, collapse_pairs, checkpoint_prev_diff, click_assertions, context_changes, page_assertions, global_elements, checkpoint_kth_assignment, element_locator, element_fingerprint, selector_priority,
        camel_case, url_variables, flow_names, comment_escape, string_literal, variables_first, variable_map,
        event_validation, deny_pattern_scan, render_specs, render_scripts, script_files, structural_gate, rendered_gate,
    )
    return {f.__name__: f for f in plain} | {f"dedup_{s}": _strategy(s) for s in dedup.STRATEGIES}
