"""Cases for operators and functions that the tables don't hold."""

import json

import pytest
from pyspark.sql import functions as F

from pathloom.functions import element, text, url
from pathloom.plans.queries import SAMPLES, WRONG
from pathloom.operators import compare, dedup, flows, gate, graph, refine, render, sessions, steps, validation, variables
from pathloom.schema import EVENT, TARGET
from pathloom.streaming import sessions as streaming


def one(spark, column, **values):
    """Value of a Column expression over one row of strings."""
    names = list(values) or ["x"]
    return spark.createDataFrame([tuple(values.get(n) for n in names)], ", ".join(f"{n} string" for n in names)).select(column.alias("v")).first()["v"]


@pytest.mark.parametrize(
    ("given", "want"),
    [
        ("/users/123/posts", "/users/:id/posts"), ("/api/550e8400-E29B-41d4-a716-446655440000", "/api/:uuid"), ("/b/my-first-post", "/b/:slug"), ("/x/507f1f77bcf86cd799439011", "/x/:objectId"),
        ("/x/123456789012345678901234", "/x/:objectId"), ("/a-b", "/a-b"), ("https://h.org/p/12?q=1#f", "https://h.org/p/:id"), ("HTTP://h/1", "/:id"), ("https://h/p/1;v=2", "https://h/p/:id;v=2"), ("", ""), ("/a//2/", "/a//:id/"),
        ("https://h.org", "https://h.org"), ("/p?x=1", "/p"),
    ],
)
def test_normalise_url(spark, given, want):
    assert one(spark, url.normalise_url(F.col("u")), u=given) == want


def test_url_sequence_and_globs(spark):
    urls = F.array(*[F.lit(u) for u in ("/a/1", "/a/2", "/b", "/b", "/a/3")])
    assert one(spark, url.url_sequence(urls)) == "/a/:id → /b → /a/:id"
    assert one(spark, url.url_sequence(F.array().cast("array<string>"))) == ""
    for u, patterns, want in [("/admin/x/y", ["/admin/*"], True), ("/admin", ["/admin/*"], False), ("https://h/admin/x", ["/admin/*"], True), ("https://h", ["/"], True), ("/p7", ["/p[0-9]"], True), ("/pa", ["/p[!a]"], False), ("https://h/x", ["https://*/x"], True), ("/x", [], False)]:
        assert one(spark, url.is_excluded(F.col("u"), patterns), u=u) is want


def target(**x):
    return json.dumps(x)


@pytest.mark.parametrize(
    ("given", "locator", "rank", "mark"),
    [
        (target(tag="BUTTON", selectors={"role": {"role": "button", "name": 'Say "hi"\n now'}}), r'getByRole("button", { name: "Say \"hi\" now" })', 1, 'BUTTON|role:button|name:Say "hi" now'),
        (target(tag="NAV", selectors={"role": {"role": "navigation"}}), 'getByRole("navigation")', 1, "NAV|role:navigation"),
        (target(tag="input", selectors={"role": {"role": "textbox"}, "css": "#a"}), 'locator("#a")', 6, "INPUT|role:textbox|css:#a"),
        (target(tag="A", attributes={"data-testid": "t"}), 'getByTestId("t")', 2, "A|testid:t"), (target(tag="A", attributes={"aria-label": "L"}), 'getByLabel("L")', 3, "A"),
        (target(tag="INPUT", selectors={"placeholder": "P"}), 'getByPlaceholder("P")', 4, "INPUT"), (target(tag="A", text_content="go </b>"), r'getByText("go \u003c/b>")', 5, "A"), (target(tag="DIV", text_content="go"), 'locator("div")', 7, "DIV"),
        (target(), None, 99, ""), (None, None, 99, ""),
    ],
)
def test_elements(spark, given, locator, rank, mark):
    t = F.from_json(F.col("t"), TARGET)
    got = spark.createDataFrame([(given,)], "t string").select(t.alias("target")).select(element.locator().alias("l"), element.priority().alias("p"), element.fingerprint().alias("f")).first()
    assert (got["l"], got["p"], got["f"]) == (locator, rank, mark)


@pytest.mark.parametrize("value", ['x"); evil(); ("', "a\\b", "`${x}`", "</script>", "l\u2028p\u2029", "é\n\t", "", None, "y" * 300])
def test_literals_round_trip(spark, value):
    made = one(spark, text.string_literal(F.col("s")), s=value)
    assert made == steps.literal(value)
    assert json.loads(made) == (value or "")[:250]
    assert not any(c in made for c in "<`\u2028\u2029") and "${" not in made


def test_names(spark):
    assert [one(spark, text.camel_case(F.col("s")), s=s) for s in ("Full Name *", "john@example.com", "--", "a_b-c")] == ["fullName", "johnExampleCom", "unnamed", "aBC"]
    assert one(spark, text.element_variable(F.col("s")), s='getByRole("textbox", { name: "Full Name *" })') == "fullName"
    assert one(spark, text.element_variable(F.col("s")), s='getByText("x")') is None
    assert one(spark, text.url_variable(F.col("s")), s="/:id/x") == "resource_id"
    long = " → ".join(f"/page-{i}" for i in range(60))
    name = one(spark, text.flow_file(F.col("s"), F.lit(1)), s=long)
    assert name.endswith("-2.spec.ts") and len(name) == 180 + 9 + 2 + 8
    assert one(spark, text.block_comment(F.col("s")), s="a */ b\nc") == "a * / b c"


def events(spark, rows):
    """Events from (session, tab, minute, type, url, target, payload)."""
    out = [(f"e{i}", s, tab, i, m * 60, kind, u, t, p) for i, (s, tab, m, kind, u, t, p) in enumerate(rows)]
    df = spark.createDataFrame(out, "event_id string, session_id string, tab_id string, sequence long, sec long, event_type string, url string, t string, payload string")
    return df.select("event_id", "session_id", "tab_id", "sequence", F.timestamp_seconds("sec").alias("timestamp"), "event_type", "url", F.from_json("t", TARGET).alias("target"), "payload", F.lit(None).cast("string").alias("page_context"), F.lit(1).alias("schema_version"))


def test_idle_and_tab_splits(spark):
    e = events(spark, [("s", "a", m, "click", "/x", None, None) for m in (0, 30, 61)])
    assert [r["sub_idx"] for r in sessions.split_sessions(e).orderBy("sequence").collect()] == [0, 0, 1]
    e = events(spark, [("s", "a", 0, "click", "/", None, None), ("s", "b", 1, "click", "/", None, None), ("s", "a", 2, "click", "/", None, None), ("s", None, 2, "click", "/", None, None), ("s", None, 3, "click", "/", None, None)])
    assert [(r["is_concurrent"], r["group_tab"]) for r in sessions.split_sessions(e).orderBy("sequence").collect()] == [(True, "a"), (True, "b"), (True, "a"), (False, None), (False, None)]
    e = events(spark, [("s", "a", i, "click", u, None, None) for i, u in enumerate(["/h", "/h", "/h", "/admin", "/d", "/d"])])
    assert sessions.split_exclusions(e, ["/admin"], ["session_id"]).count() == 3
    assert sessions.split_exclusions(e, [], ["session_id"]).count() == 6


LOGIN = [
    ("navigation", "/", None, {"to_url": "/login"}), ("fill", "/login", {"tag": "INPUT", "selectors": {"testid": "user"}}, {"value": "ann"}), ("fill", "/login", {"tag": "INPUT", "selectors": {"testid": "pass"}}, {"value": "[REDACTED]"}),
    ("click", "/login", {"tag": "BUTTON", "selectors": {"role": {"role": "button", "name": "Sign in"}}}, {}), ("navigation", "/login", None, {"to_url": "/home"}),
]


def login(spark, n=4):
    return events(spark, [(f"s{k}", "t", i, kind, u, t and json.dumps(t), json.dumps(p)) for k in range(n) for i, (kind, u, t, p) in enumerate(LOGIN)])


def test_login_journey_from_events_to_script(spark):
    e = sessions.split_sessions(login(spark))
    flow = flows.popular_flows(flows.sub_sessions(e), 4).collect()
    assert [(f["canonical_pattern"], f["session_count"], f["popularity_score"], f["rescued"]) for f in flow] == [("/login → /home", 4, 100.0, False)]
    nodes, edges = graph.build_graph(e)
    assert {r["node"]: r["count"] for r in nodes.collect()}["nav:/login"] == 4 and edges.count() == 4
    mined = graph.popular_paths(nodes, edges, 4).collect()
    assert [(f["canonical_pattern"], f["session_count"]) for f in mined] == [("/login → /home", 4)]
    made = [r["step_event"].asDict(True) for r in steps.prepared(login(spark, 1)).orderBy("sequence").collect()]
    sink = render.SpecGenerator()
    script = sink.generate_script({"name": "login to home", "canonical_pattern": "/login → /home", "popularity_score": 100.0, "events": made})
    for part in ['await page.goto("/login");', 'getByTestId("user").fill("ann")', 'fill("TestPass123!")', 'name: "Sign in" }).click();', 'await page.waitForURL("/home");', "toHaveURL(/\\/home/)"]:
        assert part in script
    assert gate.structural_gate(script)
    named = variables.first_definitions(variables.from_events(login(spark, 1), "sequence")).orderBy("place").collect()
    assert [(r["name"], r["example"]) for r in named] == [("user", "ann"), ("pass", "TestPass123!")]
    assert 'user: "ann",' in render.variables_file([(r["name"], r["description"], r["example"]) for r in named]) and "testVariables = {}" in render.variables_file([])
    with_names = sink.generate_script({"name": "n", "canonical_pattern": "p", "events": made}, variable_map={'getByTestId("user")': "user"})
    assert "import { testVariables }" in with_names and ".fill(testVariables.user)" in with_names
    assert "goto" in sink.generate_script({"name": "n", "canonical_pattern": "p", "events": made}, "smart_grouped")
    assert sink.generate_script({"name": "n", "canonical_pattern": "p", "events": made}, "nav_only").count("fill(") == 0
    assert "playwright/test" in sink.generate_config("x.org") and "1 flows" not in sink.generate_readme([], "x.org")


def test_rescue_of_varied_routes(spark):
    save = {"tag": "BUTTON", "selectors": {"testid": "save"}}
    rows = []
    for k in range(10):
        rows += [(f"p{k}", "t", i, "click", u, json.dumps({"tag": "BUTTON", "selectors": {"testid": "go"}}), "{}") for i, u in enumerate(["/a", "/b", "/c"])]
    for k, order in enumerate([["/x", "/y", "/z"], ["/z", "/y", "/x"], ["/y", "/x", "/z"]]):
        rows += [(f"q{k}", "t", i, "click", u, json.dumps(save), "{}") for i, u in enumerate(order)]
    got = flows.popular_flows(flows.sub_sessions(sessions.split_sessions(events(spark, rows))), 13, 20.0).collect()
    assert [(f["session_count"], f["rescued"]) for f in got] == [(10, False), (3, True)]
    assert got[1]["canonical_pattern"] == "/x → /y → /z"


def flow_rows(spark, rows):
    """Flows from (ord, pattern, score, [(type, url, element, link)])."""
    return spark.createDataFrame(rows, "flow_ord int, canonical_pattern string, popularity_score double, events array<struct<event_type:string,url:string,element:string,link:boolean>>")


def modes(spark, rows, strategy):
    return [(r["flow_ord"], r["test_mode"]) for r in dedup.apply_strategy(flow_rows(spark, rows), strategy).orderBy("out_ord").collect()]


def test_strategies(spark):
    nav, save, other = ("navigation", "/a", "", False), ("click", "/p", "SAVE", False), ("click", "/p", "OTHER", False)
    rows = [(1, "A", 5.0, [nav, save]), (2, "B", 9.0, [nav, save]), (3, "B", 4.0, [other]), (4, "C", 1.0, [nav])]
    assert modes(spark, rows, "full") == [(1, "full"), (2, "full"), (3, "full"), (4, "full")]
    assert modes(spark, rows, "lean") == [(2, "full"), (3, "full"), (4, "full")]
    assert modes(spark, rows, "smart") == modes(spark, rows, "no such") == [(2, "smart_grouped"), (4, "full"), (1, "nav_only")]
    assert modes(spark, rows, "modular") == [(2, "interaction_only"), (3, "interaction_only"), (4, "full"), (2, "nav_only"), (1, "nav_only")]
    # a click that a navigation follows is no interaction, whatever noise stands between
    led = [(1, "A", 1.0, [("click", "/a", "X", False), ("blur", "/a", "", False), nav])]
    assert dedup.with_facts(flow_rows(spark, led)).first()["has_interactions"] is False


def test_compare(spark):
    schema = "ord int, canonical_pattern string, significant_actions array<struct<url:string,type:string,element:string>>"
    a, b = [("/x", "click", "e")], [("/x", "click", None)]
    new = spark.createDataFrame([(1, "same", a), (2, "diff", b), (3, "new", a)], schema)
    old = spark.createDataFrame([(1, "same", a, "active"), (2, "diff", a, "active"), (3, "gone", a, "active"), (4, "old", a, "archived")], schema + ", status string")
    assert [(r["canonical_pattern"], r["status"]) for r in compare.compare_flows(new, old).orderBy("result_ord").collect()] == [("same", "unchanged"), ("diff", "changed"), ("new", "new"), ("gone", "inactive")]


def place(u):
    return {"url": u, "norm": u, "path": u}


def ev(kind, page="/p", locator=None, to="", dest=None, link=False, payload=None, key=None):
    return {"type": kind, "page": place(page), "to": place(to), "dest": dest and place(dest), "locator": locator, "link": link, "leaves": bool(dest and dest != page), "payload": payload and json.dumps(payload), "event_id": key}


def test_steps():
    clicks = [ev("click", locator="b", key=str(i)) for i in range(4)]
    got = steps.Builder(clicks, clicks={"2": ["check two"]}).full()
    assert [(s.get("repeat_count"), s["assertions"]) for s in got] == [(4, ["check two"])]
    got = steps.Builder([ev("click", locator="c"), ev("check", locator="c", payload={"checked": False})]).full()
    assert [s["type"] for s in got] == ["check"] and "not.toBeChecked" in got[0]["assertions"][0]
    trip = [ev("click", "/a", "link", dest="/b", link=True), ev("blur"), ev("navigation", "/b", to="/b"), ev("fill", "/b", "f", payload={"value": "v"})]
    held = {"/b": [["first"], ["second"]]}
    assert [(s["type"], s["assertions"]) for s in steps.Builder(trip, held).full()] == [("click", ["await expect(page).toHaveURL(/\\/b/)", "first"]), ("navigation", ["await expect(page).toHaveURL(/\\/b/)"]), ("fill", ["await expect(page.f).toHaveValue(\"v\")"])]
    assert [s["type"] for s in steps.Builder(trip).routes()] == ["click"]
    assert [s["type"] for s in steps.Builder(trip).interactions()] == ["fill"]
    assert steps.with_screenshots([{"type": "click", "locator": 'a("b")', "assertions": []}])[0]["assertions"] == ['await expect(page).toHaveScreenshot("step-1-click-a(b).png")']
    named = [{"test_name": "counter", "steps": [{"locator": 'x({ name: "A" })'}]}, {"test_name": "counter", "steps": [{"locator": 'x({ name: "B" })'}]}]
    steps.unique_names(named)
    assert [b["test_name"] for b in named] == ["counter — A", "counter — B"]
    assert steps.behavior_name([{"type": "click", "locator": 'n("+")'}, {"type": "check", "locator": "toggle"}], 0) == "counter, toggle"
    assert render.unique_files(["a.spec.ts", "a.spec.ts", "a-2.spec.ts"]) == ["a.spec.ts", "a-2.spec.ts", "a-2-2.spec.ts"]


SPEC = "import { test, expect } from '@playwright/test';\ntest('a', async ({ page }) => {\n  await page.goto('/');\n  %s\n});"


@pytest.mark.parametrize("body", ["await expect(page).toHaveURL(/a\\/b(c)/);", "const { a } = data; a.click();", "for (const x of [1]) { console; }", "const n = rows[0];", "// page.evaluate(x)", "await page.getByText('eval(1)').click();", "const b = page.locator('x'); await b.click();", "items.map(i => i.trim());"])
def test_gate_accepts(body):
    assert gate.structural_gate(SPEC % ("const data = 1, rows = 2, items = 3; " + body).replace("const data = 1, rows = 2, items = 3;", "const data = 1; const rows = 2; const items = 3;"))


@pytest.mark.parametrize("body", [
    "process.exit(1);", "page.addInitScript(x);", "eval('1');", "x['constructor']();", "const go = page.evaluate; go(1);", "const { evaluate: run } = page; run(1);", "`${steal()}`;", "import('fs');", "unknown();", "'a'.at(0);",
    "page.route('*', 1);", "request.fetch('u');", "f('unterminated);", "((1);", "import x from 'fs';", "/* open", "setTimeout(1);", "globalThis.alert(1);",
])
def test_gate_refuses(body):
    assert not gate.structural_gate(SPEC % body)
    assert not gate.structural_gate(None)


def test_refinement(spark):
    good, bad = SPEC % "await expect(page).toHaveTitle(/x/);", SPEC % "eval('x');"
    scripts = spark.createDataFrame([("a", "old a", "a.ts"), ("b", "old b", "b.ts"), ("c", "old c", "c.ts")], "flow_pattern string, content string, filename string")
    known = spark.createDataFrame([("a",), ("b",), ("c",)], "canonical_pattern string")

    def refiner(prompt):
        if "Flow: c" in prompt:
            raise RuntimeError
        return f"```typescript\n{good if 'Flow: a' in prompt else bad}\n```"

    got = {r["flow_pattern"]: (r["content"], r["ai_refined"]) for r in refine.refine_scripts(scripts, known, None, refiner).collect()}
    assert got == {"a": (good, True), "b": ("old b", True), "c": ("old c", False)}


def test_validation(spark):
    u = lambda i: f"00000000-0000-4000-8000-{i:012d}"
    rows = [(1, "click", "{}", True), (1, "click", '{"bogus":1}', True), (2, "scroll", '{"x":1,"y":2,"direction":"up"}', False), (3, "scroll", '{"x":1,"y":2,"direction":"in"}', False), (4, "click", "{}", False), (5, "focus", '{"any":1}', True), (6, "pinch_zoom", '{"scale":0,"center":{"x":1,"y":1}}', False), (7, "blur", "{}", False)]
    df = spark.createDataFrame([(f, u(i), u(1), u(2), i, k, p, '{"tag":"A"}' if t else None) for i, (f, k, p, t) in enumerate(rows)], "flow_id int, event_id string, session_id string, tab_id string, sequence long, event_type string, payload string, t string")
    df = df.select("*", F.from_json("t", TARGET).alias("target"), F.current_timestamp().alias("timestamp"), F.lit("/x").alias("url"), F.lit('{"title":"T","url":"/over"}').alias("page_context"), F.lit(1).alias("schema_version"))
    assert {r["flow_id"]: r["valid"] for r in validation.valid_flows(df).collect()} == {1: False, 2: True, 3: False, 4: False, 5: True, 6: False, 7: False}
    assert validation.wire_shape(df).first()["page"]["url"] == "/over"
    assert len(EVENT) > 0


def test_link_clicks_are_no_interactions_of_mined_flows(spark):
    link, button = '{"tag":"A","attributes":{"href":"/two"}}', '{"tag":"BUTTON","selectors":{"testid":"go"}}'
    rows = [("s", "t", i, "click", "/one", t, None) for i, t in enumerate([link, button, link, button])] + [("s", "t", 4, "click", "/one", '{"tag":"A","attributes":{"href":"#top"}}', None)]
    subs = flows.sub_sessions(sessions.split_sessions(events(spark, rows)))
    got = subs.select("events", dedup.interactions("events").alias("i")).first()
    # no navigation follows the links: only what they point to tells that they aren't interactions
    assert [e["link"] for e in got["events"]] == [True, False, True, False, False]
    assert [e["element"] for e in got["i"]] == [e["element"] for e in got["events"] if not e["link"]]


def test_every_payload_field_has_its_type(spark):
    rows = []
    for line in validation.TYPES.strip().split("\n"):
        name, *fields = line.split(" ")
        for i, f in enumerate(fields if fields != ["free"] else []):
            kind = f.split(":")[1]
            for value, right in [(SAMPLES.get(kind, f'"{kind.split("|")[0]}"'), True), (WRONG.get(kind, '"?"') if kind != "any" else None, False), ("null", "*" not in f)]:
                if value is not None:
                    others = {g.split(":")[0].rstrip("*"): SAMPLES.get(g.split(":")[1], f'"{g.split(":")[1].split("|")[0]}"') for j, g in enumerate(fields) if j != i and "*" in g.split(":")[0]}
                    body = {**others, f.split(":")[0].rstrip("*"): value}
                    rows.append((name.rstrip("!"), "{" + ",".join(f'"{k}":{v}' for k, v in body.items()) + "}", right))
    rows += [("fill", '{"value":"5"}', True), ("scroll", '{"x":"5","y":2,"direction":"up"}', True), ("fill", "{broken", False), ("fill", "[1]", False), ("focus", "[1]", False), ("focus", None, True), ("file_upload", '{"filenames":[],"mimes":["a",null]}', False)]
    u = "00000000-0000-4000-8000-000000000001"
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "flow_id int, event_type string, payload string, right boolean")
    df = df.select("*", *[F.lit(u).alias(c) for c in ("event_id", "session_id", "tab_id")], F.lit(1).cast("long").alias("sequence"), F.from_json(F.lit('{"tag":"A"}'), TARGET).alias("target"), F.current_timestamp().alias("timestamp"), F.lit("/x").alias("url"), F.lit("{}").alias("page_context"), F.lit(1).alias("schema_version"))
    got = {r["flow_id"]: r["valid"] for r in validation.valid_flows(df).collect()}
    assert [r for i, r in enumerate(rows) if got[i] != r[2]] == []


def test_streamed_sessions_equal_the_batch_split(spark, tmp_path):
    rows = [("s", "t", m, "click", "/x", None, None) for m in (0, 10, 40, 71)] + [("end", "t", 500, "click", "/x", None, None)]
    batch = events(spark, rows)
    batch.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(batch.schema).parquet(str(tmp_path / "in"))
    out = []
    query = streaming.mine_stream(stream, lambda df, _: out.extend(df.select("session_id", "n_events").collect()), str(tmp_path / "cp"))
    query.processAllAvailable()
    query.stop()
    assert sorted((r["session_id"], r["n_events"]) for r in out) == [("s", 1), ("s", 3)]
