"""Differences of snapshots against a plain version, and their work on large ones."""

import random
import time

from pyspark.sql import functions as F

from pathloom.operators import checkpoints as cps
from pathloom.operators import render
from pathloom.plans import queries
from pathloom.sources import derived

ELEMENT = "struct<tag:string,text_content:string,selectors:struct<css:string,testid:string,role:struct<role:string,name:string>>,attributes:map<string,string>>"


def el(name, text, **attributes):
    return ("DIV", text, (None, name, None), attributes)


def snapshots(spark, rows):
    return spark.createDataFrame(rows, f"n int, before array<{ELEMENT}>, after array<{ELEMENT}>")


def plain_visible(before, after):
    """The rule by hand: the last old element of an identity counts, three findings at most."""
    if before is None:
        return []
    old, out = {e[2][1]: e[1] for e in before}, []
    for _, text, (_, name, _), _ in after:
        place = f'await expect(page.getByTestId("{name}"))'
        if name not in old:
            out.append(place + ".toBeVisible()")
        elif old[name] != text and text and len(text) <= 50:
            out.append(f'{place}.toContainText("{text}")')
    return out[:3]


def test_visible_differences_equal_the_plain_rule(spark):
    rng = random.Random(5)
    side = lambda: [el(f"e{rng.randrange(6)}", rng.choice(["a", "b", "", None, "x" * 60])) for _ in range(rng.randrange(9))]
    rows = [(i, None if i % 17 == 0 else side(), side()) for i in range(200)]
    got = dict(snapshots(spark, rows).select("n", cps.diff_visible(F.col("before"), F.col("after"))).collect())
    assert got == {n: plain_visible(b, a) for n, b, a in rows}


def test_context_differences(spark):
    old = [el("t", "one"), el("v", "x", **{"aria-valuenow": "1"}), el("o", "x", **{"aria-expanded": "false"}), el("h", "x", **{"aria-hidden": "false"}), el("w", "x", style="width: 10%")]
    at = lambda name: f'await expect(page.getByTestId("{name}"))'
    cases = [
        (el("t", "two"), at("t") + '.toContainText("two")'), (el("t", "one"), None), (el("v", "x", **{"aria-valuenow": "2"}), at("v") + '.toHaveAttribute("aria-valuenow", "2")'),
        (el("o", "x", **{"aria-expanded": "true"}), at("o") + '.toHaveAttribute("aria-expanded", "true")'), (el("h", "x", **{"aria-hidden": "true"}), at("h") + ".toBeHidden()"),
        (el("w", "x", style="width: 55.5%"), at("w") + '.toHaveCSS("width", /55.5%/)'), (el("n", "new"), at("n") + ".toBeVisible()"), (el("n", "n" * 51), None),
    ]
    rows = [(i, old, [e]) for i, (e, _) in enumerate(cases)]
    got = dict(snapshots(spark, rows).select("n", cps.diff_context(F.col("before"), F.col("after"))).collect())
    assert got == {i: [want] if want else [] for i, (_, want) in enumerate(cases)}
    none = snapshots(spark, [(0, None, [el("n", "new")]), (1, old, None), (2, [], [])])
    assert dict(none.select("n", cps.diff_context(F.col("before"), F.col("after"))).collect()) == {0: [at("n") + ".toBeVisible()"], 1: None, 2: []}


def test_large_snapshots_take_linear_work(spark):
    """Ten thousand elements a side: by pairs these would be 10^8 comparisons."""
    i = F.sequence(F.lit(0), F.lit(9_999))
    made = lambda text: F.transform(i, lambda x: F.struct(F.lit("DIV").alias("tag"), text(x).alias("text_content"), F.struct(F.lit(None).cast("string").alias("css"), F.concat(F.lit("e"), x.cast("string")).alias("testid"), F.lit(None).cast("struct<role:string,name:string>").alias("role")).alias("selectors"), F.lit(None).cast("map<string,string>").alias("attributes")))
    rows = spark.range(4).select("id", made(lambda x: F.lit("same")).alias("before"), made(lambda x: F.when(x % 5000 == 4999, "other").otherwise("same")).alias("after"))
    begin = time.time()
    got = rows.select(cps.diff_visible(F.col("before"), F.col("after")).alias("d")).collect()
    assert all(r["d"] == [f'await expect(page.getByTestId("e{n}")).toContainText("other")' for n in (4999, 9999)] for r in got)
    assert time.time() - begin < 60


PLACE = "struct<url:string,norm:string,path:string>"
EVENTS = f"array<struct<type:string,page:{PLACE},to:{PLACE},dest:{PLACE},locator:string,link:boolean,leaves:boolean,payload:string,event_id:string>>"


def place(u):
    return (u, u, u)


def event(kind, at="/a", to="", dest=None, link=False):
    return (kind, place(at), place(to), dest and place(dest), None if kind == "navigation" else f"get({kind})", link, link, None, "i")


def random_flow(rng):
    some = lambda: rng.choice(["/a", "/a", "/b", "/c", "/d"])
    kinds = ["click", "click", "fill", "check", "navigation", "scroll", "hover", "api_error"]
    return [event(k, some(), some() if k == "navigation" else "", rng.choice([None, some()]) if k == "click" else None, rng.random() < 0.5) for k in (rng.choice(kinds) for _ in range(rng.randrange(1, 80)))]


def test_bounded_snapshots_give_the_scripts_of_all_snapshots(spark):
    """Scripts of flows and grouped ones are those that all snapshots of each URL give."""
    rng = random.Random(11)
    held = {u: [[f"await {u[1]}{k}()"] for k in range(1, n + 1)] for u, n in (("/a", 60), ("/b", 9), ("/c", 1))}
    modes = ["full", "nav_only", "interaction_only", "smart_grouped"]
    rows = [(i, "/p", 1.0, modes[i % 4], random_flow(rng), [(random_flow(rng),) for _ in range(3)] if i % 4 == 3 else None) for i in range(80)]
    flows = spark.createDataFrame(rows, f"flow_ord long, canonical_pattern string, popularity_score double, test_mode string, events {EVENTS}, behaviors array<struct<events:{EVENTS}>>")
    shown = spark.createDataFrame([(u, k, x) for u, lists in held.items() for k, x in enumerate(lists, 1)], "url string, k int, assertions array<string>")
    given = render.with_snapshots(flows, shown)
    texts = lambda df: dict(render.contents(df, ["flow_ord"]).collect())
    every = F.create_map(*[x for u, lists in held.items() for x in (F.lit(u), F.array(*[F.array(F.lit(a[0])) for a in lists]))])
    want = texts(flows.withColumn("snapshots", every))
    assert texts(given) == want and any("await a4()" in t for t in want.values())
    assert any("await " in t.split("test.beforeEach")[1].split("  });")[1] for i, t in want.items() if i % 4 == 3)
    sizes = {r["flow_ord"]: r["n"] for r in given.select("flow_ord", F.expr("aggregate(map_values(snapshots), 0, (a, x) -> a + size(x))").alias("n")).collect()}
    assert all((sizes[r[0]] or 0) <= 5 * max(len(e) for e in [r[4], *(b[0] for b in r[5] or [])]) * len(held) for r in rows)


def test_behaviours_fill_in_variables_of_their_own(spark):
    fill = event("fill")
    flows = spark.createDataFrame([(1, "/p", 1.0, "smart_grouped", [event("click")], [([event("click")],), ([fill],)])], f"flow_ord long, canonical_pattern string, popularity_score double, test_mode string, events {EVENTS}, behaviors array<struct<events:{EVENTS}>>")
    named = render.with_names(flows, spark.createDataFrame([("get(fill)", "fieldOne")], "locator string, name string"))
    assert "fill(testVariables.fieldOne)" in render.contents(named, ["flow_ord"]).first()["content"]


def test_all_checkpoints_reach_the_specs_in_their_order(spark, monkeypatch):
    """render_specs and rendered_gate: no checkpoint of a URL is left out."""
    seen, add = [], render.with_snapshots
    monkeypatch.setattr(render, "with_snapshots", lambda flows, shown: seen.append(shown) or add(flows, shown))
    for name in ("render_specs", "rendered_gate"):
        queries.queries()[name](spark, "/root/testdata/sf0.001")
        got = sorted((r["cp_ord"] % 5, r["k"], r["cp_ord"]) for r in seen.pop().collect())
        pages = sorted(r["cp_ord"] for r in derived.checkpoints(spark, "/root/testdata/sf0.001").select("cp_ord").collect())
        assert got == sorted((u, k, o) for u in range(5) for k, o in enumerate([p for p in pages if p % 5 == u], 1))
        assert max(k for _, k, _ in got) > 3
