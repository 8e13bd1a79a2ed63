"""Relative links against the standard library, and the path search against walking the graph in Python."""

import random
from urllib.parse import urljoin, urlparse

import pytest
from pyspark.sql import functions as F

from pathloom.functions import url
from pathloom.operators.graph import flow_paths
from pathloom.operators.render import SpecGenerator, unique_files, variables_file

BASES = ["http://h/a/b.html", "http://h", "http://h/", "https://h:8/a/b/", "/x/y.html", "http://h/a/b;p?q=1#f", "http://h/a//b/c", "HTTP://H/x"]
REFERENCES = [
    "about.html", "../x", "../../../x", "./x/../y?a=1#b", "?q=2", "?", "x;p", "..", ".", "a/./b/", "mailto:z", "http:foo", "http:/foo", "//o/p", " lead.html", "a\tb", "x//y", "#f", "foo:bar", ";p", "x?y#z", "%20", "é/../ü",
]


def test_join_follows_the_standard_library(spark):
    df = spark.createDataFrame([(b, r) for b in [*BASES, "", "about:blank"] for r in REFERENCES], "b string, r string")
    for x in df.select("b", "r", url.join(F.col("b"), F.col("r")).alias("j")).collect():
        assert x["j"] == urljoin(x["b"], x["r"]), (x["b"], x["r"])
    assert spark.createDataFrame([(None, "x"), ("http://h", None)], "b string, r string").where(url.join(F.col("b"), F.col("r")).isNotNull()).count() == 0


def slow_link(page, href):
    """(whether a link click leaves the page, its destination)"""
    if not href or href.startswith("#") or href.startswith("javascript:"):
        return False, None
    at = urlparse(page)
    goal = href if href.startswith(("http://", "https://")) else f"{at.scheme}://{at.netloc}{href}" if href.startswith("/") else urljoin(page, href)
    return (True if not page else urlparse(goal).path != at.path), goal


def test_links_with_relative_references(spark):
    hrefs = [*[r for r in REFERENCES if not r.startswith("//")], "", "/b.html", "http://h/a/b.html", "javascript:void(0)", "b.html", "./b.html", "../a/b.html"]
    rows = [(b, h, "a") for b in BASES for h in hrefs] + [("http://h/", "x.html", "BUTTON"), ("http://h/", None, "A")]
    df = spark.createDataFrame(rows, "url string, href string, tag string").withColumn("target", F.struct("tag", F.create_map(F.lit("href"), "href").alias("attributes")))
    for x in df.select("*", url.is_link_nav().alias("nav"), url.link_destination().alias("dest")).collect():
        want = slow_link(x["url"], x["href"]) if x["tag"].upper() == "A" else (False, None)
        assert (x["nav"], x["dest"]) == want, (x["url"], x["href"])


def walk(weights, starts, ends, cutoff, most):
    """Paths by a depth-first search, heaviest edge first, ties by the greater node."""
    out = []

    def go(path):
        if len(out) >= most:
            return
        if len(path) >= 3 and path[-1] in ends:
            out.append(list(path))
        if len(path) < cutoff:
            for _, n in sorted(((w, b) for (a, b), w in weights.items() if a == path[-1] and b not in path), reverse=True):
                go([*path, n])

    for s in starts:
        go([s])
    return out[:most]


@pytest.mark.parametrize("block", [50_000, 3])
def test_paths_are_those_of_a_depth_first_search(spark, block):
    """A block of 3 partial paths leaves most of every level to be taken up later; no path may be lost."""
    rnd = random.Random(2)
    names = [f"n{i}" for i in range(6)]
    weights = {(a, b): rnd.randint(1, 5) for a in names[:-1] for b in names[1:] if a != b and rnd.random() < 0.6}
    weights |= {("n0", "dead"): 9, ("dead", "end"): 9, ("end", "dead"): 1}
    nodes = spark.createDataFrame([(n, 1, "/", "click", i) for i, n in enumerate([*names, "dead", "end"])], "node string, count long, url string, event_type string, first long")
    edges = spark.createDataFrame([(a, b, w) for (a, b), w in weights.items()], "src string, dst string, weight long")
    starts = [n for n in [*names, "dead", "end"] if n not in {b for _, b in weights}]
    ends = {n for n in [*names, "dead", "end"] if n not in {a for a, _ in weights}}
    for most in (4, 500):
        got = flow_paths(nodes, edges, max_paths=most, cutoff=5, block=block).orderBy("path_ord").collect()
        want = walk(weights, starts, ends, 5, most)
        assert [r["path"] for r in got] == want
        assert [r["weight"] for r in got] == [sum(weights[e] for e in zip(p, p[1:], strict=False)) for p in want]


def test_files_and_texts():
    assert unique_files(["a.spec.ts", "a.spec.ts", "a-2.spec.ts", "a.spec.ts"]) == ["a.spec.ts", "a-2.spec.ts", "a-2-2.spec.ts", "a-3.spec.ts"]
    assert "testVariables = {}" in variables_file([]) and 'email: "x",' in variables_file([("email", "Form value", "x")])
    sink = SpecGenerator()
    assert '"https://shop.test"' in sink.generate_config("shop.test") and '"http://h:1"' in sink.generate_config("shop.test", "http://h:1")
    text = sink.generate_readme([{"name": "A", "file": "a.spec.ts", "session_count": 3}, {"name": "A", "file": "a.spec.ts", "session_count": 4, "test_mode": "nav_only"}], "shop.test", "smart", 5)
    assert "shop.test" in text and "7 recorded" in text and "`a-2.spec.ts`" in text and "nav-only" in text and "5 flows in 2 files" in text
