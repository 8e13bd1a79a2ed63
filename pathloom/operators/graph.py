"""Flow graph: nodes and edges from sub-sessions, and its heaviest paths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pathloom.functions.element import locator
from pathloom.functions.url import normalise_url, url_sequence
from pathloom.operators.sessions import SUB_KEY
from pathloom.schema import NODE_SKIP, ORDER
from pathloom.session import written

MAX_PATHS, CUTOFF, MIN_NODES, ENTRY_FALLBACK = 500, 12, 3, 5
#: Partial paths that are extended at a time, in the order of the search.
BLOCK = 50_000


def event_node(target: str = "target") -> Column:
    """Node of an event: nav:URL for navigations, else URL||type[||locator]; null for types that are skipped."""
    to_url = normalise_url(F.coalesce(F.get_json_object("payload", "$.to_url"), F.lit("")))
    where = F.concat_ws("||", normalise_url(F.col("url")), F.coalesce(F.col("event_type"), F.lit("")), locator(target))
    return F.when(F.col("event_type").isin(NODE_SKIP), None).when(F.col("event_type") == "navigation", F.concat(F.lit("nav:"), to_url)).otherwise(where)


def node_url(node: Column) -> Column:
    return F.when(node.startswith("nav:"), F.substring(node, F.lit(5), F.length(node))).otherwise(F.split_part(node, F.lit("||"), F.lit(1)))


def node_action(node: Column) -> Column:
    """struct(url, type, element) of a node; null for a node that is neither."""
    parts = F.split(node, r"\|\|", 3)
    nav = F.struct(F.substring(node, F.lit(5), F.length(node)).alias("url"), F.lit("navigation").alias("type"), F.lit(None).cast("string").alias("element"))
    return F.when(node.startswith("nav:"), nav).when(node.contains("||"), F.struct(F.get(parts, F.lit(0)).alias("url"), F.get(parts, F.lit(1)).alias("type"), F.get(parts, F.lit(2)).alias("element")))


def graph_nodes(events: DataFrame, keys: list[str] = SUB_KEY, order: list[str] = ORDER) -> DataFrame:
    """(keys, order, node, url, event_type) of the events that are nodes, in sub-sessions of at least 2 events."""
    # counted in the order of the transitions: their window needs no sort of its own
    n = F.count(F.lit(1)).over(Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    # what has no node is told by its type: a filter on the node would compute it twice
    counted = events.withColumn("_n", n).where("_n >= 2").where(~F.coalesce(F.col("event_type"), F.lit("")).isin(NODE_SKIP))
    return counted.withColumn("node", event_node()).select(*keys, *[o for o in order if o not in keys], "node", "url", "event_type")


def build_graph(events: DataFrame, keys: list[str] = SUB_KEY, order: list[str] = ORDER) -> tuple[DataFrame, DataFrame]:
    """nodes(node, count, url, event_type, first) and edges(src, dst, weight).

    ``first`` is the place of the node's first occurrence. A weight counts transitions; self-loops are
    left out. The events are read once, for the transitions with their counts, which combine on the map side and are
    checkpointed: both tables are made of these.
    """
    rows = graph_nodes(events, keys, order)
    place = F.struct(*keys, *order)
    steps = rows.withColumn("src", F.lag("node").over(Window.partitionBy(*keys).orderBy(*order)))
    seen = written(steps.groupBy("src", "node").agg(F.count(F.lit(1)).alias("n"), F.min_by(F.struct("url", "event_type"), place).alias("f"), F.min(place).alias("first")))
    nodes = seen.groupBy("node").agg(F.sum("n").alias("count"), F.min_by("f", "first").alias("_f"), F.min("first").alias("first")).select("node", "count", "_f.url", "_f.event_type", "first")
    return nodes, seen.where("src is not null and src <> node").select("src", F.col("node").alias("dst"), F.col("n").alias("weight"))


def entries_and_exits(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(node, entry_ord) and (node): sources and sinks, or where there are none the top navigations and the last node."""
    sources = nodes.join(edges.select(F.col("dst").alias("node")).distinct(), "node", "left_anti").select("node", F.struct("first").alias("o"))
    tops = nodes.where(F.col("node").startswith("nav:")).orderBy(F.desc("count"), "first").limit(ENTRY_FALLBACK).select("node", "count", "first")
    if sources.isEmpty():
        if tops.isEmpty():
            tops = nodes.orderBy("first").limit(1).select("node", "count", "first")
        starts = tops.select("node", F.row_number().over(Window.orderBy(F.desc("count"), "first")).alias("entry_ord"))
    else:
        starts = sources.select("node", F.row_number().over(Window.orderBy("o")).alias("entry_ord"))
    ends = nodes.join(edges.select(F.col("src").alias("node")).distinct(), "node", "left_anti").select("node")
    if ends.isEmpty():
        ends = nodes.orderBy(F.desc("first")).limit(1).select("node")
    return starts, ends


def reaching(edges: DataFrame, ends: DataFrame, steps: int) -> DataFrame:
    """(node): those from which an end is reached in at most so many steps, the ends included."""
    known = written(ends.select("node").distinct())
    size = known.count()
    for _ in range(steps):
        before = edges.join(known.withColumnRenamed("node", "dst"), "dst", "left_semi").select(F.col("src").alias("node"))
        known = written(known.unionByName(before).distinct())
        n = known.count()
        if n == size:
            break
        size = n
    return known


def flow_paths(nodes: DataFrame, edges: DataFrame, max_paths: int = MAX_PATHS, cutoff: int = CUTOFF, block: int = BLOCK) -> DataFrame:
    """(path_ord, path, weight, min_weight): the first ``max_paths`` simple paths from entries to exits.

    The order is that of a depth-first search that takes the heaviest edge first (ties: the greater node): paths are
    extended level by level with the ranks of their edges and sorted by these. Only edges to nodes from which
    an exit can be reached are followed. Where a level has more than ``block`` partial paths, the first of them are
    extended to the end first; the others wait and are taken up in turn while fewer than ``max_paths`` paths that
    come before them are known, so that no path is lost and no level outgrows its block. The driver holds
    ``max_paths`` paths at most.
    """
    spark = nodes.sparkSession
    nodes, edges = written(nodes), written(edges)
    starts, ends = entries_and_exits(nodes, edges)
    ends = written(ends)
    useful = reaching(edges, ends, cutoff - 1)
    rank = F.row_number().over(Window.partitionBy("src").orderBy(F.desc("weight"), F.desc("dst")))
    ranked = written(edges.withColumn("rank", rank).join(useful.withColumnRenamed("node", "dst"), "dst", "left_semi"))
    first = starts.join(useful, "node", "left_semi").select(F.col("node").alias("last"), F.array("node").alias("path"), F.array("entry_ord").alias("ranks"), F.lit(0).cast("long").alias("weight"), F.lit(None).cast("long").alias("min_weight"))
    waiting: list[tuple[int, DataFrame, list[int]]] = [(1, written(first), [])]  # length, partial paths, ranks that all of them come after
    best: list = []
    while waiting:
        depth, level, after = waiting.pop()
        if depth >= cutoff or (len(best) == max_paths and best[-1]["ranks"] <= after):
            continue
        grown = level.withColumnRenamed("weight", "sum").join(ranked, F.col("last") == F.col("src")).where(~F.array_contains("path", F.col("dst")))
        grown = written(grown.select(F.col("dst").alias("last"), F.array_append("path", F.col("dst")).alias("path"), F.array_append("ranks", F.col("rank")).alias("ranks"), (F.col("sum") + F.col("weight")).alias("weight"), F.least("min_weight", F.col("weight")).alias("min_weight")))
        n = grown.count()
        if n and depth + 1 >= MIN_NODES:
            hits = grown.join(ends, grown["last"] == ends["node"], "left_semi").orderBy("ranks").limit(max_paths)
            best = sorted([*best, *hits.collect()], key=lambda r: r["ranks"])[:max_paths]
        if n > block:
            head = written(grown.orderBy("ranks").limit(block))
            bound = head.agg(F.max("ranks")).first()[0]
            rest = grown.where(F.col("ranks") > F.array(*[F.lit(x) for x in bound]))
            waiting += [(depth + 1, rest, bound), (depth + 1, head, after)]
        elif n:
            waiting.append((depth + 1, grown, after))
    rows = [(i, r["path"], r["weight"], r["min_weight"] or 0) for i, r in enumerate(best, 1)]
    return spark.createDataFrame(rows, "path_ord int, path array<string>, weight long, min_weight long")


def popular_paths(nodes: DataFrame, edges: DataFrame, total_sessions: int, threshold: float = 5.0, max_paths: int = MAX_PATHS, cutoff: int = CUTOFF) -> DataFrame:
    """Flows of the graph: paths grouped by pattern, session_count the largest of the paths' smallest weights."""
    paths = flow_paths(nodes, edges, max_paths, cutoff).withColumn("canonical_pattern", url_sequence(F.transform("path", node_url)))
    best = F.min_by("path", F.struct(-F.col("weight"), "path_ord"))
    groups = paths.groupBy("canonical_pattern").agg(F.max("min_weight").alias("session_count"), best.alias("path_nodes"), F.min("path_ord").alias("_ord"))
    score = F.col("session_count") / F.lit(float(total_sessions)) * 100
    kept = groups.where(F.lit(total_sessions > 0) & (score >= threshold))
    actions = F.filter(F.transform("path_nodes", node_action), lambda a: a.isNotNull())
    flows = kept.select("canonical_pattern", actions.alias("significant_actions"), F.bround(score, 2).alias("popularity_score"), "session_count", "path_nodes", "_ord")
    return flows.withColumn("ord", F.row_number().over(Window.orderBy(F.desc("popularity_score"), "_ord"))).drop("_ord")
