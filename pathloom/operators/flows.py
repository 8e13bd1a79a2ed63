"""Popular flows from sub-sessions: patterns above a threshold, split by interaction, and rescued near misses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pathloom.functions.element import fingerprint
from pathloom.functions.url import is_link_nav, joined, normalise_url
from pathloom.operators.graph import MIN_NODES, event_node, node_action, node_url
from pathloom.operators.numbering import numbered
from pathloom.operators.sessions import SUB_KEY
from pathloom.schema import FINGERPRINT_SKIP, ORDER

MOBILE_WIDTH = 768
THRESHOLD = 5.0


def viewport_width() -> Column:
    """An event's viewport width, null where it is missing or no number."""
    return F.get_json_object("page_context", "$.viewport.width").try_cast("double")


def viewport_class(width: Column | None = None) -> Column:
    """Aggregate: mobile if most events with a viewport width are narrow, else desktop."""
    width = viewport_width() if width is None else width
    return F.when(F.count_if(width < MOBILE_WIDTH) > F.count(width) / 2, "mobile").otherwise("desktop")


def is_action() -> Column:
    """Whether an event counts for a session's fingerprint: not skipped and no click on a link to another page."""
    return ~F.coalesce(F.col("event_type"), F.lit("")).isin(FINGERPRINT_SKIP) & ~((F.col("event_type") == "click") & is_link_nav())


def action_text(actions: Column) -> Column:
    """A text for a list of actions, quoted, so that no two lists have one text."""
    return F.to_json(F.transform(actions, lambda a: F.struct(F.coalesce(a["event_type"], F.lit("")).alias("t"), F.coalesce(a["element"], F.lit("")).alias("e"))))


def sub_sessions(events: DataFrame, keys: list[str] = SUB_KEY, order: list[str] = ORDER) -> DataFrame:
    """One row per sub-session: keys, nodes, pattern, fingerprint, page_set, n_actions, n_nodes, events (with link: a click on a link to another page).

    Sub-sessions with under 3 nodes are left out. A sub-session's events are gathered in its row, as an
    idle gap bounds them. Nodes, actions and events are gathered each for itself: what a query doesn't ask for is
    neither computed nor gathered. A node's page is normalised once.
    """
    link = F.coalesce(F.col("event_type") == "click", F.lit(False)) & F.coalesce(is_link_nav(), F.lit(False))
    rows = events.withColumns({"node": event_node(), "_link": link, "_action": is_action(), "_element": F.coalesce(fingerprint("target"), F.lit("")), "_width": viewport_width()})
    rows = rows.withColumn("_page", normalise_url(node_url(F.col("node"))))
    place = F.struct(*order).alias("o")
    element = F.col("_element").alias("element")
    # collect_list leaves nulls out
    nodes = F.collect_list(F.when(F.col("node").isNotNull(), F.struct(place, "node", F.col("_page").alias("page"))))
    acts = F.collect_list(F.when(F.col("_action"), F.struct(place, "event_type", element)))
    each = F.collect_list(F.struct(place, "event_type", "url", element, F.col("_action").alias("is_action"), F.col("_link").alias("link")))
    per = rows.groupBy(*keys).agg(nodes.alias("_nodes"), acts.alias("_acts"), each.alias("_each"), viewport_class(F.col("_width")).alias("viewport"))
    # sorted after the filter: a filter on the size of a sorted list would sort it once more
    per = per.where(F.size("_nodes") >= MIN_NODES).withColumns({c: F.sort_array(c) for c in ["_nodes", "_acts", "_each"]})
    pages = F.transform("_nodes", lambda x: x["page"])
    plain = joined(pages)
    return per.select(
        *keys, F.transform("_nodes", lambda x: x["node"]).alias("nodes"),
        F.when(F.col("viewport") != "desktop", F.concat(F.lit("["), F.col("viewport"), F.lit("] "), plain)).otherwise(plain).alias("pattern"),
        F.when(F.size("_acts") == 0, "").otherwise(F.md5(action_text(F.col("_acts")))).alias("fingerprint"),
        F.array_join(F.array_sort(F.array_distinct(pages)), " + ").alias("page_set"),
        F.size(F.filter("_nodes", lambda x: ~x["node"].startswith("nav:"))).cast("long").alias("n_actions"), F.size("_nodes").cast("long").alias("n_nodes"),
        F.transform("_each", lambda x: F.struct(x["event_type"].alias("event_type"), x["url"].alias("url"), x["element"].alias("element"), x["is_action"].alias("is_action"), x["link"].alias("link"))).alias("events"),
    )


def popular_flows(subs: DataFrame, total_sessions: int, threshold: float = THRESHOLD, keys: list[str] = SUB_KEY) -> DataFrame:
    """Flows: ord, canonical_pattern, fingerprint, session_count, popularity_score, path_nodes, significant_actions, events, rescued.

    Patterns are counted before they are split by fingerprint, and both are joined back as small
    tables, so that a pattern that very many sub-sessions share meets in no single task. Below the
    threshold, sub-sessions with the same set of pages and the same interactions are rescued if no
    popular flow has these interactions; a fingerprint is rescued once, for its first page set.
    """
    # read by several aggregations; a lost executor's part is computed again
    subs = (subs if total_sessions > 0 else subs.limit(0)).persist()
    at = F.struct(*keys)
    share = lambda n: n / F.lit(float(max(total_sessions, 1))) * 100
    patterns = subs.groupBy("pattern").agg(F.count(F.lit(1)).alias("_n"), F.min(at).alias("pattern_ord"))
    rows = subs.join(patterns, "pattern").withColumn("_high", share(F.col("_n")) >= threshold)
    best = lambda *first: F.min_by(F.struct("nodes", "events", "pattern"), F.struct(-F.col("n_actions"), -F.col("n_nodes"), *first))
    popular = rows.where("_high").groupBy("pattern", "fingerprint").agg(F.count(F.lit(1)).alias("session_count"), best(at).alias("r"), F.min(F.struct("pattern_ord", at.alias("a"))).alias("o")).where(share(F.col("session_count")) >= threshold)
    place = F.struct("pattern_ord", at.alias("a"))
    low = rows.where(~F.col("_high"))
    sets = low.groupBy("page_set").agg(F.count(F.lit(1)).alias("_in_set"), F.min(place).alias("set_ord")).where("_in_set >= 2")
    grouped = low.where("fingerprint <> ''").groupBy("page_set", "fingerprint").agg(F.count(F.lit(1)).alias("session_count"), best("pattern_ord", at.alias("a")).alias("r"), F.min(place).alias("o")).where("session_count >= 2")
    fresh = grouped.join(sets, "page_set").join(popular.select("fingerprint").distinct(), "fingerprint", "left_anti")
    first = fresh.groupBy("fingerprint").agg(F.min("set_ord").alias("set_ord"))
    rescued = fresh.join(first, ["fingerprint", "set_ord"]).crossJoin(F.broadcast(popular.limit(1).select(F.lit(1).alias("_any"))))
    one = popular.select(F.col("pattern"), "fingerprint", "session_count", "r", F.lit(False).alias("rescued"), F.col("o.pattern_ord").alias("o1"), F.col("o").alias("o2"))
    two = rescued.select(F.col("r.pattern").alias("pattern"), "fingerprint", "session_count", "r", F.lit(True).alias("rescued"), F.col("set_ord").alias("so"), F.col("o").alias("o2"))
    one = one.select("pattern", "fingerprint", "session_count", "r", "rescued", F.struct(F.col("o1").alias("pattern_ord"), F.col("o1").alias("a")).alias("so"), "o2")
    flows = one.unionByName(two).withColumn("popularity_score", F.bround(share(F.col("session_count")), 2))
    ranked = numbered(flows, "ord", F.desc("popularity_score"), "rescued", "so", "o2")
    actions = F.filter(F.transform(F.col("r.nodes"), node_action), lambda a: a.isNotNull())
    return ranked.select("ord", F.col("pattern").alias("canonical_pattern"), "fingerprint", "session_count", "popularity_score", F.col("r.nodes").alias("path_nodes"), actions.alias("significant_actions"), F.col("r.events").alias("events"), "rescued")
