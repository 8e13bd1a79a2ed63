"""Four strategies for flows that repeat each other's interactions.

A flow set has flow_ord (its order), canonical_pattern, popularity_score and events (array of structs
with event_type, url and element, and link: whether a click is a link to another page).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pathloom.functions.url import path, present
from pathloom.operators.flows import action_text
from pathloom.operators.numbering import numbered
from pathloom.schema import FINGERPRINT_SKIP

STRATEGIES = ("full", "smart", "lean", "modular")


def interactions(events: str | Column) -> Column:
    """The events that are interactions: not skipped, no link click, and no click that a navigation follows."""
    events = F.col(events) if isinstance(events, str) else events
    types = F.transform(events, lambda e: e["event_type"])
    # from the end: what the next significant event of each place is
    ahead = F.reverse(F.aggregate(F.reverse(types), F.struct(F.lit(None).cast("string").alias("next"), F.array().cast("array<string>").alias("out")), lambda a, t: F.struct(F.when((t == "navigation") | ~t.isin(FINGERPRINT_SKIP), t).otherwise(a["next"]).alias("next"), F.array_append(a["out"], a["next"]).alias("out")), lambda a: a["out"]))
    marked = F.zip_with(events, ahead, lambda e, n: F.struct(e.alias("e"), n.alias("n")))
    real = F.filter(marked, lambda x: ~F.coalesce(x["e"]["event_type"], F.lit("")).isin(FINGERPRINT_SKIP) & ~((x["e"]["event_type"] == "click") & (F.coalesce(x["e"]["link"], F.lit(False)) | F.coalesce(x["n"] == "navigation", F.lit(False)))))
    return F.transform(real, lambda x: x["e"])


def with_facts(flows: DataFrame) -> DataFrame:
    """Adds action_fingerprint, has_interactions, interaction_page_url, single_page and nav_prefix."""
    f = flows.withColumn("_i", interactions("events"))
    text = action_text(F.col("_i"))
    urls = F.array_distinct(F.transform(F.filter("_i", lambda e: present(e["url"]).isNotNull()), lambda e: path(e["url"])))
    first = F.get(F.col("_i"), F.lit(0))["url"]
    entry = F.get(F.col("events"), F.lit(0))["url"]
    return f.select(
        *flows.columns,
        F.when(F.size("_i") == 0, F.md5(F.concat(F.lit("nav-only:"), F.coalesce("canonical_pattern", F.lit(""))))).otherwise(F.md5(text)).alias("action_fingerprint"),
        (F.size("_i") > 0).alias("has_interactions"), first.alias("_page"), (F.size(urls) <= 1).alias("single_page"),
        F.coalesce(path(present(entry)) != path(present(first)), F.lit(False)).alias("nav_prefix"),
    )


def _ranked(flows: DataFrame, key: str, name: str) -> DataFrame:
    """Adds {name}_rank, {name}_size and {name}_ord (the group's first flow) for groups by ``key``."""
    by = Window.partitionBy(key)
    return flows.withColumns({f"{name}_rank": F.row_number().over(by.orderBy(F.desc("popularity_score"), "flow_ord")), f"{name}_size": F.count(F.lit(1)).over(by), f"{name}_ord": F.min("flow_ord").over(by)})


_OUT = ["test_mode", "interaction_page_url", "behaviors"]


def _finish(rows: DataFrame, columns: list[str], *order: str) -> DataFrame:
    return numbered(rows, "out_ord", *order).select("out_ord", *columns, "action_fingerprint", *_OUT)


def apply_strategy(flows: DataFrame, strategy: str = "smart") -> DataFrame:
    """out_ord, the flow's columns, action_fingerprint, test_mode, interaction_page_url, behaviors (flow_ords).

    full: every flow is tested in full. smart: of flows with the same interactions the most popular is
    kept and the others are nav_only; kept flows of one pattern become one smart_grouped row. lean: only
    the kept ones. modular: interactions apart from routes. Other names mean smart.
    """
    strategy = strategy if strategy in STRATEGIES else "smart"
    names = flows.columns
    f = _ranked(with_facts(flows), "action_fingerprint", "fp")
    f = f.withColumns({"interaction_page_url": F.lit(None).cast("string"), "behaviors": F.lit(None).cast("array<bigint>")})
    if strategy == "full":
        return _finish(f.withColumn("test_mode", F.lit("full")), names, "flow_ord")
    if strategy == "lean":
        return _finish(f.where("fp_rank = 1").withColumn("test_mode", F.lit("full")), names, "fp_ord")
    if strategy == "smart":
        # kept flows stand in the order of their fingerprints; groups of patterns in the order of their first
        kept = f.where("fp_rank = 1")
        by = Window.partitionBy("canonical_pattern")
        kept = kept.withColumns({"p_rank": F.row_number().over(by.orderBy(F.desc("popularity_score"), "fp_ord")), "p_size": F.count(F.lit(1)).over(by), "o1": F.min("fp_ord").over(by)})
        members = F.transform(F.sort_array(F.collect_list(F.struct("p_rank", "flow_ord")).over(by)), lambda x: x["flow_ord"].cast("long"))
        kept = kept.withColumn("behaviors", F.when(F.col("p_size") > 1, members)).where("p_rank = 1").withColumn("test_mode", F.when(F.col("p_size") > 1, "smart_grouped").otherwise("full"))
        kept = kept.withColumns({"part": F.lit(0), "o2": F.lit(0).cast("long")}).drop("p_rank", "p_size")
        rest = f.where("fp_rank > 1").withColumns({"test_mode": F.lit("nav_only"), "part": F.lit(1), "o1": F.col("fp_ord"), "o2": F.col("fp_rank").cast("long")})
        return _finish(kept.unionByName(rest.select(kept.columns)), names, "part", "o1", "o2")
    together = F.col("has_interactions") & (F.col("fp_size") > 1)
    alone = ~together & F.col("has_interactions") & F.col("single_page")
    head = f.withColumns({"_t": F.first(together & F.col("single_page")).over(Window.partitionBy("action_fingerprint").orderBy("fp_rank")), "_i": F.first(together).over(Window.partitionBy("action_fingerprint").orderBy("fp_rank"))})
    kept = f.where("fp_rank = 1").withColumn("_mode", F.when((together & F.col("single_page")) | alone, "interaction_only"))
    by = Window.partitionBy("canonical_pattern")
    kept = kept.withColumns({"p_rank": F.row_number().over(by.orderBy(F.desc("popularity_score"), "fp_ord")), "p_size": F.count(F.lit(1)).over(by), "o1": F.min("fp_ord").over(by)})
    mode = F.when(F.col("p_size") == 1, F.coalesce("_mode", F.lit("full"))).when(F.col("single_page"), "interaction_only").otherwise("full")
    page = F.when((F.col("p_size") > 1) & F.col("single_page"), F.col("_page")).when(F.col("_mode").isNotNull(), F.col("_page"))
    kept = kept.withColumns({"test_mode": mode, "interaction_page_url": page, "part": F.lit(0), "o2": F.col("p_rank").cast("long")}).drop("_mode", "p_rank", "p_size")
    routes = head.where(F.col("_t") | (F.col("_i") & (F.col("fp_rank") > 1)) | (alone & F.col("nav_prefix") & (F.col("fp_size") == 1))).drop("_t", "_i")
    routes = routes.withColumn("_u", F.row_number().over(by.orderBy("fp_ord", "fp_rank"))).where("_u = 1").drop("_u")
    routes = routes.withColumns({"test_mode": F.lit("nav_only"), "part": F.lit(1), "o1": F.col("fp_ord"), "o2": F.col("fp_rank").cast("long")})
    return _finish(kept.unionByName(routes.select(kept.columns)), names, "part", "o1", "o2")
