"""Comparing newly mined flows with a stored library."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathloom.operators.numbering import numbered


def last_by_pattern(flows: DataFrame, order: str) -> DataFrame:
    """The last flow of each pattern as ``_flow``, and the place of the first as ``_place``; combined before the shuffle, so no pattern is hot."""
    return flows.groupBy("canonical_pattern").agg(F.max_by(F.struct(*[F.col(f"`{c}`") for c in flows.columns]), F.col(order)).alias("_flow"), F.min(order).alias("_place"))


def compared(new: DataFrame, library: DataFrame, order: str = "ord") -> DataFrame:
    """canonical_pattern, status, new_flow, existing_flow, new_place, existing_place of all patterns of both sides.

    status is as in ``compare_flows``, null for flows of the library that no longer occur and aren't active.
    """
    actions = lambda f: F.coalesce(F.transform(f["significant_actions"], lambda a: F.struct(a["type"].alias("type"), a["url"].alias("url"), a["element"].alias("element"))), F.array().cast("array<struct<type:string,url:string,element:string>>"))
    side = lambda f, name: last_by_pattern(f, order).select("canonical_pattern", F.col("_flow").alias(f"{name}_flow"), F.col("_place").alias(f"{name}_place"))
    both = side(new, "new").join(side(library, "existing"), "canonical_pattern", "full_outer")
    status = (
        F.when(F.col("existing_flow").isNull(), "new").when(F.col("new_flow").isNull(), F.when(F.col("existing_flow.status") == "active", "inactive"))
        .when(actions(F.col("new_flow")).eqNullSafe(actions(F.col("existing_flow"))), "unchanged").otherwise("changed")
    )
    return both.select("canonical_pattern", status.alias("status"), "new_flow", "existing_flow", "new_place", "existing_place")


def compare_flows(new: DataFrame, library: DataFrame, order: str = "ord") -> DataFrame:
    """canonical_pattern, status, new_flow, existing_flow, result_ord.

    status: new, changed (an action's type, URL or element differs), unchanged, or inactive (an active
    library flow that no longer occurs; others that no longer occur give no row).
    """
    found = compared(new, library, order).where("status is not null")
    return numbered(found, "result_ord", F.col("new_place").asc_nulls_last(), "existing_place").drop("new_place", "existing_place")
