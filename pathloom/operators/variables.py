"""Test variables: dynamic values of flows, first definition first."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathloom.functions.element import locator
from pathloom.functions.text import element_variable, url_example, url_variable
from pathloom.schema import REDACTED, REPLACEMENT
from pathloom.session import written


def from_events(events: DataFrame, *order: str) -> DataFrame:
    """(name, description, example, place) of fill events whose locator names a variable."""
    rows = events.where("event_type = 'fill' and target is not null").withColumn("_l", locator("target")).withColumn("name", element_variable(F.col("_l")))
    value = F.coalesce(F.get_json_object("payload", "$.value"), F.lit(""))
    return rows.where("name is not null").select("name", F.concat(F.lit("Form value for "), "_l").alias("description"), F.when(value == REDACTED, REPLACEMENT).otherwise(value).alias("example"), F.struct(*order).alias("place"))


def from_actions(actions: DataFrame, *order: str) -> DataFrame:
    """The same from (url, type, element) actions: URL parameters, then filled fields."""
    url, element = F.coalesce("url", F.lit("")), F.col("element")
    dynamic = url.contains(":uuid") | url.contains(":id") | url.contains(":slug")
    params = actions.where(dynamic).select(url_variable(url).alias("name"), F.concat(F.lit("Dynamic URL parameter from "), url).alias("description"), url_example(url).alias("example"), F.struct(*order, F.lit(0).alias("part")).alias("place"))
    fills = actions.where("type = 'fill' and element is not null and element <> ''").select(element_variable(element).alias("name"), F.concat(F.lit("Form value for "), element).alias("description"), F.lit("").alias("example"), F.struct(*order, F.lit(1).alias("part")).alias("place"))
    return params.unionByName(fills).where("name is not null")


def first_definitions(variables: DataFrame) -> DataFrame:
    """One row per name: its first definition."""
    best = variables.groupBy("name").agg(F.min_by(F.struct("description", "example"), "place").alias("d"), F.min("place").alias("place"))
    return best.select("name", "d.description", "d.example", "place")


def variable_map(events: DataFrame, *order: str) -> DataFrame:
    """(locator, name) of all filled targets."""
    # a name follows from its locator, so that it is made once for each; ``order`` decides nothing
    # written, or the filter on names would be pushed below, with the locator put in wherever a name is made of it
    found = written(events.where("event_type = 'fill' and target is not null").select(locator("target").alias("locator")).distinct())
    return found.select("locator", element_variable(F.col("locator")).alias("name")).where("name is not null")
