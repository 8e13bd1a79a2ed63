"""Numbering all rows of a frame in an order, without a task that sees them all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pathloom.session import written


def numbered(rows: DataFrame, name: str, *order: Column | str, kind: str = "int") -> DataFrame:
    """Adds ``name``: 1, 2, ... over all rows in the given order, as int or long; rows that tie are numbered in any order.

    The rows are range-sorted and checkpointed, so that the partitions stay as they are; a row's number
    is its place in its partition and the sizes of those before. Only these sizes, one for each
    partition, meet in a task and are broadcast. An empty frame gives no rows.
    """
    done = written(rows.orderBy(*order))
    placed = done.withColumns({"_part": F.spark_partition_id(), "_in": F.monotonically_increasing_id().bitwiseAND(F.lit(2**33 - 1))})
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = done.select(F.spark_partition_id().alias("_part")).groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    starts = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    return placed.join(F.broadcast(starts), "_part").select(*done.columns, (F.col("_start") + F.col("_in") + 1).cast(kind).alias(name))
