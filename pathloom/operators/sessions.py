"""Splitting sessions by concurrent tabs, idle gaps and excluded URLs.

Everything that runs along a large session's events does so hour by hour: windows see the events of one session and
hour, and what an hour hands on (its sums and its last time) is carried over by a table of hours. So a session with a
large part of all events, as a bot leaves, is no hot spot, and no two tabs or events are compared in pairs. The other
sessions, of at most LARGE events, are split with one shuffle.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pathloom.functions.url import is_excluded
from pathloom.schema import ORDER
from pathloom.session import written

IDLE = "30 minutes"
MIN_SEGMENT = 3
#: Sessions of more events are split hour by hour.
LARGE = 100_000
#: What identifies a sub-session, in the order of sub-sessions.
SUB_KEY = ["session_id", "is_concurrent", "group_tab", "sub_idx"]
_FIRST = Window.unboundedPreceding


def same_keys(left: str, right: str, keys: Sequence[str]) -> Column:
    """The keys of two aliased frames are equal; nulls equal nulls."""
    return reduce(Column.__and__, [F.col(f"{left}.{k}").eqNullSafe(F.col(f"{right}.{k}")) for k in keys])


def running_sums(rows: DataFrame, keys: Sequence[str], time: str, order: Sequence[str], values: dict[str, Column]) -> DataFrame:
    """Adds, for each name in ``values``, the sum of its column over the rows of the key up to and with this one.

    ``order`` begins with ``time``, a timestamp. A window sees one key's rows of an hour; only the sums of hours meet
    in the next one. Rows without a time stand first.
    """
    rows = rows.withColumn("_hour", F.date_trunc("hour", time))
    inside = Window.partitionBy(*keys, "_hour").orderBy(*order).rowsBetween(_FIRST, 0)
    hours = rows.groupBy(*keys, "_hour").agg(*[F.sum(v).alias(f"_sum_{n}") for n, v in values.items()])
    before = Window.partitionBy(*keys).orderBy("_hour").rowsBetween(_FIRST, -1)
    hours = hours.select(*keys, "_hour", *[F.coalesce(F.sum(f"_sum_{n}").over(before), F.lit(0)).alias(f"_sum_{n}") for n in values])
    own = rows.select("*", *[F.sum(v).over(inside).alias(f"_in_{n}") for n, v in values.items()]).alias("r")
    both = own.join(hours.alias("h"), same_keys("r", "h", [*keys, "_hour"]))
    return both.select(*[F.col(f"r.{c}") for c in rows.columns if c != "_hour" and c not in values], *[(F.col(f"_in_{n}") + F.col(f"_sum_{n}")).alias(n) for n in values])


def concurrent_tabs(events: DataFrame) -> DataFrame:
    """(session_id, tab_id, first_ts, last_ts, n_overlaps) of every tab; overlaps are strict on both ends.

    A sweep over the tabs' ends: the tabs that a tab meets are those that began before its end less those that ended
    by its start. Tabs without a time meet none.
    """
    return _met(events.groupBy("session_id", "tab_id").agg(F.min("timestamp").alias("first_ts"), F.max("timestamp").alias("last_ts")))


def _met(tabs: DataFrame) -> DataFrame:
    """n_overlaps of tabs (session_id, tab_id, first_ts, last_ts), each given once."""
    point = F.col("first_ts") == F.col("last_ts")
    # at equal times: ends ask, tabs begin, tabs end, starts ask. A tab of one moment asks before it ends, and doesn't count itself
    stops = [(F.col("last_ts"), F.lit(0)), (F.col("first_ts"), F.lit(1)), (F.col("last_ts"), F.when(point, 4).otherwise(2)), (F.col("first_ts"), F.when(point, 3).otherwise(5))]
    swept = tabs.select("session_id", "tab_id", point.alias("point"), F.explode(F.array(*[F.struct(t.alias("at"), k.alias("kind")) for t, k in stops])).alias("s")).select("session_id", "tab_id", "point", "s.at", "s.kind").where("at is not null")
    begun, ended = (F.col("kind") == 1).cast("long"), F.col("kind").isin(2, 4).cast("long")
    counted = running_sums(swept, ["session_id"], "at", ["at", "kind"], {"begun": begun, "ended": ended})
    met = counted.groupBy("session_id", "tab_id").agg(F.max(F.when(F.col("kind") == 0, F.col("begun") - (~F.col("point")).cast("long"))).alias("begun"), F.max(F.when(F.col("kind").isin(3, 5), F.col("ended"))).alias("ended"))
    both = tabs.alias("t").join(met.alias("m"), same_keys("t", "m", ["session_id", "tab_id"]), "left")
    return both.select("t.*", F.coalesce(F.col("begun") - F.col("ended"), F.lit(0)).cast("long").alias("n_overlaps"))


def split_tabs(events: DataFrame) -> DataFrame:
    """Adds is_concurrent and group_tab: tabs that overlap another stand alone, the rest is one main group."""
    tabs = concurrent_tabs(events).where("n_overlaps > 0").select("session_id", "tab_id", F.lit(True).alias("_c"))
    out = events.alias("e").join(tabs.alias("t"), same_keys("e", "t", ["session_id", "tab_id"]), "left")
    flag = F.coalesce(F.col("t._c"), F.lit(False))
    return out.select("e.*", flag.alias("is_concurrent"), F.when(flag, F.col("e.tab_id")).alias("group_tab"))


def split_idle(events: DataFrame, keys: list[str], gap: str = IDLE, order: list[str] = ORDER) -> DataFrame:
    """Adds sub_idx: a new sub-session begins when more than ``gap`` passes; unknown times never split.

    ``order`` begins with the timestamp. An hour hands on its last time and how many gaps it has; the first event of
    the next hour with events is held against that time.
    """
    rows = events.withColumn("_hour", F.date_trunc("hour", "timestamp"))
    wide = F.expr(f"interval {gap}")
    w = Window.partitionBy(*keys, "_hour").orderBy(*order)
    rows = rows.withColumn("_new", F.when(F.col("timestamp") - F.lag("timestamp").over(w) > wide, 1).otherwise(0))
    rows = rows.withColumn("_in", F.sum("_new").over(w.rowsBetween(_FIRST, 0)))
    hours = rows.groupBy(*keys, "_hour").agg(F.min("timestamp").alias("_a"), F.max("timestamp").alias("_b"), F.sum("_new").alias("_n"))
    by = Window.partitionBy(*keys).orderBy("_hour")
    hours = hours.withColumn("_begins", F.when(F.col("_a") - F.lag("_b").over(by) > wide, 1).otherwise(0))
    done = F.coalesce(F.sum("_n").over(by.rowsBetween(_FIRST, -1)), F.lit(0)) + F.sum("_begins").over(by.rowsBetween(_FIRST, 0))
    hours = hours.select(*keys, "_hour", done.alias("_done"))
    both = rows.alias("r").join(hours.alias("h"), same_keys("r", "h", [*keys, "_hour"]))
    return both.select(*[F.col(f"r.{c}") for c in events.columns], (F.col("_done") + F.col("_in")).alias("sub_idx"))


def split_sessions(events: DataFrame, gap: str = IDLE, large: int = LARGE) -> DataFrame:
    """Adds is_concurrent, group_tab and sub_idx, which with session_id identify a sub-session.

    The sessions are counted first. Those of more than ``large`` events go by hours; the table of their ids has at most
    one row for ``large`` events, and is broadcast.
    """
    sizes = events.groupBy("session_id").agg(F.count(F.lit(1)).alias("_n"))
    ids = written(sizes.where(F.col("_n") > large).select("session_id"))
    if ids.isEmpty():
        return _by_sessions(events, gap)
    e, few = events.alias("e"), F.broadcast(ids).alias("i")
    same = same_keys("e", "i", ["session_id"])
    return _by_sessions(e.join(few, same, "left_anti"), gap).unionByName(_by_hours(e.join(few, same, "left_semi"), gap))


def _by_sessions(events: DataFrame, gap: str) -> DataFrame:
    """``split_sessions`` with one shuffle: a session's events, which must not be many, meet in a task."""
    rows, tab = events.repartition("session_id"), Window.partitionBy("session_id", "tab_id")
    rows = rows.withColumns({"_a": F.min("timestamp").over(tab), "_b": F.max("timestamp").over(tab)})
    # tabs by their first and last times, each a run of rows: one overlaps an earlier one that ends after it begins, or
    # the next one if that begins before it ends; so ties and tabs of one moment come out right
    w = Window.partitionBy("session_id").orderBy("_a", "_b", "tab_id")
    earlier = ~F.lag("tab_id").over(w).eqNullSafe(F.col("tab_id")) & (F.max("_b").over(w.rowsBetween(_FIRST, -1)) > F.col("_a"))
    later = ~F.lead("tab_id").over(w).eqNullSafe(F.col("tab_id")) & (F.lead("_a").over(w) < F.col("_b"))
    rows = rows.withColumn("_met", F.coalesce(earlier | later, F.lit(False)))
    rows = rows.withColumn("is_concurrent", F.max("_met").over(Window.partitionBy("session_id", "_a", "_b", "tab_id"))).withColumn("group_tab", F.when(F.col("is_concurrent"), F.col("tab_id")))
    by = Window.partitionBy("session_id", "is_concurrent", "group_tab").orderBy("timestamp")
    rows = rows.withColumn("_new", F.when(F.col("timestamp") - F.lag("timestamp").over(by) > F.expr(f"interval {gap}"), 1).otherwise(0))
    return rows.withColumn("sub_idx", F.sum("_new").over(by.rowsBetween(_FIRST, 0))).select(*[F.col(f"`{c}`") for c in events.columns], "is_concurrent", "group_tab", "sub_idx")


def _by_hours(events: DataFrame, gap: str) -> DataFrame:
    """``split_sessions`` for sessions of any size."""
    if not _hours(gap):
        return split_idle(split_tabs(events), ["session_id", "is_concurrent", "group_tab"], gap)
    # no gap falls within an hour: all that is asked of an event is its session, tab and hour, and events are joined once
    rows = events.withColumn("_hour", F.date_trunc("hour", "timestamp"))
    cell, wide = ["session_id", "tab_id", "_hour"], F.expr(f"interval {gap}")
    cells = rows.groupBy(*cell).agg(F.min("timestamp").alias("_a"), F.max("timestamp").alias("_b"))
    tabs = _met(cells.groupBy("session_id", "tab_id").agg(F.min("_a").alias("first_ts"), F.max("_b").alias("last_ts"))).select("session_id", "tab_id", (F.col("n_overlaps") > 0).alias("is_concurrent"))
    cells = cells.alias("c").join(tabs.alias("t"), same_keys("c", "t", ["session_id", "tab_id"])).select("c.*", "is_concurrent", F.when(F.col("is_concurrent"), F.col("c.tab_id")).alias("group_tab"))
    group = ["session_id", "is_concurrent", "group_tab"]
    by = Window.partitionBy(*group).orderBy("_hour")
    hours = cells.groupBy(*group, "_hour").agg(F.min("_a").alias("_a"), F.max("_b").alias("_b"))
    begins = F.when(F.col("_a") - F.lag("_b").over(by) > wide, 1).otherwise(0)
    hours = hours.withColumn("_begins", begins).select(*group, "_hour", F.sum("_begins").over(by.rowsBetween(_FIRST, 0)).alias("sub_idx"))
    placed = cells.alias("c").join(hours.alias("h"), same_keys("c", "h", [*group, "_hour"])).select(*[f"c.{k}" for k in [*cell, "is_concurrent", "group_tab"]], "sub_idx")
    both = rows.alias("r").join(placed.alias("p"), same_keys("r", "p", cell))
    return both.select(*[F.col(f"r.{c}") for c in events.columns], "p.is_concurrent", "p.group_tab", "p.sub_idx")


def _hours(gap: str) -> bool:
    """Whether a gap is surely an hour or more."""
    return re.fullmatch(r"[1-9]\d* (hour|day|week)s?", gap.strip().lower()) is not None


def split_exclusions(events: DataFrame, patterns: list[str], keys: list[str], order: list[str] = ORDER, minimum: int = MIN_SEGMENT) -> DataFrame:
    """Adds segment: events are cut at excluded URLs, which go, as do segments of under ``minimum`` events.

    Without patterns all events are one segment of any size. ``order`` begins with the timestamp.
    """
    if not patterns:
        return events.withColumn("segment", F.lit(0).cast("long"))
    marked = events.withColumn("_x", is_excluded(F.col("url"), patterns))
    cut = running_sums(marked, keys, order[0], order, {"segment": F.col("_x").cast("long")}).where(~F.col("_x")).drop("_x")
    large = cut.groupBy(*keys, "segment").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= minimum)
    return cut.alias("c").join(large.alias("l"), same_keys("c", "l", [*keys, "segment"]), "left_semi")
