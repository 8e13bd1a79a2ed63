"""Sub-sessions of a stream of events with concurrent tabs: the batch split, emitted visit by visit.

A visit is a session's events up to a quiet time of more than ``expiry``. The state of a session holds, for each tab,
the spans of time in which the tab was busy (times at most a gap apart are one span), and the rows themselves, both in
list state on disk: a micro-batch appends its own spans with one call, whatever the number of tabs, and a timer joins them. Which tabs overlap and which sub-session a row belongs to follows from the spans alone, so that rows
never are sorted and memory grows with tabs and idle gaps only. What comes out depends on the log alone, not on how it
was cut into micro-batches.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterable, Iterator
from typing import Any

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import ArrayType, MapType, StructField, StructType, TimestampType

from pathloom.operators.sessions import IDLE

#: Rows that are handed to the state store at a time.
CHUNK = 1000
Span = tuple[int, int]
#: Whether a tab has a name, and its name.
Tab = tuple[bool, str]


def merged(spans: Iterable[Span], gap: int) -> list[Span]:
    """The spans in order, those at most ``gap`` apart joined."""
    out: list[Span] = []
    for a, b in sorted(spans):
        if out and a - out[-1][1] <= gap:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def overlapping(ends: dict[Any, Span]) -> set[Any]:
    """The tabs that overlap another one strictly, by the numbers of tabs begun and ended."""
    first, last = sorted(a for a, _ in ends.values()), sorted(b for _, b in ends.values())
    points = Counter(a for a, b in ends.values() if a == b)
    met = lambda a, b: bisect_left(first, b) - bisect_right(last, a) + (points[a] if a == b else -1)
    return {tab for tab, (a, b) in ends.items() if met(a, b) > 0}


class TabSplitter(StatefulProcessor):
    """Keeps a session's spans and rows; a timer behind the watermark closes visits."""

    def __init__(self, rows: StructType, gap: int, expiry: int) -> None:
        self.rows, self.gap, self.expiry = rows, gap, expiry
        self.names = rows.names
        self.shape = Row(*self.names, "_visit", "is_concurrent", "group_tab", "sub_idx")

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.spans = handle.getListState("spans", "known boolean, tab string, ends array<bigint>")
        self.lists = [handle.getListState(f"rows{i}", self.rows) for i in (0, 1)]
        self.side = handle.getValueState("side", "side int")

    def _active(self) -> int:
        found = self.side.get()
        return found[0] if found else 0

    def _load(self) -> tuple[dict[Tab, list[Span]], int]:
        """The spans of each tab, joined as they are read, and how many entries were read."""
        tabs: dict[Tab, list[Span]] = {}
        limit: dict[Tab, int] = {}
        n = 0
        for known, tab, flat in self.spans.get():
            n, key = n + 1, (known, tab)
            found = tabs.setdefault(key, [])
            found.extend(zip(flat[::2], flat[1::2], strict=True))
            if len(found) > limit.get(key, CHUNK):
                tabs[key] = merged(found, self.gap)
                limit[key] = max(2 * len(tabs[key]), CHUNK)
        return {k: merged(found, self.gap) for k, found in tabs.items()}, n

    @staticmethod
    def _entries(tabs: dict[Tab, Iterable[Span]]) -> list[tuple[bool, str, list[int]]]:
        return [(*k, [t for s in spans for t in s]) for k, spans in tabs.items() if spans]

    def _due(self, end: int) -> int:
        return (end + self.expiry) // 1000 + 1

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        held, times, earliest = [], {}, None
        kept = self.lists[self._active()]
        for row in rows:
            at = row["_at"]
            if at is None:  # a row without a time belongs to no visit
                yield self.shape(*[row[n] for n in self.names], None, False, None, 0)
                continue
            tab = (row["tab_id"] is not None, row["tab_id"] or "")
            times.setdefault(tab, set()).add((at, at))
            earliest = at if earliest is None else min(earliest, at)
            held.append(tuple(row[n] for n in self.names))
            if len(held) >= CHUNK:
                kept.appendList(held)
                times, held = {t: set(merged(s, self.gap)) for t, s in times.items()}, []
        if held:
            kept.appendList(held)
        if times:
            self.spans.appendList(self._entries({t: merged(s, self.gap) for t, s in times.items()}))
        if earliest is not None:
            due, pending = self._due(earliest), list(self.handle.listTimers())
            if not pending or due < min(pending):  # no visit can close before; a timer that is early sets the next one
                for timer in pending:
                    self.handle.deleteTimer(timer)
                self.handle.registerTimer(due)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        mark = timerValues.getCurrentWatermarkInMs()
        tabs, n = self._load()
        visits = merged((s for spans in tabs.values() for s in spans), self.expiry)
        closed = [v for v in visits if self._due(v[1]) <= mark]
        starts = [v[0] for v in closed]
        concurrent, begins = [], []
        for a, b in closed:
            inside = {t: found for t, spans in tabs.items() if (found := spans[bisect_left(spans, (a,)) : bisect_right(spans, (b, b))])}
            alone = overlapping({t: (s[0][0], s[-1][1]) for t, s in inside.items()})
            parts = {t: [s for s, _ in inside[t]] for t in alone}
            parts[None] = [s for s, _ in merged((s for t, spans in inside.items() if t not in alone for s in spans), self.gap)]
            concurrent.append(alone)
            begins.append(parts)
        side, waiting = self._active(), []
        end = closed[-1][1] if closed else None
        if closed:
            at_place, tab_place = self.names.index("_at"), self.names.index("tab_id")
            for values in self.lists[side].get():
                at, name = values[at_place], values[tab_place]
                if at > end:
                    waiting.append(tuple(values))
                    if len(waiting) >= CHUNK:
                        self.lists[1 - side].appendList(waiting)
                        waiting = []
                    continue
                v = bisect_right(starts, at) - 1
                tab = (name is not None, name or "")
                alone = tab in concurrent[v]
                part = bisect_right(begins[v][tab if alone else None], at) - 1
                yield self.shape(*values, starts[v], alone, name if alone else None, part)
            if waiting:
                self.lists[1 - side].appendList(waiting)
            self.lists[side].clear()
            self.side.update((1 - side,))
            tabs = {k: [s for s in spans if s[0] > end] for k, spans in tabs.items()}
        left = self._entries(tabs)
        if not left:
            self.spans.clear()
        elif len(left) < n or closed:
            self.spans.put(left)
        if len(closed) < len(visits):
            self.handle.registerTimer(self._due(visits[len(closed)][1]))

    def close(self) -> None:
        pass


def _micros(interval: str) -> int:
    unit = {"second": 1, "minute": 60, "hour": 3600, "day": 86400}
    number, name = interval.split()
    return int(number) * unit[name.rstrip("s")] * 1_000_000


def keep_state_on_disk(spark: SparkSession) -> None:
    """Sets the state store that ``split_stream`` needs for the session's next queries."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


_NESTED = (StructType, ArrayType, MapType)
_JSON = {"ignoreNullFields": "false", "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"}


def _pack(field: StructField) -> Column:
    """Nested values as JSON and timestamps as microseconds: Python's state takes no structs in structs, and shifts times."""
    column = F.col(f"`{field.name}`")
    if isinstance(field.dataType, _NESTED):
        return F.to_json(column, _JSON)
    return F.unix_micros(column) if isinstance(field.dataType, TimestampType) else column


def _unpack(field: StructField) -> Column:
    column = F.col(f"`{field.name}`")
    if isinstance(field.dataType, _NESTED):
        return F.from_json(column, field.dataType, _JSON)
    return F.timestamp_micros(column) if isinstance(field.dataType, TimestampType) else column


def split_stream(events: DataFrame, gap: str = IDLE, late: str = "10 minutes", expiry: str = "12 hours") -> DataFrame:
    """The events of closed visits with visit_start, is_concurrent, group_tab and sub_idx.

    The last three are those of the batch ``split_sessions`` over the visit's events. A visit is closed, and its rows
    come out once, when the watermark (``late`` behind the latest event) is past its last event by ``expiry``, which
    is at least ``gap``; rows behind the watermark are dropped by Spark. Rows without a time come out at once,
    without a visit and in sub-session 0. Needs the RocksDB state store (``keep_state_on_disk``). The names ``_at`` and ``_visit`` are taken.
    """
    if _micros(expiry) < _micros(gap):
        raise ValueError("expiry must be at least gap")
    marked = events.withWatermark("timestamp", late).withColumn("_at", F.unix_micros("timestamp"))
    packed = marked.select("timestamp", "_at", *[_pack(f).alias(f.name) for f in events.schema if f.name != "timestamp"])
    rows = StructType([f for f in packed.schema if f.name != "timestamp"])
    fields = StructType(list(rows.fields)).add("_visit", "long").add("is_concurrent", "boolean").add("group_tab", "string").add("sub_idx", "long")
    out = packed.groupBy("session_id").transformWithState(TabSplitter(rows, _micros(gap), _micros(expiry)), fields, "Append", "EventTime")
    columns = [F.timestamp_micros("_at").alias("timestamp") if f.name == "timestamp" else _unpack(f).alias(f.name) for f in events.schema]
    return out.select(*columns, F.timestamp_micros("_visit").alias("visit_start"), "is_concurrent", "group_tab", "sub_idx")
