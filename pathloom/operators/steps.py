"""Test steps of a flow: the one place where ordered state needs Python.

Everything that is a function of one event (locator, normalised URLs, link destination, assertions from
snapshots) is prepared by Column expressions; a pass over a flow's events only keeps track of pages.
"""

from __future__ import annotations

import json
import re
from collections import Counter
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pathloom.functions.element import locator
from pathloom.functions.url import bound, is_link_nav, link_destination, normalise_url, path
from pathloom.schema import NODE_SKIP, PEEK_SKIP, REDACTED, REPLACEMENT

STOPS = {"fill", "check", "select_option", "press_key"}
PLACE = "struct<url:string,norm:string,path:string>"


def prepared(events: DataFrame) -> DataFrame:
    """Adds step_event: what the step builder needs to know of an event."""
    to_url = F.coalesce(F.get_json_object("payload", "$.to_url"), F.lit(""))
    dest = link_destination()
    place = lambda u: F.struct(u.alias("url"), normalise_url(u).alias("norm"), path(u).alias("path"))
    item = F.struct(
        F.col("event_type").alias("type"), place(F.coalesce("url", F.lit(""))).alias("page"), place(to_url).alias("to"), F.when(F.col("target").isNotNull(), bound(dest, lambda u: F.when(u.isNotNull(), place(u)))).alias("dest"),
        locator("target").alias("locator"), F.coalesce(F.upper(F.col("target.tag")) == "A", F.lit(False)).alias("link"), is_link_nav().alias("leaves"),
        F.col("payload").alias("payload"), F.col("event_id").alias("event_id"),
    )
    return events.withColumn("step_event", item)


def gathered(events: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """(keys, events): the step events of each sub-session in order."""
    item = F.struct(F.struct(*order).alias("o"), F.col("step_event").alias("e"))
    return events.groupBy(*keys).agg(F.transform(F.sort_array(F.collect_list(item)), lambda x: x["e"]).alias("events"))


def literal(value: Any, max_len: int | None = 250) -> str:
    """The script literal of ``functions.text.string_literal`` for one value."""
    s = "" if value is None else value if isinstance(value, str) else str(value)
    out = json.dumps(s if max_len is None else s[:max_len], ensure_ascii=False)
    for raw in "<`\u2028\u2029":
        out = out.replace(raw, f"\\u{ord(raw):04x}")
    return out.replace("${", "\\u0024{")


def escaped(url: str) -> str:
    return re.sub(r"([.*+?^${}()|\[\]\\/])", r"\\\1", url)


def url_check(url: str) -> str:
    return f"await expect(page).toHaveURL(/{escaped(url)}/)"


class Builder:
    """Builds the steps of one flow.

    ``events`` are step_event dicts; ``snapshots`` has, for each URL, the assertion lists of its
    checkpoints in order; ``clicks`` has the state assertions of click events by event id; ``names``
    maps locators to variables.
    """

    def __init__(self, events: list[dict], snapshots: dict[str, list[list[str]]] | None = None, clicks: dict[str, list[str]] | None = None, names: dict[str, str] | None = None, actions: list[dict] | None = None):
        self.events, self.snapshots, self.clicks, self.names, self.actions = events, snapshots or {}, clicks or {}, names or {}, actions or []
        self.calls: Counter = Counter()
        # from the end: where the next navigation is, and the next event that counts
        n = len(events)
        self.next_nav: list[int | None] = [None] * (n + 1)
        self.next_place: list[dict | None] = [None] * (n + 1)
        for i in range(n - 1, -1, -1):
            e = events[i]
            if e["type"] == "navigation":
                self.next_nav[i], self.next_place[i] = i, e["to"]
            elif e["type"] in PEEK_SKIP:
                self.next_nav[i], self.next_place[i] = self.next_nav[i + 1], self.next_place[i + 1]
            else:
                self.next_place[i] = e["page"]

    # --- parts of steps

    def entry(self) -> dict:
        """Where the flow begins: the first navigation's target, else the first event's page."""
        for e in self.events:
            if e["type"] == "navigation" and e["to"]["url"]:
                return e["to"]
        if self.events:
            return self.events[0]["page"]
        url = next((a.get("url") or "/" for a in self.actions if a.get("type") == "navigation"), "/")
        return {"url": url, "norm": url, "path": url}

    def checks(self, url: str, arrived: bool) -> list[str]:
        """Assertions for being on a page; each call for a URL uses its next snapshot, the last one for good."""
        out = [url_check(url)] if arrived and url else []
        held = self.snapshots.get(url)
        if held:
            out = out + held[min(self.calls[url], len(held) - 1)]
            self.calls[url] += 1
        return out[:5]

    def action(self, e: dict) -> dict | None:
        """The step of an interaction, null for other events."""
        kind, at = e["type"], e["locator"] or ""
        p = json.loads(e["payload"]) if e.get("payload") else {}
        if kind == "click":
            return {"type": kind, "locator": at, "description": f"Click {at}", "_id": e.get("event_id")}
        if kind == "fill":
            value = p.get("value", "test value")
            value = REPLACEMENT if value == REDACTED else value
            return {"type": kind, "locator": at, "value": f"testVariables.{self.names[at]}" if self.names.get(at) else literal(value), "description": f"Fill {at}"}
        if kind == "check":
            on = p.get("checked", True)
            return {"type": kind, "locator": at, "checked": on, "description": f"{'Check' if on else 'Uncheck'} {at}"}
        if kind == "select_option":
            return {"type": kind, "locator": at, "value": literal(p.get("value") or p.get("label") or "option"), "description": f"Select option in {at}"}
        if kind == "press_key":
            key = p.get("key", "Enter")
            return {"type": kind, "locator": at or "page", "key": key, "description": f"Press {key} on {at or 'page'}"}
        return None

    def state_checks(self, e: dict) -> list[str]:
        """What a field must show after its event."""
        p = json.loads(e["payload"]) if e.get("payload") else {}
        at, kind = e["locator"], e["type"]
        if not at:
            return []
        if kind == "fill":
            value = p.get("value", "")
            shown = f"testVariables.{self.names[at]}" if self.names.get(at) else literal(REPLACEMENT if value == REDACTED else value)
            return [f"await expect(page.{at}).toHaveValue({shown})"] if value else []
        if kind == "check":
            return [f"await expect(page.{at}){'' if p.get('checked', True) else '.not'}.toBeChecked()"]
        if kind == "select_option":
            value = p.get("value") or p.get("label")
            return [f"await expect(page.{at}).toHaveValue({literal(value)})"] if value else []
        return []

    def wait(self, place: dict, full: bool) -> dict:
        checks = self.checks(place["url"], True) if full else [url_check(place["url"])] if place["url"] else []
        return {"type": "navigation", "url": place["url"], "description": f"Wait for navigation to {place['url']}", "assertions": checks}

    @staticmethod
    def corrected(place: dict, dest: dict | None) -> dict:
        """A link's own destination if what was recorded next is another page."""
        return dest if dest and place["url"] and dest["path"] != place["path"] else place

    # --- the modes

    def full(self) -> list[dict]:
        if not self.events:
            return self.from_actions()
        steps: list[dict] = []
        entry, acted, on, i = self.entry(), False, None, 0
        while i < len(self.events):
            e, i = self.events[i], i + 1
            if e["type"] in NODE_SKIP:
                continue
            if e["type"] == "navigation":
                # the entry itself, and navigations that no action caused, aren't steps
                if acted and (steps or e["to"]["norm"] != entry["norm"]):
                    steps.append(self.wait(e["to"], True))
                    on = e["to"]["norm"]
                continue
            acted = True
            step = self.action(e)
            if step is None:
                continue
            step["assertions"] = self.checks(e["page"]["url"], False) if e["page"]["norm"] != on else []
            on = e["page"]["norm"]
            step["assertions"] += self.state_checks(e)
            steps.append(step)
            if e["type"] != "click":
                continue
            nav, ahead, dest = self.next_nav[i], self.next_place[i], e["dest"]
            if nav is not None and e["link"]:
                goal = self.corrected(self.events[nav]["to"], dest)
                step["assertions"] = self.checks(goal["url"], True)
                steps.append(self.wait(goal, False))
                on, i = goal["norm"], nav + 1
                continue
            if ahead and ahead["url"] and ahead["norm"] != e["page"]["norm"] and e["link"]:
                goal = self.corrected(ahead, dest)
            elif dest and dest["norm"] != e["page"]["norm"]:
                goal = dest
            else:
                step["assertions"] += self.clicks.get(e.get("event_id"), [])
                continue
            step["assertions"], on = self.checks(goal["url"], True), goal["norm"]
        return one_url_check(self.collapse(drop_clicks_before_checks(steps)))

    def from_actions(self) -> list[dict]:
        """Steps of a flow that has its actions only."""
        out = []
        for a in self.actions:
            kind, at, url = a.get("type"), a.get("element") or "", a.get("url") or ""
            if kind == "navigation":
                step: dict | None = {"type": kind, "url": url, "description": f"Navigate to {url}"}
            else:
                step = self.action({"type": kind, "locator": at, "payload": None})
                extra = {"fill": {"value": "'test-value'"}, "select_option": {"value": "'option'"}, "press_key": {"description": f"Press key on {at or 'page'}"}}
                step = step and step | extra.get(kind, {})
            if step:
                out.append(step | {"assertions": self.checks(url, kind == "navigation")})
        return out

    def routes(self) -> list[dict]:
        """Navigation up to the first interaction."""
        steps: list[dict] = []
        entry, acted, i = self.entry(), False, 0
        while i < len(self.events):
            e, i = self.events[i], i + 1
            if e["type"] in STOPS:
                break
            if e["type"] == "navigation":
                if acted and (steps or e["to"]["norm"] != entry["norm"]):
                    steps.append(self.wait(e["to"], True))
            elif e["type"] == "click":
                after = self.events[i] if i < len(self.events) else None
                toggles = after and after["type"] == "check" and after["locator"] and after["locator"] == e["locator"]
                nav, ahead, dest = self.next_nav[i], self.next_place[i], e["dest"]
                if toggles or not (e["leaves"] or nav is not None):
                    break
                acted = True
                goal = self.events[nav]["to"] if nav is not None else ahead if ahead and ahead["url"] and ahead["norm"] != e["page"]["norm"] else dest
                step = self.action(e)
                step["assertions"] = self.checks(self.corrected(goal, dest)["url"], True) if goal and goal["url"] else []
                steps.append(step)
                i = i if nav is None else nav + 1
        return steps

    def interactions(self) -> list[dict]:
        """Interactions without the navigation that leads to them."""
        steps: list[dict] = []
        begun, on = False, None
        for i, e in enumerate(self.events):
            if e["type"] in NODE_SKIP or e["type"] == "navigation":
                continue
            if not begun and e["type"] == "click":
                ahead, dest, here = self.next_place[i + 1], e["dest"], e["page"]["norm"]
                away = e["link"] and (self.next_nav[i + 1] is not None or (ahead and ahead["url"] and ahead["norm"] != here))
                if away or (dest and dest["norm"] != here):
                    continue
            begun = True
            step = self.action(e)
            if step:
                step["assertions"] = self.checks(e["page"]["url"], False) if e["page"]["norm"] != on else []
                on = e["page"]["norm"]
                step["assertions"] += self.state_checks(e) + (self.clicks.get(e.get("event_id"), []) if e["type"] == "click" else [])
                steps.append(step)
        return self.collapse(drop_clicks_before_checks(steps))

    def collapse(self, steps: list[dict]) -> list[dict]:
        """Runs of three or more clicks on one locator as one step; its checks are the last click's that has any."""
        out: list[dict] = []
        i = 0
        while i < len(steps):
            j = i + 1
            while steps[i]["type"] == "click" and j < len(steps) and steps[j]["type"] == "click" and steps[j]["locator"] == steps[i]["locator"]:
                j += 1
            if j - i >= 3:
                found = next((c for s in reversed(steps[i:j]) if (c := self.clicks.get(s.get("_id")))), [])
                out.append(steps[i] | {"repeat_count": j - i, "description": f"Click {steps[i]['locator']} ({j - i} times)", "assertions": list(found)})
                i = j
            else:
                out.append(steps[i])
                i += 1
        return out


def drop_clicks_before_checks(steps: list[dict]) -> list[dict]:
    """A click goes if the step after it checks the same locator."""
    later = [*steps[1:], {"type": None}]
    return [s for s, n in zip(steps, later, strict=True) if not (s["type"] == "click" and n["type"] == "check" and n["locator"] == s["locator"])] if steps else []


def one_url_check(steps: list[dict]) -> list[dict]:
    """A wait after a click that has checked the URL keeps its own URL check only."""
    out: list[dict] = []
    for s in steps:
        before = out[-1] if out else {"type": None}
        if s["type"] == "navigation" and before["type"] == "click" and len(s["assertions"]) > 1 and any("toHaveURL" in a for a in before["assertions"]):
            s = s | {"assertions": [a for a in s["assertions"] if "toHaveURL" in a][:1]}
        out.append(s)
    return out


def with_screenshots(steps: list[dict]) -> list[dict]:
    """Interaction steps without checks get a screenshot check."""
    for i, s in enumerate(steps):
        if s["type"] in {"click", "fill", "select_option", "check"} and not s["assertions"]:
            hint = s["locator"].translate({ord(c): None for c in "\"'{}"} | {32: "-"})[:40]
            s["assertions"] = [f"await expect(page).toHaveScreenshot({literal(f'step-{i + 1}-{s["type"]}-{hint}.png')})"]
    return steps


#: What a click's locator says of the component it belongs to (fixed values, in order of precedence; None: of none).
COMPONENTS: list[tuple[str | None, tuple[str, ...]]] = [
    ("counter", ('"+"', '"−"')), ("progress bar", ("+ 10%", "- 10%")), (None, ('"Reset"',)), ("modal", ('"Open Modal"', '"×"', '"Got it!"')),
    ("tabs", ('"Overview"', '"Details"', '"Reviews"')), ("accordion", ("▼", "TestSite?", "open source?")),
]


def component(step: dict) -> str | None:
    where = step.get("locator") or step.get("description") or ""
    if step["type"] == "check":
        return "toggle" if "toggle" in where.lower() else "checkbox"
    if step["type"] == "select_option":
        return "select"
    return next((name for name, marks in COMPONENTS if any(m in where for m in marks)), None) if step["type"] == "click" else None


def behavior_name(steps: list[dict], index: int) -> str:
    """Name of a group of steps: form fill, or the components that come up, or a number."""
    if any(s["type"] == "fill" for s in steps):
        return "form fill"
    found = list(dict.fromkeys(c for s in steps if (c := component(s))))
    more = f" (+{len(found) - 3} more)" if len(found) > 3 else ""
    return ", ".join(found[:3]) + more if found else f"behavior {index + 1}"


def unique_names(behaviors: list[dict]) -> None:
    """Names that occur twice get the first element that no namesake has, else their number of steps."""
    names = [b["test_name"] for b in behaviors]
    elements = [re.findall(r'name: "([^"]*)"', " ".join(s.get("locator", "") + "\n" for s in b["steps"])) for b in behaviors]
    for i, b in enumerate(behaviors):
        if names.count(names[i]) > 1:
            taken = {e for j, other in enumerate(elements) if j != i and behaviors[j]["test_name"] == names[i] for e in other}
            b["test_name"] = f"{names[i]} — {next((e for e in elements[i] if e not in taken), None) or f'{len(b["steps"])} steps'}"


STEP = "step_no int, type string, locator string, url string, value string, repeat_count int, description string, assertions array<string>"


#: Events of a batch's flows that are Python objects at a time, but for a single flow with more.
EVENTS = 5000


def slices(batch: pa.RecordBatch, column: int, events: int = EVENTS) -> Iterator[pa.RecordBatch]:
    """The batch in parts of as many rows as have ``events`` events in all, or one row, in order; no part without rows."""
    sizes = [n or 0 for n in pc.list_value_length(batch.column(column)).to_pylist()]
    start = held = 0
    for i, n in enumerate(sizes):
        if i > start and held + n > events:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += n + 1
    if start < batch.num_rows:
        yield batch.slice(start)


def _rows(flows: DataFrame, keep: list[str], schema: str, make: Callable[[dict], list[dict]]) -> DataFrame:
    """The rows that ``make`` gives of each flow (a dictionary with events), in Arrow batches, with the ``keep`` columns."""
    rows = flows.select(*keep, *[c for c in ("events", "snapshots", "clicks", "names") if c in flows.columns and c not in keep])
    fields = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*keep).schema), schema])
    names = flows.sparkSession.createDataFrame([], schema).columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (part for batch in batches for part in slices(batch, batch.schema.get_field_index("events"))):
            made, at = [], []
            for i, flow in enumerate(b.select(list(range(len(keep), b.num_columns))).to_pylist()):
                own = make({k: dict(v) if k != "events" and v is not None else v for k, v in flow.items()})
                made += own
                at += [i] * len(own)
            if made:
                kept = b.select(list(range(len(keep)))).take(pa.array(at, pa.int64()))
                kinds = {"int": pa.int32(), "boolean": pa.bool_(), "array<string>": pa.list_(pa.string()), "string": pa.string()}
                columns = [pa.array([r.get(n) for r in made], kinds[k.split(" ")[1]]) for n, k in zip(names, schema.split(", "), strict=True)]
                yield pa.RecordBatch.from_arrays([*kept.columns, *columns], names=[*keep, *names])

    return rows.mapInArrow(run, fields)


def steps_of(flows: DataFrame, keep: list[str], mode: str = "full") -> DataFrame:
    """(keep, step_no, type, locator, url, value, repeat_count, description, assertions): a row per step of each flow.

    Rows have events (step events in order) and may have snapshots, clicks and names. A flow without events has no steps.
    """

    def make(flow: dict) -> list[dict]:
        b = Builder(flow["events"] or [], flow.get("snapshots"), flow.get("clicks"), flow.get("names"))
        steps = {"nav_only": b.routes, "interaction_only": b.interactions}.get(mode, b.full)()
        return [{"repeat_count": 1} | s | {"step_no": i} for i, s in enumerate(steps, 1)]

    return _rows(flows, keep, STEP, make)


def plain_steps(flows: DataFrame, keep: list[str]) -> DataFrame:
    """The same for every event that is an interaction, in order; clicks before checks of the same locator go."""

    def make(flow: dict) -> list[dict]:
        b = Builder(flow["events"] or [])
        steps = drop_clicks_before_checks([s for e in b.events if (s := b.action(e))])
        return [s | {"step_no": i, "assertions": []} for i, s in enumerate(steps, 1)]

    return _rows(flows, keep, STEP, make)


def look_ahead(events: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """(event_id, next_url, to_navigation) of prepared events: where the next event that counts is, and whether it is a navigation.

    A navigation is where it leads to, others are where they happen; events that a look ahead passes over don't count.
    One running window per sub-session, from its end: its last value that isn't null is the next one.
    """
    e = F.col("step_event")
    goes = F.coalesce(e["type"] == "navigation", F.lit(False))
    place = F.when(goes | ~F.coalesce(e["type"], F.lit("")).isin(PEEK_SKIP), F.struct(F.when(goes, e["to"]["url"]).otherwise(e["page"]["url"]).alias("url"), goes.alias("goes")))
    back = Window.partitionBy(*keys).orderBy(*[F.desc_nulls_last(c) for c in order]).rowsBetween(Window.unboundedPreceding, -1)
    ahead = F.last(place, ignorenulls=True).over(back)
    return events.select("event_id", ahead.alias("_a")).select("event_id", F.col("_a.url").alias("next_url"), F.coalesce("_a.goes", F.lit(False)).alias("to_navigation"))
