"""Validation of events against the closed set of 32 event types, and their wire shape.

A field is ``name[*]:kind``: * is required; kinds are s(tring), n(umber), n0 (not negative), n1 (positive), i(nteger),
i0 (not negative), b(oolean), p(oint), ls, ln0 and lm (lists of strings, of numbers and of modifier keys), o(bject), os (object of
strings), any, or values separated by |. ``!`` after a type requires a target. Payloads are parsed once, to a variant, whose
types decide: a number is no string, and a list is right in each of its members. Numbers may be given as strings, as the
wire allows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The event types with their payload fields; ``free`` payloads may hold anything.
TYPES = """
click! modifiers:lm force:b button:left|right position:p
dblclick! modifiers:lm position:p
right_click! modifiers:lm position:p
hover! position:p
drag_drop! target_selectors*:o source_position:p target_position:p
scroll x*:n y*:n delta_x:n delta_y:n direction*:up|down|left|right
fill! value*:s
clear! previous_value:s
press_key key*:s repeat:i0
type_sequentially! value*:s delay:n0
select_option! value:s label:s index:i0
check! checked*:b
focus! free
clipboard action*:copy|cut|paste text:s
navigation to_url*:s from_url:s trigger*:link_click|form_submit|js_redirect|history_push|history_pop
page_load load_state*:domcontentloaded|networkidle|load
reload free
tab_open url*:s opener_tab_id*:s
tab_close free
history_change url*:s type*:pushState|replaceState|popstate
file_upload! filenames*:ls mimes*:ls sizes:ln0
download filename*:s url:s mime:s
media_play! element_type*:video|audio src*:s current_time:n0
media_pause! element_type*:video|audio current_time*:n0
dialog dialog_type*:alert|confirm|prompt|beforeunload message*:s response:OK|Cancel input_value:s
permission_prompt permission*:geolocation|notifications|camera|microphone response*:grant|deny
api_request method*:GET|POST|PUT|PATCH|DELETE|HEAD|OPTIONS url*:s request_headers:os request_body:any status:i response_body:any duration_ms:n0
api_error method*:GET|POST|PUT|PATCH|DELETE|HEAD|OPTIONS url*:s status*:i error_message:s response_body:any
websocket_message url*:s direction*:sent|received data*:s
tap! position*:p
swipe direction*:left|right|up|down start*:p end*:p
pinch_zoom scale*:n1 center*:p
"""
MODIFIERS = ["Shift", "Ctrl", "Alt", "Meta"]
UUID = r"(?i)^[0-9a-f]{8}-?[0-9a-f]{4}-?[0-9a-f]{4}-?[0-9a-f]{4}-?[0-9a-f]{12}$"
ENVELOPE = ["event_id", "session_id", "tab_id", "sequence", "timestamp", "event_type", "target", "payload"]


def wire_shape(events: DataFrame) -> DataFrame:
    """Storage rows in wire shape: the envelope, page (url, title, viewport; a url in page_context wins), schema_version 1 if absent."""
    context = lambda p: F.get_json_object("page_context", p)
    viewport = F.when(context("$.viewport").isNotNull(), F.struct(context("$.viewport.width").try_cast("int").alias("width"), context("$.viewport.height").try_cast("int").alias("height")))
    page = F.struct(F.coalesce(context("$.url"), "url", F.lit("")).alias("url"), context("$.title").alias("title"), viewport.alias("viewport"))
    return events.select(*ENVELOPE, page.alias("page"), F.coalesce("schema_version", F.lit(1)).alias("schema_version"))


def _field(v: Column, kind: str) -> Column:
    """Whether a payload field that is there has its kind. ``v`` is its variant."""
    type_of = F.schema_of_variant(v)
    text, number = type_of == "STRING", F.try_variant_get(v, "$", "double")
    of = lambda t: F.try_variant_get(v, "$", t)
    whole = number == F.floor(number)
    members = lambda right: type_of.startswith("ARRAY<") & F.forall(of("array<variant>"), right)
    fields = of("map<string,variant>")
    coordinate = lambda name: F.try_variant_get(v, f"$.{name}", "double").isNotNull()
    rules = {
        "s": text, "any": F.lit(True), "n": number.isNotNull(), "n0": number >= 0, "n1": number > 0, "i": whole, "i0": whole & (number >= 0), "b": type_of.isin("BOOLEAN", "STRING") & of("boolean").isNotNull(),
        "p": type_of.startswith("OBJECT<") & (F.array_sort(F.map_keys(fields)) == F.array(F.lit("x"), F.lit("y"))) & coordinate("x") & coordinate("y"),
        "ls": members(lambda x: F.schema_of_variant(x) == "STRING"), "ln0": members(lambda x: F.coalesce(F.try_variant_get(x, "$", "double") >= 0, F.lit(False))),
        "lm": members(lambda x: (F.schema_of_variant(x) == "STRING") & F.coalesce(F.try_variant_get(x, "$", "string").isin(MODIFIERS), F.lit(False))),
        "o": type_of.startswith("OBJECT<"), "os": type_of.startswith("OBJECT<") & F.forall(F.map_values(fields), lambda x: F.schema_of_variant(x) == "STRING"),
    }
    return rules[kind] if kind in rules else text & of("string").isin(kind.split("|"))


def payload_valid(kind: str, fields: list[str], payload: str = "_payload") -> Column:
    """Whether the variant payload of this type has its required fields, no others than its own, and right kinds.

    A field that is null counts as one that is not there.
    """
    v = F.col(payload)
    keys = F.map_keys(F.try_variant_get(v, "$", "map<string,variant>"))
    if fields == ["free"]:
        return keys.isNotNull()
    names = [f.split(":")[0].rstrip("*") for f in fields]
    ok = F.coalesce(F.size(F.array_except(keys, F.array(*[F.lit(n) for n in names]))) == 0, F.lit(False))
    for f, name in zip(fields, names, strict=True):
        one = F.try_variant_get(v, f"$.{name}", "variant")
        there = one.isNotNull() & ~F.is_variant_null(one)
        right = F.coalesce(_field(one, f.split(":")[1]), F.lit(False))
        ok = ok & (there & right if "*" in f.split(":")[0] else ~there | right)
    return ok


def with_payload(events: DataFrame) -> DataFrame:
    """Adds _payload: the payload as a variant, null if it isn't JSON; no payload is an empty one."""
    return events.withColumn("_payload", F.try_parse_json(F.coalesce("payload", F.lit("{}"))))


def is_valid() -> Column:
    """Whether an event of the wire shape, with _payload as ``with_payload`` adds it, is one of the known types and right in all its parts."""
    checks = F.lit(False)
    for line in TYPES.split("\n"):
        if line:
            name, *fields = line.split(" ")
            kind = name.rstrip("!")
            ok = payload_valid(kind, fields) & (F.col("target").isNotNull() if name.endswith("!") else F.lit(True))
            checks = F.when(F.col("event_type") == kind, ok).otherwise(checks)
    ids = F.col("event_id").rlike(UUID) & F.col("session_id").rlike(UUID) & F.col("tab_id").rlike(UUID)
    return F.coalesce(ids & (F.col("sequence") >= 0) & F.col("timestamp").isNotNull() & (F.col("schema_version") == 1) & checks, F.lit(False))


def valid_flows(events: DataFrame, key: str = "flow_id") -> DataFrame:
    """(key, n_events, valid): one wrong event makes a flow invalid."""
    shaped = wire_shape(events).columns
    rows = events.select(key, *[c for c in events.columns if c in shaped or c in ("url", "page_context")])
    return with_payload(rows).withColumn("_ok", is_valid()).groupBy(key).agg(F.count(F.lit(1)).alias("n_events"), F.bool_and("_ok").alias("valid"))
