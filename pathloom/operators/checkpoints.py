"""State assertions from page snapshots: indexes, previous snapshot, and differences."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pathloom.functions.element import identity, snapshot_locator
from pathloom.functions.text import string_literal
from pathloom.functions.url import escape_regex, present
from pathloom.operators.numbering import numbered

MAX_DIFFS, MAX_VISIBLE, MAX_TOTAL, SHORT = 3, 3, 5, 50


def element_signature(e: Column) -> Column:
    """role:name or text of an element, by which global elements are found."""
    role, name = e["selectors"]["role"]["role"], present(e["selectors"]["role"]["name"])
    return F.coalesce(F.when(name.isNotNull(), F.concat(F.lit("role:"), role, F.lit(":"), name)), F.concat(F.lit("text:"), F.left(present(e["text_content"]), F.lit(SHORT))))


def first_by_url(checkpoints: DataFrame, order: str = "cp_ord") -> DataFrame:
    """The first checkpoint of each non-empty URL."""
    return checkpoints.where(present(F.col("url")).isNotNull()).withColumn("_r", F.row_number().over(Window.partitionBy("url").orderBy(order))).where("_r = 1").drop("_r")


def by_url(checkpoints: DataFrame, order: str = "cp_ord") -> DataFrame:
    """All checkpoints with their number among those of their URL and how many there are."""
    w = Window.partitionBy("url")
    return checkpoints.where(present(F.col("url")).isNotNull()).withColumns({"k": F.row_number().over(w.orderBy(order)), "n": F.count(F.lit(1)).over(w)})


def placed_by_url(checkpoints: DataFrame, order: str = "cp_ord") -> DataFrame:
    """All checkpoints with their number k among those of their URL, by range partitions, so that any number may share a URL."""
    rows = numbered(checkpoints.where(present(F.col("url")).isNotNull()), "_n", "url", order, kind="long")
    first = rows.groupBy("url").agg(F.min("_n").alias("_first"))
    return rows.join(first, "url").withColumn("k", F.col("_n") - F.col("_first") + 1).drop("_n", "_first")


def by_trigger(checkpoints: DataFrame, order: str = "cp_ord") -> DataFrame:
    """The first checkpoint of each triggering event."""
    return checkpoints.where("trigger_event_id is not null").withColumn("_r", F.row_number().over(Window.partitionBy("trigger_event_id").orderBy(order))).where("_r = 1").drop("_r")


def global_elements(checkpoints: DataFrame, order: str = "cp_ord", elements: str = "visible_elements") -> DataFrame:
    """(signature): elements in the first checkpoint of every URL, if there are at least two URLs."""
    firsts = first_by_url(checkpoints, order)
    n = firsts.agg(F.count(F.lit(1)).alias("n"))
    sigs = firsts.select("url", F.explode(elements).alias("e")).select("url", element_signature(F.col("e")).alias("signature")).where("signature is not null").distinct()
    return sigs.groupBy("signature").agg(F.count(F.lit(1)).alias("c")).join(F.broadcast(n), (F.col("c") == F.col("n")) & (F.col("n") >= 2)).select("signature")


def kth_assignment(calls: DataFrame, checkpoints: DataFrame, order: str = "call_ord", cp_order: str = "cp_ord") -> DataFrame:
    """Each call's checkpoint: the k-th call for a URL takes its k-th checkpoint, later calls the last."""
    w = Window.partitionBy("flow_id", "url").orderBy(order)
    numbered = calls.withColumn("_k", F.row_number().over(w)).alias("c")
    p = by_url(checkpoints, cp_order).alias("p")
    return numbered.join(p, (F.col("c.url") == F.col("p.url")) & (F.col("p.k") == F.least(F.col("c._k").cast("long"), F.col("p.n"))), "left").select("c.flow_id", f"c.{order}", "c.url", F.col("c._k").alias("call_no"), F.col("p.checkpoint_id").alias("checkpoint_id"))


def with_previous(checkpoints: DataFrame) -> DataFrame:
    """Adds before: the session's checkpoint before each one in time."""
    w = Window.partitionBy("session_id").orderBy("timestamp", "checkpoint_id")
    return checkpoints.withColumn("before", F.lag(F.struct("checkpoint_id", "visible_elements", "click_context")).over(w))


def _first_by_identity(before: Column, after: Column, one: Callable[[Column, Column], Column]) -> Column:
    """``one(new, old)`` of the first new elements for which it isn't null, three at most, in their order.

    ``old`` is the last element of ``before`` with the identity of the new one, null if there is none. The elements of
    both sides are sorted by identity and read once, the last old one being carried to the new ones of its identity, so
    that the work grows with their number and not with its square, as it would by a look-up in a map (which Spark reads
    from its front each time).
    """
    at = lambda elements, side: F.transform(elements, lambda e, i: F.struct(identity(e).alias("id"), F.lit(side).alias("side"), i.alias("i")))
    order = F.sort_array(F.concat(at(F.coalesce(before, F.slice(after, 1, 0)), 0), at(after, 1)))
    start = F.struct(F.lit(None).cast("string").alias("id"), F.lit(None).cast("int").alias("old"), F.array().cast("array<struct<i:int,text:string>>").alias("found"))

    def step(acc: Column, x: Column) -> Column:
        old = F.when(x["side"] == 0, x["i"]).when(acc["id"] == x["id"], acc["old"])
        text = F.when(x["side"] == 1, one(F.get(after, x["i"]), F.get(before, old)))
        more = F.filter(F.array(F.struct(x["i"].alias("i"), text.alias("text"))), lambda f: f["text"].isNotNull())
        return F.struct(x["id"].alias("id"), old.alias("old"), F.slice(F.sort_array(F.concat(acc["found"], more)), 1, MAX_DIFFS).alias("found"))

    return F.aggregate(order, start, step, lambda acc: F.transform(acc["found"], lambda f: f["text"]))


def diff_visible(before: Column, after: Column, global_names: Column | None = None) -> Column:
    """Assertions for elements whose text changed or that are new, three at most; none without a before."""

    def one(e: Column, old: Column) -> Column:
        text, place = e["text_content"], snapshot_locator(e)
        changed = F.when(~old["text_content"].eqNullSafe(text) & (present(text).isNotNull()) & (F.length(text) <= SHORT), F.concat(F.lit("await expect("), place, F.lit(").toContainText("), string_literal(text), F.lit(")")))
        out = F.when(old.isNotNull(), changed).otherwise(F.concat(F.lit("await expect("), place, F.lit(").toBeVisible()")))
        skip = F.array_contains(global_names, identity(e)) if global_names is not None else F.lit(False)
        return F.when(~skip & place.isNotNull(), out)

    return F.when(before.isNull(), F.array().cast("array<string>")).otherwise(_first_by_identity(before, after, one))


def diff_context(before: Column, after: Column) -> Column:
    """Assertions from the elements around a click: text, value, expanded, hidden, width; new short texts are visible."""

    def attribute(e: Column, name: str) -> Column:
        return F.try_element_at(e["attributes"], F.lit(name))

    def one(e: Column, old: Column) -> Column:
        text, css = e["text_content"], present(e["selectors"]["css"])
        place = F.coalesce(snapshot_locator(e), F.concat(F.lit("page.locator("), string_literal(css), F.lit(")")))
        expect = lambda *x: F.concat(F.lit("await expect("), place, F.lit(")"), *x)
        differs = lambda name: ~attribute(old, name).eqNullSafe(attribute(e, name)) & attribute(e, name).isNotNull()
        style = F.coalesce(attribute(e, "style"), F.lit(""))
        width = F.regexp_extract(style, r"width:\s*(\d+(?:\.\d+)?%)", 1)
        short = present(text).isNotNull() & (F.length(text) <= SHORT)
        changed = (
            F.when(~old["text_content"].eqNullSafe(text) & short, expect(F.lit(".toContainText("), string_literal(text), F.lit(")")))
            .when(differs("aria-valuenow"), expect(F.lit('.toHaveAttribute("aria-valuenow", '), string_literal(attribute(e, "aria-valuenow")), F.lit(")")))
            .when(differs("aria-expanded"), expect(F.lit('.toHaveAttribute("aria-expanded", '), string_literal(attribute(e, "aria-expanded")), F.lit(")")))
            .when(differs("aria-hidden"), F.when(attribute(e, "aria-hidden") == "true", expect(F.lit(".toBeHidden()"))).otherwise(expect(F.lit(".toBeVisible()"))))
            .when((F.coalesce(attribute(old, "style"), F.lit("")) != style) & (width != ""), expect(F.lit('.toHaveCSS("width", /'), width, F.lit("/)")))
        )
        return F.when(place.isNotNull(), F.when(old.isNotNull(), changed).otherwise(F.when(short, expect(F.lit(".toBeVisible()")))))

    return _first_by_identity(before, after, one)


def click_assertions(clicks: DataFrame, checkpoints: DataFrame, order: str = "cp_ord", global_names: Column | None = None) -> DataFrame:
    """(event_id, assertions) of clicks: their checkpoint against the session's one before, else the click's surroundings."""
    after = by_trigger(with_previous(checkpoints), order).alias("p")
    rows = clicks.alias("c").join(after, F.col("c.event_id") == F.col("p.trigger_event_id"), "left")
    visible = diff_visible(F.col("p.before.visible_elements"), F.coalesce(F.col("p.visible_elements"), F.slice(F.col("p.click_context"), 1, 0)), global_names)
    context = diff_context(F.col("p.before.click_context"), F.col("p.click_context"))
    empty = F.array().cast("array<string>")
    return rows.select(F.col("c.event_id").alias("event_id"), F.coalesce(F.when(F.size(visible) > 0, visible), F.when(F.size("p.click_context") > 0, context), empty).alias("assertions"))


def url_assertions(kind: Column, url: Column, elements: Column, title: Column, global_names: Column | None = None) -> Column:
    """Assertions of one step: the URL after a navigation, three visible elements, the title; five at most."""

    def one(e: Column) -> Column:
        role, name, text = e["selectors"]["role"]["role"], present(e["selectors"]["role"]["name"]), present(e["text_content"])
        skip = F.array_contains(global_names, element_signature(e)) if global_names is not None else F.lit(False)
        by_role = F.concat(F.lit("await expect(page.getByRole("), string_literal(role), F.lit(", { name: "), string_literal(name), F.lit(" })).toBeVisible()"))
        by_text = F.concat(F.lit("await expect(page.getByText("), string_literal(text), F.lit(")).toBeVisible()"))
        return F.when(~skip, F.when(name.isNotNull(), by_role).when(F.length(text) <= SHORT, by_text))

    seen = F.slice(F.filter(F.transform(elements, one), lambda x: x.isNotNull()), 1, MAX_VISIBLE)
    nav = F.when((kind == "navigation") & present(url).isNotNull(), F.array(F.concat(F.lit("await expect(page).toHaveURL(/"), escape_regex(url), F.lit("/)"))))
    last = F.when(present(title).isNotNull(), F.array(F.concat(F.lit("await expect(page).toHaveTitle(/"), escape_regex(title), F.lit("/)"))))
    empty = F.array().cast("array<string>")
    return F.slice(F.concat(F.coalesce(nav, empty), F.coalesce(seen, empty), F.coalesce(last, empty)), 1, MAX_TOTAL)
