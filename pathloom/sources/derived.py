"""The driver's tables as events, URLs, links and checkpoints of this engine.

Types, URLs, tabs, targets and viewports are derived from the columns by fixed rules, which the SQL in
``plans/oracles.py`` states again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pathloom.schema import ELEMENT, TARGET
from pathloom.session import table


def slim_events(spark: SparkSession, sf_dir: str, stream: bool = False) -> DataFrame:
    """What identifies and places an event, and in a few bytes (_type, _value, k) what ``shaped`` makes the rest of. On request as a stream."""
    log = table(spark, sf_dir, "events")
    if stream:
        # a pattern, as a stream's plain path can't be a single file
        log = spark.readStream.schema(log.schema).parquet(f"{sf_dir}/{{events}}.parquet")
    e = log.select("event_id", "ts", "user_id", "event_type", "value", "props")
    day = F.date_format("ts", "yyyyMMdd")
    return e.select(
        F.col("event_id").cast("string").alias("event_id"), F.col("user_id").cast("string").alias("session_id"), F.concat(day, F.lit("-"), (F.col("event_id") % 2).cast("string")).alias("tab_id"),
        F.col("event_id").alias("sequence"), F.col("ts").cast("timestamp").alias("timestamp"), F.get_json_object("props", "$.k").cast("int").alias("k"), "user_id", F.col("event_type").alias("_type"), F.col("value").alias("_value"),
    )


def _target(tag: str, role: Column | None = None, testid: Column | None = None) -> Column:
    """A target of a button or a field, as a struct: no JSON is made and read."""
    named = F.struct(F.lit("button").alias("role"), role.alias("name")) if role is not None else F.lit(None)
    empty = lambda n: F.lit(None).alias(n)
    selectors = F.struct(empty("css"), empty("xpath"), empty("text"), named.alias("role"), (testid if testid is not None else F.lit(None)).alias("testid"), empty("nth"), empty("placeholder"))
    return F.struct(selectors.alias("selectors"), F.lit(tag).alias("tag"), empty("attributes"), empty("text_content"), empty("bounding_box"), empty("is_in_iframe"), empty("iframe_selector")).cast(TARGET)


def shaped(slim: DataFrame) -> DataFrame:
    """Slim events in storage shape, with the columns that were added to them: views scroll, sign-ups navigate, purchases fill, errors are api_error."""
    raw = F.col("_type")
    kind = F.when(raw == "view", "scroll").when(raw == "signup", "navigation").when(raw == "purchase", "fill").when(raw == "error", "api_error").otherwise(raw)
    url = F.concat(F.lit("/"), raw, F.lit("/"), F.col("k").cast("string"))
    button = _target("BUTTON", role=F.concat(F.lit("Go "), (F.col("k") % 3).cast("string")))
    field = _target("INPUT", testid=F.concat(F.lit("f"), (F.col("k") % 2).cast("string")))
    known = F.col("k").isNotNull()
    target = F.when(known & (kind == "click"), button).when(known & (kind == "fill"), field)
    payload = F.when(kind == "navigation", F.concat(F.lit('{"to_url":"'), url, F.lit('"}'))).when(kind == "fill", F.concat(F.lit('{"value":"'), F.col("k").cast("string"), F.lit('"}')))
    first, last = ["event_id", "session_id", "tab_id", "sequence", "timestamp"], ["k", "user_id"]
    return slim.select(
        *first, kind.alias("event_type"), url.alias("url"), target.alias("target"), payload.alias("payload"),
        F.concat(F.lit('{"viewport":{"width":'), (F.col("_value") * 20).cast("int").cast("string"), F.lit("}}")).alias("page_context"), F.lit(1).alias("schema_version"), *last,
        *[c for c in slim.columns if c not in [*first, *last, "_type", "_value"]],
    )


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events in storage shape."""
    return shaped(slim_events(spark, sf_dir))


def links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(page_id, url, n, href, target): the anchors of the pages in order."""
    p = table(spark, sf_dir, "pages").select("page_id", "url", F.regexp_extract_all("html", F.lit(r'<a[^>]*href="([^"]*)"'), F.lit(1)).alias("h"))
    rows = p.select("page_id", "url", F.posexplode("h").alias("n", "href"))
    target = F.from_json(F.to_json(F.struct(F.lit("A").alias("tag"), F.create_map(F.lit("href"), F.col("href")).alias("attributes"))), TARGET)
    return rows.withColumn("target", target)


def checkpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as checkpoints: the host is the session, the anchors are elements with their href as test id."""
    l = links(spark, sf_dir).groupBy("page_id", "url").agg(F.sort_array(F.collect_list(F.struct("n", "href"))).alias("h"))  # noqa: E741
    one = lambda x: F.to_json(F.struct(F.struct(x["href"].alias("testid")).alias("selectors"), F.lit("A").alias("tag"), F.concat(F.lit("link "), x["n"].cast("string")).alias("text_content")))
    elements = F.transform("h", lambda x: F.from_json(one(x), ELEMENT))
    host = F.regexp_extract("url", "^https?://([^/]*)", 1)
    return l.select(
        F.col("page_id").cast("string").alias("checkpoint_id"), host.alias("session_id"), F.col("page_id").cast("string").alias("trigger_event_id"), F.timestamp_seconds("page_id").alias("timestamp"),
        "url", F.lit(None).cast("string").alias("page_title"), elements.alias("visible_elements"), elements.alias("click_context"), F.col("page_id").alias("cp_ord"),
    )
