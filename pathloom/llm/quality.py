"""Quality rules by cross-document line frequency, in DataFrame functions only.

Normalised lines are hashed; for each host the distinct documents that hold a line are counted; lines
above the host's limit count as removed; documents that lose too much of their words are rejected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pathloom.llm.common import BROADCAST_ROWS, SPACE_RUN, WORD_CHAR, small_side, stored

#: A line is removed when more than this many, and more than this share, of a host's distinct documents hold it.
MIN_DOCS, MAX_SHARE = 10, 0.05
#: A document is rejected when less than this share of its words is left.
MIN_LEFT = 0.3
MIN_WORDS = 50


def normal_line(line: Column) -> Column:
    """Lower case, digits as 0, white space collapsed and trimmed."""
    return F.trim(F.regexp_replace(F.translate(F.lower(line), "123456789", "000000000"), SPACE_RUN, " "))


def base_metrics(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed (and drops nothing).

    Null text counts as empty: all numbers are 0 and base_failed is true. Repeated 3-word windows are
    found by sorting the windows' 64-bit hashes with their positions, so that a text of n words takes
    n log n steps and no shuffle; texts without a repeated window skip the sort.
    """
    keep = docs.columns
    body = F.coalesce(F.col(text), F.lit(""))
    d = docs.select(*keep, body.alias("_t"))
    d = d.select(*keep, "_t", F.array_remove(F.split("_t", SPACE_RUN), "").alias("_w"), F.filter(F.split("_t", "\n"), lambda x: x.rlike(WORD_CHAR)).alias("_l"))
    d = d.select(
        *keep, "_l",
        F.size("_w").alias("_n"),
        F.length(F.array_join("_w", "")).cast("long").alias("word_chars"),
        F.regexp_count("_t", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        F.expr("case when size(_w) >= 3 then transform(slice(_w, 1, size(_w) - 2), (x, i) -> xxhash64(x, get(_w, i + 1), get(_w, i + 2))) else cast(array() as array<bigint>) end").alias("_h"),
    )
    # position bits, and (hash prefix, position) in one sorted long for each window of texts with a repeat
    d = d.select("*", F.expr("length(bin(_n))").alias("_k"), F.expr("size(array_distinct(_h)) < size(_h)").alias("_some"))
    d = d.select("*", F.expr("case when _some then sort_array(transform(_h, (h, i) -> shiftleft(shiftright(h, _k), _k) | cast(i as bigint))) end").alias("_p"))
    d = d.select("*", F.expr("""
        case when _some then sort_array(transform(filter(_p, (p, j) ->
            coalesce(shiftright(p, _k) = shiftright(get(_p, j - 1), _k) and get(_h, cast(p & (shiftleft(1L, _k) - 1) as int)) = get(_h, cast(get(_p, j - 1) & (shiftleft(1L, _k) - 1) as int)), false)
            or coalesce(shiftright(p, _k) = shiftright(get(_p, j + 1), _k) and get(_h, cast(p & (shiftleft(1L, _k) - 1) as int)) = get(_h, cast(get(_p, j + 1) & (shiftleft(1L, _k) - 1) as int)), false)),
            p -> p & (shiftleft(1L, _k) - 1))) end""").alias("_at"))
    d = d.select(
        *keep,
        F.col("_n").cast("long").alias("n_words"), "word_chars", "n_symbols",
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        F.expr("case when _some then aggregate(transform(_at, (p, j) -> least(3L, coalesce(get(_at, j + 1) - p, 3L))), 0L, (a, x) -> a + x) else 0L end").alias("n_repeat_words"),
        F.col("_l").alias("_lines"),
    )
    # a generator, so that a filter on the metrics isn't moved below, where it would split a text for each of its words
    numbers = F.struct("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", F.col("_lines"))
    d = d.select(*keep, F.inline(F.array(numbers)))
    return d.withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))


def text_key(text: Column) -> list[Column]:
    """Two 64-bit hashes that stand for the whole text."""
    body = F.coalesce(text, F.lit(""))
    return [F.xxhash64(body).alias("_k1"), F.xxhash64(F.lit("second"), body).alias("_k2")]


def _above(docs: DataFrame, text: str = "text", host: str = "source", min_docs: int = MIN_DOCS, max_share: float = MAX_SHARE) -> DataFrame:
    """(_host, _k1, _k2, _h, _w) of every distinct text of a host and line in it above the limits; _w: its words.

    Exact copies of a text within a host count as one document. Null hosts form a host; null texts
    have no lines. Counting combines on the map side first. Hosts and lines above the limits are broadcast behind
    a count of them; where they are too many for that, the joins are plain inner ones, whose large keys
    adaptive execution splits.
    """
    lines = F.filter(F.split(F.coalesce(F.col(text), F.lit("")), "\n"), lambda x: x.rlike(WORD_CHAR))
    stats = F.transform(lines, lambda x: F.struct(F.xxhash64(normal_line(x)).alias("h"), F.regexp_count(x, F.lit(f"{WORD_CHAR}+")).alias("w")))
    distinct = docs.select(F.col(host).alias("_host"), *text_key(F.col(text)), stats.alias("_s")).groupBy("_host", "_k1", "_k2").agg(F.first("_s").alias("_s"))
    # a text without lines keeps a row, so that its host's documents are all counted
    rows = distinct.select("_host", "_k1", "_k2", F.explode_outer("_s").alias("_s")).groupBy("_host", "_k1", "_k2", F.col("_s.h").alias("_h")).agg(F.sum("_s.w").alias("_w"))
    rows = stored(rows, "lines")
    hosts = stored(rows.select("_host", "_k1", "_k2").distinct().groupBy("_host").agg(F.count(F.lit(1)).alias("_docs")), "hosts")
    counts = rows.where("_h is not null").groupBy("_host", "_h").agg(F.count(F.lit(1)).alias("_in")).where(F.col("_in") > min_docs)
    c, n = counts.alias("c"), small_side(hosts).alias("n")
    over = c.join(n, F.col("c._host").eqNullSafe(F.col("n._host"))).where(F.col("_in") > max_share * F.col("_docs")).select(F.col("c._host").alias("_host"), F.col("c._h").alias("_h"))
    r, o = rows.alias("r"), small_side(stored(over, "over")).alias("o")
    hit = r.join(o, (F.col("r._h") == F.col("o._h")) & F.col("r._host").eqNullSafe(F.col("o._host")))
    return hit.select(*[F.col(f"r.{x}").alias(x) for x in ("_host", "_k1", "_k2", "_h", "_w")])


def removed_words(docs: DataFrame, text: str = "text", host: str = "source", min_docs: int = MIN_DOCS, max_share: float = MAX_SHARE) -> DataFrame:
    """(host, _k1, _k2, n_removed) of every distinct text of a host that loses words."""
    return _above(docs, text, host, min_docs, max_share).groupBy("_host", "_k1", "_k2").agg(F.sum("_w").alias("n_removed"))


METRICS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def judge(docs: DataFrame, text: str = "text", host: str = "source", min_docs: int = MIN_DOCS, max_share: float = MAX_SHARE, min_left: float = MIN_LEFT) -> DataFrame:
    """The input's columns but for the text, and the metrics, n_removed and kept.

    A document is kept if it passes the base rules and at least ``min_left`` of its words are in lines
    that its host doesn't repeat above the limits. Null and empty texts fail the base rules. Input columns that clash
    with the added names are replaced. Repeated rows get the same verdict each; an empty table gives no rows.
    """
    keep = [c for c in docs.columns if c != text and c not in (*METRICS, "n_removed", "kept")]
    own = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row"), F.col(text).alias("text"), F.col(host).alias("_host"), *text_key(F.col(text)))
    m = base_metrics(own, "text").drop("text", "_lines").alias("m")
    x = removed_words(docs, text, host, min_docs, max_share).alias("x")
    same = (F.col("m._k1") == F.col("x._k1")) & (F.col("m._k2") == F.col("x._k2")) & F.col("m._host").eqNullSafe(F.col("x._host"))
    out = m.join(x, same, "left").select("m.row", *[F.col(f"m.{c}") for c in METRICS], F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"))
    kept = ~F.col("base_failed") & (F.col("n_words") - F.col("n_removed") >= min_left * F.col("n_words"))
    return out.select(*[F.col("row").getField(c).alias(c) for c in keep], *METRICS, "n_removed", kept.alias("kept"))


def _passing(docs: DataFrame, text: str, host: str) -> DataFrame:
    """(row, text, _host, _k1, _k2, n_words) of the documents that pass the base rules; row has all columns."""
    own = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(text).alias("text"), F.col(host).alias("_host"), *text_key(F.col(text)))
    return base_metrics(own, "text").where(~F.col("base_failed")).select("row", "text", "_host", "_k1", "_k2", "n_words")


def kept_documents(docs: DataFrame, text: str = "text", host: str = "source", min_docs: int = MIN_DOCS, max_share: float = MAX_SHARE, min_left: float = MIN_LEFT) -> DataFrame:
    """The rows of ``docs`` that ``judge`` keeps, with their columns, of any name, and text unchanged.

    The depleted texts' keys are stored first: as few as they mostly are, they are broadcast behind a
    check of their number, and joined by a shuffle if there are more.
    """
    gone = stored(removed_words(docs, text, host, min_docs, max_share), "removed")
    d, g = _passing(docs, text, host).alias("d"), small_side(gone).alias("g")
    same = (F.col("d._k1") == F.col("g._k1")) & (F.col("d._k2") == F.col("g._k2")) & F.col("d._host").eqNullSafe(F.col("g._host")) & (F.col("d.n_words") - F.col("g.n_removed") < min_left * F.col("d.n_words"))
    return d.join(g, same, "left_anti").select("d.row.*")


def cleaned_documents(docs: DataFrame, text: str = "text", host: str = "source", min_docs: int = MIN_DOCS, max_share: float = MAX_SHARE, min_left: float = MIN_LEFT) -> DataFrame:
    """The rows of ``docs`` that ``judge`` keeps, their texts without the lines above the limits.

    A line that is removed goes with its line feed; lines without words stay; other texts stay as they are; null and empty
    texts aren't kept. An n_chars column is made anew where the text is; other columns, of any name, stay. Repeated rows are
    kept or not together; an empty table gives no rows. What texts lose is stored first; it is broadcast behind a check
    of its size, and joined by a shuffle if it is larger.
    """
    lost = _above(docs, text, host, min_docs, max_share).groupBy("_host", "_k1", "_k2").agg(F.sum("_w").alias("n_removed"), F.collect_set("_h").alias("_gone"))
    gone = stored(lost, "removed")
    size = gone.agg(F.sum(F.size("_gone") + 5)).first()[0] or 0
    d, g = _passing(docs, text, host).alias("d"), (F.broadcast(gone) if size <= 8 * BROADCAST_ROWS else gone).alias("g")
    same = (F.col("d._k1") == F.col("g._k1")) & (F.col("d._k2") == F.col("g._k2")) & F.col("d._host").eqNullSafe(F.col("g._host"))
    both = d.join(g, same, "left").where(F.col("_gone").isNull() | (F.col("n_words") - F.col("n_removed") >= min_left * F.col("n_words")))
    left = F.filter(F.split(F.col("d.text"), "\n"), lambda x: ~(x.rlike(WORD_CHAR) & F.array_contains(F.col("g._gone"), F.xxhash64(normal_line(x)))))
    body = F.when(F.col("g._gone").isNull(), F.col("d.text")).otherwise(F.array_join(left, "\n"))
    old = lambda c: F.col("d.row").getField(c)
    changed = {text: body}
    if "n_chars" in docs.columns and text != "n_chars":
        changed["n_chars"] = F.when(F.col("g._gone").isNull(), old("n_chars")).otherwise(F.length(body)).cast("long")
    return both.select(*[(changed[c] if c in changed else old(c)).alias(c) for c in docs.columns])
