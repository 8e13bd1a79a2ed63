"""Document fingerprints by winnowing, with DataFrame functions only.

A text is a sequence of tokens; a rolling hash (a cyclic polynomial: each token's hash, rotated by its place) goes
over all grams of GRAM tokens; of each window of WINDOW grams the least hash is kept, of equal ones the rightmost,
with its place. So any GRAM + WINDOW - 1 tokens in a row that two texts share leave them a hash in common.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pathloom.llm.common import unfolded
from pathloom.operators.numbering import numbered

#: Tokens: runs without white space, cut after this many characters, so that text without spaces has grams too.
TOKEN = r"[^\s]{1,12}"
#: Tokens of a gram and grams of a window; powers of two.
GRAM, WINDOW = 4, 8
_PLACE = 2**31 - 1


def _rotated(x: Column, by: int) -> Column:
    return F.shiftleft(x, by).bitwiseOR(F.shiftrightunsigned(x, 64 - by))


def _rolled(by: int) -> Callable[[Column, Column], Column]:
    return lambda x, y: x.bitwiseXOR(_rotated(y, by))


def winnowed(df: DataFrame, text: str, out: str, gram: int = GRAM, window: int = WINDOW) -> DataFrame:
    """Adds ``out``: the kept (place, hash) of a text in order of place; place is a token's number from 0, hash has 31 bits.

    Null and empty texts, and those of white space alone, have none. A text of fewer tokens than a gram is one gram;
    one of fewer grams than a window is one window. Time and memory grow with the length of the text, of any length.
    ``df`` must have no column that begins with ``_w``.
    """
    if gram & (gram - 1) or window & (window - 1) or gram > 32:
        raise ValueError("gram and window are powers of two, gram at most 32")
    names = df.columns
    tokens = F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(f"({TOKEN})"), F.lit(1))
    rows = df.select(*names, F.transform(tokens, lambda x: F.xxhash64(x)).alias("_w"))
    rows = rows.select(*names, F.size("_w").alias("_wn"), F.concat("_w", F.array_repeat(F.lit(0).cast("long"), F.greatest(F.lit(gram) - F.size("_w"), F.lit(0)))).alias("_w"))
    reach = 1
    while reach < gram:
        rows = rows.withColumn("_w", F.zip_with("_w", F.slice("_w", reach + 1, F.size("_w")), _rolled(reach)))
        reach *= 2
    grams = F.when(F.col("_wn") > 0, F.greatest(F.col("_wn") - (gram - 1), F.lit(1))).otherwise(0)
    packed = F.transform(F.slice("_w", F.lit(1), grams), lambda h, i: F.shiftleft(F.shiftrightunsigned(h, 33), 31).bitwiseOR(F.lit(_PLACE).cast("long") - i))
    rows = rows.select(*names, grams.alias("_wn"), packed.alias("_w"))
    reach = 1
    while reach < window:
        rows = rows.withColumn("_w", F.zip_with("_w", F.slice("_w", reach + 1, F.size("_w")), lambda x, y: F.least(x, y)))
        reach *= 2
    windows = F.when(F.col("_wn") > 0, F.greatest(F.col("_wn") - (window - 1), F.lit(1))).otherwise(0)
    kept = F.array_distinct(F.slice("_w", F.lit(1), windows))
    pair = F.transform(kept, lambda v: F.struct((F.lit(_PLACE) - v.bitwiseAND(F.lit(_PLACE))).cast("int").alias("place"), F.shiftright(v, 31).cast("int").alias("hash")))
    return rows.select(*[c for c in names if c != out], pair.alias(out))


def hashes(kept: Column) -> Column:
    """The distinct hashes of a fingerprint."""
    return F.array_distinct(F.transform(kept, lambda x: x["hash"]))


def digest(kept: Column) -> Column:
    """A fingerprint as a string: SHA-256 over its places and hashes, in order."""
    return F.sha2(F.array_join(F.transform(kept, lambda x: F.concat_ws(":", x["place"], x["hash"])), ","), 256)


def likeness(a: Column, b: Column) -> Column:
    """Jaccard similarity of two sets of hashes; of two empty ones 1."""
    both = F.size(F.array_intersect(a, b))
    every = F.size(a) + F.size(b) - both
    return F.when(every == 0, F.lit(1.0)).otherwise(both / every)


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", gram: int = GRAM, window: int = WINDOW) -> DataFrame:
    """(key, kept, fingerprint) of every row: the kept places and hashes, and their digest; see ``winnowed`` for odd texts.

    Repeated rows give repeated rows, an empty table none. Other columns aren't carried on.
    """
    rows = winnowed(docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text")), "text", "kept", gram, window)
    return rows.select(F.col("key").alias(key), "kept", digest(F.col("kept")).alias("fingerprint"))


def edited_likeness(docs: DataFrame, key: str = "doc_id", text: str = "text", gram: int = GRAM, window: int = WINDOW) -> DataFrame:
    """Each document against an edit of itself and against the next document.

    Documents stand by descending key, null keys last, equal keys by a hash of the text; after the last comes the
    first. The edit puts the next document's first characters, as many as there are, in place of the last half (rounded
    down) of the text. Returns doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next and
    n_kept. Null texts count as empty. Rows of equal key and text are one document, given as often as they stand. A sole
    document is its own next. An empty table gives no rows; other columns aren't carried on.

    The order is made from keys, hashes and lengths alone. Texts are shuffled once by their key, and half of each with
    its hashes once more, to the document before it; no task sees more than its share.
    """
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    rows = docs.select(F.col(f"`{key}`").cast("long").alias("id"), body.alias("text")).select("id", F.coalesce("id", F.lit(-(2**63))).alias("k"), F.xxhash64(F.col("id").isNull(), "text").alias("t"), "text")
    listed = rows.select("id", "k", "t", F.length("text").alias("n")).groupBy("id", "k", "t", "n").agg(F.count(F.lit(1)).alias("_copies"))
    placed = numbered(listed, "place", F.desc("k"), "t", kind="long")
    total = placed.agg(F.max("place").alias("last"))
    before = F.when(F.col("place") > 1, F.col("place") - 1).otherwise(F.col("last"))
    a = placed.crossJoin(F.broadcast(total)).select("k", "t", before.alias("before")).alias("a")  # total is one row
    b = placed.select("place", F.col("k").alias("to_k"), F.col("t").alias("to_t"), F.floor(F.col("n") / 2).cast("int").alias("half")).alias("b")
    to = a.join(b, F.col("a.before") == F.col("b.place")).select("k", "t", "to_k", "to_t", "half")
    own = rows.groupBy("k", "t").agg(F.first("text").alias("text"))
    sent = winnowed(own.join(to, ["k", "t"]), "text", "kept", gram, window)
    sent = sent.select(F.col("to_k").alias("k"), F.col("to_t").alias("t"), F.expr("left(text, half)").alias("start"), hashes(F.col("kept")).alias("next_hashes"))
    both = own.join(sent, ["k", "t"]).join(placed.drop("place"), ["k", "t"])
    both = both.withColumn("edited", F.concat(F.expr("left(text, n - cast(floor(n / 2) as int))"), "start"))
    made = winnowed(both, "text", "kept", gram, window).select("id", "n", "_copies", "edited", "next_hashes", digest(F.col("kept")).alias("fingerprint"), hashes(F.col("kept")).alias("own_hashes"))
    made = winnowed(made, "edited", "kept", gram, window)
    out = made.select(
        F.col("id").alias("doc_id"), F.col("n").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), "fingerprint", digest(F.col("kept")).alias("edited_fingerprint"),
        likeness(F.col("own_hashes"), hashes(F.col("kept"))).alias("near_edited"), likeness(F.col("own_hashes"), F.col("next_hashes")).alias("near_next"), F.size("own_hashes").cast("long").alias("n_kept"), "_copies",
    )
    return unfolded(out).drop("_copy")
