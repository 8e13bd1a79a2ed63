"""Line dedup by a deletion-neighbourhood join.

Distinct lines are joined on hashed keys of all variants that an edit bound of one deletion gives. Two
lines at edit distance one either lose a character at the same place and are then equal (a
replacement), or one of them with a character deleted is the other. Of the lines that a line is so
joined to, the earliest is verified by edit distance; the line goes if one is earlier.

Hash joins on halves, and then on all but one of 8 and of 64 stretches, come first: lines at distance
one share these. Only lines that share them with another line have their variants written out, so that
the bulk of a corpus, whose lines are like no others, costs a few keys a line and not one for each
character.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pathloom.llm.common import BROADCAST_ROWS, SPACE_RUN, WORD_CHAR, dropped, renamed, small_side, stored

#: Normalised lines shorter than this (code points) have no near lines: one edit makes another word of them. Equal ones go at any length.
MIN_CHARS = 20
#: Stretches of a line of which a near line may differ in one, coarse ones first; lines without such a partner write out no variants.
HOLES = (8, 64)
_B = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1
_INVERSE = pow(_B, -1, 1 << 64)


def normal(line: Column) -> Column:
    """Lower case, white space collapsed and trimmed. The regular expression runs only on lines that need it."""
    odd = line.contains("  ")
    for c in "\t\x0b\x0c\r":
        odd = odd | line.contains(c)
    return F.trim(F.lower(F.when(odd, F.regexp_replace(line, SPACE_RUN, " ")).otherwise(line)))


def _scramble(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def variants(line: str) -> tuple[np.ndarray, np.ndarray, int]:
    """Hash of the line less its i-th character, for each i; the same with i mixed in; hash of the line.

    The hash is a polynomial in 64-bit arithmetic: what follows a deleted character counts one power
    less, so all n variants come from two running sums.
    """
    with np.errstate(over="ignore"):
        code = np.frombuffer(line.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
        n = len(code)
        power = np.ones(n, np.uint64)
        power[1:] = np.uint64(_B)
        power = np.multiply.accumulate(power)
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_scramble(code + np.uint64(0x51ED27)) * power)))
        less = sums[:-1] + (sums[-1] - sums[1:]) * np.uint64(_INVERSE)
        deleted = _scramble(less ^ np.uint64(n - 1))
        placed = _scramble(deleted + np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03))
        return deleted, placed, int(_scramble(sums[-1:] ^ np.uint64(n))[0])


def _key(table: DataFrame, key: str, text: str) -> list[Column]:
    """What tells rows apart: the key, nulls last, and a hash of the text."""
    return [F.coalesce(F.col(key).cast("long"), F.lit(2**63 - 1)).alias("_k"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("_t")]


def occurrences(docs: DataFrame, key: str = "doc_id", text: str = "text", min_chars: int = 1) -> DataFrame:
    """(_k, _t, _at, _line): the normalised lines of documents with their places."""
    lines = docs.select(*_key(docs, key, text), F.posexplode(F.split(F.coalesce(F.col(text), F.lit("")), "\n")).alias("_at", "_raw"))
    return lines.select("_k", "_t", "_at", normal(F.col("_raw")).alias("_line")).where(F.length("_line") >= min_chars)


def _holes(line: Column, holes: int) -> Column:
    """Hashes of a line without one of ``holes`` stretches, for lengths n and n - 1.

    Lines at distance one are equal outside the stretch that holds the edit, if the stretches are laid
    out for the shorter one's length. With two holes these are the halves.
    """
    n = F.length(line)

    def one(length: Column, i: Column) -> Column:
        start, end = F.floor(length * i / holes).cast("int"), F.floor(length * (i + 1) / holes).cast("int")
        return F.xxhash64(length, i, F.left(line, start), F.right(line, length - end))

    places = F.sequence(F.lit(0), F.lit(holes - 1))
    return F.concat(F.transform(places, lambda i: one(n, i)), F.transform(places, lambda i: one(n - 1, i)))


def _halves(line: Column) -> Column:
    """Hashes of the first and last halves of a line, for the half lengths of lines of n and of n - 1 characters.

    Lines at distance one share one of these: the edit is in the other half. Odd lengths have one half length.
    """

    def pair(half: Column) -> list[Column]:
        return [F.xxhash64(F.lit(1), half, F.left(line, half)), F.xxhash64(F.lit(2), half, F.right(line, half))]

    half = F.floor(F.length(line) / 2).cast("int")
    return F.when(F.length(line) % 2 == 0, F.array(*pair(half), *pair(half - 1))).otherwise(F.array(*pair(half)))


def near_lines(docs: DataFrame, places: DataFrame, firsts: DataFrame, key: str, text: str, min_chars: int, holes: Sequence[int] = HOLES) -> DataFrame:
    """(_h, _near): for lines with an earlier one at edit distance 1, the earliest's hash, verified.

    ``places`` has each line's hash and the hashes of its halves, ``firsts`` the first place of each
    hash. Keys are combined on the map side to their smallest places, so that a key that very many
    lines share gives one row, and no pairs are made within a key.
    """

    def shared(keys: DataFrame, name: str) -> DataFrame:
        """Keys that more than one line has."""
        return stored(keys.groupBy("_hole").agg(F.min("_h").alias("_a"), F.max("_h").alias("_b")).where("_a <> _b").select("_hole"), name)

    # lines that share a half with another line, then of these the lines that are equal but for a short stretch
    keyed = places.select("_h", F.explode("_halves").alias("_hole"))
    some = stored(keyed.join(small_side(shared(keyed, "halves")), "_hole", "left_semi").select("_h").distinct(), "some")
    picked = stored(firsts.join(small_side(some), "_h", "left_semi"), "picked")
    held = stored(picked.select(F.col("_first._k").alias("_pk")).distinct(), "held")
    if held.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        # few documents hold them: only these are split into lines again
        docs = docs.join(F.broadcast(held), _key(docs, key, text)[0] == F.col("_pk"), "left_semi")
    p, f = occurrences(docs, key, text, min_chars).withColumn("_h", F.xxhash64("_line")).alias("p"), small_side(picked).alias("f")
    here = (F.col("p._h") == F.col("f._h")) & (F.struct(F.col("p._k"), F.col("p._t"), F.col("p._at")) == F.col("f._first"))
    rows = stored(p.join(f, here).select(F.col("f._h").alias("_h"), "_line", "_first").dropDuplicates(["_h"]), "wide")
    for n in holes:
        # the keys are read twice, so they are stored: making them costs n walks over each line
        keyed = stored(rows.select("_h", F.explode(_holes(F.col("_line"), n)).alias("_hole")), "holes")
        met = shared(keyed, "stretches")
        close = keyed.join(small_side(met), "_hole", "left_semi").select("_h").distinct()
        closer = stored(rows.join(close, "_h", "left_semi"), "candidates")
        for done in (keyed, met, rows):
            dropped(done)
        rows = closer

    def write_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys, kinds, own = [], [], []
            size = 0
            for i, x in enumerate(b.column(1)):
                deleted, placed, whole = variants(x.as_py())
                deleted = np.unique(deleted)
                keys += [placed, deleted, np.array([whole], np.uint64)]
                kinds += [np.zeros(len(placed), np.int8), np.ones(len(deleted), np.int8), np.full(1, 2, np.int8)]
                own.append(np.full(len(placed) + len(deleted) + 1, i))
                size += len(own[-1])
                if size > 200_000 or i == b.num_rows - 1:
                    at = pa.array(np.concatenate(own))
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.concatenate(kinds)), b.column(0).take(at), b.column(2).take(at)], names=["_key", "_kind", "_h", "_first"])
                    keys, kinds, own, size = [], [], [], 0

    first = rows.schema["_first"].dataType.simpleString()
    keyed = rows.select("_h", "_line", "_first").mapInArrow(write_out, f"_key long, _kind byte, _h long, _first {first}")
    place = F.struct("_first", "_h")
    # kind 0 meets kind 0 (replacements); 1 (a character deleted) meets 2 (the line itself)
    per_key = keyed.groupBy("_key").agg(F.count(F.lit(1)).alias("_n"), F.min(F.when(F.col("_kind") == 0, place)).alias("_p0"), F.min(F.when(F.col("_kind") == 1, place)).alias("_p1"), F.min(F.when(F.col("_kind") == 2, place)).alias("_p2")).where("_n > 1")
    met = keyed.join(per_key, "_key").select("_h", "_first", F.when(F.col("_kind") == 0, F.col("_p0")).when(F.col("_kind") == 1, F.col("_p2")).otherwise(F.col("_p1")).alias("_p"))
    best = met.where(F.col("_p._first") < F.col("_first")).groupBy("_h").agg(F.min("_p").alias("_p")).select("_h", F.col("_p._h").alias("_near"))
    b, x, y = best.alias("b"), rows.select("_h", "_line").alias("x"), rows.select("_h", "_line").alias("y")
    both = b.join(x, F.col("b._h") == F.col("x._h")).join(y, F.col("b._near") == F.col("y._h"))
    return both.where(F.levenshtein(F.col("x._line"), F.col("y._line"), 1) >= 0).select(F.col("b._h").alias("_h"), F.col("b._near").alias("_near"))


def removals(docs: DataFrame, key: str = "doc_id", text: str = "text", min_chars: int = MIN_CHARS) -> DataFrame:
    """(_k, _t, _at, _exact): places of the lines that go: an equal line, or one at edit distance 1, is earlier.

    Order: by key (nulls last), text hash and line number. Repeated rows (same key and text) are one
    document and are treated alike. A line goes even if the earlier line goes too. Lines without a word never go; equal
    lines go at any length, near ones from ``min_chars`` on. Texts and lines of any length are read whole.
    """
    lines = occurrences(docs, key, text).select("_k", "_t", "_at", "_line", F.xxhash64("_line").alias("_h"))
    halves = F.when(F.length("_line") >= min_chars, _halves(F.col("_line")))
    halved = stored(lines.select("_k", "_t", "_at", "_h", halves.alias("_halves")), "places")
    at = halved.select("_k", "_t", "_at", "_h")
    firsts = at.groupBy("_h").agg(F.min(F.struct("_k", "_t", "_at")).alias("_first"), F.count(F.lit(1)).alias("_n"))
    near = stored(near_lines(docs, halved, firsts.select("_h", "_first"), key, text, min_chars).select("_h", F.lit(True).alias("_is_near")), "near")
    marks = firsts.join(small_side(near), "_h", "left").where("_n > 1 or _is_near").select("_h", "_first", F.coalesce("_is_near", F.lit(False)).alias("_is_near"))
    marks = small_side(stored(marks, "marks"))
    a, m = at.alias("a"), marks.alias("m")
    later = F.struct(F.col("a._k"), F.col("a._t"), F.col("a._at")) != F.col("m._first")
    return a.join(m, F.col("a._h") == F.col("m._h")).where(later | F.col("m._is_near")).select(F.col("a._k").alias("_k"), F.col("a._t").alias("_t"), F.col("a._at").alias("_at"), later.alias("_exact")).distinct()


def dedup_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", min_chars: int = MIN_CHARS) -> DataFrame:
    """The input's columns with the text rewritten, and n_lines, n_exact and n_near (lines, and lines removed).

    Lines are what stands between line feeds. A line that is removed goes with its line feed. Null
    texts stay null with no lines; lines without a word stay; an empty table gives no rows; repeated rows are treated
    alike; texts of any length are read whole. Input columns with the added names are replaced, others, of any name,
    stay. The texts are shuffled once, by their key.
    """
    added = ("n_lines", "n_exact", "n_near")
    rows, keep, at = renamed(docs, added)
    key, text = at[key], at[text]
    gone = removals(rows, key, text, min_chars).groupBy("_k", "_t").agg(F.map_from_entries(F.collect_list(F.struct("_at", "_exact"))).alias("_gone"))
    d, g = rows.select(*keep, *[c.alias(n) for c, n in zip(_key(rows, key, text), ("_k", "_t"), strict=True)]).alias("d"), gone.alias("g")
    both = d.join(g, (F.col("d._k") == F.col("g._k")) & (F.col("d._t") == F.col("g._t")), "left").select(*[F.col(f"d.{c}") for c in keep], F.col("g._gone").alias("_gone"))
    lines = F.split(F.col(text), "\n")
    places = F.array_sort(F.map_keys("_gone"))
    both = both.withColumn("_all", lines)
    rewritten = F.when(F.col("_gone").isNull(), F.col(text)).otherwise(F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size("_all") - 1), places), lambda i: F.get(F.col("_all"), i)), "\n"))
    exact = F.coalesce(F.size(F.filter(F.map_values("_gone"), lambda x: x)), F.lit(0)).cast("long")
    out = both.select(*[rewritten.alias(c) if c == text else F.col(c) for c in keep], F.coalesce(F.size("_all"), F.lit(0)).cast("long").alias("n_lines"), exact.alias("n_exact"), (F.coalesce(F.size("_gone"), F.lit(0)).cast("long") - exact).alias("n_near"))
    return out.toDF(*keep.values(), *added)


def deduplicated_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", min_chars: int = MIN_CHARS) -> DataFrame:
    """The rows of ``docs`` with their lines deduplicated; those whose every word went with its lines are dropped.

    An n_chars column is made anew; other columns, of any name, stay. Documents that had no words before, null texts
    among them, stay as they are. Repeated rows are treated alike; an empty table gives no rows.
    """
    names = docs.columns
    own = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), F.col(key).alias("key"), F.col(text).alias("text"))
    found = dedup_lines(own, "key", "text", min_chars)
    stays = (F.col("n_exact") + F.col("n_near") == 0) | F.col("text").rlike(WORD_CHAR)
    made = {text: F.col("text")} | ({"n_chars": F.length("text").cast("long")} if "n_chars" in names and text != "n_chars" else {})
    return found.where(stays).select(*[(made[c] if c in made else F.col("row").getField(c)).alias(c) for c in names])
