"""Spelling variants: words one edit apart, found by bands of letter-parity bitmasks.

A word's mask has a bit for each letter and third of the word: whether the letter stands there an odd number of times.
The thirds are the mask's three bands. One edit flips at most two bits, both in the band where the edit is, so the two
other bands are equal. Words are joined on two equal bands and their length, and verified by edit distance. (Three bands
of one mask over the whole word, without the thirds, would hold some four bits each: a band would join a fifteenth of the
vocabulary with itself.)

For words of unequal length the bands are laid out as those of the shorter word, with what follows the edit shifted by one.
Keys that very many words share are split: these words' free band is cut into three again, down to single letters.
"""

from __future__ import annotations

import string
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pathloom.llm.common import dropped, stored

LETTERS = r"([A-Za-zÀ-ÿ]+)"
MIN_CHARS, MIN_COUNT, NOISE = 5, 3, 97
#: Words that share a key and are compared with each other; a key with more is split. Bands at the last split.
KEY_WORDS, LAST = 200, 3**8


def word_counts(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(word, n): words of at least MIN_CHARS characters that occur MIN_COUNT times or more in all texts.

    Runs of letters, A-Z lower-cased. A run loses a letter where 97 divides the CRC-32 of "key:run" (a null key is
    written as nothing): the letter at that number modulo the run's length. Null texts have no words.
    """
    runs = docs.select(F.coalesce(F.col(f"`{key}`").cast("string"), F.lit("")).alias("k"), F.explode(F.regexp_extract_all(F.col(f"`{text}`"), F.lit(LETTERS), F.lit(1))).alias("run"))
    low = F.when(F.col("run").rlike("[A-Z]"), F.translate("run", string.ascii_uppercase, string.ascii_lowercase)).otherwise(F.col("run"))
    runs = runs.select("k", low.alias("run")).withColumn("h", F.crc32(F.concat("k", F.lit(":"), "run").cast("binary")))
    less = F.expr("concat(left(run, cast(h % length(run) as int)), substring(run, cast(h % length(run) as int) + 2))")
    words = runs.select(F.when(F.col("h") % NOISE == 0, less).otherwise(F.col("run")).alias("word")).where(F.length("word") >= MIN_CHARS)
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= MIN_COUNT)


def parity(letters: Column) -> Column:
    """A bit for each letter (code point modulo 64) that stands an odd number of times. Letters that share a bit flip less, never more."""
    return F.aggregate(F.split(letters, ""), F.lit(0).cast("long"), lambda a, c: a.bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), F.ascii(c) % 64)))


def _key(word: Column, size: Column, bands: int, free: Column, shift: Column) -> Column:
    """Hash of the masks of all bands but the free one, of words laid out as ``size`` letters; bands behind it stand ``shift`` further."""

    def mask(i: Column) -> Column:
        start, end = F.floor(size * i / bands).cast("int"), F.floor(size * (i + 1) / bands).cast("int")
        return F.when(i == free, F.lit(0).cast("long")).otherwise(parity(F.substring(word, start + 1 + F.when(i > free, shift).otherwise(0), end - start)))

    return F.xxhash64(F.lit(bands), size, free, F.transform(F.sequence(F.lit(0), F.lit(bands - 1)), mask))


def keyed(rows: DataFrame, bands: int) -> DataFrame:
    """(key, longer, free, word, n) for each band that ``frees`` lists, of rows (word, n, longer, frees)."""
    rows = rows.withColumn("size", F.length("word") - F.col("longer")).where(F.col("size") >= MIN_CHARS)
    rows = rows.select("word", "n", "longer", "size", F.explode("frees").alias("free"))
    # an empty band can't hold the edit, but an edit may be put at the word's end: the last band is always taken
    some = F.floor(F.col("size") * F.col("free") / bands) < F.floor(F.col("size") * (F.col("free") + 1) / bands)
    return rows.where(some).select(_key(F.col("word"), F.col("size"), bands, F.col("free"), F.col("longer")).alias("key"), "longer", "free", "word", "n")


def near_words(words: DataFrame, key_words: int = KEY_WORDS) -> DataFrame:
    """(word, n, near, near_n), stored: all words one edit apart, both ways, without repeats."""
    rows = words.select("word", "n", F.explode(F.array(F.lit(0), F.lit(1))).alias("longer"), F.array(*[F.lit(i) for i in range(3)]).alias("frees"))
    bands, parts = 3, []
    while True:
        keys = keyed(rows, bands)
        sizes = keys.groupBy("key").agg(F.count(F.lit(1)).alias("m"), F.min("longer").alias("least")).where("m > 1 and least = 0")
        met = stored(keys.join(sizes.select("key", (F.lit(bands < LAST) & (F.col("m") > key_words)).alias("hot")), "key"), "shared")
        a, b = met.where("not hot and longer = 0").alias("a"), met.where("not hot").alias("b")
        meet = (F.col("a.key") == F.col("b.key")) & ((F.col("b.longer") == 1) | (F.col("a.word") < F.col("b.word")))
        pairs = a.join(b, meet).where(F.levenshtein(F.col("a.word"), F.col("b.word"), 1) == 1)
        parts.append(stored(pairs.select(F.col("a.word").alias("x"), F.col("a.n").alias("xn"), F.col("b.word").alias("y"), F.col("b.n").alias("yn")).distinct(), "pairs"))
        if met.where("hot").isEmpty():
            dropped(met)
            break
        frees = F.flatten(F.collect_set(F.array(*[F.col("free") * 3 + i for i in range(3)])))
        finer = stored(met.where("hot").groupBy("word", "n", "longer").agg(frees.alias("frees")), "finer")
        dropped(met)
        rows, bands = finer, bands * 3
    one = reduce(DataFrame.unionByName, parts).distinct()
    both = one.select(F.explode(F.array(F.struct(F.col("x").alias("word"), F.col("xn").alias("n"), F.col("y").alias("near"), F.col("yn").alias("near_n")), F.struct(F.col("y").alias("word"), F.col("yn").alias("n"), F.col("x").alias("near"), F.col("xn").alias("near_n")))).alias("p"))
    out = stored(both.select("p.*"), "near")
    for part in parts:
        dropped(part)
    return out


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) for each (word, form): forms followed to the last, each round twice as far. Forms must not run in a circle."""
    done = stored(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        a, b = done.alias("a"), done.alias("b")
        further = stored(a.join(b, F.col("a.root") == F.col("b.word"), "left").select("a.word", F.coalesce("b.root", "a.root").alias("root"), F.col("b.root").isNotNull().alias("on")), "roots")
        dropped(done)
        done = further
        if done.where("on").isEmpty():
            return done.drop("on")


def spelling_variants(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(word, form, root, n, n_near, form_n) for every word of ``word_counts``.

    A word's form is its near word of largest n (of equal ones the least in code-point order) if that is at least twice
    the word's own, else null; root follows forms to the last. Repeated rows count as often as they stand; an empty
    table gives no rows. Words of any length take part. Other columns of the table, of any name, are not read.
    """
    words = stored(word_counts(docs, key, text), "words")
    near = near_words(words)
    best = near.groupBy("word").agg(F.max("n").alias("n"), F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"))
    large = -F.col("best.less") >= 2 * F.col("n")
    best = stored(best.select("word", "n_near", F.when(large, F.col("best.near")).alias("form"), F.when(large, -F.col("best.less")).alias("form_n")), "forms")
    last = roots(best.where("form is not null"))
    out = words.join(best, "word", "left").join(last, "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form_n")


#: CRC-32 by its table, which is made from the polynomial; edit distance over one ASCII character for each letter.
SPELLING_SQL = r"""
WITH RECURSIVE
tab AS (SELECT list(c ORDER BY i) AS t FROM (SELECT i, list_reduce([i::UBIGINT, 0, 0, 0, 0, 0, 0, 0, 0]::UBIGINT[], lambda c, z: xor(c >> 1, 3988292384::UBIGINT * (c & 1::UBIGINT))) AS c FROM range(256) r(i)) q),
r AS (SELECT coalesce(doc_id::VARCHAR, '') AS k, translate(unnest(regexp_extract_all(text, '[A-Za-z\x{00C0}-\x{00FF}]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents),
g AS (SELECT k, run, count(*) AS c, hex(k || ':' || run) AS b FROM r GROUP BY k, run),
h AS (SELECT run, c, xor(list_reduce(list_prepend(4294967295::UBIGINT, list_transform(range(len(b) // 2), lambda i: ('0x' || substr(b, (2 * i + 1)::INT, 2))::UBIGINT)),
        lambda s, z: xor(s >> 8, t[(xor(s & 255::UBIGINT, z) + 1)::INT])), 4294967295::UBIGINT) AS crc FROM g, tab),
w AS (SELECT CASE WHEN crc % 97 = 0 THEN substr(run, 1, (crc % len(run))::INT) || substr(run, (crc % len(run))::INT + 2) ELSE run END AS word, sum(c)::BIGINT AS n FROM h GROUP BY 1),
v AS MATERIALIZED (SELECT word, n, len(word) AS l, translate(word, 'àáâãäåæçèéêëìíîïðñòóôõö÷øùúûüýþÿÀÁÂÃÄÅÆÇÈÉÊËÌÍÎÏÐÑÒÓÔÕÖ×ØÙÚÛÜÝÞß', '0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ!"#$%&()*+,-./:;<=>?@[]^_`{|') AS a FROM w WHERE len(word) >= 5 AND n >= 3),
p AS (SELECT x.word AS x, x.n AS xn, y.word AS y, y.n AS yn FROM v x JOIN v y ON y.l = x.l AND x.word < y.word AND (left(x.a, x.l // 2) = left(y.a, x.l // 2) OR substr(x.a, x.l // 2 + 1) = substr(y.a, x.l // 2 + 1)) WHERE levenshtein(x.a, y.a) = 1
      UNION ALL SELECT x.word, x.n, y.word, y.n FROM v x JOIN v y ON y.l = x.l + 1 AND (left(x.a, x.l // 2) = left(y.a, x.l // 2) OR right(x.a, x.l - x.l // 2) = right(y.a, x.l - x.l // 2)) WHERE levenshtein(x.a, y.a) = 1),
e AS (SELECT x AS word, xn AS n, y AS near, yn AS near_n FROM p UNION ALL SELECT y, yn, x, xn FROM p),
f AS MATERIALIZED (SELECT word, n_near, CASE WHEN near_n >= 2 * n THEN near END AS form, CASE WHEN near_n >= 2 * n THEN near_n END AS form_n FROM (
      SELECT *, count(*) OVER (PARTITION BY word) AS n_near, row_number() OVER (PARTITION BY word ORDER BY near_n DESC, near) AS o FROM e) q WHERE o = 1),
walk AS (SELECT word, form AS goal FROM f WHERE form IS NOT NULL UNION ALL SELECT walk.word, f.form FROM walk JOIN f ON f.word = walk.goal WHERE f.form IS NOT NULL),
ends AS (SELECT word, goal FROM walk ANTI JOIN (SELECT word FROM f WHERE form IS NOT NULL) s ON s.word = walk.goal)
SELECT v.word, f.form, coalesce(ends.goal, v.word) AS root, v.n, coalesce(f.n_near, 0)::BIGINT AS n_near, f.form_n
FROM v LEFT JOIN f ON f.word = v.word LEFT JOIN ends ON ends.word = v.word
"""
