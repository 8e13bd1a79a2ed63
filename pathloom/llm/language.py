"""Language identification by rank-order profiles.

A language's profile is the list of the most frequent character n-grams of its training texts. A
document's own list is compared to each profile by out-of-place distance: for each of its n-grams the
difference of the two ranks, or the profile's length where the profile lacks it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from pathloom.llm.common import renamed, spread

#: N-grams in a profile and in a document's list; lengths of n-grams.
PROFILE, ORDERS = 400, (1, 2, 3)
#: Training documents per language from which profiles are counted (expected number of a hash sample).
SAMPLE_DOCS = 2000
UNKNOWN = "und"
_LETTERS: list[np.ndarray] = []


def letters() -> np.ndarray:
    """For each code point whether it is a letter."""
    if not _LETTERS:
        _LETTERS.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000))
    return _LETTERS[0]


def ngrams(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Codes of the n-grams within the words of a whole text, lower-cased and padded by a space, and their counts."""
    code = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
    real = letters()[np.minimum(code, 0x10FFFF)]
    if not real.any():
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    code = np.concatenate(([32], np.where(real, code, 32), [32]))
    code = code[np.concatenate(([True], (code[1:] != 32) | (code[:-1] != 32)))]
    space = code == 32
    found = []
    if 1 in ORDERS:
        found.append(code[~space])
    if 2 in ORDERS:
        found.append(code[:-1] << 21 | code[1:])
    if 3 in ORDERS and len(code) > 2:
        found.append((code[:-2] << 42 | code[1:-1] << 21 | code[2:])[~space[1:-1]])
    return np.unique(np.concatenate(found), return_counts=True)


def top(codes: np.ndarray, counts: np.ndarray, n: int) -> np.ndarray:
    """The most frequent codes, most frequent first, ties by code."""
    return codes[np.lexsort((codes, -counts))[:n]]


class Profiles:
    """Profiles by language; each is kept sorted by code with the ranks beside."""

    def __init__(self, by_language: dict[str, list[int]], length: int = PROFILE):
        self.length = length
        self.names = sorted(by_language)
        self.sorted = []
        for name in self.names:
            codes = np.array(by_language[name], np.int64)
            order = np.argsort(codes)
            self.sorted.append((codes[order], order))

    def predict(self, text: str | None) -> tuple[str, float]:
        """Language and score: 1 less the share of the largest possible distance. Ties go to the smaller name."""
        codes, counts = ngrams(text)
        if not len(codes) or not self.names:
            return UNKNOWN, 0.0
        own = top(codes, counts, self.length)
        rank = np.arange(len(own))
        best, least = UNKNOWN, None
        for name, (known, places) in zip(self.names, self.sorted, strict=True):
            at = np.minimum(np.searchsorted(known, own), len(known) - 1)
            away = int(np.where(known[at] == own, np.abs(places[at] - rank), self.length).sum())
            if least is None or away < least:
                best, least = name, away
        return best, 1.0 - least / (self.length * len(own))


def remainder(key: str) -> Column:
    """crc32 of the key as text, mod 5; null for a null key."""
    return F.crc32(F.col(key).cast("string")) % 5


def learn(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", sample_docs: int = SAMPLE_DOCS, length: int = PROFILE) -> Profiles:
    """Profiles of the languages of the training documents (remainder not 0, language not null).

    Counts come from whole texts of a hash sample of about ``sample_docs`` documents per language. The
    driver receives one count per language and ``length`` n-grams per language; labels are few. From an empty table, or one
    without labels, nothing is learned.
    """
    train = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull() & (remainder(key) != 0)).select(F.col(key).alias("_id"), F.col(lang).cast("string").alias("_lang"), F.col(text).alias("_text"))
    sizes = {r["_lang"]: r["n"] for r in train.groupBy("_lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not sizes:
        return Profiles({}, length)
    rate = F.coalesce(*[F.when(F.col("_lang") == n, F.lit(min(1.0, sample_docs / c))) for n, c in sizes.items()])
    picked = train.where(spread(F.col("_id"), F.lit("language")) < rate)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found: dict[str, list] = {}
            for name, x in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                found.setdefault(name, []).append(ngrams(x.as_py()))
            for name, parts in found.items():
                codes, at = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
                n = np.bincount(at, weights=np.concatenate([p[1] for p in parts]), minlength=len(codes)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(codes), pa.string()), pa.array(codes), pa.array(n)], names=["_lang", "_code", "_n"])

    grams = picked.select("_lang", "_text").mapInArrow(count, "_lang string, _code long, _n long").groupBy("_lang", "_code").agg(F.sum("_n").alias("_n"))
    best = Window.partitionBy("_lang").orderBy(F.desc("_n"), "_code")
    rows = grams.withColumn("_rank", F.row_number().over(best)).where(F.col("_rank") <= length).orderBy("_lang", "_rank").collect()
    out: dict[str, list[int]] = {}
    for r in rows:
        out.setdefault(r["_lang"], []).append(r["_code"])
    return Profiles(out, length)


def identify(docs: DataFrame, profiles: Profiles, text: str = "text") -> DataFrame:
    """The input's columns but for the text, and lang_pred and score, from the text alone.

    Null texts and texts without a letter are ``und`` with score 0, as are all where no language was learned. Texts of any
    length are judged whole, repeated rows each alike; an empty table gives no rows. Rows are judged one by one in Arrow
    batches; nothing is shuffled. Input columns with the added names are replaced, others, of any name, stay.
    """
    rows, keep, at = renamed(docs, (text, "lang_pred", "score"))
    rows = rows.select(*keep, F.col(at[text]).alias("_text"))
    schema = T.StructType([*rows.select(*keep).schema, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [profiles.predict(x.as_py()) for x in b.column(len(keep))]
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())], names=[*keep, "lang_pred", "score"])

    return rows.mapInArrow(run, schema).toDF(*keep.values(), "lang_pred", "score")
