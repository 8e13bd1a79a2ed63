"""Packing documents into sequences by patterns of few lengths, fitted by non-negative least squares.

Only a histogram of lengths reaches the driver: one number for each length up to the sequence size.
Patterns of one to three lengths that fill a sequence are enumerated on coarse length classes; repeat
counts are fitted to the histogram by non-negative least squares and rounded down; what is left is
packed by best fit over the exact histogram. The plan, a few thousand rows whatever the corpus, is
joined to the documents' ranks within their lengths.
"""

from __future__ import annotations

import base64
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pathloom.llm.common import folded, running_sums, spread, unfolded

SEQUENCE = 2048
#: Tokens in a length class of the fit.
CLASS = 8
#: Texts on which a quicker library has to give the ids of the tokenizer's own before it is used.
SELF_CHECK = ("", " a", "it's we'll I'd 'Ve", "the  cat\n\nsat\t\t on \r\n", "caf\u00e9 na\u00efve 12345 $$$*** \u4e2d\u6587", "\u00a0x\u3000y\u0085z \x1c", "\U0001f600 \u0301e\u0301", "aaaaaaaaaaaaaaaaaaaaaaaaaaaa", " \n \t ", "\u0e33\u0967\u216b_\u2028end")

#: Code points up to which no run of white space exhausts the quicker library's stack; longer texts go another way, which reports it.
SHORT = 100_000


class Tokens:
    """Token ids of whole texts as little-endian unsigned 32-bit numbers, from a byte-level BPE file."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.library = Tokenizer.from_file(path)
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.fast = self._fast(path, self.library)

    @staticmethod
    def _fast(path: str, library):
        """The same vocabulary and merges in a quicker library, if its ranks are the ids of the file and both give the same ids on odd texts."""
        import json

        import tiktoken

        from pathloom.llm.bpe_count import PRE_TOKEN, byte_letters

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        back = {c: b for b, c in enumerate(byte_letters())}
        special = {t["content"] for t in spec.get("added_tokens", [])}
        ranks = {bytes(back[c] for c in t): i for t, i in spec["model"]["vocab"].items() if t not in special}
        merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        merged = [spec["model"]["vocab"][a + b] for a, b in merges]
        if any(y <= x for x, y in zip(merged, merged[1:], strict=False)) or spec["pre_tokenizer"].get("type") != "ByteLevel":
            return None
        fast = tiktoken.Encoding("own", pat_str=PRE_TOKEN, mergeable_ranks=ranks, special_tokens={})
        return fast if all(fast.encode_ordinary(x) == library.encode(x, add_special_tokens=False).ids for x in SELF_CHECK) else None

    def ids(self, text: str | None) -> bytes:
        if not text:
            return b""
        if self.fast and not any(s in text for s in self.special):
            if len(text) <= SHORT:
                return array("I", self.fast.encode_ordinary(text)).tobytes()
            try:
                return self.fast.encode_to_numpy(text, disallowed_special=()).astype("<u4", copy=False).tobytes()
            except ValueError:
                pass  # a run of white space that is too long for its regular expression
        return array("I", self.library.encode(text, add_special_tokens=False).ids).tobytes()


def pieces(docs: DataFrame, tokenizer: str, sequence: int = SEQUENCE, keep: list[str] | None = None, with_ids: bool = False, text: str = "text") -> DataFrame:
    """One row per piece: the ``keep`` columns, piece, start, length, ids_crc32 (and ids, base64, if asked).

    A document is its tokens and then id 0. One of over ``sequence`` tokens is cut into pieces of that
    many, the first being what is left over. Null and empty texts give one piece of length 1.
    """
    made = ("piece", "start", "length", "ids_crc32", "ids")
    keep = ["doc_id"] if keep is None else [c for c in keep if c not in made]
    held = [f"c{i}" for i in range(len(keep))]
    rows = docs.select(*[F.col(f"`{c}`").alias(h) for c, h in zip(keep, held, strict=True)], F.col(f"`{text}`").alias("_text"))
    names = [*held, "piece", "start", "length", "ids_crc32", *["ids"] * with_ids]
    schema = T.StructType([*rows.select(*held).schema, T.StructField("piece", T.IntegerType()), *[T.StructField(c, T.LongType()) for c in ("start", "length", "ids_crc32")], *[T.StructField("ids", T.StringType())] * with_ids])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = Tokens(tokenizer)
        for b in batches:
            row, piece, start, length, crc, ids = [], [], [], [], [], []
            for i, x in enumerate(b.column(len(keep))):
                data = tokens.ids(x.as_py()) + b"\0\0\0\0"
                n = len(data) // 4
                at, k = 0, 0
                while at < n:
                    size = (n % sequence or sequence) if not at else sequence
                    row.append(i), piece.append(k), start.append(at), length.append(size)
                    part = data[at * 4 : (at + size) * 4]
                    crc.append(zlib.crc32(part))
                    if with_ids:
                        ids.append(base64.b64encode(part).decode())
                    at, k = at + size, k + 1
            taken = b.select(list(range(len(keep)))).take(pa.array(row, pa.int64()))
            more = [pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())] + ([pa.array(ids, pa.string())] if with_ids else [])
            yield pa.RecordBatch.from_arrays([*taken.columns, *more], names=names)

    return rows.mapInArrow(run, schema).toDF(*keep, *names[len(keep) :])


def nnls(a: np.ndarray, b: np.ndarray, steps: int = 2000) -> np.ndarray:
    """Non-negative least squares by active sets: the x >= 0 that makes ``a @ x`` nearest to ``b``."""
    n = a.shape[1]
    x, active = np.zeros(n), np.zeros(n, bool)
    w = a.T @ b
    floor = 1e-9 * max(1.0, float(np.abs(w).max(initial=0)))
    for _ in range(steps):
        if active.all() or w[~active].max(initial=-1) <= floor:
            break
        active[np.argmax(np.where(active, -np.inf, w))] = True
        while True:
            s = np.zeros(n)
            s[active] = np.linalg.lstsq(a[:, active], b, rcond=None)[0]
            if s[active].min(initial=1) > 0:
                break
            low = active & (s <= 0)
            step = np.min(x[low] / np.maximum(x[low] - s[low], 1e-300))
            x = x + step * (s - x)
            active &= x > 1e-12
            x[~active] = 0
        x = s
        w = a.T @ (b - a @ x)
    return x


def plan(histogram: dict[int, int], sequence: int = SEQUENCE, width: int = CLASS) -> list[tuple[int, int, int, int, int, int]]:
    """Rows (length, rank_from, rank_to, per_sequence, first_sequence, offset).

    Of the documents of ``length``, those with ranks from rank_from up to before rank_to go, per_sequence
    at a time, to the sequences from first_sequence on, the first of each at ``offset``. The number of
    rows depends on the number of different lengths only.
    """
    left = {n: c for n, c in histogram.items() if c > 0}
    used: dict[int, int] = dict.fromkeys(left, 0)
    rows: list[tuple[int, int, int, int, int, int]] = []
    runs: list[list[int]] = []  # [space, sequences, first sequence]: equal sequences that are still open
    made = 0

    def put(n: int, per: int, sequences: int, first: int, offset: int) -> None:
        rows.append((n, used[n], used[n] + per * sequences, per, first, offset))
        used[n] += per * sequences
        left[n] -= per * sequences

    # patterns of up to three classes that fill a sequence, fitted to the numbers of documents in the classes
    classes = -(-sequence // width)
    members = [[n for n in range(k * width, (k - 1) * width, -1) if left.get(n)] for k in range(classes + 1)]
    counts = np.array([float(sum(left[n] for n in m)) for m in members])
    if counts.sum() and sequence % width == 0:
        there = counts > 0
        found = [(k,) for k in (classes,) if there[k]]
        found += [(a, classes - a) for a in range(1, classes // 2 + 1) if there[a] and there[classes - a]]
        found += [(a, b, c) for a in range(1, classes // 3 + 1) if there[a] for b in range(a, (classes - a) // 2 + 1) if there[b] and there[c := classes - a - b]]
        if found:
            matrix = np.zeros((classes + 1, len(found)))
            for j, pattern in enumerate(found):
                for k in pattern:
                    matrix[k, j] += 1
            scale = 1 / np.sqrt(np.maximum(counts, 1))
            for j, times in enumerate(np.floor(nnls(matrix * scale[:, None], counts * scale) + 1e-6).astype(int)):
                pattern = found[j]
                times = min([int(times), *(sum(left[n] for n in members[k]) // pattern.count(k) for k in set(pattern))])
                while times > 0:
                    # the next exact lengths of each class, for as many sequences as all of them reach
                    lengths = []
                    for k in pattern:
                        lengths.append(next((n for n in members[k] if left[n] - lengths.count(n) > 0)))
                    now = min([times, *(left[n] // lengths.count(n) for n in set(lengths))])
                    offset = 0
                    for n in lengths:
                        put(n, 1, now, made, offset)
                        offset += n
                    runs.append([sequence - offset, now, made])
                    made, times = made + now, times - now

    # the rest by best fit, longest first, over runs of equal open sequences
    spaces: dict[int, list[tuple[int, int]]] = {}
    for space, number, first in runs:
        spaces.setdefault(space, []).append((number, first))
    for n in sorted(left, reverse=True):
        while left[n]:
            space = next((s for s in range(n, sequence) if spaces.get(s)), None)
            if space is None:
                number, first = left[n] // (sequence // n) or 1, made
                per = min(sequence // n, left[n])
                made, offset, space = made + number, 0, sequence
            else:
                number, first = spaces[space].pop()
                per = min(space // n, left[n])
                offset = sequence - space
                if number > left[n] // per:
                    now = left[n] // per
                    spaces[space].append((number - now, first + now))
                    number = now
            put(n, per, number, first, offset)
            if space > per * n:
                spaces.setdefault(space - per * n, []).append((number, first))
    return rows


def pack(parts: DataFrame, sequence: int = SEQUENCE) -> DataFrame:
    """Adds sequence_id and offset to rows that have length, piece and ids_crc32; nothing is dropped.

    Pieces of full length take a sequence each. ``parts`` is read once and stored, equal rows folded. Rows of
    one length are ranked by a hash of the whole row in buckets (``running_sums``), so that a length that a third of all
    rows share is no hot spot, nor are null or repeated keys. Reruns over the same rows give the same sequences. The
    empty table gives no rows; input columns named sequence_id or offset are replaced.
    """
    spark = parts.sparkSession
    columns = [c for c in parts.columns if c not in ("sequence_id", "offset")]
    names = {c: f"_c{i}" for i, c in enumerate(columns)}
    length = names["length"]
    rows = folded(parts.select(*[F.col(f"`{c}`").alias(n) for c, n in names.items()]), "pieces")
    counts = {r[length]: r["n"] for r in rows.groupBy(length).agg(F.sum("_copies").alias("n")).collect()}  # at most `sequence` rows
    schema = "length long, rank_from long, rank_to long, per long, first long, at long"
    table = F.broadcast(spark.createDataFrame(plan(counts, sequence), schema))  # a few rows for each length: bounded by `sequence`
    order = [n for c, n in names.items() if "map<" not in rows.schema[n].dataType.simpleString()]
    ranked = unfolded(running_sums(rows.withColumn("_place", spread(*[F.col(n) for n in order], F.lit(7))), [length], "_place", ["_copies"], ties=order))
    p, t = ranked.withColumn("_rank", F.col("before__copies") + F.col("_copy")).alias("p"), table.alias("t")
    r = F.col("p._rank")
    inside = (F.col(f"p.{length}") == F.col("t.length")) & (r >= F.col("t.rank_from")) & (r < F.col("t.rank_to"))
    turn = r - F.col("t.rank_from")
    return p.join(t, inside).select(*[F.col(f"p.{n}").alias(c) for c, n in names.items()], (F.col("t.first") + F.floor(turn / F.col("t.per"))).cast("long").alias("sequence_id"), (F.col("t.at") + turn % F.col("t.per") * F.col(f"p.{length}")).cast("long").alias("offset"))


def pack_documents(docs: DataFrame, tokenizer: str, sequence: int = SEQUENCE, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The ``keep`` columns (doc_id), piece, start, length, ids_crc32, sequence_id and offset of every piece of every document.

    Texts are tokenized once; the pieces' numbers (not their ids) are stored in the shared folder. Null and empty
    texts are one piece of one token. Other columns are left out; repeated rows and equal or null keys are packed as
    often as they occur; a text of any length is cut into pieces by itself. An empty table gives no rows.
    """
    return pack(pieces(docs, tokenizer, sequence, keep, text=text), sequence)
