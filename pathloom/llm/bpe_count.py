"""Token counts of byte-level BPE by heap-and-linked-list merging, without token ids.

A pre-token starts as a linked list of byte symbols. A heap holds the adjacent pairs that can merge,
by merge rank and place; the lowest is popped, merged if both ends still stand as they did, and the
pairs with its new neighbours are pushed. The count is the initial symbols minus the merges.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathloom.llm.common import renamed

from pathloom.llm.units import Memory, any_units, units

#: The pre-token pattern of byte-level BPE (fixed value of the tokenizer).
PRE_TOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
LIMIT = 1024


def byte_letters() -> list[str]:
    """The letter by which such vocabularies write each byte: printable bytes as themselves, others from U+0100 on."""
    shown = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out, spare = [""] * 256, 0x100
    for b in range(256):
        if b in shown:
            out[b] = chr(b)
        else:
            out[b], spare = chr(spare), spare + 1
    return out


def check_kind(spec: dict) -> None:
    """Refuses a tokenizer file that does more than byte-level BPE without a space put in front."""
    model, before = spec["model"], spec.get("pre_tokenizer") or {}
    odd = [k for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix") if model.get(k)] + [k for k in ("byte_fallback", "ignore_merges") if model.get(k)]
    if model.get("type", "BPE") != "BPE" or odd or spec.get("normalizer") or spec.get("truncation") or spec.get("padding"):
        raise ValueError(f"not a plain byte-level BPE file: {odd or 'its model, normalizer, truncation or padding'}")
    if before.get("type") != "ByteLevel" or before.get("add_prefix_space") or before.get("use_regex") is False:
        raise ValueError("its pre-tokenizer isn't the plain byte-level one")
    if any(t.get(k) for t in spec.get("added_tokens", []) for k in ("single_word", "lstrip", "rstrip")):
        raise ValueError("its added tokens take white space or whole words only")


class Counter:
    """Counts tokens by the merge list of a tokenizer file (path is of a local file on every node)."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        check_kind(spec)
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
        letters = byte_letters()
        # symbols are small numbers: a merge of symbols a and b has the key a << 32 | b
        number = {c: i for i, c in enumerate(letters)}
        self.merges: dict[int, tuple[int, int]] = {}
        for rank, (a, b) in enumerate(pairs):
            made = number.setdefault(a + b, len(number))
            self.merges[number[a] << 32 | number[b]] = (rank, made)
        self.special = [t["content"] for t in spec.get("added_tokens", [])]
        self.cut = regex.compile("|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True))) if self.special else None
        self.pattern = regex.compile(PRE_TOKEN)
        self.after_space = Memory(lambda u: self.unit(u if u[:1] == "\n" else " " + u))
        self.whole = Memory(self.unit)
        self.pieces = Memory(lambda p: self.merged(p.encode()))

    def merged(self, data: bytes) -> int:
        """Symbols left of one pre-token when no pair of neighbours can merge any more."""
        n = len(data)
        if n < 2:
            return n
        merges = self.merges
        sym = list(data)
        heap = []
        for i in range(n - 1):
            m = merges.get(sym[i] << 32 | sym[i + 1])
            if m:
                heap.append((m[0], i, m[1], sym[i], sym[i + 1]))
        if not heap:
            return n
        heapify(heap)
        after, before, left = list(range(1, n + 1)), list(range(-1, n - 1)), n
        while heap:
            _, i, made, a, b = heappop(heap)
            j = after[i]
            if sym[i] != a or j >= n or sym[j] != b:
                continue
            sym[i], sym[j], left = made, -1, left - 1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                m = merges.get(made << 32 | sym[k])
                if m:
                    heappush(heap, (m[0], i, m[1], made, sym[k]))
            h = before[i]
            if h >= 0:
                m = merges.get(sym[h] << 32 | made)
                if m:
                    heappush(heap, (m[0], h, m[1], sym[h], made))
        return left

    def unit(self, unit: str) -> int:
        got = self.pattern.findall(unit)
        return self.merged(got[0].encode()) if len(got) == 1 else sum(map(self.pieces.__getitem__, got))

    def plain(self, text: str) -> int:
        parts = units(text)
        if parts:
            return self.whole[parts[0]] + sum(map(self.after_space.__getitem__, parts[1:]))
        return sum(map(self.whole.__getitem__, any_units(text)))

    def count(self, text: str | None) -> int:
        """Tokens of a text; a special string in it is one token, as the library's default has it."""
        if not text:
            return 0
        if self.cut is None or not any(s in text for s in self.special):
            return self.plain(text)
        parts = self.cut.split(text)
        return sum(self.plain(p) for p in parts if p) + len(parts) - 1


def token_counts(docs: DataFrame, tokenizer: str, text: str = "text", limit: int = LIMIT) -> DataFrame:
    """The input's columns but for the text, and n_bytes (UTF-8), n_tokens and over_limit.

    Null and empty texts have 0 of both; repeated rows get the same numbers each; an empty table gives no rows. Rows are
    handled one by one in Arrow batches, each row of any length by itself, so that nothing is shuffled, order
    doesn't matter, and a lost executor costs its tasks only. Input columns that clash with the added names are replaced.
    A file that isn't plain byte-level BPE is refused.
    """
    rows, keep, at = renamed(docs, (text, "n_bytes", "n_tokens", "over_limit"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(tokenizer)
        for b in batches:
            texts = b.column(b.schema.get_field_index("_text"))
            counts = pa.array([counter.count(x.as_py()) for x in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(i) for i, f in enumerate(b.schema) if f.name != "_text"] + [counts], names=[f.name for f in b.schema if f.name != "_text"] + ["n_tokens"])

    rows = rows.select(*keep, F.coalesce(F.octet_length(at[text]), F.lit(0)).cast("long").alias("n_bytes"), F.col(at[text]).alias("_text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != "_text") + ", n_tokens long"
    return rows.mapInArrow(run, schema).withColumn("over_limit", F.col("n_tokens") > limit).toDF(*keep.values(), "n_bytes", "n_tokens", "over_limit")
