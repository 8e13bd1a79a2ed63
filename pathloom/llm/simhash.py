"""SimHash near-duplicates by anchor-point covering, and near-duplicates by exact similarity.

A 64-bit fingerprint is seen as two halves. Fingerprints that differ in at most 3 bits differ in at
most one bit in one half. On 31 bits of a half, the perfect Hamming code of radius 1 is the set of
anchors: every word is within one bit of exactly one. A fingerprint's home is that anchor; it is
replicated to every anchor within covering radius plus threshold, 1 + 1 bits, of its half: its home and
at most 15 others. Homes and visitors of an anchor are compared over all 64 bits, so no link is lost.

Three bits are far less than a Jaccard similarity of 0.8 gives (about 10 bits), and no covering of 64 bits
stays selective there. Links by similarity therefore take fingerprints within 3 bits as a first step only:
further candidates are texts that agree in a band of min-wise hashes of their shingles. All candidates are verified
by exact similarity.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pathloom.llm.common import dropped, renamed, shuffled, small_side, stored

THRESHOLD = 3
SHINGLE = 3
#: Homes and visitors of an anchor that meet in one comparison; larger sides are cut into blocks of this size.
BLOCK = 1024


#: Bands of min-wise hashes and hashes in a band: of pairs at a similarity of 0.8 one in 14,000 agrees in none; at 0.3, one in 17 agrees.
BANDS, BAND_ROWS = 24, 5
_FACTORS = np.random.default_rng(17).integers(1, 2**63 - 1, BANDS * BAND_ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """Hashes of a text's shingles, one for each place; of the whole text if it is shorter; none without words."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return np.zeros(0, np.uint64)
    line = b" ".join(words)
    n = max(1, len(words) - shingle + 1)
    if n == 1:
        return np.array([xxhash.xxh64_intdigest(line, 42)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    digest = xxhash.xxh64_intdigest
    return np.fromiter([digest(line[a:b], 42) for a, b in zip(starts[:n].tolist(), ends[shingle - 1 :].tolist(), strict=True)], np.uint64, n)


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """SimHash of one whole text, unsigned; 0 without words."""
    return _majority(shingles(text, shingle))


def _majority(hashes: np.ndarray) -> int:
    n = len(hashes)
    if not n:
        return 0
    # each bit as a byte, eight bytes added at once in 64-bit lanes; 255 rows can't overflow a byte
    lanes = np.unpackbits(hashes.astype("<u8").view(np.uint8), bitorder="little").view("<u8").reshape(n, 8)
    sums = np.add.reduceat(lanes, np.arange(0, n, 255), axis=0)
    ones = sums.view(np.uint8).reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """The input's columns but for the text, and _fp (the fingerprint as a signed long); one of the input named so is replaced."""
    rows, keep, at = renamed(docs, (text, "_fp"))
    rows = rows.select(*keep, F.col(at[text]).alias("_text"))
    schema = T.StructType([*rows.select(*keep).schema, T.StructField("_fp", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = np.array([fingerprint(x.as_py(), shingle) for x in b.column(len(keep))], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], pa.array(found)], names=[*keep, "_fp"])

    return rows.mapInArrow(run, schema).toDF(*keep.values(), "_fp")


def _half(fp: Column, side: int) -> Column:
    """31 bits of a half."""
    return (F.shiftrightunsigned(fp, 32 * side)).bitwiseAND(F.lit(0x7FFFFFFF))


def _syndrome(word: Column) -> Column:
    """0 for a code word, else the number (1 to 31) of the bit to flip to reach the code word."""
    out = F.lit(0)
    for r in range(5):
        mask = sum(1 << (p - 1) for p in range(1, 32) if p >> r & 1)
        out = out + F.bit_count(word.bitwiseAND(F.lit(mask))) % 2 * (1 << r)
    return out.cast("int")


def homes(distinct: DataFrame) -> DataFrame:
    """(_side, _anchor, _fp): each fingerprint at the nearest anchor of each half."""
    sides = F.explode(F.array(*[F.struct(F.lit(s).alias("side"), _half(F.col("_fp"), s).alias("word")) for s in (0, 1)]))
    rows = distinct.select("_fp", sides.alias("_x")).select("_fp", F.col("_x.side").alias("_side"), F.col("_x.word").alias("_word")).withColumn("_s", _syndrome(F.col("_word")))
    return rows.select("_side", F.expr("case when _s = 0 then _word else _word ^ shiftleft(1L, _s - 1) end").alias("_anchor"), "_fp")


def visitors(distinct: DataFrame) -> DataFrame:
    """(_side, _anchor, _fp): each fingerprint at every anchor within radius plus threshold of each half."""
    sides = F.explode(F.array(*[F.struct(F.lit(s).alias("side"), _half(F.col("_fp"), s).alias("word")) for s in (0, 1)]))
    rows = distinct.select("_fp", sides.alias("_x")).select("_fp", F.col("_x.side").alias("_side"), F.col("_x.word").alias("_word")).withColumn("_s", _syndrome(F.col("_word")))
    near = "case when _s = 0 then array(_word) else concat(array(_word ^ shiftleft(1L, _s - 1)), transform(filter(sequence(1, 31), a -> a < (a ^ _s)), a -> _word ^ shiftleft(1L, a - 1) ^ shiftleft(1L, (a ^ _s) - 1))) end"
    return rows.select("_side", F.explode(F.expr(near)).alias("_anchor"), "_fp")


def _stars(home: np.ndarray, visit: np.ndarray, threshold: int) -> list[tuple[int, int]]:
    """Links within the threshold between two sides, thinned to a spanning set of their components."""
    both = np.unique(np.concatenate([home, visit]))
    parent = list(range(len(both)))

    def top(i: int) -> int:
        while parent[i] != i:
            parent[i] = i = parent[parent[i]]
        return i

    at_home, at_visit, links = np.searchsorted(both, home), np.searchsorted(both, visit), []
    view = visit.view(np.uint64)
    for i, h in zip(at_home.tolist(), home.view(np.uint64), strict=True):
        for j in at_visit[np.bitwise_count(view ^ h) <= threshold].tolist():
            a, b = top(i), top(j)
            if a != b:
                parent[max(a, b)] = min(a, b)
                links.append((int(both[i]), int(both[j])))
    return links


def links(distinct: DataFrame, threshold: int = THRESHOLD, block: int = BLOCK) -> DataFrame:
    """(_a, _b): links that join the same fingerprints as all pairs within the threshold do.

    ``distinct`` holds each fingerprint once. Anchors with one fingerprint only are dropped after a
    count that combines on the map side; a crowded anchor's sides are cut by hash into blocks, and each
    pair of blocks is compared in its own task. A comparison emits a spanning set of its links, so the
    output grows with the fingerprints, not with the square of a cluster.
    """
    if not 0 <= threshold <= 3:
        raise ValueError("the covering is made for thresholds of at most 3")
    h, v = homes(distinct), visitors(distinct)
    both = h.withColumn("_home", F.lit(True)).unionByName(v.withColumn("_home", F.lit(False)))
    counts = both.groupBy("_side", "_anchor").agg(F.count_if("_home").alias("_nh"), F.count_if(~F.col("_home")).alias("_nv")).where((F.col("_nh") >= 1) & (F.col("_nv") >= 2))
    b, c = both.alias("b"), shuffled(counts).alias("c")
    at = b.join(c, (F.col("b._anchor") == F.col("c._anchor")) & (F.col("b._side") == F.col("c._side"))).select("b._side", "b._anchor", "b._home", "b._fp", F.ceil(F.col("_nh") / block).cast("int").alias("_kh"), F.ceil(F.col("_nv") / block).cast("int").alias("_kv"))
    mine = F.pmod(F.xxhash64("_fp"), F.when(F.col("_home"), F.col("_kh")).otherwise(F.col("_kv"))).cast("int")
    others = F.explode(F.sequence(F.lit(0), F.when(F.col("_home"), F.col("_kv")).otherwise(F.col("_kh")) - 1))
    dealt = at.select("_side", "_anchor", "_home", "_fp", mine.alias("_mine"), others.alias("_other"))
    dealt = dealt.select("_side", "_anchor", F.when(F.col("_home"), F.col("_mine")).otherwise(F.col("_other")).alias("_bh"), F.when(F.col("_home"), F.col("_other")).otherwise(F.col("_mine")).alias("_bv"), "_home", "_fp")
    cells = dealt.repartition("_side", "_anchor", "_bh", "_bv").sortWithinPartitions("_side", "_anchor", "_bh", "_bv")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # rows of a cell stand together; the last cell of a batch may go on in the next
        rest: list[np.ndarray] | None = None
        for pdf in [*_and_end(batches)]:
            columns = None if pdf is None else [pdf[x].to_numpy() for x in ("_side", "_anchor", "_bh", "_bv", "_home", "_fp")]
            if rest is not None:
                columns = rest if columns is None else [np.concatenate(x) for x in zip(rest, columns, strict=True)]
            if columns is None or not len(columns[0]):
                continue
            new = np.zeros(len(columns[0]), bool)
            for x in columns[:4]:
                new[1:] |= x[1:] != x[:-1]
            bounds = [0, *np.flatnonzero(new).tolist(), len(new)]
            if pdf is not None:
                rest = [x[bounds[-2] :] for x in columns]
                bounds.pop()
            out: list[tuple[int, int]] = []
            for i, j in zip(bounds, bounds[1:], strict=False):
                if j - i > 1:
                    fp, home = columns[5][i:j], columns[4][i:j].astype(bool)
                    if home.any() and not home.all():
                        out += _stars(fp[home], fp[~home], threshold)
            if out:
                yield pd.DataFrame(out, columns=["_a", "_b"])

    return cells.mapInPandas(run, "_a long, _b long")


def _and_end(batches: Iterator) -> Iterator:
    yield from batches
    yield None


def components(pairs: DataFrame, a: str = "_a", b: str = "_b", rounds: int = 60) -> DataFrame:
    """(_node, _root): for every node of a link the smallest node that it is joined to.

    Large-star and small-star steps in turn, each over written tables; hubs are combined on the map
    side and never gathered in one task.
    """
    edges = stored(pairs.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct(), "edges")
    before = None
    for _ in range(rounds):
        # large-star: every larger neighbour is tied to the node's smallest
        both = edges.select(F.col("u").alias("x"), F.col("v").alias("y")).unionByName(edges.select(F.col("v").alias("x"), F.col("u").alias("y")))
        low = both.groupBy("x").agg(F.min("y").alias("m")).select("x", F.least("x", "m").alias("m"))
        large = both.join(shuffled(low), "x").where("y > x").select(F.col("y").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # small-star: every smaller neighbour, and the node, are tied to the smallest
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        tied = large.join(shuffled(low), "u")
        small = tied.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        after = stored(small, "edges")
        dropped(edges)
        edges = after
        state = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    else:
        raise RuntimeError("components didn't settle")
    return edges.select(F.col("u").alias("_node"), F.col("v").alias("_root")).unionByName(edges.select(F.col("v").alias("_node"), F.col("v").alias("_root")).distinct())


def classes(printed: DataFrame, key: str = "doc_id", threshold: int = THRESHOLD) -> DataFrame:
    """Adds component_id, the smallest key among the rows whose fingerprints can be reached.

    Equal fingerprints are one node, so thousands of copies cost one comparison. Null keys are passed
    over by the smallest key; a class of null keys only has a null id. Rows without words have
    fingerprint 0 and are linked like any others.
    """
    distinct = stored(printed.groupBy("_fp").agg(F.min(key).alias("_least")), "fingerprints")
    roots = components(links(distinct.select("_fp"), threshold))
    d, r = distinct.alias("d"), shuffled(roots).alias("r")
    nodes = d.join(r, F.col("d._fp") == F.col("r._node"), "left").select(F.col("d._fp").alias("_fp"), "_least", F.coalesce("_root", F.col("d._fp")).alias("_root"))
    least = nodes.groupBy("_root").agg(F.min("_least").alias("component_id"))
    named = nodes.join(shuffled(least), "_root").select(F.col("_fp").alias("_node"), "component_id")
    p, n = printed.alias("p"), shuffled(named).alias("n")
    return p.join(n, F.col("p._fp") == F.col("n._node")).select(*[F.col(f"p.{c}") for c in printed.columns if c != "component_id"], "component_id")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", threshold: int = THRESHOLD, shingle: int = SHINGLE) -> DataFrame:
    """The input's columns but for the text, and fingerprint (16 hex digits) and component_id.

    Null and empty texts and those without a word have fingerprint zero and are linked like any other; texts of any length are
    read whole; repeated rows each get their group; an empty table gives no rows. Input columns with the added names are
    replaced, others, of any name, stay. Fingerprints, a few bytes a row, are written to the shared folder once.
    """
    rows, keep, at = renamed(docs, ("fingerprint", "component_id"))
    printed = stored(fingerprints(rows.select(*keep), at[text], shingle), "printed")
    stay = [c for c in keep if c != at[text]]
    out = classes(printed, at[key], threshold).select(*stay, F.lower(F.lpad(F.hex("_fp"), 16, "0")).alias("fingerprint"), "component_id")
    return out.toDF(*[keep[c] for c in stay], "fingerprint", "component_id")


def band_keys(own: np.ndarray) -> np.ndarray:
    """A key for each band of the min-wise hashes of a set of shingle hashes; none for the empty set."""
    if not len(own):
        return np.zeros(0, np.int64)
    low = np.full(len(_FACTORS), np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(own), 1024):
        np.minimum(low, (own[i : i + 1024, None] * _FACTORS[None, :]).min(axis=0), out=low)
    mixed = np.bitwise_xor.reduce((low ^ (low >> np.uint64(29))).reshape(BANDS, BAND_ROWS) * (_FACTORS[:BAND_ROWS] ^ np.uint64(0x9E3779B97F4A7C14)), axis=1)
    return (mixed ^ np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03)).view(np.int64)


def _sketches(docs: DataFrame, text: str, shingle: int) -> DataFrame:
    """The input's columns but for the text, and of its set of shingles: _node (a hash), _fp, _size, _level, _part and _keys.

    _part holds the low halves of the shingles' hashes that end in _level zero bits, 128 to 256 of them by expectation, or all where
    there are fewer (_level 0).
    """
    keep = [c for c in docs.columns if c != text]
    rows = docs.select(*keep, F.col(text).alias("_text"))
    schema = T.StructType([*rows.select(*keep).schema, *T.StructType.fromDDL("_node long, _fp long, _size int, _level int, _part array<int>, _keys array<long>")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for x in b.column(len(keep)):
                hashes = shingles(x.as_py(), shingle)
                own = np.unique(hashes)
                level = max(0, len(own).bit_length() - 8)
                part = np.unique(own[own & np.uint64((1 << level) - 1) == 0].astype(np.uint32)).view(np.int32)
                names = np.array([xxhash.xxh64_intdigest(own.tobytes(), 7), _majority(hashes)], np.uint64).view(np.int64).tolist()
                out.append((*names, len(own), level, part, band_keys(own)))
            columns = [pa.array(x, t) for x, t in zip(zip(*out, strict=True), [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.int32()), pa.list_(pa.int64())], strict=True)]
            if out:
                yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], *columns], names=schema.names)

    return rows.mapInArrow(run, schema)


def _alike(pairs: DataFrame, docs: DataFrame, texts: DataFrame, text: str, shingle: int, similarity: float) -> DataFrame:
    """Those of the pairs (_a, _b of nodes) whose sets of shingles have at least this Jaccard similarity.

    ``texts`` has a text of each node (_node, _own: the hash of the text, two parts).
    """
    asked = pairs.select(F.col("_a").alias("_node")).unionByName(pairs.select(F.col("_b").alias("_node"))).distinct()
    names = stored(texts.join(shuffled(asked), "_node", "left_semi"), "asked")
    d, n = docs.select(F.col(text).alias("_text"), *_own(text)), small_side(names)
    held = d.join(n, ["_k1", "_k2"]).select("_node", "_text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [np.unique(shingles(x.as_py(), shingle)).view(np.int64) for x in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sets, pa.list_(pa.int64()))], names=["_node", "_set"])

    sets = stored(held.mapInArrow(run, "_node long, _set array<long>").dropDuplicates(["_node"]), "sets")
    x, y = sets.select(F.col("_node").alias("_a"), F.col("_set").alias("_x")), sets.select(F.col("_node").alias("_b"), F.col("_set").alias("_y"))
    both = F.size(F.array_intersect("_x", "_y"))
    found = pairs.join(shuffled(x), "_a").join(shuffled(y), "_b").where(both >= F.lit(similarity - 1e-9) * (F.size("_x") + F.size("_y") - both)).select("_a", "_b")
    out = stored(found, "alike")
    dropped(sets)
    return out


def _own(text: str) -> list[Column]:
    """Two hashes that stand for a whole text."""
    body = F.coalesce(F.col(text), F.lit(""))
    return [F.xxhash64(body).alias("_k1"), F.xxhash64(F.lit("second"), body).alias("_k2")]


def similar(docs: DataFrame, key: str = "doc_id", text: str = "text", similarity: float = 0.8, shingle: int = SHINGLE) -> DataFrame:
    """The input's columns but for the text, and component_id, the smallest key that similar texts lead to.

    Two texts are linked if the Jaccard similarity of their sets of shingles is ``similarity`` or more and they are within
    THRESHOLD bits or agree in a band (see BANDS). Texts with equal sets are one node. Fingerprints within
    THRESHOLD bits, and the nodes of each band with the band's centre, are verified first; then all pairs that agree in a
    band, pass the bounds by size and part, and aren't joined yet. Texts without words (null and empty ones) are alike. Null keys are passed over
    by the smallest key; repeated rows are members each; input columns with the names of the method (a leading underscore,
    component_id) are left out; an empty table gives no rows.
    """
    if not 0 < similarity <= 1:
        raise ValueError("the similarity is above 0 and at most 1")
    keep = [c for c in docs.columns if c != "component_id" and (not c.startswith("_") or c in (key, text))]
    docs = docs.select(*keep)
    drawn = stored(_sketches(docs.select(*keep, *_own(text)), text, shingle), "sketches")
    numbers = ["_fp", "_size", "_level", "_part"]
    # numbers other than the fingerprint depend on the set; the fingerprint also on how often a shingle stands
    whole = F.struct("_k1", "_k2", *numbers, "_keys")
    nodes = stored(drawn.groupBy("_node").agg(F.min(whole).alias("_w"), F.min(key).alias("_least")).select("_node", "_w.*", "_least"), "nodes")
    keyed = nodes.select("_node", F.explode("_keys").alias("_s"))
    shared = stored(keyed.groupBy("_s").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1"), "shared")
    keyed = stored(keyed.join(small_side(shared), "_s").select("_s", "_node", "_n"), "keyed")
    dropped(shared)
    # a key's centre is the node that meets most others under its keys: of near copies this is mostly what they were made from
    met = keyed.groupBy("_node").agg(F.sum("_n").alias("_met"))
    centres = keyed.join(shuffled(met), "_node").groupBy("_s").agg(F.max(F.struct("_met", "_node")).alias("_c")).select("_s", F.col("_c._node").alias("_low"))

    def bounded(pairs: DataFrame) -> DataFrame:
        """(_a, _b, _sure): pairs that can reach the similarity by their sizes and parts, and whether the parts are all there is."""
        asked = pairs.select(F.col("_a").alias("_node")).unionByName(pairs.select(F.col("_b").alias("_node"))).distinct()
        held = stored(nodes.select("_node", "_size", "_level", "_part").join(shuffled(asked), "_node", "left_semi"), "held")
        a, b = held.select(*[F.col(c).alias(f"{c}a") for c in held.columns]), held.select(*[F.col(c).alias(f"{c}b") for c in held.columns])
        p = pairs.join(shuffled(a), F.col("_a") == F.col("_nodea")).join(shuffled(b), (F.col("_b") == F.col("_nodeb")) & _near_sizes(similarity) & _may(similarity))
        return p.select("_a", "_b", (F.greatest("_levela", "_levelb") == 0).alias("_sure"))

    def verified(pairs: DataFrame) -> DataFrame:
        rest = _alike(pairs.where("not _sure").select("_a", "_b"), docs, nodes.select("_node", "_k1", "_k2"), text, shingle, similarity)
        return stored(pairs.where("_sure").select("_a", "_b").unionByName(rest), "verified")

    prints = stored(nodes.groupBy("_fp").agg(F.min("_node").alias("_low")), "fingerprints")
    same = nodes.join(shuffled(prints), "_fp").select(F.col("_low").alias("_a"), F.col("_node").alias("_b"))
    p, q = prints.select(F.col("_fp").alias("_fa"), F.col("_low").alias("_a")), prints.select(F.col("_fp").alias("_fb"), F.col("_low").alias("_b"))
    near = links(prints.select("_fp")).select(F.col("_a").alias("_fa"), F.col("_b").alias("_fb")).join(shuffled(p), "_fa").join(shuffled(q), "_fb").select("_a", "_b")
    stars = keyed.join(shuffled(centres), "_s").select(F.col("_low").alias("_a"), F.col("_node").alias("_b"))
    pairs = same.unionByName(near).unionByName(stars).where("_a <> _b").select(F.least("_a", "_b").alias("_a"), F.greatest("_a", "_b").alias("_b")).distinct()
    pairs = stored(bounded(pairs), "pairs")
    joined = verified(pairs)
    roots = stored(components(joined), "roots")

    # bands under which nodes of several classes stand: these are compared by their parts, band by band, in blocks
    k, r = keyed.alias("k"), shuffled(roots).alias("r")
    classed = k.join(r, F.col("k._node") == F.col("r._node"), "left").select("k._s", F.col("k._node").alias("_node"), F.coalesce("r._root", "k._node").alias("_root"))
    open_keys = classed.groupBy("_s").agg(F.min("_root").alias("_l"), F.max("_root").alias("_h"), F.count(F.lit(1)).alias("_n")).where("_l <> _h").select("_s", "_n")
    left = stored(classed.join(shuffled(open_keys), "_s"), "open")
    close = stored(_close(left.join(shuffled(nodes.select("_node", "_size", "_level", "_part")), "_node"), similarity).distinct(), "close")
    rest = stored(close.join(shuffled(pairs.select("_a", "_b")), ["_a", "_b"], "left_anti"), "rest")
    more = verified(rest)
    if not more.isEmpty():
        roots = components(joined.unionByName(more))

    n, r = nodes.alias("n"), shuffled(roots).alias("r")
    rooted = n.join(r, F.col("n._node") == F.col("r._node"), "left").select(F.col("n._node").alias("_node"), "_least", F.coalesce("r._root", "n._node").alias("_root"))
    smallest = rooted.groupBy("_root").agg(F.min("_least").alias("component_id"))
    named = rooted.join(shuffled(smallest), "_root").select(F.col("_node").alias("_n"), "component_id")
    out = stored(drawn.join(shuffled(named), F.col("_node") == F.col("_n")).select(*[c for c in keep if c != text], "component_id"), "similar")
    for table in (drawn, nodes, keyed, prints, pairs, left, close, rest, joined, more):
        dropped(table)
    return out


#: Nodes of a band in a block.
CLOSE_BLOCK = 512


def _close(rows: DataFrame, similarity: float, block: int = CLOSE_BLOCK) -> DataFrame:
    """(_a, _b, _sure): pairs of nodes of a band, of different classes, that can have the similarity by their parts.

    ``rows`` has (_s, _n: the band's nodes, _node, _root, _size, _level, _part). A band's nodes are cut by hash into
    blocks, and each pair of blocks is compared in its own task. Where the parts are the sets themselves, the pairs that
    have the similarity are thinned to a spanning set; others are handed on to be verified.
    """
    many = F.ceil(F.col("_n") / block).cast("int")
    mine = F.pmod(F.xxhash64("_node"), F.col("_many")).cast("int")
    dealt = rows.withColumn("_many", many).withColumn("_mine", mine).withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_many") - 1)))
    place = ["_s", "_i", "_j"]
    dealt = dealt.select("_s", F.least("_mine", "_other").alias("_i"), F.greatest("_mine", "_other").alias("_j"), "_mine", "_node", "_root", "_size", "_level", "_part")
    cells = dealt.repartition(*place).sortWithinPartitions(*place)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        at = None

        def done() -> Iterator[pa.RecordBatch]:
            found = _compare(held, similarity) if len(held) > 1 else []
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*found, strict=True), [pa.int64(), pa.int64(), pa.bool_()], strict=True)], names=["_a", "_b", "_sure"])

        for b in batches:
            numbers = [b.column(i).to_pylist() for i in range(8)]
            ends, flat = b.column(8).offsets.to_numpy(), b.column(8).values.to_numpy(zero_copy_only=False)
            for i, (s, x, y, *row) in enumerate(zip(*numbers, strict=True)):
                if at != (s, x, y):
                    yield from done()
                    at, held = (s, x, y), []
                held.append((*row, flat[ends[i] : ends[i + 1]]))
        yield from done()

    return cells.mapInArrow(run, "_a long, _b long, _sure boolean")


def _compare(rows: list[tuple], similarity: float) -> list[tuple[int, int, bool]]:
    """The pairs of one cell; rows are (block, node, class, size, level, part)."""
    block, node, root, size, level = (np.array(x) for x in list(zip(*rows, strict=True))[:5])
    out: list[tuple[int, int, bool]] = []
    for step in np.unique(level).tolist():
        at = np.flatnonzero((level == step) | (level == step - 1))
        parts = [p if level[i] == step else p[p & ((1 << step) - 1) == 0] for i in at.tolist() for p in (rows[i][5],)]
        n = np.array([len(p) for p in parts], np.float32)
        who, flat = np.repeat(np.arange(len(at)), n.astype(np.int64)), np.concatenate(parts)
        _, names, counts = np.unique(flat, return_inverse=True, return_counts=True)
        shared = counts[names] > 1
        _, names = np.unique(names[shared], return_inverse=True)
        who, both = who[shared], np.zeros((len(at), len(at)), np.float32)
        order = np.argsort(names, kind="stable")
        who, names = who[order], names[order]
        for low in range(0, int(names[-1]) + 1 if len(names) else 0, 4096):
            a, b = np.searchsorted(names, [low, low + 4096])
            table = np.zeros((len(at), 4096), np.float32)
            table[who[a:b], names[a:b] - low] = 1
            both += table @ table.T
        either = n[:, None] + n[None, :] - both
        slack = DEVIATIONS * np.sqrt(similarity * (1 - similarity) * either) if step else 0.0
        z, c, own, blocks = size[at], root[at], level[at], block[at]
        fits = (both >= similarity * either - slack - 1e-4) & (c[:, None] != c[None, :]) & (np.minimum(z[:, None], z[None, :]) >= (similarity - 1e-9) * np.maximum(z[:, None], z[None, :]))
        fits &= (own[:, None] == step) | (own[None, :] == step)
        if len(set(blocks.tolist())) > 1:
            fits &= blocks[:, None] != blocks[None, :]
        i, j = np.nonzero(np.triu(fits, 1))
        a, b = node[at[i]], node[at[j]]
        pairs = zip(np.minimum(a, b).tolist(), np.maximum(a, b).tolist(), i.tolist(), j.tolist(), strict=True)
        if step:
            out += [(x, y, False) for x, y, _, _ in pairs]
            continue
        parent = list(range(len(at)))

        def top(k: int, parent: list[int] = parent) -> int:
            while parent[k] != k:
                parent[k] = k = parent[parent[k]]
            return k

        for x, y, k, m in pairs:
            if (k := top(k)) != (m := top(m)):
                parent[max(k, m)] = min(k, m)
                out.append((x, y, True))
    return out


def _near_sizes(similarity: float) -> Column:
    """Whether sets of these sizes can have the similarity."""
    a, b = F.col("_sizea"), F.col("_sizeb")
    return F.least(a, b) >= F.lit(similarity - 1e-9) * F.greatest(a, b)


#: Standard deviations by which the similarity of two sets' parts may be below the one that is asked for.
DEVIATIONS = 5.0


def _may(similarity: float) -> Column:
    """Whether two sets, by the parts of them that are held, can have the similarity.

    Parts at level 0 are the sets themselves. Else a part of m shingles gives the similarity up to the
    square root of s (1 - s) / m; five of these below it a pair isn't taken any further, which a pair at the similarity
    itself meets in one of three million cases.
    """
    level = F.greatest("_levela", "_levelb")
    cut = lambda part: F.filter(part, lambda x: x.bitwiseAND(F.pow(F.lit(2.0), level).cast("int") - 1) == 0)
    a, b = cut(F.col("_parta")), cut(F.col("_partb"))
    both = F.size(F.array_intersect(a, b))
    either = F.size(a) + F.size(b) - both
    slack = F.when(level > 0, F.lit(DEVIATIONS) * F.sqrt(F.lit(similarity * (1 - similarity)) * either)).otherwise(F.lit(1e-6))
    return both >= F.lit(similarity) * either - slack


def one_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text", threshold: int = THRESHOLD, shingle: int = SHINGLE, similarity: float | None = None) -> DataFrame:
    """The rows of ``docs`` with the smallest key of each class; of repeated rows with that key, one.

    Classes are by fingerprints within ``threshold``, or with ``similarity`` by the exact Jaccard similarity.

    Rows with a null key stay only where their class has no other key, all of them. Null and empty texts are alike.
    Columns of any name are passed on as they are; an empty table gives no rows. What goes is stored and counted:
    if it is few rows it is broadcast, else the texts are shuffled once.
    """
    names = docs.columns
    d = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), F.col(key).alias("key"), F.col(text).alias("text"), F.xxhash64(text).alias("own"))
    slim = d.select("key", "text", "own")
    found = stored(near_duplicates(slim, "key", "text", threshold, shingle) if similarity is None else similar(slim, "key", "text", similarity, shingle), "classes")
    first = F.col("key").eqNullSafe(F.col("component_id"))
    gone = stored(found.where(~first).select(F.col("key").alias("gone_key"), F.col("own").alias("gone_own")).distinct(), "gone")
    again = stored(found.where(first).groupBy(F.col("key").alias("again_key")).agg(F.count(F.lit(1)).alias("n")).where("n > 1 and again_key is not null"), "again")
    dropped(found)
    kept = d.join(small_side(gone), F.col("key").eqNullSafe(F.col("gone_key")) & (F.col("own") == F.col("gone_own")), "left_anti")
    if again.isEmpty():
        return kept.select("row.*")
    twice, same = small_side(again), F.col("key") == F.col("again_key")
    return kept.join(twice, same, "left_anti").select("row.*").unionByName(kept.join(twice, same, "left_semi").dropDuplicates(["key"]).select("row.*"))
