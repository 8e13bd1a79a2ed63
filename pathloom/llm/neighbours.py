"""Approximate nearest neighbours by multiprobe p-stable hashing.

Largest inner product becomes smallest distance by one more component: with M the largest norm, rows
are x / M with sqrt(1 - |x/M|^2) appended and queries q / |q| with 0. A table hashes a vector by K
Gaussian projections cut into cells of a width. For a neighbour of inner product s with the query, a
projection is normal around s times the query's own with variance 1 - s^2; a query visits cells in the
order of the probability so estimated, until the probabilities add up to a target.

The search takes two rounds. In the first a query visits its few likeliest cells and gets a score that
20 rows reach. Only rows that reach it matter from there on: in the second round s is the query's own score
where that is higher, the remaining probes carry the score, and rows below it aren't handed on. The tables'
candidates are merged and ranked by exact inner products.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pathloom.llm.common import stored

NEAREST = 20
#: Probability with which a neighbour at the fitted inner product, or a nearer one, lies in a visited cell of some table.
MASS = 0.9
#: Share of the probability that the first round visits.
FIRST = 0.2
#: Rows that share a row's cell, on the mean; rows of a cell and queries that meet in one comparison.
CELL_ROWS, CHUNK_ROWS, ASK_ROWS = 400, 2048, 65_536
#: Widths of a cell, in standard deviations of a projection, and numbers of tables of which the fit takes the cheapest.
WIDTHS, TABLES = (1.5, 2.0, 3.0), (1, 2)
#: Vectors of the sample from which the inner product of neighbours and the spread of projections are fitted.
SAMPLE = 4096
#: Cells of a table visited at most; a query whose mass isn't reached by then goes to the exact search.
CELLS = 20_000
#: Relative difference of two scores that may be rounding.
SLACK = 1e-9


def usable(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """(key, vector) without null, zero or non-finite vectors."""
    rows = vectors.select(F.col(key).cast("long").alias("_id"), F.col(vector).alias("_v")).where(F.col("_v").isNotNull() & F.col("_id").isNotNull())
    odd = F.exists("_v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf")))
    return rows.where(~odd).where(F.exists("_v", lambda x: x != 0))


class Tables:
    """Projections, cells and the order of probes. All is drawn from a seed and the fitted numbers.

    ``near`` is the inner product (of scaled vectors) from which on rows count as neighbours; width is in
    standard deviations of a projection of a random row.
    """

    def __init__(self, dim: int, projections: int, width: float, near: float, norm: float, tables: int = 1, seed: int = 5, most: int = CELLS):
        rng = np.random.default_rng(seed)
        self.k, self.width, self.norm, self.tables, self.most = projections, width, norm, tables, most
        self.near = near
        self.a = rng.normal(size=(tables, dim + 1, projections))
        self.b = rng.uniform(0, width, (tables, projections))
        self.mix = rng.integers(1, 2**63 - 1, (tables, projections + 1), dtype=np.int64) | 1

    def lines(self, x: np.ndarray, query: bool) -> np.ndarray:
        """Table by row by projection: the projections."""
        if query:
            y = np.hstack([x / np.linalg.norm(x, axis=1, keepdims=True), np.zeros((len(x), 1))])
        else:
            y = x / self.norm
            y = np.hstack([y, np.sqrt(np.maximum(0, 1 - (y**2).sum(axis=1, keepdims=True)))])
        return np.einsum("nd,tdk->tnk", y, self.a)

    def cells(self, x: np.ndarray) -> np.ndarray:
        """Table by row by projection: the cells in which rows lie."""
        return np.floor((self.lines(x, False) + self.b[:, None, :]) / self.width).astype(np.int64)

    def keys(self, table: int, cells: np.ndarray) -> np.ndarray:
        """A number for each row of cell coordinates."""
        with np.errstate(over="ignore"):
            h = np.full(len(cells), self.mix[table, -1], np.int64)
            for i in range(self.k):
                h = (h ^ (cells[:, i].astype(np.int64) * self.mix[table, i])) * np.int64(-7046029254386353131)
                h ^= h >> np.int64(29)
        return h

    def _likeliest(self, table: int, line: np.ndarray, near: float, mass: float) -> tuple[list[tuple[int, ...]], list[float], bool]:
        """Cells, likeliest first, until they hold ``mass`` of a row at inner product ``near``; their logarithms; whether they do."""
        sd, choices = math.sqrt(max(1 - near * near, 1e-6)), []
        for i in range(self.k):
            low = (near * line[i] - 5 * sd + self.b[table, i]) / self.width
            high = (near * line[i] + 5 * sd + self.b[table, i]) / self.width
            at = np.arange(math.floor(low), math.floor(high) + 2)
            cdf = np.array([0.5 * (1 + math.erf((c * self.width - self.b[table, i] - near * line[i]) / sd / math.sqrt(2))) for c in at])
            p = np.diff(cdf)
            order = np.argsort(-p, kind="stable")
            choices.append((at[:-1][order].tolist(), np.log(np.maximum(p[order], 1e-300)).tolist()))
        # best first over the choices of each projection, in order of the product of probabilities
        start = (0,) * self.k
        heap, seen, out, cost_of, done = [(-sum(c[1][0] for c in choices), start)], {start}, [], [], 0.0
        while heap and done < mass and len(out) < self.most:
            cost, at = heapq.heappop(heap)
            done += math.exp(-cost)
            out.append(tuple(choices[i][0][j] for i, j in enumerate(at)))
            cost_of.append(-cost)
            for i in range(self.k):
                if at[i] + 1 < len(choices[i][0]):
                    nxt = (*at[:i], at[i] + 1, *at[i + 1 :])
                    if nxt not in seen:
                        seen.add(nxt)
                        heapq.heappush(heap, (cost + choices[i][1][at[i]] - choices[i][1][at[i] + 1], nxt))
        return out, cost_of, done >= mass

    def head(self, table: int, line: np.ndarray, first: float = FIRST) -> np.ndarray:
        """The cells of the first round."""
        cells = self._likeliest(table, line, min(max(self.near, 0.0), 0.99), first)[0]
        return np.array(cells, np.int64).reshape(len(cells), self.k)

    def visits(self, table: int, line: np.ndarray, mass: float, reached: float = -1.0) -> tuple[np.ndarray, bool]:
        """All cells to visit for rows of inner product ``reached`` or more, and whether they hold ``mass`` of them.

        Nearer rows aren't spread as far around the query, so they have estimates of their own, and the cells
        for these follow.
        """
        near = min(max(self.near, reached, 0.0), 0.99)
        cells, whole = {}, True
        for s in sorted({near, (1 + near) / 2, max(near, 0.95)}):
            found, _, done = self._likeliest(table, line, s, mass)
            whole &= done
            cells |= dict.fromkeys(found)
        return np.array(list(cells), np.int64).reshape(len(cells), self.k), whole


def table_mass(mass: float, tables: int) -> float:
    """The mass of each of ``tables`` tables that together miss as little as one of ``mass``."""
    return 1 - (1 - mass) ** (1 / tables)


def compared_share(index: Tables, x: np.ndarray, queries: np.ndarray, mass: float, reached: np.ndarray | None = None) -> float:
    """Share of rows that queries are compared with, all tables added up, by a sample of both."""
    lines, held, total = index.lines(queries, True), index.cells(x), 0
    reached = np.full(len(queries), -1.0) if reached is None else reached
    for t in range(index.tables):
        keys = index.keys(t, held[t])
        for line, s in zip(lines[t], reached, strict=True):
            total += int(np.isin(keys, index.keys(t, index.visits(t, line, mass, s)[0])).sum())
    return total / max(1, len(x) * len(queries))


def fit(rows: DataFrame, nearest: int = NEAREST, tables: int | None = None, cell_rows: int = CELL_ROWS, mass: float = MASS, most: int = CELLS) -> tuple[Tables, float] | None:
    """The index, and the mass that each of its tables visits, from the count, the largest norm and a sample of about SAMPLE vectors.

    A sampled query's inner product with neighbours is the one that ``nearest`` rows exceed, by the sample's products
    (in samples too small for that, the largest, which errs to more probes); the index is made for the lowest tenth of
    these. For each width K is the
    largest number of projections, one at least, that leaves ``cell_rows`` rows in a row's cell, and less where
    ``most`` cells don't reach the mass. Of the widths and numbers of tables the one is taken by which sampled queries
    compare the fewest rows.
    """
    square = F.aggregate("_v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    n, top, dim = rows.agg(F.count(F.lit(1)), F.max(square), F.max(F.size("_v"))).first()
    if not n:
        return None
    norm = math.sqrt(top)
    share = min(1.0, SAMPLE / n)
    picked = rows.where(F.pmod(F.xxhash64("_id"), F.lit(1 << 30)) <= int(share * (1 << 30))).orderBy(F.xxhash64("_id")).select("_v").limit(2 * SAMPLE)
    x = np.array([r["_v"] for r in picked.collect()], float)
    if len(x) < 2:
        return Tables(dim, 1, 2.0, 0.0, norm, 1, most=most), mass
    q = x[:256] / np.linalg.norm(x[:256], axis=1, keepdims=True)
    dots = np.sort((q @ x.T / norm)[~np.eye(len(q), len(x), dtype=bool)].reshape(len(q), -1), axis=1)
    own = dots[:, max(0, len(x) - 2 - int((len(x) - 1) * min(1.0, nearest / n)))]
    near = float(np.quantile(own, 0.1))
    best: tuple[float, Tables, float] | None = None
    for width in WIDTHS:
        probe = Tables(dim, 16, width, near, norm, 1)
        at = probe.cells(x)[0]
        alone = np.mean([np.sum((np.unique(at[:, i], return_counts=True)[1] / len(x)) ** 2) for i in range(16)])
        k = max(1, min(24, int(math.log(max(n / cell_rows, 1.0)) / max(-math.log(alone), 0.05))))
        for number in TABLES if tables is None else (tables,):
            part, some = table_mass(mass, number), x[:24]
            index = Tables(dim, k, width, near, norm, number, most=most)
            while index.k > 1 and not all(index.visits(0, p, part)[1] for p in index.lines(x[:3], True)[0]):
                index = Tables(dim, index.k - 1, width, near, norm, number, most=most)
            cost = compared_share(index, x, some, part, own[:24])
            if best is None or cost < best[0]:
                best = (cost, index, part)
    return best[1], best[2]


def _arrays(ids: pa.Array, vectors: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    return ids.to_numpy(zero_copy_only=False), vectors.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(ids), -1)


def _pack(rows: DataFrame, index: Tables) -> DataFrame:
    """(_key, _id, _v): a row for each table of a vector."""
    kind = rows.schema["_v"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                for t, at in enumerate(index.cells(_arrays(b.column(0), b.column(1))[1])):
                    yield pa.RecordBatch.from_arrays([pa.array(index.keys(t, at)), b.column(0), b.column(1)], names=["_key", "_id", "_v"])

    return rows.select("_id", "_v").mapInArrow(run, f"_key long, _id long, _v {kind}")


def _heads(queries: DataFrame, index: Tables) -> DataFrame:
    """(_key, _id, _v, _least): the cells of a query's first round."""
    kind = queries.schema["_v"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            lines = index.lines(_arrays(b.column(0), b.column(1))[1], True)
            for t in range(index.tables):
                keys = [index.keys(t, index.head(t, line)) for line in lines[t]]
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(keys, pa.list_(pa.int64()))], names=["_id", "_v", "_keys"])

    rows = queries.select("_id", "_v").mapInArrow(run, f"_id long, _v {kind}, _keys array<long>")
    return rows.select(F.explode("_keys").alias("_key"), "_id", "_v", F.lit(float("-inf")).alias("_least"))


def _ask(queries: DataFrame, index: Tables, mass: float) -> DataFrame:
    """(_id, _v, _least, _keys, _whole): a row for each table of a query, with the cells of the second round and whether both rounds' reach the mass."""
    kind = queries.schema["_v"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            x = _arrays(b.column(0), b.column(1))[1]
            lines, reached = index.lines(x, True), b.column(2).to_numpy(zero_copy_only=False) / np.linalg.norm(x, axis=1) / index.norm
            for i in range(0, b.num_rows, 64):
                part = b.slice(i, 64)
                for t in range(index.tables):
                    keys, whole = [], []
                    for line, s in zip(lines[t][i : i + 64], reached[i : i + 64], strict=True):
                        cells, done = index.visits(t, line, mass, s)
                        had = index.keys(t, index.head(t, line))
                        found = index.keys(t, cells)
                        keys.append(found[~np.isin(found, had)])
                        whole.append(done)
                    yield pa.RecordBatch.from_arrays([*part.columns, pa.array(keys, pa.list_(pa.int64())), pa.array(whole)], names=["_id", "_v", "_least", "_keys", "_whole"])

    return queries.select("_id", "_v", "_least").mapInArrow(run, f"_id long, _v {kind}, _least double, _keys array<long>, _whole boolean")


def _meet(held: DataFrame, asked: DataFrame, nearest: int, chunk: int = CHUNK_ROWS, block: int = ASK_ROWS) -> DataFrame:
    """(query_id, vec_id, score): rows that can be among the nearest of a query in a cell that it visits.

    ``held`` has (_key, _id, _v), ``asked`` (_key, _id, _v, _least), a row for each cell that a query
    visits, with the score that rows must reach. Rows and queries of a cell are cut by hash into chunks and
    blocks, and each pair of these is compared by itself: the chunk is held, its queries pass by in batches. What
    a query has reached in one chunk counts for those that the same task compares later.
    """
    rows = held.groupBy("_key").agg(F.ceil(F.count(F.lit(1)) / chunk).cast("int").alias("_chunks"))
    sizes = rows.join(asked.groupBy("_key").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("_blocks")), "_key")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    own = lambda n: F.pmod(F.xxhash64("_id"), F.col(n)).cast("int")
    left = held.join(sizes, "_key").select("_key", own("_chunks").alias("_chunk"), every("_blocks").alias("_block"), F.lit(False).alias("_ask"), "_id", "_v", F.lit(0.0).alias("_least"))
    right = asked.join(sizes, "_key").select("_key", every("_chunks").alias("_chunk"), own("_blocks").alias("_block"), F.lit(True).alias("_ask"), "_id", "_v", "_least")
    place = ["_key", "_chunk", "_block"]
    dealt = left.unionByName(right).repartition(*place).sortWithinPartitions(*place, "_ask")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, ids, parts, own, least = None, [], [], None, {}
        for b in batches:
            where = np.stack([b.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(4)])
            cuts = [0, *(np.flatnonzero((where[:, 1:] != where[:, :-1]).any(axis=0)) + 1).tolist(), b.num_rows]
            for i, j in zip(cuts, cuts[1:], strict=False):
                if i == j:
                    continue
                if at != (place := tuple(where[:3, i].tolist())):
                    at, ids, parts, own = place, [], [], None
                key, vec = _arrays(b.column(4).slice(i, j - i), b.column(5).slice(i, j - i))
                if not where[3, i]:
                    ids.append(key)
                    parts.append(vec)
                    continue
                if not ids:
                    continue
                if own is None:
                    own, vecs = np.concatenate(ids), np.concatenate(parts)
                    order = np.argsort(own, kind="stable")
                    own, vecs = own[order], vecs[order]
                floor = b.column(6).slice(i, j - i).to_numpy(zero_copy_only=False)
                for k in range(0, len(key), 256):
                    yield _best(key[k : k + 256], vec[k : k + 256], floor[k : k + 256], own, vecs, nearest, least)
                if len(least) > 1_000_000:
                    least.clear()

    return dealt.mapInArrow(run, "query_id long, vec_id long, score double")


def _best(asked: np.ndarray, vec: np.ndarray, floor: np.ndarray, own: np.ndarray, vecs: np.ndarray, nearest: int, least: dict[int, float]) -> pa.RecordBatch:
    """The rows that are among the ``nearest`` of a chunk for a query and reach its score. ``own`` ascends."""
    s = vec @ vecs.T
    s[asked[:, None] == own[None, :]] = -np.inf
    floor = np.maximum(floor, [least.get(q, -np.inf) for q in asked.tolist()])
    if len(own) > nearest:
        edge = -np.partition(-s, nearest - 1, axis=1)[:, nearest - 1]
        floor = np.maximum(floor, edge)
        least |= dict(zip(asked.tolist(), floor.tolist(), strict=True))
    # the matrix product may round equal rows apart; scores are made anew, alike for each pair
    i, j = np.nonzero((s >= (floor - SLACK * np.abs(floor))[:, None]) & (s > -np.inf))
    score = np.einsum("nd,nd->n", vec[i], vecs[j])
    order = np.lexsort((own[j], -score, i))
    i, j, score = i[order], j[order], score[order]
    first = np.searchsorted(i, i)
    keep = np.arange(len(i)) - first < nearest
    return pa.RecordBatch.from_arrays([pa.array(asked[i[keep]]), pa.array(own[j[keep]]), pa.array(score[keep])], names=["query_id", "vec_id", "score"])


def _distinct(rows: DataFrame, keep: int) -> DataFrame:
    """Of equal vectors the ``keep`` smallest ids: no others can be among a query's nearest. Hot vectors are salted."""
    first = Window.partitionBy("_v", F.pmod(F.xxhash64("_id"), F.lit(64))).orderBy("_id")
    then = Window.partitionBy("_v").orderBy("_id")
    return rows.withColumn("_r", F.row_number().over(first)).where(F.col("_r") <= keep).withColumn("_r", F.row_number().over(then)).where(F.col("_r") <= keep).drop("_r")


def search(
    vectors: DataFrame, queries: DataFrame, key: str = "vec_id", vector: str = "embedding", nearest: int = NEAREST, tables: int | None = None, mass: float = MASS, cell_rows: int = CELL_ROWS, chunk: int = CHUNK_ROWS, cells: int = CELLS
) -> DataFrame:
    """query_id, rank, vec_id, score: each query's nearest found rows but its own id, ties to the smaller id.

    Vectors that are null, zero, hold null or non-finite components, or have another length than most,
    and null ids, take no part on either side; repeated rows count once. Extra columns are left out.
    Tables of every size are hashed and probed alike. A query that finds fewer than ``nearest`` rows, or whose mass
    isn't reached by ``cells`` cells of a table, is searched over all rows, in chunks. An empty table gives
    no rows.
    """
    spark = vectors.sparkSession
    good = usable(vectors, key, vector)
    lengths = good.groupBy(F.size("_v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    schema = "query_id long, rank int, vec_id long, score double"
    if lengths is None:
        return spark.createDataFrame([], schema)
    good = good.where(F.size("_v") == lengths["n"])
    asked = usable(queries, key, vector).where(F.size("_v") == lengths["n"]).dropDuplicates(["_id"])
    rows = stored(_distinct(good.dropDuplicates(["_id"]), nearest + 1), "rows")
    index, part = fit(rows, nearest, tables, cell_rows, mass, cells)
    held = _pack(rows, index)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    none = F.lit(float("-inf"))

    def ranked(found: DataFrame) -> DataFrame:
        merged = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
        return merged.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= nearest).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")

    near = stored(ranked(_meet(held, _heads(asked, index), nearest, chunk)), "first")
    reached = near.where(F.col("rank") == nearest).select(F.col("query_id").alias("_id"), F.col("score").alias("_least"))
    # probes cost time, not bytes: the queries are dealt to a number of tasks that isn't lowered to fit their size
    scored = asked.join(reached, "_id", "left").select("_id", "_v", F.coalesce("_least", none).alias("_least"))
    visits = stored(_ask(scored.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "_id"), index, part), "visits")
    rest = visits.select(F.explode("_keys").alias("_key"), "_id", "_v", "_least")
    out = stored(ranked(near.select("query_id", "vec_id", "score").unionByName(_meet(held, rest, nearest, chunk))), "nearest")
    full = out.where(F.col("rank") == nearest).select(F.col("query_id").alias("_id"), F.col("score").alias("_least"))
    unmet = visits.where(~F.col("_whole")).select("_id", F.lit(True).alias("_unmet")).distinct()
    short = asked.join(full, "_id", "left").join(unmet, "_id", "left").where(F.col("_least").isNull() | F.col("_unmet"))
    short = stored(short.select(F.lit(0).cast("long").alias("_key"), "_id", "_v", F.coalesce("_least", none).alias("_least")), "short")
    if short.isEmpty():
        return out
    again = ranked(_meet(rows.select(F.lit(0).cast("long").alias("_key"), "_id", "_v"), short, nearest, chunk))
    return out.join(short.select(F.col("_id").alias("query_id")), "query_id", "left_anti").unionByName(again)
