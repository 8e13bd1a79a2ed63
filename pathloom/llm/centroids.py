"""Exact integer k-means with Yinyang bounds.

Centroids are put into groups once. Each vector carries an upper bound of the distance to its centroid and, for each
group, a lower bound of the distances to the group's other centroids. A round adds what the centroids moved to the bounds;
vectors whose upper bound stays below all their lower ones keep their centroid, of the others only groups whose bound is
reached are scanned, exactly. All distances are integers; bounds are rounded outwards, so that no tie is missed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathloom.llm.common import dropped, stored

#: Largest component, in size: squared distances of up to 512 components stay within a long.
LARGEST = 2**26
#: Centroids to a group, about.
GROUP = 4
_FAR = np.iinfo(np.int64).max
_SLACK = 1e-9


def integers(rows: DataFrame, key: str, vector: str, dims: int, scale: float) -> DataFrame:
    """(vec_id, x): vectors of exactly ``dims`` components, none null or non-finite, as integers floor(scale * component)."""
    v = F.col(f"`{vector}`")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < F.lit(float("inf"))))
    kept = rows.where(v.isNotNull() & (F.size(v) == dims)).where(finite)
    return kept.select(F.col(f"`{key}`").alias("vec_id"), F.transform(v, lambda x: F.floor(F.lit(scale) * x.cast("double"))).alias("x"))


def first_centroids(vectors: DataFrame, k: int, seed: int) -> np.ndarray:
    """The ``k`` vectors (all, if fewer) with least SHA-256 of "seed:vec_id", in that order; equal keys by components, null keys last."""
    mark = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    found = vectors.select(mark.alias("mark"), "x").orderBy(F.asc_nulls_last("mark"), "x").limit(k).collect()
    return np.array([r["x"] for r in found], np.int64)


def grouped(centroids: np.ndarray, rounds: int = 5) -> np.ndarray:
    """The group of each centroid: a few rounds of k-means over the centroids themselves. Any grouping gives right results."""
    t = -(-len(centroids) // GROUP)
    points = centroids.astype(float)
    heads = points[:t].copy()
    for _ in range(rounds):
        of = ((points[:, None] - heads[None]) ** 2).sum(2).argmin(1)
        for g in range(t):
            if (of == g).any():
                heads[g] = points[of == g].mean(0)
    return of


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances of the rows of x to the rows of c, in 64-bit integers."""
    return np.stack([((x - row) ** 2).sum(1) for row in c], 1) if len(c) else np.zeros((len(x), 0), np.int64)


def _above(d2: np.ndarray) -> np.ndarray:
    return np.sqrt(d2.astype(float)) * (1 + _SLACK)


def _below(d2: np.ndarray) -> np.ndarray:
    return np.where(d2 == _FAR, np.inf, np.sqrt(d2.astype(float)) * (1 - _SLACK))


def moved_bounds(x: np.ndarray, own: np.ndarray, upper: np.ndarray, lower: np.ndarray, centroids: np.ndarray, moved: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Centroid, upper bound and lower bounds of each row after the centroids moved by ``moved``, and how many distances were computed.

    ``own`` is -1 for rows that have no centroid yet; all centroids are scanned for these.
    """
    own, fresh = own.copy(), own < 0
    groups = range(lower.shape[1])
    upper = np.where(fresh, np.inf, upper + moved[own])
    lower = np.where(fresh[:, None], -np.inf, np.maximum(lower - np.array([moved[group == g].max(initial=0) for g in groups])[None], 0))
    work, counted = np.flatnonzero(upper >= lower.min(1)), 0
    held = work[own[work] >= 0]
    upper[held] = _above(((x[held] - centroids[own[held]]) ** 2).sum(1))
    counted += len(held)
    work = work[upper[work] >= lower[work].min(1)]
    if len(work):
        d = np.full((len(work), len(centroids)), _FAR)
        has = own[work] >= 0
        d[has, own[work][has]] = ((x[work][has] - centroids[own[work][has]]) ** 2).sum(1)
        scan = lower[work] <= upper[work, None]
        for g in groups:
            at, members = np.flatnonzero(scan[:, g]), np.flatnonzero(group == g)
            if len(at) and len(members):
                d[np.ix_(at, members)] = squared(x[work[at]], centroids[members])
                counted += len(at) * len(members)
        best = d.argmin(1)  # the first of equal ones: the smaller number
        upper[work] = _above(d[np.arange(len(work)), best])
        d[np.arange(len(work)), best] = _FAR
        for g in groups:
            near = _below(d[:, group == g].min(1, initial=_FAR))
            lower[work, g] = np.where(scan[:, g], near, np.minimum(lower[work, g], near))
        own[work] = best
    return own, upper, lower, counted


def _matrix(column: pa.Array, dims: int, kind: type) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(-1, dims)


def _round(dims: int, centroids: np.ndarray, moved: np.ndarray, group: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x, lower = _matrix(b.column("x"), dims, np.int64), _matrix(b.column("lower"), int(group.max()) + 1, float)
                if np.abs(x).max(initial=0) > LARGEST:
                    raise ValueError(f"a component is beyond {LARGEST}: squared distances might leave a long")
                was = b.column("own").to_numpy()
                own, upper, lower, counted = moved_bounds(x, was, b.column("upper").to_numpy(), lower, centroids, moved, group)
                counts = np.zeros(len(x), np.int64)
                counts[0] = counted
                yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("x"), pa.array(own.astype(np.int32)), pa.array(was.astype(np.int32)), pa.array(upper), pa.array(list(lower), pa.list_(pa.float64())), pa.array(counts)], names=["vec_id", "x", "own", "was", "upper", "lower", "counted"])

    return run


def _sums(dims: int, k: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """What the vectors that changed their centroid add to the sums and counts of centroids: a row for each centroid and task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, count = np.zeros((k, dims), np.int64), np.zeros(k, np.int64)
        for b in batches:
            x = _matrix(b.column("x"), dims, np.int64)
            for name, sign in (("own", 1), ("was", -1)):
                at = b.column(name).to_numpy()
                for c in np.unique(at[at >= 0]):
                    total[c] += sign * x[at == c].sum(0)
                    count[c] += sign * (at == c).sum()
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(k, dtype=np.int32)), pa.array(list(total), pa.list_(pa.int64())), pa.array(count)], names=["c", "total", "n"])

    return run


def cluster(rows: DataFrame, key: str = "vec_id", vector: str = "embedding", k: int = 8, rounds: int = 10, seed: int = 3, dims: int = 64, scale: float = 1024.0) -> DataFrame:
    """A row for each kept vector: its key as vec_id, cluster, distance (squared), cluster_inertia, inertia, centroid_sha256.

    Vectors that are null, of other than ``dims`` components, or hold null or non-finite ones are left out. Repeated rows
    are vectors of their own; keys may be null. With fewer than ``k`` vectors there are as many centroids as vectors; an
    empty table gives no rows. Other columns, of any name, aren't carried on.

    Only the centroids, their sums and counts reach the driver: k rows. Each round reads the last round's table and
    writes its own in the shared folder, whose predecessor is deleted; vectors that keep their centroid add nothing to
    the sums. Rounds end early when no centroid moves, as nothing can change then.
    """
    spark = rows.sparkSession
    kind = dict(rows.dtypes)[key]
    vectors = integers(rows, key, vector, dims, scale)
    centroids = first_centroids(vectors, k, seed)
    out = f"vec_id {kind}, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    if not len(centroids):
        return spark.createDataFrame([], out)
    k, group, moved = len(centroids), grouped(centroids), np.zeros(len(centroids))
    sums, counts = [[0] * dims for _ in range(k)], [0] * k
    state = stored(vectors.select("vec_id", "x", F.lit(-1).alias("own"), F.lit(0.0).alias("upper"), F.array_repeat(F.lit(0.0), int(group.max()) + 1).alias("lower")), "vectors")
    shape = f"vec_id {kind}, x array<long>, own int, was int, upper double, lower array<double>, counted long"
    for at in range(rounds + 1):
        before, state = state, stored(state.mapInArrow(_round(dims, centroids, moved, group), shape), "clusters")
        dropped(before)
        if at == rounds:
            break
        changes = state.where("own <> was").mapInArrow(_sums(dims, k), "c int, total array<long>, n long")
        parts = changes.select("c", "n", F.posexplode("total").alias("i", "v")).groupBy("c", "i").agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("v"), F.sum("n").alias("n"))
        for r in parts.collect():  # k times dims rows
            sums[r["c"]][r["i"]] += int(r["v"])
            if r["i"] == 0:
                counts[r["c"]] += r["n"]
        new = np.array([[s // counts[c] for s in sums[c]] if counts[c] else centroids[c] for c in range(k)], np.int64)
        if (new == centroids).all():
            break
        moved, centroids = _above(((new - centroids) ** 2).sum(1)), new
    heads = spark.createDataFrame([(c, row.tolist(), hashlib.sha256(",".join(map(str, row.tolist())).encode()).hexdigest()) for c, row in enumerate(centroids)], "cluster int, centre array<long>, centroid_sha256 string")
    far = F.aggregate(F.zip_with("x", "centre", lambda x, y: (x - y) * (x - y)), F.lit(0).cast("long"), lambda a, b: a + b)
    found = stored(state.select("vec_id", F.col("own").alias("cluster"), "x").join(F.broadcast(heads), "cluster").select("vec_id", "cluster", far.alias("distance"), "centroid_sha256"), "distances")
    dropped(state)
    per = found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s"))
    every = per.agg(F.sum("s").cast("long").alias("inertia"))
    # at most k rows and one row
    both = found.join(F.broadcast(per.select("cluster", F.col("s").cast("long").alias("cluster_inertia"))), "cluster").crossJoin(F.broadcast(every))
    return both.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def cluster_sql(k: int = 8, rounds: int = 10, seed: int = 3, dims: int = 64) -> str:
    """The same by plain k-means, every distance computed, for tables of any size DuckDB takes."""
    nearest = """a{0} AS MATERIALIZED (SELECT r, c, d FROM (SELECT v.r, z.c, list_sum(list_transform(list_zip(v.x, z.x), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT AS d,
      row_number() OVER (PARTITION BY v.r ORDER BY d, z.c) AS o FROM v, z{0} z) s WHERE o = 1)"""
    moved = """z{1} AS MATERIALIZED (SELECT z.c, coalesce(m.x, z.x) AS x FROM z{0} z LEFT JOIN (SELECT c, list(f ORDER BY i) AS x FROM (
      SELECT c, i, ((sum(e) - ((sum(e) % count(*)) + count(*)) % count(*)) // count(*))::BIGINT AS f FROM (SELECT a.c, unnest(v.x) AS e, generate_subscripts(v.x, 1) AS i FROM a{0} a JOIN v USING (r)) u GROUP BY c, i) w GROUP BY c) m ON m.c = z.c)"""
    parts = [
        f"""WITH v AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda y: floor(1024 * y::DOUBLE)::BIGINT) AS x FROM embeddings
      WHERE len(embedding) = {dims} AND len(list_filter(embedding, lambda y: y IS NULL OR isnan(y) OR isinf(y))) = 0)""",
        f"z0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('{seed}:' || vec_id::VARCHAR), x) - 1 AS c, x FROM v QUALIFY c < {k})",
    ]
    for i in range(rounds):
        parts += [nearest.format(i), moved.format(i, i + 1)]
    parts.append(nearest.format(rounds))
    return ",\n".join(parts) + f"""
    SELECT v.vec_id, a.c::INT AS cluster, a.d AS distance, (sum(a.d) OVER (PARTITION BY a.c))::BIGINT AS cluster_inertia, (sum(a.d) OVER ())::BIGINT AS inertia,
      sha256(array_to_string(z.x, ',')) AS centroid_sha256 FROM a{rounds} a JOIN v USING (r) JOIN z{rounds} z ON z.c = a.c"""
