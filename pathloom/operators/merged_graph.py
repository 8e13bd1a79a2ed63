"""A flow graph that is merged batch by batch, equal to the graph of all batches together.

A batch changes the graph only near its own events: it adds nodes, adds edges, and takes an edge away where a row falls
between two earlier ones. So a folder keeps, for each batch, the differences of counts and weights, and of each
sub-session that may still grow its number of events and its boundary: the node rows behind which nothing new can come
no more, and the last one before these. The work of a batch grows with the batch and the open sub-sessions, not with
the history. A batch becomes visible by its marker, which is written last; one that was aborted is written over.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pathloom.operators.graph import event_node
from pathloom.operators.sessions import SUB_KEY, same_keys
from pathloom.schema import ORDER
from pathloom.session import entries, written

#: After so many batches the differences are summed up.
FOLD = 20


def _done(spark: SparkSession, folder: str) -> list[int]:
    return sorted(int(n) for n in entries(spark, f"{folder}/done") if n.isdigit())


def _marker(spark: SparkSession, folder: str, batch: int):
    return spark.read.parquet(f"{folder}/done/{batch}").first()


def _moment(micros: int | None) -> Column:
    return F.timestamp_micros(F.lit(micros).cast("long"))


def _sum_nodes(rows: DataFrame) -> DataFrame:
    return rows.groupBy("node").agg(F.sum("count").alias("count"), F.min_by(F.struct("url", "event_type"), "first").alias("_f"), F.min("first").alias("first")).select("node", "count", "_f.url", "_f.event_type", "first")


def _sum_edges(rows: DataFrame) -> DataFrame:
    return rows.groupBy("src", "dst").agg(F.sum("weight").alias("weight")).where("weight <> 0")


def differences(rows: DataFrame, keys: list[str], order: list[str]) -> tuple[DataFrame, DataFrame]:
    """What new rows change in nodes and edges.

    ``rows`` are node rows, old and new, with ``_old``, and the number of events of their sub-session before (``_n0``)
    and with (``_n1``) the new ones; sub-sessions count from 2 events on.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    was, now = F.col("_old") & (F.col("_n0") >= 2), F.col("_n1") >= 2
    signed = rows.select("*", F.lag("node").over(w).alias("_src1"), F.last(F.when(F.col("_old"), F.col("node")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)).alias("_src0"))
    added = signed.where(now & ~was).select("node", F.lit(1).cast("long").alias("count"), "url", "event_type", F.struct(*keys, *order).alias("first"))
    edge = lambda use, src, sign: F.when(use & (F.col(src) != F.col("node")), F.struct(F.col(src).alias("src"), F.col("node").alias("dst"), F.lit(sign).cast("long").alias("weight")))
    edges = signed.select(F.explode(F.array_compact(F.array(edge(now, "_src1", 1), edge(was, "_src0", -1)))).alias("e")).select("e.*")
    return _sum_nodes(added), _sum_edges(edges)


def merge_batch(folder: str, events: DataFrame, batch: int, late: str = "10 minutes", keep: str = "1 day", keys: list[str] = SUB_KEY, order: list[str] = ORDER, fold: int = FOLD) -> bool:
    """Adds a batch of events to the graph in ``folder``; False if it was added before.

    Batches have rising numbers. Events more than ``late`` behind the latest event of the batches before, or without
    a time, are left out, as behind a stream's watermark. A sub-session without an event for ``keep`` behind that mark
    is closed: events of its key that come later begin another one. ``order`` begins with the timestamp.
    """
    spark, time = events.sparkSession, order[0]
    done = _done(spark, folder)
    if batch in done:
        return False
    if done and batch < done[-1]:
        raise ValueError(f"batch {batch} comes after batch {done[-1]}")
    last = done[-1] if done else None
    state = _marker(spark, folder, last) if done else None
    mark = state["mark"] if state else None
    taken = events.where(F.col(time).isNotNull() if mark is None else F.col(time) >= _moment(mark))
    places = [o for o in order if o not in keys]
    fresh = written(taken.select(*keys, *places, event_node().alias("node"), "url", "event_type"))
    grown = fresh.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.max(time).alias("_last"))
    none = spark.createDataFrame([], grown.schema), spark.createDataFrame([], fresh.schema)
    seen, held = (spark.read.parquet(f"{folder}/{t}/{last}") for t in ("seen", "open")) if done else none
    counts = written(seen.select("*", F.col("_n").alias("_n0")).unionByName(grown.withColumn("_n0", F.lit(0).cast("long"))).groupBy(*keys).agg(F.sum("_n0").alias("_n0"), F.sum("_n").alias("_n1"), F.max("_last").alias("_last")))
    rows = held.withColumn("_old", F.lit(True)).unionByName(fresh.where("node is not null").withColumn("_old", F.lit(False)))
    rows = written(rows.alias("r").join(counts.alias("c"), same_keys("r", "c", keys)).select("r.*", "c._n0", "c._n1", "c._last"))
    nodes, edges = differences(rows.where("_n1 > _n0"), keys, order)
    nodes.write.mode("overwrite").parquet(f"{folder}/nodes/{batch}")
    edges.write.mode("overwrite").parquet(f"{folder}/edges/{batch}")

    top = fresh.agg((F.unix_micros(F.max(time) - F.expr(f"interval {late}"))).alias("t")).first()["t"]
    reach = max((t for t in (top, mark) if t is not None), default=None)
    past = F.col(time) < _moment(reach)
    alive = F.col("_last") >= _moment(reach) - F.expr(f"interval {keep}")
    counts.where(alive).select(*keys, F.col("_n1").alias("_n"), "_last").write.mode("overwrite").parquet(f"{folder}/seen/{batch}")
    nearest = Window.partitionBy(*keys, "_past").orderBy(*[F.desc(o) for o in order])
    kept = rows.where(alive).withColumn("_past", past).withColumn("_r", F.row_number().over(nearest)).where("not _past or _r = 1")
    kept.select(*fresh.columns).write.mode("overwrite").parquet(f"{folder}/open/{batch}")

    base = state["base"] if state else None
    since = [b for b in done if base is None or b > base]
    if len(since) + 1 >= fold:
        for table, total in zip(("nodes", "edges"), _totals(spark, folder, base, [*since, batch]), strict=True):
            total.write.mode("overwrite").parquet(f"{folder}/{table}_total/{batch}")
        base = batch
    spark.createDataFrame([(reach, base)], "mark long, base long").coalesce(1).write.mode("overwrite").parquet(f"{folder}/done/{batch}")
    return True


def _totals(spark: SparkSession, folder: str, base: int | None, since: list[int]) -> tuple[DataFrame, DataFrame]:
    def all_of(table: str) -> DataFrame:
        return spark.read.parquet(*[f"{folder}/{table}_total/{base}"] * (base is not None), *[f"{folder}/{table}/{b}" for b in since])

    return _sum_nodes(all_of("nodes")), _sum_edges(all_of("edges"))


def merged_graph(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """nodes and edges of all batches so far, as ``graph.build_graph`` gives them. An error where there are none."""
    done = _done(spark, folder)
    if not done:
        raise ValueError(f"no batch was merged in {folder}")
    base = _marker(spark, folder, done[-1])["base"]
    return _totals(spark, folder, base, [b for b in done if base is None or b > base])
