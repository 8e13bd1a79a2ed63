"""What the operators of this subpackage share: word rule, shared-folder tables, scalable prefix sums."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: A word is a run of characters other than space and the five ASCII controls 09-0D (Java regex).
SPACE_RUN = r"[\x20\x09-\x0D]+"
WORD_CHAR = r"[^\x20\x09-\x0D]"

#: Rows up to which a side whose size was counted may be broadcast (a row here is at most 64 bytes).
BROADCAST_ROWS = 100_000


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table by its directory, through Spark's own reader only."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir; where it is unset, a temporary one on a local master, else an error."""
    sc = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if configured:
        return configured.rstrip("/")
    current = sc._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get().rstrip("/")
    if not sc.master.startswith("local[") and sc.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    made = f"file://{tempfile.mkdtemp(prefix='pathloom-')}"
    sc.setCheckpointDir(made)
    return made


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing else uses."""
    return f"{shared_dir(spark)}/pathloom-{name}-{uuid.uuid4().hex}"


def remove_path(spark: SparkSession, path: str) -> None:
    """Delete a shared path through the file system that it belongs to."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def stored(df: DataFrame, name: str) -> DataFrame:
    """The rows written as Parquet in the shared folder and read again.

    This cuts the lineage, survives the loss of an executor and gives the optimizer the true size.
    """
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    again = df.sparkSession.read.schema(df.schema).parquet(path)
    again._pathloom_path = path  # type: ignore[attr-defined]
    return again


def dropped(df: DataFrame) -> None:
    """Delete the files behind a frame made by ``stored``."""
    remove_path(df.sparkSession, df._pathloom_path)  # type: ignore[attr-defined]


def shuffled(df: DataFrame) -> DataFrame:
    """``df`` with a hint by which its join is shuffled, whatever Spark takes its size to be.

    Spark takes exploded rows for as many as before and stored ones for as large as their files, so that it would
    broadcast tables that grow with the input, and the driver holds what is broadcast.
    """
    return df.hint("merge")


def small_side(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``limit`` rows; else for a shuffled join.

    ``df`` should be stored, as its rows are counted here.
    """
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else shuffled(df)


def renamed(docs: DataFrame, replaced: Sequence[str]) -> tuple[DataFrame, dict[str, str], dict[str, str]]:
    """The rows with columns c0, c1, ..., the names of those that stay by their new ones, and the new names by the old.

    Columns named in ``replaced`` don't stay. So no name of the input, dotted or not, meets one that a method uses.
    """
    at = {n: f"c{i}" for i, n in enumerate(docs.columns)}
    return docs.toDF(*at.values()), {c: n for n, c in at.items() if n not in replaced}, at


def word_count(text: Column) -> Column:
    """Number of words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(f"{WORD_CHAR}+")), F.lit(0)).cast("long")


def spread(*columns: Column) -> Column:
    """A double in [0, 1) from a hash of the columns: a fixed pseudo-random order of rows."""
    return F.shiftrightunsigned(F.xxhash64(*columns), 11).cast("double") / F.lit(float(2**53))


#: Copies of a row that one row of the first step of ``unfolded`` stands for.
FOLD = 4096


def folded(df: DataFrame, name: str) -> DataFrame:
    """The distinct rows, stored, with their number as _copies, combined on the map side.

    A row that is repeated very often is one row so. Rows with maps or variants can't be compared; they stay
    one by one.
    """
    if any(x in df.schema.simpleString() for x in ("map<", "variant")):
        return stored(df.withColumn("_copies", F.lit(1).cast("long")), name)
    return stored(df.groupBy(*[F.col(f"`{c}`") for c in df.columns]).agg(F.count(F.lit(1)).alias("_copies")), name)


def unfolded(df: DataFrame) -> DataFrame:
    """Each row as often as _copies says, with _copy from 0; _copies goes. Many copies are made in steps, so that no long array is held."""
    names = [c for c in df.columns if c != "_copies"]
    blocks = df.select(*names, "_copies", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_copies") - 1, F.lit(FOLD).cast("long"))).alias("_block"))
    return blocks.select(*names, F.explode(F.sequence(F.col("_block"), F.least(F.col("_block") + (FOLD - 1), F.col("_copies") - 1))).alias("_copy"))


def running_sums(
    df: DataFrame,
    group: Sequence[str],
    place: str,
    values: Sequence[str],
    ties: Sequence[str] = (),
    rows_per_bucket: int = 1024,
) -> DataFrame:
    """Adds, for each value column v, ``before_v`` (sum over earlier rows of the group) and ``total_v``.

    ``place`` is a double in [0, 1) that orders the rows of a group and spreads them evenly, as
    ``spread`` gives; ``ties`` break equal places. A group of any size is cut by ``place`` into
    buckets of about ``rows_per_bucket`` rows, and these into about the square root of their number
    of ranges. Only one bucket, one range or the ranges of one group meet in a task, so that a group
    with a third of all rows is no hot spot. Null group keys form a group. No rows are lost.
    """
    out = [c for c in df.columns]
    keys = [F.col(c) for c in group]
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), *[F.sum(v).alias(f"total_{v}") for v in values])
    sizes = sizes.withColumn("_fine", F.ceil(F.col("_n") / rows_per_bucket)).withColumn("_wide", F.ceil(F.sqrt("_fine")))
    d, s = df.alias("d"), sizes.alias("s")
    same = F.lit(True)
    for c in group:
        same = same & F.col(f"d.{c}").eqNullSafe(F.col(f"s.{c}"))
    cut = d.join(s, same).select(*[F.col(f"d.{c}") for c in out], *[F.col(f"total_{v}") for v in values], F.floor(F.col(f"d.{place}") * F.col("_fine")).alias("_b"), F.floor(F.col(f"d.{place}") * F.col("_wide")).alias("_a"))
    fine = cut.groupBy(*keys, "_a", "_b").agg(*[F.sum(v).alias(f"_{v}") for v in values])
    wide = fine.groupBy(*keys, "_a").agg(*[F.sum(f"_{v}").alias(f"_{v}") for v in values])
    zero = F.lit(0)

    def over(by: list, order: list, suffix: str, source: str) -> list[Column]:
        w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
        return [F.coalesce(F.sum(source.format(v)).over(w), zero).alias(f"_{suffix}_{v}") for v in values]

    wide = wide.select(*keys, "_a", *over(keys, [F.col("_a")], "w", "_{}"))
    fine = fine.select(*keys, "_a", "_b", *over([*keys, F.col("_a")], [F.col("_b")], "f", "_{}"))
    f, w = fine.alias("f"), wide.alias("w")
    same = F.col("f._a") == F.col("w._a")
    for c in group:
        same = same & F.col(f"f.{c}").eqNullSafe(F.col(f"w.{c}"))
    starts = f.join(w, same).select(*[F.col(f"f.{c}") for c in group], F.col("f._a"), F.col("f._b"), *[(F.col(f"_w_{v}") + F.col(f"_f_{v}")).alias(f"_start_{v}") for v in values])
    inner = cut.select("*", *over([*keys, F.col("_a"), F.col("_b")], [F.col(place), *[F.col(t) for t in ties]], "in", "{}"))
    i, t = inner.alias("i"), starts.alias("t")
    same = (F.col("i._a") == F.col("t._a")) & (F.col("i._b") == F.col("t._b"))
    for c in group:
        same = same & F.col(f"i.{c}").eqNullSafe(F.col(f"t.{c}"))
    return i.join(t, same).select(*[F.col(f"i.{c}") for c in out], *[(F.col(f"_start_{v}") + F.col(f"_in_{v}")).alias(f"before_{v}") for v in values], *[F.col(f"total_{v}") for v in values])
