"""The library of known flows, kept in a folder as versions of a table and changed run by run.

A run compares newly mined flows with the current version and writes the next one: flows that occur are entered, changed
or confirmed, active ones that no longer occur become inactive, all others stay as they are. A version becomes current
by its manifest, a small file that is renamed into place last, so readers see the version before or the one after, and a
run that was aborted leaves nothing that counts; it is simply repeated. One run writes at a time.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from pathloom.operators.compare import compared
from pathloom.session import delete_folder, entries, read_text, write_text

#: So many versions are kept; older ones are deleted after a run.
KEEP = 3
#: Columns that the library adds to those of a flow.
OWN = ["status", "result", "first_run", "changed_run", "seen_run"]


def versions(spark: SparkSession, folder: str) -> list[int]:
    """The runs whose versions can be read, the current one last."""
    return sorted(int(n.removesuffix(".json")) for n in entries(spark, f"{folder}/manifests") if n.endswith(".json"))


def _manifest(spark: SparkSession, folder: str, run: int) -> dict:
    return json.loads(read_text(spark, f"{folder}/manifests/{run}.json"))


def library(spark: SparkSession, folder: str, run: int | None = None) -> DataFrame:
    """The flows of the library as they stood after ``run``, by default the last one; an error where there is none.

    To the flow's columns it adds status (active, inactive or what the user set), result (of the last run: new, changed,
    unchanged, inactive, or kept where the run didn't touch the flow), and the runs in which the flow was entered,
    last changed and last seen.
    """
    known = versions(spark, folder)
    if not known or (run is not None and run not in known):
        raise ValueError(f"{folder} has no version {'' if run is None else run}, but {known}")
    m = _manifest(spark, folder, known[-1] if run is None else run)
    return spark.read.schema(StructType.fromJson(m["schema"])).parquet(f"{folder}/{m['rows']}")


def next_version(new: DataFrame, old: DataFrame, run: int, order: str = "ord") -> DataFrame:
    """The library ``old`` after ``run`` has mined ``new``; one row for each pattern.

    Of several new flows of a pattern the last counts. A flow that occurs takes the new flow's columns and is active,
    but keeps a status that is neither active nor inactive. Flows without a pattern can't be found again: they are
    left out.
    """
    fields = [c for c in old.columns if c not in OWN]
    rows = compared(new.where("canonical_pattern is not null"), old, order).withColumn("result", F.coalesce("status", F.lit("kept")))
    n, o, now = F.col("new_flow"), F.col("existing_flow"), F.lit(run).cast("long")
    seen = n.isNotNull()
    status = F.when(seen, F.when(~o["status"].isin("active", "inactive"), o["status"]).otherwise("active")).when(F.col("result") == "inactive", "inactive").otherwise(o["status"])
    return rows.select(
        *[F.when(seen, n[c]).otherwise(o[c]).alias(c) for c in fields], status.alias("status"), "result", F.coalesce(o["first_run"], now).alias("first_run"),
        F.when(F.col("result").isin("new", "changed"), now).otherwise(o["changed_run"]).alias("changed_run"), F.when(seen, now).otherwise(o["seen_run"]).alias("seen_run"),
    )


def update_library(folder: str, new: DataFrame, run: int, order: str = "ord", keep: int = KEEP) -> bool:
    """Applies a run's mined flows to the library in ``folder``; False if it has applied this run before.

    ``new`` has canonical_pattern, significant_actions and ``order``; its other columns are kept too. Runs have rising
    numbers and the same columns. The first run makes the library; an empty ``new`` makes all active flows inactive.
    """
    spark, known = new.sparkSession, versions(new.sparkSession, folder)
    if run in known:
        return False
    if known and run < known[-1]:
        raise ValueError(f"run {run} comes after run {known[-1]}")
    clash = [c for c in new.columns if c in OWN]
    if clash:
        raise ValueError(f"the library has columns {clash} of its own")
    if known:
        old = library(spark, folder)
        other = set(new.columns) ^ (set(old.columns) - set(OWN))
        if other:
            raise ValueError(f"the library and the run don't both have {sorted(other)}")
    else:
        old = new.limit(0).select("*", *[F.lit(None).cast("string").alias(c) for c in OWN[:2]], *[F.lit(None).cast("long").alias(c) for c in OWN[2:]])
    # a name of its own for each attempt: what an aborted one wrote is never read
    out, name = next_version(new, old, run, order), f"rows/{run}-{uuid.uuid4().hex}"
    out.write.parquet(f"{folder}/{name}")
    write_text(spark, f"{folder}/manifests/{run}.json", json.dumps({"rows": name, "schema": out.schema.jsonValue()}))
    for past in known[: max(len(known) + 1 - keep, 0)]:
        delete_folder(spark, f"{folder}/manifests/{past}.json")
    live = {_manifest(spark, folder, r)["rows"].removeprefix("rows/") for r in versions(spark, folder)}
    for left in entries(spark, f"{folder}/rows"):
        if left not in live:
            delete_folder(spark, f"{folder}/rows/{left}")
    return True
