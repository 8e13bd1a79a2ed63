"""Spark session factory for local runs; on a cluster the caller's session is used as it is."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str | None = None, name: str = "pathloom") -> SparkSession:
    """A local session with UTC time, adaptive execution and as many shuffle partitions as cores."""
    n = str(cores or os.environ.get("BENCH_CPUS") or 8)
    return (
        SparkSession.builder.master(f"local[{n}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", n if n.isdigit() else "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("PATHLOOM_DRIVER_MEMORY", "8g"))
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str):
    """One of the driver tables. The path may be of any store that Spark reads."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which all executors share.

    Where it is unset, a local session gets a temporary one; others raise an error.
    """
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        if not folder and not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="pathloom-"))
    return (folder or sc._jsc.sc().getCheckpointDir().get()).rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing else uses."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def _store(spark: SparkSession, name: str):
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
    return path, path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def entries(spark: SparkSession, folder: str) -> list[str]:
    """The names in a folder of any file system; none where it doesn't exist."""
    path, store = _store(spark, folder)
    return [s.getPath().getName() for s in store.listStatus(path)] if store.exists(path) else []


def read_text(spark: SparkSession, name: str) -> str:
    """The text of a small file of any file system."""
    path, store = _store(spark, name)
    source = store.open(path)
    try:
        return bytes(source.readAllBytes()).decode()
    finally:
        source.close()


def write_text(spark: SparkSession, name: str, text: str) -> None:
    """Writes a small file under a temporary name and renames it, so that it is there whole or not at all; an error if the name is taken."""
    path, store = _store(spark, name)
    temporary, _ = _store(spark, f"{name}.{uuid.uuid4().hex}.tmp")
    out = store.create(temporary, False)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    if store.exists(path) or not store.rename(temporary, path):
        store.delete(temporary, False)
        raise FileExistsError(f"{name} was written by another run")


def delete_folder(spark: SparkSession, name: str) -> None:
    """Deletes a file or folder of any file system with all in it, if it exists."""
    path, store = _store(spark, name)
    store.delete(path, True)


def written(df: DataFrame) -> DataFrame:
    """The rows, checkpointed in the shared folder, so that plans built on them stay small and survive lost executors."""
    shared_folder(df.sparkSession)
    return df.checkpoint()
