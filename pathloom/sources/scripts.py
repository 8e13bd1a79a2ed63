"""Script files as a Spark data source: rows of names and texts in, one set of files out, and back.

    spark.dataSource.register(ScriptSource)
    scripts.write.format("scripts").mode("overwrite").save(folder)
    spark.read.format("scripts").load(folder)

Each task writes its files, as one compressed tar archive, to a folder of its own attempt, with the archive's size and
digest: a script has a few hundred bytes, and as a file of its own would take a block of the disk and an inode, as would
its folder. The job's commit makes a version of the attempts that succeeded, by one small manifest that is renamed into
place; until then a reader sees the version before. So tasks that failed, were repeated or ran twice leave nothing that
counts, and the commit deletes it. Neither texts nor names pass through the driver: a task's message has its folder and
two sums.

Folders are of any file system that Arrow reads, and shared by all executors. One job writes to a folder at a time.
"""

from __future__ import annotations

import gzip
import hashlib
import json
import posixpath
import tarfile
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

from pyarrow import fs as stores
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

SCHEMA = "file_name string, content string"
MANIFESTS, ATTEMPTS, ARCHIVE, LIST = "_versions", "_attempts", "scripts.tar.gz", "_files.json"


@dataclass
class Written(WriterCommitMessage):
    """What a task tells the driver: its attempt's folder and sums."""

    attempt: str
    files: int
    size: int


@dataclass
class Attempt(InputPartition):
    attempt: str


def opened(folder: str) -> tuple[stores.FileSystem, str]:
    """The file system of a path or URI and the path in it; ``file:/x`` is read as ``file:///x``."""
    if folder.startswith("file:") and not folder.startswith("file://"):
        folder = "file://" + folder.removeprefix("file:")
    return stores.FileSystem.from_uri(folder)


def names(store: stores.FileSystem, folder: str) -> list[str]:
    return [x.base_name for x in store.get_file_info(stores.FileSelector(folder, allow_not_found=True))]


def put(store: stores.FileSystem, path: str, data: bytes) -> None:
    with store.open_output_stream(path) as out:
        out.write(data)


def get(store: stores.FileSystem, path: str) -> bytes:
    with store.open_input_stream(path) as source:
        return source.read()


def digest(store: stores.FileSystem, path: str) -> list:
    """The size of a file and its digest, read in pieces."""
    size, sha = 0, hashlib.sha256()
    with store.open_input_stream(path, compression=None) as source:
        while part := source.read(2**20):
            size += len(part)
            sha.update(part)
    return [size, sha.hexdigest()]


def member(name: str, data: bytes) -> bytes:
    """A file as it stands in a tar archive."""
    info = tarfile.TarInfo(name)
    info.size = len(data)
    return info.tobuf(tarfile.PAX_FORMAT) + data + bytes(-len(data) % tarfile.BLOCKSIZE)


def checked(name: object) -> str:
    """A file name that stays in its folder: parts of a relative path, none of them empty, hidden or leading up."""
    parts = str(name).split("/") if name is not None else []
    if not parts or any(p in ("", ".", "..") or p.startswith("_") or "\\" in p or "\0" in p for p in parts):
        raise ValueError(f"not a name for a script: {name!r}")
    return str(name)


def current(store: stores.FileSystem, root: str) -> dict | None:
    """The newest version's manifest, if there is one."""
    known = sorted(n for n in names(store, posixpath.join(root, MANIFESTS)) if n.endswith(".json"))
    return json.loads(get(store, posixpath.join(root, MANIFESTS, known[-1]))) if known else None


class ScriptWriter(DataSourceWriter):
    def __init__(self, folder: str, schema: StructType, overwrite: bool):
        missing = {"file_name", "content"} - set(schema.fieldNames())
        if missing:
            raise ValueError(f"scripts need columns {sorted(missing)}")
        self.folder, self.overwrite, self.job = folder, overwrite, uuid.uuid4().hex

    def write(self, iterator: Iterator) -> Written:
        store, root = opened(self.folder)
        attempt = f"{self.job}-{uuid.uuid4().hex}"
        here, rows = posixpath.join(root, ATTEMPTS, attempt), iter(iterator)
        first = next(rows, None)
        if first is None:
            return Written(attempt, 0, 0)
        store.create_dir(here, recursive=True)
        path, taken, size = posixpath.join(here, ARCHIVE), set(), 0
        with store.open_output_stream(path, compression=None) as out, gzip.GzipFile("", "wb", 6, out, 0) as packed:
            for row in chain([first], rows):
                name, data = checked(row["file_name"]), (row["content"] or "").encode()
                if name in taken:
                    raise ValueError(f"two scripts are named {name}")
                packed.write(member(name, data))
                taken.add(name)
                size += len(data)
            packed.write(bytes(2 * tarfile.BLOCKSIZE))
        put(store, posixpath.join(here, LIST), json.dumps({ARCHIVE: digest(store, path)}).encode())
        return Written(attempt, len(taken), size)

    def commit(self, messages: list[Written | None]) -> None:
        """Makes the attempts of ``messages`` the current version, or adds them to it, then deletes what no version names."""
        store, root = opened(self.folder)
        old = current(store, root)
        done = [m for m in messages if m is not None and m.files]
        kept = old["attempts"] if old and not self.overwrite else []
        number = old["version"] + 1 if old else 1
        total = {k: sum(getattr(m, k) for m in done) + (old[k] if kept else 0) for k in ("files", "size")}
        path = posixpath.join(root, MANIFESTS, f"{number:012}.json")
        store.create_dir(posixpath.dirname(path), recursive=True)
        put(store, f"{path}.{self.job}", json.dumps({"version": number, **total, "attempts": kept + sorted(m.attempt for m in done)}).encode())
        if store.get_file_info(path).type != stores.FileType.NotFound:
            store.delete_file(f"{path}.{self.job}")
            raise FileExistsError(f"another job wrote version {number} of {self.folder}")
        store.move(f"{path}.{self.job}", path)
        self.clear(store, root, {*kept, *(m.attempt for m in done)})
        for name in names(store, posixpath.dirname(path)):
            if name != posixpath.basename(path):
                store.delete_file(posixpath.join(root, MANIFESTS, name))

    def abort(self, messages: list[Written | None]) -> None:
        """Deletes this job's attempts; the version before stays."""
        store, root = opened(self.folder)
        self.clear(store, root, {a for a in names(store, posixpath.join(root, ATTEMPTS)) if not a.startswith(self.job)})

    @staticmethod
    def clear(store: stores.FileSystem, root: str, live: set[str]) -> None:
        for name in names(store, posixpath.join(root, ATTEMPTS)):
            if name not in live:
                store.delete_dir(posixpath.join(root, ATTEMPTS, name))


class ScriptReader(DataSourceReader):
    """A partition for each attempt of the current version."""

    def __init__(self, folder: str):
        self.folder = folder

    def partitions(self) -> list[Attempt]:
        manifest = current(*opened(self.folder))
        if manifest is None:
            raise ValueError(f"{self.folder} has no scripts")
        return [Attempt(a) for a in manifest["attempts"]] or [Attempt("")]

    def read(self, partition: Attempt) -> Iterator[tuple[str, str]]:
        if not partition.attempt:
            return
        store, root = opened(self.folder)
        here = posixpath.join(root, ATTEMPTS, partition.attempt)
        listed = json.loads(get(store, posixpath.join(here, LIST)))
        for name in sorted({*names(store, here), ARCHIVE} - {LIST}):
            if name not in listed or digest(store, posixpath.join(here, name)) != listed[name]:
                raise ValueError(f"{name} isn't what was written")
        with store.open_input_stream(posixpath.join(here, ARCHIVE), compression=None) as source, gzip.GzipFile(fileobj=source) as packed, tarfile.open(fileobj=packed, mode="r|") as files:
            while (file := files.next()) is not None:
                yield file.name, files.extractfile(file).read().decode()
                files.members = []  # or it keeps them all


class ScriptSource(DataSource):
    """``scripts``: columns file_name and content; others are left out when written, a null content is an empty file.

    A name that is null, empty, absolute, hidden or leads out of the folder is an error, as are two equal names in a
    task; ``save_scripts`` deals rows by name, so that equal ones meet. Appending doesn't look for names written before.
    """

    @classmethod
    def name(cls) -> str:
        return "scripts"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> ScriptReader:
        return ScriptReader(self.options["path"])

    def writer(self, schema: StructType, overwrite: bool) -> ScriptWriter:
        return ScriptWriter(self.options["path"], schema, overwrite)


def save_scripts(scripts: DataFrame, folder: str, mode: str = "overwrite") -> None:
    """Writes scripts, dealt by their names, so that equal names meet in a task and are refused."""
    spark = scripts.sparkSession
    spark.dataSource.register(ScriptSource)
    scripts.select("file_name", "content").repartition("file_name").write.format("scripts").mode(mode).save(folder)


def load_scripts(spark: SparkSession, folder: str) -> DataFrame:
    """(file_name, content) of the scripts in a folder."""
    spark.dataSource.register(ScriptSource)
    return spark.read.format("scripts").load(folder)
