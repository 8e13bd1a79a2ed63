"""Deterministic sharded WARC archives.

Records are range-sorted by key into shards whose bounds depend on the data only. Each shard is written
in order to gzip members, a new file beginning when the last has reached a compressed size. Lengths and
digests are made anew from the payloads. Files are written under temporary names and renamed when
complete; the manifest, written last, names the files that count. Equal payloads are written once;
later records of theirs are revisits.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pathloom.llm.common import small_side, spread, stored

#: Payload bytes of a shard at least; shards at most.
SHARD_BYTES, SHARDS = 32 << 20, 65_536
#: A file is closed after this share of a shard's mean payload bytes, compressed, and so many bytes at least.
ROLL_SHARE, ROLL_LEAST = 16, 1 << 20
#: Sampled keys per shard from which the bounds are taken.
SAMPLE_KEYS = 20
LEVEL = 6
DATE = "2000-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def digest32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _line(value: str | None) -> str:
    """A header value on one line."""
    return " ".join((value or "").split())


def record(kind: str, key: int | None, url: str | None, payload: bytes, digest: str, size: int, refers: int | None) -> bytes:
    """One WARC record, headers made anew."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http + payload if kind == "response" else http
    fields = [
        ("WARC-Type", kind), ("WARC-Record-ID", f"<urn:page:{'' if key is None else key}>"), ("WARC-Date", DATE), ("WARC-Target-URI", _line(url) or "urn:page"),
        ("WARC-Payload-Digest", f"sha1:{digest}"), ("WARC-Block-Digest", f"sha1:{digest32(block)}"), ("X-Payload-Length", str(size)),
    ]
    if kind == "revisit":
        fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", f"<urn:page:{refers}>")]
    fields += [("Content-Type", "application/http;msgtype=response"), ("Content-Length", str(len(block)))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields).encode() + b"\r\n" + block + b"\r\n\r\n"


def info(name: str) -> bytes:
    """The record at the start of a file."""
    block = b"software: pathloom\r\nformat: WARC File Format 1.1\r\n"
    fields = f"WARC-Type: warcinfo\r\nWARC-Record-ID: <urn:file:{name}>\r\nWARC-Date: {DATE}\r\nWARC-Filename: {name}\r\nWARC-Block-Digest: sha1:{digest32(block)}\r\nContent-Type: application/warc-fields\r\nContent-Length: {len(block)}\r\n"
    return b"WARC/1.1\r\n" + fields.encode() + b"\r\n" + block + b"\r\n\r\n"


def member(data: bytes, level: int = LEVEL) -> bytes:
    """A gzip member without a time stamp."""
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


class Roller:
    """Writes a shard's records to files under temporary names; each is renamed when it is complete."""

    def __init__(self, folder: str, shard: int, roll_bytes: int):
        from pyarrow import fs

        self.fs, self.folder = fs.FileSystem.from_uri(folder)
        self.shard, self.roll_bytes, self.turn, self.out = shard, roll_bytes, 0, None
        self.done: list[dict] = []

    def write(self, data: bytes, payload: int) -> None:
        if self.out is None:
            self.name = f"shard-{self.shard:05d}-{self.turn:05d}.warc.gz"
            self.temporary = f"{self.folder}/_temporary/{uuid.uuid4().hex}"
            self.fs.create_dir(f"{self.folder}/_temporary", recursive=True)
            self.out, self.sha = self.fs.open_output_stream(self.temporary, compression=None), hashlib.sha1()
            self.size = self.records = self.payload = 0
            self._put(member(info(self.name)))
        self._put(member(data))
        self.records, self.payload = self.records + 1, self.payload + payload
        if self.size >= self.roll_bytes:
            self.close()

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.sha.update(data)
        self.size += len(data)

    def close(self) -> None:
        if self.out is None:
            return
        self.out.close()
        final = f"{self.folder}/{self.name}"
        try:
            self.fs.move(self.temporary, final)
        except OSError:
            # a file system that doesn't rename over an earlier attempt's file of the same content
            self.fs.delete_file(final)
            self.fs.move(self.temporary, final)
        self.done.append({"shard": self.shard, "file": self.name, "records": self.records, "bytes": self.size, "payload_bytes": self.payload, "sha1": self.sha.hexdigest()})
        self.turn, self.out = self.turn + 1, None


MANIFEST = "shard int, file string, records long, bytes long, payload_bytes long, sha1 string"


def bounds(facts: DataFrame, key: str, shard_bytes: int = SHARD_BYTES, shards: int = SHARDS) -> tuple[np.ndarray, int]:
    """First keys of all shards but the first, and the mean payload bytes of a shard.

    The keys are quantiles by bytes of a hash sample of the keys, the same for the same rows. The sample grows with the
    number of shards only.
    """
    n, total = facts.agg(F.count(F.lit(1)), F.sum("_size")).first()
    wanted = int(min(shards, max(1, -(-(total or 0) // shard_bytes)), max(1, n)))
    mean = (total or 0) // wanted
    if wanted == 1:
        return np.zeros(0, np.int64), mean
    rate = min(1.0, wanted * SAMPLE_KEYS / n)
    sample = facts.where(F.col(key).isNotNull() & (spread(F.col(key), F.lit("bounds")) < rate)).select(key, "_size").toPandas().sort_values([key, "_size"])
    keys, bytes_before = sample[key].to_numpy(np.int64), sample["_size"].cumsum().to_numpy(np.int64)
    if not len(keys):
        return np.zeros(0, np.int64), mean
    at = np.searchsorted(bytes_before, [bytes_before[-1] * i // wanted for i in range(1, wanted)], side="right")
    return np.unique(keys[np.minimum(at, len(keys) - 1)]), mean


def write(pages: DataFrame, folder: str, key: str = "page_id", url: str = "url", payload: str = "html", min_bytes: int = 0, roll_bytes: int | None = None, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Writes the archives and the manifest under ``folder``; returns the manifest.

    Null payloads are empty ones. Of records with equal payloads of at least ``min_bytes`` the one with
    the largest key is the response (repeated rows with that key are responses too) and the others are
    revisits; null keys count as smaller than all others and are dealt to shards by their digests. A file is closed
    after ``roll_bytes`` compressed bytes, by default a sixteenth of a shard's payload. Extra columns are left out. A
    task that is run again writes the same files; an empty table gives an empty manifest. Payloads are shuffled once,
    to their shards; which of them are revisits is found by keys and digests alone and joined there, so that a payload
    that a third of all pages have is no hot spot. ``folder`` must be one that all executors reach through
    pyarrow's file systems.
    """
    spark = pages.sparkSession
    body = F.coalesce(F.col(payload), F.lit(""))
    rows = pages.select(F.col(key).cast("long").alias("_key"), F.col(url).cast("string").alias("_url"), body.alias("_body"), F.sha1(body).alias("_sha"))
    facts = stored(rows.select("_key", "_sha", F.octet_length("_body").cast("long").alias("_size")), "facts")
    long_enough = facts.where(F.col("_size") >= min_bytes)
    twice = stored(long_enough.groupBy("_sha").agg(F.max("_key").alias("_kept"), F.count(F.lit(1)).alias("_n")).where("_n > 1 and _kept is not null").select("_sha", "_kept"), "twice")
    first, mean = bounds(facts, "_key", shard_bytes)
    cuts, roll = first.tolist(), roll_bytes or max(ROLL_LEAST, mean // ROLL_SHARE)

    @F.pandas_udf("int")
    def shard(k: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(np.array(cuts, np.int64), k.fillna(-(2**63)).to_numpy(np.int64), side="right").astype(np.int32))

    spare = F.pmod(F.xxhash64("_sha"), F.lit(len(cuts) + 1)).cast("int")
    place = F.when(F.col("_key").isNull(), spare).otherwise(shard("_key")) if cuts else F.lit(0)
    # a mark goes before the records of its key and digest
    marks = long_enough.select("_key", "_sha").distinct().join(small_side(twice), "_sha").where(~F.col("_kept").eqNullSafe(F.col("_key")))
    marks = marks.select(place.alias("_shard"), "_key", "_sha", F.lit(0).alias("_kind"), F.lit(None).cast("string").alias("_url"), F.lit(None).cast("string").alias("_body"), "_kept")
    records = rows.select(place.alias("_shard"), "_key", "_sha", F.lit(1).alias("_kind"), "_url", "_body", F.lit(None).cast("long").alias("_kept"))
    dealt = marks.unionByName(records).repartitionById(len(cuts) + 1, F.col("_shard")).sortWithinPartitions("_shard", "_key", "_sha", "_kind", "_url")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        roller: Roller | None = None
        mark: tuple | None = None
        done: list[dict] = []
        for b in batches:
            for n, k, sha, is_record, u, x, refers in zip(*[b.column(i).to_pylist() for i in range(5)], b.column(5), b.column(6).to_pylist(), strict=True):
                if not is_record:
                    mark = (k, sha, refers)
                    continue
                refers = mark[2] if mark and mark[:2] == (k, sha) else None
                if roller is None or roller.shard != n:
                    if roller:
                        roller.close()
                        done += roller.done
                    roller = Roller(folder, n, roll)
                data = x.as_py().encode("utf-8", "surrogatepass")
                kind = "response" if refers is None else "revisit"
                roller.write(record(kind, k, u, data, digest32(data), len(data), refers), len(data))
        if roller:
            roller.close()
            done += roller.done
        yield pa.RecordBatch.from_pylist(done, schema=pa.schema([("shard", pa.int32()), ("file", pa.string()), ("records", pa.int64()), ("bytes", pa.int64()), ("payload_bytes", pa.int64()), ("sha1", pa.string())]))

    dealt.mapInArrow(run, MANIFEST).write.mode("overwrite").json(f"{folder}/manifest")
    return manifest(spark, folder)


def manifest(spark: SparkSession, folder: str) -> DataFrame:
    """The files that count, one row each. It exists only after all of them are complete."""
    return spark.read.schema(MANIFEST).json(f"{folder}/manifest")


def parse(stream, size: int = 1 << 20) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of each record of a gzip stream, read in pieces."""
    z, data, ended = zlib.decompressobj(47), bytearray(), False
    pending = b""

    def more() -> bool:
        nonlocal z, pending, ended
        while not ended:
            if not pending:
                pending = stream.read(size)
                if not pending:
                    ended = True
                    return False
            got = z.decompress(pending)
            pending = z.unused_data
            if z.eof:
                z = zlib.decompressobj(47)
            data.extend(got)
            if got:
                return True
        return False

    while True:
        while (at := data.find(b"\r\n\r\n")) < 0:
            if not more():
                if data.strip():
                    raise ValueError("a record is cut off")
                return
        lines = bytes(data[:at]).decode().split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError("not a WARC record")
        headers = dict(x.split(": ", 1) for x in lines[1:])
        end = at + 4 + int(headers["Content-Length"])
        while len(data) < end + 4:
            if not more():
                raise ValueError("a record is cut off")
        yield headers, bytes(data[at + 4 : end])
        del data[: end + 4]


def read_back(spark: SparkSession, folder: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of every record in the manifest's files.

    Block digests, payload digests and lengths are checked against the bytes; a mismatch is an error. An empty manifest
    gives no rows.
    """
    files = manifest(spark, folder).select("file")
    n = max(1, min(files.count(), SHARDS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        system, base = fs.FileSystem.from_uri(folder)
        names = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])
        for b in batches:
            for name in b.column(0).to_pylist():
                out: list[dict] = []
                with system.open_input_stream(f"{base}/{name}", compression=None) as stream:
                    for headers, block in parse(stream):
                        kind = headers["WARC-Type"]
                        if headers["WARC-Block-Digest"] != f"sha1:{digest32(block)}":
                            raise ValueError(f"{name}: block digest of {headers['WARC-Record-ID']}")
                        if kind == "warcinfo":
                            continue
                        payload = block[block.index(b"\r\n\r\n") + 4 :]
                        digest, size = headers["WARC-Payload-Digest"].removeprefix("sha1:"), int(headers["X-Payload-Length"])
                        if kind == "response" and (digest32(payload) != digest or len(payload) != size):
                            raise ValueError(f"{name}: payload of {headers['WARC-Record-ID']}")
                        own, other = (headers.get(h, "").removeprefix("<urn:page:").rstrip(">") for h in ("WARC-Record-ID", "WARC-Refers-To"))
                        out.append({"page_id": int(own) if own else None, "payload_bytes": size, "payload_digest": digest, "record_type": kind, "refers_to": int(other) if other else None})
                        if len(out) == 5000:
                            yield pa.RecordBatch.from_pylist(out, schema=names)
                            out = []
                yield pa.RecordBatch.from_pylist(out, schema=names)

    return files.repartition(n).mapInArrow(run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")
