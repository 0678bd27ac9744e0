"""WARC: a deterministic sharded writer of gzip-member archives, and their reader.

Records are range-partitioned by page id at boundaries that depend on the table alone (quantiles, by bytes, of
the ids of least hash), sorted within a shard, and written to files that roll by compressed size.  Each
task attempt writes under a name of its own; the manifest of files is a Spark table, so it holds the attempts
that won and no others, and only those are renamed to their final names.  A lost executor repeats its shards and
leaves nothing but a temporary file.  Rerunning over the same rows gives byte-identical archives.

Headers, record ids and digests are made anew from the payload.  Records of one payload of ``revisit_bytes`` or more
become one response (largest page id) and revisits that refer to it.  Only narrow columns decide that: html is
shuffled once, to its shard, where the revisit notes meet it by merge order, not by a join.

Rows: a null html is an empty payload; a null url gives a record without target; null ids sort first, are written without id and
never are the response that others refer to if any id is there; of repeated rows with the same id and payload, one is the response.  A payload of any length is one
record, and other columns aren't read.  An empty table gives no files.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import Scratch, small_batches

MANIFEST = "shard long, part long, temp string, name string, records long, bytes long, sha1 string, first_id long, last_id long"
RECORDS = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


@dataclass(frozen=True)
class WarcParams:
    shard_bytes: int = 32 << 20
    file_bytes: int = 4 << 20
    revisit_bytes: int = 1000
    #: boundaries are taken from about this many ids
    boundary_ids: int = 20_000
    date: str = "1970-01-01T00:00:00Z"
    level: int = 6


def record_id(page_id: int | None, digest: bytes) -> str:
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.sha1(f'{page_id}|'.encode() + digest).digest()[:16], version=5)}>"


def _sha1(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, p: WarcParams) -> bytes:
    """One uncompressed record; ``refers_to`` makes it a revisit."""
    digest = hashlib.sha1(payload).digest()
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {record_id(page_id, digest)}", f"WARC-Date: {p.date}"]
    if url is not None:
        head.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    head += [f"WARC-Payload-Digest: sha1:{base64.b32encode(digest).decode()}", f"WARC-Block-Digest: {_sha1(block)}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", f"X-Payload-Bytes: {len(payload)}"]
    if page_id is not None:
        head.append(f"X-Page-Id: {page_id}")
    if refers_to is not None:
        head += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: {record_id(refers_to, digest)}", f"X-Refers-To-Page: {refers_to}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _member(data: bytes, level: int) -> bytes:
    z = zlib.compressobj(level, zlib.DEFLATED, 31)  # a gzip member; no time in its header
    return z.compress(data) + z.flush()


class _Roller:
    """Writes the files of one shard."""

    def __init__(self, root: str, shard: int, p: WarcParams):
        self.fs, self.root = pafs.FileSystem.from_uri(root)
        self.shard, self.p, self.attempt, self.part, self.out, self.done = shard, p, uuid.uuid4().hex, 0, None, []

    def add(self, page_id: int | None, data: bytes) -> None:
        member = _member(data, self.p.level)
        if self.out is not None and self.size + len(member) > self.p.file_bytes:
            self.close()
        if self.out is None:
            self.name = f"records-{self.shard:06d}-{self.part:05d}.warc.gz"
            self.temp = f"_temporary/{self.name}.{self.attempt}"
            self.out, self.size, self.records, self.hash, self.first = self.fs.open_output_stream(f"{self.root}/{self.temp}", compression=None), 0, 0, hashlib.sha1(), page_id
        self.out.write(member)
        self.hash.update(member)
        self.size, self.records, self.last = self.size + len(member), self.records + 1, page_id

    def close(self) -> None:
        if self.out is not None:
            self.out.close()
            self.done.append((self.shard, self.part, self.temp, self.name, self.records, self.size, self.hash.hexdigest(), self.first, self.last))
            self.out, self.part = None, self.part + 1


def _boundaries(sizes: DataFrame, p: WarcParams) -> np.ndarray:
    """Ids at which shards begin, from the (page_id, n) of every row."""
    total = sizes.agg(F.sum("n").alias("n"), F.count("*").alias("rows")).first()
    shards = -(-(total["n"] or 0) // p.shard_bytes)
    if shards < 2:
        return np.zeros(0, np.int64)
    every = max(1, total["rows"] // p.boundary_ids)
    own = sizes.where(F.col("page_id").isNotNull() & (F.pmod(F.xxhash64("page_id"), F.lit(every)) == 0)).groupBy("page_id").agg(F.sum("n").alias("n")).toPandas().sort_values("page_id")
    weight = own["n"].to_numpy().cumsum()
    if not len(weight):
        return np.zeros(0, np.int64)
    at = np.searchsorted(weight, weight[-1] * np.arange(1, shards) / shards)
    return np.unique(own["page_id"].to_numpy()[np.minimum(at, len(weight) - 1)])


def write(pages: DataFrame, out: str, params: WarcParams = WarcParams()) -> DataFrame:
    """Write ``pages`` (page_id, url, html) to archives under the folder ``out``, a URI that all executors reach; returns the manifest."""
    p, spark = params, pages.sparkSession
    small_batches(spark)
    scratch = Scratch(spark, "warc")
    base = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    sizes = scratch.table(base.select("page_id", (F.octet_length("html") + 512).cast("long").alias("n"), F.unhex(F.sha1("html")).alias("digest")), "sizes")
    start = spark.sparkContext.broadcast(_boundaries(sizes, p))

    @F.pandas_udf("long")
    def shard_of(ids: pd.Series) -> pd.Series:
        return pd.Series(np.where(ids.isna(), 0, np.searchsorted(start.value, ids.fillna(0).astype("int64").to_numpy(), "right")), index=ids.index)

    large = sizes.where(F.col("n") >= p.revisit_bytes + 512)
    groups = large.groupBy("digest").agg(F.max("page_id").alias("refers_to"), F.count("*").alias("copies")).where((F.col("copies") > 1) & F.col("refers_to").isNotNull())
    notes = large.join(groups.select("digest", "refers_to"), "digest").where(~F.col("page_id").eqNullSafe(F.col("refers_to"))).select("page_id", F.lit(None).cast("string").alias("url"), F.lit(None).cast("string").alias("html"), "digest", "refers_to").distinct()
    records = base.select("page_id", "url", "html", F.unhex(F.sha1("html")).alias("digest"), F.lit(None).cast("long").alias("refers_to"))
    both = records.unionByName(notes).withColumn("shard", shard_of("page_id"))
    tasks = min(len(start.value) + 1, max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism))
    # a note stands before the records it is about: null html sorts first
    dealt = both.repartitionByRange(tasks, "shard").sortWithinPartitions("shard", "page_id", "digest", F.col("html").isNotNull(), "url")
    root = out.rstrip("/")
    fs, path = pafs.FileSystem.from_uri(root)
    fs.create_dir(f"{path}/_temporary", recursive=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        roller, note, last = None, None, None

        def flush() -> pa.RecordBatch:
            roller.close()
            return pa.RecordBatch.from_pylist([dict(zip(names, r)) for r in roller.done], schema=schema)

        names = [x.split()[0] for x in MANIFEST.split(", ")]
        schema = pa.schema([(x.split()[0], pa.int64() if x.endswith(" long") else pa.string()) for x in MANIFEST.split(", ")])
        for batch in batches:
            ids, urls, htmls, digests, refers, shards = (c.to_pylist() if k != 2 else c for k, c in enumerate(batch.columns))
            for k in range(batch.num_rows):
                if roller is None or roller.shard != shards[k]:
                    if roller is not None:
                        yield flush()
                    roller = _Roller(root, shards[k], p)
                key, html = (ids[k], digests[k]), htmls[k]
                if not html.is_valid:
                    note = (key, refers[k])
                    continue
                payload = html.as_buffer().to_pybytes()
                to = note[1] if note and note[0] == key else None
                if to is None and key == last and len(payload) >= p.revisit_bytes and key[0] is not None:
                    to = key[0]  # a repeated row
                roller.add(key[0], record(key[0], urls[k], payload, to, p))
                last = key
        if roller is not None:
            yield flush()

    manifest = scratch.table(dealt.mapInArrow(run, MANIFEST), "manifest")

    def commit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = pafs.FileSystem.from_uri(root)
        for batch in batches:
            for temp, name, size in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), batch.column(5).to_pylist()):
                there = fs.get_file_info([f"{path}/{temp}", f"{path}/{name}"])
                if there[0].is_file:
                    fs.move(f"{path}/{temp}", f"{path}/{name}")
                elif not there[1].is_file or there[1].size != size:
                    raise OSError(f"neither {temp} nor a whole {name} is there")
            yield batch

    final = Scratch(spark, "warc-manifest").table(manifest.repartition(max(1, min(tasks, 64)), "name").mapInArrow(commit, MANIFEST), "manifest")
    fs.delete_dir(f"{path}/_temporary")
    with fs.open_output_stream(f"{path}/_SUCCESS") as done:
        done.write(b"")
    scratch.drop("sizes", "manifest")
    return final


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and block of one record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    fields = dict(x.split(": ", 1) for x in lines[1:])
    n = int(fields["Content-Length"])
    if lines[0] != "WARC/1.1" or rest[n:] != b"\r\n\r\n":
        raise ValueError("not a whole WARC record")
    return fields, rest[:n]


def members(stream, step: int = 1 << 20) -> Iterator[bytes]:
    """The decompressed gzip members of a stream; one is in memory at a time."""
    z, parts, rest = zlib.decompressobj(31), [], b""
    while chunk := rest or stream.read(step):
        parts.append(z.decompress(chunk))
        rest = z.unused_data
        if z.eof:
            yield b"".join(parts)
            z, parts = zlib.decompressobj(31), []
        else:
            rest = b""
    if any(parts):
        raise ValueError("the last record is cut off")


def read(spark: SparkSession, out: str, manifest: DataFrame) -> DataFrame:
    """The records of the archives in a manifest; block and payload digests are verified."""
    root = out.rstrip("/")
    schema = pa.schema([(x.split()[0], pa.int64() if x.endswith(" long") else pa.string()) for x in RECORDS.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = pafs.FileSystem.from_uri(root)
        for batch in batches:
            for name in batch.column("name").to_pylist():
                rows = []
                with fs.open_input_stream(f"{path}/{name}", compression=None) as stream:
                    for data in members(stream):
                        f, block = parse(data)
                        kind = f["WARC-Type"]
                        if _sha1(block) != f["WARC-Block-Digest"]:
                            raise ValueError(f"{name}: wrong block digest in {f['WARC-Record-ID']}")
                        payload = block.partition(b"\r\n\r\n")[2]
                        if kind == "response" and (_sha1(payload) != f["WARC-Payload-Digest"] or len(payload) != int(f["X-Payload-Bytes"])):
                            raise ValueError(f"{name}: wrong payload digest in {f['WARC-Record-ID']}")
                        digest = base64.b32decode(f["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
                        page, to = f.get("X-Page-Id"), f.get("X-Refers-To-Page")
                        rows.append((page and int(page), f.get("WARC-Target-URI"), int(f["X-Payload-Bytes"]), digest, kind, to and int(to)))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)

    files = manifest.select("name")
    tasks = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return files.repartition(tasks, "name").mapInArrow(run, RECORDS)


def query(pages: DataFrame, params: WarcParams = WarcParams()) -> DataFrame:
    """Write ``pages``, read the archives back: page_id, payload_bytes, payload_digest, record_type, refers_to."""
    spark = pages.sparkSession
    out = Scratch(spark, "warc-archives").root
    records = read(spark, out, write(pages, out, params))
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
