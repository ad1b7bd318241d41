"""WARC archives: a deterministic sharded writer and a streaming reader.

Records are range-sorted by page and digest; each task writes its range as archives that roll at a compressed size, under temporary names.
Their manifest is a table that Spark commits, so only attempts that won are in it. A second pass renames
what the manifest lists, which may run again without harm, and the listed names are the archives.
Headers, digests and record ids are made anew from the content, compression carries no time stamp: equal input and shards give equal files.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Compressed bytes at which an archive is closed; the record that crosses it is whole.
ROLL_BYTES = 32 << 20
#: The pages carry no time of capture; records need one.
CAPTURED = "1970-01-01T00:00:00Z"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Most tasks that read archives back; each takes an archive or more.
MAX_READERS = 20_000
_MANIFEST = "temporary string, name string, records long, bytes long"
_LINE = b"\r\n"


def _open(uri: str) -> tuple[fs.FileSystem, str]:
    if uri.startswith("file:/") and not uri.startswith("file:///"):
        uri = "file:///" + uri[6:].lstrip("/")
    return fs.FileSystem.from_uri(uri)


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(page: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, f'{page} {digest}')}>"


def record(page: int | None, url: str | None, payload: bytes, revisits: tuple[int | None] | None) -> bytes:
    """One record: a response, or a revisit of the response of page ``revisits[0]``, which carries no payload."""
    digest = base32_sha1(payload)
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisits else http + payload
    head = {
        "WARC-Type": "revisit" if revisits else "response",
        "WARC-Record-ID": record_id(page, digest + (" revisit" if revisits else "")),
        "WARC-Date": CAPTURED,
        "WARC-Target-URI": " ".join((url or "").split()),
        "WARC-Payload-Digest": f"sha1:{digest}",
        "WARC-Block-Digest": f"sha1:{base32_sha1(block)}",
        "Content-Type": "application/http; msgtype=response",
        "Content-Length": str(len(block)),
    }
    if page is not None:
        head["Page-ID"] = str(page)
    if revisits:
        head |= {"WARC-Profile": REVISIT_PROFILE, "WARC-Refers-To": record_id(revisits[0], digest)}
        if revisits[0] is not None:
            head["Refers-To-Page-ID"] = str(revisits[0])
    lines = b"".join(f"{k}: {v}\r\n".encode() for k, v in head.items() if v)
    return b"WARC/1.1\r\n" + lines + _LINE + block + _LINE + _LINE


def member(data: bytes) -> bytes:
    """A gzip member without name or time."""
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


class _Archives:
    """The archives of one task's range, one open at a time."""

    def __init__(self, folder: str, roll: int):
        self.files, self.base = _open(folder)
        context = TaskContext.get()
        self.part = context.partitionId() if context else 0
        self.attempt, self.roll, self.number, self.sink, self.done = uuid.uuid4().hex, roll, 0, None, []

    def add(self, data: bytes) -> None:
        if self.sink is None:
            self.name = f"part-{self.part:06d}-{self.number:06d}.warc.gz"
            self.place = f"_temporary/{self.attempt}-{self.name}"
            self.files.create_dir(f"{self.base}/_temporary", recursive=True)
            self.sink = self.files.open_output_stream(f"{self.base}/{self.place}", compression=None)
            self.size = self.records = 0
        packed = member(data)
        self.sink.write(packed)
        self.size += len(packed)
        self.records += 1
        if self.size >= self.roll:
            self.close()

    def close(self) -> None:
        if self.sink is not None:
            self.sink.close()
            self.done.append((self.place, self.name, self.records, self.size))
            self.sink = None
            self.number += 1


def write_archives(
    pages: DataFrame, folder: str, shards: int | None = None, least_bytes: int = 0, roll_bytes: int = ROLL_BYTES,
    key: str = "page_id", url: str = "url", payload: str = "html",
) -> DataFrame:
    """Write every row as a record to ``folder`` (shared by all executors) and return the manifest: archive, records, bytes.

    Of rows with equal payloads of at least ``least_bytes`` bytes the one with the smallest key (null last) is a response and
    the others revisit it; smaller payloads are all responses. Of rows that also share the key, the first written is the response.
    Null payloads are empty, null urls are left out. Other columns are not read. The payload is shuffled once; copies meet as digests.
    """
    spark = pages.sparkSession
    body = F.coalesce(pages[f"`{payload}`"], F.lit(""))
    rows = pages.select(
        pages[f"`{key}`"].cast("long").alias("page"), pages[f"`{url}`"].cast("string").alias("url"), body.alias("body"),
        F.sha1(body.cast("binary")).alias("sha1"),
    )
    narrow = rows.where(F.octet_length("body") >= least_bytes).select("page", "sha1")
    groups = narrow.groupBy("sha1").agg(F.min("page").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    again = narrow.join(groups, "sha1").where("page is null or page > first").select("page", "sha1", "first").distinct()
    both = again.select("page", "sha1", F.lit(0).alias("kind"), "first", F.lit(None).cast("string").alias("url"), F.lit("").alias("body")).union(
        rows.select("page", "sha1", F.lit(1), F.lit(None).cast("long"), "url", "body")
    )
    shards = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = both.repartitionByRange(shards, F.col("page").asc_nulls_last(), "sha1").sortWithinPartitions(
        F.col("page").asc_nulls_last(), "sha1", "kind"
    )

    def write(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = _Archives(folder, roll_bytes)
        told = written = None
        for batch in batches:
            for page, sha1, kind, first, link, text in zip(*(c.to_pylist() for c in batch.columns)):
                if kind == 0:
                    told = (page, sha1), first
                    continue
                data, revisits = text.encode("utf-8", "replace"), None
                if told and told[0] == (page, sha1) and (told[1] is not None or written == (page, sha1)):
                    revisits = (told[1],)
                elif written == (page, sha1) and len(data) >= least_bytes:
                    revisits = (page,)
                out.add(record(page, link, data, revisits))
                written = page, sha1
        out.close()
        columns = list(zip(*out.done)) or [()] * 4
        kinds = [pa.string(), pa.string(), pa.int64(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["temporary", "name", "records", "bytes"])

    staged = f"{folder}/_staged"
    ranged.mapInArrow(write, _MANIFEST).write.mode("overwrite").parquet(staged)

    def commit(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, base = _open(folder)
        for batch in batches:
            for temporary, name in zip(batch.column("temporary").to_pylist(), batch.column("name").to_pylist()):
                if files.get_file_info(f"{base}/{temporary}").type == fs.FileType.File:
                    files.move(f"{base}/{temporary}", f"{base}/{name}")
                elif files.get_file_info(f"{base}/{name}").type != fs.FileType.File:
                    raise FileNotFoundError(name)
            yield batch

    listed = spark.read.schema(_MANIFEST).parquet(staged)
    listed.mapInArrow(commit, _MANIFEST).select("name", "records", "bytes").write.mode("overwrite").parquet(f"{folder}/_manifest")
    return spark.read.schema("name string, records long, bytes long").parquet(f"{folder}/_manifest")


def records_of(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of each record of an archive whose records are gzip members."""
    unpacker, held = zlib.decompressobj(31), []
    data = b""
    while True:
        data = data or stream.read(1 << 20)
        if not data:
            if held:
                raise ValueError("the archive ends within a record")
            return
        held.append(unpacker.decompress(data))
        data = unpacker.unused_data
        if unpacker.eof:
            head, _, rest = b"".join(held).partition(b"\r\n\r\n")
            lines = head.decode().split("\r\n")
            fields = dict(line.split(": ", 1) for line in lines[1:])
            yield fields, rest[: int(fields["Content-Length"])]
            unpacker, held = zlib.decompressobj(31), []


def read_archives(manifest: DataFrame, folder: str) -> DataFrame:
    """``page_id, payload_bytes, payload_digest, record_type, refers_to, url`` of all records of the manifest's archives.

    Archives are dealt over the tasks and streamed record by record. A response whose payload does not
    match its digest ends the job.
    """

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, base = _open(folder)
        for batch in batches:
            for name in batch.column("name").to_pylist():
                with files.open_input_stream(f"{base}/{name}", compression=None) as stream:
                    rows = []
                    for head, block in records_of(stream):
                        http, _, payload = block.partition(b"\r\n\r\n")
                        size = int(dict(x.split(": ", 1) for x in http.decode().split("\r\n")[1:])["Content-Length"])
                        digest = head["WARC-Payload-Digest"].removeprefix("sha1:")
                        if head["WARC-Type"] == "response" and (len(payload) != size or base32_sha1(payload) != digest):
                            raise ValueError(f"record {head['WARC-Record-ID']} of {name} is damaged")
                        page, first = head.get("Page-ID"), head.get("Refers-To-Page-ID")
                        rows.append(
                            (page and int(page), size, digest, head["WARC-Type"], first and int(first), head.get("WARC-Target-URI"))
                        )
                        if len(rows) == 10_000:
                            yield _rows(rows)
                            rows = []
                    yield _rows(rows)

    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string"
    # the names are few bytes, so that only a stated number of tasks keeps adaptive execution from reading all archives in one
    readers = max(1, min(manifest.count(), MAX_READERS))
    return manifest.select("name").repartition(readers, "name").mapInArrow(read, schema)


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string()]
    columns = list(zip(*rows)) or [()] * 6
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url"]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)
