"""WARC archives as a table of chunks.

A payload is a run of rows ``(record, chunk, data)`` of at most ``CHUNK`` bytes, so neither the writer nor the reader
holds a whole record: the writer streams chunks into one gzip member per record and checks the declared length and
SHA-256 as they pass; the reader inflates piece by piece and gives chunk rows with the running digest and size. The
last chunk of a record has the payload's digest.

Writing is one task per partition. A file is written under a name of its own attempt and renamed at its end, so a
task that runs twice leaves one archive; the list of archives is a table that the tasks return. Paths are opened
through ``pyarrow.fs`` below the shared folder, whatever store that is on.

Of records with equal payloads of at least ``SHARED`` bytes the one with the smallest key is a response and the
others are revisits without a body; rows that repeat that smallest key are responses too. A null payload is empty. A
null key is greater than all others and is written as an empty field.
"""

from __future__ import annotations

import hashlib
import io
import zlib

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chainage.llm.common import stored, work_path

CHUNK, SHARED = 1 << 20, 100
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
CHUNKS = "record string, chunk int, last boolean, kind string, uri string, digest string, bytes bigint, refers_to string, data binary"
READ = "record string, chunk int, last boolean, kind string, uri string, digest string, refers_to string, size bigint, running string, data binary"


def payload_rows(pages: DataFrame, key: str, uri: str, payload: str) -> DataFrame:
    """One row per record: its digest, its kind and what it refers to. The payload column stays for responses only."""
    rows = pages.select(
        F.col(f"`{key}`").alias("record"),
        F.col(f"`{uri}`").cast("string").alias("uri"),
        F.coalesce(F.col(f"`{payload}`").cast("binary"), F.lit(b"").cast("binary")).alias("data"),
    ).withColumns({"digest": F.sha2("data", 256), "bytes": F.octet_length("data").cast("bigint")})
    # Most digests occur once; only the others' first keys take part in the join with the payloads.
    first = (
        rows.filter(F.col("bytes") >= SHARED).groupBy("digest").agg(F.min("record").alias("first"), F.count("*").alias("n"))
        .filter("n > 1").drop("n")
    )
    joined = rows.join(first, "digest", "left")
    again = F.col("first").isNotNull() & ~F.col("record").eqNullSafe(F.col("first"))
    return joined.select(
        F.coalesce(F.col("record").cast("string"), F.lit("")).alias("record"),
        "uri",
        "digest",
        "bytes",
        F.when(again, "revisit").otherwise("response").alias("kind"),
        F.when(again, F.col("first").cast("string")).alias("refers_to"),
        F.when(~again, F.col("data")).alias("data"),
    )


def chunked(rows: DataFrame, size: int = CHUNK) -> DataFrame:
    """Chunk rows of records, each record's chunks in order and next to each other. An empty payload has one chunk."""
    n = F.greatest(F.lit(1), F.ceil(F.octet_length("data") / size)).cast("int")
    n = F.coalesce(n, F.lit(1))
    return rows.withColumn("chunk", F.explode(F.sequence(F.lit(0), n - 1))).select(
        "record",
        "chunk",
        (F.col("chunk") == n - 1).alias("last"),
        "kind",
        "uri",
        "digest",
        "bytes",
        "refers_to",
        F.substring(F.coalesce("data", F.lit(b"").cast("binary")), F.col("chunk") * size + 1, F.lit(size)).alias("data"),
    )


def _head(r: dict) -> bytes:
    body = len(HTTP) + (r["bytes"] if r["kind"] == "response" else 0)
    fields = [
        "WARC/1.1",
        f"WARC-Type: {r['kind']}",
        f"WARC-Record-ID: <urn:record:{r['record']}>",
        f"WARC-Target-URI: {' '.join((r['uri'] or '').split())}",
        "WARC-Date: 1970-01-01T00:00:00Z",
        "Content-Type: application/http; msgtype=response",
        f"WARC-Payload-Digest: sha256:{r['digest']}",
    ]
    if r["kind"] == "revisit":
        fields += [
            "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
            f"WARC-Refers-To: <urn:record:{r['refers_to']}>",
        ]
    return "\r\n".join([*fields, f"Content-Length: {body}", "", ""]).encode() + HTTP


class _Archive:
    """One file, a gzip member per record."""

    def __init__(self, folder: str, name: str, attempt: int):
        self.fs, at = pafs.FileSystem.from_uri(folder)
        self.fs.create_dir(at, recursive=True)
        self.final, self.own = f"{at}/{name}", f"{at}/.{name}.{attempt}"
        self.path = f"{folder}/{name}"
        self.out, self.bytes, self.records = self.fs.open_output_stream(self.own), 0, 0

    def add(self, r: dict) -> None:
        if r["chunk"] == 0:
            self.zip = zlib.compressobj(1, zlib.DEFLATED, 31)
            self.sha, self.size, self.next = hashlib.sha256(), 0, 0
            self._put(self.zip.compress(_head(r)))
        if r["chunk"] != self.next:
            raise ValueError(f"record {r['record']}: chunk {r['chunk']} where {self.next} is due")
        self.next += 1
        self.sha.update(r["data"])
        self.size += len(r["data"])
        self._put(self.zip.compress(r["data"]))
        if r["last"]:
            if r["kind"] == "response" and (self.size, self.sha.hexdigest()) != (r["bytes"], r["digest"]):
                raise ValueError(f"record {r['record']}: the chunks don't make up the declared payload")
            self._put(self.zip.compress(b"\r\n\r\n") + self.zip.flush())
            self.records += 1

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.bytes += len(data)

    def close(self) -> dict:
        self.out.close()
        self.fs.move(self.own, self.final)
        return {"path": self.path, "records": self.records, "bytes": self.bytes}


def _uri(path: str) -> str:
    """Paths without a scheme are local ones."""
    return path if "://" in path or path.startswith("file:") else f"file://{path}"


def write_archives(chunks: DataFrame, folder: str, archive_bytes: int = 256 << 20) -> DataFrame:
    """Writes chunk rows, each partition in its own archives, and returns ``path, records, bytes`` of each archive.

    A record's chunks must follow each other in one partition, as ``chunked`` gives them.
    """
    folder = _uri(folder)

    def write(batches):
        task = TaskContext.get()
        part, attempt, archive, made = task.partitionId(), task.taskAttemptId(), None, 0
        schema = pa.schema([("path", pa.string()), ("records", pa.int64()), ("bytes", pa.int64())])
        for batch in batches:
            for row in range(batch.num_rows):
                r = batch.slice(row, 1).to_pylist()[0]
                if archive is None:
                    archive = _Archive(folder, f"part-{part:05d}-{made:04d}.warc.gz", attempt)
                    made += 1
                archive.add(r)
                if r["last"] and archive.bytes >= archive_bytes:
                    yield pa.RecordBatch.from_pylist([archive.close()], schema)
                    archive = None
        if archive is not None:
            yield pa.RecordBatch.from_pylist([archive.close()], schema)

    return stored(chunks.mapInArrow(write, "path string, records bigint, bytes bigint"), "archives")


class _Inflated:
    """The bytes of all gzip members of a stream, a bounded piece at a time."""

    def __init__(self, source, piece: int):
        self.source, self.piece, self.zip, self.rest, self.buffer = source, piece, None, b"", bytearray()

    def more(self) -> bool:
        if not self.rest:
            self.rest = self.source.read(self.piece)
        if not self.rest:
            return False
        if self.zip is None:
            self.zip = zlib.decompressobj(31)
        self.buffer += self.zip.decompress(self.rest, self.piece)
        self.rest = self.zip.unconsumed_tail or self.zip.unused_data
        if self.zip.eof:
            self.zip = None
        return True

    def take(self, n: int) -> bytes:
        while len(self.buffer) < n and self.more():
            pass
        out = bytes(self.buffer[:n])
        del self.buffer[:n]
        return out

    def head(self) -> bytes:
        """Up to and with the next empty line."""
        begin = 0
        while (at := self.buffer.find(b"\r\n\r\n", begin)) < 0:
            begin = max(0, len(self.buffer) - 3)
            if not self.more():
                return b""
        return self.take(at + 4)


def records(source, size: int):
    """Chunk rows of an archive that is open for reading."""
    stream = _Inflated(source, 1 << 16)
    while head := stream.head():
        lines = head.decode().split("\r\n")
        field = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:] if x)
        left = int(field["Content-Length"]) - len(stream.head())
        named = lambda f: field[f].removeprefix("<urn:record:").removesuffix(">")
        own = {
            "record": named("WARC-Record-ID"),
            "kind": field["WARC-Type"],
            "uri": field["WARC-Target-URI"],
            "digest": field["WARC-Payload-Digest"].removeprefix("sha256:"),
            "refers_to": named("WARC-Refers-To") if "WARC-Refers-To" in field else None,
        }
        sha, done, chunk = hashlib.sha256(), 0, 0
        while True:
            data = stream.take(min(size, left))
            if len(data) < min(size, left):
                raise ValueError(f"record {own['record']} ends early")
            left -= len(data)
            sha.update(data)
            done += len(data)
            yield own | {"chunk": chunk, "last": not left, "size": done, "running": sha.hexdigest(), "data": data}
            chunk += 1
            if not left:
                break
        if stream.take(4) != b"\r\n\r\n":
            raise ValueError(f"record {own['record']} has no end")


def read_archives(archives: DataFrame, size: int = CHUNK, with_data: bool = True) -> DataFrame:
    """Chunk rows of all archives of a list; an archive is read by one task, a batch of chunks at a time."""

    def read(batches):
        names = [c.split()[0] for c in READ.split(", ")]
        kinds = [pa.string(), pa.int32(), pa.bool_(), *[pa.string()] * 4, pa.int64(), pa.string(), pa.binary()]
        schema = pa.schema(list(zip(names, kinds, strict=True)))
        for batch in batches:
            for path in batch.column(0).to_pylist():
                fs, at = pafs.FileSystem.from_uri(path)
                out, held = [], 0
                with fs.open_input_stream(at, compression=None) as source:
                    for r in records(source, size):
                        held += len(r["data"]) + 300
                        out.append(r if with_data else r | {"data": None})
                        if held >= 8 << 20:
                            yield pa.RecordBatch.from_pylist(out, schema)
                            out, held = [], 0
                yield pa.RecordBatch.from_pylist(out, schema)

    # A number that is given is kept, so small lists aren't merged into one task.
    return archives.select("path").repartition(max(1, archives.count())).mapInArrow(read, READ)


def archived(pages: DataFrame, key: str = "page_id", uri: str = "url", payload: str = "html", size: int = CHUNK) -> DataFrame:
    """Writes a record per row, reads the archives back: ``record, payload_bytes, payload_digest, record_type, refers_to``.

    A revisit's payload is that of the response it refers to, found by the reference and the digest.
    """
    folder = work_path(pages.sparkSession, "warc")
    archives = write_archives(chunked(payload_rows(pages, key, uri, payload), size), folder)
    ends = stored(read_archives(archives, size, with_data=False).filter("last").drop("data"), "warc-ends")
    responses = ends.filter("kind = 'response'").select(
        "record", F.col("size").alias("payload_bytes"), F.col("running").alias("payload_digest"),
        F.col("kind").alias("record_type"), F.lit(None).cast("string").alias("refers_to"),
    )
    bodies = (
        responses.filter(F.col("payload_bytes") >= SHARED).groupBy("record", "payload_digest")
        .agg(F.first("payload_bytes").alias("payload_bytes"))
        .select(F.col("record").alias("refers_to"), "payload_bytes", "payload_digest")
    )
    revisits = ends.filter("kind = 'revisit'").select("record", "refers_to", F.col("digest").alias("payload_digest"))
    found = revisits.join(bodies, ["refers_to", "payload_digest"], "left")
    return responses.unionByName(
        found.select("record", "payload_bytes", "payload_digest", F.lit("revisit").alias("record_type"), "refers_to")
    )


def from_bytes(archive: bytes, size: int = CHUNK) -> list[dict]:
    """Chunk rows of an archive in memory."""
    return list(records(io.BytesIO(archive), size))
