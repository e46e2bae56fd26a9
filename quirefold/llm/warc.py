"""WARC archives as chunked record tables.

Writing: payloads go to the writing tasks as rows (record, chunk number, bytes), in order, and are streamed into
gzip-per-record archives in the shared folder; the writer holds a batch of chunks, not a payload. A task emits one
manifest row per finished archive. The manifest is a table of its own: only archives that it names are
read, so what a lost or repeated task left behind does no harm. Archives are rolled at a size, which bounds the work of
one reading task.

Reading: an archive is decompressed block by block, and its records are counted against the manifest. A record comes out as rows (record, chunk number, bytes, running
SHA-256, total so far, last); a payload longer than a chunk is never held as a whole, and the digest is carried from
chunk to chunk, so the last row has the digest and length of the payload without any grouping.

Archives are reached by URI through Arrow's file systems (local or mounted folders, HDFS, object stores).

Records with equal payloads of at least `min_payload` bytes: the smallest id is a response, the others revisit it.
Their counts are aggregated before the shuffle, only digests that occur twice or more are joined back, and adaptive
execution can split that join if one payload is a third of all rows.

Defined results: a null payload is empty; empty and short payloads are responses each by themselves; a null url gives a
record without target, a long one is a long header; a record without id has none in the archive and comes back with a
null id, it revisits an equal payload that has one; rows that repeat an id are records of their own (equal ones are
responses alike); an archive that is cut short, or has other records than its manifest says, is an error; an empty
table gives no archives and no rows; extra columns are not read, whatever their names.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as arrow_fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quirefold.llm.store import fresh_path, materialize, prepare

#: Bytes of a payload in one row of the chunk table.
CHUNK_BYTES = 64 << 10
#: Bytes that are read or compressed at a time.
BLOCK_BYTES = 256 << 10
#: Compressed bytes after which a new archive is begun.
ARCHIVE_BYTES = 256 << 20
#: Bytes of chunk rows in one Arrow batch.
BATCH_BYTES = 4 << 20

CHUNKS = T.StructType(
    [
        T.StructField("record_id", T.StringType()),
        T.StructField("record_type", T.StringType()),
        T.StructField("refers_to", T.StringType()),
        T.StructField("target_uri", T.StringType()),
        T.StructField("claimed_digest", T.StringType()),
        T.StructField("claimed_length", T.LongType()),
        T.StructField("chunk_no", T.LongType()),
        T.StructField("chunk", T.BinaryType()),
        T.StructField("running_sha256", T.StringType()),
        T.StructField("bytes_so_far", T.LongType()),
        T.StructField("is_last", T.BooleanType()),
    ]
)
MANIFEST = T.StructType([T.StructField("archive", T.StringType()), T.StructField("records", T.LongType()), T.StructField("bytes", T.LongType())])

_ARROW = {"string": pa.string(), "bigint": pa.int64(), "binary": pa.binary(), "boolean": pa.bool_()}


def _arrow_schema(schema: T.StructType) -> pa.Schema:
    return pa.schema([(f.name, _ARROW[f.dataType.simpleString()]) for f in schema])


class _Archive:
    """One archive being written: every record is a gzip member."""

    def __init__(self, uri: str) -> None:
        system, path = arrow_fs.FileSystem.from_uri(uri)
        system.create_dir(path.rsplit("/", 1)[0], recursive=True)
        self.uri, self.out, self.records, self.size = uri, system.open_output_stream(path), 0, 0

    def begin(self, header: bytes) -> None:
        self.z = zlib.compressobj(1, zlib.DEFLATED, 31)
        self._put(self.z.compress(header))

    def add(self, chunk) -> None:
        self._put(self.z.compress(chunk))

    def end(self) -> None:
        self._put(self.z.compress(b"\r\n\r\n") + self.z.flush())
        self.records += 1

    def _put(self, data: bytes) -> None:
        if data:
            self.out.write(data)
            self.size += len(data)


def _header(record_id: str | None, kind: str, length: int, digest: str, full_length: int, uri: str | None, refers_to: str | None) -> bytes:
    lines = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <urn:record:{'' if record_id is None else record_id}>",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Payload-Digest: sha256:{digest}",
        f"X-Payload-Length: {full_length}",
        f"Content-Length: {length}",
        "Content-Type: text/html",
    ]
    if uri:
        lines.append("WARC-Target-URI: " + uri.replace("\r", "%0D").replace("\n", "%0A"))
    if refers_to is not None:
        lines += [f"WARC-Refers-To: <urn:record:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n"


def _write_task(folder: str, archive_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import uuid

        archive: _Archive | None = None

        def close() -> pa.RecordBatch:
            archive.out.close()
            return pa.RecordBatch.from_pylist([{"archive": archive.uri, "records": archive.records, "bytes": archive.size}], _arrow_schema(MANIFEST))

        for batch in batches:
            fields = [batch.column(c).to_pylist() for c in ("record_id", "uri", "digest", "length", "refers_to", "chunk_no", "chunks")]
            for record_id, uri, digest, length, refers, number, chunks, chunk in zip(*fields, batch.column("chunk"), strict=True):
                if number == 0:
                    if archive is None:  # a name that no other attempt of this task uses
                        archive = _Archive(f"{folder}/{uuid.uuid4().hex}.warc.gz")
                    revisit = refers is not None
                    archive.begin(_header(record_id, "revisit" if revisit else "response", 0 if revisit else length, digest, length, uri, refers))
                archive.add(memoryview(chunk.as_buffer() or b""))
                if number == chunks - 1:
                    archive.end()
                    if archive.size >= archive_bytes:
                        yield close()
                        archive = None
        if archive is not None:
            yield close()

    return run


def write_archives(pages: DataFrame, id_col: str = "page_id", url: str = "url", payload: str = "html", min_payload: int = 100, folder: str | None = None, archive_bytes: int = ARCHIVE_BYTES, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Write a record for every row; returns the manifest (archive, records, bytes). Ids contain neither `>` nor line ends."""
    spark = prepare(pages.sparkSession)
    body = F.coalesce(F.col(payload).cast("binary"), F.lit(b""))
    rows = pages.select(F.col(id_col).cast("string").alias("record_id"), F.col(id_col).alias("_id"), F.col(url).alias("uri"), body.alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256)).withColumn("length", F.octet_length("payload").cast("long"))
    groups = rows.filter(F.col("length") >= min_payload).groupBy("digest").agg(F.count(F.lit(1)).alias("_n"), F.min("_id").alias("_first")).filter("_n > 1")
    groups = materialize(groups.select(F.col("digest").alias("_digest"), "_first"), "payload_groups")
    joined = rows.join(groups, rows["digest"] == groups["_digest"], "left")
    refers = F.when(~F.col("_first").eqNullSafe(F.col("_id")), F.col("_first").cast("string"))
    ready = joined.select("record_id", "uri", "digest", "length", refers.alias("refers_to"), F.when(refers.isNull(), F.col("payload")).otherwise(F.lit(b"")).alias("payload"))
    # explode keeps a record's chunks together and in order; what leaves it is a chunk a row
    starts = F.sequence(F.lit(0), F.greatest(F.floor((F.octet_length("payload") - 1) / chunk_bytes), F.lit(0)).cast("int"))
    cut = F.transform(starts, lambda i: F.substring(F.col("payload"), i * chunk_bytes + 1, F.lit(chunk_bytes)))
    ready = ready.select("record_id", "uri", "digest", "length", "refers_to", F.size(starts).alias("chunks"), F.posexplode(cut).alias("chunk_no", "chunk"))
    folder = folder or fresh_path(spark, "warc")
    return materialize(ready.mapInArrow(_write_task(folder, archive_bytes), MANIFEST), "manifest")


class _Stream:
    """Bytes of a multi-member gzip file, decompressed block by block."""

    def __init__(self, source) -> None:
        self.source, self.z, self.buffer, self.ended = source, zlib.decompressobj(31), bytearray(), False

    def fill(self) -> bool:
        """Add up to a block; False at the end."""
        while True:
            if self.z.eof:
                rest, self.z = self.z.unused_data, zlib.decompressobj(31)
            else:
                rest = self.z.unconsumed_tail
            data = rest or self.source.read(BLOCK_BYTES)
            if not data:
                return False
            out = self.z.decompress(data, BLOCK_BYTES)
            if out:
                self.buffer += out
                return True

    def until(self, mark: bytes) -> bytes | None:
        """Up to and with mark; None at the end of the file."""
        seen = 0
        while (at := self.buffer.find(mark, max(0, seen - len(mark)))) < 0:
            seen = len(self.buffer)
            if not self.fill():
                if self.buffer:
                    raise ValueError("the archive ends within a record")
                return None
        return self.take(at + len(mark))

    def take(self, n: int) -> bytes:
        """The next n bytes at most, at least one if n > 0."""
        while len(self.buffer) < n:
            if not self.fill():
                raise ValueError("the archive ends within a record")
        out = bytes(self.buffer[:n])
        del self.buffer[:n]
        return out


def read_records(source, chunk_bytes: int = CHUNK_BYTES) -> Iterator[dict]:
    """Chunk rows of one archive, in order."""
    stream = _Stream(source)
    while (head := stream.until(b"\r\n\r\n")) is not None:
        fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:] if ": " in line)
        name = lambda key: fields.get(key, "").removeprefix("<urn:record:").removesuffix(">") or None
        left, digest, done, number = int(fields["Content-Length"]), hashlib.sha256(), 0, 0
        base = {
            "record_id": name("WARC-Record-ID"),
            "record_type": fields["WARC-Type"],
            "refers_to": name("WARC-Refers-To"),
            "target_uri": fields.get("WARC-Target-URI"),
            "claimed_digest": fields["WARC-Payload-Digest"].removeprefix("sha256:"),
            "claimed_length": int(fields["X-Payload-Length"]),
        }
        while True:
            chunk = stream.take(min(left, chunk_bytes))
            left -= len(chunk)
            done += len(chunk)
            digest.update(chunk)
            yield base | {"chunk_no": number, "chunk": chunk, "running_sha256": digest.hexdigest(), "bytes_so_far": done, "is_last": left == 0}
            number += 1
            if not left:
                break
        if stream.take(4) != b"\r\n\r\n":
            raise ValueError("a record does not end where it should")


def _read_task(chunk_bytes: int, with_chunk: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = _arrow_schema(CHUNKS)
        for batch in batches:
            for uri, records in zip(batch.column("archive").to_pylist(), batch.column("records").to_pylist(), strict=True):
                system, path = arrow_fs.FileSystem.from_uri(uri)
                with system.open_input_stream(path) as source:
                    rows, size, found = [], 0, 0
                    for row in read_records(source, chunk_bytes):
                        size += len(row["chunk"]) + 300
                        found += row["is_last"]
                        if not with_chunk:
                            row["chunk"] = None
                        rows.append(row)
                        if size >= BATCH_BYTES:
                            yield pa.RecordBatch.from_pylist(rows, schema)
                            rows, size = [], 0
                    if found != records:
                        raise ValueError(f"{uri} has {found} records, its manifest says {records}")
                    if rows:
                        yield pa.RecordBatch.from_pylist(rows, schema)

    return run


def read_archives(manifest: DataFrame, chunk_bytes: int = CHUNK_BYTES, with_chunk: bool = True) -> DataFrame:
    """The chunk table of all archives of a manifest; with_chunk=False leaves the bytes out and keeps their digests."""
    spark = prepare(manifest.sparkSession)
    tasks = max(spark.sparkContext.defaultParallelism, min(manifest.count(), 100_000))
    spread = manifest.select("archive", "records").repartitionByRange(tasks, "archive")
    return spread.mapInArrow(_read_task(chunk_bytes, with_chunk), CHUNKS)


def records(manifest: DataFrame) -> DataFrame:
    """One row per record: (record_id, payload_bytes, payload_digest, record_type, refers_to, target_uri).

    A response's length and digest are those of the bytes that were read, and must be the claimed ones."""
    last = read_archives(manifest, with_chunk=False).filter("is_last")
    response = F.col("record_type") == "response"
    sound = ~response | ((F.col("running_sha256") == F.col("claimed_digest")) & (F.col("bytes_so_far") == F.col("claimed_length")))
    digest = F.when(sound, F.when(response, F.col("running_sha256")).otherwise(F.col("claimed_digest"))).otherwise(F.raise_error(F.lit("a payload differs from its digest")))
    length = F.when(response, F.col("bytes_so_far")).otherwise(F.col("claimed_length"))
    return last.select("record_id", length.alias("payload_bytes"), digest.alias("payload_digest"), "record_type", "refers_to", "target_uri")


