"""WARC archives: writing captures and assembling them again.

Every capture is three records: the request, the response (or a revisit of an equal payload seen
before) and metadata, the latter two kinds bound to the response by ``WARC-Concurrent-To``. Archives
are gzip files with one member per record, written by the tasks that hold the rows; a lost task
writes its files again under the same names. Assembly parses the archives into one row per record,
joins request and metadata to their capture by that identifier, and emits one nested row each.

Of captures with equal payloads of at least ``REVISIT_BYTES`` that with the smallest page id is the
response and the others revisit it. Defined cases: a null html is an empty payload; a page id null
never names the one that others revisit, and where all ids are null all are responses; repeated rows
of that smallest id are responses all; an empty table writes no archive; null urls stay null.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gapspark.llm.common import arrow_schema, batches_of, in_chunks, materialize, rows_to_batch, shared_dir
from gapspark.llm.id_files import open_folder, put

REVISIT_BYTES = 100
FILE_BYTES = 16 << 20
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP_OK = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
MANIFEST = "path string, n_captures long"
RECORDS = ("record_id string, record_type string, concurrent_to string, target_uri string, date string, "
           "payload_digest string, payload_bytes long, payload binary, block binary, fields map<string,string>")


def record(kind: str, record_id: str, headers: list[tuple[str, str | None]], block: bytes) -> bytes:
    """One gzip member. Headers with null values are left out; line ends in values become spaces."""
    head = [("WARC-Type", kind), ("WARC-Record-ID", f"<{record_id}>"), ("WARC-Date", DATE), *headers,
            ("Content-Length", str(len(block)))]
    lines = [f"{k}: {' '.join(v.splitlines())}" for k, v in head if v is not None]
    raw = "\r\n".join(["WARC/1.1", *lines]).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"
    packer = zlib.compressobj(4, zlib.DEFLATED, 31)
    return packer.compress(raw) + packer.flush()


def capture(page_id: int | None, url: str | None, payload: bytes, digest: str, first: int | None,
            is_revisit: bool) -> bytes:
    """The three records of a capture."""
    main, request, metadata = (f"urn:uuid:{uuid.uuid4()}" for _ in range(3))
    shared = [("WARC-Target-URI", url)]
    bound = [*shared, ("WARC-Concurrent-To", f"<{main}>")]
    path = "/" + (url or "").partition("://")[2].partition("/")[2].partition("#")[0]
    ask = f"GET {path} HTTP/1.1\r\n\r\n".encode()
    about = {"page-id": page_id, "refers-to-page-id": first if is_revisit else None}
    fields = "".join(f"{k}: {v}\r\n" for k, v in about.items() if v is not None).encode()
    own = [*shared, ("WARC-Payload-Digest", f"sha256:{digest}")]
    if is_revisit:
        body = record("revisit", main, [*own, ("WARC-Profile", PROFILE), ("WARC-Refers-To-Date", DATE),
                                        ("Content-Type", "application/http;msgtype=response")], HTTP_OK)
    else:
        body = record("response", main, [*own, ("Content-Type", "application/http;msgtype=response")], HTTP_OK + payload)
    return (record("request", request, [*bound, ("Content-Type", "application/http;msgtype=request")], ask) + body
            + record("metadata", metadata, [*bound, ("Content-Type", "application/warc-fields")], fields))


def write_captures(pages: DataFrame, folder: str, page_id: str = "page_id", url: str = "url",
                   html: str = "html") -> DataFrame:
    """Writes the archives and returns the manifest, one row per file."""
    spark = pages.sparkSession
    batches_of(spark)
    payload = F.encode(F.coalesce(F.col(f"`{html}`"), F.lit("")), "UTF-8")
    rows = pages.select(
        F.col(f"`{page_id}`").cast("long").alias("page_id"), F.col(f"`{url}`").alias("url"), payload.alias("payload"),
        F.sha2(payload, 256).alias("digest"))
    firsts = (
        rows.where(F.octet_length("payload") >= REVISIT_BYTES).groupBy("digest").agg(
            F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1 and first is not null")
        .select("digest", "first")
    )
    schema = arrow_schema(MANIFEST)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, file = TaskContext.get().partitionId(), 0
        members: list[bytes] = []
        size = 0

        def flush() -> pa.RecordBatch:
            path = put(folder, f"captures-{part:06d}-{file:06d}.warc.gz", b"".join(members))
            return rows_to_batch([(path, len(members))], schema)

        for batch in batches:
            for values in zip(*(c.to_pylist() for c in batch.columns)):
                name, address, body, digest, first = values
                members.append(capture(name, address, body, digest, first, first is not None and first != name))
                size += len(members[-1])
                if size >= FILE_BYTES:
                    yield flush()
                    members, size, file = [], 0, file + 1
        if members:
            yield flush()

    joined = rows.join(firsts, "digest", "left").select("page_id", "url", "payload", "digest", "first")
    return materialize(joined.mapInArrow(write, MANIFEST), "warc-manifest")


def members_of(data: Iterator[bytes]) -> Iterator[bytes]:
    """The gzip members of a stream, one at a time."""
    unpacker, parts = zlib.decompressobj(31), []
    for block in data:
        while block:
            parts.append(unpacker.decompress(block))
            block = b""
            if unpacker.eof:
                yield b"".join(parts)
                block, unpacker, parts = unpacker.unused_data, zlib.decompressobj(31), []
    if any(parts):
        raise ValueError("archive ends inside a record")


def parse(raw: bytes, with_blocks: bool) -> tuple:
    """A record as a row of ``RECORDS``; payload length and digest are those of the block itself."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    headers = {k.lower(): v.strip() for k, _, v in (line.partition(":") for line in lines[1:])}
    block = rest[: int(headers["content-length"])]
    kind = headers["warc-type"]
    body, digest, size, fields = None, None, None, {}
    if kind == "response":
        body = block.partition(b"\r\n\r\n")[2]
        digest, size = hashlib.sha256(body).hexdigest(), len(body)
    elif kind == "revisit":
        digest = headers.get("warc-payload-digest", "").partition(":")[2] or None
    elif kind == "metadata":
        fields = {k: v.strip() for k, _, v in (line.partition(":") for line in block.decode().split("\r\n") if line)}
    bare = lambda x: x.strip("<>") if x else None
    return (bare(headers.get("warc-record-id")), kind, bare(headers.get("warc-concurrent-to")),
            headers.get("warc-target-uri"), headers.get("warc-date"), digest, size,
            body if with_blocks else None, block if with_blocks and kind == "request" else None, fields)


def read_records(spark: SparkSession, manifest: DataFrame, with_blocks: bool = True) -> DataFrame:
    """One row per record of the archives in ``manifest`` (column path)."""
    batches_of(spark)
    schema = arrow_schema(RECORDS)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for batch in batches:
                for uri in batch.column(0).to_pylist():
                    system, path = open_folder(uri)
                    with system.open_input_file(path) as file:
                        for raw in members_of(iter(lambda: file.read(1 << 20), b"")):
                            yield parse(raw, with_blocks)

        yield from in_chunks(rows(), schema, 256)

    files = manifest.select("path").repartition(max(1, spark.sparkContext.defaultParallelism * 4))
    return files.mapInArrow(read, RECORDS)


def assemble(records: DataFrame) -> DataFrame:
    """One nested row per capture: record_id, record_type, target_uri, payload_digest, payload_bytes
    (of the full payload, also for revisits), payload, request and metadata."""
    main = records.where(F.col("record_type").isin("response", "revisit")).select(
        "record_id", "record_type", "target_uri", "date", "payload_digest", "payload_bytes", "payload")
    requests = records.where("record_type = 'request'").select(
        F.col("concurrent_to").alias("record_id"),
        F.struct(F.col("record_id").alias("record_id"), F.col("date"), F.col("block")).alias("request"))
    metadata = records.where("record_type = 'metadata'").select(
        F.col("concurrent_to").alias("record_id"),
        F.struct(F.col("record_id").alias("record_id"), F.col("date"), F.col("fields")).alias("metadata"))
    sizes = main.where("record_type = 'response'").groupBy("payload_digest").agg(F.max("payload_bytes").alias("full"))
    captures = main.join(requests, "record_id", "left").join(metadata, "record_id", "left")
    responses = captures.where("record_type = 'response'")
    revisits = captures.where("record_type = 'revisit'").join(sizes, "payload_digest", "left").select(
        *[F.col("full").alias(c) if c == "payload_bytes" else F.col(c) for c in captures.columns])
    return responses.unionByName(revisits)


def page_captures(pages: DataFrame, folder: str | None = None, with_blocks: bool = True) -> DataFrame:
    """Writes ``pages`` as archives into ``folder`` (the shared folder where none is given), reads
    them back and assembles the captures, with page_id and refers_to from their metadata."""
    spark = pages.sparkSession
    manifest = write_captures(pages, folder or shared_dir(spark, "warc"))
    records = materialize(read_records(spark, manifest, with_blocks), "warc-records")
    field = lambda k: F.col("metadata.fields")[k].cast("long")
    return assemble(records).select(
        field("page-id").alias("page_id"), "record_id", "record_type", "target_uri", "payload_bytes",
        "payload_digest", "payload", "request", "metadata", field("refers-to-page-id").alias("refers_to"))
