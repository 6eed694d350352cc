"""Token-id files: concatenated ids with Elias-Fano document boundaries.

Documents are dealt by ranges of their id, sorted inside each range, encoded and written by the
task that holds the range, so ids are never shuffled. A file holds at most ``FILE_IDS`` ids (one
longer document has a file of its own). Layout, little-endian: a fixed head, the end offsets of the
documents and their ids as Elias-Fano codes, then the token ids in 2 bytes each where the largest
id allows it, else 4. Nothing in it is a table of 64-bit offsets.

Defined cases: a null text counts as empty and holds the end id alone; null document ids come first
and stay null; rows with equal ids follow one another, ordered by a hash of their text; an empty
table writes no file. A lost task writes its files again under the same names.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gapspark.llm import elias_fano
from gapspark.llm.common import arrow_schema, batches_of, in_chunks, materialize, rows_to_batch, shared_dir
from gapspark.llm.encoding import encoder

MAGIC = b"GAPIDS01"
HEAD = "<8sBQQQqQQ"
FILE_IDS = 4_000_000
MANIFEST = "part int, file int, path string, n_docs long, n_ids long"


def file_bytes(doc_ids: list[int | None], lengths: list[int], ids: list[bytes]) -> bytes:
    """One file. ``ids`` holds each document's ids as unsigned 32-bit bytes; null ids come first."""
    flat = np.frombuffer(b"".join(ids), "<u4")
    width = 2 if not len(flat) or int(flat.max()) < 1 << 16 else 4
    n_null = sum(d is None for d in doc_ids)
    known = doc_ids[n_null:]
    base = known[0] if known else 0
    ends = elias_fano.encode(np.cumsum(np.array(lengths, np.uint64)))
    names = elias_fano.encode(np.array([d - base for d in known], np.uint64))
    head = struct.pack(HEAD, MAGIC, width, len(doc_ids), n_null, len(flat), base, len(ends), len(names))
    return head + ends + names + flat.astype(f"<u{width}").tobytes()


class IdFile:
    """A file's documents, by place."""

    def __init__(self, data: bytes):
        magic, width, self.n_docs, self.n_null, self.n_ids, self.base, n_ends, n_names = struct.unpack_from(HEAD, data)
        if magic != MAGIC:
            raise ValueError("not a token-id file")
        at = struct.calcsize(HEAD)
        self.ends = elias_fano.EliasFano(data[at : at + n_ends])
        self.names = elias_fano.EliasFano(data[at + n_ends : at + n_ends + n_names])
        self.ids = np.frombuffer(data, f"<u{width}", self.n_ids, at + n_ends + n_names)

    def doc_id(self, i: int) -> int | None:
        return None if i < self.n_null else self.base + self.names.select(i - self.n_null)

    def tokens(self, i: int) -> np.ndarray:
        start = self.ends.select(i - 1) if i else 0
        return self.ids[start : self.ends.select(i)].astype("<u4")

    def __iter__(self) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """(document id, start in the file, ids) of every document."""
        names = [None] * self.n_null + [self.base + int(v) for v in self.names.all()]
        start = 0
        for name, end in zip(names, self.ends.all().astype(np.int64).tolist()):
            yield name, start, self.ids[start:end].astype("<u4")
            start = end


def open_folder(uri: str):
    """The file system of a shared folder and the path in it; works for local and remote ones."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)


def put(uri: str, name: str, data: bytes) -> str:
    """Writes a whole file or none: an own name first, then the final one."""
    system, folder = open_folder(uri)
    system.create_dir(folder, recursive=True)
    draft = f"{folder}/_{name}-{uuid.uuid4().hex}"
    with system.open_output_stream(draft) as out:
        out.write(data)
    system.move(draft, f"{folder}/{name}")
    return f"{uri}/{name}"


def get(uri: str) -> bytes:
    system, path = open_folder(uri)
    with system.open_input_file(path) as file:
        return file.read()


def write_ids(docs: DataFrame, folder: str, tokenizer: str, keep_space: bool, end_id: int,
              doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Writes the files and returns the manifest, one row per file: part, file, path, counts.

    Files in the order (part, file) hold the documents in ascending order of their ids.
    """
    spark = docs.sparkSession
    batches_of(spark)
    schema = arrow_schema(MANIFEST)
    end = np.array([end_id], "<u4").tobytes()

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(tokenizer, keep_space)
        part, file = TaskContext.get().partitionId(), 0
        names: list = []
        lengths: list[int] = []
        ids: list[bytes] = []

        def flush() -> pa.RecordBatch:
            path = put(folder, f"ids-{part:06d}-{file:06d}.bin", file_bytes(names, lengths, ids))
            return rows_to_batch([(part, file, path, len(names), sum(lengths))], schema)

        for batch in batches:
            for name, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                own = coder.encode(value or "") + end
                if names and sum_ids + len(own) // 4 > FILE_IDS:
                    yield flush()
                    file += 1
                    names, lengths, ids = [], [], []
                if not names:
                    sum_ids = 0
                names.append(name)
                lengths.append(len(own) // 4)
                ids.append(own)
                sum_ids += len(own) // 4
        if names:
            yield flush()

    parts = max(1, docs.rdd.getNumPartitions())
    ordered = (
        docs.select(F.col(doc_id).cast("long").alias("d"), F.col(text).alias("t"))
        .repartitionByRange(parts, F.col("d").asc_nulls_first(), F.xxhash64("t"))
        .sortWithinPartitions(F.col("d").asc_nulls_first(), F.xxhash64("t"))
    )
    return materialize(ordered.mapInArrow(write, MANIFEST), "id-manifest")


def read_ids(spark: SparkSession, manifest: DataFrame, with_ids: bool = True) -> DataFrame:
    """Every document of the files: doc_id, start (ids of all documents before it), n_tokens,
    ids_crc32 of the ids as unsigned 32-bit numbers, and with ``with_ids`` the ids themselves."""
    columns = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids
    schema = arrow_schema(columns)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for batch in batches:
                for path, before in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    for name, start, ids in IdFile(get(path)):
                        row = (name, before + start, len(ids), zlib.crc32(ids.tobytes()))
                        yield (*row, ids.tolist()) if with_ids else row

        yield from in_chunks(rows(), schema)

    before = Window.orderBy("part", "file").rowsBetween(Window.unboundedPreceding, -1)  # a row per file
    files = manifest.select("path", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).alias("before"))
    return files.repartition(max(1, spark.sparkContext.defaultParallelism * 4)).mapInArrow(read, columns)


def token_id_table(docs: DataFrame, tokenizer: str, keep_space: bool, end_id: int, folder: str | None = None,
                   with_ids: bool = False) -> DataFrame:
    """Writes ``docs`` to files in ``folder`` (the shared folder where none is given), reads them back."""
    spark = docs.sparkSession
    folder = folder or shared_dir(spark, "id-files")
    return read_ids(spark, write_ids(docs, folder, tokenizer, keep_space, end_id), with_ids)
