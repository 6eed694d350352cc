"""Helpers shared by the operators of this folder."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gapspark.session import materialize, shared_dir

__all__ = ["batches_of", "hash_pair", "materialize", "rows_to_batch", "shared_dir", "texts", "worker_state"]

BATCH_ROWS = 1000
BATCH_BYTES = 16 << 20


def batches_of(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Bounds what one Arrow batch brings into a Python worker: texts may be very long."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


@contextmanager
def arrow_limits(spark: SparkSession, rows: int = BATCH_ROWS):
    """As ``batches_of``, for the jobs that run inside the block only."""
    names = ("spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch")
    before = [spark.conf.get(n) for n in names]
    batches_of(spark, rows)
    try:
        yield
    finally:
        for name, value in zip(names, before):
            spark.conf.set(name, value)


def hash_pair(value: Column) -> tuple[Column, Column]:
    """Two independent 64-bit hashes that together stand for a value."""
    return F.xxhash64(value), F.xxhash64(F.lit(7), value)


def worker_state() -> dict:
    """What a Python worker keeps from task to task.

    Functions of this package travel to the workers by value, so their modules' globals do not last.
    """
    import sys

    return sys.__dict__.setdefault("_gapspark_worker_state", {})


def texts(batch: pa.RecordBatch, name: str) -> list[str]:
    """The texts of a batch; null counts as empty."""
    return [t or "" for t in batch.column(name).to_pylist()]


def arrow_schema(schema: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(T.StructType.fromDDL(schema))


def rows_to_batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [[] for _ in schema]
    return pa.RecordBatch.from_arrays(
        [pa.array(c, type=f.type) for c, f in zip(columns, schema)], schema=schema
    )


def in_chunks(rows: Iterator[tuple], schema: pa.Schema, size: int = 4096) -> Iterator[pa.RecordBatch]:
    """Batches of ``size`` rows, so that a task never holds its whole output."""
    kept: list[tuple] = []
    for row in rows:
        kept.append(row)
        if len(kept) >= size:
            yield rows_to_batch(kept, schema)
            kept = []
    if kept:
        yield rows_to_batch(kept, schema)


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def sound_vectors(table: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", keep: tuple[str, ...] = ()) -> DataFrame:
    """vec_id and v (array of double) of the rows whose vector is neither null nor holds null or
    non-finite components, and the columns ``keep``."""
    raw = F.col(f"`{embedding}`")
    finite = lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf"))
    return table.where(raw.isNotNull() & F.forall(raw, finite)).select(
        F.col(f"`{vec_id}`").cast("long").alias("vec_id"), raw.cast("array<double>").alias("v"),
        *[F.col(f"`{c}`") for c in keep])


def vector_matrix(lists: pa.ListArray, dims: int) -> np.ndarray:
    """Vectors as rows of ``dims`` components; shorter ones end in zeros."""
    sizes = np.diff(lists.offsets.to_numpy())
    out = np.zeros((len(sizes), dims))
    out[np.arange(dims)[None, :] < sizes[:, None]] = lists.flatten().to_numpy(zero_copy_only=False)
    return out


def fixed_width(values: pa.BinaryArray, width: int) -> np.ndarray:
    """Binary values of one length as rows of bytes."""
    offsets = np.frombuffer(values.buffers()[1], np.int32)[values.offset : values.offset + len(values) + 1]
    if not len(values) or values.buffers()[2] is None:
        return np.zeros((len(values), width), np.uint8)
    return np.frombuffer(values.buffers()[2], np.uint8)[offsets[0] : offsets[-1]].reshape(len(values), width)


def as_lists(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, kind))


#: Whole numbers of any size travel as decimals of so many digits each, sums of which still fit 38.
LIMB = 10**30


def limb_count(largest: float) -> int:
    """How many limbs hold sums of numbers of this size."""
    return 1 + len(str(int(largest) << 64)) // 30


def as_limbs(values: list[int], limbs: int) -> list[Decimal]:
    """Every number as ``limbs`` decimals, the lowest first; the last one carries the sign."""
    out = []
    for value in values:
        for _ in range(limbs - 1):
            value, low = divmod(value, LIMB)
            out.append(Decimal(low))
        out.append(Decimal(value))
    return out


def limbs_added(parts: DataFrame, column: str, keys: list[str], limbs: int) -> dict[tuple, dict[int, int]]:
    """Sums of lists of numbers in limbs, per keys and place; what comes to the driver is a row for each
    key, place and limb."""
    each = parts.select(*keys, F.posexplode(column).alias("at", "x"))
    found: dict[tuple, dict[int, int]] = {}
    for r in each.groupBy(*keys, "at").agg(F.sum("x").cast("decimal(38,0)").alias("x")).collect():
        place, limb = divmod(r["at"], limbs)
        own = found.setdefault(tuple(r[k] for k in keys), {})
        own[place] = own.get(place, 0) + int(r["x"]) * LIMB**limb
    return found
