"""Embedding whitening: blockwise QR, bidiagonal qd values, twisted directions.

Components become whole numbers, floor(scale * c) + offset, so that sums and deviations are exact. The
rows, centred as (n * x - S) / n before any product, are reduced block by block to a triangular factor
of the dimensions' size; factors meet in rounds of ``FAN`` on the executors until one is left. Its
singular values and right vectors (``bidiagonal``) are the covariance's eigenvalues and directions; no
covariance is ever formed from sums of products. A second pass folds the whitened rows' own covariance
in the same rounds, from block means and centred products, and the last pass returns the rows.

The driver sees one factor and one folded covariance, of the size of the dimensions squared.

Defined cases: rows whose vector is null or holds null or non-finite components are dropped, rows with
null ids stay, repeated rows count each for itself; shorter vectors count as ending in zeros; fewer
dimensions than components asked for give as many components; a component without variance has whitened
and explained zero and is left out of the identity error; a deviation beyond 64 bits is null; an empty
table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gapspark.llm.bidiagonal import eigen_of_gram
from gapspark.llm.common import (
    arrow_limits, arrow_schema, as_limbs, as_lists, batches_of, limb_count, limbs_added, materialize, sound_vectors,
)
from gapspark.llm.vector_codes import LONG, size_of, whole_numbers

SCALE, OFFSET, COMPONENTS = 64, 1_000_000, 32
#: Partial results that meet in one row of work.
FAN = 16
BATCH = 4096
PARTIAL = "at long, n long, first array<double>, second array<double>"


class Centring:
    """Whole vectors of a batch against the sums of all ``n`` vectors."""

    def __init__(self, n: int, sums: list[int], scale: int, offset: int):
        self.n, self.sums, self.scale, self.offset = n, sums, scale, offset

    def exact(self, lists: pa.ListArray) -> np.ndarray:
        """n * x - S: 64-bit numbers, Python's where these might not do."""
        x = whole_numbers(lists, len(self.sums), self.scale) + self.offset
        reach = max((abs(int(v)) for v in (x.max(initial=0), x.min(initial=0))), default=0) if x.size else 0
        if x.dtype == object or reach * self.n + max(map(abs, self.sums), default=0) >= LONG:
            return x.astype(object) * self.n - np.array(self.sums, object)
        return x * self.n - np.array(self.sums, np.int64)

    def centred(self, exact: np.ndarray) -> np.ndarray:
        return exact.astype(np.float64) / self.n


def totals(vectors: DataFrame, dims: int, largest: float, scale: int, offset: int) -> tuple[int, list[int]]:
    """Number of vectors and the exact sum of each dimension."""
    ddl = "n long, sums array<decimal(38,0)>"
    schema, limbs = arrow_schema(ddl), limb_count(largest * scale + offset)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums = 0, np.zeros(dims, object)
        for batch in batches:
            x = whole_numbers(batch.column(0), dims, scale) + offset
            n += len(x)
            sums += x.sum(0) if x.dtype == object or np.abs(x).max(initial=0) < 1 << 50 else x.astype(object).sum(0)
        if n:
            yield pa.RecordBatch.from_arrays(
                [pa.array([n]), pa.array([as_limbs([int(s) for s in sums], limbs)], schema.field("sums").type)], schema=schema)

    parts = materialize(vectors.select("v").mapInArrow(add, ddl), "sums")
    n = parts.agg(F.sum("n")).first()[0] or 0
    sums = limbs_added(parts, "sums", [], limbs).get((), {})
    return n, [sums[i] for i in range(dims)] if n else []


def folded(parts: DataFrame, merge: Callable, purpose: str) -> tuple[int, list[float], list[float]]:
    """One row out of partial results (``PARTIAL``), merged ``FAN`` at a time in the order of ``at``."""
    schema = arrow_schema(PARTIAL)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, items in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                n, first, second = merge([(x["n"], np.array(x["first"]), np.array(x["second"])) for x in items])
                yield pa.RecordBatch.from_arrays(
                    [pa.array([at]), pa.array([n]), pa.array([first.tolist()], pa.list_(pa.float64())),
                     pa.array([second.tolist()], pa.list_(pa.float64()))], schema=schema)

    with arrow_limits(parts.sparkSession, 1):
        parts = materialize(parts, purpose)
        last = parts.agg(F.max("at")).first()[0] or 0
        while True:
            groups = parts.groupBy(F.expr(f"at div {FAN}").alias("at")).agg(
                F.sort_array(F.collect_list(F.struct("at", "n", "first", "second"))).alias("items"))
            parts = materialize(groups.mapInArrow(meet, PARTIAL), purpose)
            if last < FAN:
                row = parts.first()
                return row.n, row.first, row.second
            last //= FAN


def join_factors(items: list[tuple]) -> tuple[int, np.ndarray, np.ndarray]:
    """The triangular factor of stacked ones; ``first`` holds their width."""
    width = int(items[0][1][0])
    stacked = np.vstack([m.reshape(-1, width) for _, _, m in items])
    return sum(n for n, _, _ in items), items[0][1], np.linalg.qr(stacked, mode="r").ravel()


def join_moments(items: list[tuple]) -> tuple[int, np.ndarray, np.ndarray]:
    """Number, mean and centred products of several groups of rows as one."""
    n, mean, products = items[0]
    products = products.reshape(len(mean), len(mean))
    for m, other, more in items[1:]:
        gap = other - mean
        products = products + more.reshape(products.shape) + np.outer(gap, gap) * (n * m / (n + m))
        mean = mean + gap * (m / (n + m))
        n += m
    return n, mean, products.ravel()


def factor(vectors: DataFrame, centring: Centring) -> np.ndarray:
    """The triangular factor of all centred rows."""
    schema, dims = arrow_schema(PARTIAL), len(centring.sums)

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r, n = np.zeros((0, dims)), 0
        for batch in batches:
            rows = centring.centred(centring.exact(batch.column(0)))
            r, n = np.linalg.qr(np.vstack([r, rows]), mode="r"), n + len(rows)
        if n:
            yield pa.RecordBatch.from_arrays(
                [pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([n]),
                 pa.array([[float(dims)]], pa.list_(pa.float64())), pa.array([r.ravel().tolist()], pa.list_(pa.float64()))],
                schema=schema)

    _, _, r = folded(vectors.select("v").mapInArrow(reduce, PARTIAL), join_factors, "factors")
    return np.array(r).reshape(-1, dims)


def whitened_covariance(vectors: DataFrame, centring: Centring, weights: np.ndarray) -> np.ndarray:
    """The covariance of the whitened rows, from a pass over them."""
    schema, width = arrow_schema(PARTIAL), weights.shape[1]

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            rows = centring.centred(centring.exact(batch.column(0))) @ weights
            if len(rows):
                mean = rows.mean(0)
                own = (len(rows), mean, ((rows - mean).T @ (rows - mean)).ravel())
                held = join_moments([held, own]) if held else own
        if held:
            yield pa.RecordBatch.from_arrays(
                [pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([held[0]]),
                 pa.array([held[1].tolist()], pa.list_(pa.float64())), pa.array([held[2].tolist()], pa.list_(pa.float64()))],
                schema=schema)

    n, _, products = folded(vectors.select("v").mapInArrow(measure, PARTIAL), join_moments, "moments")
    return np.array(products).reshape(width, width) / n


def whitened(table: DataFrame, components: int = COMPONENTS, scale: int = SCALE, offset: int = OFFSET,
             vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """vec_id, component (from 1), n, deviation (sum over the dimensions of (n*x - S)**2), whitened,
    explained and identity_error, a row for every sound vector and component."""
    spark = table.sparkSession
    batches_of(spark)
    result = ("vec_id long, component int, n long, deviation long, whitened double, explained double, "
              "identity_error double")
    with arrow_limits(spark, BATCH):
        vectors = materialize(sound_vectors(table, vec_id, embedding), "sound-vectors")
        dims, largest = size_of(vectors)
        if not dims:
            return spark.createDataFrame([], result)
        n, sums = totals(vectors, dims, largest, scale, offset)
        centring = Centring(n, sums, scale, offset)
        r = factor(vectors, centring)
        values, directions = eigen_of_gram(r)
        values = values / n
        # either sign will do; the largest entry is positive
        signs = np.sign(directions[np.abs(directions).argmax(0), np.arange(dims)])
        kept = min(components, dims)
        values, trace = values[:kept], float(values.sum())
        weights = (directions * signs)[:, :kept] / np.sqrt(np.where(values > 0, values, 1)) * (values > 0)
        explained = values / trace if trace > 0 else np.zeros(kept)
        live = np.flatnonzero(values > 0)
        error = 0.0
        if len(live):
            error = float(np.abs(whitened_covariance(vectors, centring, weights[:, live]) - np.eye(len(live))).max())
    each = "vec_id long, n long, deviation long, whitened array<double>"
    schema = arrow_schema(each)

    def whiten(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            exact = centring.exact(batch.column(1))
            reach = max((abs(int(v)) for v in (exact.max(), exact.min())), default=0) if exact.size else 0
            if reach * reach * dims >= LONG:
                exact = exact.astype(object)
            deviation = [int(d) if d < LONG else None for d in (exact * exact).sum(1)]
            rows = centring.centred(exact) @ weights
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(np.full(len(rows), n)), pa.array(deviation, pa.int64()),
                 as_lists(rows.ravel(), np.full(len(rows), kept), pa.float64())], schema=schema)

    shares = F.array(*[F.lit(float(x)) for x in explained])
    rows = vectors.mapInArrow(whiten, each).select(
        "vec_id", "n", "deviation", F.posexplode("whitened").alias("at", "whitened"))
    return rows.select(
        "vec_id", (F.col("at") + 1).cast("int").alias("component"), "n", "deviation", "whitened",
        F.get(shares, F.col("at")).alias("explained"), F.lit(error).alias("identity_error"))
