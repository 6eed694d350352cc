"""Exact top-k inner-product search by an impact-ordered index, score at a time.

Vectors are whole numbers. The index of a block quantises the impact of every component, its size, to
halvings of the largest one; a posting segment holds, for one dimension and one such level, the vectors
with a component there. Queries take the segments of all dimensions level by level, in descending order
of impact, many queries at once. After each level every vector has a score so far and a proven bound on
what is left: the lesser of the query's length times that of the vector's components still to come, and
the sum of the query's weights times the next impact. Vectors whose bound stays below the query's
bar are out, whatever their later components. When scoring the others exactly costs less than the next
segments, that is done; without any proof all segments are taken, which is the exact score too.

The bar is a proven lower bound of a query's k-th best score: the k-th best exact score in a sample of
``SAMPLE`` candidates, found before any block is searched, so it holds in every block. Every block is
one task's work: its index is built once and all query blocks stream past it. The best of all blocks
are merged per query.

Scores are exact: products are summed in single or double precision only where no sum leaves the whole
numbers that these hold, else in Python's unbounded ones.

Defined cases: vectors null, or holding null or non-finite components, take no part, nor do rows without
id; nor, as their scores fit no 64-bit number, do those with a component of 2**58 or more after scaling;
a score beyond 64 bits ranks by its value and is null. Rows that repeat an id count once (the smallest
vector stays), shorter vectors count as ending in zeros; fewer candidates than k give all of them; an
empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gapspark.llm.common import arrow_limits, arrow_schema, batches_of, in_chunks, materialize, sound_vectors

BLOCK, QUERY_BLOCK = 4096, 512
#: Candidates that give every query its first bar; a hash picks them.
SAMPLE = 4096
LEVELS = 6
#: How many components of a segment are taken in the time of scoring one alone.
SCORE_COST = 16
LARGEST = 1 << 58


def whole_vectors(table: DataFrame, scale: int, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """vec_id and v, the components as floor(scale * x), of the rows that take part."""
    sound = sound_vectors(table, vec_id, embedding).where(
        F.col("vec_id").isNotNull() & F.forall("v", lambda x: F.abs(x) * scale < LARGEST))
    whole = sound.select("vec_id", F.transform("v", lambda x: F.floor(x * scale)).alias("v"))
    return whole.groupBy("vec_id").agg(F.min("v").alias("v"))


def exact_kind(a: np.ndarray, b: np.ndarray) -> type:
    """The kind of number in which all products of rows of ``a`` and ``b`` add up exactly."""
    if not a.size or not b.size:
        return np.float32
    reach = int(np.abs(a).max()) * int(np.abs(b).max()) * a.shape[1]
    return np.float32 if reach < 1 << 24 else np.float64 if reach < 1 << 53 else object


class ImpactIndex:
    """Posting segments of one block of vectors. ``segments[i]`` holds the dimensions that have postings
    at level i and, a row per dimension, their components at the vectors' places."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, levels: int = LEVELS):
        self.ids, self.vectors = ids, vectors
        self.n, self.dims = vectors.shape
        size = np.abs(vectors).astype(np.float64)
        self.peak = float(size.max(initial=0))
        self.segments, self.left, self.impact = [], [], []
        above = np.inf
        for level in range(levels):
            least = self.peak / 2 ** (level + 1) if level < levels - 1 else -1.0
            here = (size > least) & (size <= above)
            dims = np.flatnonzero(here.any(0))
            self.segments.append((dims, np.ascontiguousarray(np.where(here, vectors, 0)[:, dims].T)))
            self.left.append(np.sqrt((np.where(size <= least, size, 0) ** 2).sum(1)) * (1 + 1e-6))
            self.impact.append(max(0.0, least))
            above = least

    def possible(self, queries: np.ndarray, bars: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """(query, vector) places that may reach the query's bar, and the number of levels taken."""
        kind = exact_kind(queries, self.vectors)
        if kind is object:
            return *np.nonzero(np.ones((len(queries), self.n), bool)), 0
        weights = queries.astype(kind)
        length = np.sqrt((queries.astype(np.float64) ** 2).sum(1)) * (1 + 1e-6)
        total = np.abs(queries).sum(1).astype(np.float64)
        score = np.zeros((len(queries), self.n), kind)
        for level, (dims, postings) in enumerate(self.segments):
            if len(dims):
                score += weights[:, dims] @ postings.astype(kind)
            left, impact = self.left[level], self.impact[level]
            rest = np.minimum(np.outer(length, left), (total * impact)[:, None]).astype(np.float32)
            rest *= np.float32(1 + 1e-5)
            reach = score + rest >= bars[:, None]
            if level == len(self.segments) - 1:
                break
            if np.count_nonzero(reach) * self.dims * SCORE_COST <= reach.size * len(self.segments[level + 1][0]):
                break
        return *np.nonzero(reach), level + 1

    def search(self, queries: np.ndarray, bars: np.ndarray, k: int, own: np.ndarray) -> tuple[np.ndarray, np.ndarray, list]:
        """Query places, vector places and exact scores of the block's members that can be among the k
        best, own ids aside: at most k a query, best first."""
        kind = exact_kind(queries, self.vectors)
        i, j, _ = self.possible(queries, bars)
        other = self.ids[j] != own[i]
        i, j = i[other], j[other]
        scores = np.zeros(len(i), object if kind is object else np.float64)
        a, b = queries.astype(scores.dtype), self.vectors.astype(scores.dtype)
        for at in range(0, len(i), 1 << 16):
            cut = slice(at, at + (1 << 16))
            scores[cut] = (a[i[cut]] * b[j[cut]]).sum(1)
        good = scores >= bars[i]
        i, j, scores = i[good], j[good], scores[good]
        if kind is object:
            order = np.array(sorted(range(len(i)), key=lambda x: (i[x], -scores[x], self.ids[j[x]])), np.int64)
        else:
            order = np.lexsort((self.ids[j], -scores, i))
        i, j, scores = i[order], j[order], scores[order]
        rank = np.arange(len(i)) - np.searchsorted(i, i)
        return i[rank < k], j[rank < k], [int(s) for s in scores[rank < k]]


def matrix(lists: pa.ListArray, dims: int) -> np.ndarray:
    """Vectors as rows; shorter ones end in zeros."""
    sizes = np.diff(lists.offsets.to_numpy())
    out = np.zeros((len(sizes), dims), np.int64)
    out[np.arange(dims)[None, :] < sizes[:, None]] = lists.flatten().to_numpy()
    return out


def top_k(vectors: DataFrame, queries: DataFrame, k: int, block: int = BLOCK, query_block: int = QUERY_BLOCK,
          sample: int = SAMPLE) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k best of ``vectors`` for each of ``queries``, its
    own id aside; ties go to the smaller id. Both have vec_id (unique) and v (whole numbers)."""
    spark = vectors.sparkSession
    batches_of(spark)
    size = F.max(F.size("v"))
    (n, wide), (n_queries, wide_queries) = (t.agg(F.count("*"), size).first() for t in (vectors, queries))
    dims = max(wide or 0, wide_queries or 0)
    blocks, query_blocks = max(1, -(-n // block)), max(1, -(-n_queries // query_block))
    few = vectors.orderBy(F.xxhash64("vec_id")).limit(sample).collect()  # a bounded number of rows
    few_ids = np.array([r.vec_id for r in few], np.int64)
    few_rows = matrix(pa.array([r.v for r in few], pa.list_(pa.int64())), dims)
    asked = "q long, vec_ids array<long>, vs array<array<long>>, bars array<decimal(38,0)>"
    schema = arrow_schema(asked)

    def gathered(table: DataFrame, parts: int, name: str) -> DataFrame:
        dealt = table.withColumn(name, F.pmod(F.xxhash64("vec_id"), F.lit(parts)))
        return dealt.groupBy(name).agg(F.collect_list(F.struct("vec_id", "v")).alias("rows"))

    def first_bars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from decimal import Decimal

        known = ImpactIndex(few_ids, few_rows, 1)
        for batch in batches:
            for q, rows in zip(batch.column(0).to_pylist(), batch.column(1)):
                names, lists = rows.values.flatten()
                names, own = names.to_numpy(), matrix(lists, dims)
                i, _, scores = known.search(own, np.full(len(own), -np.inf), k, names)
                bars = [None] * len(own)
                for place, at in enumerate(i.tolist()):  # the last of k scores stays
                    if place - np.searchsorted(i, at) == k - 1:
                        bars[at] = Decimal(scores[place])
                yield pa.RecordBatch.from_arrays(
                    [pa.array([q]), pa.array([names.tolist()], pa.list_(pa.int64())),
                     pa.array([own.tolist()], schema.field("vs").type), pa.array([bars], schema.field("bars").type)], schema=schema)

    with arrow_limits(spark, 1):
        barred = materialize(gathered(queries, query_blocks, "q").mapInArrow(first_bars, asked), "query-blocks")
    # a block's own row comes first in its task, then every query block's
    index = gathered(vectors, blocks, "b").select(
        "b", F.lit(-1).cast("long").alias("q"), F.col("rows.vec_id").alias("vec_ids"), F.col("rows.v").alias("vs"),
        F.array().cast("array<decimal(38,0)>").alias("bars"))
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("b")
    work = index.unionByName(barred.select(every, "q", "vec_ids", "vs", "bars"))
    work = work.repartitionByRange(min(blocks, 4096), "b").sortWithinPartitions("b", "q")
    ddl = "query_id long, vec_id long, score decimal(38,0)"
    found_schema = arrow_schema(ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from decimal import Decimal

        def rows():
            held = None
            for batch in batches:
                for b, q, names, lists, bars in zip(*batch.columns):
                    names, own = names.values.to_numpy(), matrix(lists.values, dims)
                    if q.as_py() < 0:
                        held = b.as_py(), ImpactIndex(names, own)
                    elif held and held[0] == b.as_py():
                        index = held[1]
                        bars = bars.as_py()
                        kind = exact_kind(own, index.vectors)
                        least = np.array([-np.inf if x is None else int(x) if kind is object else float(x) for x in bars],
                                         object if kind is object else np.float64)
                        for i, j, score in zip(*index.search(own, least, k, names)):
                            yield int(names[i]), int(index.ids[j]), Decimal(score)

        yield from in_chunks(rows(), found_schema)

    with arrow_limits(spark, 1):
        found = materialize(work.mapInArrow(run, ddl), "block-bests")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    fits = F.col("score").between(F.lit(str(-(1 << 63))).cast("decimal(38,0)"), F.lit(str((1 << 63) - 1)).cast("decimal(38,0)"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select(
        "query_id", F.col("rank").cast("int").alias("rank"), "vec_id", F.when(fits, F.col("score").cast("long")).alias("score"))
