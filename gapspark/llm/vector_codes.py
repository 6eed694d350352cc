"""Vector code compression: product codes by Lloyd's rounds on cover trees, in whole numbers.

Vectors become whole numbers, floor(scale * x), and are cut into ``parts`` equal pieces. Every Arrow
batch of a partition builds one cover tree a part: the points of a node lie within its radius of its
centre, its children halve the radius, small nodes are leaves. Points are stored in tree order, so
every node is a range of them, and running totals of the points give a node's sum at once.

A round assigns whole nodes: if the nearest entry of a node's centre is nearer than any other entry by
more than twice the radius, the triangle inequality proves it nearest to all points under the node,
which go to it by sum and count. Other nodes pass on to their children, and points of ambiguous leaves
are compared exactly. Sums and counts per entry, one row per partition and entry, add up by
aggregation; the driver holds the codebooks alone (``parts`` x ``entries`` short lists). Trees are
written once to the shared folder and read in each round.

All distances that decide are exact: products stay below 2**53 in doubles, or the batch's points are
compared one entry at a time in Python's unbounded integers. Sums travel as decimals, in limbs.

Defined cases: vectors null or holding null or non-finite components are dropped; shorter vectors count
as ending in zeros, and so do dimensions that are not a multiple of the parts; fewer rows than entries
make smaller codebooks; rows with null ids take part and come last in the order of the first entries,
repeated rows take part each for itself (of equal ids the smaller vector is the earlier entry); a
distance sum beyond 64 bits is null; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gapspark.llm.common import (
    arrow_limits, arrow_schema, as_limbs, batches_of, limb_count, limbs_added, materialize, sound_vectors,
)

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
BATCH = 4096
#: Nodes of so few points are not split further.
LEAF = 16
#: Bounds on distances are widened by this share for what doubles round.
SLACK = 1e-9
LONG = 1 << 63


def whole_numbers(lists: pa.ListArray, dims: int, scale: int) -> np.ndarray:
    """floor(scale * x) of every component, shorter vectors ending in zeros: 64-bit numbers or, where
    some do not fit the fast way, Python's."""
    sizes = np.diff(lists.offsets.to_numpy())
    flat = np.floor(lists.flatten().to_numpy(zero_copy_only=False) * scale)
    fast = not len(flat) or np.abs(flat).max() < 2**50
    out = np.zeros((len(sizes), dims), np.int64 if fast else object)
    values = flat.astype(np.int64) if fast else np.array(
        [int(v) if np.isfinite(v) else int(np.floor(x)) * scale
         for v, x in zip(flat.tolist(), lists.flatten().to_pylist())], object)
    out[np.arange(dims)[None, :] < sizes[:, None]] = values
    return out


def size_of(vectors: DataFrame) -> tuple[int, float]:
    """The most components a vector has, and the largest absolute one."""
    largest = F.max(F.array_max(F.transform("v", lambda x: F.abs(x))))
    dims, peak = vectors.agg(F.max(F.size("v")), largest).first()
    return dims or 0, peak or 0.0


def fits(points: np.ndarray, entries: np.ndarray) -> bool:
    """Whether squared distances of these are exact in doubles."""
    if points.dtype == object or entries.dtype == object or not points.size:
        return not points.size
    reach = int(np.abs(points).max()) + int(np.abs(entries).max(initial=0))
    return reach * reach * points.shape[1] < 1 << 52


def squares(points: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Squared distances of all points and entries, exact if ``fits``."""
    p, e = points.astype(np.float64), entries.astype(np.float64)
    return (p * p).sum(1)[:, None] - 2 * (p @ e.T) + (e * e).sum(1)[None, :]


def distances(points: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Distances of all points and entries, right to the last digits at any size."""
    if fits(points, entries):
        return np.sqrt(squares(points, entries))
    p, e = points.astype(np.float64), entries.astype(np.float64)
    return np.stack([np.sqrt(((p - x) ** 2).sum(1)) for x in e], 1)


def nearest_entries(points: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """The nearest entry of every point by exact comparison, the lower index of equals."""
    if fits(points, entries):
        return np.concatenate([squares(points[at : at + 4096], entries).argmin(1) for at in range(0, len(points), 4096)]
                              or [np.zeros(0, np.int64)])
    book = [[int(x) for x in e] for e in entries]
    return np.array([min(range(len(book)), key=lambda j: (sum((int(x) - y) ** 2 for x, y in zip(p, book[j])), j))
                     for p in points], np.int64)


class CoverTree:
    """Points in tree order; node i is the range start[i]..end[i] of them, within radius[i] of
    centre[i]; its children are first[i]..last[i] (none: a leaf)."""

    def __init__(self, points: np.ndarray, leaf: int = LEAF):
        n = len(points)
        real = points.astype(np.float64)
        self.order = np.arange(n)
        start, end, centre, radius, first, last = [0], [n], [0], [0.0], [0], [0]
        if n:
            radius[0] = float(np.sqrt(((real - real[0]) ** 2).sum(1).max()))
        at = 0
        while at < len(start):
            a, b, r = start[at], end[at], radius[at]
            if b - a > leaf and r > 0:
                first[at] = len(start)
                left, place = self.order[a:b].copy(), a
                while len(left):
                    away = ((real[left] - real[left[0]]) ** 2).sum(1)
                    near = away <= r * r / 4
                    mine = left[near]
                    self.order[place : place + len(mine)] = mine
                    start.append(place)
                    end.append(place + len(mine))
                    centre.append(int(left[0]))
                    radius.append(float(np.sqrt(away[near].max())))
                    first.append(0)
                    last.append(0)
                    place += len(mine)
                    left = left[~near]
                last[at] = len(start)
            at += 1
        self.start, self.end, self.first, self.last = (np.array(x, np.int64) for x in (start, end, first, last))
        self.radius = np.array(radius)
        self.points = points[self.order]
        self.centres = points[centre] if n else points[:0]
        self.add_up()

    def add_up(self) -> None:
        totals = np.cumsum(self.points, axis=0)
        self.totals = np.concatenate([np.zeros((1, self.points.shape[1]), totals.dtype), totals])

    def packed(self) -> dict:
        """What a file holds of the tree; the running totals are added up again."""
        small = {k: v.astype(np.int32) for k, v in vars(self).items()
                 if v.dtype == np.int64 and (not v.size or np.abs(v).max() < 1 << 31)}
        return {k: v for k, v in (vars(self) | small).items() if k != "totals"}

    @classmethod
    def unpacked(cls, held: dict) -> CoverTree:
        tree = object.__new__(cls)
        for k, v in held.items():
            setattr(tree, k, v.astype(np.int64) if v.dtype == np.int32 else v)
        tree.add_up()
        return tree

    def assign(self, entries: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int]]]:
        """The nearest entry of every point in tree order, and the nodes that went as a whole (node,
        entry); the points compared one by one are in none of them."""
        best = np.full(len(self.points), -1, np.int64)
        whole: list[tuple[int, int]] = []
        level = np.arange(min(1, len(self.points)))
        open_leaves = []
        while len(level):
            away = distances(self.centres[level], entries)
            near = away.argmin(1)
            least = away[np.arange(len(level)), near]
            away[np.arange(len(level)), near] = np.inf
            second = away.min(1)
            margin = SLACK * (self.scale_of(entries) + second_or_zero(second))
            sure = second - least > 2 * self.radius[level] + margin
            for node, entry in zip(level[sure].tolist(), near[sure].tolist()):
                best[self.start[node] : self.end[node]] = entry
                whole.append((node, entry))
            rest = level[~sure]
            inner = self.first[rest] > 0
            open_leaves.append(rest[~inner])
            level = np.concatenate([np.arange(self.first[i], self.last[i]) for i in rest[inner]] or [np.zeros(0, np.int64)])
        places = np.flatnonzero(best < 0)
        best[places] = nearest_entries(self.points[places], entries)
        return best, whole

    def scale_of(self, entries: np.ndarray) -> float:
        """The size of numbers that distances are computed from."""
        return (float(np.abs(self.points).max()) + float(np.abs(entries).max())) * self.points.shape[1]

    def sums(self, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sum and count of the points of every entry, whole nodes by their running totals."""
        best, whole = self.assign(entries)
        total = np.zeros((len(entries), self.points.shape[1]), object)
        count = np.zeros(len(entries), np.int64)
        alone = np.ones(len(best), bool)
        for node, entry in whole:
            a, b = self.start[node], self.end[node]
            total[entry] += self.totals[b] - self.totals[a]
            count[entry] += b - a
            alone[a:b] = False
        own = np.zeros((len(entries), self.points.shape[1]), self.points.dtype)
        np.add.at(own, best[alone], self.points[alone])
        return total + own, count + np.bincount(best[alone], minlength=len(entries))


def second_or_zero(values: np.ndarray) -> np.ndarray:
    """Distances of the second nearest entry; where only one entry exists, none matters."""
    return np.where(np.isfinite(values), values, 0)


def planted(vectors: DataFrame, dims: int, parts: int, scale: int, batch: int) -> DataFrame:
    """One row a batch of rows: its ids, labels and trees."""
    ddl = "ids array<long>, labels array<string>, trees binary"
    schema = arrow_schema(ddl)
    width = dims // parts

    def plant(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            points = whole_numbers(rows.column(1), dims, scale)
            trees = [CoverTree(points[:, p * width : (p + 1) * width]) for p in range(parts)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([rows.column(0).to_pylist()], pa.list_(pa.int64())),
                 pa.array([rows.column(2).to_pylist()], pa.list_(pa.string())),
                 pa.array([pickle.dumps([t.packed() for t in trees])], pa.binary())], schema=schema)

    with arrow_limits(vectors.sparkSession, batch):
        return materialize(vectors.select("vec_id", "v", "label").mapInArrow(plant, ddl), "cover-trees")


def next_codebooks(trees: DataFrame, books: list[list[tuple[int, ...]]], width: int,
                   limbs: int) -> list[list[tuple[int, ...]]]:
    """One of Lloyd's rounds."""
    ddl = "part int, entry int, n long, sums array<decimal(38,0)>"
    schema = arrow_schema(ddl)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrays = [as_array(b, width) for b in books]
        total = [np.zeros(a.shape, object) for a in arrays]
        count = [np.zeros(len(a), np.int64) for a in arrays]
        for rows in batches:
            for blob in rows.column(0).to_pylist():
                for p, tree in enumerate(map(CoverTree.unpacked, pickle.loads(blob))):
                    sums, n = tree.sums(arrays[p])
                    total[p] += sums
                    count[p] += n
        found = [(p, j, int(count[p][j]), as_limbs([int(x) for x in total[p][j]], limbs))
                 for p in range(len(books)) for j in np.flatnonzero(count[p]).tolist()]
        if found:
            columns = list(zip(*found))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

    with arrow_limits(trees.sparkSession, 1):
        partial = materialize(trees.select("trees").mapInArrow(assign, ddl), "codebook-sums")
    counts = {(r.part, r.entry): r.n for r in partial.groupBy("part", "entry").agg(F.sum("n").alias("n")).collect()}
    moved = [list(b) for b in books]
    for key, sums in limbs_added(partial, "sums", ["part", "entry"], limbs).items():
        moved[key[0]][key[1]] = tuple(sums[i] // counts[key] for i in range(width))
    return moved


def as_array(book: list[tuple[int, ...]], width: int) -> np.ndarray:
    big = max((abs(x) for e in book for x in e), default=0) >= 1 << 50
    return np.array(book, object if big else np.int64).reshape(len(book), width)


def vector_codes(table: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE,
                 vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label",
                 batch: int = BATCH) -> tuple[DataFrame, list[list[tuple[int, ...]]]]:
    """vec_id, label, code (entry per part, as hex digits) and error (squared distances, summed over
    the parts) of every sound vector; and the codebooks, a list of entries per part."""
    spark = table.sparkSession
    batches_of(spark)
    named = table.withColumn(label, F.lit(None).cast("string")) if label not in table.columns else table
    vectors = sound_vectors(named, vec_id, embedding, (label,)).withColumnRenamed(label, "label")
    vectors = materialize(vectors.withColumn("label", F.col("label").cast("string")), "sound-vectors")
    dims, largest = size_of(vectors)
    dims, limbs = -(-dims // parts) * parts, limb_count(largest * scale)
    width = dims // parts
    first = vectors.orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(entries).select("v").collect()
    heads = whole_numbers(pa.array([r.v for r in first], pa.list_(pa.float64())), dims, scale)
    books = [[tuple(int(x) for x in row[p * width : (p + 1) * width]) for row in heads] for p in range(parts)]
    trees = planted(vectors, dims, parts, scale, batch)
    for _ in range(rounds):
        books = next_codebooks(trees, books, width, limbs)
    ddl = "vec_id long, label string, code string, error long"
    schema = arrow_schema(ddl)
    digits = max(2, len(f"{max(0, entries - 1):x}"))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrays = [as_array(b, width) for b in books]
        for rows in batches:
            for ids, labels, blob in zip(*(c.to_pylist() for c in rows.columns)):
                codes, errors = np.zeros((len(ids), parts), np.int64), np.zeros(len(ids), object)
                for p, tree in enumerate(map(CoverTree.unpacked, pickle.loads(blob))):
                    best, _ = tree.assign(arrays[p])
                    codes[tree.order, p] = best
                    exact = np.int64 if fits(tree.points, arrays[p]) else object
                    apart = tree.points.astype(exact) - arrays[p].astype(exact)[best]
                    errors[tree.order] += (apart * apart).sum(1)
                text = ["".join(f"{j:0{digits}x}" for j in row) for row in codes.tolist()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids, pa.int64()), pa.array(labels, pa.string()), pa.array(text, pa.string()),
                     pa.array([int(e) if e < LONG else None for e in errors], pa.int64())], schema=schema)

    with arrow_limits(spark, 1):
        coded = materialize(trees.mapInArrow(encode, ddl), "vector-codes")
    kind = named.schema[label].dataType
    return coded.withColumn("label", F.col("label").cast(kind)), books


def codebooks_sha256(books: list[list[tuple[int, ...]]]) -> str:
    """Of all entries' components as decimal numbers by part, entry and place, joined by commas."""
    return hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()


def code_report(coded: DataFrame, books: list[list[tuple[int, ...]]]) -> DataFrame:
    """vec_id, code, error, label_error (the error of all rows of the label, nulls together) and
    codebooks_sha256."""
    by_label = coded.groupBy("label").agg(F.sum("error").alias("label_error"))
    mine, its = coded.alias("c"), by_label.withColumnRenamed("label", "its").alias("l")
    return mine.join(its, F.col("c.label").eqNullSafe(F.col("l.its"))).select(
        "vec_id", "code", "error", "label_error", F.lit(codebooks_sha256(books)).alias("codebooks_sha256"))
