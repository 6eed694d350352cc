"""Best-fit packing of token pieces by a grouping genetic algorithm.

Pieces are dealt at random into blocks of about ``BLOCK`` and each block is packed by ``ISLANDS``
islands, which are Spark rows. An island's population starts from best-fit-decreasing, exact-fill and
random-order packings. Crossover injects whole well-filled bins of one parent into the other, removes every bin that
then holds an injected piece twice, exchanges the pieces that lost their bin for smaller ones of other
bins where that fills these better, and best-fits what is left. After the first epoch
each island receives the elite of its neighbour, evolves on, and the best packing of a block stays.
A population runs through all its generations unless it reaches a bound that no packing can beat
(``least_bins``). Pieces that fill a sequence lie alone in every packing and take no part, nor do two that fill
one together: some best packing has them so (``exact_pairs``).

Only piece lengths travel to the islands; a block has a bounded number of them, so no task grows
with the input. At most one bin of a block is lost against packing all blocks as one.

Defined cases: an empty table gives no rows; a null text counts as empty and holds the end id alone;
repeated rows are packed each for itself; null document ids are kept.
"""

from __future__ import annotations

import random
import zlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gapspark.llm.common import arrow_schema, batches_of, in_chunks, materialize
from gapspark.llm.encoding import encoder

BLOCK = 4096
ISLANDS = 2
POPULATION = 6
GENERATIONS = 24
#: Pieces that are tried as the first of three to fill a bin exactly.
TRIED = 48
#: Bins of more pieces than this are not searched for exchanges.
MOST_SWAPPED = 24
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def piece_lengths(n: int, capacity: int) -> list[int]:
    """A document's pieces: whole ones of ``capacity``, the first may be shorter."""
    whole, rest = divmod(n, capacity)
    return [rest] * (rest > 0) + [capacity] * whole


def token_pieces(docs: DataFrame, tokenizer: str, keep_space: bool, end_id: int, capacity: int,
                 doc_id: str = "doc_id", text: str = "text", with_ids: bool = False) -> DataFrame:
    """Pieces of every document: doc_id, piece, start, length, ids_crc32 and, if wanted, the ids as
    unsigned 32-bit little-endian bytes."""
    batches_of(docs.sparkSession)
    columns = PIECES + ", ids binary" * with_ids
    schema = arrow_schema(columns)
    end = np.array([end_id], "<u4").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(tokenizer, keep_space)

        def rows():
            for batch in batches:
                for name, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    ids, start = coder.encode(value or "") + end, 0
                    for piece, length in enumerate(piece_lengths(len(ids) // 4, capacity)):
                        own = ids[4 * start : 4 * (start + length)]
                        yield (name, piece, start, length, zlib.crc32(own), *([own] if with_ids else []))
                        start += length

        yield from in_chunks(rows(), schema)

    return docs.select(F.col(doc_id).cast("long"), F.col(text)).mapInArrow(cut, columns)


class Packing:
    """Bins of one block: ``bins[i]`` is the bin of piece i, ``loads`` the tokens of each bin."""

    def __init__(self, bins: np.ndarray, lengths: np.ndarray, capacity: int):
        self.bins = np.unique(bins, return_inverse=True)[1].astype(np.int32)
        self.loads = np.bincount(self.bins, weights=lengths).astype(np.int64)
        self.count = len(self.loads)
        self.fitness = (self.count, -float(((self.loads / capacity) ** 2).sum()))


def best_fit(bins: np.ndarray, loads: list[int], loose: np.ndarray, lengths: np.ndarray, capacity: int) -> None:
    """Puts the ``loose`` pieces, longest first, each into the fullest bin that still takes it."""
    room: dict[int, list[int]] = {}
    mask = 0
    filled = np.array(loads, np.int64)
    for b in np.flatnonzero((filled < capacity) & (filled >= 0)).tolist():
        room.setdefault(capacity - loads[b], []).append(b)
    for free in room:
        mask |= 1 << free
    order = loose[np.argsort(-lengths[loose], kind="stable")]
    chosen = []
    for need in lengths[order].tolist():
        fits = mask >> need
        if fits:
            free = need + (fits & -fits).bit_length() - 1
            held = room[free]
            b = held.pop()
            if not held:
                mask ^= 1 << free
            loads[b] += need
        else:
            b, free = len(loads), capacity
            loads.append(need)
        chosen.append(b)
        if left := free - need:
            if held := room.get(left):
                held.append(b)
            else:
                room[left] = [b]
                mask |= 1 << left
    bins[order] = chosen


def exact_pairs(lengths: np.ndarray, capacity: int) -> np.ndarray:
    """Bins of pieces that pair up to exactly ``capacity``, -1 for the others. No packing is lost by it: in any
    packing of two such pieces in different bins, one can trade places with all that lies beside the other."""
    held: dict[int, list[int]] = {}
    bins, count = np.full(len(lengths), -1, np.int32), 0
    for i, size in enumerate(lengths.tolist()):
        if others := held.get(capacity - size):
            bins[i] = bins[others.pop()] = count
            count += 1
        else:
            held.setdefault(size, []).append(i)
    return bins


def packed(lengths: np.ndarray, capacity: int, shake: random.Random | None = None) -> Packing:
    """Best-fit decreasing; ``shake`` blurs the order to start other members of a population."""
    bins = np.full(len(lengths), -1, np.int32)
    if shake is None:
        best_fit(bins, [], np.arange(len(lengths)), lengths, capacity)
    else:
        loads: list[int] = []
        order = np.array(shake.sample(range(len(lengths)), len(lengths)))
        for part in np.array_split(order, shake.choice((2, 3, 8, min(32, len(lengths))))):
            best_fit(bins, loads, part, lengths, capacity)
    return Packing(bins, lengths, capacity)


def exact_fill(lengths: np.ndarray, capacity: int) -> Packing:
    """Bin by bin: the longest piece left, then the longest of one, two or three pieces that fill the rest
    exactly; where there are none, the longest that fits, and so on with what is left."""
    held: list[list[int]] = [[] for _ in range(capacity + 1)]
    for i, size in enumerate(lengths.tolist()):
        held[size].append(i)
    sizes = sum(1 << s for s, own in enumerate(held) if own)  # bit s: a piece of length s is left
    mirror = sum(1 << (capacity - s) for s, own in enumerate(held) if own)
    bins = np.full(len(lengths), -1, np.int32)

    def two(room: int) -> int:
        """The larger of two pieces that fill ``room`` (0: none)."""
        both = sizes & (mirror >> (capacity - room))
        while both:
            a = both.bit_length() - 1
            if 2 * a < room:
                return 0
            if 2 * a != room or len(held[a]) > 1:
                return a
            both ^= 1 << a
        return 0

    def next_piece(room: int) -> int:
        if sizes >> room & 1:
            return room
        if a := two(room):
            return a
        fits = sizes & ((1 << room) - 1)
        largest = fits.bit_length() - 1
        for _ in range(TRIED):
            if not fits:
                break
            a = fits.bit_length() - 1
            if (b := two(room - a)) and not (a in (b, room - a - b) and len(held[a]) < 1 + (a == b) + (a == room - a - b)):
                return a
            fits ^= 1 << a
        return largest

    b = 0
    while sizes:
        room, size = capacity, sizes.bit_length() - 1
        while size > 0:
            bins[held[size].pop()] = b
            if not held[size]:
                sizes ^= 1 << size
                mirror ^= 1 << (capacity - size)
            room -= size
            size = next_piece(room) if room and sizes else 0
        b += 1
    return Packing(bins, lengths, capacity)


def swap_in(bins: np.ndarray, loads: list[int], loose: np.ndarray, lengths: np.ndarray, capacity: int) -> np.ndarray:
    """Exchanges pieces of open bins for loose ones that fill the bin better, one for one, two for one or
    one for two; returns the loose pieces then, which are smaller or fewer than before."""
    inside = bins >= 0
    inside[loose] = False
    filled = np.array(loads)
    inside[inside] = filled[bins[inside]] < capacity
    held: dict[int, list[int]] = {}
    members = np.flatnonzero(inside)
    for i, b in zip(members.tolist(), bins[members].tolist()):
        if b in held:
            held[b].append(i)
        else:
            held[b] = [i]
    size = lengths.tolist()
    free = sorted(zip(lengths[loose].tolist(), loose.tolist()))
    left = [s for s, _ in free]
    for b, own in held.items():
        room = capacity - loads[b]
        if room <= 0 or not left or len(own) > MOST_SWAPPED:
            continue
        gain, out, places = 0, (), ()
        sizes, least, most = [size[i] for i in own], left[0], left[-1]
        for x, gone in enumerate(sizes):
            upto = gone + room
            if least > upto:
                first = -1
            else:
                one = bisect_right(left, upto) - 1
                if (more := left[one] - gone) > gain:
                    gain, out, places = more, (x,), (one,)
                    if gain == room:  # the bin is full, nothing is better
                        break
                first = bisect_right(left, upto - least) - 1
            if first >= 0:
                second = bisect_right(left, upto - left[first]) - 1
                second -= second == first
                if second >= 0 and (more := left[first] + left[second] - gone) > gain:
                    gain, out, places = more, (x,), (first, second)
                    if gain == room:
                        break
            for y in range(x + 1, len(sizes)):
                both = gone + sizes[y]
                if most - both > gain:  # else no loose piece is long enough
                    one = bisect_right(left, both + room) - 1
                    if one >= 0 and (more := left[one] - both) > gain:
                        gain, out, places = more, (x, y), (one,)
            if gain == room:
                break
        if gain:
            taken = [free[at][1] for at in places]
            for at in sorted(places, reverse=True):
                del free[at], left[at]
            for x in out:
                piece = (sizes[x], own[x])
                at = bisect_right(free, piece)
                free.insert(at, piece)
                left.insert(at, sizes[x])
            for i in taken:
                bins[i] = b
            loads[b] += gain
    return np.array([i for _, i in free], np.int64)


def refit(bins: np.ndarray, loose: np.ndarray, lengths: np.ndarray, capacity: int, sealed: np.ndarray) -> Packing:
    """Best-fits ``loose`` into the bins that remain; ``sealed`` bins stay as they are."""
    fixed = np.ones(len(lengths), bool)
    fixed[loose] = False
    size = int(bins.max()) + 1 if len(bins) else 0
    loads = np.bincount(bins[fixed], weights=lengths[fixed], minlength=size).astype(np.int64)
    open_loads = loads.copy()
    open_loads[sealed] = capacity
    open_loads[loads == 0] = capacity  # emptied bins are not used again under their number
    room = open_loads.tolist()
    loose = swap_in(bins, room, loose, lengths, capacity)
    best_fit(bins, room, loose, lengths, capacity)
    return Packing(bins, lengths, capacity)


def crossover(one: Packing, other: Packing, lengths: np.ndarray, capacity: int, rng: random.Random) -> Packing:
    """``one`` with whole well-filled bins of ``other``."""
    filled = np.flatnonzero(other.loads >= np.quantile(other.loads, 0.5))
    chosen = np.array(rng.sample(filled.tolist(), max(1, int(len(filled) * rng.uniform(0.2, 0.6)))))
    injected = np.isin(other.bins, chosen)
    hit = np.isin(one.bins, np.unique(one.bins[injected]))
    bins = one.bins.copy()
    bins[injected] = one.count + other.bins[injected]
    return refit(bins, np.flatnonzero(hit & ~injected), lengths, capacity, one.count + chosen)


def mutation(one: Packing, lengths: np.ndarray, capacity: int, rng: random.Random) -> Packing:
    """Dissolves the least filled bins and a few others."""
    worst = np.argsort(one.loads, kind="stable")[: max(2, one.count // 50)].tolist()
    others = rng.sample(range(one.count), min(one.count, max(2, one.count // 20)))
    loose = np.flatnonzero(np.isin(one.bins, np.array(worst + others)))
    return refit(one.bins.copy(), loose, lengths, capacity, np.array([], np.int64))


def least_bins(lengths: np.ndarray, capacity: int) -> int:
    """A number of bins that no packing can beat. For every size t up to half a bin: pieces over
    capacity - t lie alone, other pieces over half a bin need a bin each, and what pieces from t to half a
    bin exceed the room left beside those needs more bins."""
    sizes = np.bincount(lengths, minlength=capacity + 1).astype(np.int64)
    upto, tokens = np.cumsum(sizes), np.cumsum(sizes * np.arange(capacity + 1))
    half = capacity // 2
    t = np.arange(half + 1)
    alone = upto[-1] - upto[capacity - t]
    large = upto[capacity - t] - upto[half]
    room = large * capacity - (tokens[capacity - t] - tokens[half])
    medium = tokens[half] - np.where(t > 0, tokens[np.maximum(t - 1, 0)], 0)
    more = np.maximum(0, -(-(medium - room) // capacity))
    return int((alone + large + more).max())


def evolve(lengths: np.ndarray, capacity: int, seed: str, immigrants: list[np.ndarray] = (),
           generations: int = GENERATIONS, population: int = POPULATION) -> np.ndarray:
    """Bins of the best packing of one island after some generations."""
    if not len(lengths):
        return np.array([], np.int32)
    rng = random.Random(seed)
    bound = least_bins(lengths, capacity)
    group = [Packing(b, lengths, capacity) for b in immigrants] or [packed(lengths, capacity)]
    if not len(immigrants) and group[0].count > bound:
        group.append(exact_fill(lengths, capacity))
    while len(group) < population and min(p.count for p in group) > bound:
        group.append(packed(lengths, capacity, rng))
    for _ in range(generations):
        group.sort(key=lambda p: p.fitness)
        if group[0].count <= bound:
            break
        children = []
        for k in range(max(1, population // 2)):
            a, b = rng.sample(range(len(group)), 2)
            a, b = min(a, b), max(a, b)
            children.append(crossover(group[b], group[a], lengths, capacity, rng))
            children.append(mutation(group[k], lengths, capacity, rng))
        group = sorted(group + children, key=lambda p: p.fitness)[:population]
    return min(group, key=lambda p: p.fitness).bins


def pack(pieces: DataFrame, capacity: int, length: str = "length", block: int = BLOCK,
         islands: int = ISLANDS) -> DataFrame:
    """All columns of ``pieces`` with sequence_id and offset: pieces of one sequence lie side by side
    from 0 and hold at most ``capacity`` tokens. Lengths must be from 1 to ``capacity``."""
    spark = pieces.sparkSession
    batches_of(spark, 16)
    names = pieces.columns
    pieces = materialize(pieces, "pieces")
    size = F.col(f"`{length}`").cast("int")
    n_blocks = max(1, round(pieces.where(size < capacity).count() / block))
    row = F.struct(*[F.col(f"`{c}`") for c in names]).alias("row")
    dealt = pieces.where(size < capacity).select(
        F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(n_blocks)).alias("block"), size.alias("size"), row)
    alone = pieces.where(size >= capacity).select(
        "*", (-1 - F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    blocks = materialize(
        dealt.groupBy("block").agg(F.collect_list(F.struct("size", "row")).alias("rows"))
        .select("block", F.col("rows.size").alias("sizes"), F.col("rows.row").alias("rows")), "blocks")
    columns = "block long, island int, bins array<int>, fill array<double>"
    schema = arrow_schema(columns)

    def evolving(epoch: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            def rows():
                for batch in batches:
                    for b, island, sizes, *elites in zip(*(c.to_pylist() for c in batch.columns)):
                        sizes = np.array(sizes, np.int64)
                        bins = exact_pairs(sizes, capacity)
                        rest = bins < 0
                        first = [np.array(e, np.int32)[rest] for e in elites]
                        bins[rest] = bins.max() + 1 + evolve(sizes[rest], capacity, f"{b}/{island}/{epoch}", first)
                        p = Packing(bins, sizes, capacity)
                        yield b, island, p.bins.tolist(), [float(v) for v in p.fitness]

            yield from in_chunks(rows(), schema, 16)

        return run

    tasks = max(1, min(n_blocks * islands, spark.sparkContext.defaultParallelism * 16))
    settlers = blocks.select("block", F.explode(F.sequence(F.lit(0), F.lit(islands - 1))).alias("island"), "sizes")
    first = materialize(
        settlers.repartition(tasks, "block", "island").mapInArrow(evolving(1), columns), "epoch")
    guests = first.select("block", F.pmod(F.col("island") + 1, F.lit(islands)).alias("island"), F.col("bins").alias("guest"))
    second = (
        settlers.join(first.drop("fill"), ["block", "island"]).join(guests, ["block", "island"])
        .select("block", "island", "sizes", "bins", "guest")
        .repartition(tasks, "block", "island").mapInArrow(evolving(2), columns)
    )
    best = second.groupBy("block").agg(F.min_by("bins", F.struct("fill", "island")).alias("bins"))
    placed = "block long, places array<struct<bin:int,offset:long>>"
    out = arrow_schema(placed)

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for batch in batches:
                for b, sizes, bins in zip(*(c.to_pylist() for c in batch.columns)):
                    used: dict[int, int] = {}
                    spots = []
                    for size, at in zip(sizes, bins):
                        spots.append({"bin": at, "offset": used.get(at, 0)})
                        used[at] = used.get(at, 0) + size
                    yield b, spots

        yield from in_chunks(rows(), out, 16)

    spots = blocks.select("block", "sizes").join(best, "block").mapInArrow(places, placed)
    together = (
        blocks.select("block", "rows").join(spots, "block")
        .select("block", F.explode(F.arrays_zip("rows", "places")).alias("x"))
        .select("x.rows.*", (F.col("block") * (1 << 20) + F.col("x.places.bin")).alias("sequence_id"),
                F.col("x.places.offset").alias("offset"))
    )
    return together.unionByName(alone)
