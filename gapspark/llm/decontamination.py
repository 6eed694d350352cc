"""Benchmark decontamination by greedy string tiling.

Seeds are the ``min_match``-word windows that a document shares with a benchmark item. Both sides give
their windows as rows and meet in a join on the window's words, so equal hashes alone never count. Of a
document only windows travel whose rolling Karp-Rabin hash is set in a bitmap of the benchmark's
hashes; the bitmap has ``BITMAP_BITS`` bits whatever the benchmark's size, and a bit set by chance costs
a row that finds no partner. Texts are never shuffled, and no table passes through the driver.

Seeds that follow one another form the maximal matches. Tiling marks the longest match first and never
marks a word twice, on either side; a match of which words are taken already goes back with what is
left of it. The share of the item's words under tiles is its coverage, so passages in another order
count in full.

A word is a run of word characters in lower case; in scripts written without spaces each character is
a word.

Defined cases: null and empty texts and items match nothing; an item of fewer than ``min_match`` words
matches where all its words follow one another; repeated rows are reported each; an empty table on
either side gives no rows; very long texts are walked in spans of ``SPAN_WORDS`` words.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator
from itertools import islice, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gapspark.llm.common import arrow_limits, arrow_schema, in_chunks, materialize

MIN_MATCH = 5
THRESHOLD = 0.6
BASE = np.uint64(0x9E3779B97F4A7C15)
#: Bits of the filter over the benchmark's windows, and of one of its rows.
BITMAP_BITS, ROW_BITS = 1 << 25, 1 << 15
#: A window's documents are dealt to so many tasks; the benchmark's rows are copied as often.
SALTS = 16
SPAN_WORDS = 1 << 20
#: Thai, Lao, Burmese, Khmer, kana and ideographs.
UNSPACED = "\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff"
WORD = re.compile(rf"[{UNSPACED}]|[^\W{UNSPACED}]+")


class WordHashes(dict):
    """Hashes of words, remembered for the next texts."""

    MOST = 1 << 20

    def __missing__(self, word: str) -> int:
        if len(self) >= self.MOST:
            self.clear()
        found = self[word] = xxhash.xxh64_intdigest(word)
        return found


def words_of(text: str) -> list[str]:
    return WORD.findall(text.lower())


def spans_of(text: str, overlap: int) -> Iterator[tuple[int, list[str]]]:
    """Words of a text in spans, each with the place of its first word; spans share ``overlap`` words."""
    if len(text) <= SPAN_WORDS:
        yield 0, words_of(text)
        return
    found = (m.group() for m in WORD.finditer(text.lower()))
    words, first = list(islice(found, SPAN_WORDS)), 0
    while words:
        yield first, words
        more = list(islice(found, SPAN_WORDS))
        if not more:
            return
        kept = words[len(words) - overlap:] if overlap else []
        first += len(words) - len(kept)
        words = kept + more


def rolling(ids: np.ndarray, size: int) -> np.ndarray:
    """Karp-Rabin hash of every window of ``size`` ids."""
    n = len(ids) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for k in range(size):
        out = out * BASE + ids[k : k + n]
    return out


def bits_of(words: list[str], size: int, hashes: WordHashes) -> np.ndarray:
    """The bit of every window of ``size`` words."""
    ids = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    return ((rolling(ids, size) * BASE) >> np.uint64(64 - BITMAP_BITS.bit_length() + 1)).astype(np.int64)


def tiles_of(i: np.ndarray, j: np.ndarray, size: int, n_item: int) -> list[tuple[int, int, int]]:
    """Greedy tiling from seeds at item places ``i`` and text places ``j``: (item, text, length).

    Ties go to the smaller place in the item, then in the text.
    """
    order = np.lexsort((i, j - i))
    i, j = i[order], j[order]
    starts = np.flatnonzero(np.concatenate([[True], (np.diff(i) != 1) | (np.diff(j) != 1)]))
    lengths = np.diff(np.append(starts, len(i))) + size - 1
    heap = [(-n, a, b) for n, a, b in zip(lengths.tolist(), i[starts].tolist(), j[starts].tolist())]
    heapq.heapify(heap)
    item_marks, text_marks, tiles, left = np.zeros(n_item, bool), {}, [], n_item
    while heap and left >= size:
        n, a, b = heapq.heappop(heap)
        n = -n
        taken = item_marks[a : a + n].copy()
        for k in range(n):
            if b + k in text_marks:
                taken[k] = True
        if not taken.any():
            tiles.append((a, b, n))
            item_marks[a : a + n] = True
            text_marks.update(zip(range(b, b + n), repeat(True)))
            left -= n
            continue
        free = np.flatnonzero(np.diff(np.concatenate([[True], taken, [True]]).astype(np.int8)))
        for start, end in zip(free[::2].tolist(), free[1::2].tolist()):
            if end - start >= size:
                heapq.heappush(heap, (start - end, a + start, b + start))
    return tiles


def item_windows(benchmark: DataFrame, item_id: str, text: str, min_match: int) -> DataFrame:
    """A row for each distinct window of an item: item (number of the row), item_id, n_words, size, words,
    places, bit."""
    ddl = "item long, item_id long, n_words int, size int, words string, places array<int>, bit long"
    schema = arrow_schema(ddl)
    items = benchmark.select(
        F.monotonically_increasing_id().alias("item"), F.col(f"`{item_id}`").cast("long").alias("item_id"),
        F.col(f"`{text}`").alias("value"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()

        def rows():
            for batch in batches:
                for item, name, value in zip(*(c.to_pylist() for c in batch.columns)):
                    words = words_of(value or "")
                    size = min(min_match, len(words))
                    if not size:
                        continue
                    bits = bits_of(words, size, hashes)
                    places: dict[str, list[int]] = {}
                    for k in range(len(bits)):
                        places.setdefault(" ".join(words[k : k + size]), []).append(k)
                    for window, at in places.items():
                        yield item, name, len(words), size, window, at, int(bits[at[0]])

        yield from in_chunks(rows(), schema)

    return items.mapInArrow(run, ddl)


def bitmap_of(windows: DataFrame) -> bytes:
    """The filter over all windows: at most ``BITMAP_BITS`` bits come to the driver."""
    found = np.zeros(BITMAP_BITS // 8, np.uint8)
    row_bytes = ROW_BITS // 8
    at = F.floor(F.col("bit") / ROW_BITS)
    for r in windows.groupBy(at.alias("at")).agg(F.bitmap_construct_agg(F.col("bit") % ROW_BITS).alias("bits")).collect():
        own = np.frombuffer(bytes(r["bits"]), np.uint8)
        found[r["at"] * row_bytes : r["at"] * row_bytes + len(own)] = own
    return found.tobytes()


def document_windows(docs: DataFrame, text: str, keep: tuple[str, ...], sizes: list[int], bitmap: bytes) -> DataFrame:
    """A row for each document with windows in the filter: row, kept columns k0.., windows (words, places)."""
    kept = [F.col(f"`{c}`").alias(f"k{k}") for k, c in enumerate(keep)]
    source = docs.select(F.monotonically_increasing_id().alias("row"), *kept, F.col(f"`{text}`").alias("value"))
    ddl = ", ".join(["row long", *(f"k{k} {source.schema[f'k{k}'].dataType.simpleString()}" for k in range(len(keep))),
                     "windows array<struct<words:string,places:array<int>>>"])
    schema = arrow_schema(ddl)
    shared = docs.sparkSession.sparkContext.broadcast(bitmap)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filled, hashes = np.frombuffer(shared.value, np.uint8), WordHashes()

        def rows():
            for batch in batches:
                columns = [c.to_pylist() for c in batch.columns]
                for r, value in enumerate(columns[-1]):
                    places: dict[str, list[int]] = {}
                    for size in sizes:
                        for first, words in spans_of(value or "", size - 1):
                            bits = bits_of(words, size, hashes)
                            hit = np.flatnonzero((filled[bits >> 3] >> (bits & 7).astype(np.uint8)) & 1)
                            for k in hit.tolist():
                                places.setdefault(" ".join(words[k : k + size]), []).append(first + k)
                    if places:
                        yield (*(c[r] for c in columns[:-1]), [{"words": w, "places": p} for w, p in places.items()])

        yield from in_chunks(rows(), schema, 256)

    return source.mapInArrow(run, ddl)


def tiled(pairs: DataFrame, threshold: float) -> DataFrame:
    """Tiles of each (document, item) from their shared windows, where they cover enough of the item."""
    ddl = ("row long, item_id long, coverage double, "
           "tiles array<struct<item_start:int,doc_start:int,length:int>>")
    schema = arrow_schema(ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for batch in batches:
                for r in batch.select(["row", "item_id", "n_words", "size", "shared"]).to_pylist():
                    n, size = r["n_words"], r["size"]
                    spots = [(np.array(s["item_places"]), np.array(s["doc_places"])) for s in r["shared"]]
                    places = np.unique(np.concatenate([a for a, _ in spots]))
                    reach = np.zeros(n + 1, np.int64)
                    np.add.at(reach, places, 1)
                    np.add.at(reach, places + size, -1)
                    if (np.cumsum(reach) > 0).sum() < threshold * n:
                        continue  # even all seeds together do not cover enough
                    i = np.concatenate([np.repeat(a, len(b)) for a, b in spots])
                    j = np.concatenate([np.tile(b, len(a)) for a, b in spots])
                    tiles = tiles_of(i, j, size, n)
                    coverage = sum(length for _, _, length in tiles) / n
                    if coverage >= threshold:
                        yield r["row"], r["item_id"], coverage, [
                            {"item_start": a, "doc_start": b, "length": length} for a, b, length in tiles]

        yield from in_chunks(rows(), schema, 256)

    return pairs.mapInArrow(run, ddl)


def benchmark_overlaps(docs: DataFrame, benchmark: DataFrame, min_match: int = MIN_MATCH, threshold: float = THRESHOLD,
                       keep: tuple[str, ...] = ("doc_id",), text: str = "text", item_id: str = "item_id",
                       item_text: str = "text", salts: int = SALTS) -> DataFrame:
    """Columns ``keep`` with item_id, coverage (share of the item's words under tiles, at least
    ``threshold``) and tiles (places in words and lengths), one row for each document and item.

    The windows found are written once, so numbers of rows hold for all that follows. A window that many
    documents share is dealt to ``salts`` tasks; a pair goes on to tiling only if its windows can cover
    enough of the item.
    """
    spark = docs.sparkSession
    with arrow_limits(spark):
        items = materialize(item_windows(benchmark, item_id, item_text, min_match), "benchmark-windows")
        sizes = sorted(r["size"] for r in items.select("size").distinct().collect())  # min_match at most
        found = materialize(document_windows(docs, text, keep, sizes, bitmap_of(items)), "document-windows")
    seeds = found.select("row", F.explode("windows").alias("w")).select(
        "row", F.col("w.words").alias("words"), F.col("w.places").alias("doc_places"),
        F.pmod(F.xxhash64("row"), F.lit(salts)).alias("salt"))
    copies = items.select(
        "item", "item_id", "n_words", "size", "words", F.col("places").alias("item_places"),
        F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))).alias("salt"))
    pairs = seeds.join(copies, ["words", "salt"]).groupBy("row", "item").agg(
        F.first("item_id").alias("item_id"), F.first("n_words").alias("n_words"), F.first("size").alias("size"),
        F.sum(F.size("item_places")).alias("n_places"),
        F.collect_list(F.struct("item_places", "doc_places")).alias("shared"),
    ).where(F.col("n_places") * F.col("size") >= F.lit(threshold) * F.col("n_words"))
    return tiled(pairs, threshold).join(found.drop("windows"), "row").select(
        *[F.col(f"k{k}").alias(c) for k, c in enumerate(keep)], "item_id", "coverage", "tiles")
