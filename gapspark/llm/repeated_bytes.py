"""Suffix-array dedup of long repeated byte strings, by a depth-limited radix sort.

Suffixes are told apart only through their first ``threshold`` bytes, in passes from the most
significant digit on; after every pass only suffixes that still share their group with another one
go on, and what is equal after the last pass is exactly a repeated window. A digit is a slab of
bytes, compared by a 128-bit hash, and Spark's shuffle is the bucket sort of a pass.

So that not every suffix needs a row from the start, a window is filed under its own leading digit:
the ``GRAM``-byte string inside it with the smallest hash (the leftmost of equals). Equal windows
have equal ones at the same place, so no pair is lost, and all windows of a text that share one such
string make one row, a stretch:

1. first digit: the gram. Stretches whose gram comes nowhere else hold no repeat.
2. second digit: the whole stretch. One that comes twice is repeated as a whole; copies of
   documents end here.
3. third digit, for one stretch of each kind whose gram also leads another kind: groups of windows
   that have the gram at nearly the same place, by what they share and by all that they cover.
4. last digit: the windows themselves, where a group shares its core but not all of its bytes with
   another one.

Groups of any size are counted by aggregation, never gathered; what is shuffled are hashes, places,
the texts (compressed) to take stretches from them and to cut them, and the few stretches of 3 and 4.

Defined cases: a null text is empty; texts shorter than the threshold have no windows; repeated rows
repeat each other's windows; null ids are kept (each row stands for itself); an empty table gives no
rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gapspark.llm.common import arrow_schema, batches_of, hash_pair, in_chunks, materialize

THRESHOLD = 400
#: Windows with their gram at nearly the same place, so many places apart at most, make one group.
STEP = 32
MIX, SPREAD = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def gram_hashes(data: np.ndarray, size: int) -> np.ndarray:
    """A 64-bit hash of every string of ``size`` bytes, built from strings of doubling length."""
    with np.errstate(over="ignore"):
        block = (data.astype(np.uint64) + np.uint64(1)) * MIX
        block ^= block >> np.uint64(29)
        span, out, covered, rest = 1, None, 0, size
        while True:
            if rest & 1:
                if out is None:
                    out, covered = block.copy(), span
                else:
                    n = len(data) - covered - span + 1
                    out = (out[:n] * SPREAD) ^ block[covered : covered + n]
                    out ^= out >> np.uint64(31)
                    covered += span
            rest >>= 1
            if not rest:
                return out
            n = len(block) - span
            block = block[:n] * SPREAD + block[span : span + n]
            block ^= block >> np.uint64(32)
            span *= 2


def leaders(hashes: np.ndarray, width: int) -> np.ndarray:
    """Place of the smallest of every ``width`` hashes side by side, the leftmost of equals."""
    least, span = hashes, 1
    places = np.arange(len(hashes))

    def smaller(a, pa_, b, pb):
        right = b < a
        return np.where(right, b, a), np.where(right, pb, pa_)

    while span * 2 <= width:
        n = len(least) - span
        least, places = smaller(least[:n], places[:n], least[span : span + n], places[span : span + n])
        span *= 2
    if span < width:
        n, by = len(least) - (width - span), width - span
        least, places = smaller(least[:n], places[:n], least[by : by + n], places[by : by + n])
    return places


def stretches(data: bytes, threshold: int, gram: int) -> Iterator[tuple[int, int, int, int]]:
    """(gram hash, first window, last window, gram place) of the runs of windows with one leading gram."""
    if len(data) < threshold:
        return
    hashes = gram_hashes(np.frombuffer(data, np.uint8), gram)
    lead = leaders(hashes, threshold - gram + 1)
    starts = np.concatenate([[0], np.flatnonzero(np.diff(lead)) + 1, [len(lead)]])
    heads = lead[starts[:-1]]
    for g, first, end, place in zip(hashes[heads].view(np.int64).tolist(), starts[:-1].tolist(),
                                    starts[1:].tolist(), heads.tolist()):
        yield g, first, end - 1, place


def squeezed(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """doc_id, the text's pair of hashes, and the text's bytes compressed for the shuffle."""
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    a, b = hash_pair(body)
    ddl = "doc_id long, ta long, tb long, packed binary"
    schema = arrow_schema(ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from zstandard import ZstdCompressor

        packer = ZstdCompressor(level=3)
        for batch in batches:
            packed = [packer.compress(t.encode("utf-8", "surrogatepass")) for t in batch.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(packed, pa.binary())], schema=schema)

    return docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), a.alias("ta"), b.alias("tb"),
                       body.alias("text")).mapInArrow(run, ddl)


def cut_texts(docs: DataFrame, threshold: int, gram: int, text: str, grams_only: bool) -> DataFrame:
    """Stretches of every text: g, and unless ``grams_only`` the text's hashes, the stretch's hash and
    its place, ``(first * (t + 1) + windows - 1) * (t + 1) + gram place - last`` for threshold t."""
    from_text = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    a, b = hash_pair(from_text)
    ddl = "g long" if grams_only else "g long, s long, ta long, tb long, place long"
    schema = arrow_schema(ddl)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_64_intdigest

        def rows():
            for batch in batches:
                for ta, tb, value in zip(*(c.to_pylist() for c in batch.columns)):
                    data = value.encode("utf-8", "surrogatepass")
                    for g, first, last, lead in stretches(data, threshold, gram):
                        if grams_only:
                            yield (g,)
                        else:
                            place = (first * (threshold + 1) + last - first) * (threshold + 1) + lead - last
                            yield g, signed(xxh3_64_intdigest(data[first : last + threshold])), ta, tb, place

        yield from in_chunks(rows(), schema, 8192)

    return docs.select(a.alias("ta"), b.alias("tb"), from_text.alias("text")).mapInArrow(cut, ddl)


def signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def repeated_windows(docs: DataFrame, threshold: int = THRESHOLD, gram: int | None = None, text: str = "text",
                     doc_id: str = "doc_id") -> DataFrame:
    """(ta, tb, a, b): ranges of repeated windows, first to last start, of the texts with hashes ta, tb."""
    spark = docs.sparkSession
    batches_of(spark, 256)
    gram = gram or max(1, threshold // 2)
    t1 = threshold + 1
    grams = cut_texts(docs, threshold, gram, text, True).groupBy("g").agg(F.count("*").alias("n")).where("n > 1").select("g")
    grams = materialize(grams, "repeated-grams")
    cuts = materialize(
        cut_texts(docs, threshold, gram, text, False).join(grams, "g", "left_semi"), "stretches")
    first = F.floor(F.col("place") / (t1 * t1)).cast("long")
    last = first + F.floor(F.col("place") / t1).cast("long") % t1
    kinds = materialize(
        cuts.groupBy("g", "s").agg(F.count("*").alias("n"), F.min(F.struct("ta", "tb", "place")).alias("one")), "kinds")
    whole = (
        cuts.join(kinds.where("n > 1").select("g", "s"), ["g", "s"], "left_semi")
        .select("ta", "tb", first.alias("a"), last.alias("b")).distinct()
    )
    # a gram that leads more than one kind: these are looked at more closely, one stretch of each kind
    mixed = materialize(kinds.groupBy("g").agg(F.count("*").alias("k")).where("k > 1").select("g"), "mixed-grams")
    fine = kinds.join(mixed, "g", "left_semi").select("g", "s", "n", "one.ta", "one.tb", "one.place")
    wanted = fine.groupBy("ta", "tb").agg(F.collect_list(F.struct("g", "s", "n", "place")).alias("cuts"))
    own = squeezed(docs, doc_id, text).select("ta", "tb", "packed")
    ddl = "g long, s long, n long, ta long, tb long, first int, last int, lead int, bytes binary"
    schema = arrow_schema(ddl)

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from zstandard import ZstdDecompressor

        unpacker = ZstdDecompressor()

        def rows():
            for batch in batches:
                for ta, tb, packed, cuts_ in zip(*(c.to_pylist() for c in batch.columns)):
                    data = unpacker.decompress(packed)
                    for c in cuts_:
                        at, rest = divmod(c["place"], t1 * t1)
                        end = at + rest // t1
                        yield c["g"], c["s"], c["n"], ta, tb, at, end, end + rest % t1, data[at : end + threshold]

        yield from in_chunks(rows(), schema, 4096)

    taken = own.join(wanted, ["ta", "tb"]).mapInArrow(take, ddl).dropDuplicates(["g", "s"])  # copies give the same
    bodies = materialize(taken, "fine-stretches")

    # windows whose gram lies at nearly the same place are compared as one: by what all of them share
    # (their core), and by all that they cover
    ddl_c = "g long, c int, core long, cover long, s long, n long, ta long, tb long, a int, b int"
    schema_c = arrow_schema(ddl_c)

    def in_groups(first: int, last: int, lead: int) -> Iterator[tuple[int, int, int, int]]:
        """(group, first window, last window, core start) of a stretch's windows by gram place."""
        for c in range((lead - last) // STEP, (lead - first) // STEP + 1):
            yield c, max(first, lead - c * STEP - STEP + 1), min(last, lead - c * STEP), lead - c * STEP

    def group(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_64_intdigest as h

        def rows():
            for batch in batches:
                for g, s, n, ta, tb, at, end, lead, data in zip(*(c.to_pylist() for c in batch.columns)):
                    for c, a, b, core in in_groups(at, end, lead):
                        inner = data[core - at : core - at + threshold - STEP + 1]
                        outer = data[a - at : b - at + threshold]
                        yield g, c, signed(h(inner)), signed(h(outer)), s, n, ta, tb, a, b

        yield from in_chunks(rows(), schema_c, 8192)

    groups = materialize(bodies.mapInArrow(group, ddl_c), "window-groups")
    covers = materialize(groups.groupBy("g", "c", "core", "cover").agg(
        F.count("*").alias("covers"), F.min("n").alias("n"), F.min("s").alias("s")), "covers")
    same = groups.where("n = 1").join(
        covers.where("covers > 1").select("g", "c", "core", "cover"), ["g", "c", "core", "cover"], "left_semi"
    ).select("ta", "tb", F.col("a").cast("long"), F.col("b").cast("long"))
    # last digit: single windows, only where one core has more than one cover
    split = materialize(
        covers.groupBy("g", "c", "core").agg(F.count("*").alias("k")).where("k > 1").select("g", "c", "core"), "open-cores")
    open_groups = covers.join(split, ["g", "c", "core"], "left_semi").groupBy("g", "s").agg(
        F.collect_list(F.struct("c", (F.col("covers") * F.col("n") == 1).alias("open"))).alias("open_groups"))
    ddl_w = "w1 long, w2 long, ta long, tb long, a long, open boolean"
    schema_w = arrow_schema(ddl_w)

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_128_digest

        def rows():
            for batch in batches:
                for ta, tb, at, end, lead, data, wanted_ in zip(*(c.to_pylist() for c in batch.columns)):
                    spans = {c: (a, b) for c, a, b, _ in in_groups(at, end, lead)}
                    for x in wanted_:
                        a, b = spans[x["c"]]
                        for w in range(a, b + 1):
                            w1, w2 = np.frombuffer(xxh3_128_digest(data[w - at : w - at + threshold]), "<i8").tolist()
                            yield w1, w2, ta, tb, w, x["open"]

        yield from in_chunks(rows(), schema_w, 8192)

    single = materialize(
        bodies.join(open_groups, ["g", "s"]).select("ta", "tb", "first", "last", "lead", "bytes", "open_groups")
        .mapInArrow(windows, ddl_w), "windows")
    twice = single.groupBy("w1", "w2").agg(F.count("*").alias("k")).where("k > 1").select("w1", "w2")
    found = single.where("open").join(twice, ["w1", "w2"], "left_semi").select("ta", "tb", "a", F.col("a").alias("b"))
    return whole.unionByName(same).unionByName(found)


def merged(ranges: list[dict], threshold: int) -> list[tuple[int, int]]:
    """Maximal runs of bytes that ranges of windows cover, as [start, end)."""
    runs: list[list[int]] = []
    for a, b in sorted((r["a"], r["b"]) for r in ranges):
        if runs and a <= runs[-1][1]:
            runs[-1][1] = max(runs[-1][1], b + threshold)
        else:
            runs.append([a, b + threshold])
    return [tuple(r) for r in runs]


def remove_repeated_bytes(docs: DataFrame, threshold: int = THRESHOLD, gram: int | None = None,
                          doc_id: str = "doc_id", text: str = "text", with_bytes: bool = True) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every document without the bytes that a
    string of ``threshold`` bytes covers which also starts elsewhere; with ``with_bytes`` the spans
    and the kept bytes too."""
    ranges = repeated_windows(docs, threshold, gram, text, doc_id).groupBy("ta", "tb").agg(
        F.collect_set(F.struct("a", "b")).alias("ranges"))
    ddl = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    ddl += ", spans array<struct<start:long,end:long>>, kept binary" * with_bytes
    schema = arrow_schema(ddl)

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from zstandard import ZstdDecompressor

        unpacker = ZstdDecompressor()

        def rows():
            for batch in batches:
                for name, packed, ranges_ in zip(*(c.to_pylist() for c in batch.columns)):
                    data = unpacker.decompress(packed)
                    runs = merged(ranges_ or [], threshold)
                    edges = [0, *(x for r in runs for x in r), len(data)]
                    kept = b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2]))
                    row = (name, len(data), len(data) - len(kept), len(runs), hashlib.sha256(kept).hexdigest())
                    yield (*row, [{"start": a, "end": b} for a, b in runs], kept) if with_bytes else row

        yield from in_chunks(rows(), schema, 512)

    batches_of(docs.sparkSession, 256)
    return squeezed(docs, doc_id, text).join(ranges, ["ta", "tb"], "left").select(
        "doc_id", "packed", "ranges").mapInArrow(remove, ddl)
