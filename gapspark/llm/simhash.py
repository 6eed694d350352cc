"""SimHash near-duplicates by tiled exact comparison of fingerprints.

Distinct fingerprints are dealt into tiles by the population counts of their segments. Two
fingerprints within ``radius`` bits differ by at most ``radius`` in the sum of these counts'
differences, so tile pairs beyond that are never formed; the others are compared in full with numpy
exclusive-or and bit counts. A tile is cut into blocks of bounded size, each pair of blocks is one
row of work, and a task passes on only a spanning forest of the links it saw: no list of all pairs
of a group exists anywhere. Components then join up across tasks.

``near_duplicates`` adds what text similarity needs: wide fingerprints find groups generously, and
inside a group exact shingle sets decide, again block by block and as forests. There the tiles are
named by bands of the least shingle hashes, so texts meet that share a band, in each tile those of
compatible size and fingerprint link, and the work follows the number of texts, not its square.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gapspark.llm.common import arrow_schema, batches_of, in_chunks, materialize
from gapspark.llm.graph import connected_components

SEED = 42
BLOCK = 2048
#: Rows of shingle bits that are summed at once.
SLICE = 1 << 14


def words_of(text: str) -> list[bytes]:
    """Words between ASCII white space, A-Z in lower case."""
    upper = bytes(range(65, 91))
    return text.encode("utf-8", "surrogatepass").translate(bytes.maketrans(upper, upper.lower())).split()


def shingles_of(words: list[bytes], size: int) -> list[bytes]:
    """Word shingles, repeats included; fewer words make one shingle, no words none."""
    if len(words) <= size:
        return [b" ".join(words)] if words else []
    return [b" ".join(words[i : i + size]) for i in range(len(words) - size + 1)]


def hashes_of(shingles: list[bytes], seed: int = SEED) -> np.ndarray:
    from xxhash import xxh64_intdigest

    return np.fromiter((xxh64_intdigest(s, seed) for s in shingles), "<u8", len(shingles))


def majority(hashes: np.ndarray) -> int:
    """Bits set in over half of the hashes, as a signed 64-bit number; 0 for none."""
    total = np.zeros(64, np.int64)
    for at in range(0, len(hashes), SLICE):
        part = hashes[at : at + SLICE]
        total += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    bits = (total * 2 > len(hashes)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view("<i8")[0])


def band_keys(hashes: np.ndarray) -> list[int]:
    """A key for each of ``BANDS`` bands of ``BAND_ROWS`` minima over the hashes, each in its own order."""
    rng = np.random.default_rng(SEED)
    factors, shifts = (rng.integers(1, 1 << 63, BANDS * BAND_ROWS, dtype=np.uint64) for _ in range(2))
    least = np.full(BANDS * BAND_ROWS, np.iinfo(np.uint64).max, np.uint64)
    with np.errstate(over="ignore"):
        for at in range(0, len(hashes), 4096):
            part = hashes[at : at + 4096, None] * (factors | np.uint64(1)) + shifts
            least = np.minimum(least, (part ^ (part >> np.uint64(31))).min(0))
        keys = np.arange(BANDS, dtype=np.uint64)
        for row in least.reshape(BANDS, BAND_ROWS).T:
            keys = (keys ^ row) * np.uint64(0x9E3779B97F4A7C15)
            keys ^= keys >> np.uint64(29)
    return keys.view(np.int64).tolist()


def fingerprints(docs: DataFrame, size: int = 3, words: int = 1, keep: tuple[str, ...] = ("doc_id",),
                 text: str = "text", distinct: bool = False, bands: bool = False) -> DataFrame:
    """Columns ``keep``, fp0.. (``words`` signed 64-bit numbers) and n_shingles (distinct ones).
    ``distinct``: a shingle that repeats counts once in the bits, as it does in a set. ``bands``: also
    the band keys of the shingles, as an array."""
    batches_of(docs.sparkSession)
    kept = docs.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text}`").alias("text of it"))
    columns = [f"fp{i}" for i in range(words)]
    fields = [f"`{c}` {kept.schema[c].dataType.simpleString()}" for c in keep]
    ddl = ", ".join(fields + [f"{c} long" for c in columns] + ["n_shingles long"] + ["bands array<long>"] * bands)
    schema = arrow_schema(ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for value in batch.column(batch.num_columns - 1).to_pylist():
                own = shingles_of(words_of(value or ""), size)
                own = list(dict.fromkeys(own)) if distinct else own
                first = hashes_of(own)
                prints = [majority(first)] + [majority(hashes_of(own, SEED + i)) for i in range(1, words)]
                found.append((*prints, len(np.unique(first)), *([band_keys(first)] if bands else [])))
            arrays = list(batch.columns[:-1]) + [pa.array(c) for c in zip(*found)]
            if found:
                yield pa.RecordBatch.from_arrays(
                    [a.cast(f.type) for a, f in zip(arrays, schema)], schema=schema)

    return kept.mapInArrow(run, ddl)


class Forest:
    """Union-find over numbered things; remembers the links that joined two groups."""

    def __init__(self):
        self.parent: dict[int, int] = {}
        self.links: list[tuple[int, int]] = []

    def root(self, x: int) -> int:
        parent = self.parent
        while (up := parent.setdefault(x, x)) != x:
            parent[x] = x = parent[up]
        return x

    def link(self, x: int, y: int) -> bool:
        a, b = self.root(x), self.root(y)
        if a == b:
            return False
        self.parent[max(a, b)] = min(a, b)
        self.links.append((x, y))
        return True


def link_block(forest: Forest, left: list[int], right: list[int], near: np.ndarray) -> None:
    """Adds the links ``near[i, j]``. A row's links are joined by their groups, not one by one."""
    label = np.array([forest.root(r) for r in right])
    for i in np.flatnonzero(near.any(1)).tolist():
        own = forest.root(left[i])
        hits = np.flatnonzero(near[i])
        for group in np.unique(label[hits]).tolist():
            if group != own and forest.link(left[i], right[int(hits[label[hits] == group][0])]):
                own = forest.root(own)
        if len(hits):
            label[np.isin(label, np.unique(label[hits]))] = forest.root(left[i])


def segment_counts(words: int, segments: int) -> list[Column]:
    """Population counts of equal segments of a fingerprint; none for one tile over all."""
    if not segments:
        return []
    width = 64 * words // segments
    if width >= 64:
        per = width // 64
        return [sum((F.bit_count(f"fp{k}") for k in range(s * per, s * per + per)), F.lit(0)) for s in range(segments)]
    mask = (1 << width) - 1
    return [F.bit_count(F.shiftrightunsigned(f"fp{at // 64}", at % 64).bitwiseAND(F.lit(mask)))
            for at in range(0, 64 * words, width)]


def steps(dims: int, reach: int) -> list[tuple[int, ...]]:
    """Differences of count vectors that two near fingerprints can have; of two opposite ones, one."""
    spans = [range(-reach, reach + 1)] * dims
    return [d for d in itertools.product(*spans) if sum(map(abs, d)) <= reach and d >= (0,) * dims]


def blocks_of(nodes: DataFrame, tile: Column, payload: list[str], size: int = BLOCK) -> DataFrame:
    """(tile, block, items): the nodes of each tile in blocks of about ``size``, dealt by a hash."""
    keyed = nodes.select(tile.alias("tile"), F.struct(*payload).alias("item"))
    counts = keyed.groupBy("tile").agg(F.count("*").alias("n"))
    dealt = keyed.join(counts, "tile").select(
        "tile", F.pmod(F.xxhash64("item"), F.ceil(F.col("n") / size)).alias("block"), "item")
    dealt = dealt.repartition("tile", "block")  # else a large tile would stay in the join's one task
    return dealt.groupBy("tile", "block").agg(F.collect_list("item").alias("items"))


def pairs_of(blocks: DataFrame, others: list[Column]) -> DataFrame:
    """(left, right) items of every pair of blocks to compare; ``others`` are the keys of the tiles
    that a tile meets, its own among them."""
    left = blocks.select(
        F.explode(F.array(*others)).alias("other"), F.col("tile").alias("own"),
        F.col("block").alias("own_block"), F.col("items").alias("left"))
    right = blocks.select(F.col("tile").alias("other"), F.col("block").alias("other_block"), F.col("items").alias("right"))
    met = left.join(right, "other")
    return met.where((F.col("own") != F.col("other")) | (F.col("own_block") <= F.col("other_block"))).select(
        "left", "right", ((F.col("own") == F.col("other")) & (F.col("own_block") == F.col("other_block"))).alias("same"))


def links_within(pairs: DataFrame, words: int, radius: int, sizes: float | None = None) -> DataFrame:
    """Spanning links (u, v) of the fingerprints within ``radius``; items are structs of node, fp0..
    and n. ``sizes``: the least ratio of n that a link may have."""
    ddl = "u long, v long"
    schema = arrow_schema(ddl)

    def arrays(items: pa.Array) -> tuple[list[int], list[np.ndarray], np.ndarray]:
        fields = {f.name: items.field(f.name) for f in items.type}
        prints = [fields[f"fp{k}"].to_numpy(zero_copy_only=False).view(np.uint64) for k in range(words)]
        return fields["node"].to_pylist(), prints, fields["n"].to_numpy(zero_copy_only=False)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for batch in batches:
                lefts, rights, same = batch.columns
                for k in range(batch.num_rows):
                    forest = Forest()
                    left, a, n = arrays(lefts[k].values)
                    right, b, m = arrays(rights[k].values)
                    for at in range(0, len(left), 256):
                        cut = slice(at, at + 256)
                        apart = np.bitwise_count(a[0][cut, None] ^ b[0][None, :]).astype(np.uint16)
                        for x, y in zip(a[1:], b[1:]):
                            apart += np.bitwise_count(x[cut, None] ^ y[None, :])
                        near = apart <= radius
                        if sizes and near.any():
                            near &= np.minimum.outer(n[cut], m) >= sizes * np.maximum.outer(n[cut], m)
                        if same[k].as_py():
                            near &= np.arange(at, at + len(near))[:, None] < np.arange(len(right))[None, :]
                        if near.any():
                            link_block(forest, left[cut], right, near)
                    yield from forest.links

        yield from in_chunks(rows(), schema)

    batches_of(pairs.sparkSession, 64)
    return pairs.mapInArrow(run, ddl)


def fingerprint_links(nodes: DataFrame, radius: int, segments: int = 4) -> DataFrame:
    """Spanning links of distinct 64-bit fingerprints: ``nodes`` has node and fp0."""
    counts = segment_counts(1, segments)
    blocks = materialize(
        blocks_of(nodes.withColumn("n", F.lit(1).cast("long")), F.array(*counts), ["node", "fp0", "n"]), "tiles")
    near = [F.array(*[F.get("tile", i) + x for i, x in enumerate(d)]) for d in steps(segments, radius)]
    pairs = pairs_of(blocks, near)
    return links_within(pairs, 1, radius)


def simhash_components(docs: DataFrame, radius: int = 2, size: int = 3, doc_id: str = "doc_id",
                       text: str = "text") -> DataFrame:
    """doc_id, fingerprint (16 lower-case hex digits) and component_id, the smallest document id that
    links of at most ``radius`` differing bits reach, the document's own included.

    Defined cases: null and empty texts have fingerprint zero and link like any other; null ids never
    name a component (a component of null ids alone has a null name); repeated rows are all returned;
    an empty table gives no rows.
    """
    ids = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    prints = materialize(fingerprints(ids, size, 1).select("doc_id", "fp0"), "fingerprints")
    names = materialize(prints.groupBy("fp0").agg(F.min("doc_id").alias("least")), "distinct-fingerprints")
    links = fingerprint_links(names.select(F.col("fp0").alias("node"), "fp0"), radius)
    roots = connected_components(links)
    grouped = names.join(roots, F.col("fp0") == F.col("node"), "left").select(
        "fp0", "least", F.coalesce("root", "fp0").alias("root"))
    named = grouped.groupBy("root").agg(F.min("least").alias("component_id"))
    of_print = grouped.join(named, "root").select("fp0", "component_id")
    return prints.join(of_print, "fp0").select(
        "doc_id", F.lower(F.lpad(F.hex("fp0"), 16, "0")).alias("fingerprint"), "component_id")


#: Of 256 bits, taken over distinct shingles, what texts of shingle similarity 0.8 stay within (about 39
#: expected, 6 the spread). A pair at 0.8 or more is missed with a probability of at most 4.4e-7,
#: that of four shingles and the same four with a fifth aside (1e-4: even counts tie).
WIDE_WORDS, WIDE_RADIUS = 4, 72
#: Texts of similarity s share no band with probability (1 - s**4)**14: 6.2e-4 at 0.8, 1.4e-5 at 0.86.
BANDS, BAND_ROWS = 14, 4
#: Texts of a group whose shingle sets meet in one row of work.
GROUP_BLOCK = 256


def jaccard_links(pairs: DataFrame, least: float) -> DataFrame:
    """Spanning links of the texts whose shingle sets have at least ``least`` of their union in
    common; items are structs of node and shingles (distinct 64-bit hashes)."""
    ddl = "u long, v long"
    schema = arrow_schema(ddl)

    def sets(items: pa.Array) -> tuple[list[int], np.ndarray, np.ndarray]:
        lists = items.field("shingles")
        sizes = np.diff(lists.offsets.to_numpy())
        flat = lists.flatten().to_numpy(zero_copy_only=False)
        return items.field("node").to_pylist(), flat, sizes

    def common(flat_a, size_a, flat_b, size_b) -> np.ndarray:
        """Shared shingles of every pair, by the shingles that both sides have."""
        shared = np.intersect1d(flat_a, flat_b)
        out = np.zeros((len(size_a), len(size_b)), np.int64)
        owner_a, owner_b = np.repeat(np.arange(len(size_a)), size_a), np.repeat(np.arange(len(size_b)), size_b)
        at_a, at_b = np.searchsorted(shared, flat_a), np.searchsorted(shared, flat_b)
        in_a = (at_a < len(shared)) & (shared[np.minimum(at_a, max(0, len(shared) - 1))] == flat_a) if len(shared) else np.zeros(len(flat_a), bool)
        in_b = (at_b < len(shared)) & (shared[np.minimum(at_b, max(0, len(shared) - 1))] == flat_b) if len(shared) else np.zeros(len(flat_b), bool)
        for start in range(0, len(shared), 4096):
            width = min(4096, len(shared) - start)
            x, y = np.zeros((len(size_a), width), np.float32), np.zeros((len(size_b), width), np.float32)
            pick_a = in_a & (at_a >= start) & (at_a < start + width)
            pick_b = in_b & (at_b >= start) & (at_b < start + width)
            x[owner_a[pick_a], at_a[pick_a] - start] = 1
            y[owner_b[pick_b], at_b[pick_b] - start] = 1
            out += (x @ y.T).astype(np.int64)
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for batch in batches:
                lefts, rights, same = batch.columns
                for k in range(batch.num_rows):
                    forest = Forest()
                    left, a, n = sets(lefts[k].values)
                    right, b, m = sets(rights[k].values)
                    both = common(a, n, b, m)
                    near = both >= least * (n[:, None] + m[None, :] - both) - 1e-9
                    if same[k].as_py():
                        near &= np.arange(len(left))[:, None] < np.arange(len(right))[None, :]
                    link_block(forest, left, right, near)
                    yield from forest.links

        yield from in_chunks(rows(), schema)

    batches_of(pairs.sparkSession, 1)
    return pairs.mapInArrow(run, ddl)


def shingle_sets(texts: DataFrame, size: int) -> DataFrame:
    """root, node and its distinct shingle hashes; ``texts`` has root, node and text."""
    batches_of(texts.sparkSession, 256)
    ddl = "root long, node long, shingles array<long>"
    schema = arrow_schema(ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for batch in batches:
                for root, node, value in zip(*(c.to_pylist() for c in batch.columns)):
                    own = np.unique(hashes_of(shingles_of(words_of(value or ""), size)))
                    yield root, node, own.view("<i8").tolist()

        yield from in_chunks(rows(), schema, 256)

    return texts.select("root", "node", "text").mapInArrow(run, ddl)


def loose_groups(nodes: DataFrame, least: float = 0.8) -> DataFrame:
    """(node, root) of nodes that share a band and whose fingerprints of 256 bits lie within
    ``WIDE_RADIUS``, connected; ``nodes`` has node, fp0.., n (the number of distinct shingles) and bands.
    Nodes whose sizes cannot reach the similarity ``least`` are not linked."""
    keyed = nodes.select("node", F.explode("bands").alias("band"))
    shared = keyed.groupBy("band").agg(F.count("*").alias("k")).where("k > 1").select("band")
    met = materialize(keyed.join(shared, "band", "left_semi"), "shared-bands")
    payload = ["node", *[f"fp{k}" for k in range(WIDE_WORDS)], "n"]
    tiles = met.join(nodes.select(*payload), "node")
    blocks = materialize(blocks_of(tiles, F.col("band"), payload), "band-tiles")
    pairs = pairs_of(blocks, [F.col("tile")])
    return connected_components(links_within(pairs, WIDE_WORDS, WIDE_RADIUS, least))


def exact_groups(members: DataFrame, size: int = 5, least: float = 0.8) -> DataFrame:
    """(node, root) of the texts that shingle sets connect within the groups named by root;
    ``members`` has root, node and text."""
    grouped = materialize(shingle_sets(members, size), "group-shingles")
    blocks = materialize(blocks_of(grouped, F.col("root"), ["node", "shingles"], GROUP_BLOCK), "group-blocks")
    return connected_components(jaccard_links(pairs_of(blocks, [F.col("tile")]), least))


def near_duplicates(texts: DataFrame, size: int = 5, least: float = 0.8) -> DataFrame:
    """(node, root) of the texts in groups of near copies; ``texts`` has node (long, one row each)
    and text. Texts link if their sets of ``size``-word shingles reach a Jaccard similarity of
    ``least``; texts without words link with one another. The root is the group's smallest node.
    """
    prints = materialize(fingerprints(texts, size, WIDE_WORDS, ("node",), distinct=True, bands=True), "wide-fingerprints")
    loose = loose_groups(prints.withColumnRenamed("n_shingles", "n"), least)
    return exact_groups(texts.join(loose, "node"), size, least)
