"""Approximate nearest neighbours by inner product: NN-descent graph, greedy graph search.

Equal vectors are one node, known by the smallest of their ids. Every node keeps its ``k`` nearest
nodes found so far. The lists start from a few random-hyperplane forests, whose leaves of bounded size
are compared in full, and then improve by NN-descent: a node's neighbours, and the ``reverse`` nearest
of the nodes that name it, meet at that node, and each learns of the others. A round is a join of the
links with the members' vectors and a grouping by node; it emits only what beats the last place of a
list, and only pairs with a link that is new since the round before. Rounds end when few lists change.

A query starts at its own node where it has one, and at the nearest of a fixed number of entry nodes.
In every round the unvisited nodes of its beam are joined with their neighbourhoods, and the beam keeps
the ``beam`` nearest nodes seen; a search ends when its beam holds no unvisited node. The best of the
beam are scored exactly, in double precision, on the original vectors.

Graph and search score with codes of one byte a component; the exact scores decide the order. A node
passes on at most ``k + reverse`` links, the other reverse links stay in their owners' lists. Groups
gathered into one row are bounded by ``LEAF``, ``k + reverse`` and ``ASKS``, whatever a hub or a group
of copies holds; per-node limits are applied before the shuffle where Spark can.

Defined cases: vectors null, zero or holding null or non-finite components take no part, nor do rows
without id; rows that repeat an id count once (the smallest vector stays); shorter vectors count as
ending in zeros; fewer candidates than asked for give all of them; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gapspark.llm.common import (
    arrow_limits, arrow_schema, as_lists, batches_of, fixed_width, in_chunks, materialize, sound_vectors, vector_matrix,
)

NEIGHBOURS, REVERSE = 24, 12
TREES, LEAF = 6, 1024
#: Nodes whose median places the forests' hyperplanes; a hash picks them.
PLANE_SAMPLE = 4096
ROUNDS = 4
#: Rounds end when fewer of all list places than this changed.
LEAST_CHANGE = 0.02
BEAM, ENTRIES, STARTS = 256, 256, 16
#: Of a beam, how many are scored exactly for each one asked for.
RESCORE = 4
#: Searches that visit one node together in one row of work, about.
ASKS = 4096
SCALE_BYTES = 8


def codes_of(vectors: np.ndarray) -> np.ndarray:
    """Rows of bytes: a scale and one signed byte a component."""
    scale = np.abs(vectors).max(1, initial=0) / 127
    whole = np.rint(vectors / np.where(scale > 0, scale, 1)[:, None]).astype(np.int8)
    return np.concatenate([scale.astype("<f8")[:, None].view(np.uint8).reshape(len(vectors), SCALE_BYTES),
                           whole.view(np.uint8)], axis=1)


def decoded(codes: np.ndarray) -> np.ndarray:
    scale = np.ascontiguousarray(codes[:, :SCALE_BYTES]).view("<f8")
    return (codes[:, SCALE_BYTES:].view(np.int8) * scale).astype(np.float32)


def nodes_of(table: DataFrame, copies: int, vec_id: str = "vec_id", embedding: str = "embedding") -> tuple[DataFrame, int]:
    """node, ids (the ``copies`` smallest of the vector's ids), exact (its components), code; and the
    number of components."""
    sound = sound_vectors(table, vec_id, embedding)
    sound = sound.where(F.col("vec_id").isNotNull() & F.exists("v", lambda x: x != 0))
    once = materialize(sound.groupBy("vec_id").agg(F.min("v").alias("v")), "vectors")
    dims = once.agg(F.max(F.size("v"))).first()[0] or 0
    ddl = "vec_id long, exact binary, code binary"
    schema = arrow_schema(ddl)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m = vector_matrix(batch.column(1), dims) + 0.0  # one zero, not two
            exact, codes = m.astype("<f8"), codes_of(m)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([r.tobytes() for r in exact], pa.binary()),
                 pa.array([r.tobytes() for r in codes], pa.binary())], schema=schema)

    place = F.row_number().over(Window.partitionBy("exact").orderBy("vec_id"))
    least = once.mapInArrow(pack, ddl).withColumn("place", place).where(F.col("place") <= copies)
    grouped = least.groupBy("exact").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"), F.first("code").alias("code"))
    with arrow_limits(table.sparkSession, 4096):
        return materialize(grouped.select(F.col("ids")[0].alias("node"), "ids", "exact", "code"), "nodes"), dims


def best_of(row: np.ndarray, ids: np.ndarray, scores: np.ndarray, late: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` best distinct ids of every row, best first; of equals the smaller id. Of a
    repeated id the entry stays that is not ``late``."""
    order = np.lexsort((late, ids, row))
    r, i = row[order], ids[order]
    first = np.ones(len(order), bool)
    first[1:] = (r[1:] != r[:-1]) | (i[1:] != i[:-1])
    order = order[first]
    order = order[np.lexsort((ids[order], -scores[order], row[order]))]
    r = row[order]
    starts = np.concatenate([[0], np.flatnonzero(np.diff(r)) + 1]) if len(r) else np.zeros(0, int)
    rank = np.arange(len(r)) - np.repeat(starts, np.diff(np.concatenate([starts, [len(r)]])))
    return order[rank < k]


def list_rows(lists: pa.ListArray) -> np.ndarray:
    """The row of every item of the lists."""
    return np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))


GRAPH = "node long, code binary, nbr array<long>, score array<float>, fresh array<boolean>"


def merged_lists(rows: DataFrame, k: int) -> DataFrame:
    """The graph's rows from node, code, nbr, score, fresh with lists of any length and repeated ids."""
    schema = arrow_schema(GRAPH)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node, code, nbr, score, fresh = batch.columns
            row, ids = list_rows(nbr), nbr.flatten().to_numpy(zero_copy_only=False)
            values = score.flatten().to_numpy(zero_copy_only=False)
            late = fresh.flatten().to_numpy(zero_copy_only=False).astype(bool)
            kept = best_of(row, ids, values, late, k)
            counts = np.bincount(row[kept], minlength=batch.num_rows)
            yield pa.RecordBatch.from_arrays(
                [node, code, as_lists(ids[kept], counts, pa.int64()), as_lists(values[kept], counts, pa.float32()),
                 as_lists(late[kept], counts, pa.bool_())], schema=schema)

    return rows.select("node", "code", "nbr", "score", "fresh").mapInArrow(merge, GRAPH)


def tasks_for(nodes: DataFrame, n: int) -> int:
    return max(2 * nodes.sparkSession.sparkContext.defaultParallelism, n // 4096)


def forest_lists(nodes: DataFrame, n: int, dims: int, k: int, trees: int, leaf: int) -> DataFrame:
    """The first lists: the nearest nodes in the leaves of ``trees`` forests. A tree's leaf is named by
    the sides of random hyperplanes through the sample's medians; a leaf that many near copies share
    is dealt into parts of about ``leaf`` nodes by a hash."""
    depth = max(0, int(np.ceil(np.log2(max(1, n) / leaf))))
    planes = np.random.default_rng(42).normal(size=(dims, trees * depth)).astype(np.float32)
    sample = nodes.select("code").orderBy(F.xxhash64("node")).limit(PLANE_SAMPLE).collect()
    sample = decoded(np.stack([np.frombuffer(r.code, np.uint8) for r in sample])) if sample else np.zeros((1, dims), np.float32)
    medians = np.median(sample @ planes, axis=0).astype(np.float32)
    ddl = "tree int, side long, node long, code binary"
    schema = arrow_schema(ddl)
    listed = "node long, nbr array<long>, score array<float>"
    out = arrow_schema(listed)

    def sides(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = 1 << np.arange(depth, dtype=np.int64)
        for batch in batches:
            above = decoded(fixed_width(batch.column(1), SCALE_BYTES + dims)) @ planes > medians
            for t in range(trees):
                side = above[:, t * depth : (t + 1) * depth] @ weights if depth else np.zeros(batch.num_rows, np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(batch.num_rows, t, np.int32)), pa.array(side.astype(np.int64)), *batch.columns], schema=schema)

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for items in batch.column(0):
                node, codes = items.values.flatten()
                node = node.to_numpy(zero_copy_only=False)
                m = decoded(fixed_width(codes, SCALE_BYTES + dims))
                least = min(k, len(node) - 1)
                for at in range(0, len(node), 1024):
                    scores = m[at : at + 1024] @ m.T
                    rows = len(scores)
                    scores[np.arange(rows), at + np.arange(rows)] = -np.inf
                    best = np.argpartition(-scores, max(0, least - 1), axis=1)[:, :least]
                    counts = np.full(rows, least)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(node[at : at + rows]), as_lists(node[best].ravel(), counts, pa.int64()),
                         as_lists(np.take_along_axis(scores, best, 1).ravel(), counts, pa.float32())], schema=out)

    spark = nodes.sparkSession
    with arrow_limits(spark, 4096):
        placed = materialize(nodes.select("node", "code").mapInArrow(sides, ddl), "forest")
    sizes = placed.groupBy("tree", "side").agg(F.count("*").alias("n"))
    parts = placed.join(sizes, ["tree", "side"]).withColumn(
        "part", F.pmod(F.xxhash64("node", "tree"), F.ceil(F.col("n") / (1.5 * leaf))))
    leaves = parts.repartition(tasks_for(nodes, n * trees), "tree", "side", "part").groupBy("tree", "side", "part").agg(
        F.collect_list(F.struct("node", "code")).alias("items"))
    with arrow_limits(spark, 16):
        found = materialize(leaves.select("items").mapInArrow(nearest, listed), "leaf-lists")
    gathered = found.groupBy("node").agg(F.collect_list(F.struct("nbr", "score")).alias("x"))
    joined = nodes.select("node", "code").join(gathered, "node").select(
        "node", "code", F.flatten("x.nbr").alias("nbr"), F.flatten("x.score").alias("score"))
    with arrow_limits(spark, 4096):
        return materialize(
            merged_lists(joined.withColumn("fresh", F.transform("nbr", lambda _: F.lit(True))), k), "graph")


def members_of(graph: DataFrame, reverse: int) -> DataFrame:
    """(node, member, fresh): the links of every node and the ``reverse`` nearest that name it."""
    links = graph.select("node", F.explode(F.arrays_zip("nbr", "score", "fresh")).alias("x")).select(
        "node", F.col("x.nbr").alias("member"), F.col("x.score").alias("score"), F.col("x.fresh").alias("fresh"))
    place = F.row_number().over(Window.partitionBy("member").orderBy(F.desc("score"), "node"))
    back = links.withColumn("place", place).where(F.col("place") <= reverse)
    return links.select("node", "member", "fresh").unionByName(
        back.select(F.col("member").alias("node"), F.col("node").alias("member"), "fresh"))


def descent_round(graph: DataFrame, n: int, dims: int, k: int, reverse: int) -> DataFrame:
    """The graph after one meeting of neighbours of neighbours."""
    spark = graph.sparkSession
    last = F.when(F.size("score") >= k, F.array_min("score")).otherwise(float("-inf"))
    cards = graph.select(F.col("node").alias("member"), "code", last.cast("float").alias("least"))
    met = (
        members_of(graph, reverse).join(cards, "member")
        .repartition(tasks_for(graph, n), "node").groupBy("node")
        .agg(F.collect_list(F.struct("member", "code", "least", "fresh")).alias("items"), F.max("fresh").alias("fresh"))
        .where("fresh").select("items")
    )
    ddl = "node long, nbr long, score float"
    schema = arrow_schema(ddl)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(0)
            row = list_rows(lists)
            ids, codes, least, fresh = lists.flatten().flatten()
            ids, least = ids.to_numpy(zero_copy_only=False), least.to_numpy(zero_copy_only=False)
            old = ~fresh.to_numpy(zero_copy_only=False).astype(bool)
            # a node that is neighbour and reverse neighbour stands once, as new if either link is
            order = np.lexsort((old, ids, row))
            once = np.ones(len(order), bool)
            once[1:] = (row[order][1:] != row[order][:-1]) | (ids[order][1:] != ids[order][:-1])
            order = order[once]
            r = row[order]
            at = np.arange(len(r)) - np.searchsorted(r, np.arange(batch.num_rows))[r]
            width = int(at.max(initial=0)) + 1
            shape = (batch.num_rows, width)
            name, bar, aged = np.full(shape, -1, np.int64), np.full(shape, np.inf, np.float32), np.ones(shape, bool)
            name[r, at], bar[r, at], aged[r, at] = ids[order], least[order], old[order]
            m = np.zeros((*shape, dims), np.float32)
            m[r, at] = decoded(fixed_width(codes, SCALE_BYTES + dims)[order])
            present = np.zeros(shape, bool)
            present[r, at] = True
            scores = m @ m.transpose(0, 2, 1)
            good = (scores > bar[:, :, None]) & ~(aged[:, :, None] & aged[:, None, :]) & present[:, None, :]
            good[:, np.arange(width), np.arange(width)] = False
            b, i, j = np.nonzero(good)
            yield pa.RecordBatch.from_arrays(
                [pa.array(name[b, i]), pa.array(name[b, j]), pa.array(scores[b, i, j])], schema=schema)

    with arrow_limits(spark, 512):
        found = materialize(met.mapInArrow(meet, ddl), "meetings")
    best = found.groupBy("node", "nbr").agg(F.max("score").alias("score"))
    place = F.row_number().over(Window.partitionBy("node").orderBy(F.desc("score"), "nbr"))
    news = best.withColumn("place", place).where(F.col("place") <= k).groupBy("node").agg(
        F.collect_list(F.struct("nbr", "score")).alias("x"))
    held = graph.join(news, "node", "left")
    both = held.select(
        "node", "code", F.concat("nbr", F.coalesce("x.nbr", F.array().cast("array<long>"))).alias("nbr"),
        F.concat("score", F.coalesce("x.score", F.array().cast("array<float>"))).alias("score"),
        F.concat(F.transform("nbr", lambda _: F.lit(False)),
                 F.coalesce(F.transform("x.nbr", lambda _: F.lit(True)), F.array().cast("array<boolean>"))).alias("fresh"))
    with arrow_limits(spark, 4096):
        return materialize(merged_lists(both, k), "graph")


def neighbour_graph(nodes: DataFrame, dims: int, k: int = NEIGHBOURS, reverse: int = REVERSE, trees: int = TREES,
                    leaf: int = LEAF, rounds: int = ROUNDS, least_change: float = LEAST_CHANGE) -> DataFrame:
    """node, code, nbr, score: the ``k`` nearest nodes found for every node, best first."""
    n = nodes.count()
    graph = forest_lists(nodes, n, dims, k, trees, leaf)
    for _ in range(rounds):
        graph = descent_round(graph, n, dims, k, reverse)
        changed = graph.agg(F.sum(F.size(F.filter("fresh", lambda x: x)))).first()[0] or 0
        if changed < least_change * n * k:
            break
    return graph


STATE = "query_id long, code binary, nbr array<long>, score array<float>, visited array<boolean>"


def beam_rows(rows: DataFrame, beam: int) -> DataFrame:
    """Search states from query_id, code, nbr, score, visited with lists of any length and repeated
    ids."""
    schema = arrow_schema(STATE)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            query, code, nbr, score, visited = batch.columns
            row, ids = list_rows(nbr), nbr.flatten().to_numpy(zero_copy_only=False)
            values = score.flatten().to_numpy(zero_copy_only=False)
            done = visited.flatten().to_numpy(zero_copy_only=False).astype(bool)
            kept = best_of(row, ids, values, ~done, beam)
            counts = np.bincount(row[kept], minlength=batch.num_rows)
            yield pa.RecordBatch.from_arrays(
                [query, code, as_lists(ids[kept], counts, pa.int64()), as_lists(values[kept], counts, pa.float32()),
                 as_lists(done[kept], counts, pa.bool_())], schema=schema)

    return rows.select("query_id", "code", "nbr", "score", "visited").mapInArrow(merge, STATE)


def first_beams(asked: DataFrame, entries: tuple[np.ndarray, np.ndarray], dims: int, starts: int) -> DataFrame:
    """States before the first round: the query's own node (``home``, may be null) and all entry nodes,
    of which the ``starts`` nearest are to be visited."""
    schema = arrow_schema(STATE)
    names, codes = entries

    def begin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        points = decoded(codes)
        for batch in batches:
            own = decoded(fixed_width(batch.column(1), SCALE_BYTES + dims))
            scores = own @ points.T
            away = np.ones(scores.shape, bool)
            near = np.argpartition(-scores, min(starts, len(names)) - 1, axis=1)[:, :starts]
            np.put_along_axis(away, near, False, 1)
            home = np.array([-1 if h is None else h for h in batch.column(2).to_pylist()], np.int64)
            known = np.array([h is not None for h in batch.column(2).to_pylist()], bool)
            ids = np.concatenate([home[:, None], np.broadcast_to(names, scores.shape)], 1)
            values = np.concatenate([(own * own).sum(1)[:, None], scores], 1).astype(np.float32)
            done = np.concatenate([np.zeros((len(own), 1), bool), away], 1)
            there = np.concatenate([known[:, None], names[None, :] != home[:, None]], 1)
            counts = there.sum(1)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), as_lists(ids[there], counts, pa.int64()),
                 as_lists(values[there], counts, pa.float32()), as_lists(done[there], counts, pa.bool_())], schema=schema)

    return asked.mapInArrow(begin, STATE)


def searched(graph: DataFrame, asked: DataFrame, n: int, dims: int, beam: int, reverse: int, entries: int = ENTRIES,
             starts: int = STARTS) -> DataFrame:
    """Final search states; ``asked`` has query_id, code and home, the query's own node or null."""
    spark = graph.sparkSession
    around = members_of(graph, reverse).select("node", "member").distinct()
    codes = graph.select(F.col("node").alias("member"), "code")
    around = around.join(codes, "member").repartition(tasks_for(graph, n), "node").groupBy("node").agg(
        F.collect_list(F.struct("member", "code")).alias("items"))
    around = materialize(around, "neighbourhoods")
    picked = graph.select("node", "code").orderBy(F.xxhash64("node")).limit(entries).collect()
    points = (np.array([r.node for r in picked], np.int64), np.stack([np.frombuffer(r.code, np.uint8) for r in picked]))
    with arrow_limits(spark, 1024):
        state = materialize(first_beams(asked.select("query_id", "code", "home"), points, dims, starts), "beams")
    n_asked = state.count()
    salts = max(1, n_asked // ASKS)
    ddl = "query_id long, nbr array<long>, score array<float>"
    schema = arrow_schema(ddl)

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            queries, values, ids, counts = [], [], [], []
            for asks, items in zip(*batch.columns):
                query, own, least = asks.values.flatten()
                member, there = items.values.flatten()
                scores = decoded(fixed_width(own, SCALE_BYTES + dims)) @ decoded(fixed_width(there, SCALE_BYTES + dims)).T
                good = scores > least.to_numpy(zero_copy_only=False)[:, None]
                any_ = good.any(1)
                i, j = np.nonzero(good)
                queries.append(query.to_numpy(zero_copy_only=False)[any_])
                ids.append(member.to_numpy(zero_copy_only=False)[j])
                values.append(scores[i, j])
                counts.append(good.sum(1)[any_])
            if queries and sum(map(len, queries)):
                counts = np.concatenate(counts)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(queries)), as_lists(np.concatenate(ids), counts, pa.int64()),
                     as_lists(np.concatenate(values), counts, pa.float32())], schema=schema)

    while True:
        open_ = state.where(F.exists("visited", lambda x: ~x))
        least = F.when(F.size("nbr") >= beam, F.array_min("score")).otherwise(float("-inf")).cast("float")
        front = open_.select("query_id", "code", least.alias("least"), F.explode(F.arrays_zip("nbr", "visited")).alias("x")).where(
            "not x.visited").select(F.col("x.nbr").alias("node"), "query_id", "code", "least")
        asks = front.withColumn("salt", F.pmod(F.xxhash64("query_id"), F.lit(salts))).repartition(
            tasks_for(graph, n), "node", "salt").groupBy("node", "salt").agg(
            F.collect_list(F.struct("query_id", "code", "least")).alias("asks"))
        with arrow_limits(spark, 256):
            found = materialize(asks.join(around, "node").select("asks", "items").mapInArrow(visit, ddl), "visits")
        news = found.groupBy("query_id").agg(F.collect_list(F.struct("nbr", "score")).alias("x"))
        seen = state.join(news, "query_id", "left").select(
            "query_id", "code", F.concat("nbr", F.coalesce(F.flatten("x.nbr"), F.array().cast("array<long>"))).alias("nbr"),
            F.concat("score", F.coalesce(F.flatten("x.score"), F.array().cast("array<float>"))).alias("score"),
            F.concat(F.transform("nbr", lambda _: F.lit(True)),
                     F.coalesce(F.transform(F.flatten("x.nbr"), lambda _: F.lit(False)), F.array().cast("array<boolean>"))).alias("visited"))
        with arrow_limits(spark, 64):
            state = materialize(beam_rows(seen, beam), "beams")
        if not state.where(F.exists("visited", lambda x: ~x)).limit(1).count():
            return state


def nearest(table: DataFrame, queries: DataFrame, k: int, neighbours: int = NEIGHBOURS, reverse: int = REVERSE,
            trees: int = TREES, leaf: int = LEAF, rounds: int = ROUNDS, beam: int = BEAM) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the ``k`` nearest of ``table`` found for each of
    ``queries``, its own id aside; both have vec_id and embedding."""
    spark = table.sparkSession
    batches_of(spark)
    nodes, dims = nodes_of(table, k + 1)
    asks = sound_vectors(queries).where(F.col("vec_id").isNotNull() & F.exists("v", lambda x: x != 0))
    asks = asks.groupBy(F.col("vec_id").alias("query_id")).agg(F.min("v").alias("v"))
    ddl = "query_id long, exact binary, code binary"
    schema = arrow_schema(ddl)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m = vector_matrix(pa.array([v[:dims] for v in batch.column(1).to_pylist()], pa.list_(pa.float64())), dims) + 0.0
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([r.tobytes() for r in m.astype("<f8")], pa.binary()),
                 pa.array([r.tobytes() for r in codes_of(m)], pa.binary())], schema=schema)

    result = "query_id long, rank int, vec_id long, score double"
    n = nodes.count()
    if not n:
        return spark.createDataFrame([], result)
    with arrow_limits(spark, 4096):
        asks = materialize(asks.mapInArrow(pack, ddl), "queries")
    # a query whose vector is in the table starts there, whatever its id
    asked = asks.join(nodes.select(F.col("node").alias("home"), "exact"), "exact", "left")
    asked = materialize(asked.select("query_id", "exact", "code", "home"), "asked")
    graph = neighbour_graph(nodes, dims, neighbours, reverse, trees, leaf, rounds)
    state = searched(graph, asked, n, dims, beam, reverse)
    near = state.select("query_id", F.posexplode(F.slice("nbr", 1, RESCORE * k)).alias("at", "node")).select("query_id", "node")
    pairs = near.join(nodes.select("node", "ids", F.col("exact").alias("there")), "node").join(
        asked.select("query_id", "exact"), "query_id").select("query_id", "ids", "exact", "there")
    scored = "query_id long, ids array<long>, score double"
    out = arrow_schema(scored)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (np.ascontiguousarray(fixed_width(batch.column(c), 8 * dims)).view("<f8") for c in (2, 3))
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array((a * b).sum(1))], schema=out)

    each = pairs.mapInArrow(score, scored).select("query_id", F.explode("ids").alias("vec_id"), "score").where(
        F.col("query_id") != F.col("vec_id"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return each.withColumn("rank", rank).where(F.col("rank") <= k).select(
        "query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
