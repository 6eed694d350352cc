"""Neighbour graph, vector codes and whitening against brute force."""

import hashlib

import numpy as np
import pytest

from gapspark.llm import bidiagonal, neighbour_graph, vector_codes, whitening

DDL = "vec_id long, embedding array<float>, label int, score int, code string, n int"
BAD = [(1, None), (4, [1.0, None]), (7, [float("nan")] * 3), (10, [float("inf")])]


def table_of(spark, rows):
    """Rows of id and vector with labels and columns of clashing names."""
    return spark.createDataFrame(
        [(i, None if v is None else [None if x is None else float(x) for x in v], None if i is None or i % 3 == 0 else i % 3,
          1, "c", 2) for i, v in rows], DDL)


def single(x):
    return np.array(x, np.float32).astype(float)


# neighbour graph

def best(vectors, query_id, query, k):
    scores = {i: float(v @ query) for i, v in vectors.items() if i != query_id}
    return sorted(scores.items(), key=lambda p: (-p[1], p[0]))[:k], scores


@pytest.mark.parametrize("kind", ["dense", "clusters", "copies", "lengths"])
def test_nearest_recall(spark, kind):
    rng = np.random.default_rng(5)
    v = {"dense": rng.normal(0, 1, (1500, 24)), "clusters": np.repeat(rng.normal(0, 1, (15, 24)), 100, 0) + rng.normal(0, 0.1, (1500, 24)),
         "copies": np.where(np.arange(1500)[:, None] % 3 == 0, 0.5, rng.normal(0, 1, (1500, 24))),
         "lengths": rng.normal(0, 1, (1500, 24)) * rng.uniform(0.5, 2, (1500, 1))}[kind]
    rows = [(2 * i, r) for i, r in enumerate(v)]
    table = table_of(spark, rows + BAD + [(13, [0.0] * 24), (None, [1.0] * 24)] + rows[:2])
    out = neighbour_graph.nearest(table, table.where("vec_id % 20 = 0"), 10, leaf=200, trees=3, beam=64).collect()
    vectors = {i: single(r) for i, r in rows}
    found = {}
    for r in sorted(out, key=lambda r: r["rank"]):
        found.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert set(found) == {i for i in vectors if i % 20 == 0}
    hits = 0
    for q, got in found.items():
        want, scores = best(vectors, q, vectors[q], 10)
        assert len({i for i, _ in got}) == 10 and [r for r in got] == sorted(got, key=lambda p: (-p[1], p[0]))
        assert all(abs(scores[i] - s) <= 1e-12 * max(1, abs(s)) for i, s in got)
        hits += len({i for i, _ in got} & {i for i, _ in want})
    assert hits >= 0.95 * 10 * len(found)


def test_nearest_of_few(spark):
    rows = [(0, [1, 2]), (20, [3]), (2, [0, 1]), (3, [1, 2]), (5, [1, 2])]
    table = table_of(spark, rows)
    out = neighbour_graph.nearest(table, table.where("vec_id % 20 = 0"), 20).collect()
    # equal vectors tie by id; shorter vectors end in zeros
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in out) == [
        (0, 1, 3, 5.0), (0, 2, 5, 5.0), (0, 3, 20, 3.0), (0, 4, 2, 2.0),
        (20, 1, 0, 3.0), (20, 2, 3, 3.0), (20, 3, 5, 3.0), (20, 4, 2, 0.0)]
    outside = table_of(spark, [(100, [0, 5, 7])])
    assert [r.vec_id for r in neighbour_graph.nearest(table, outside, 2).orderBy("rank").collect()] == [0, 3]
    assert neighbour_graph.nearest(table.limit(0), table, 3).collect() == []
    assert neighbour_graph.nearest(table, table.limit(0), 3).collect() == []


def test_descent_improves_lists(spark):
    rng = np.random.default_rng(2)
    v = rng.normal(0, 1, (1200, 16))
    nodes, dims = neighbour_graph.nodes_of(table_of(spark, list(enumerate(v))), 3)
    exact = {i: set(np.argsort(-(v @ v[i]) + np.where(np.arange(1200) == i, 1e9, 0))[:8].tolist()) for i in range(0, 1200, 7)}

    def recall(rounds):
        graph = neighbour_graph.neighbour_graph(nodes, dims, k=12, reverse=6, trees=2, leaf=100, rounds=rounds)
        lists = {r.node: set(r.nbr) for r in graph.collect()}
        assert len(lists) == 1200
        return np.mean([len(exact[i] & lists[i]) / 8 for i in exact])

    assert recall(3) > recall(0) + 0.2


# vector codes

def plain_codes(points, ids, parts, entries, rounds):
    width = points.shape[1] // parts
    order = sorted(range(len(ids)), key=lambda i: (ids[i] is None, ids[i] or 0, points[i].tolist()))
    codes, errors, books = [[] for _ in ids], [0] * len(ids), []
    for p in range(parts):
        own = [[int(x) for x in r[p * width : (p + 1) * width]] for r in points]
        book = [list(own[i]) for i in order[:entries]]

        def nearest(x):
            return min((sum((a - b) ** 2 for a, b in zip(x, e)), j) for j, e in enumerate(book))

        for _ in range(rounds):
            groups = {}
            for x in own:
                groups.setdefault(nearest(x)[1], []).append(x)
            for j, g in groups.items():
                book[j] = [sum(c) // len(g) for c in zip(*g)]
        for i, x in enumerate(own):
            d, j = nearest(x)
            codes[i].append(f"{j:02x}")
            errors[i] += d
        books.append(book)
    return ["".join(c) for c in codes], errors, books


@pytest.mark.parametrize("kind", ["dense", "ties", "clusters", "large"])
def test_codes_match_plain_version(spark, kind):
    rng = np.random.default_rng(len(kind))
    v = {"dense": rng.normal(0, 0.2, (150, 8)), "ties": rng.integers(-1, 2, (150, 8)) / 1024,
         "clusters": np.repeat(rng.normal(0, 1, (10, 8)), 15, 0) + rng.normal(0, 0.001, (150, 8)),
         "large": rng.normal(0, 1, (60, 8)) * 10.0 ** rng.integers(0, 7, (60, 1))}[kind]
    rows = [(1000 - i, r) for i, r in enumerate(v)] + [(None, v[3])]
    rows += [rows[5], rows[5]]
    coded, books = vector_codes.vector_codes(table_of(spark, rows + BAD).repartition(3), 4, 12, 3, 1024, batch=40)
    out = vector_codes.code_report(coded, books).collect()
    points = np.array([[int(np.floor(x * 1024)) for x in single(r)] for _, r in rows], object)
    codes, errors, plain = plain_codes(points, [i for i, _ in rows], 4, 12, 3)
    assert sorted((str(r.vec_id), r.code, r.error) for r in out) == sorted(
        (str(i), c, e) for (i, _), c, e in zip(rows, codes, errors))
    assert [[list(e) for e in b] for b in books] == plain
    by_label = {}
    for (i, _), e in zip(rows, errors):
        key = None if i is None or i % 3 == 0 else i % 3
        by_label[key] = by_label.get(key, 0) + e
    assert all(r.label_error == by_label[None if r.vec_id is None or r.vec_id % 3 == 0 else r.vec_id % 3] for r in out)
    text = ",".join(str(x) for b in plain for e in b for x in e)
    assert {r.codebooks_sha256 for r in out} == {hashlib.sha256(text.encode()).hexdigest()}


def test_whole_subtrees_are_assigned():
    rng = np.random.default_rng(1)
    centres = rng.integers(-5000, 5000, (6, 4))
    points = np.repeat(centres, 200, 0) + rng.integers(-20, 21, (1200, 4))
    tree = vector_codes.CoverTree(points)
    best, whole = tree.assign(centres)
    assert sum(tree.end[n] - tree.start[n] for n, _ in whole) > 1000
    assert (best == vector_codes.squares(tree.points, centres).argmin(1)).all()
    assert sorted(tree.order.tolist()) == list(range(1200))
    sums, counts = tree.sums(centres)
    assert counts.tolist() == [200] * 6 and sums.tolist() == [points[i * 200 : i * 200 + 200].sum(0).tolist() for i in range(6)]
    for node in range(len(tree.start)):  # every point lies within its nodes' radius
        held = tree.points[tree.start[node] : tree.end[node]]
        assert np.sqrt(((held - tree.centres[node]) ** 2).sum(1)).max() <= tree.radius[node] + 1e-9


def test_codes_of_few(spark):
    coded, books = vector_codes.vector_codes(table_of(spark, [(2, [1, 2, 3, 4, 5]), (1, [0.5])]))
    # five dimensions count as eight; two rows make books of two entries
    out = {r.vec_id: (r.code, r.error) for r in coded.collect()}
    assert out == {1: ("00000000", 0), 2: ("01010100", 0)} and [len(b) for b in books] == [2] * 4 and len(books[0][0]) == 2
    for empty in (table_of(spark, [(1, [1.0])]).limit(0), table_of(spark, BAD)):
        coded, books = vector_codes.vector_codes(empty)
        assert vector_codes.code_report(coded, books).collect() == []
    far, _ = vector_codes.vector_codes(table_of(spark, [(1, [3e38, 0, 0, 0]), (2, [-3e38, 0, 0, 0])]), 4, 1, 1)
    assert {r.error for r in far.collect()} == {None}
    bare, _ = vector_codes.vector_codes(table_of(spark, [(1, [1, 2, 3, 4])]).drop("label"))
    assert [(r.code, r.error, r.label) for r in bare.collect()] == [("00000000", 0, None)]


# whitening

def plain_whitening(vectors):
    x = np.array([[int(np.floor(64 * c)) + 1_000_000 for c in v] for v in vectors], object)
    n, sums = len(x), x.sum(0)
    exact = n * x - sums
    centred = exact.astype(float) / n
    values, directions = np.linalg.eigh(centred.T @ centred / n)
    return [int(d) for d in (exact * exact).sum(1)], centred, values[::-1], directions[:, ::-1]


@pytest.mark.parametrize("scale", [1.0, 1e5])
def test_whitening_matches_eigenvectors(spark, scale):
    rng = np.random.default_rng(9)
    v = single(rng.normal(0, 1, (400, 12)) @ np.diag(np.linspace(1, 4, 12)) @ rng.normal(0, 1, (12, 12)) * scale)
    rows = list(enumerate(v)) + [(None, v[0]), (3, v[3])]
    out = whitening.whitened(table_of(spark, rows + BAD).repartition(5), 5).collect()
    deviation, centred, values, directions = plain_whitening([r for _, r in rows])
    assert len(out) == 5 * len(rows) and {r.n for r in out} == {len(rows)}
    assert max(r.identity_error for r in out) < 1e-9
    got = {(r.vec_id, r.component): r for r in out if r.vec_id not in (None, 0, 3)}
    for c in range(5):
        want = centred @ directions[:, c] / np.sqrt(values[c])
        have = np.array([got[i, c + 1].whitened for i in range(400) if i not in (0, 3)])
        want = want[[i for i in range(400) if i not in (0, 3)]]
        assert np.allclose(have, want * np.sign(have @ want), atol=1e-7)
        assert abs(got[1, c + 1].explained / (values[c] / values.sum()) - 1) < 1e-9
    assert all(got[i, 1].deviation == (deviation[i] if deviation[i] < 1 << 63 else None) for i in range(4, 400))


def test_whitening_of_flat_and_few(spark):
    rng = np.random.default_rng(4)
    v = np.concatenate([rng.normal(0, 1, (50, 2)), np.ones((50, 2))], 1)  # two dimensions never move
    out = whitening.whitened(table_of(spark, list(enumerate(v))), 32).collect()
    assert len(out) == 200 and {r.component for r in out} == {1, 2, 3, 4}
    flat = [r for r in out if r.component > 2]
    assert {(r.whitened, r.explained) for r in flat} == {(0.0, 0.0)} and out[0].identity_error < 1e-9
    alone = whitening.whitened(table_of(spark, [(5, [1.0, 2.0])])).collect()
    assert [(r.vec_id, r.component, r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in alone] == [
        (5, 1, 1, 0, 0.0, 0.0, 0.0), (5, 2, 1, 0, 0.0, 0.0, 0.0)]
    short = whitening.whitened(table_of(spark, [(1, [1.0]), (2, [1.0, 1.0]), (3, [])])).collect()
    assert len(short) == 6
    assert whitening.whitened(table_of(spark, BAD)).collect() == []
    assert whitening.whitened(table_of(spark, BAD).limit(0)).collect() == []


def test_folding_in_rounds(spark, monkeypatch):
    monkeypatch.setattr(whitening, "FAN", 2)
    rng = np.random.default_rng(8)
    v = single(rng.normal(0, 1, (200, 3)))
    out = whitening.whitened(table_of(spark, list(enumerate(v))).repartition(9), 3).collect()
    _, _, values, _ = plain_whitening(v)
    shares = sorted({round(r.explained, 12) for r in out}, reverse=True)
    assert np.allclose(shares, values / values.sum(), atol=1e-10) and out[0].identity_error < 1e-9


@pytest.mark.parametrize("name", ["random", "graded", "equal", "repeated", "near", "deficient", "wide", "zero"])
def test_singular_values_and_vectors(name):
    rng = np.random.default_rng(3)
    q = lambda: np.linalg.qr(rng.normal(size=(20, 20)))[0]
    m = {"random": rng.normal(size=(20, 20)), "graded": rng.normal(size=(20, 20)) * np.logspace(0, -9, 20), "equal": 3 * np.eye(9),
         "repeated": q() @ np.diag([3.0] * 7 + [2.0] * 7 + [1.0] * 6) @ q(), "near": q() @ np.diag(1 + 1e-9 * np.arange(20)) @ q(),
         "deficient": rng.normal(size=(20, 4)) @ rng.normal(size=(4, 20)), "wide": rng.normal(size=(3, 8)), "zero": np.zeros((4, 4))}[name]
    values, vectors = bidiagonal.eigen_of_gram(m)
    want = np.zeros(m.shape[1])
    want[: min(m.shape)] = np.linalg.svd(m, compute_uv=False) ** 2
    assert np.allclose(values, want, rtol=1e-10, atol=1e-13 * max(1e-300, want.max()))
    assert np.abs(vectors.T @ vectors - np.eye(len(values))).max() < 1e-10
    assert np.abs(m.T @ m @ vectors - vectors * values).max() <= 1e-10 * max(1e-300, want.max()) + 1e-300
