"""SimHash groups against brute force, and the defined cases."""

import random

import pytest
from xxhash import xxh64_intdigest

from gapspark.llm import simhash
from gapspark.llm.graph import connected_components


def components(n, linked):
    parent = list(range(n))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(n):
        for j in range(i):
            if linked(i, j):
                parent[max(root(i), root(j))] = min(root(i), root(j))
    return [root(i) for i in range(n)]


def plain_fingerprint(text, size=3):
    words = "".join(c.lower() if c.isascii() else c for c in text).encode().split()
    shingles = [b" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))] if words else []
    value = 0
    for bit in range(64):
        if 2 * sum(xxh64_intdigest(s, 42) >> bit & 1 for s in shingles) > len(shingles):
            value |= 1 << bit
    return value


def varied_texts(seed=3, groups=12):
    rng = random.Random(seed)
    vocabulary = [f"w{i}é" for i in range(400)]
    texts = []
    for _ in range(groups):
        base = rng.choices(vocabulary, k=rng.randint(1, 90))
        for _ in range(rng.randint(1, 6)):
            own = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 4])):
                own[rng.randrange(len(own))] = rng.choice(vocabulary)
            texts.append((" " if rng.random() < 0.5 else "\n\t").join(own))
    return texts + [None, "", " \n", "One", "ONE", "one two", "x " * 30000]


def test_components_match_brute_force(spark):
    texts = varied_texts()
    rows = [(i, t) for i, t in enumerate(texts)]
    found = {r.doc_id: r for r in simhash.simhash_components(
        spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    prints = [plain_fingerprint(t or "") for t in texts]
    assert [found[i].fingerprint for i in range(len(texts))] == [f"{p:016x}" for p in prints]
    expected = components(len(texts), lambda i, j: (prints[i] ^ prints[j]).bit_count() <= 2)
    assert [found[i].component_id for i in range(len(texts))] == expected


def test_nulls_repeats_extra_columns_and_empty(spark):
    rows = [(None, "a b c d", 1), (4, "a b c d", 2), (4, "a b c d", 2), (None, "q r s t u", 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, fp0 int")
    out = sorted(((r.doc_id, r.component_id) for r in simhash.simhash_components(df).collect()), key=str)
    assert out == [(4, 4), (4, 4), (None, 4), (None, None)]
    assert simhash.simhash_components(df.limit(0)).collect() == []


def test_links_of_all_fingerprints(spark):
    rng = random.Random(5)
    base = [rng.getrandbits(64) for _ in range(60)]
    values = {b ^ sum(1 << k for k in rng.sample(range(64), rng.choice([0, 1, 2, 3]))) for b in base for _ in range(8)}
    values = sorted(v - (1 << 64) if v >> 63 else v for v in values)
    nodes = spark.createDataFrame([(v, v) for v in values], "node long, fp0 long")
    roots = {r.node: r.root for r in connected_components(simhash.fingerprint_links(nodes, 2)).collect()}
    expected = components(len(values), lambda i, j: ((values[i] ^ values[j]) & (1 << 64) - 1).bit_count() <= 2)
    assert [roots.get(v, v) for v in values] == [values[e] for e in expected]


@pytest.mark.parametrize("seed", [1, 2])
def test_near_duplicates_match_brute_force(spark, seed):
    texts = sorted({t or "" for t in varied_texts(seed)})
    sets = [set(simhash.shingles_of(simhash.words_of(t), 5)) for t in texts]

    def linked(i, j):
        union = len(sets[i] | sets[j])
        return not union or len(sets[i] & sets[j]) >= 0.8 * union

    found = {r.node: r.root for r in simhash.near_duplicates(
        spark.createDataFrame(list(enumerate(texts)), "node long, text string")).collect()}
    assert [found.get(i, i) for i in range(len(texts))] == components(len(texts), linked)


def texts_with_repeated_lines():
    """Pairs of near copies that differ in how often a line repeats, or in a line that repeats."""
    rng = random.Random(11)

    def own(n):
        return " ".join(f"v{rng.randrange(10**6)}" for _ in range(n))

    a, b, c, d = own(300), own(200), own(300), own(200)
    foot, other = "\nread more on our pages", "\nall of it may be copied"
    return [a + 2 * foot, a + 20 * foot, b + foot, b + 40 * foot, c + " -" * 100, c + " =" * 100,
            d + 30 * foot, d + 30 * other, own(300) + 20 * foot, own(200) + " -" * 100]


def test_near_duplicates_with_repeated_lines(spark):
    texts = texts_with_repeated_lines()
    sets = [set(simhash.shingles_of(simhash.words_of(t), 5)) for t in texts]
    linked = lambda i, j: len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])
    expected = components(len(texts), linked)
    assert expected == [0, 0, 2, 2, 4, 4, 6, 6, 8, 9]
    found = {r.node: r.root for r in simhash.near_duplicates(
        spark.createDataFrame(list(enumerate(texts)), "node long, text string")).collect()}
    assert [found.get(i, i) for i in range(len(texts))] == expected


def test_recall_of_near_pairs(spark):
    rng = random.Random(17)
    texts, near = [], []
    for k in range(300):
        words = [f"w{rng.randrange(10**6)}" for _ in range(rng.randint(12, 150))]
        copy = list(words)
        for _ in range(rng.randint(1, max(1, len(words) // 45))):
            copy[rng.randrange(len(copy))] = "changed"
        texts += [" ".join(words), " ".join(copy)]
        a, b = (set(simhash.shingles_of(simhash.words_of(t), 5)) for t in texts[-2:])
        near.append(len(a & b) >= 0.8 * len(a | b))
    assert 60 < sum(near) < 300
    found = {r.node: r.root for r in simhash.near_duplicates(
        spark.createDataFrame(list(enumerate(texts)), "node long, text string")).collect()}
    hits = [found.get(2 * k) is not None and found.get(2 * k) == found.get(2 * k + 1) for k in range(300)]
    assert not any(h and not n for h, n in zip(hits, near))  # no pair below 0.8
    assert sum(hits) >= 0.99 * sum(near)


def test_long_path_is_one_component(spark):
    path = list(range(40))
    random.Random(1).shuffle(path)
    links = spark.createDataFrame(list(zip(path, path[1:])), "u long, v long")
    assert {r.root for r in connected_components(links).collect()} == {0}
