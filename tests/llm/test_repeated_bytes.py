"""Repeated bytes against brute force over all windows."""

import hashlib
import random
from collections import Counter

import pytest

from gapspark.llm import repeated_bytes


def brute(texts, t):
    bodies = [(x or "").encode() for x in texts]
    counts = Counter(b[i : i + t] for b in bodies for i in range(len(b) - t + 1))
    out = []
    for b in bodies:
        gone = [False] * len(b)
        for i in range(len(b) - t + 1):
            if counts[b[i : i + t]] > 1:
                gone[i : i + t] = [True] * t
        kept = bytes(x for x, g in zip(b, gone) if not g)
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out.append((len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def made(seed, t):
    rng = random.Random(seed)
    letters = "abé " if seed % 2 else "abcdefghijklmnopqrstuvwxyzé "
    text = lambda n: "".join(rng.choices(letters, k=n))
    passages = [text(rng.randint(t - 2, 3 * t)) for _ in range(5)]
    out = [None, "", "x", "ab" * (3 * t), "a" * (t + 3), "q" * t]
    for _ in range(60):
        parts = [text(rng.randint(0, 3 * t)) for _ in range(rng.randint(1, 3))]
        for k in range(rng.randint(0, 2)):
            p = rng.choice(passages)
            a = rng.randint(0, max(0, len(p) - t))
            parts.insert(rng.randrange(len(parts) + 1), p[a : a + rng.randint(t - 3, 3 * t)])
        out.append("".join(parts))
    for base in rng.sample(out[6:], 10):  # copies and near copies
        out.append(base)
        if base:
            i = rng.randrange(len(base))
            out.append(base[:i] + "#" + base[i + 1 :])
    return out


@pytest.mark.parametrize("seed,t,gram", [(1, 40, 20), (2, 40, None), (3, 70, 11), (4, 50, 50), (5, 64, 1)])
def test_matches_brute_force(spark, seed, t, gram):
    texts = made(seed, t)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    out = {r.doc_id: r for r in repeated_bytes.remove_repeated_bytes(df, t, gram).collect()}
    for i, want in enumerate(brute(texts, t)):
        r = out[i]
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == want, (i, texts[i])
        assert hashlib.sha256(bytes(r.kept)).hexdigest() == r.kept_sha256


def test_nulls_repeats_extra_columns_and_empty(spark):
    df = spark.createDataFrame([(None, "abcdef", 1), (3, "abcdef", 2), (3, "abcdef", 2), (4, None, 2)],
                               "doc_id long, text string, ta int")
    out = repeated_bytes.remove_repeated_bytes(df, 4, 2).collect()
    assert sorted((str(r.doc_id), r.n_removed, r.n_spans) for r in out) == [
        ("3", 6, 1), ("3", 6, 1), ("4", 0, 0), ("None", 6, 1)]
    assert repeated_bytes.remove_repeated_bytes(df.limit(0), 4, 2).collect() == []
