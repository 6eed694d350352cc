"""The pipeline's stages on a small table with planted cases."""

import random
import zlib

import numpy as np
import pytest

import corpus_pipeline as pipeline
from gapspark.llm import language, simhash


def make(seed=1):
    rng = random.Random(seed)
    words = {k: ["".join(rng.choices(v, k=rng.randint(3, 8))) for _ in range(300)]
             for k, v in {"en": "etaoinshrdlu", "xx": "ßäöüzwkq"}.items()}
    rows = []
    for i in range(120):
        lang = rng.choice(["en", "xx"])
        lines = [" ".join(rng.choices(words[lang], k=rng.randint(8, 20))) for _ in range(rng.randint(2, 6))]
        if i % 3 == 0:
            lines.append("all rights reserved by everyone")
        rows.append((i, "\n".join(lines), lang, f"s{i // 3 % 15}", 0))
    return rng, rows


@pytest.fixture
def folder(spark, tmp_path):
    rng, rows = make()
    items = [(k, " ".join(f"item{k}word{j}" for j in range(24))) for k in range(3)]
    base = rows[7][1].split()
    near = list(base)
    near[3] = "changed"
    rows += [(200, rows[7][1], "en", "s1", 0), (201, " ".join(near), "en", "s2", 0), (202, "123 !!", "en", "s3", 0),
             (203, None, None, None, None), (None, "words without a name at all here", "en", "s4", 0),
             (204, "before " + items[0][1] + " after", "en", "s5", 0),
             (205, " ".join(items[1][1].split()[12:] + ["x"] + items[1][1].split()[:12]), "en", "s6", 0),
             (206, "before " + " ".join(items[2][1].split()[:6]) + " after", "en", "s7", 0), rows[9], rows[9],
             (207, "", "en", "s1", 0), (208, "word " * 20000, "en", "s1", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(
        f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    return str(tmp_path), rows


def test_stages(spark, folder, tmp_path):
    path, rows = folder
    docs, seen = spark.read.parquet(f"{path}/documents.parquet"), {}
    for name, stage in pipeline.STAGES:
        stage(spark, docs, path).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        seen[name] = docs.collect()
        if name != "best_fit_packing":
            assert set(docs.columns) == set(pipeline.COLUMNS)
    ids = {k: [r.doc_id for r in v] for k, v in seen.items()}
    gone = lambda a, b: set(ids[a]) - set(ids[b])
    assert {r[0] for r in rows} - set(ids["language_id"]) == {202, 203, 207}
    assert len(ids["line_dedup"]) == len(ids["language_id"])
    assert not any("rights reserved" in r.text for r in seen["line_dedup"])
    assert all(r.n_chars == len(r.text) for r in seen["line_dedup"])
    # near copies by brute force on the stage's own input
    own = seen["line_dedup"]
    sets = [set(simhash.shingles_of(simhash.words_of(r.text), 5)) for r in own]
    order = sorted(range(len(own)), key=lambda i: (own[i].doc_id is None, own[i].doc_id or 0))
    group = list(range(len(own)))
    for i in order:
        for j in order:
            if i < j and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                a, b = group[i], group[j]
                group = [min(a, b) if g in (a, b) else g for g in group]
    kept = {}
    for i in order:
        kept.setdefault(group[i], own[i].doc_id)
    assert sorted(map(str, kept.values())) == sorted(map(str, ids["near_dedup"]))
    assert {200, 201} <= gone("line_dedup", "near_dedup") and ids["near_dedup"].count(9) == 1
    assert gone("near_dedup", "decontaminate") == {204, 205}
    assert set(ids["best_fit_packing"]) == set(ids["decontaminate"])
    loads = {}
    for r in seen["best_fit_packing"]:
        loads[r.sequence_id] = loads.get(r.sequence_id, 0) + r.length
    assert max(loads.values()) <= 1024


def test_lines_of_pages_go_and_copies_stay(spark):
    rng = random.Random(13)
    line = lambda n: " ".join(f"v{rng.randrange(10**6)}" for _ in range(n))
    frame, twice, near = ([line(n) for _ in range(4)] for n in (4, 12, 12))
    near += [line(12) for _ in range(8)]
    own = [line(20) for _ in range(12)]
    rows = [(i, "\n".join([*frame, own[i]]), f"s{i}") for i in range(12)]
    rows += [(15, "\n".join([*frame, "little"]), "s1")]
    rows += [(20 + i, "\n".join(twice), f"s{i}") for i in range(12)]
    rows += [(40 + i, "\n".join([*near, f"copy number {i}"]), f"s{i}") for i in range(12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = {r.doc_id: r.text for r in pipeline.line_dedup(spark, docs, "").collect()}
    assert [out[i] for i in range(12)] == own and out[15] == "little"
    assert all(out[i] == t for i, t, _ in rows[13:])


def test_texts_like_no_language_go(spark):
    _, rows = make()
    rows += [(300, "\u0436\u0449 " * 40, None, "s1", 0), (301, "5 6 7", None, "s1", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    kept = {r.doc_id for r in pipeline.language_id(spark, docs, "").collect()}
    assert kept == {r[0] for r in rows} - {300, 301}
    unlabelled = pipeline.language_id(spark, docs.drop("lang"), "")
    assert {r.doc_id for r in unlabelled.collect()} == {r[0] for r in rows} - {301}


def test_languages_and_their_bound_are_learned_from_every_labelled_text(spark):
    rng = random.Random(5)
    word = lambda letters: "".join(rng.choices(letters, k=rng.randint(2, 7)))
    text = lambda share: " ".join(word("etaoins" if rng.random() < share else "\u0436\u0449\u044b\u044d") for _ in range(12))
    rows = [(i, text(1), "en") for i in range(1600)] + [(i, text(i % 100 / 100), None) for i in range(2000, 2400)]
    # few texts are odd, so a sample would hardly hold one
    rows += [(i, text(0.5), "en") for i in range(3000, 3006)]
    vectors = language.Profiles().bundles([t for _, t, _ in rows]).astype(float)
    learned = np.array([lang is not None and zlib.crc32(str(i).encode()) % 5 != 0 for i, _, lang in rows])
    assert learned.sum() > 1200
    prototype = vectors[learned].sum(0)
    scores = vectors @ (prototype / np.linalg.norm(prototype))
    bound = language.BOUND_SHARE * scores[learned].min()
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(5)
    found = language.learn(docs)
    assert np.allclose(found["en"], prototype / np.linalg.norm(prototype), atol=1e-6)
    kept = {r.doc_id for r in pipeline.language_id(spark, docs, "").collect()}
    clear = np.abs(scores - bound) > 1e-5
    assert all((i in kept) == (s >= bound) for (i, *_), s, c in zip(rows, scores, clear) if c)
    assert 10 < len(rows) - len(kept)


def test_near_copies_with_repeated_lines(spark):
    rng = random.Random(12)
    body = " ".join(f"v{rng.randrange(10**6)}" for _ in range(300))
    rows = [(1, body + "\nread more on our pages" * 2), (2, body + "\nread more on our pages" * 20), (3, "other text")]
    out = pipeline.near_dedup(spark, spark.createDataFrame(rows, "doc_id long, text string"), "").collect()
    assert sorted(r.doc_id for r in out) == [1, 3]


def test_run_and_empty_table(spark, folder, tmp_path):
    path, _ = folder
    assert pipeline.run(spark, path).count() > 100
    empty = f"{tmp_path}/empty"
    spark.read.parquet(f"{path}/documents.parquet").limit(0).write.parquet(f"{empty}/documents.parquet")
    spark.read.parquet(f"{path}/benchmark.parquet").limit(0).write.parquet(f"{empty}/benchmark.parquet")
    assert pipeline.run(spark, empty).count() == 0
