"""Impact search, WARC captures, decontamination and languages against plain versions."""

import gzip
import hashlib
import random

import numpy as np
import pytest

from gapspark.llm import decontamination, impact_search, language, warc


@pytest.mark.parametrize("kind", ["dense", "sparse", "ties", "clusters"])
def test_top_k_matches_brute_force(spark, kind):
    rng = np.random.default_rng(len(kind))
    v = {"dense": rng.normal(0, 0.1, (700, 24)), "sparse": rng.normal(0, 1, (700, 24)) * (rng.random((700, 24)) < 0.1),
         "ties": rng.integers(-1, 2, (700, 6)) / 64, "clusters": np.repeat(rng.normal(0, 0.2, (7, 24)), 100, 0)}[kind]
    rows = [(i * 3, [float(np.float32(x)) for x in r], 1) for i, r in enumerate(v)]
    bad = [(1, None, 1), (4, [1.0, None], 1), (7, [float("nan")] * 3, 1), (10, [float("inf")], 1), (None, [1.0], 1)]
    table = spark.createDataFrame(rows + bad + rows[:2], "vec_id long, embedding array<float>, score int")
    whole = impact_search.whole_vectors(table, 64)
    out = impact_search.top_k(whole, whole.where("vec_id % 20 = 0"), 9, block=300, query_block=7).collect()
    found = {}
    for r in sorted(out, key=lambda r: r["rank"]):
        found.setdefault(r.query_id, []).append((r.vec_id, r.score))
    ints = {i: np.floor(np.array(e, np.float32).astype(float) * 64).astype(int) for i, e, _ in rows}
    assert set(found) == {i for i in ints if i % 20 == 0}
    for q, got in found.items():
        want = sorted(((-int(ints[q] @ ints[i]), i) for i in ints if i != q))[:9]
        assert got == [(i, -s) for s, i in want]


def test_search_prunes_and_shorter_vectors(spark):
    rng = np.random.default_rng(1)
    base = np.floor(rng.normal(0, 8, (4000, 16))).astype(np.int64)
    base[:40] *= 6
    index = impact_search.ImpactIndex(np.arange(4000), base)
    scores = base @ base[3]
    bar = float(np.sort(scores)[-11])
    _, found, levels = index.possible(base[3:4], np.array([bar]))
    assert len(found) < 400 and levels < impact_search.LEVELS  # proof before the last segments
    assert set(np.flatnonzero(scores >= bar)) <= set(found.tolist())
    few = spark.createDataFrame([(0, [1, 2]), (1, [3]), (2, [])], "vec_id long, v array<bigint>")
    out = {(r.query_id, r.vec_id): r.score for r in impact_search.top_k(few, few, 20).collect()}
    assert out == {(0, 1): 3, (0, 2): 0, (1, 0): 3, (1, 2): 0, (2, 0): 0, (2, 1): 0}
    assert impact_search.top_k(few.limit(0), few.limit(0), 3).collect() == []


def test_search_with_large_components(spark):
    rows = [(20, [200000.0, 1.0]), (1, [1e6, -3.0]), (2, [-1e6, 5.0]), (3, [0.5, 0.25]), (40, [1e15, 1.0]), (5, [1e-3, 2.0]),
            (60, [3e38, 0.0])]
    whole = impact_search.whole_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), 64)
    out = impact_search.top_k(whole, whole.where("vec_id % 20 = 0"), 3, block=2, sample=4).collect()
    ints = {i: [int(np.floor(x * 64)) for x in v] for i, v in rows[:-1]}  # no whole number of 64 bits: takes no part
    score = lambda a, b: sum(x * y for x, y in zip(ints[a], ints[b]))
    want = []
    for q in (20, 40):
        best = sorted((-score(q, i), i) for i in ints if i != q)[:3]
        want += [(q, r + 1, i, -s if abs(s) < 1 << 63 else None) for r, (s, i) in enumerate(best)]
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in out) == sorted(want)


def test_captures(spark, tmp_path):
    big = "ü" * 60
    rows = [(5, "http://a.example/x?y=1#z", big, 0), (2, "http://a.example/", big, 0), (9, None, big, 0), (1, "u", "small", 0),
            (3, "u", "small", 0), (4, "http://b.example", None, 0), (6, "b", "", 0), (None, "n", big, 0),
            (7, "c", "x" * 300000, 0), (8, "line\r\nbreak", "y" * 200, 0), (8, "line\r\nbreak", "y" * 200, 0)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, digest int").repartition(2)
    out = warc.page_captures(pages, str(tmp_path)).collect()
    assert len(out) == len(rows)
    for r in out:
        body = next(h for i, _, h, _ in rows if i == r.page_id)
        body = (body or "").encode()
        assert (r.payload_bytes, r.payload_digest) == (len(body), hashlib.sha256(body).hexdigest())
        assert r.request.block.startswith(b"GET /") and r.metadata.record_id
        assert (r.payload is None) == (r.record_type == "revisit") and r.payload in (None, body)
    kinds = sorted((str(r.page_id), r.record_type, r.refers_to) for r in out)
    assert [k for k in kinds if k[1] == "revisit"] == [("5", "revisit", 2), ("9", "revisit", 2), ("None", "revisit", 2)]
    archive = gzip.decompress(next(tmp_path.glob("*.warc.gz")).read_bytes())
    assert archive.startswith(b"WARC/1.1\r\nWARC-Type: request")
    assert warc.page_captures(pages.limit(0)).collect() == []


def plain_tiles(item, doc, least):
    marked_i, marked_d, total = set(), set(), 0
    while True:
        best = (0, 0, 0)
        for i in range(len(item)):
            for j in range(len(doc)):
                n = 0
                while (i + n < len(item) and j + n < len(doc) and item[i + n] == doc[j + n]
                       and i + n not in marked_i and j + n not in marked_d):
                    n += 1
                if n > best[0]:
                    best = (n, i, j)
        if best[0] < least:
            return total
        n, i, j = best
        marked_i |= set(range(i, i + n))
        marked_d |= set(range(j, j + n))
        total += n


def test_tiling_matches_plain_version(spark):
    rng = random.Random(3)
    vocabulary = [f"w{k}" for k in range(12)]
    items = [(k, " ".join(rng.choices(vocabulary, k=rng.randint(3, 25)))) for k in range(6)] + [(None, None), (8, "")]
    docs = []
    for d in range(40):
        words = rng.choices(vocabulary, k=rng.randint(0, 40))
        if d % 2:
            own = items[rng.randrange(6)][1].split()
            cut = rng.randint(0, len(own))
            words[3:3] = own[cut:] + own[:cut]
        docs.append((d, " ".join(words).upper(), 1))
    docs += [(None, None, 1), docs[1], docs[1]]
    a = spark.createDataFrame(docs, "doc_id long, text string, item_id int")
    b = spark.createDataFrame(items, "item_id long, text string")
    for salts in (1, 16):
        out = decontamination.benchmark_overlaps(a, b, 3, 0.5, salts=salts).collect()
        want = []
        for d, t, _ in docs:
            for k, x in items:
                item = decontamination.words_of(x or "")
                n = plain_tiles(item, decontamination.words_of(t or ""), 3)
                if n and n >= 0.5 * len(item):
                    want.append((d, k, round(n / len(item), 9)))
        assert sorted((r.doc_id, r.item_id, round(r.coverage, 9)) for r in out) == sorted(want)
    assert decontamination.benchmark_overlaps(a.limit(0), b).collect() == []
    assert decontamination.benchmark_overlaps(a, b.limit(0)).collect() == []


def test_short_and_unspaced_items_and_long_texts(spark, monkeypatch):
    ideographs = "".join(chr(0x4E00 + 7 * k) for k in range(40))
    items = [(1, "forty two"), (2, ideographs), (3, " ".join(f"n{k}" for k in range(20))), (3, " ".join(f"n{k}" for k in range(20)))]
    docs = [(1, "The answer is Forty-Two."), (2, "two forty"), (3, f"x{ideographs[20:]}y{ideographs[:20]}"), (4, ideographs[:20]),
            (5, " ".join(["pad"] * 700_000 + [f"N{k}" for k in range(20)] + ["pad"] * 700_000))]
    a = spark.createDataFrame([(d, t, "row", 0) for d, t in docs], "doc_id long, text string, `row` string, words int")
    b = spark.createDataFrame(items, "item_id long, text string")
    out = decontamination.benchmark_overlaps(a, b, keep=("doc_id", "row")).collect()
    assert sorted((r.doc_id, r.row, r.item_id, r.coverage) for r in out) == [
        (1, "row", 1, 1.0), (3, "row", 2, 1.0), (5, "row", 3, 1.0), (5, "row", 3, 1.0)]
    assert {r.tiles[0].doc_start for r in out if r.doc_id == 5} == {700_000}
    text = " ".join(f"w{k}" for k in range(50))
    monkeypatch.setattr(decontamination, "SPAN_WORDS", 7)
    windows = [words[k : k + 3] for first, words in decontamination.spans_of(text, 2) for k in range(len(words) - 2)]
    assert windows == [[f"w{k}", f"w{k + 1}", f"w{k + 2}"] for k in range(48)]


def test_languages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    out = language.identify_languages(docs, 100).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in out if r.held_out]
    assert len(held) > 20 and sum(r.lang == r.lang_pred for r in held) >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 for r in out)


def test_language_cases(spark):
    rows = [(i, "the cat and the dog " * 3, "en", "x") for i in range(20)] + [(30 + i, "über Öl für äußere", "de", "x") for i in range(20)]
    rows += [(101, None, "en", "x"), (102, "123 !", None, "x"), (None, "die äußere über", "en", "x"), (103, "the " * 400000, None, "x"),
             (104, "", "en", "x"), (1, rows[1][1], "en", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, lang_pred string")
    out = language.identify_languages(docs).collect()
    by_id = {r.doc_id: r for r in out}
    assert len(out) == len(rows) and by_id[101].lang_pred == by_id[102].lang_pred == by_id[104].lang_pred == "und"
    assert by_id[103].lang_pred == "en" and by_id[None].lang_pred == "de" and not by_id[None].held_out
    nothing = language.identify_languages(docs.where("lang is null")).collect()
    assert {(r.lang_pred, r.score) for r in nothing} == {("und", 0.0)}
    assert language.identify_languages(docs.limit(0)).collect() == []


def test_bound_of_scores(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    texts = language.training_texts(docs, 100).cache()
    prototypes = language.learn_from(texts)
    bound = language.least_score(texts, prototypes)
    assert 0 < bound < 0.3
    # practically no held-out document scores below it; a text that repeats one foreign letter does
    judged = language.predict(docs.where(language.held_out(docs.doc_id) & docs.lang.isNotNull()), prototypes, ("doc_id",))
    held = judged.where("lang_pred <> 'und'").collect()
    assert sum(r.score < bound for r in held) <= 0.005 * len(held)
    assert language.least_score(texts, {"xx": -prototypes["en"]}) == 0


def test_long_text_profile_equals_short_spans(monkeypatch):
    text = "Ein langer Satz, der über Grenzen läuft! " * 50
    whole = language.Profiles(64).bundles([text])
    monkeypatch.setattr(language, "SPAN", 7)
    assert np.allclose(whole, language.Profiles(64).bundles([text]), atol=1e-5)
