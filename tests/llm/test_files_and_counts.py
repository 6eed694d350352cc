"""Encoders, token-id files, token counts and packing: round trips and the library's own results."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer, models, pre_tokenizers

from gapspark.llm import elias_fano, id_files, packing, token_counts
from gapspark.llm.encoding import Encoder

PIECES = list("ab  \n\t.,'s!09éÉßΣσ́  　\u0085\x1c᠎​漢字Ⅷ½²\U0001f600▁") + [
    "  ", "\n\n", " \n", "<|endoftext|>", "<unk>", "'s", "'re", "</w>", "Ġ", "the", "Word", "Éclair", "a..", "İ"]


def odd_texts(n, seed=1):
    rng = random.Random(seed)
    return ["".join(rng.choices(PIECES, k=rng.randint(0, 40))) for _ in range(n)]


@pytest.mark.parametrize("name,keep_space", [("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)])
@pytest.mark.parametrize("room", [10, 10**6])
def test_encoder_equals_the_library(name, keep_space, room):
    own, library = Encoder(public_tokenizers.path(name), keep_space, room), Tokenizer.from_file(public_tokenizers.path(name))
    special = ["a <|endoftext|> b", "x<|endoftext|>y  <|startoftext|>\n<|endoftext|><|endoftext|>", " <|endoftext|"]
    for text in odd_texts(3000) + special + ["", "plain words, and more.\nNext line!", "x" * 5000]:
        ids = library.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(own.encode(text), "<u4").tolist() == ids, ascii(text)


def test_counts_equal_the_library():
    whole = token_counts.read_vocabulary(public_tokenizers.path("piece_bpe_32k.model"))
    without_bytes = [x for x in whole if not x[0].startswith("<0x")]
    ties = [("<unk>", 0.0), ("▁", -1.0), ("a", -2.0), ("b", -2.0), ("ab", -4.0), ("▁a", -3.0), ("ba", -4.0), ("aba", -6.0)]
    for vocabulary, by_bytes in ((whole, True), (without_bytes, False), (ties, False)):
        library = Tokenizer(models.Unigram(vocabulary, unk_id=0, byte_fallback=by_bytes))
        library.pre_tokenizer = pre_tokenizers.Metaspace(replacement="▁", prepend_scheme="always", split=True)
        own = token_counts.Counter(vocabulary)
        for text in odd_texts(3000, 2) + ["abababba" * 30]:
            assert own.count(text) == len(library.encode(text, add_special_tokens=False).ids), ascii(text)


def test_elias_fano_round_trip():
    rng = np.random.default_rng(1)
    for n, top in ((0, 1), (1, 1), (5, 3), (1000, 10), (1000, 10**12), (3000, 3000), (600, 2**60)):
        values = np.sort(rng.integers(0, top, n, dtype=np.uint64))
        code = elias_fano.EliasFano(elias_fano.encode(values))
        assert (code.all() == values).all()
        assert [code.select(i) for i in range(n)] == values.tolist()
    with pytest.raises(ValueError):
        elias_fano.encode(np.array([2, 1], np.uint64))


TABLE = [(5, "one two"), (3, None), (9, ""), (3, "again"), (None, "nameless"), (-4, "word " * 3000), (7, " \n")]


def test_token_id_files(spark, monkeypatch):
    monkeypatch.setattr(id_files, "FILE_IDS", 8)
    path = public_tokenizers.path("word_bpe_49k.json")
    df = spark.createDataFrame([(d, t, 1) for d, t in TABLE], "doc_id long, text string, start int").repartition(3)
    out = id_files.token_id_table(df, path, False, 1, with_ids=True).collect()
    out.sort(key=lambda r: r.start)
    assert [r.doc_id for r in out] == sorted((d for d, _ in TABLE), key=lambda d: (d is not None, d or 0))
    library, start = Tokenizer.from_file(path), 0
    for row in out:
        assert row.start == start and row.n_tokens == len(row.ids)
        assert row.ids_crc32 == zlib.crc32(np.array(row.ids, "<u4").tobytes())
        start += row.n_tokens
    by_id = {d: t for d, t in TABLE if d != 3}
    for row in out:
        if row.doc_id != 3:
            assert row.ids == library.encode(by_id[row.doc_id] or "", add_special_tokens=False).ids + [1]
    assert id_files.token_id_table(df.limit(0), path, False, 1).collect() == []


def test_a_file_gives_single_documents():
    ids = [np.arange(n, dtype="<u4").tobytes() for n in (3, 1, 70000)]
    file = id_files.IdFile(id_files.file_bytes([None, -5, 8], [3, 1, 70000], ids))
    assert [file.doc_id(i) for i in range(3)] == [None, -5, 8]
    assert [len(file.tokens(i)) for i in range(3)] == [3, 1, 70000]
    assert [(d, s) for d, s, _ in file] == [(None, 0), (-5, 3), (8, 4)]


def test_token_counts_table(spark):
    df = spark.createDataFrame([(1, "a b", 0), (None, None, 0), (1, "", 0)], "doc_id long, text string, n_tokens int")
    out = token_counts.token_counts(df, public_tokenizers.path("piece_bpe_32k.model")).collect()
    assert sorted((tuple(r) for r in out), key=str) == [(1, 0), (1, 2), (None, 0)]


def test_packing(spark, monkeypatch):
    path = public_tokenizers.path("byte_bpe_50k.json")
    rng = random.Random(4)
    rows = [(i, " ".join(rng.choices(["the", "of", "word"], k=rng.randint(0, 260))), 1) for i in range(300)]
    rows += [(None, None, 1), (2, rows[2][1], 1), (999, "of " * 5000, 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, block int")
    out = packing.pack(packing.token_pieces(df, path, True, 2, 128, with_ids=True), 128, block=64).collect()
    library = Tokenizer.from_file(path)
    want = sorted(str(library.encode(t or "", add_special_tokens=False).ids + [2]) for _, t, _ in rows)
    docs, sequences = {}, {}
    for r in out:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
        docs.setdefault(r.doc_id, []).append(r)
        assert r.ids_crc32 == zlib.crc32(r.ids) and 0 < r.length <= 128 and (r.piece == 0 or r.length == 128)
    for own in sequences.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 128
    total = sum(r.length for r in out)
    assert len(sequences) <= 1.06 * (-(-total // 128))
    found = []
    for d, own in docs.items():
        own.sort(key=lambda r: r.piece)
        if d != 2:
            assert [r.start for r in own] == list(np.cumsum([0] + [r.length for r in own[:-1]]))
            found.append(str(np.frombuffer(b"".join(bytes(r.ids) for r in own), "<u4").tolist()))
    assert sorted(found) == sorted(w for w in want if w in found) and len(found) == len(rows) - 2
    assert packing.pack(packing.token_pieces(df.limit(0), path, True, 2, 128), 128).collect() == []


def fewest_bins(sizes, capacity):
    best = len(sizes)

    def place(i, loads):
        nonlocal best
        if len(loads) >= best:
            return
        if i == len(sizes):
            best = len(loads)
            return
        for k in range(len(loads)):
            if loads[k] + sizes[i] <= capacity:
                place(i + 1, [*loads[:k], loads[k] + sizes[i], *loads[k + 1 :]])
        place(i + 1, [*loads, sizes[i]])

    place(0, [])
    return best


def test_evolution_meets_the_optimum_and_beats_best_fit():
    rng = random.Random(1)
    beaten = 0
    for k in range(150):
        sizes = sorted((rng.randint(3, 60) for _ in range(11)), reverse=True)
        lengths, want = np.array(sizes), fewest_bins(sizes, 100)
        evolved = packing.Packing(packing.evolve(lengths, 100, str(k)), lengths, 100)
        assert evolved.count == want >= packing.least_bins(lengths, 100) and evolved.loads.max() <= 100
        beaten += packing.packed(lengths, 100).count > want
    assert beaten >= 4  # where best fit alone needs a bin more


def test_evolution_beats_no_bound_and_keeps_capacity():
    rng = np.random.default_rng(3)
    for n in (1, 7, 800):
        lengths = rng.integers(1, 1025, n)
        bins = packing.evolve(lengths, 1024, "seed")
        loads = np.bincount(bins, weights=lengths)
        assert loads.max() <= 1024 and len(loads) >= -(-lengths.sum() // 1024)
        assert len(loads) <= packing.packed(lengths, 1024).count


def test_evolution_runs_all_generations_below_the_bound(monkeypatch):
    rng = np.random.default_rng(6)
    lengths = np.sort(rng.integers(260, 520, 4100))  # three a bin at most: no packing comes near the bound
    assert packing.packed(lengths, 1024).count > packing.least_bins(lengths, 1024)
    runs = []
    monkeypatch.setattr(packing, "crossover", lambda one, *rest: runs.append(1) or one)
    monkeypatch.setattr(packing, "mutation", lambda one, *rest: one)
    packing.evolve(lengths, 1024, "seed")
    assert len(runs) == packing.GENERATIONS * (packing.POPULATION // 2)


def test_exact_fill_meets_the_bound_where_best_fit_does_not():
    rng = np.random.default_rng(8)
    won = 0
    for _ in range(12):
        lengths = rng.integers(1, 700, 1200)
        found = packing.exact_fill(lengths, 1024)
        assert sorted(np.unique(found.bins)) == list(range(found.count)) and found.loads.max() <= 1024
        least = packing.least_bins(lengths, 1024)
        won += found.count == least < packing.packed(lengths, 1024).count
        assert packing.Packing(packing.evolve(lengths, 1024, "s"), lengths, 1024).count >= least
    assert won >= 3


def test_full_pieces_lie_alone(spark):
    df = spark.createDataFrame([(i, 10 if i % 3 else 4) for i in range(90)], "doc_id long, length int")
    bins = {}
    for r in packing.pack(df, 10, block=8).collect():
        bins.setdefault(r.sequence_id, []).append((r.length, r.offset))
    assert sum(b == [(10, 0)] for b in bins.values()) == 60
    assert all(b == [(10, 0)] or sorted(b) in ([(4, 0)], [(4, 0), (4, 4)]) for b in bins.values())
    assert sum(map(len, bins.values())) == 90


def test_an_exchange_stops_where_nothing_better_can_come(monkeypatch):
    searches = []
    plain = packing.bisect_right
    monkeypatch.setattr(packing, "bisect_right", lambda *a: searches.append(1) or plain(*a))
    # 50 bins of 20 pieces with 24 tokens of room: the first piece given for a loose one of 74 fills the bin
    lengths = np.array([50] * 1000 + [74] * 50)
    bins = np.concatenate([np.repeat(np.arange(50), 20), np.full(50, -1)]).astype(np.int32)
    loads = [1000] * 50
    loose = packing.swap_in(bins, loads, np.arange(1000, 1050), lengths, 1024)
    assert loads == [1024] * 50 and lengths[loose].tolist() == [50] * 50
    assert sorted(bins[1000:].tolist()) == list(range(50))
    assert len(searches) < 50 * 50  # all pairs of a bin are 190


def test_pieces_that_fill_a_sequence_together_lose_no_packing():
    lengths = np.array([600, 424, 424, 512, 512, 512, 1, 600])
    bins = packing.exact_pairs(lengths, 1024)
    assert sorted(lengths[bins == b].tolist() for b in range(3)) == [[424, 600], [512, 512], [600, 424]]
    assert lengths[bins < 0].tolist() == [512, 1]
    for seed in range(150):
        rng = random.Random(seed)
        sizes = np.array([rng.randint(1, 19) for _ in range(rng.randint(1, 11))])
        paired = packing.exact_pairs(sizes, 20)
        rest = sizes[paired < 0].tolist()
        assert not any(a + b == 20 for i, a in enumerate(rest) for b in rest[:i])
        assert fewest_bins(sizes.tolist(), 20) == paired.max() + 1 + (fewest_bins(rest, 20) if rest else 0), sizes


def test_pairs_that_fill_a_sequence_stay_together(spark):
    sizes = [600] * 30 + [424] * 30 + [700, 200, 300, 90]
    df = spark.createDataFrame(list(enumerate(sizes)), "doc_id long, length long").coalesce(1)
    out = packing.pack(df, 1024, block=100).collect()
    held = {}
    for r in out:
        held.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert len(out) == len(sizes) and len(held) == 32
    assert sum(sorted(x for _, x in own) == [424, 600] for own in held.values()) == 30
    for own in held.values():
        assert [at for at, _ in sorted(own)] == [sum(x for _, x in sorted(own)[:k]) for k in range(len(own))]


@pytest.mark.parametrize("name,keep_space", [("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)])
def test_a_known_word_with_marks_is_not_encoded_again(name, keep_space, monkeypatch):
    encoder = Encoder(public_tokenizers.path(name), keep_space)
    library = Tokenizer.from_file(public_tokenizers.path(name))
    spelled, pieces = [], encoder.pieces
    monkeypatch.setattr(encoder, "pieces", lambda word: spelled.append(word) or pieces(word))
    monkeypatch.setattr(encoder, "whole", lambda text: pytest.fail(text))
    text = "ab zorble zorble, zorble. zorble$$$ fünfzig fünfzig%%% fünfzig#& zorble!?***"
    assert np.frombuffer(encoder.encode(text), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids
    assert sum("zorble" in w for w in spelled) == 1 and len(spelled) == len(set(spelled))
