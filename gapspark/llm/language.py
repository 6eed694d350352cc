"""Language identification with hyperdimensional profiles.

Every letter has a random vector of +1 and -1, drawn from its code point. A trigram is bound from its
three letters' vectors, permuted by their place (rotated twice, once, not at all) and multiplied; a
text is the bundle (sum) of its trigrams; a language is the bundle of its training texts, each at
length one. A text gets the language with the largest cosine, ties go to the smaller name.

Letters are compared in lower case; everything else counts as one space between words.

Defined cases: ``und`` with score 0 for null texts, texts without letters and where nothing could be
learned; null ids are not held out and not learned from; repeated rows are all returned.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gapspark.llm.common import arrow_schema, batches_of, in_chunks, materialize, worker_state

DIMENSIONS = 1024
SEED = 20240
#: Ids of sampled texts that are broadcast at most.
BROADCAST_IDS = 100_000
#: Sizes of at most so many languages are sent to all executors.
BROADCAST_LANGUAGES = 10_000
#: A text is like none of the languages if it scores less than this share of the least right score learned.
BOUND_SHARE = 0.5
UNKNOWN = "und"
GAP = 32
#: Characters whose trigrams are counted at once, and trigrams whose vectors are held at once.
SPAN, COLUMNS, TEXTS = 1 << 20, 4096, 128


class Profiles:
    """Bundles of texts; letter vectors are made as letters come up."""

    def __init__(self, dimensions: int = DIMENSIONS):
        self.dimensions = dimensions
        self.letter = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)
        self.number = np.full(0x110000, -1, np.int64)
        self.vectors = np.zeros((0, dimensions), np.int8)

    def numbered(self, points: np.ndarray) -> np.ndarray:
        new = np.unique(points[self.number[points] < 0])
        if len(new):
            self.number[new] = len(self.vectors) + np.arange(len(new))
            drawn = [np.random.default_rng((SEED, int(p))).choice(np.array([-1, 1], np.int8), self.dimensions) for p in new]
            self.vectors = np.concatenate([self.vectors, np.array(drawn, np.int8)])
        return self.number[points]

    def trigrams(self, text: str) -> tuple[np.ndarray, np.ndarray] | None:
        """Distinct trigrams as numbers and how often each comes; None for a text without letters."""
        kinds, counts = [], []
        tail = np.array([GAP], np.uint32)
        any_letter = False
        for at in range(0, len(text), SPAN):
            points = np.frombuffer(text[at : at + SPAN].lower().encode("utf-32-le", "surrogatepass"), np.uint32)
            letters = self.letter[points]
            any_letter |= bool(letters.any())
            points = np.concatenate([tail, np.where(letters, points, GAP)])
            if at + SPAN >= len(text):
                points = np.append(points, np.uint32(GAP))
            space = points == GAP
            points = points[np.concatenate([[True], ~(space[1:] & space[:-1])])]
            ids = self.numbered(points)
            if len(ids) >= 3:
                keys, n = np.unique((ids[:-2] << 40) | (ids[1:-1] << 20) | ids[2:], return_counts=True)
                kinds.append(keys)
                counts.append(n)
            tail = points[-2:]
        if not any_letter:
            return None
        if len(kinds) == 1:
            return kinds[0], counts[0]
        keys, place = np.unique(np.concatenate(kinds), return_inverse=True)
        return keys, np.bincount(place, weights=np.concatenate(counts)).astype(np.int64)

    def bound(self, keys: np.ndarray) -> np.ndarray:
        """Vectors of trigrams."""
        part = (1 << 20) - 1
        first, second, third = self.vectors[keys >> 40], self.vectors[keys >> 20 & part], self.vectors[keys & part]
        return np.roll(first, 2, 1) * np.roll(second, 1, 1) * third

    def bundles(self, texts: list[str]) -> np.ndarray:
        """One row per text at length one; zeros for a text without letters."""
        out = np.zeros((len(texts), self.dimensions), np.float32)
        for at in range(0, len(texts), TEXTS):
            found = [self.trigrams(t) for t in texts[at : at + TEXTS]]
            rows = np.concatenate([np.full(len(x[0]), i) for i, x in enumerate(found) if x] or [np.zeros(0, int)])
            if not len(rows):
                continue
            keys = np.concatenate([x[0] for x in found if x])
            counts = np.concatenate([x[1] for x in found if x])
            kinds, place = np.unique(keys, return_inverse=True)
            for start in range(0, len(kinds), COLUMNS):
                width = min(COLUMNS, len(kinds) - start)
                own = (place >= start) & (place < start + width)
                table = np.zeros((len(found), width), np.float32)
                table[rows[own], place[own] - start] = counts[own]
                out[at : at + len(found)] += table @ self.bound(kinds[start : start + width]).astype(np.float32)
        length = np.linalg.norm(out, axis=1, keepdims=True)
        return np.divide(out, length, out=np.zeros_like(out), where=length > 0)


def profiles() -> Profiles:
    state = worker_state()
    if "profiles" not in state:
        state["profiles"] = Profiles()
    return state["profiles"]


def held_out(doc_id: Column) -> Column:
    """The fold that is never learned from: crc32 of the id as text is a multiple of 5."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def learned_from(doc_id: Column, lang: Column, text: Column) -> Column:
    """Whether a document is one to learn from: labelled, with an id that is not held out."""
    return lang.isNotNull() & text.isNotNull() & doc_id.isNotNull() & ~held_out(doc_id)


def training_texts(docs: DataFrame, sample: int | None = None, doc_id: str = "doc_id", text: str = "text",
                   lang: str = "lang") -> DataFrame:
    """(lang, text) of all documents to learn from, or only of ``sample`` ids of each language, picked by a
    hash of the id."""
    own = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{lang}`").alias("lang"), F.col(f"`{text}`").alias("text"))
    if sample is None:
        return own.where(learned_from(F.col("doc_id"), F.col("lang"), F.col("text"))).select("lang", "text")
    labelled = own.select("doc_id", "lang").where("lang is not null and doc_id is not null").where(~held_out(F.col("doc_id")))
    # a share of the hashes leaves about twice the sample of each language to rank
    sizes = materialize(labelled.groupBy("lang").agg(F.count("*").alias("n")), "language-sizes")
    if sizes.count() <= BROADCAST_LANGUAGES:  # else the join shuffles by language
        sizes = F.broadcast(sizes)
    share = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 31)) / (1 << 31)
    near = labelled.join(sizes, "lang").where(share * F.col("n") < 2 * sample + 20)
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(share, "doc_id"))
    chosen = materialize(near.withColumn("k", rank).where(F.col("k") <= sample).select("doc_id").distinct(), "sample")
    if chosen.count() <= BROADCAST_IDS:  # at most ``sample`` ids per language: else the join shuffles
        chosen = F.broadcast(chosen)
    return own.where("lang is not null and text is not null").join(chosen, "doc_id", "left_semi").select("lang", "text")


def learn_from(texts: DataFrame) -> dict[str, np.ndarray]:
    """Language prototypes at length one, from all rows of lang and text. Every task sums its own texts,
    Spark sums the tasks; one row per language comes back."""
    batches_of(texts.sparkSession)
    ddl = "lang string, total array<double>"
    schema = arrow_schema(ddl)

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            vectors = profiles().bundles(batch.column(1).to_pylist())
            names = np.array(batch.column(0).to_pylist(), object)
            for name in set(names):
                sums[name] = sums.get(name, 0) + vectors[names == name].sum(0, dtype=np.float64)
        yield from in_chunks(((k, v.tolist()) for k, v in sums.items()), schema, 64)

    parts = texts.mapInArrow(total, ddl).select("lang", F.posexplode("total").alias("at", "x"))
    whole = parts.groupBy("lang", "at").agg(F.sum("x").alias("x")).groupBy("lang").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("at", "x"))), lambda r: r["x"]).alias("total"))
    sums = {row.lang: np.array(row.total) for row in whole.collect()}
    return {k: (v / np.linalg.norm(v)).astype(np.float32) for k, v in sorted(sums.items()) if np.linalg.norm(v) > 0}


def learn(docs: DataFrame, sample: int | None = None, doc_id: str = "doc_id", text: str = "text",
          lang: str = "lang") -> dict[str, np.ndarray]:
    """Language prototypes at length one, from all texts to learn from, or ``sample`` ids of each language."""
    return learn_from(training_texts(docs, sample, doc_id, text, lang))


def least_of(judged: DataFrame) -> float:
    """``BOUND_SHARE`` of the least score among rows of lang, lang_pred and score that got their language:
    what scores less is like no text that was learned from. Zero if none got it."""
    right = judged.where(F.col("lang") == F.col("lang_pred"))
    return BOUND_SHARE * (right.agg(F.min("score")).first()[0] or 0.0)


def least_score(texts: DataFrame, prototypes: dict[str, np.ndarray]) -> float:
    """``least_of`` the labelled ``texts``."""
    return least_of(predict(texts, prototypes, ("lang",)))


def predict(docs: DataFrame, prototypes: dict[str, np.ndarray], keep: tuple[str, ...] = ("doc_id",),
            text: str = "text") -> DataFrame:
    """Columns ``keep``, lang_pred and score (the cosine, at least 0) of every row."""
    batches_of(docs.sparkSession)
    kept = docs.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text}`").alias("text of it"))
    ddl = ", ".join([f"`{c}` {kept.schema[c].dataType.simpleString()}" for c in keep] + ["lang_pred string", "score double"])
    schema = arrow_schema(ddl)
    names = list(prototypes)
    table = np.array([prototypes[k] for k in names], np.float32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = [t or "" for t in batch.column(batch.num_columns - 1).to_pylist()]
            labels, scores = [UNKNOWN] * len(values), np.zeros(len(values))
            if names and values:
                vectors = profiles().bundles(values)
                cosines = vectors @ table.T
                best = cosines.argmax(1)
                known = vectors.any(1)
                scores = np.where(known, np.clip(cosines.max(1), 0, 1), 0).astype(float)
                labels = [names[b] if k else UNKNOWN for b, k in zip(best, known)]
            arrays = [*batch.columns[:-1], pa.array(labels, pa.string()), pa.array(scores, pa.float64())]
            yield pa.RecordBatch.from_arrays([a.cast(f.type) for a, f in zip(arrays, schema)], schema=schema)

    return kept.mapInArrow(run, ddl)


def identify_languages(docs: DataFrame, sample: int | None = None) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every document; learns from all of the other folds,
    or from ``sample`` ids of each language in them."""
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang")
    found = predict(ids, learn(ids, sample))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
