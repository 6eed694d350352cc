"""The corpus pipeline: documents in, packed training sequences out.

Every stage takes all that its predecessor kept, is written as Parquet and read again. Documents are
told apart by their text (a pair of 64-bit hashes), so null and repeated ids are safe throughout.
Columns beyond those of ``documents`` are dropped by the first stage, missing ones count as null. Rows
with equal ids and different texts are documents of their own; rows equal in both count once from
near-duplicate removal on, and of a group of copies the smallest id stays, of equal ids the text with
the smaller hash. Every stage returns no rows for an empty table.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gapspark.llm import decontamination, language, line_spread, packing, simhash
from gapspark.llm.common import hash_pair, materialize, read_table

COLUMNS = {"doc_id": T.LongType(), "text": T.StringType(), "lang": T.StringType(), "source": T.StringType(),
           "n_chars": T.LongType()}
SHINGLE_WORDS, SIMILARITY = 5, 0.8
SEQUENCE_TOKENS = 1024
#: Stands for a null id, after all others.
NAMELESS = (1 << 63) - 1
TOKENIZER, END_ID = "byte_bpe_50k.json", 2


def as_documents(docs: DataFrame) -> DataFrame:
    return docs.select(*[(F.col(f"`{c}`") if c in docs.columns else F.lit(None)).cast(t).alias(c)
                         for c, t in COLUMNS.items()])


def with_text_key(docs: DataFrame) -> DataFrame:
    """Adds ta and tb, the hashes of the text; null counts as empty."""
    ta, tb = hash_pair(F.coalesce(F.col("text"), F.lit("")))
    return docs.select("*", ta.alias("ta"), tb.alias("tb"))


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents without any letters, which have no language (``und``), and those that score
    below the bound learned with the languages. Both are learned from every labelled document of the
    folds that are not held out. Without labels to learn from, no text but those without letters is
    rejected."""
    docs = as_documents(docs)
    prototypes = language.learn(docs)
    if not prototypes:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    found = materialize(language.predict(docs, prototypes, tuple(COLUMNS)), "language-scores")
    bound = language.least_of(found.where(language.learned_from(F.col("doc_id"), F.col("lang"), F.col("text"))))
    return found.where((F.col("lang_pred") != language.UNKNOWN) & (F.col("score") >= bound)).select(*COLUMNS)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes lines that many sites share. Copies and near copies of one document on many sites do not
    make its lines boilerplate, so they come whole to the next stage."""
    cleaned = line_spread.remove_widespread_lines(as_documents(docs))
    return cleaned.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of copies and near copies: that with the smallest id.

    Texts are shuffled twice: to compare shingle sets inside loose groups, and to give the result.
    """
    keyed = with_text_key(as_documents(docs)).withColumn("name", F.coalesce("doc_id", F.lit(NAMELESS)))
    prints = simhash.fingerprints(keyed, SHINGLE_WORDS, simhash.WIDE_WORDS, ("ta", "tb", "name"), distinct=True, bands=True)
    words = [f"fp{k}" for k in range(simhash.WIDE_WORDS)]
    # one row per distinct text, which stands for all of its copies
    nodes = materialize(
        prints.groupBy("ta", "tb").agg(
            F.min("name").alias("name"), F.max("n_shingles").alias("n"), F.max("bands").alias("bands"),
            *[F.max(w).alias(w) for w in words])
        .withColumn("node", F.monotonically_increasing_id()), "distinct-texts")
    loose = simhash.loose_groups(nodes.select("node", "n", "bands", *words), SIMILARITY)
    once = keyed.dropDuplicates(["ta", "tb", "name"])
    members = once.join(nodes.select("ta", "tb", "name", "node").join(loose, "node"), ["ta", "tb", "name"])
    roots = simhash.exact_groups(members.select("root", "node", "text"), SHINGLE_WORDS, SIMILARITY)
    grouped = nodes.join(roots, "node", "left").select("ta", "tb", "name", F.coalesce("root", "node").alias("root"))
    stay = grouped.groupBy("root").agg(F.min(F.struct("name", "ta", "tb")).alias("first")).select("first.*")
    return once.join(stay, ["ta", "tb", "name"], "left_semi").select(*COLUMNS)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes documents that hold a benchmark item."""
    keyed = with_text_key(as_documents(docs))
    hits = decontamination.benchmark_overlaps(keyed, read_table(spark, sf_dir, "benchmark"), keep=("ta", "tb"))
    held = materialize(hits.select("ta", "tb").distinct(), "contaminated-texts")
    return keyed.join(held, ["ta", "tb"], "left_anti").select(*COLUMNS)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs all documents into training sequences."""
    pieces = packing.token_pieces(
        as_documents(docs), public_tokenizers.path(TOKENIZER), True, END_ID, SEQUENCE_TOKENS)
    return packing.pack(pieces, SEQUENCE_TOKENS)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontaminate", decontaminate),
    ("best_fit_packing", best_fit_packing),
]

#: SQL cannot express the stages; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
