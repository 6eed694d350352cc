"""Registered queries of the operators here: each applies one to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gapspark.llm import (
    decontamination, id_files, impact_search, language, line_spread, neighbour_graph, packing, repeated_bytes, simhash,
    token_counts, vector_codes, warc, whitening,
)
from gapspark.llm.common import materialize, read_table

SEQUENCE_TOKENS = 1024
BYTE_BPE, BYTE_BPE_END = "byte_bpe_50k.json", 2
WORD_BPE, WORD_BPE_END = "word_bpe_49k.json", 1


def op1_impact_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = materialize(impact_search.whole_vectors(read_table(spark, sf_dir, "embeddings"), 64), "whole-vectors")
    return impact_search.top_k(vectors, vectors.where(F.col("vec_id") % 20 == 0), 20)


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.token_pieces(
        read_table(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_BPE), True, BYTE_BPE_END, SEQUENCE_TOKENS)
    return packing.pack(pieces, SEQUENCE_TOKENS)


def op3_repeated_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repeated_bytes.remove_repeated_bytes(read_table(spark, sf_dir, "documents"), 400, with_bytes=True)
    # bytes of a character that was cut apart cannot be shown as text
    return found.withColumn("kept", F.make_valid_utf8(F.col("kept").cast("string")))


def op4_token_id_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return id_files.token_id_table(
        read_table(spark, sf_dir, "documents"), public_tokenizers.path(WORD_BPE), False, WORD_BPE_END)


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify_languages(read_table(spark, sf_dir, "documents"))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_components(read_table(spark, sf_dir, "documents"), radius=2, size=3)


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.benchmark_overlaps(
        read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "coverage", F.size("tiles").cast("long").alias("n_tiles"), "tiles")


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.page_captures(read_table(spark, sf_dir, "pages"), with_blocks=False).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(
        read_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op10_line_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_spread.remove_widespread_lines(read_table(spark, sf_dir, "documents")).select(
        "doc_id", "text", "n_removed_lines")


def op11_neighbour_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read_table(spark, sf_dir, "embeddings")
    return neighbour_graph.nearest(vectors, vectors.where(F.col("vec_id") % 20 == 0), 20)


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, books = vector_codes.vector_codes(read_table(spark, sf_dir, "embeddings"))
    return vector_codes.code_report(coded, books)


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whitened(read_table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (
        op1_impact_search, op2_best_fit_packing, op3_repeated_bytes, op4_token_id_files, op5_language_id, op6_simhash,
        op7_decontamination, op8_warc, op9_token_counts, op10_line_spread,
        op11_neighbour_graph, op12_vector_codes, op13_whitening)
}



def lloyd_sql(rounds: int, parts: int, entries: int, scale: int) -> str:
    """Lloyd's rounds in SQL: the nearest entry by the least of distance * entries + index."""
    steps = [f"""
WITH kept AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) AS rid, vec_id, label,
         list_transform(embedding, lambda x: floor({scale} * x::DOUBLE)::BIGINT) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
points AS MATERIALIZED (
  SELECT rid, part, list_slice(x, part * len(x) // {parts} + 1, (part + 1) * len(x) // {parts}) AS p
  FROM kept, (SELECT unnest(range({parts})) AS part)),
book0 AS MATERIALIZED (SELECT part, rid - 1 AS entry, p AS c FROM points WHERE rid <= {entries})"""]
    for k in range(rounds + 1):
        steps.append(f"""
near{k} AS MATERIALIZED (
  SELECT rid, part, p, least % {entries} AS entry, least // {entries} AS error FROM (
    SELECT rid, part, any_value(p) AS p, min(
      list_sum(list_transform(list_zip(p, c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::HUGEINT * {entries} + entry) AS least
    FROM points JOIN book{k} USING (part) GROUP BY rid, part))""")
        if k < rounds:
            steps.append(f"""
means{k} AS (
  SELECT part, entry, list((s - ((s % n + n) % n)) // n ORDER BY pos)::BIGINT[] AS c FROM (
    SELECT part, entry, pos, sum(v)::HUGEINT AS s, count(*) AS n FROM (
      SELECT part, entry, unnest(p) AS v, generate_subscripts(p, 1) AS pos FROM near{k}) GROUP BY ALL) GROUP BY part, entry),
book{k + 1} AS MATERIALIZED (
  SELECT part, entry, coalesce(m.c, b.c) AS c FROM book{k} b LEFT JOIN means{k} m USING (part, entry))""")
    return ",".join(steps) + f""",
coded AS (
  SELECT rid, string_agg(format('{{:02x}}', entry::BIGINT), '' ORDER BY part) AS code, sum(error)::BIGINT AS error
  FROM near{rounds} GROUP BY rid),
digest AS (
  SELECT sha256(string_agg(v::VARCHAR, ',' ORDER BY part, entry, pos)) AS codebooks_sha256 FROM (
    SELECT part, entry, unnest(c) AS v, generate_subscripts(c, 1) AS pos FROM book{rounds}))
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256
FROM coded JOIN kept USING (rid), digest
"""


ORACLES: dict[str, str] = {
    "op12_vector_codes": lloyd_sql(4, 4, 256, 1024),
    "op1_impact_search": """
WITH sound AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, d.vec_id,
         list_sum(list_transform(list_zip(q.v, d.v), lambda p: p[1] * p[2]))::BIGINT AS score
  FROM sound q, sound d WHERE q.vec_id % 20 = 0 AND q.vec_id <> d.vec_id)
SELECT query_id, rank::INTEGER AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored)
WHERE rank <= 20
""",
    "op8_warc": """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS body, strlen(coalesce(html, '')) AS payload_bytes,
         sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT payload_digest, min(page_id) AS first FROM p WHERE payload_bytes >= 100 GROUP BY ALL)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN first IS NULL OR page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first THEN first END AS refers_to
FROM p LEFT JOIN f USING (payload_digest)
""",
    "op10_line_spread": """
WITH lines AS (
  SELECT row_number() OVER () AS rid, doc_id, source, text FROM documents WHERE text IS NOT NULL),
parts AS (
  SELECT rid, source, length(replace(text, chr(10), '')) AS whole, unnest(string_split(text, chr(10))) AS line,
         generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM lines),
shared AS (
  SELECT line FROM parts WHERE trim(line, ' ') <> '' GROUP BY line HAVING count(DISTINCT source) >= 10),
held AS (SELECT * FROM parts WHERE line IN (SELECT line FROM shared)),
witnesses AS (SELECT rid FROM held GROUP BY rid HAVING sum(length(line)) <= 0.5 * any_value(whole)),
wide AS (
  SELECT line FROM held WHERE rid IN (SELECT rid FROM witnesses) GROUP BY line HAVING count(DISTINCT source) >= 10),
cleaned AS (
  SELECT rid, coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '') AS text,
         count(*) FILTER (WHERE gone) AS n_removed_lines
  FROM (SELECT rid, pos, line, line IN (SELECT line FROM wide) AS gone FROM parts) GROUP BY rid)
SELECT doc_id, c.text, c.n_removed_lines FROM lines JOIN cleaned c USING (rid)
UNION ALL SELECT doc_id, NULL, 0 FROM documents WHERE text IS NULL
""",
}
