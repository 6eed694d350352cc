"""Reads that may fail: what could be read, and a status that says whether that is all.

A source is ``ok``, ``missing`` or ``unreadable``. A broken file never stops a read and never passes
as an empty one: the files listed are held against the files that rows came from, and a file without
rows is opened to see whether it is empty or broken.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gapspark.operators.filters import known_node_ids

FILES = "path string, n_rows long, file_status string"


def _judged(silent: DataFrame) -> DataFrame:
    """Status of files that gave no rows, from their content."""
    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import io

        from pyarrow import parquet

        for batch in batches:
            found = []
            for content in batch.column(1).to_pylist():
                try:
                    found.append("ok" if parquet.read_metadata(io.BytesIO(content)).num_rows == 0 else "unreadable")
                except (pa.ArrowException, OSError):
                    found.append("unreadable")
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.string())], names=["path", "judged"])

    return silent.select("path", "content").mapInArrow(judge, "path string, judged string")


def guarded_read(spark: SparkSession, path: str, schema: T.StructType) -> tuple[DataFrame, DataFrame]:
    """(rows that could be read, status per file) of a folder of Parquet files; both empty where the
    folder is missing."""
    empty = spark.createDataFrame([], schema), spark.createDataFrame([], FILES)
    listing = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet").format("binaryFile")
    try:
        files = listing.load(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return empty
    rows = spark.read.schema(schema).option("ignoreCorruptFiles", True).option("recursiveFileLookup", True).option(
        "pathGlobFilter", "*.parquet").parquet(path)
    seen = rows.select(F.col("_metadata.file_path").alias("path")).groupBy("path").agg(F.count(F.lit(1)).alias("n_rows"))
    # readers leave files of no length out, but the listing that Spark made on the driver has them
    same = lambda c: F.regexp_replace(c, "^file:/+", "file:/")
    listed = spark.createDataFrame([(f,) for f in files.inputFiles()], "path string").select(same("path").alias("path"))
    seen, files = seen.withColumn("path", same("path")), files.withColumn("path", same("path"))
    names = listed.join(seen, "path", "left")
    silent = files.join(seen, "path", "left_anti")
    judged = _judged(silent)
    status = names.join(judged, "path", "left").select(
        "path", F.coalesce("n_rows", F.lit(0).cast("long")).alias("n_rows"),
        F.when(F.col("n_rows").isNotNull(), "ok").otherwise(F.coalesce("judged", F.lit("unreadable"))).alias("file_status"))
    return rows, status


def source_status(files: DataFrame) -> DataFrame:
    """One row: n_files, n_unreadable, n_rows and the status of the whole source."""
    counts = files.agg(
        F.count(F.lit(1)).alias("n_files"), F.count_if(F.col("file_status") != "ok").alias("n_unreadable"),
        F.coalesce(F.sum("n_rows"), F.lit(0)).alias("n_rows"))
    return counts.withColumn("source_status", F.when(F.col("n_files") == 0, "missing").when(
        F.col("n_unreadable") > 0, "unreadable").otherwise("ok"))


def guarded_sources(spark: SparkSession, sources: dict[str, str], schema: T.StructType) -> tuple[DataFrame, DataFrame]:
    """(rows with their ``system``, status per system) of several named folders."""
    rows = states = None
    for name, path in sources.items():  # a handful of systems
        own, files = guarded_read(spark, path, schema)
        own, state = own.withColumn("system", F.lit(name)), source_status(files).withColumn("system", F.lit(name))
        rows = own if rows is None else rows.unionByName(own)
        states = state if states is None else states.unionByName(state)
    return rows, states


def guarded_node_ids(spark: SparkSession, path: str, schema: T.StructType) -> tuple[DataFrame, str]:
    """Registered node addresses and the status of their table; the built-in set where the table is
    missing, unreadable or empty."""
    nodes, files = guarded_read(spark, path, schema)
    status = source_status(files).first().source_status
    if status != "ok":
        nodes = spark.createDataFrame([], schema)
    return known_node_ids(nodes), status
