"""Result trees as experiments leave them: one folder per trial, named files inside.

Every reader returns one row per trial folder with a status for each expected file: ``ok``,
``missing`` or ``unreadable``. A broken file never stops a scan and never counts as a measured zero.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gapspark.functions.parsing import run_name
from gapspark.operators.experiments import assemble_ablation, resource_stats
from gapspark.schemas import ABLATION_RESULT, DRIFT_RUN, EDGE_META, LOSS_RESULT, RESOURCE_SAMPLES

# File names inside a trial folder.
LOSS_FILE, META_FILE, ABLATION_FILE = "loss_rate.json", "meta.json", "results.json"
ABLATION_SAMPLES, DRIFT_FILE = "resource_vector.csv", "fidelity_results.json"


def folder_of(path: Column) -> Column:
    return F.regexp_extract(path, r"^(.*)/[^/]+$", 1)


def name_of(folder: Column) -> Column:
    return F.regexp_extract(folder, r"([^/]+)$", 1)


def _tree(spark: SparkSession, pattern: str):
    return spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", pattern)


def folders(spark: SparkSession, base: str) -> DataFrame:
    """Every folder that holds any file; content is not read."""
    return _tree(spark, "*.*").format("binaryFile").load(base).select(folder_of(F.col("path")).alias("folder")).distinct()


def read_json(spark: SparkSession, base: str, name: str, schema: T.StructType) -> DataFrame:
    """One row per file called ``name``: folder, ``record`` and ``status``. Files may be indented."""
    files = _tree(spark, name).text(base, wholetext=True).select(
        folder_of(F.col("_metadata.file_path")).alias("folder"), "value")
    with_mark = T.StructType([*schema.fields, T.StructField("_unreadable", T.StringType())])
    parsed = files.select("folder", F.from_json(
        "value", with_mark, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_unreadable"}).alias("_r"))
    broken = F.col("_r").isNull() | F.col("_r._unreadable").isNotNull()
    return parsed.select(
        "folder", F.when(~broken, F.struct(*[F.col(f"_r.{f}").alias(f) for f in schema.fieldNames()])).alias("record"),
        F.when(broken, "unreadable").otherwise("ok").alias("status"))


def read_samples(spark: SparkSession, base: str, pattern: str = "resource_*.csv") -> DataFrame:
    """Resource samples with their folder and the system named in the file name."""
    rows = _tree(spark, pattern).schema(RESOURCE_SAMPLES).option("header", True).csv(base)
    path = F.col("_metadata.file_path")
    return rows.withColumn("folder", folder_of(path)).withColumn("system", F.regexp_extract(path, r"resource_([^/]+)\.csv$", 1))


def _with_file(left: DataFrame, files: DataFrame, name: str) -> DataFrame:
    own = files.select("folder", F.col("record").alias(name), F.col("status").alias(f"{name}_status"))
    return left.join(own, "folder", "left").withColumn(
        f"{name}_status", F.coalesce(f"{name}_status", F.lit("missing")))


def scan_trials(spark: SparkSession, base: str) -> DataFrame:
    """One row per trial folder ``<pattern>_rps<n>_trial<k>``: loss result and resource statistics."""
    runs = folders(spark, base).withColumn("run", name_of(F.col("folder"))).withColumn("_n", run_name(F.col("run")))
    runs = runs.where(F.col("_n.rps").isNotNull()).select("folder", "run", "_n.pattern", "_n.rps", "_n.trial")
    out = _with_file(runs, read_json(spark, base, LOSS_FILE, LOSS_RESULT), "loss")
    samples = read_samples(spark, base)
    for system in ("baseline", "proposed"):
        stats = resource_stats(samples.where(F.col("system") == system), ["folder"], f"{system}-")
        out = out.join(stats.select("folder", F.struct(
            "cpu_peak", "cpu_mean", "mem_peak", "mem_mean").alias(f"{system}_resources")), "folder", "left")
    return out.select("run", "pattern", "rps", "trial", "loss.*", "loss_status", "baseline_resources", "proposed_resources")


def scan_edge_trials(spark: SparkSession, base: str) -> DataFrame:
    """One row per folder of a multi-edge experiment: metadata and the loss of the proposed system.

    ``complete`` trials have both files, readable, and a result of that system.
    """
    both = _with_file(_with_file(
        folders(spark, base), read_json(spark, base, META_FILE, EDGE_META), "meta"),
        read_json(spark, base, LOSS_FILE, LOSS_RESULT), "loss")
    return both.select(
        name_of(F.col("folder")).alias("trial_id"), "meta.*", F.col("loss.proposed.loss_rate_percent").alias("loss_rate_percent"),
        F.coalesce("loss.proposed.verification_failed", F.lit(False)).alias("verification_failed"), "meta_status", "loss_status",
        ((F.col("meta_status") == "ok") & (F.col("loss_status") == "ok") & F.col("loss.proposed").isNotNull()).alias("complete"))


def scan_ablation(spark: SparkSession, base: str) -> DataFrame:
    """One row per ablation trial folder: result fields and resource statistics."""
    results = _with_file(folders(spark, base), read_json(spark, base, ABLATION_FILE, ABLATION_RESULT), "result")
    read = results.where("result_status = 'ok'").select(F.col("folder").alias("trial"), "result.*")
    samples = read_samples(spark, base, ABLATION_SAMPLES).withColumnRenamed("folder", "trial")
    scanned = assemble_ablation(read, samples).withColumnRenamed("trial", "folder")
    return results.select("folder", "result_status").join(scanned, "folder", "left").withColumn(
        "trial", name_of(F.col("folder"))).withColumn("complete", F.coalesce("complete", F.lit(False))).drop("folder")


def scan_drift_runs(spark: SparkSession, base: str) -> DataFrame:
    """One row per drift trial ``<run>/<scenario>_trial<k>``: its result, the run's name and the status."""
    trials = _with_file(folders(spark, base), read_json(spark, base, DRIFT_FILE, DRIFT_RUN), "result")
    return trials.select(
        F.regexp_extract("folder", r"([^/]+)/[^/]+$", 1).alias("run"), name_of(F.col("folder")).alias("trial_folder"),
        "result.*", "result_status")
