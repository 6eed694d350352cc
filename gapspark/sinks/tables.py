"""Writers: routed appends, verified exports, clean-up, retention, ledger rows.

Every write is repeatable: a batch, a day or a run owns its folders and overwrites only them, and
deletion only follows a verified copy. Stored tables are laid out by ``event_date`` first and the
writing batch second, which is what retention and clean-up act on.
"""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gapspark.operators.retention import RETENTION_DAYS, export_status
from gapspark.schemas import BACKUP_LOG
from gapspark.session import shared_dir

ROUTES = ("threat_events", "threat_events_experiment", "quarantine")
_EVENT_COLUMNS = ["timestamp", "sensor_id", "event_type", "severity", "count", "inject_id", "ts_substituted"]
# ids are looked up in the tagged table only; the filter sizes itself to the ids of each file
_BLOOM = {
    "parquet.bloom.filter.enabled#inject_id": "true",
    "parquet.bloom.filter.adaptive.enabled": "true",
}


def append_routes(validated: DataFrame, batch_id: int, base: str, value: str = "value") -> None:
    """Writes one micro-batch in a single pass, one folder per target, day and batch.

    A retried batch overwrites its own folders only. Event rows are ordered by time and sensor; a
    quarantined row keeps its payload unchanged and lies under the day it came in. A small count
    table per batch, read from the stored rows, says how many went where and why.
    """
    stored = F.col("target") != "quarantine"
    rows = validated.select(
        "target", F.to_date(F.when(stored, F.col("timestamp")).otherwise(F.col("ingest_ts"))).alias("event_date"),
        F.lit(batch_id).cast("bigint").alias("batch_id"),
        *[F.when(stored, F.col(c)).alias(c) for c in _EVENT_COLUMNS],
        F.when(~stored, F.col(value)).alias("raw"), "reason", "ingest_ts",
    )
    rows.sortWithinPartitions("target", "event_date", "timestamp", "sensor_id").write.mode("overwrite").options(
        **_BLOOM).option("partitionOverwriteMode", "dynamic").partitionBy(
        "target", "event_date", "batch_id").parquet(f"{base}/routes")
    spark = validated.sparkSession
    written = spark.read.schema(rows.schema).parquet(f"{base}/routes").where(F.col("batch_id") == batch_id)
    written.groupBy("target", "reason").agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(F.coalesce("ts_substituted", F.lit(False))).alias("n_ts_substituted"),
    ).coalesce(1).write.mode("overwrite").parquet(f"{base}/ingest_metrics/batch_id={batch_id}")


def route_path(base: str, target: str) -> str:
    """The folder of one target's table, laid out by ``event_date`` and ``batch_id``."""
    return f"{base}/routes/target={target}"


def read_route(spark: SparkSession, base: str, target: str) -> DataFrame:
    rows = spark.read.parquet(f"{base}/routes").where(F.col("target") == target)
    if target == "quarantine":
        return rows.select("raw", "reason", "ingest_ts")
    return rows.select(*_EVENT_COLUMNS, "event_date", "batch_id")


def compact_days(spark: SparkSession, table_path: str, days: list[date], through_batch: int) -> None:
    """Merges the folders of batches up to ``through_batch`` (all of them committed) into that one.

    A batch per second would else leave tens of thousands of folders a day. The merged rows are
    counted before any folder goes; later batches are not touched.
    """
    table = spark.read.parquet(table_path).where(
        F.col("event_date").isin(days) & (F.col("batch_id") <= through_batch))
    old = [(r["event_date"], r["batch_id"]) for r in table.select("event_date", "batch_id").distinct().collect()]
    expected = table.count()
    staging = shared_dir(spark, "compaction")
    table.withColumn("batch_id", F.lit(through_batch).cast("bigint")).hint("rebalance", "event_date").write.partitionBy(
        "event_date", "batch_id").parquet(staging)
    merged = spark.read.schema(table.schema).parquet(staging)
    if merged.count() != expected:
        raise RuntimeError("compaction could not be verified; nothing was changed")
    merged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(
        "event_date", "batch_id").parquet(table_path)
    drop_folders(spark, table_path, [{"event_date": d, "batch_id": b} for d, b in old if b != through_batch])


def export_days(rows: DataFrame, base: str, ts: str = "timestamp") -> None:
    """One folder per UTC day; days that are not exported now stay as they are.

    Rebalancing splits a busy day over as many writers as it needs.
    """
    (
        rows.withColumn("file_day", F.to_date(ts)).hint("rebalance", "file_day")
        .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("file_day").parquet(base)
    )


def verified_export(rows: DataFrame, base: str, failed_days: DataFrame | None = None, ts: str = "timestamp") -> DataFrame:
    """Exports by day, reads the copy back, and returns one ledger status per day."""
    spark = rows.sparkSession
    source = rows.groupBy(F.to_date(ts).alias("day")).agg(F.count(F.lit(1)).alias("n_rows"))
    export_days(rows, base, ts)
    copied = spark.read.parquet(base).select(F.col("file_day").cast("date").alias("day")).join(
        source.select("day"), "day", "left_semi").groupBy("day").agg(F.count(F.lit(1)).alias("n_rows"))
    none = source.where(F.lit(False)).select("day")
    return export_status(source, copied, failed_days if failed_days is not None else none)


def ledger_rows(status: DataFrame, node_id: str, table_name: str, created_at: datetime) -> DataFrame:
    """Export status in the ledger's schema."""
    return status.select(
        F.col("day").alias("backup_date"), F.lit(node_id).alias("node_id"), F.lit(table_name).alias("table_name"),
        "status", F.col("row_count").cast("bigint").alias("row_count"), "error_message",
        F.lit(str(created_at)).cast("timestamp").alias("created_at"),
    ).select(*BACKUP_LOG.fieldNames())


def append_ledger(entries: DataFrame, path: str, run_id: str) -> None:
    """Adds a run's rows to the ledger; the run that is retried replaces them.

    A failure to record is an error of the caller's job.
    """
    entries.write.mode("overwrite").parquet(f"{path}/run_id={run_id}")


def cleanup_synthetic(table_path: str, export_path: str, spark: SparkSession, run_id: str) -> tuple[int, int]:
    """Moves tagged rows out of a table laid out by ``event_date`` (and ``batch_id`` where it has one).

    Each run exports to a folder of its own, which must not exist yet. The copy is counted back
    first; only then are the touched folders written anew without the tagged rows (others stay as
    they are). Returns (exported, kept in touched folders).
    """
    table = spark.read.parquet(table_path)
    layout = [c for c in ("event_date", "batch_id") if c in table.columns]
    tagged = table.where(F.col("inject_id") != "")
    expected = tagged.count()
    own = f"{export_path}/run_id={run_id}"
    tagged.write.mode("errorifexists").parquet(own)
    exported = spark.read.schema(tagged.schema).parquet(own)
    if exported.count() != expected:
        raise RuntimeError("export could not be verified; nothing was removed")
    touched = exported.select(*layout).distinct()
    kept = table.join(touched, layout, "left_semi").where(F.coalesce("inject_id", F.lit("")) == "")
    staging = shared_dir(spark, "cleanup-kept")
    kept.hint("rebalance", *layout).write.partitionBy(*layout).parquet(staging)
    rewritten = spark.read.schema(table.schema).parquet(staging)
    n_kept = rewritten.count()
    rewritten.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*layout).parquet(table_path)
    # a touched folder of tagged rows only has no replacement: it goes
    emptied = touched.join(rewritten.select(*layout).distinct(), layout, "left_anti")
    drop_folders(spark, table_path, [r.asDict() for r in emptied.collect()])
    return expected, n_kept


def drop_folders(spark: SparkSession, table_path: str, folders: list[dict]) -> list[dict]:
    """Removes partition folders; returns those removed and fails if a planned one is not there."""
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(table_path)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    removed = []
    for folder in folders:
        path = jvm.org.apache.hadoop.fs.Path(root, "/".join(f"{k}={v}" for k, v in folder.items()))
        if not fs.delete(path, True):
            raise FileNotFoundError(f"{path} was to be removed and is not there; removed so far: {removed}")
        removed.append(folder)
    return removed


def drop_days(spark: SparkSession, table_path: str, days: list[date], column: str = "event_date") -> list[date]:
    """Removes whole day folders (one per calendar day); returns the days removed."""
    return [f[column] for f in drop_folders(spark, table_path, [{column: day} for day in days])]


def expire_days(spark: SparkSession, table_path: str, as_of: date, keep_days: int, column: str = "event_date") -> list[date]:
    """Drops day folders older than the retention; only partition values are read."""
    cutoff = F.date_sub(F.lit(as_of.isoformat()).cast("date"), keep_days)
    old = spark.read.parquet(table_path).where(F.col(column) < cutoff).select(column).distinct()
    return drop_days(spark, table_path, sorted(r[0] for r in old.collect()), column)


def expire_routes(spark: SparkSession, base: str, as_of: date, keep: dict[str, int] = RETENTION_DAYS) -> dict[str, list[date]]:
    """Applies each table's retention to the stored routes; returns the days removed by table."""
    present = {r["target"] for r in spark.read.parquet(f"{base}/routes").select("target").distinct().collect()}
    return {t: expire_days(spark, route_path(base, t), as_of, keep[t]) for t in sorted(present & keep.keys())}


def purge(entries: DataFrame, partitions: DataFrame, node_id: str, at: datetime) -> DataFrame:
    """Ledger rows for partitions removed unconditionally."""
    return partitions.select(
        F.lit(str(at.date())).cast("date").alias("backup_date"),
        F.lit(node_id).alias("node_id"), F.col("index_name").alias("table_name"), F.lit("success").alias("status"),
        F.lit(0).cast("bigint").alias("row_count"), F.lit("").alias("error_message"),
        F.lit(str(at)).cast("timestamp").alias("created_at"),
    ).unionByName(entries)


def read_monthly(spark: SparkSession, path: str) -> DataFrame:
    """Month folders with their names as text; as numbers the tenth month would lose its zero."""
    schema = T.StructType([f for f in spark.read.parquet(path).schema if f.name != "index_month"])
    return spark.read.schema(schema.add("index_month", "string")).parquet(path)


def purge_months(spark: SparkSession, path: str, before: str, node_id: str, at: datetime, ledger: str) -> list[str]:
    """Removes the month folders before ``before`` (``yyyy.MM``) and records each in the ledger."""
    months = read_monthly(spark, path).select("index_month").where(F.col("index_month") < before).distinct()
    gone = [f["index_month"] for f in drop_folders(spark, path, [{"index_month": r[0]} for r in months.collect()])]
    names = spark.createDataFrame([(f"threat-events-{m}",) for m in gone], "index_name string")
    append_ledger(purge(spark.createDataFrame([], BACKUP_LOG), names, node_id, at), ledger, f"purge-{at:%Y%m%dT%H%M%S}")
    return gone


def write_feature_csv(features: DataFrame, path: str) -> None:
    """Compressed CSV with header; an export without a data row is a failure, not a success."""
    if features.isEmpty():
        raise ValueError("feature export holds no data row")
    features.write.mode("overwrite").option("header", True).option("compression", "gzip").csv(path)


def write_json(report: DataFrame, path: str) -> None:
    """Nested report rows as JSON lines."""
    report.write.mode("overwrite").json(path)


def write_monthly(rows: DataFrame, path: str, ts: str = "timestamp") -> None:
    """One folder per month; months without rows here stay as they are."""
    rows.withColumn("index_month", F.date_format(ts, "yyyy.MM")).hint("rebalance", "index_month").write.mode(
        "overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("index_month").parquet(path)
