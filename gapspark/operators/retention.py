"""Retention, routing, export status, clean-up splits. Deletion is always planned as rows first."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gapspark.operators.filters import bound, resolve_as_of

# Retention in days per table.
RETENTION_DAYS = {
    "threat_events": 180, "threat_events_experiment": 3, "heartbeats": 180,
    "pipeline_health": 180, "backup_log": 180,
}


def survivors(df: DataFrame, ts: str, days: int, as_of=None) -> DataFrame:
    """Rows a retention run keeps: ``ts >= as_of - days``."""
    now = resolve_as_of(df, as_of, ts)
    return df.where(F.col(ts) >= bound(df, ts, now - timedelta(days=days)))


def route(inject_id: Column) -> Column:
    """Target table of a row: tagged traffic never reaches the main table."""
    return F.when(inject_id != "", "threat_events_experiment").otherwise("threat_events")


def month_index(ts: Column) -> Column:
    return F.concat(F.lit("threat-events-"), F.date_format(ts, "yyyy.MM"))


def older_than(partitions: DataFrame, date_col: str, days: int, as_of=None) -> DataFrame:
    """Time-named partitions strictly before the cutoff day."""
    now = resolve_as_of(partitions, as_of, date_col)
    return partitions.where(F.col(date_col) < bound(partitions, date_col, now.date() - timedelta(days=days)))


def export_status(
    source_counts: DataFrame, exported_counts: DataFrame, failed_days: DataFrame,
) -> DataFrame:
    """Ledger status per day of an export.

    ``source_counts``/``exported_counts``: (day, n_rows); ``failed_days``: days whose source
    count could not be read. A failed count is never booked as a successful zero.
    """
    s = source_counts.select("day", F.col("n_rows").alias("source_rows"))
    e = exported_counts.select("day", F.col("n_rows").alias("exported_rows"))
    f = failed_days.select("day").distinct().withColumn("count_failed", F.lit(True))
    joined = s.join(e, "day", "full_outer").join(f, "day", "full_outer")
    src = F.coalesce("source_rows", F.lit(0))
    exp = F.coalesce("exported_rows", F.lit(0))
    status = (
        F.when(F.col("count_failed"), "export_failed")
        .when(src == exp, "success")
        .when(F.col("exported_rows").isNull(), "export_failed")
        .otherwise("upload_failed")
    )
    return joined.select(
        "day", status.alias("status"),
        F.when(status == "success", src).otherwise(F.lit(0)).alias("row_count"),
        F.when(F.col("count_failed"), "source count failed")
        .when(src == exp, "").when(F.col("exported_rows").isNull(), "export missing")
        .otherwise("row count mismatch").alias("error_message"),
    )


def drop_until_under(
    inventory: DataFrame, limit_bytes: Column, min_keep_days: int, as_of=None,
) -> DataFrame:
    """Oldest-first partitions to drop until the total is at or below ``limit_bytes``.

    ``inventory``: (part_date, bytes). Whole dates are dropped in order; a date inside the
    minimum retention stops the run, as does reaching the limit. Only the per-date totals are
    ordered, one row per calendar day.
    """
    days = inventory.groupBy("part_date").agg(F.sum("bytes").alias("bytes"))
    total = days.agg(F.sum("bytes").alias("_total"))
    before = Window.orderBy("part_date").rowsBetween(Window.unboundedPreceding, -1)
    oldest_kept = resolve_as_of(inventory, as_of, "part_date").date() - timedelta(days=min_keep_days)
    return (
        days.withColumn("_freed", F.coalesce(F.sum("bytes").over(before), F.lit(0)))
        .crossJoin(F.broadcast(total))
        .where(
            (F.col("_total") - F.col("_freed") > limit_bytes)
            & (F.col("part_date") < bound(days, "part_date", oldest_kept))
        )
        .select("part_date", "bytes", (F.col("_total") - F.col("_freed") - F.col("bytes")).alias("bytes_left"))
    )


def size_gaps(sizes: DataFrame, threshold_gb: int = 20) -> DataFrame:
    """Stores whose actual size exceeds the reported one by the alert threshold."""
    gap = F.col("actual_gb") - F.col("reported_gb")
    return sizes.select(
        "store", "reported_gb", "actual_gb", gap.alias("gap_gb"),
        F.coalesce(gap >= threshold_gb, F.lit(False)).alias("alert"),
        F.coalesce(gap.isNull(), F.lit(True)).alias("unmeasured"),
    )
