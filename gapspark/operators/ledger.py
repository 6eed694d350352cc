"""Backup ledger: gaps between records, latest status, catch-up and prune decisions."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gapspark.operators.filters import resolve_as_of
from gapspark.operators.ordered import next_in_time

BACKED_UP_TABLES = ("threat_events", "pipeline_health", "heartbeats")


def record_gaps(
    records: DataFrame, keys: list[str], ts: str, over_minutes: int,
) -> DataFrame:
    """Pairs of consecutive records more than ``over_minutes`` minute boundaries apart.

    Records of one minute are no minute apart, so they first reduce to their first and last time
    (map-side, at most one row per key and minute). The following minute is looked up day by
    day, so neither one busy key nor a keyless ledger lands in one task. The last record of a
    key has no successor and yields no row.
    """
    if over_minutes < 0:
        raise ValueError("over_minutes must not be negative")
    at = F.col(ts).cast("timestamp")
    minutes_seen = records.where(at.isNotNull()).groupBy(*keys, F.date_trunc("MINUTE", at).alias("_minute")).agg(
        F.min(at).alias("_first"), F.max(at).alias("gap_start"))
    minutes = F.timestamp_diff(
        "MINUTE", F.date_trunc("MINUTE", "gap_start"), F.date_trunc("MINUTE", "gap_end")
    )
    return (
        next_in_time(minutes_seen, keys, "_first", "gap_end")
        .withColumn("gap_minutes", minutes)
        .where(F.col("gap_minutes") > over_minutes)
        .select(*keys, "gap_start", "gap_end", "gap_minutes")
    )


def backup_log_gaps(backup_log: DataFrame) -> DataFrame:
    return record_gaps(
        backup_log.where("table_name = 'results_sync'"), ["node_id"], "created_at", 480
    )


def health_gaps(pipeline_health: DataFrame) -> DataFrame:
    return record_gaps(pipeline_health, [], "checked_at", 120)


def latest_status(backup_log: DataFrame) -> DataFrame:
    """Newest ledger entry per (table, day); ties break on status and rows."""
    order = F.struct("created_at", "status", "row_count")
    newest = F.max_by(F.struct("status", "row_count", "created_at"), order)
    return backup_log.groupBy("table_name", "backup_date").agg(newest.alias("l")).select(
        "table_name", "backup_date", "l.status", "l.row_count", "l.created_at"
    )


def catch_up_days(
    backup_log: DataFrame, as_of=None, first_back: int = 2, last_back: int = 14,
    per_table: int = 7, tables: tuple[str, ...] = BACKED_UP_TABLES,
) -> DataFrame:
    """Days to back up again: expected days whose latest status is not success.

    At most ``per_table`` days per run and table, most recent first; ``remaining`` counts the
    days left for later runs, so the cap hides nothing.
    """
    today = resolve_as_of(backup_log, as_of, "backup_date").date()
    expected = backup_log.sparkSession.range(first_back, last_back + 1).select(
        F.date_sub(F.lit(str(today)).cast("date"), F.col("id").cast("int")).alias("backup_date"),
        F.explode(F.array(*[F.lit(t) for t in tables])).alias("table_name"),
    )
    recent = backup_log.where(
        (F.col("backup_date") >= F.lit(str(today - timedelta(days=last_back))).cast("date"))
        & F.col("table_name").isin(*tables)
    )
    good = latest_status(recent).where("status = 'success'").select("table_name", "backup_date")
    newest_first = Window.partitionBy("table_name").orderBy(F.desc("backup_date"))
    return (
        expected.join(good, ["table_name", "backup_date"], "left_anti")
        .withColumn("attempt", F.row_number().over(newest_first))
        .withColumn("remaining", F.count(F.lit(1)).over(Window.partitionBy("table_name")) - per_table)
        .where(F.col("attempt") <= per_table)
        .withColumn("remaining", F.greatest("remaining", F.lit(0)))
    )


def not_yet_pruned(backup_log: DataFrame, as_of=None, keep_days: int = 7) -> DataFrame:
    """Verified days old enough to prune and without a prune record, with their latest rows."""
    today = resolve_as_of(backup_log, as_of, "backup_date").date()
    cutoff = F.lit(str(today - timedelta(days=keep_days))).cast("date")
    ok = backup_log.where("table_name = 'threat_events' AND status = 'success'").where(
        F.col("backup_date") <= cutoff
    )
    pruned = backup_log.where(
        "table_name = 'threat_events_local_prune' AND status = 'success'"
    ).select("backup_date").distinct()
    backed = ok.groupBy("backup_date").agg(
        F.max_by("row_count", F.struct("created_at", "row_count")).alias("backed_rows")
    )
    return backed.join(pruned, "backup_date", "left_anti")


def prune_decisions(
    backup_log: DataFrame, stored_rows: DataFrame, as_of=None, keep_days: int = 7,
    reexported: DataFrame | None = None,
) -> DataFrame:
    """Decision per candidate day: delete, re-export first, keep, skip, or unverified.

    ``stored_rows``: (day, n_rows) now in the store; a NULL count means that the day could not be
    counted, which is never taken for a measured zero. ``reexported``: (day, backed_rows) after a
    second export; a day that still holds more rows than its backup is kept.
    """
    candidates = not_yet_pruned(backup_log, as_of, keep_days)
    stored = stored_rows.select(
        F.col("day").alias("backup_date"), F.col("n_rows").alias("stored_rows"), F.lit(True).alias("_listed"))
    joined = candidates.join(stored, "backup_date", "left")
    uncounted = F.col("_listed") & F.col("stored_rows").isNull()
    rows = F.when(~F.coalesce(uncounted, F.lit(False)), F.coalesce("stored_rows", F.lit(0)))
    backed = F.coalesce("backed_rows", F.lit(0))
    decision = F.when(rows.isNull(), "unverified").when(rows == 0, "skip").when(rows <= backed, "delete")
    if reexported is None:
        decision = decision.otherwise("re_export")
    else:
        again = reexported.select(F.col("day").alias("backup_date"), F.col("backed_rows").alias("_again"))
        joined = joined.join(again, "backup_date", "left")
        decision = decision.when(rows <= F.col("_again"), "delete").otherwise("keep")
    return joined.select(
        "backup_date", rows.alias("stored_rows"), backed.alias("backed_rows"),
        decision.alias("decision"),
    )
