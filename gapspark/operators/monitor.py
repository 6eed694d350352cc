"""Operational reports over the event table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gapspark.operators.filters import clean_events, in_range, resolve_as_of, since


def recent_events(events: DataFrame, hours: float = 24, limit: int = 20, as_of=None) -> DataFrame:
    """Newest events first. Ties break on the remaining columns, so the report is stable."""
    return (
        events.where(since(events, resolve_as_of(events, as_of), hours))
        .select("timestamp", "sensor_id", "event_type", "severity", "count")
        .orderBy(F.desc("timestamp"), "sensor_id", "event_type", "severity", "count")
        .limit(limit)
    )


def event_type_summary(events: DataFrame, hours: float = 24, as_of=None) -> DataFrame:
    """Rows (not summed counts) and worst severity per event type."""
    return (
        events.where(since(events, resolve_as_of(events, as_of), hours))
        .groupBy("event_type")
        .agg(F.count(F.lit(1)).alias("total"), F.max("severity").alias("max_severity"))
        .orderBy(F.desc("total"), "event_type")
    )


def top_sensors(events: DataFrame, hours: float = 24, limit: int = 10, as_of=None) -> DataFrame:
    """Sensors by summed count column."""
    return (
        events.where(since(events, resolve_as_of(events, as_of), hours))
        .groupBy("sensor_id").agg(F.sum("count").alias("total"))
        .orderBy(F.desc("total"), "sensor_id").limit(limit)
    )


def health_checks(events: DataFrame, as_of=None) -> DataFrame:
    """Three checks, one row each with OK/NG. Only the last hour is read besides the newest time."""
    now = resolve_as_of(events, as_of)
    newest = events.agg(F.max("timestamp").cast("string").alias("latest"))
    one = events.where(since(events, now, 1)).agg(
        F.count_if(since(events, now, 5 / 60)).alias("rows_5m"), F.count_distinct("sensor_id").alias("sensors_1h"),
    ).crossJoin(F.broadcast(newest))  # one row each
    return one.select(F.inline(F.array(
        F.struct(F.lit("rows_last_5_minutes").alias("check"),
                 F.col("rows_5m").cast("string").alias("value"),
                 F.when(F.col("rows_5m") > 0, "OK").otherwise("NG").alias("status")),
        F.struct(F.lit("sensors_last_hour").alias("check"),
                 F.col("sensors_1h").cast("string").alias("value"),
                 F.when(F.col("sensors_1h") > 0, "OK").otherwise("NG").alias("status")),
        F.struct(F.lit("latest_event").alias("check"),
                 F.coalesce("latest", F.lit("N/A")).alias("value"),
                 F.when(F.col("latest").isNotNull(), "OK").otherwise("NG").alias("status")),
    )))


def clean_daily_counts(
    events: DataFrame, start, end, excluded_days=None, known_ids=None,
) -> DataFrame:
    """Summed counts per UTC day after the exclusions. Absent days stay absent."""
    clean = clean_events(events, known_ids) if known_ids else clean_events(events)
    return (
        clean.where(in_range(clean, "timestamp", start, end, excluded_days))
        .groupBy(F.to_date("timestamp").alias("day"))
        .agg(F.sum("count").alias("total_count"))
        .orderBy("day")
    )


def health_snapshot(events: DataFrame, side_table: DataFrame, as_of=None) -> DataFrame:
    """One hourly ledger row: event rows, exact distinct sensors, size of the side table.

    Bytes are the estimated plan size of the side table's rows: text lengths plus fixed widths.
    """
    now = resolve_as_of(events, as_of)
    main = (
        events.where(since(events, now, 1))
        .agg(
            F.lit(str(now)).cast("timestamp").alias("checked_at"),
            F.count(F.lit(1)).alias("events_last_hour"),
            F.count_distinct("sensor_id").alias("unique_sensors"),
        )
    )
    side = side_table.agg(
        F.count(F.lit(1)).alias("experiment_table_rows"),
        F.coalesce(F.sum(
            F.octet_length("sensor_id") + F.octet_length("event_type")
            + F.octet_length("inject_id") + F.lit(18)
        ), F.lit(0)).alias("experiment_table_bytes"),
    )
    return main.crossJoin(F.broadcast(side))


def health_history(events: DataFrame) -> DataFrame:
    """The hourly snapshot series over the whole history (hours without rows stay absent)."""
    return events.groupBy(F.date_trunc("HOUR", "timestamp").alias("checked_at")).agg(
        F.count(F.lit(1)).alias("events_last_hour"),
        F.count_distinct("sensor_id").alias("unique_sensors"),
    )


def rows_per_day(events: DataFrame, ts: str = "timestamp") -> DataFrame:
    return events.groupBy(F.to_date(ts).alias("day")).agg(F.count(F.lit(1)).alias("n_rows"))
