"""Windowed features, calendars, sequences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gapspark.operators.ordered import halo_blocks, next_in_time, positions
from gapspark.schemas import FEATURE_COLUMNS, FEATURE_TYPES

WINDOW_SECONDS = 300
SEQUENCE_LENGTH = 12


def _slot(ts: str, seconds: int) -> Column:
    micros = F.unix_micros(F.col(ts).cast("timestamp"))
    return F.timestamp_seconds(F.floor(micros / F.lit(seconds * 1_000_000)) * seconds)


def feature_windows(events: DataFrame, seconds: int = WINDOW_SECONDS) -> DataFrame:
    """Ten features per window, counting rows; windows without events stay absent.

    The exact distinct count is taken by first reducing to one row per (window, sensor) with all
    partial sums. Both steps combine map-side and a busy window or sensor collapses early.
    """
    per_sensor = events.groupBy(_slot("timestamp", seconds).alias("window_start"), "sensor_id").agg(
        F.count(F.lit(1)).alias("event_count"), F.sum("severity").alias("_severity"),
        F.count("severity").alias("_n_severity"), F.max("severity").alias("max_severity"),
        *[F.count_if(F.col("event_type") == t).alias(f"{t}_count") for t in FEATURE_TYPES],
    )
    return per_sensor.groupBy("window_start").agg(
        F.sum("event_count").alias("event_count"), F.count("sensor_id").alias("unique_sensors"),
        (F.sum("_severity") / F.sum("_n_severity")).alias("avg_severity"),
        F.max("max_severity").alias("max_severity"),
        *[F.sum(f"{t}_count").alias(f"{t}_count") for t in FEATURE_TYPES],
    )


def document_windows(documents: DataFrame, exact: bool = False) -> DataFrame:
    """One-minute features over document events; approximate distinct unless ``exact``.

    Here a sensor is the ``type`` field, and ssh is the Cowrie type or port 22.
    """
    distinct = F.count_distinct("type") if exact else F.approx_count_distinct("type", 0.01)
    plain = [t for t in FEATURE_TYPES if t != "ssh"]
    ssh = (F.col("type") == "Cowrie") | (F.col("dest_port") == 22)
    return documents.groupBy(_slot("timestamp", 60).alias("window_start")).agg(
        F.count(F.lit(1)).alias("event_count"), distinct.alias("unique_sensors"),
        F.coalesce(F.round(F.avg("alert_severity"), 4), F.lit(0.0)).alias("avg_severity"),
        F.coalesce(F.max("alert_severity").cast("double"), F.lit(0.0)).alias("max_severity"),
        *[F.count_if(F.col("event_type") == t).alias(f"{t}_count") for t in plain],
        F.count_if(ssh).alias("ssh_count"),
    )


def hourly_features(clean: DataFrame, types: tuple[str, ...] = FEATURE_TYPES) -> DataFrame:
    """Hourly sums of the count column, distinct sensors and sums per type."""
    per_sensor = clean.groupBy(F.date_trunc("HOUR", "timestamp").alias("hour"), "sensor_id").agg(
        F.sum("count").alias("event_count"),
        *[F.sum(F.when(F.col("event_type") == t, F.col("count"))).alias(f"{t}_count") for t in types],
    )
    return per_sensor.groupBy("hour").agg(
        F.sum("event_count").alias("event_count"), F.count("sensor_id").alias("unique_sensors"),
        *[F.coalesce(F.sum(f"{t}_count"), F.lit(0)).alias(f"{t}_count") for t in types],
    )


def on_hour_calendar(hourly: DataFrame, first_day: str, last_day: str) -> DataFrame:
    """Zero-filled form on the hour calendar; ``is_filled`` marks hours without any row."""
    spark = hourly.sparkSession
    calendar = spark.range(1).select(F.explode(F.sequence(
        F.lit(f"{first_day} 00:00:00").cast("timestamp"), F.lit(f"{last_day} 23:00:00").cast("timestamp"),
        F.expr("INTERVAL 1 HOUR"))).alias("hour"))
    values = [c for c in hourly.columns if c != "hour"]
    marked = hourly.withColumn("_seen", F.lit(True))
    return calendar.join(marked, "hour", "left").select(
        "hour", *[F.coalesce(c, F.lit(0)).alias(c) for c in values],
        F.col("_seen").isNull().alias("is_filled"),
    )


def missing_windows(windows: DataFrame, seconds: int = WINDOW_SECONDS, ts: str = "window_start") -> DataFrame:
    """How many windows lie empty between consecutive non-empty ones (one row)."""
    step = next_in_time(windows.select(ts).distinct(), [], ts, "following")
    gap = F.timestamp_diff("SECOND", F.col(ts), F.col("following"))
    empty = F.greatest(F.floor(gap / F.lit(seconds)) - 1, F.lit(0))
    return step.agg(
        F.coalesce(F.sum(empty), F.lit(0)).alias("missing_windows"),
        F.count_if(empty > 0).alias("n_gaps"),
        F.count(F.lit(1)).alias("n_windows"),
    )


def vectors(windows: DataFrame, columns: tuple[str, ...] = FEATURE_COLUMNS, ts: str = "window_start") -> DataFrame:
    """One row per window: position along time and its feature vector."""
    packed = windows.select(ts, F.array(*[F.col(c).cast("double") for c in columns]).alias("features"))
    return positions(packed, [], ts, "idx")


def sliding_sequences(
    series: DataFrame, seq_len: int = SEQUENCE_LENGTH, keys: list[str] | None = None,
    features: str = "features", idx: str = "idx",
) -> DataFrame:
    """X = the ``seq_len`` rows before a row, y = the row. Too short a series is an error.

    Frames are evaluated in blocks with overlap, so a series of any length is processed in
    parallel. ``seq_index`` numbers the sequences from 0.
    """
    keys = keys or []
    spread, w = halo_blocks(series, keys, idx, before=seq_len, after=0)
    frame = w.rowsBetween(-seq_len, -1)
    built = spread.withColumn("x", F.collect_list(features).over(frame)).where(
        F.col("_own") & (F.col(idx) >= seq_len)
    )
    return built.select(
        *keys, (F.col(idx) - seq_len).alias("seq_index"), "x", F.col(features).alias("y"),
        *[c for c in series.columns if c not in (*keys, features, idx)],
    )


def require_sequences(n_rows: int, seq_len: int = SEQUENCE_LENGTH) -> None:
    if n_rows <= seq_len:
        raise ValueError(f"Not enough data: {n_rows} windows, need > {seq_len}")


def fixed_blocks(sequences: DataFrame, n_sequences: Column, size: int = 10) -> DataFrame:
    """Adds the block number; the incomplete tail block is dropped as in the definition."""
    return sequences.withColumn("block", F.floor(F.col("seq_index") / F.lit(size))).where(
        (F.col("block") + 1) * size <= n_sequences
    )


def chronological_split(sequences: DataFrame, n_sequences: Column, ratio: float = 0.8) -> DataFrame:
    return sequences.withColumn(
        "part", F.when(F.col("seq_index") < F.floor(n_sequences * F.lit(ratio)), "train").otherwise("test")
    )


def normalisation(training: DataFrame, columns: tuple[str, ...] = FEATURE_COLUMNS) -> DataFrame:
    """One row: mean and population standard deviation per column; a zero deviation becomes 1."""
    aggs = []
    for c in columns:
        sd = F.stddev_pop(c)
        aggs += [F.avg(c).alias(f"{c}_mean"), F.when(sd == 0, F.lit(1.0)).otherwise(sd).alias(f"{c}_std")]
    return training.agg(*aggs)


def normalise(windows: DataFrame, stats: DataFrame, columns: tuple[str, ...] = FEATURE_COLUMNS) -> DataFrame:
    """Z-scores with the statistics of the training rows (a one-row table)."""
    joined = windows.crossJoin(F.broadcast(stats))
    other = [c for c in windows.columns if c not in columns]
    return joined.select(
        *other, *[((F.col(c) - F.col(f"{c}_mean")) / F.col(f"{c}_std")).alias(c) for c in columns]
    )
