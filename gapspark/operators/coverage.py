"""Heartbeat completeness: the absence of a row is the signal.

Every operator first reduces heartbeats to one row per (node, minute) with its row count. That
aggregation combines map-side, so repeated or re-sent heartbeats cost nothing downstream, and a
node has at most ``slots`` such rows in its window whatever the volume of its input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gapspark.operators.ordered import join_on, next_in_time, spread
from gapspark.session import materialize

SLOTS_90_DAYS = 129_600  # one-minute slots in 90 days
_MINUTE = "INTERVAL 1 MINUTE"


def minute_counts(heartbeats: DataFrame) -> DataFrame:
    return heartbeats.groupBy("node_id", F.date_trunc("MINUTE", "timestamp").alias("minute")).agg(
        F.count(F.lit(1)).alias("n")
    )


def slot_windows(minutes: DataFrame, slots: int = SLOTS_90_DAYS) -> DataFrame:
    """One row per node: first and last minute slot of its observation window."""
    return minutes.groupBy("node_id").agg(F.min("minute").alias("slot_first")).withColumn(
        "slot_last", F.col("slot_first") + F.make_dt_interval(mins=F.lit(slots - 1))
    )


def expected_slots(windows: DataFrame) -> DataFrame:
    """The calendar: one row per (node, minute), exploded day by day to spread a long window."""
    day_first = F.explode(F.sequence("slot_first", "slot_last", F.expr("INTERVAL 1 DAY")))
    days = spread(windows.select("node_id", "slot_last", day_first.alias("_from")), "node_id", "_from")
    day_last = F.least("slot_last", F.col("_from") + F.expr("INTERVAL 1439 MINUTES"))
    return days.select(
        "node_id", F.explode(F.sequence("_from", day_last, F.expr(_MINUTE))).alias("minute")
    )


def missing_slots(heartbeats: DataFrame, slots: int = SLOTS_90_DAYS) -> DataFrame:
    """Expected slots minus observed slots."""
    minutes = minute_counts(heartbeats)
    return expected_slots(slot_windows(minutes, slots)).join(
        minutes.select("node_id", "minute"), ["node_id", "minute"], "left_anti"
    )


def islands(missing: DataFrame) -> DataFrame:
    """Gaps-and-islands over missing minutes: one row per run of consecutive minutes.

    Runs are found inside each (node, day) first, then runs that touch across midnight are
    joined. Only the day-border runs, at most two per day, meet in the second step.
    """
    spread = missing.withColumn("_day", F.date_trunc("DAY", "minute"))
    seq = F.row_number().over(Window.partitionBy("node_id", "_day").orderBy("minute"))
    local = (
        spread.withColumn("_run", F.col("minute") - F.make_dt_interval(mins=seq))
        .groupBy("node_id", "_day", "_run")
        .agg(F.min("minute").alias("gap_start"), F.max("minute").alias("gap_end"))
    )
    starts_at_border = F.col("gap_start") == F.col("_day")
    ends_at_border = F.col("gap_end") == F.col("_day") + F.expr("INTERVAL 1439 MINUTES")
    border = local.where(starts_at_border | ends_at_border)
    inner = local.where(~(starts_at_border | ends_at_border)).select("node_id", "gap_start", "gap_end")
    w = Window.partitionBy("node_id").orderBy("gap_start")
    begins = F.coalesce(
        F.col("gap_start") != F.lag("gap_end").over(w) + F.expr(_MINUTE), F.lit(True)
    )
    joined = (
        border.withColumn("_begins", begins.cast("int"))
        .withColumn("_chain", F.sum("_begins").over(w))
        .groupBy("node_id", "_chain")
        .agg(F.min("gap_start").alias("gap_start"), F.max("gap_end").alias("gap_end"))
        .drop("_chain")
    )
    return inner.unionByName(joined).withColumn("gap_minutes", _span_minutes("gap_start", "gap_end"))


def gap_intervals(
    heartbeats: DataFrame | None, slots: int = SLOTS_90_DAYS, minutes: DataFrame | None = None,
) -> DataFrame:
    """The same gap intervals read from the observed minutes alone, without a calendar.

    Between two consecutive observed minutes everything is missing, as is everything after the
    last observed minute of the window. ``minutes``: the minute counts, where they are known.
    """
    if minutes is None:
        minutes = materialize(minute_counts(heartbeats), "minutes")
    observed = join_on(minutes, slot_windows(minutes, slots), ["node_id"]).where(
        F.col("minute") <= F.col("slot_last")
    ).select("node_id", "minute", "slot_last")
    stepped = next_in_time(observed, ["node_id"], "minute", "next_minute")
    end = F.coalesce(F.col("next_minute") - F.expr(_MINUTE), F.col("slot_last"))
    return (
        stepped.select("node_id", (F.col("minute") + F.expr(_MINUTE)).alias("gap_start"), end.alias("gap_end"))
        .where(F.col("gap_end") >= F.col("gap_start"))
        .withColumn("gap_minutes", _span_minutes("gap_start", "gap_end"))
    )


def _span_minutes(first: str, last: str):
    return F.timestamp_diff("MINUTE", F.col(first), F.col(last)) + 1


def heartbeat_coverage(heartbeats: DataFrame, slots: int = SLOTS_90_DAYS) -> DataFrame:
    """Per node: rows and missing slots in the window, coverage, rows after it, duplicates, gaps.

    covered + missing = slots by construction; rows after the window are counted, not dropped.
    """
    minutes = materialize(minute_counts(heartbeats), "minutes")  # at most one row per node and slot
    windows = slot_windows(minutes, slots)
    inside = F.col("minute") <= F.col("slot_last")
    counted = join_on(minutes, windows, ["node_id"]).groupBy("node_id").agg(
        F.min("slot_first").alias("slot_first"), F.min("slot_last").alias("slot_last"),
        F.coalesce(F.sum(F.when(inside, F.col("n"))), F.lit(0)).alias("rows_in_window"),
        F.count_if(inside).alias("covered_slots"),
        F.coalesce(F.sum(F.when(~inside, F.col("n"))), F.lit(0)).alias("rows_after"),
        F.coalesce(F.sum(F.when(inside, F.col("n") - 1)), F.lit(0)).alias("duplicate_extra_rows"),
    )
    gaps = gap_intervals(None, slots, minutes).groupBy("node_id").agg(
        F.count(F.lit(1)).alias("n_gaps"), F.max("gap_minutes").alias("longest_gap_minutes")
    )
    total = F.lit(slots)
    return join_on(counted, gaps, ["node_id"], "left").select(
        "node_id", "slot_first", "slot_last", "rows_in_window", "covered_slots",
        (total - F.col("covered_slots")).alias("missing_slots"),
        (100 * F.col("covered_slots") / total).alias("coverage_percent"),
        (100 * F.col("rows_in_window") / total).alias("row_ratio_percent"),
        "rows_after", "duplicate_extra_rows",
        F.coalesce("n_gaps", F.lit(0)).alias("n_gaps"),
        F.coalesce("longest_gap_minutes", F.lit(0)).alias("longest_gap_minutes"),
    )
