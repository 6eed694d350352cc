"""Sent-versus-recorded reconciliation."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gapspark.functions.labels import end_to_end_verdict, loss_status
from gapspark.functions.parsing import host_of
from gapspark.operators.filters import bound

SLACK_MINUTES = 10


def sent_ids(send_log: DataFrame) -> DataFrame:
    """Distinct (host, inject_id) that left the sender; a log without the flag keeps all rows.

    Two targets on one host are one system. Re-sent ids collapse map-side before the shuffle.
    """
    if "sent_ok" in send_log.columns:
        send_log = send_log.where(F.coalesce("sent_ok", F.lit("1")) == "1")
    return send_log.select(host_of(F.col("target")).alias("host"), "inject_id").distinct()


def sent_ranges(send_log: DataFrame) -> DataFrame:
    """Per target: distinct ids and first/last send time of the rows that were sent."""
    if "sent_ok" in send_log.columns:
        send_log = send_log.where(F.coalesce("sent_ok", F.lit("1")) == "1")
    return send_log.groupBy("target").agg(
        F.count_distinct("inject_id").alias("n_ids"),
        F.min("timestamp").alias("ts_min"), F.max("timestamp").alias("ts_max"),
    )


def recorded_ids(stored: DataFrame, ts_min, ts_max, slack_minutes: int = SLACK_MINUTES) -> DataFrame:
    """Distinct non-empty ids stored in the send range plus delivery slack.

    Bounds are constants (whole seconds), so the time filter prunes row groups; a re-sent id
    collapses map-side before the shuffle.
    """
    rows = stored.where(F.col("inject_id") != "")
    if ts_min is not None:
        rows = rows.where(F.col("timestamp") >= bound(stored, "timestamp", ts_min.replace(microsecond=0)))
    if ts_max is not None:
        end = (ts_max + timedelta(minutes=slack_minutes)).replace(microsecond=0)
        rows = rows.where(F.col("timestamp") <= bound(stored, "timestamp", end))
    return rows.select("inject_id").distinct()


def matched(sent: DataFrame, recorded: DataFrame) -> DataFrame:
    """Sent ids with a ``found`` flag."""
    seen = recorded.select("inject_id").distinct().withColumn("found", F.lit(True))
    return sent.join(seen, "inject_id", "left").withColumn("found", F.coalesce("found", F.lit(False)))


def lost_ids(sent: DataFrame, recorded: DataFrame) -> DataFrame:
    return sent.join(recorded, "inject_id", "left_anti")


def found_ids(sent: DataFrame, recorded: DataFrame) -> DataFrame:
    return sent.join(recorded, "inject_id", "left_semi")


def common_ids(left: DataFrame, right: DataFrame) -> DataFrame:
    return left.select("inject_id").intersect(right.select("inject_id"))


def loss_report(sent: DataFrame, recorded: DataFrame, systems: DataFrame) -> DataFrame:
    """Loss per system: total, recorded, lost, percent, and its status.

    ``systems``: (system, host, verification_failed), one row per system. A failed lookup is
    carried as UNVERIFIED; its zero is not a measured zero. found + lost = sent.
    """
    counts = matched(sent, recorded).groupBy("host").agg(
        F.count(F.lit(1)).alias("total_injected"), F.count_if("found").alias("total_recorded")
    )
    lost = F.col("total_injected") - F.col("total_recorded")
    rate = F.when(F.col("total_injected") > 0, 100 * lost / F.col("total_injected")).otherwise(0.0)
    return systems.join(counts, "host").select(
        "system", "total_injected", "total_recorded", lost.alias("total_lost"),
        F.round(rate, 4).alias("loss_rate_percent"), "verification_failed",
        loss_status(F.round(rate, 4), F.col("verification_failed")).alias("status"),
    )


def end_to_end(report: DataFrame, primary: str = "proposed", other: str = "baseline") -> DataFrame:
    """One-row verdict over a loss report; an unmeasured side can never pass."""
    value = lambda s: F.max(F.when(
        (F.col("system") == s) & ~F.col("verification_failed"), F.col("loss_rate_percent")))
    return report.agg(value(primary).alias("primary_loss"), value(other).alias("other_loss")).withColumn(
        "verdict", end_to_end_verdict(F.col("primary_loss"), F.col("other_loss"))
    )


def late_rows(raw: DataFrame, emitted: DataFrame, keys: list[str]) -> DataFrame:
    """Rows that reached the raw store but no emitted result: counted, never dropped."""
    return raw.join(emitted.select(*keys).distinct(), keys, "left_anti")
