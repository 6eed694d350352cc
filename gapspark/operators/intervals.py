"""Range join of points to time windows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def points_in_windows(windows: DataFrame, points: DataFrame, lo: str, hi: str, ts: str) -> DataFrame:
    """Pairs with ``lo <= ts <= hi``, joined on an hour bucket as equality key.

    A window is listed once per hour it touches and a point lies in exactly one hour, so each
    pair appears once and the join is a hash or merge join.
    """
    hours = F.explode(F.sequence(
        F.date_trunc("HOUR", lo), F.date_trunc("HOUR", hi), F.expr("INTERVAL 1 HOUR")))
    w = windows.withColumn("_hour", hours)
    p = points.withColumn("_hour", F.date_trunc("HOUR", ts))
    return w.join(p, "_hour").where(F.col(ts).between(F.col(lo), F.col(hi))).drop("_hour")


def around(starts: DataFrame, start: str, hours_before: int = 1, hours_after: int = 4) -> DataFrame:
    return starts.withColumn("win_lo", F.col(start) - F.make_dt_interval(hours=F.lit(hours_before))).withColumn(
        "win_hi", F.col(start) + F.make_dt_interval(hours=F.lit(hours_after)))
