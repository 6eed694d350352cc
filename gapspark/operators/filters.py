"""Event filters: the fixed exclusions, time ranges, recency."""

from __future__ import annotations

from datetime import date, datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gapspark.schemas import KNOWN_SENSOR_IDS, UNRESOLVED_SENSOR_IDS


def clean_events(
    events: DataFrame, known_ids: tuple[str, ...] = KNOWN_SENSOR_IDS,
) -> DataFrame:
    """Drops synthetic traffic, the platform's own nodes and unresolved sources."""
    return events.where(
        (F.col("inject_id") == "") & ~F.col("sensor_id").isin(*known_ids, *UNRESOLVED_SENSOR_IDS)
    )


def exclude_known_nodes(events: DataFrame, known_nodes: DataFrame) -> DataFrame:
    """Anti join against the node dimension; Spark broadcasts it only when its size allows."""
    ips = known_nodes.where(F.col("ip").isNotNull() & (F.col("ip") != "")).select("ip").distinct()
    return events.join(ips, F.col("sensor_id") == F.col("ip"), "left_anti")


def known_node_ids(known_nodes: DataFrame) -> DataFrame:
    """Registered node addresses, or the built-in set when none is registered."""
    usable = known_nodes.where(F.coalesce(F.col("ip"), F.lit("")) != "").select("ip").distinct()
    registered = usable.agg(F.count(F.lit(1)).alias("_n"))
    built_in = registered.where("_n = 0").select(
        F.explode(F.array(*[F.lit(ip) for ip in KNOWN_SENSOR_IDS])).alias("ip")
    )
    return usable.unionByName(built_in)


def bound(df: DataFrame, ts: str, value: datetime | date | str) -> Column:
    """A literal of the column's own type, so comparisons with it reach the Parquet scan."""
    return F.lit(str(value)).cast(df.schema[ts].dataType)


def in_range(
    df: DataFrame, ts: str, start: datetime | str, end: datetime | str,
    excluded_days: tuple[date | str, date | str] | None = None,
) -> Column:
    """Half-open time range, minus an optional half-open range of whole days."""
    col = F.col(ts)
    cond = (col >= bound(df, ts, start)) & (col < bound(df, ts, end))
    if excluded_days:
        lo, hi = (bound(df, ts, d) for d in excluded_days)
        cond = cond & ((col < lo) | (col >= hi))
    return cond


def latest(df: DataFrame, ts: str = "timestamp") -> datetime:
    """The newest time in the data: one reported scalar, the reproducible stand-in for a clock."""
    value = df.agg(F.max(ts).cast("timestamp").cast("string")).first()[0]
    if value is None:
        raise ValueError("no rows, so there is no latest time; pass as_of explicitly")
    return datetime.fromisoformat(value)


def day_range(df: DataFrame, ts: str = "timestamp") -> tuple[date, date]:
    """The first day of the data and the day after its last one."""
    first, last = df.agg(F.to_date(F.min(ts)), F.to_date(F.max(ts))).first()
    if first is None:
        raise ValueError("no rows, so there is no range of days")
    return first, last + timedelta(days=1)


def resolve_as_of(df: DataFrame, as_of: datetime | str | None, ts: str = "timestamp") -> datetime:
    """Operators take ``as_of`` instead of reading a clock; None means the newest event."""
    if as_of is None:
        return latest(df, ts)
    return as_of if isinstance(as_of, datetime) else datetime.fromisoformat(str(as_of))


def since(df: DataFrame, as_of: datetime, hours: float, ts: str = "timestamp") -> Column:
    """``ts >= as_of - hours`` with a constant bound, which prunes row groups at the scan."""
    return F.col(ts) >= bound(df, ts, as_of - timedelta(hours=hours))
