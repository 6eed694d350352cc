"""Scalar parsing rules: sizes, names, hosts, timestamps."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Factors of the binary size units, in MiB.
_MIB_PER_UNIT = {
    "B": 1.0 / 1024**2, "KiB": 1.0 / 1024, "MiB": 1.0, "GiB": 1024.0, "TiB": 1024.0**2,
}


def mem_mib(usage: Column) -> Column:
    """MiB on the used side of a text such as ``665.4MiB / 1GiB``; NULL when unreadable."""
    used = F.trim(F.split_part(usage, F.lit("/"), F.lit(1)))
    pattern = r"^([0-9.]+)\s*(B|KiB|MiB|GiB|TiB)$"
    amount = F.regexp_extract(used, pattern, 1).try_cast("double")
    unit = F.regexp_extract(used, pattern, 2)
    scale = F.lit(None).cast("double")
    for name, factor in _MIB_PER_UNIT.items():
        scale = F.when(unit == name, F.lit(factor)).otherwise(scale)
    return amount * scale


def run_name(name: Column) -> Column:
    """Struct (pattern, rps, trial) of ``spike_rps1000_trial3``; NULL if it is no trial name."""
    rx = r"^(.+)_rps(\d+)_trial(\d+)$"
    parsed = F.struct(
        F.regexp_extract(name, rx, 1).alias("pattern"),
        F.regexp_extract(name, rx, 2).try_cast("int").alias("rps"),
        F.regexp_extract(name, rx, 3).try_cast("int").alias("trial"),
    )
    return F.when(name.rlike(rx), parsed)


def host_of(url: Column) -> Column:
    """Lower-case host of a URL or of a bare ``host:port``."""
    host = F.coalesce(
        F.try_parse_url(url, F.lit("HOST")),
        F.try_parse_url(F.concat(F.lit("//"), url), F.lit("HOST")),
        F.split_part(url, F.lit(":"), F.lit(1)),
    )
    return F.lower(host)


def date_in_name(name: Column) -> Column:
    """Date of an eight-digit stamp between underscores; NULL when there is none."""
    return F.try_to_date(F.nullif(F.regexp_extract(name, r"_(\d{8})_", 1), F.lit("")), "yyyyMMdd")


def batch_start(name: Column, zone: str = "Europe/Berlin") -> Column:
    """UTC start of ``batch_YYYYMMDD_HHMMSS``, a local stamp (first of two in a repeated hour)."""
    rx = r"^batch_(\d{8})_(\d{6})"
    stamp = F.nullif(
        F.concat(F.regexp_extract(name, rx, 1), F.regexp_extract(name, rx, 2)), F.lit("")
    )
    return F.to_utc_timestamp(F.try_to_timestamp(stamp, F.lit("yyyyMMddHHmmss")), zone)


# Fixed value: the ISO-8601 shapes accepted as event times (date, optional clock, optional zone).
ISO_SHAPE = (
    r"^\d{4}-\d{2}-\d{2}([T ]\d{2}(:\d{2}(:\d{2}([.,]\d{1,9})?)?)?(Z|[+-]\d{2}(:?\d{2})?)?)?$"
)


def iso_timestamp(raw: Column) -> Column:
    """UTC timestamp of an ISO text, cut to milliseconds; text without offset is UTC."""
    return F.when(raw.rlike(ISO_SHAPE), F.date_trunc(
        "MILLISECOND", F.replace(raw, F.lit(","), F.lit(".")).try_cast("timestamp")))


def epoch_timestamp(seconds: Column) -> Column:
    """UTC timestamp of epoch seconds, cut to the second; NULL when unreadable."""
    value = seconds.try_cast("double")
    usable = value.isNotNull() & ~F.isnan(value) & (F.abs(value) < F.lit(2.5e11))
    return F.when(usable, F.timestamp_seconds(F.floor(value)))


def utc_bounds(lower: Column, upper: Column, slack_minutes: int = 10) -> tuple[Column, Column]:
    """Search range of a reconciliation: floored lower end, upper end plus delivery slack."""
    return (
        F.date_trunc("SECOND", lower.cast("timestamp")),
        F.date_trunc("SECOND", upper.cast("timestamp"))
        + F.expr(f"INTERVAL {int(slack_minutes)} MINUTES"),
    )
