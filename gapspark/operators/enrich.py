"""Range lookup of source addresses."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_PREFIX = 65_536  # addresses per /16 bucket


def ipv4_number(ip: Column) -> Column:
    """The address as a number; NULL for anything but four decimal octets of 0 to 255."""
    well_formed = ip.rlike(r"^[0-9]{1,3}(\.[0-9]{1,3}){3}$")
    parts = F.split(ip, r"\.")
    octets = [F.get(parts, F.lit(i)).try_cast("bigint") for i in range(4)]
    in_range = reduce(lambda a, b: a & b, [o <= 255 for o in octets])
    return F.when(well_formed & in_range, reduce(lambda total, o: total * 256 + o, octets))


def geo_lookup(events: DataFrame, ranges: DataFrame, ip: str, attributes: list[str]) -> DataFrame:
    """Left range join of addresses to disjoint ``ranges`` (lo, hi, attributes).

    Both sides carry the /16 prefix as an equality key, so this is a hash or merge join and never
    a nested loop; ranges of any number work, since disjoint ranges add at most one row per
    prefix beyond their own number. Distinct addresses are looked up once each.
    """
    addresses = events.select(F.col(ip).alias("_ip")).distinct().withColumn("_n", ipv4_number(F.col("_ip")))
    spread = ranges.select(
        *attributes, "lo", "hi",
        F.explode(F.sequence(F.floor(F.col("lo") / _PREFIX), F.floor(F.col("hi") / _PREFIX))).alias("_p"),
    )
    found = addresses.withColumn("_q", F.floor(F.col("_n") / _PREFIX)).join(
        spread, (F.col("_q") == F.col("_p")) & F.col("_n").between(F.col("lo"), F.col("hi"))
    ).select("_ip", *attributes)
    return events.join(found, events[ip] == found["_ip"], "left").drop("_ip")
