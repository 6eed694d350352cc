"""Query registry: name -> (Spark callable, SQL oracle or None)."""

from __future__ import annotations

import importlib
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gapspark.sources.driver_tables import VIEWS, view_sql

CATALOG_MODULES = (
    "monitoring", "completeness", "ingestion", "reconciliation", "features", "experiments",
    "hypotheses", "periodicity", "drift", "streams",
)


@dataclass(frozen=True)
class Entry:
    name: str
    covers: str
    run: Callable[[SparkSession, str], DataFrame]
    oracle: str | None


ENTRIES: dict[str, Entry] = {}


def report_edge(df: DataFrame) -> DataFrame:
    """Presentation form: times as ISO text, doubles rounded to six digits.

    Operators keep full types and precision; only the registered report rounds, so that sums
    taken in different orders compare equal.
    """
    cols = []
    for field in df.schema.fields:
        c = F.col(f"`{field.name}`")
        if isinstance(field.dataType, (T.TimestampType, T.TimestampNTZType, T.DateType)):
            c = c.cast("string")
        elif isinstance(field.dataType, (T.DoubleType, T.FloatType)):
            c = F.round(c.cast("double"), 6) + F.lit(0.0)
        elif isinstance(field.dataType, (T.IntegerType, T.ShortType, T.ByteType)):
            c = c.cast("bigint")
        cols.append(c.alias(field.name))
    return df.select(*cols)


def with_views(sql: str) -> str:
    """Prefixes an oracle with the view definitions it mentions."""
    body = sql.strip()
    used = [v for v in VIEWS if f" {v}" in f" {body}".replace("\n", " ").replace("(", " ")]
    if not used:
        return body
    head = ", ".join(f"{v} AS ({view_sql(v)})" for v in used)
    if body[:14].upper() == "WITH RECURSIVE":
        return f"WITH RECURSIVE {head}, {body[14:].lstrip()}"
    if body[:4].upper() == "WITH":
        return f"WITH {head}, {body[4:].lstrip()}"
    return f"WITH {head} {body}"


def query(name: str, covers: str, oracle: str | None = None):
    def register(fn: Callable[[SparkSession, str], DataFrame]):
        if name in ENTRIES:
            raise ValueError(f"duplicate query name {name}")

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return report_edge(fn(spark, sf_dir))

        ENTRIES[name] = Entry(name, covers, run, with_views(oracle) if oracle else None)
        return fn

    return register


def entries() -> dict[str, Entry]:
    for module in CATALOG_MODULES:
        importlib.import_module(f"gapspark.catalog.{module}")
    return ENTRIES
