"""Burst collapse and what can be proved about it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gapspark.operators.ordered import join_on, quantiles

KEYS = ["sensor_id", "event_type"]


def collapse_bursts(
    events: DataFrame, gap_seconds: float = 1.0, keys: list[str] | None = None,
    ingest_ms: str | None = None, chunk_seconds: int = 600,
) -> DataFrame:
    """One row per burst: events of a key with no idle time longer than ``gap_seconds``.

    Two events exactly one gap apart belong to the same burst. ``timestamp`` is the last event
    time of the burst, ``first_ts`` the first. ``ingest_ms`` adds min/max ingest times.

    Rows are collapsed inside (key, time chunk) and stitched across chunk borders, so no key sits
    in one task. Rows without an event time belong to no burst: ``untimed_events`` counts them.
    """
    timed = events.where(F.col("timestamp").isNotNull())
    return _stitched(timed, gap_seconds, keys or KEYS, ingest_ms, chunk_seconds)


def untimed_events(events: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Rows and summed counts per key that no burst can hold, because they have no event time."""
    return events.where(F.col("timestamp").isNull()).groupBy(*(keys or KEYS)).agg(
        F.count(F.lit(1)).alias("raw_rows"), F.sum("count").alias("count"))


def _stitched(
    events: DataFrame, gap_seconds: float, keys: list[str], ingest_ms: str | None, chunk_seconds: int,
) -> DataFrame:
    """Bursts of busy keys: collapsed inside (key, time chunk), then joined across chunk borders.

    Rows first combine map-side to one per (key, instant). A summary of one row per (key, chunk)
    tells which border bursts belong together. Event times have millisecond resolution, so ten
    minutes of a key are at most 600,000 instants, whatever share of the data the key has.
    """
    gap_us = int(gap_seconds * 1_000_000)
    measures = {
        "count": F.sum("count"), "severity": F.max("severity"), "raw_rows": F.sum("raw_rows"),
    }
    first_pass = {
        "count": F.sum("count"), "severity": F.max("severity"), "raw_rows": F.count(F.lit(1)),
    }
    if ingest_ms:
        measures |= {"ingest_ms_first": F.min("ingest_ms_first"), "ingest_ms_last": F.max("ingest_ms_last")}
        first_pass |= {"ingest_ms_first": F.min(ingest_ms), "ingest_ms_last": F.max(ingest_ms)}
    aggs = [c.alias(n) for n, c in measures.items()]

    # One struct key is never NULL, so windows, join and grouping share their partitioning.
    key = F.struct(*[F.col(k) for k in keys]).alias("_key")
    instants = events.groupBy(
        key, F.unix_micros(F.col("timestamp").cast("timestamp")).alias("_us")
    ).agg(*[c.alias(n) for n, c in first_pass.items()])
    chunked = instants.withColumn("_chunk", F.floor(F.col("_us") / F.lit(chunk_seconds * 1_000_000)))
    inner = Window.partitionBy("_key", "_chunk").orderBy("_us")
    starts = F.coalesce(F.col("_us") - F.lag("_us").over(inner) > gap_us, F.lit(True)).cast("int")
    local = (
        chunked.withColumn("_starts", starts)
        .withColumn("_burst", F.sum("_starts").over(inner))
        .groupBy("_key", "_chunk", "_burst")
        .agg(F.min("_us").alias("_first"), F.max("_us").alias("_last"), *aggs)
    )

    # Which burst does the first burst of a chunk continue?
    along = Window.partitionBy("_key").orderBy("_chunk")
    summary = local.groupBy("_key", "_chunk").agg(
        F.min("_first").alias("_head"), F.max("_last").alias("_tail"), F.max("_burst").alias("_n")
    )
    continues = F.coalesce(F.col("_head") - F.lag("_tail").over(along) <= gap_us, F.lit(False))
    anchor = F.when(~continues, F.struct(F.col("_chunk").alias("c"), F.lit(1).cast("bigint").alias("b"))).when(
        F.lag("_n").over(along) > 1,
        F.struct(F.lag("_chunk").over(along).alias("c"), F.lag("_n").over(along).cast("bigint").alias("b")),
    )
    anchored = summary.select("_key", "_chunk", anchor.alias("_own")).select(
        "_key", "_chunk",
        F.last("_own", ignorenulls=True).over(
            along.rowsBetween(Window.unboundedPreceding, Window.currentRow)
        ).alias("_anchor"),
    )
    mine = F.struct(F.col("_chunk").alias("c"), F.col("_burst").cast("bigint").alias("b"))
    stitched = local.join(anchored, ["_key", "_chunk"]).withColumn(
        "_id", F.when(F.col("_burst") == 1, F.col("_anchor")).otherwise(mine)
    )
    merged = stitched.groupBy("_key", "_id").agg(
        F.min("_first").alias("_first"), F.max("_last").alias("_last"), *aggs
    )
    return merged.select(
        *[F.col(f"_key.{k}").alias(k) for k in keys], F.timestamp_micros("_last").alias("timestamp"),
        F.timestamp_micros("_first").alias("first_ts"), *measures,
    )


def count_conservation(raw: DataFrame, collapsed: DataFrame) -> DataFrame:
    """One row: raw rows, summed collapsed counts, and whether they agree."""
    before = raw.agg(F.count(F.lit(1)).alias("raw_event_count"))
    after = collapsed.agg(
        F.coalesce(F.sum("count"), F.lit(0)).alias("aggregated_count_sum"),
        F.count(F.lit(1)).alias("n_aggregated_groups"),
    )
    diff = F.col("aggregated_count_sum") - F.col("raw_event_count")
    return before.crossJoin(F.broadcast(after)).select(
        "*", diff.alias("count_diff"), (diff == 0).alias("count_matches")
    )


def wait_bounds(collapsed: DataFrame, observed_ms: str = "observed_ms") -> DataFrame:
    """Upper and lower bound of the waiting time inside a burst."""
    return collapsed.withColumn("wait_upper_ms", F.col(observed_ms) - F.col("ingest_ms_first")).withColumn(
        "wait_lower_ms", F.col(observed_ms) - F.col("ingest_ms_last")
    )


def wait_summary(waits: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Mean, nearest-rank p50/p95 and maximum of the waits per key."""
    moments = waits.groupBy(*keys).agg(F.avg(value).alias("mean"), F.max(value).alias("max"))
    ranks = quantiles(waits, keys, value, {"p50": 0.5, "p95": 0.95}, method="nearest")
    return join_on(moments, ranks, keys)


def parse_collapsed(lines: DataFrame, value: str = "value") -> DataFrame:
    """Collapsed output records; a line without two usable ingest times is a parse error."""
    v = F.try_parse_json(F.col(value))
    parsed = lines.where(F.trim(F.col(value)) != "").withColumn("_v", v)
    get = lambda p, t: F.try_variant_get(F.col("_v"), p, t)
    first, last = get("$.vector_ingest_ts_first", "double"), get("$.vector_ingest_ts_last", "double")
    return parsed.select(
        *[c for c in lines.columns if c != value],
        first.alias("ingest_ms_first"), last.alias("ingest_ms_last"),
        F.coalesce(get("$.count", "bigint"), F.lit(0)).alias("count"),
        (first.isNull() | last.isNull()).alias("parse_error"),
    )
