"""Structured Streaming jobs.

Queues, retries and drains become source offsets and checkpoints: a job restarted from its
checkpoint repeats at most the last micro-batch, and its sinks overwrite that batch. With
``drain=True`` a job processes what is there and stops.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from gapspark.operators import ingest
from gapspark.operators.collapse import KEYS, collapse_bursts
from gapspark.operators.features import feature_windows
from gapspark.schemas import FEATURE_TYPES
from gapspark.session import shared_dir
from gapspark.sinks.tables import append_routes

# Micro-batch bounds of the deployed transport and store.
FLUSH_INTERVAL = "1 second"
MAX_FILES_PER_BATCH = 1000


def text_source(
    spark: SparkSession, path: str, max_files: int = MAX_FILES_PER_BATCH, max_bytes: int | None = None,
) -> DataFrame:
    """Raw lines with their ingest time (the file's modification time, so replays agree).

    A micro-batch takes ``max_files`` files or, where given, as many as fit ``max_bytes``.
    """
    bound = ("maxBytesPerTrigger", max_bytes) if max_bytes else ("maxFilesPerTrigger", max_files)
    lines = spark.readStream.option(*bound).text(path)
    return lines.withColumn("ingest_ts", F.col("_metadata.file_modification_time"))


def table_source(spark: SparkSession, path: str, schema, max_files: int = MAX_FILES_PER_BATCH) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(path)


def _start(writer, checkpoint: str, drain: bool) -> StreamingQuery:
    writer = writer.option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if drain else writer.trigger(processingTime=FLUSH_INTERVAL)
    query = writer.start()
    if drain:
        query.awaitTermination()
        if query.exception() is not None:
            raise query.exception()
    return query


def run_to_table(stream: DataFrame, path: str, checkpoint: str, drain: bool = True) -> StreamingQuery:
    """Append-mode file sink (exactly once through its commit log)."""
    return _start(stream.writeStream.outputMode("append").format("parquet").option("path", path), checkpoint, drain)


def run_batches(stream: DataFrame, fn: Callable[[DataFrame, int], None], checkpoint: str, drain: bool = True):
    return _start(stream.writeStream.foreachBatch(fn), checkpoint, drain)


def routed_ingest(lines: DataFrame, base: str, checkpoint: str, drain: bool = True) -> StreamingQuery:
    """Validate raw lines and write each target; invalid rows are isolated, never fatal."""
    validated = ingest.validate_rows(lines)

    def write(batch: DataFrame, batch_id: int) -> None:
        append_routes(batch, batch_id, base)

    return run_batches(validated, write, checkpoint, drain)


def _merge_sessions_early(spark: SparkSession) -> None:
    """Rows of one input partition merge into sessions before the shuffle, so a busy key is cheap."""
    spark.conf.set("spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition", "true")


def burst_stream(events: DataFrame, gap: str, lateness: str) -> DataFrame:
    """Session collapse on a stream; emitted once the watermark passes the end of the burst."""
    _merge_sessions_early(events.sparkSession)
    timed = events.withColumn("timestamp", F.col("timestamp").cast("timestamp")).withWatermark("timestamp", lateness)
    grouped = timed.groupBy(*KEYS, F.session_window("timestamp", gap).alias("_s")).agg(
        F.sum("count").alias("count"), F.max("severity").alias("severity"), F.count(F.lit(1)).alias("raw_rows"),
        F.max("timestamp").alias("last_ts"))
    return grouped.select(
        *KEYS, F.col("last_ts").alias("timestamp"), F.col("_s.start").alias("first_ts"), "count", "severity", "raw_rows")


def corrected_bursts(raw: DataFrame, emitted: DataFrame, gap_seconds: float) -> DataFrame:
    """Batch correction of a burst stream: late rows and still-open bursts are added, not lost.

    ``origin`` tells which bursts the stream had emitted in their final form.
    """
    final = collapse_bursts(raw, gap_seconds)
    keys = [*KEYS, "first_ts", "timestamp", "count", "severity", "raw_rows"]
    seen = emitted.select(*keys).distinct().withColumn("_stream", F.lit(True))
    return final.join(seen, keys, "left").select(
        *keys, F.when(F.col("_stream"), "stream").otherwise("correction").alias("origin"))


def feature_stream(events: DataFrame, lateness: str, seconds: int = 300) -> DataFrame:
    """Tumbling feature windows with approximate distinct; exact ones are a batch job."""
    timed = events.withColumn("timestamp", F.col("timestamp").cast("timestamp")).withWatermark("timestamp", lateness)
    return timed.groupBy(F.window("timestamp", f"{seconds} seconds").alias("_w")).agg(
        F.count(F.lit(1)).alias("event_count"), F.approx_count_distinct("sensor_id", 0.01).alias("unique_sensors"),
        F.avg("severity").alias("avg_severity"), F.max("severity").alias("max_severity"),
        *[F.count_if(F.col("event_type") == t).alias(f"{t}_count") for t in FEATURE_TYPES],
    ).select(F.col("_w.start").alias("window_start"), "*").drop("_w")


def corrected_windows(raw: DataFrame, emitted: DataFrame, seconds: int = 300) -> DataFrame:
    """Batch correction of a feature stream: windows that late rows changed and windows still open
    are added with their exact values. ``origin`` tells which windows the stream had right."""
    final = feature_windows(raw, seconds)
    # the stream's distinct sensors are approximate, so they do not decide
    keys = [c for c in emitted.columns if c not in ("unique_sensors", "avg_severity")]
    seen = emitted.select(*keys).withColumn("_stream", F.lit(True))
    same = reduce(and_, [final[c].eqNullSafe(seen[c]) for c in keys])
    joined = final.join(seen, same, "left")
    return joined.select(*[final[c] for c in final.columns],
                         F.when(F.col("_stream"), "stream").otherwise("correction").alias("origin"))


def corrected_ids(raw: DataFrame, emitted: DataFrame, key: str = "inject_id") -> DataFrame:
    """Batch correction of a deduplicated stream: ids that only came behind the watermark are added
    once, with the row of their earliest time. ``origin`` tells which ids the stream emitted."""
    late = raw.join(emitted.select(key).distinct(), key, "left_anti")
    others = [c for c in emitted.columns if c != key]
    first = late.groupBy(key).agg(F.min_by(F.struct(*others), "timestamp").alias("_row"))
    added = first.select(*[F.col(f"_row.{c}").alias(c) if c != key else F.col(c) for c in emitted.columns])
    return emitted.withColumn("origin", F.lit("stream")).unionByName(added.withColumn("origin", F.lit("correction")))


def deduplicated(tagged: DataFrame, lateness: str) -> DataFrame:
    """Re-sent ids are suppressed while their first copy is inside the watermark."""
    timed = tagged.withColumn("timestamp", F.col("timestamp").cast("timestamp")).withWatermark("timestamp", lateness)
    return timed.dropDuplicatesWithinWatermark(["inject_id"])


def silence_alarms(heartbeats: DataFrame, silence: str, lateness: str, clock: DataFrame | None = None) -> DataFrame:
    """One alarm per node silence: a heartbeat session closes when the node stays quiet.

    The session end is the last heartbeat plus the allowed silence; append mode emits it as soon
    as the watermark proves that no further heartbeat arrived in time. Heartbeats alone move no
    watermark once all nodes are silent, so ``clock``, a stream whose ``timestamp`` goes on (other
    events, or a rate source), carries time through a total outage.
    """
    _merge_sessions_early(heartbeats.sparkSession)
    beats = heartbeats.select("node_id", F.col("timestamp").cast("timestamp").alias("timestamp"))
    if clock is not None:
        ticks = clock.select(F.lit(None).cast("string").alias("node_id"), F.col("timestamp").cast("timestamp").alias("timestamp"))
        beats = beats.unionByName(ticks)
    # the condition names the event time, else it would move below the watermark and stop the clock
    beat = F.when(F.col("timestamp").isNotNull(), F.col("node_id")).isNotNull()
    timed = beats.withWatermark("timestamp", lateness).where(beat)
    return timed.groupBy("node_id", F.session_window("timestamp", silence).alias("_s")).agg(
        F.count(F.lit(1)).alias("n_heartbeats"), F.max("timestamp").alias("last_seen")
    ).select("node_id", F.col("_s.start").alias("first_seen"), "last_seen", F.col("_s.end").alias("alarm_at"), "n_heartbeats")


def heartbeat_append(bodies: DataFrame, path: str, checkpoint: str, drain: bool = True) -> StreamingQuery:
    """Decoded heartbeats as an exactly-once file sink; rejected bodies stay in it by status."""
    return run_to_table(ingest.decode_heartbeats(bodies), path, checkpoint, drain)


def heartbeat_totals(stored: DataFrame) -> DataFrame:
    """received, accepted and ts_substituted over all stored heartbeats, whatever the batch count."""
    return stored.agg(
        F.count(F.lit(1)).alias("received"), F.count_if(F.col("body_status") == "accepted").alias("accepted"),
        F.count_if(F.coalesce("ts_substituted", F.lit(False))).alias("ts_substituted"))


def job_dirs(spark: SparkSession, name: str) -> tuple[str, str]:
    base = shared_dir(spark, name)
    return f"{base}/table", f"{base}/checkpoint"
