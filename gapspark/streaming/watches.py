"""Streaming jobs that keep their own account: silence by the clock, observed counts, late rows.

What a stream drops, misses or rejects is counted while it runs, never looked for afterwards.
"""

from __future__ import annotations

import threading
import time
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from gapspark.operators.collapse import KEYS, collapse_bursts, parse_collapsed, wait_bounds
from gapspark.streaming.jobs import run_batches

# Timers need a state store that can hold them.
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
# What opening a file counts for, the least size of the parts that Spark splits a batch's files into.
_OPEN_COST = "spark.sql.files.openCostInBytes"
SPLIT_BYTES = 1 << 18

ALARMS = "node_id string, first_seen timestamp, last_seen timestamp, n_heartbeats long, alarm_at timestamp"


class SilenceTimer(StatefulProcessor):
    """One timer per node: every heartbeat sets it anew, and when it fires the node has been silent."""

    def __init__(self, silence_ms: int):
        self.silence_ms = silence_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getValueState("seen", "first_seen timestamp, last_seen timestamp, n long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        first = last = None
        n = 0
        if self.seen.exists():
            first, last, n = self.seen.get()
        for part in rows:
            low, high = part["first_seen"].min(), part["last_seen"].max()
            first = low if first is None else min(first, low)
            last = high if last is None else max(last, high)
            n += int(part["n"].sum())
        self.seen.update((first, last, n))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.silence_ms)
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        first, last, n = self.seen.get()
        self.seen.clear()
        fired = pd.Timestamp(expiredTimerInfo.getExpiryTimeInMs(), unit="ms")
        yield pd.DataFrame({"node_id": [key[0]], "first_seen": [first], "last_seen": [last], "n_heartbeats": [n], "alarm_at": [fired]})

    def close(self) -> None:
        pass


def silence_watch(heartbeats: DataFrame, silence_seconds: float) -> DataFrame:
    """One alarm per silence, by the clock of the job: no other stream need go on while all nodes are
    still. A node that comes back starts anew. Heartbeats without a node or a time set no timer.

    Rows of a batch combine to one per node and input partition before they are shuffled.
    """
    def combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            grouped = pa.Table.from_batches([batch]).group_by("node_id").aggregate(
                [("timestamp", "min"), ("timestamp", "max"), ("timestamp", "count")])
            yield from grouped.select(["node_id", "timestamp_min", "timestamp_max", "timestamp_count"]).rename_columns(
                ["node_id", "first_seen", "last_seen", "n"]).combine_chunks().to_batches()

    beats = heartbeats.select("node_id", F.col("timestamp").cast("timestamp").alias("timestamp")).where(
        F.col("node_id").isNotNull() & F.col("timestamp").isNotNull())
    combined = beats.mapInArrow(combine, "node_id string, first_seen timestamp, last_seen timestamp, n long")
    return combined.groupBy("node_id").transformWithStateInPandas(
        statefulProcessor=SilenceTimer(int(silence_seconds * 1000)), outputStructType=ALARMS, outputMode="Append",
        timeMode="ProcessingTime")


def run_watch(stream: DataFrame, path: str, checkpoint: str, interval: str = "1 second") -> StreamingQuery:
    """Starts a job that goes on by the clock; alarms are appended to the table exactly once."""
    spark = stream.sparkSession
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, _ROCKSDB)
    try:
        return stream.writeStream.outputMode("append").format("parquet").option("path", path).option(
            "checkpointLocation", checkpoint).trigger(processingTime=interval).start()
    finally:
        if before is None:
            spark.conf.unset(_PROVIDER)
        else:
            spark.conf.set(_PROVIDER, before)


def stop_when(query: StreamingQuery, done: Callable[[], bool], limit_seconds: float) -> bool:
    """Stops a running job once ``done`` holds, or after ``limit_seconds``; tells whether it held."""
    deadline, held = time.monotonic() + limit_seconds, False
    while not held and time.monotonic() < deadline and query.isActive:
        time.sleep(0.5)
        held = done()
    if query.exception() is not None:
        raise query.exception()
    query.stop()
    return held


class BatchLedger(StreamingQueryListener):
    """Stores what ``observe(name, ...)`` counted, one row per micro-batch.

    Rows are appended to ``path`` every ``flush`` batches and at the end, so neither the number of
    batches nor the short memory of a query's progress loses any. A batch that is repeated after a
    restart replaces its row (``read``).
    """

    def __init__(self, spark: SparkSession, name: str, path: str, flush: int = 50):
        self.spark, self.name, self.path, self.flush = spark, name, path, flush
        self.rows: list[dict] = []
        self.ended = threading.Event()

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        progress = event.progress
        counts = progress.observedMetrics.get(self.name)
        if counts is None:
            return
        self.rows.append({"batch_id": int(progress.batchId), "noted_at": progress.timestamp, **counts.asDict()})
        if len(self.rows) >= self.flush:
            self.store()

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self.store()
        self.ended.set()

    def store(self) -> None:
        rows, self.rows = self.rows, []
        if rows:
            self.spark.createDataFrame(rows).coalesce(1).write.mode("append").parquet(self.path)

    def read(self) -> DataFrame:
        rows = self.spark.read.parquet(self.path)
        others = [c for c in rows.columns if c != "batch_id"]
        latest = rows.groupBy("batch_id").agg(F.max_by(F.struct(*others), "noted_at").alias("row"))
        return latest.select("batch_id", "row.*")


def run_observed(stream: DataFrame, path: str, checkpoint: str, ledger: BatchLedger, partition_by: tuple[str, ...] = (),
                 limit_seconds: float = 60) -> None:
    """Drains an observed stream into a table while ``ledger`` notes each batch.

    A batch is often one file of a few MB, which Spark would read in one or two tasks, batch after batch.
    So parts may be as small as ``SPLIT_BYTES``, and the batch is spread over all cores.
    """
    spark = stream.sparkSession
    spark.streams.addListener(ledger)
    before = spark.conf.get(_OPEN_COST)
    try:
        writer = stream.writeStream.outputMode("append").format("parquet").option("path", path).option(
            "checkpointLocation", checkpoint).trigger(availableNow=True)
        # a file source asks the session it was made by, batch after batch, not the copy a query keeps
        spark.conf.set(_OPEN_COST, SPLIT_BYTES)
        query = (writer.partitionBy(*partition_by) if partition_by else writer).start()
        query.awaitTermination()
        if query.exception() is not None:
            raise query.exception()
        if not ledger.ended.wait(limit_seconds):
            raise TimeoutError("the listener did not see the end of the query")
    finally:
        spark.conf.set(_OPEN_COST, before)
        spark.streams.removeListener(ledger)


def observed_ingest(validated: DataFrame) -> DataFrame:
    """Validated rows with the counts of the trickle endpoint observed as ``ingest``."""
    bad = F.col("target") == "quarantine"
    return validated.observe(
        "ingest", F.count(F.lit(1)).alias("received"), F.count_if(~bad).alias("accepted"), F.count_if(bad).alias("quarantined"),
        F.count_if(F.coalesce(F.col("reason") == "parse_error", F.lit(False))).alias("parse_errors"),
        F.count_if(F.coalesce("ts_substituted", F.lit(False))).alias("ts_substituted"))


def collapsed_tail(lines: DataFrame, observed_ms: Column | None = None) -> DataFrame:
    """Collapsed output records as they arrive, with the bounds of their waiting time; groups, summed
    counts and parse errors are observed as ``tail``. ``observed_ms`` defaults to the batch's clock."""
    clock = F.unix_millis(F.current_timestamp()) if observed_ms is None else observed_ms
    records = parse_collapsed(lines).withColumn("observed_ms", clock)
    bad = F.col("parse_error")
    return wait_bounds(records).observe(
        "tail", F.count_if(~bad).alias("n_groups"), F.count_if(bad).alias("parse_errors"),
        F.coalesce(F.sum(F.when(~bad, F.col("count"))), F.lit(0)).alias("total_count"))


_MEASURES = {"count": F.sum, "severity": F.max, "raw_rows": F.sum}


def merge_bursts(parts: DataFrame, gap_seconds: float, keys: list[str] | None = None) -> DataFrame:
    """Bursts out of partial ones: parts of a key that overlap, or lie no more than the gap apart, are
    one. What is ordered per key are parts, not rows."""
    keys = keys or KEYS
    key = F.struct(*[F.col(k) for k in keys]).alias("_key")
    us = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    spans = parts.select(key, us("first_ts").alias("_first"), us("timestamp").alias("_last"), *_MEASURES)
    order = Window.partitionBy("_key").orderBy("_first", "_last")
    reach = F.max("_last").over(order.rowsBetween(Window.unboundedPreceding, -1))
    starts = F.coalesce(F.col("_first") - reach > int(gap_seconds * 1_000_000), F.lit(True)).cast("int")
    numbered = spans.withColumn("_starts", starts).withColumn("_burst", F.sum("_starts").over(order))
    merged = numbered.groupBy("_key", "_burst").agg(
        F.min("_first").alias("_first"), F.max("_last").alias("_last"), *[f(c).alias(c) for c, f in _MEASURES.items()])
    return merged.select(*[F.col(f"_key.{k}").alias(k) for k in keys], F.timestamp_micros("_last").alias("timestamp"),
                         F.timestamp_micros("_first").alias("first_ts"), *_MEASURES)


def _ledger(spark: SparkSession, base: str) -> DataFrame:
    return spark.read.schema("n_rows long, n_late long, n_untimed long, max_us long, watermark_us long, batch_id long").parquet(
        f"{base}/ledger")


def burst_ledger(events: DataFrame, base: str, checkpoint: str, gap_seconds: float, lateness_seconds: float,
                 drain: bool = True) -> StreamingQuery:
    """Session collapse that loses no late row: every micro-batch splits off the rows behind the
    watermark into a counted ``late`` table, merges the others with the bursts still open, and emits a
    burst once the watermark is more than the gap past its last event.

    The watermark of a batch is the largest event time of the batches before it less the lateness, read
    from the ledger that each batch writes. A repeated batch overwrites its own folders only. Rows
    without an event time are counted in the ledger.
    """
    gap_us, late_us = int(gap_seconds * 1_000_000), int(lateness_seconds * 1_000_000)

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        at = F.unix_micros(F.col("timestamp").cast("timestamp"))
        past = None
        if batch_id:
            past = _ledger(spark, base).where(F.col("batch_id") < batch_id).agg(
                F.max("max_us"), F.max("batch_id")).first()
        top, last_id = past if past else (None, None)
        watermark = None if top is None else top - late_us
        late = F.lit(False) if watermark is None else at < watermark
        own = f"batch_id={batch_id}"
        batch.where(late).write.mode("overwrite").parquet(f"{base}/late/{own}")
        counts = batch.agg(
            F.count(F.lit(1)).alias("n_rows"), F.count_if(late).alias("n_late"), F.count_if(at.isNull()).alias("n_untimed"),
            F.greatest(F.max(at), F.lit(top).cast("long")).alias("max_us"), F.lit(watermark).cast("long").alias("watermark_us"))
        row = counts.first()
        parts = collapse_bursts(batch.where(~late), gap_seconds)
        if last_id is not None:
            parts = parts.unionByName(spark.read.schema(parts.schema).parquet(f"{base}/bursts/batch_id={last_id}/closed=false"))
        reach = -(1 << 62) if row.max_us is None else row.max_us - late_us
        closed = F.unix_micros("timestamp") + gap_us < reach
        merged = merge_bursts(parts, gap_seconds).withColumn("closed", closed)
        for part in (True, False):  # both folders exist, whatever the batch holds
            merged.limit(0).drop("closed").write.mode("overwrite").parquet(f"{base}/bursts/{own}/closed={str(part).lower()}")
        merged.write.mode("append").partitionBy("closed").parquet(f"{base}/bursts/{own}")
        spark.createDataFrame([tuple(row)], "n_rows long, n_late long, n_untimed long, max_us long, watermark_us long").coalesce(
            1).write.mode("overwrite").parquet(f"{base}/ledger/{own}")

    return run_batches(events, write, checkpoint, drain)


def late_table(spark: SparkSession, base: str) -> DataFrame:
    """The rows that came behind the watermark, with the batch that brought them."""
    return spark.read.parquet(f"{base}/late")


def ledger_bursts(spark: SparkSession, base: str, gap_seconds: float) -> DataFrame:
    """All bursts: emitted ones, those still open, and what late rows change about them. Nothing but the
    late table and the bursts is read; ``origin`` tells which bursts the stream had right."""
    last = _ledger(spark, base).agg(F.max("batch_id")).first()[0]
    held = spark.read.parquet(f"{base}/bursts").withColumn("closed", F.col("closed").cast("boolean"))
    held = held.where(F.col("closed") | (F.col("batch_id") == last)).select(*KEYS, "timestamp", "first_ts", *_MEASURES, "closed")
    late = collapse_bursts(late_table(spark, base), gap_seconds)
    touched = late.select(*KEYS).distinct()
    same = [held[k].eqNullSafe(touched[k]) for k in KEYS]
    calm = held.join(touched, same, "left_anti")
    moved = held.join(touched, same, "left_semi")
    merged = merge_bursts(moved.drop("closed").unionByName(late), gap_seconds)
    before = moved.where("closed").drop("closed").withColumn("_stream", F.lit(True)).alias("b")
    whole = [F.col(f"m.{c}").eqNullSafe(F.col(f"b.{c}")) for c in (*KEYS, "timestamp", "first_ts", *_MEASURES)]
    changed = merged.alias("m").join(before, whole, "left").select(
        "m.*", F.when(F.col("_stream"), "stream").otherwise("correction").alias("origin"))
    rest = calm.select(*[c for c in calm.columns if c != "closed"],
                       F.when(F.col("closed"), "stream").otherwise("correction").alias("origin"))
    return rest.unionByName(changed)
