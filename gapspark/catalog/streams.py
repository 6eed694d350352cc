"""Registered queries: streaming jobs run to completion over the tables, and sinks."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from gapspark.catalog.features import WINDOWS
from gapspark.catalog.ingestion import BURSTS, GAP, VALID
from gapspark.operators import features as ft
from gapspark.operators import ingest, monitor, retention
from gapspark.registry import query
from gapspark.schemas import FEATURE_TYPES
from gapspark.session import shared_dir
from gapspark.sinks import tables
from gapspark.sources.driver_tables import VIEWS, load, view
from gapspark.streaming import jobs, watches


def stream_view(spark, d, name):
    base, exprs = VIEWS[name]
    # as a glob the path may be one file or a folder of files
    path = f"{d}/[{base[0]}]{base[1:]}.parquet"
    return jobs.table_source(spark, path, load(spark, d, base).schema).selectExpr(*exprs)


def _drained(spark, name, stream):
    table, checkpoint = jobs.job_dirs(spark, name)
    jobs.run_to_table(stream, table, checkpoint)
    return spark.read.schema(stream.schema).parquet(table)


@query("stream_burst_collapse", "X1 X2", f"""
WITH {BURSTS}, m AS (SELECT max(timestamp) AS mx FROM threat_events)
SELECT sensor_id, event_type, CAST(first_ts AS VARCHAR) AS first_ts, CAST(last_ts AS VARCHAR) AS timestamp, count, severity, raw_rows,
  CASE WHEN last_ts + INTERVAL 6 HOUR <= date_trunc('milliseconds', mx) - INTERVAL 10 MINUTE THEN 'stream' ELSE 'correction' END AS origin FROM bursts, m""")
def _(spark, d):
    emitted = _drained(spark, "bursts", jobs.burst_stream(stream_view(spark, d, "threat_events"), "6 hours", "10 minutes"))
    return jobs.corrected_bursts(view(spark, d, "threat_events"), emitted, GAP)


_COLS = ", ".join(["event_count", *(f"{t}_count" for t in FEATURE_TYPES)])


@query("stream_feature_windows", "X3", f"""
WITH {WINDOWS}, m AS (SELECT max(timestamp) AS mx FROM threat_events)
SELECT CAST(window_start AS VARCHAR) AS window_start, unique_sensors, round(avg_severity, 6) AS avg_severity, max_severity, {_COLS},
  CASE WHEN window_start + INTERVAL 5 MINUTE <= date_trunc('milliseconds', mx) - INTERVAL 10 MINUTE THEN 'stream' ELSE 'correction' END AS origin FROM fw, m""")
def _(spark, d):
    out = _drained(spark, "features", jobs.feature_stream(stream_view(spark, d, "threat_events"), "10 minutes"))
    return jobs.corrected_windows(view(spark, d, "threat_events"), out)


@query("stream_feature_sensors_approx", "X3", f"""
WITH {WINDOWS}, m AS (SELECT max(timestamp) AS mx FROM threat_events)
SELECT CAST(window_start AS VARCHAR) AS window_start, unique_sensors FROM fw, m WHERE window_start + INTERVAL 5 MINUTE <= mx - INTERVAL 10 MINUTE""")
def _(spark, d):
    out = _drained(spark, "features", jobs.feature_stream(stream_view(spark, d, "threat_events"), "10 minutes"))
    return out.select("window_start", "unique_sensors")


@query("stream_routed_ingest", "X4 X5 X6 S1 S2 S3", f"""
{VALID} SELECT CASE WHEN reason IS NOT NULL THEN 'quarantine' WHEN coalesce(j->>'$.inject_id', '') <> '' THEN 'threat_events_experiment' ELSE 'threat_events' END AS target,
  coalesce(CASE WHEN reason IS NULL THEN coalesce(j->>'$.event_type', 'unknown') END, reason) AS label, count(*) AS n_rows FROM r GROUP BY 1, 2""")
def _(spark, d):
    base, checkpoint = jobs.job_dirs(spark, "ingest")
    jobs.routed_ingest(stream_view(spark, d, "raw_lines"), base, checkpoint)
    parts = [
        tables.read_route(spark, base, t).select(F.lit(t).alias("target"), F.col("reason" if t == "quarantine" else "event_type").alias("label"))
        for t in tables.ROUTES
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).groupBy("target", "label").agg(F.count(F.lit(1)).alias("n_rows"))


@query("stream_ingest_metrics", "X9 G33", f"""
{VALID} SELECT count(*) AS received, count(*) FILTER (WHERE reason IS NULL) AS accepted, count(*) FILTER (WHERE reason IS NOT NULL) AS quarantined,
  count(*) FILTER (WHERE reason = 'parse_error') AS parse_errors, count(*) FILTER (WHERE reason IS NULL AND t = '') AS ts_substituted FROM r""")
def _(spark, d):
    base, checkpoint = jobs.job_dirs(spark, "metrics")
    jobs.routed_ingest(stream_view(spark, d, "raw_lines"), base, checkpoint)
    m = spark.read.parquet(f"{base}/ingest_metrics")
    n = lambda cond: F.coalesce(F.sum(F.when(cond, F.col("n_rows"))), F.lit(0))
    return m.agg(
        F.sum("n_rows").alias("received"), n(F.col("target") != "quarantine").alias("accepted"),
        n(F.col("target") == "quarantine").alias("quarantined"), n(F.col("reason") == "parse_error").alias("parse_errors"),
        F.sum("n_ts_substituted").alias("ts_substituted"))


@query("stream_heartbeat_metrics", "X9", """
WITH v AS (SELECT body, json_valid(body) AS ok, CASE WHEN json_valid(body) AND json_type(body) = 'OBJECT' THEN body END AS o FROM heartbeat_bodies)
SELECT count(*) AS received, count(o) AS accepted, count(*) FILTER (WHERE o IS NOT NULL AND TRY_CAST(o->>'$._received_at' AS DOUBLE) IS NULL) AS ts_substituted FROM v""")
def _(spark, d):
    table, checkpoint = jobs.job_dirs(spark, "heartbeats")
    jobs.heartbeat_append(stream_view(spark, d, "heartbeat_bodies"), table, checkpoint)
    return jobs.heartbeat_totals(spark.read.parquet(table))


@query("stream_resent_ids", "X7", "SELECT inject_id, 'stream' AS origin, count(*) AS n_rows FROM threat_events WHERE inject_id <> '' GROUP BY 1")
def _(spark, d):
    tagged = stream_view(spark, d, "threat_events").where("inject_id <> ''")
    resent = tagged.unionByName(stream_view(spark, d, "threat_events").where("inject_id <> '' AND event_id % 3 <> 0"))
    emitted = _drained(spark, "resent", jobs.deduplicated(resent, "10 minutes"))
    whole = jobs.corrected_ids(view(spark, d, "threat_events").where("inject_id <> ''"), emitted)
    return whole.groupBy("inject_id", "origin").agg(F.count(F.lit(1)).alias("n_rows"))


@query("stream_silence_alarms", "X8", """
WITH g AS (SELECT *, CASE WHEN timestamp - lag(timestamp) OVER (PARTITION BY node_id ORDER BY timestamp) <= INTERVAL 15 MINUTE THEN 0 ELSE 1 END AS b FROM heartbeats),
i AS (SELECT *, sum(b) OVER (PARTITION BY node_id ORDER BY timestamp ROWS UNBOUNDED PRECEDING) AS g FROM g), m AS (SELECT max(timestamp) AS mx FROM heartbeats),
s AS (SELECT node_id, min(timestamp) AS f, max(timestamp) AS l, count(*) AS n FROM i GROUP BY node_id, i.g)
SELECT node_id, CAST(f AS VARCHAR) AS first_seen, CAST(l AS VARCHAR) AS last_seen, CAST(l + INTERVAL 15 MINUTE AS VARCHAR) AS alarm_at, n AS n_heartbeats
FROM s, m WHERE l + INTERVAL 15 MINUTE <= date_trunc('milliseconds', mx) - INTERVAL 2 MINUTE""")
def _(spark, d):
    return _drained(spark, "silence", jobs.silence_alarms(stream_view(spark, d, "heartbeats"), "15 minutes", "2 minutes"))


@query("stream_outage_alarms", "X8", """
WITH g AS (SELECT *, CASE WHEN timestamp - lag(timestamp) OVER (PARTITION BY node_id ORDER BY timestamp) <= INTERVAL 15 MINUTE THEN 0 ELSE 1 END AS b FROM heartbeats),
i AS (SELECT *, sum(b) OVER (PARTITION BY node_id ORDER BY timestamp ROWS UNBOUNDED PRECEDING) AS g FROM g),
m AS (SELECT max(timestamp) + INTERVAL 1 DAY AS mx FROM heartbeats),
s AS (SELECT node_id, min(timestamp) AS f, max(timestamp) AS l, count(*) AS n FROM i GROUP BY node_id, i.g)
SELECT node_id, CAST(f AS VARCHAR) AS first_seen, CAST(l AS VARCHAR) AS last_seen, CAST(l + INTERVAL 15 MINUTE AS VARCHAR) AS alarm_at, n AS n_heartbeats
FROM s, m WHERE l + INTERVAL 15 MINUTE <= date_trunc('milliseconds', mx) - INTERVAL 2 MINUTE""")
def _(spark, d):
    beats = stream_view(spark, d, "heartbeats")
    # all nodes stop, the clock goes on for a day: every node's last silence must be an alarm too
    clock = stream_view(spark, d, "heartbeats").selectExpr("timestamp + INTERVAL 1 DAY AS timestamp")
    return _drained(spark, "outage", jobs.silence_alarms(beats, "15 minutes", "2 minutes", clock))


@query("stream_heartbeat_append", "S4 A4", """
WITH v AS (SELECT body, json_valid(body) AS ok, CASE WHEN json_valid(body) AND json_type(body) = 'OBJECT' THEN body END AS o FROM heartbeat_bodies)
SELECT CASE WHEN NOT ok THEN 'invalid_json' WHEN o IS NULL THEN 'invalid_heartbeat' ELSE 'accepted' END AS body_status,
  CASE WHEN o IS NOT NULL THEN coalesce(o->>'$.node_id', 'unknown') END AS node_id, count(*) AS n_rows FROM v GROUP BY 1, 2""")
def _(spark, d):
    table, checkpoint = jobs.job_dirs(spark, "heartbeats")
    jobs.heartbeat_append(stream_view(spark, d, "heartbeat_bodies"), table, checkpoint)
    return spark.read.parquet(table).groupBy("body_status", "node_id").agg(F.count(F.lit(1)).alias("n_rows"))


SILENCE = 5.0


@query("stream_total_outage", "X8", """
SELECT node_id, CAST(min(timestamp) AS VARCHAR) AS first_seen, CAST(max(timestamp) AS VARCHAR) AS last_seen, count(*) AS n_heartbeats,
  CAST(1 AS BIGINT) AS n_alarms FROM heartbeats WHERE node_id IS NOT NULL AND timestamp IS NOT NULL GROUP BY node_id""")
def _(spark, d):
    table, checkpoint = jobs.job_dirs(spark, "outage-watch")
    beats = stream_view(spark, d, "heartbeats")
    n_nodes = view(spark, d, "heartbeats").where("node_id IS NOT NULL AND timestamp IS NOT NULL").select("node_id").distinct().count()
    alarms = lambda: spark.read.schema(watches.ALARMS).parquet(table)
    # all nodes stop and nothing else runs: the job's own clock tells; a restart repeats no alarm
    query = watches.run_watch(watches.silence_watch(beats, SILENCE), table, checkpoint)
    watches.stop_when(query, lambda: bool(query.recentProgress) and alarms().count() >= n_nodes, 180)
    again = watches.run_watch(watches.silence_watch(beats, SILENCE), table, checkpoint)
    watches.stop_when(again, lambda: False, 2 * SILENCE)
    return alarms().groupBy("node_id").agg(
        F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"), F.sum("n_heartbeats").alias("n_heartbeats"),
        F.count(F.lit(1)).alias("n_alarms"))


BATCHES = 104


@query("stream_observed_ingest", "X9 G33", f"""
{VALID} SELECT count(*) AS received, count(*) FILTER (WHERE reason IS NULL) AS accepted, count(*) FILTER (WHERE reason IS NOT NULL) AS quarantined,
  count(*) FILTER (WHERE reason = 'parse_error') AS parse_errors, count(*) FILTER (WHERE reason IS NULL AND t = '') AS ts_substituted,
  count(*) AS stored_rows, count(*) FILTER (WHERE reason IS NOT NULL) AS stored_quarantined, CAST({BATCHES} AS BIGINT) AS n_batches FROM r""")
def _(spark, d):
    base = shared_dir(spark, "observed-ingest")
    lines = view(spark, d, "raw_lines").repartition(BATCHES, "event_id")
    lines.select("value").write.text(f"{base}/lines")
    table, checkpoint = jobs.job_dirs(spark, "observed-table")
    ledger = watches.BatchLedger(spark, "ingest", f"{base}/ledger")
    source = jobs.text_source(spark, f"{base}/lines", max_files=1)
    watches.run_observed(watches.observed_ingest(ingest.validate_rows(source)), table, checkpoint, ledger, ("target",))
    counts = [c for c in ("received", "accepted", "quarantined", "parse_errors", "ts_substituted")]
    seen = ledger.read().agg(*[F.sum(c).alias(c) for c in counts], F.count(F.lit(1)).alias("n_batches"))
    stored = spark.read.parquet(table).agg(
        F.count(F.lit(1)).alias("stored_rows"), F.count_if(F.col("target") == "quarantine").alias("stored_quarantined"))
    return seen.crossJoin(F.broadcast(stored))  # one row each


@query("stream_collapsed_tail", "A17 X9 G19", """
SELECT count(*) FILTER (WHERE event_id % 13 <> 0) AS n_groups, count(*) FILTER (WHERE event_id % 13 = 0) AS parse_errors,
  CAST(coalesce(sum(event_id % 5) FILTER (WHERE event_id % 13 <> 0), 0) AS BIGINT) AS total_count,
  count(*) AS stored_rows, CAST(coalesce(sum(event_id % 7) FILTER (WHERE event_id % 13 <> 0), 0) AS BIGINT) AS total_span_ms FROM events""")
def _(spark, d):
    base = shared_dir(spark, "collapsed-tail")
    line = F.when(F.col("event_id") % 13 == 0, F.lit('{"count": 1, "vector_ingest_ts_first": "x"}')).otherwise(
        F.to_json(F.struct((F.col("event_id") % 5).alias("count"), F.col("event_id").alias("vector_ingest_ts_first"),
                           (F.col("event_id") + F.col("event_id") % 7).alias("vector_ingest_ts_last"))))
    load(spark, d, "events").repartition(12, "event_id").select(line.alias("value")).write.text(f"{base}/lines")
    table, checkpoint = jobs.job_dirs(spark, "collapsed-table")
    ledger = watches.BatchLedger(spark, "tail", f"{base}/ledger", flush=5)
    lines = jobs.text_source(spark, f"{base}/lines", max_files=1)
    watches.run_observed(watches.collapsed_tail(lines), table, checkpoint, ledger)
    seen = ledger.read().agg(*[F.sum(c).alias(c) for c in ("n_groups", "parse_errors", "total_count")])
    span = F.coalesce(F.sum(F.col("wait_upper_ms") - F.col("wait_lower_ms")), F.lit(0)).cast("bigint")
    stored = spark.read.parquet(table).agg(F.count(F.lit(1)).alias("stored_rows"), span.alias("total_span_ms"))
    return seen.crossJoin(F.broadcast(stored))  # one row each


LATENESS = 86400
#: The delivery that brings an event: five days each, every seventh event two deliveries later.
_DELIVERY = "CAST(floor((day(timestamp) - 1) / 5) AS BIGINT) + CASE WHEN event_id % 7 = 0 THEN 2 ELSE 0 END"


def _deliveries(spark, d):
    """The ledger job, started anew from its checkpoint for every delivery."""
    base, checkpoint = jobs.job_dirs(spark, "burst-ledger")
    events = view(spark, d, "threat_events").withColumn("delivery", F.expr(_DELIVERY))
    schema = events.drop("delivery").schema
    for n in range(9):
        part = events.where(F.col("delivery") == n).drop("delivery")
        part.write.parquet(f"{base}/in/delivery={n}")
        source = spark.readStream.schema(schema).parquet(f"{base}/in/*")
        watches.burst_ledger(source, f"{base}/out", checkpoint, GAP, LATENESS)
    return f"{base}/out"


@query("stream_late_bursts", "X2 X1", f"""
WITH {BURSTS} SELECT sensor_id, event_type, CAST(first_ts AS VARCHAR) AS first_ts, CAST(last_ts AS VARCHAR) AS timestamp, count, severity, raw_rows FROM bursts""")
def _(spark, d):
    return watches.ledger_bursts(spark, _deliveries(spark, d), GAP).drop("origin")


@query("late_rows", "X2", f"""
WITH e AS (SELECT *, {_DELIVERY} AS delivery FROM threat_events),
m AS (SELECT delivery, max(max(timestamp)) OVER (ORDER BY delivery ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM e GROUP BY delivery)
SELECT event_id, sensor_id FROM e JOIN m USING (delivery) WHERE timestamp < before - INTERVAL {LATENESS} SECOND""")
def _(spark, d):
    return watches.late_table(spark, _deliveries(spark, d)).select("event_id", "sensor_id")


@query("verified_day_export", "S7 S5", """
SELECT CAST(CAST(timestamp AS DATE) AS VARCHAR) AS backup_date, 'central' AS node_id, 'threat_events' AS table_name, 'success' AS status,
  count(*) AS row_count, '' AS error_message, '2024-02-01 00:00:00' AS created_at FROM threat_events GROUP BY 1""")
def _(spark, d):
    base = shared_dir(spark, "export")
    status = tables.verified_export(view(spark, d, "threat_events"), f"{base}/days")
    for _ in range(2):  # a retried run adds nothing
        tables.append_ledger(tables.ledger_rows(status, "central", "threat_events", datetime(2024, 2, 1)), f"{base}/ledger", "r1")
    return spark.read.parquet(f"{base}/ledger").drop("run_id")


@query("export_day_by_day", "S7", """
SELECT CAST(CAST(timestamp AS DATE) AS VARCHAR) AS day, count(*) AS n_rows, 'success' AS status FROM threat_events GROUP BY 1""")
def _(spark, d):
    base = shared_dir(spark, "export")
    ev = view(spark, d, "threat_events")
    even = F.dayofmonth("timestamp") % 2 == 0
    both = [tables.verified_export(ev.where(part), base) for part in (even, ~even)]  # two runs, other days each
    stored = spark.read.parquet(base).groupBy(F.col("file_day").alias("day")).agg(F.count(F.lit(1)).alias("n_rows"))
    return stored.join(both[0].unionByName(both[1]).select("day", "status"), "day", "full_outer")


@query("routes_expire", "S11 S1", """
WITH t AS (SELECT *, CASE WHEN inject_id <> '' THEN 'threat_events_experiment' ELSE 'threat_events' END AS target,
  CAST(timestamp AS DATE) AS d, max(CAST(timestamp AS DATE)) OVER () AS mx FROM threat_events)
SELECT target, CAST(d AS VARCHAR) AS event_date, count(*) AS n_rows FROM t
WHERE d >= mx - CAST(CASE WHEN target = 'threat_events' THEN 20 ELSE 3 END AS INTEGER) GROUP BY 1, 2""")
def _(spark, d):
    base = shared_dir(spark, "routes")
    ev = view(spark, d, "threat_events")
    ready = ev.select(
        "*", retention.route(F.col("inject_id")).alias("target"), F.lit(None).cast("string").alias("reason"),
        F.lit(False).alias("ts_substituted"), F.col("timestamp").alias("ingest_ts"), F.lit(None).cast("string").alias("value"))
    for batch in range(2):
        tables.append_routes(ready.where(F.col("event_id") % 2 == batch), batch, base)
    days = [r[0] for r in ev.select(F.to_date("timestamp")).distinct().collect()]
    tables.compact_days(spark, tables.route_path(base, "threat_events"), days, 1)
    tables.expire_routes(spark, base, max(days), {"threat_events": 20, "threat_events_experiment": 3})
    left = [tables.read_route(spark, base, t).withColumn("target", F.lit(t)) for t in tables.ROUTES[:2]]
    return left[0].unionByName(left[1]).groupBy("target", "event_date").agg(F.count(F.lit(1)).alias("n_rows"))


@query("synthetic_cleanup", "S8", """
SELECT CAST(CAST(timestamp AS DATE) AS VARCHAR) AS event_date, count(*) FILTER (WHERE inject_id = '') AS table_rows,
  count(*) FILTER (WHERE inject_id <> '') AS exported_rows FROM threat_events GROUP BY 1""")
def _(spark, d):
    base = shared_dir(spark, "cleanup")
    ev = view(spark, d, "threat_events").withColumn("event_date", F.to_date("timestamp"))
    odd = F.col("event_id") % 2 == 1
    for run, part in (("first", odd), ("second", ~odd)):  # tagged rows of a second run join the first ones
        ev.where(part).write.mode("append").partitionBy("event_date").parquet(f"{base}/table")
        tables.cleanup_synthetic(f"{base}/table", f"{base}/exported", spark, run)
    left = spark.read.parquet(f"{base}/table").groupBy("event_date").agg(F.count(F.lit(1)).alias("table_rows"))
    out = spark.read.parquet(f"{base}/exported").groupBy("event_date").agg(F.count(F.lit(1)).alias("exported_rows"))
    return left.join(out, "event_date", "full_outer").select(
        "event_date", F.coalesce("table_rows", F.lit(0)).alias("table_rows"), F.coalesce("exported_rows", F.lit(0)).alias("exported_rows"))


@query("feature_csv_export", "S9 S10", """
SELECT CAST(date_trunc('minute', timestamp) AS VARCHAR) AS window_start, count(*) AS event_count FROM documents_in GROUP BY 1""")
def _(spark, d):
    base = shared_dir(spark, "feature-csv")
    tables.write_feature_csv(ft.document_windows(view(spark, d, "documents_in")), f"{base}/csv")
    rows = spark.read.option("header", True).schema("window_start TIMESTAMP, event_count BIGINT").csv(f"{base}/csv")
    tables.write_json(rows, f"{base}/json")
    return spark.read.schema(rows.schema).json(f"{base}/json")


@query("purged_indices", "S12 S13", """
WITH m AS (SELECT strftime(o_orderdate, '%Y.%m') AS index_month, count(*) AS n FROM orders GROUP BY 1)
SELECT index_month, CASE WHEN index_month < '1995.01' THEN 0 ELSE n END AS rows_left,
  CASE WHEN index_month < '1995.01' THEN 'success' END AS purge_status FROM m""")
def _(spark, d):
    base = shared_dir(spark, "months")
    orders = load(spark, d, "orders")
    tables.write_monthly(orders, f"{base}/months", "o_orderdate")
    tables.purge_months(spark, f"{base}/months", "1995.01", "central", datetime(2024, 2, 1), f"{base}/ledger")
    months = orders.select(F.date_format("o_orderdate", "yyyy.MM").alias("index_month")).distinct()
    left = tables.read_monthly(spark, f"{base}/months").groupBy("index_month").agg(F.count(F.lit(1)).alias("rows_left"))
    done = spark.read.parquet(f"{base}/ledger").select(
        F.substring_index("table_name", "-", -1).alias("index_month"), F.col("status").alias("purge_status"))
    return months.join(left, "index_month", "left").join(done, "index_month", "left").select(
        "index_month", F.coalesce("rows_left", F.lit(0)).alias("rows_left"), "purge_status")


@query("health_ledger_append", "S6", """
SELECT CAST(date_trunc('hour', timestamp) AS VARCHAR) AS checked_at, count(*) AS events_last_hour,
  count(DISTINCT sensor_id) AS unique_sensors FROM threat_events GROUP BY date_trunc('hour', timestamp)""")
def _(spark, d):
    path = shared_dir(spark, "health")
    tables.append_ledger(monitor.health_history(view(spark, d, "threat_events")), path, "r1")
    return spark.read.parquet(path).drop("run_id")
