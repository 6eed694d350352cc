"""Registered queries: heartbeat coverage, gap intervals, ledger gaps, backup decisions."""

from __future__ import annotations

from pyspark.sql import functions as F

from gapspark.operators import coverage, ledger, monitor
from gapspark.registry import query
from gapspark.sources.driver_tables import view

SLOTS = """
m AS (SELECT node_id, date_trunc('minute', timestamp) AS minute, count(*) AS n FROM heartbeats GROUP BY 1, 2),
w AS (SELECT node_id, min(minute) AS f, min(minute) + INTERVAL 129599 MINUTE AS l FROM m GROUP BY 1),
cal AS (SELECT node_id, unnest(generate_series(f, l, INTERVAL 1 MINUTE)) AS minute FROM w),
miss AS (SELECT c.node_id, c.minute FROM cal c ANTI JOIN m ON m.node_id = c.node_id AND m.minute = c.minute),
r AS (SELECT node_id, minute, minute - to_minutes(row_number() OVER (PARTITION BY node_id ORDER BY minute)) AS g FROM miss),
isl AS (SELECT node_id, min(minute) AS gap_start, max(minute) AS gap_end, count(*) AS gap_minutes FROM r GROUP BY node_id, g)
"""


@query("heartbeat_coverage", "G10 A12", f"""
WITH {SLOTS},
c AS (SELECT m.node_id, min(f) AS slot_first, min(l) AS slot_last,
  CAST(coalesce(sum(n) FILTER (WHERE minute <= l), 0) AS BIGINT) AS rows_in_window,
  CAST(coalesce(sum(n) FILTER (WHERE minute > l), 0) AS BIGINT) AS rows_after,
  CAST(coalesce(sum(n - 1) FILTER (WHERE minute <= l AND n > 1), 0) AS BIGINT) AS duplicate_extra_rows
  FROM m JOIN w ON m.node_id = w.node_id GROUP BY 1),
s AS (SELECT node_id, count(*) AS missing_slots FROM miss GROUP BY 1),
g AS (SELECT node_id, count(*) AS n_gaps, max(gap_minutes) AS longest_gap_minutes FROM isl GROUP BY 1)
SELECT c.node_id, CAST(slot_first AS VARCHAR) AS slot_first, CAST(slot_last AS VARCHAR) AS slot_last,
  rows_in_window, 129600 - coalesce(missing_slots, 0) AS covered_slots, coalesce(missing_slots, 0) AS missing_slots,
  round(100 * (1 - coalesce(missing_slots, 0) / 129600), 6) AS coverage_percent,
  round(100 * rows_in_window / 129600, 6) AS row_ratio_percent, rows_after, duplicate_extra_rows,
  coalesce(n_gaps, 0) AS n_gaps, coalesce(longest_gap_minutes, 0) AS longest_gap_minutes
FROM c LEFT JOIN s USING (node_id) LEFT JOIN g USING (node_id)""")
def _(spark, d):
    return coverage.heartbeat_coverage(view(spark, d, "heartbeats"))


@query("missing_heartbeat_slots", "J5 U4", f"""
WITH {SLOTS} SELECT node_id, CAST(minute AS VARCHAR) AS minute FROM miss""")
def _(spark, d):
    return coverage.missing_slots(view(spark, d, "heartbeats"))


@query("missing_slot_islands", "W3 G11", f"""
WITH {SLOTS} SELECT node_id, CAST(gap_start AS VARCHAR) AS gap_start, CAST(gap_end AS VARCHAR) AS gap_end, gap_minutes FROM isl""")
def _(spark, d):
    return coverage.islands(coverage.missing_slots(view(spark, d, "heartbeats")))


@query("gap_intervals", "G11", f"""
WITH {SLOTS} SELECT node_id, CAST(gap_start AS VARCHAR) AS gap_start, CAST(gap_end AS VARCHAR) AS gap_end, gap_minutes FROM isl""")
def _(spark, d):
    return coverage.gap_intervals(view(spark, d, "heartbeats"))


@query("backup_log_gaps", "W1", """
WITH n AS (SELECT node_id, created_at, lead(created_at) OVER (PARTITION BY node_id ORDER BY created_at) AS nx
  FROM backup_log WHERE table_name = 'results_sync')
SELECT node_id, CAST(created_at AS VARCHAR) AS gap_start, CAST(nx AS VARCHAR) AS gap_end,
  date_diff('minute', created_at, nx) AS gap_minutes FROM n WHERE date_diff('minute', created_at, nx) > 480""")
def _(spark, d):
    return ledger.backup_log_gaps(view(spark, d, "backup_log"))


@query("health_snapshot_gaps", "W2", """
WITH n AS (SELECT created_at, lead(created_at) OVER (ORDER BY created_at) AS nx FROM backup_log WHERE table_name = 'pipeline_health')
SELECT CAST(created_at AS VARCHAR) AS gap_start, CAST(nx AS VARCHAR) AS gap_end,
  date_diff('minute', created_at, nx) AS gap_minutes FROM n WHERE date_diff('minute', created_at, nx) > 120""")
def _(spark, d):
    log = view(spark, d, "backup_log").where("table_name = 'pipeline_health'")
    return ledger.health_gaps(log.select(F.col("created_at").alias("checked_at")))


@query("latest_backup_status", "G22", """
SELECT table_name, CAST(backup_date AS VARCHAR) AS backup_date,
  arg_max(status, (created_at, status, row_count)) AS status,
  arg_max(row_count, (created_at, status, row_count)) AS row_count,
  CAST(max(created_at) AS VARCHAR) AS created_at FROM backup_log GROUP BY table_name, backup_date""")
def _(spark, d):
    return ledger.latest_status(view(spark, d, "backup_log"))


@query("catch_up_days", "J8 K4", """
WITH t AS (SELECT max(backup_date) AS today FROM backup_log),
e AS (SELECT today - CAST(i AS INT) AS backup_date, tn AS table_name FROM t, range(2, 15) r(i),
  (VALUES ('threat_events'), ('pipeline_health'), ('heartbeats')) v(tn)),
g AS (SELECT table_name, backup_date, arg_max(status, (created_at, status, row_count)) AS st FROM backup_log, t
  WHERE backup_date >= today - 14 GROUP BY 1, 2),
n AS (SELECT table_name, backup_date, row_number() OVER (PARTITION BY table_name ORDER BY backup_date DESC) AS attempt,
  greatest(count(*) OVER (PARTITION BY table_name) - 7, 0) AS remaining
  FROM e WHERE NOT EXISTS (SELECT 1 FROM g WHERE g.table_name = e.table_name AND g.backup_date = e.backup_date AND st = 'success'))
SELECT table_name, CAST(backup_date AS VARCHAR) AS backup_date, attempt, remaining FROM n WHERE attempt <= 7""")
def _(spark, d):
    return ledger.catch_up_days(view(spark, d, "backup_log"))


@query("dates_not_yet_pruned", "J4 G22", """
WITH t AS (SELECT max(backup_date) AS today FROM backup_log)
SELECT CAST(backup_date AS VARCHAR) AS backup_date, arg_max(row_count, (created_at, row_count)) AS backed_rows
FROM backup_log, t WHERE table_name = 'threat_events' AND status = 'success' AND backup_date <= today - 7
AND backup_date NOT IN (SELECT backup_date FROM backup_log WHERE table_name = 'threat_events_local_prune' AND status = 'success')
GROUP BY backup_date""")
def _(spark, d):
    return ledger.not_yet_pruned(view(spark, d, "backup_log"))


PRUNE = """
WITH t AS (SELECT max(backup_date) AS today FROM backup_log),
s AS (SELECT CAST(l_shipdate AS DATE) AS day, count(*) * 100 AS n FROM lineitem GROUP BY 1),
b AS (SELECT backup_date, arg_max(row_count, (created_at, row_count)) AS b FROM backup_log, t
  WHERE table_name = 'threat_events' AND status = 'success' AND backup_date <= today - 7
  AND backup_date NOT IN (SELECT backup_date FROM backup_log WHERE table_name = 'threat_events_local_prune' AND status = 'success')
  GROUP BY 1)
"""


def _stored(spark, d):
    from gapspark.sources.driver_tables import load
    return monitor.rows_per_day(load(spark, d, "lineitem"), "l_shipdate").withColumn(
        "n_rows", F.col("n_rows") * 100)


@query("prune_decisions", "J9", PRUNE + """
SELECT CAST(backup_date AS VARCHAR) AS backup_date, coalesce(n, 0) AS stored_rows, b AS backed_rows,
  CASE WHEN coalesce(n, 0) = 0 THEN 'skip' WHEN n <= b THEN 'delete' ELSE 're_export' END AS decision
FROM b LEFT JOIN s ON s.day = b.backup_date""")
def _(spark, d):
    return ledger.prune_decisions(view(spark, d, "backup_log"), _stored(spark, d))


@query("prune_after_reexport", "J9", PRUNE + """
SELECT CAST(backup_date AS VARCHAR) AS backup_date, coalesce(n, 0) AS stored_rows, b AS backed_rows,
  CASE WHEN coalesce(n, 0) = 0 THEN 'skip' WHEN n <= b THEN 'delete'
       WHEN day(backup_date) % 2 = 0 THEN 'delete' ELSE 'keep' END AS decision
FROM b LEFT JOIN s ON s.day = b.backup_date""")
def _(spark, d):
    stored = _stored(spark, d)
    again = stored.select("day", F.when(F.day("day") % 2 == 0, F.col("n_rows")).otherwise(
        F.col("n_rows") - 1).alias("backed_rows"))
    return ledger.prune_decisions(view(spark, d, "backup_log"), stored, reexported=again)
