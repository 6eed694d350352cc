"""Registered queries: sent-versus-recorded reconciliation."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from gapspark.functions import parsing
from gapspark.operators import reconcile
from gapspark.registry import query
from gapspark.session import shared_dir
from gapspark.sinks.files import write_texts
from gapspark.sources import guarded, send_logs
from gapspark.sources.driver_tables import view

SENT = """
s AS (SELECT DISTINCT CASE WHEN target LIKE 'http://%' THEN regexp_extract(target, '^http://([^:/]+)', 1) ELSE split_part(target, ':', 1) END AS host,
  inject_id FROM inject_log WHERE coalesce(sent_ok, '1') = '1'),
b AS (SELECT date_trunc('second', min(timestamp)) AS lo, date_trunc('second', max(timestamp)) + INTERVAL 10 MINUTE AS hi
  FROM inject_log WHERE coalesce(sent_ok, '1') = '1'),
r AS (SELECT DISTINCT inject_id FROM recorded_rows, b WHERE inject_id <> '' AND timestamp >= lo AND timestamp <= hi)
"""


def _inputs(spark, d):
    log = view(spark, d, "inject_log")
    lo, hi = log.where(F.coalesce("sent_ok", F.lit("1")) == "1").agg(
        F.min("timestamp").cast("string"), F.max("timestamp").cast("string")).first()
    recorded = reconcile.recorded_ids(
        view(spark, d, "recorded_rows"), datetime.fromisoformat(lo), datetime.fromisoformat(hi))
    return reconcile.sent_ids(log), recorded


def _systems(spark):
    return spark.range(2).select(
        F.when(F.col("id") == 0, "proposed").otherwise("baseline").alias("system"),
        F.when(F.col("id") == 0, "proposed").otherwise("baseline").alias("host"),
        F.lit(False).alias("verification_failed"))


REPORT = """
c AS (SELECT host AS system, count(*) AS total_injected, count(r.inject_id) AS total_recorded FROM s LEFT JOIN r USING (inject_id) GROUP BY host)
"""


@query("sent_vs_recorded", "J1 J2 A7 B7 B16 B19", f"""
WITH {SENT}, {REPORT}
SELECT system, total_injected, total_recorded, total_injected - total_recorded AS total_lost,
  round(100.0 * (total_injected - total_recorded) / total_injected, 4) AS loss_rate_percent, false AS verification_failed,
  CASE WHEN total_injected = total_recorded THEN 'OK' ELSE 'DATA LOSS' END AS status FROM c""")
def _(spark, d):
    sent, recorded = _inputs(spark, d)
    return reconcile.loss_report(sent, recorded, _systems(spark))


@query("unverified_loss_report", "A8 B18 B19", f"""
WITH {SENT}, {REPORT}
SELECT system, total_injected, total_recorded, total_injected - total_recorded AS total_lost,
  round(100.0 * (total_injected - total_recorded) / total_injected, 4) AS loss_rate_percent, system = 'baseline' AS verification_failed,
  CASE WHEN system = 'baseline' THEN 'UNVERIFIED' WHEN total_injected = total_recorded THEN 'OK' ELSE 'DATA LOSS' END AS status FROM c""")
def _(spark, d):
    sent, recorded = _inputs(spark, d)
    base = shared_dir(spark, "exports")
    for system in ("proposed", "baseline"):
        recorded.write.parquet(f"{base}/{system}")
    # one file of the baseline's export broke off while it was written
    write_texts(spark.range(1).select(F.lit("baseline/part-broken.parquet").alias("path"), F.lit("PAR1 and no end").alias("content")), base)
    rows, states = guarded.guarded_sources(spark, {s: f"{base}/{s}" for s in ("proposed", "baseline")}, recorded.schema)
    failed = states.select("system", (F.col("source_status") != "ok").alias("verification_failed"))
    systems = _systems(spark).drop("verification_failed").join(failed, "system")
    return reconcile.loss_report(sent, rows.select(*recorded.columns).distinct(), systems)


@query("export_read_status", "A8", f"""
WITH {SENT}, n AS (SELECT count(*) AS n FROM r)
SELECT 'whole' AS system, 'ok' AS source_status, n AS n_rows, CAST(0 AS BIGINT) AS n_unreadable FROM n UNION ALL SELECT 'broken', 'unreadable', n, 1 FROM n
UNION ALL SELECT 'absent', 'missing', 0, 0 UNION ALL SELECT 'empty', 'ok', 0, 0""")
def _(spark, d):
    _, recorded = _inputs(spark, d)
    base = shared_dir(spark, "exports")
    for system in ("whole", "broken"):
        recorded.write.parquet(f"{base}/{system}")
    recorded.limit(0).write.parquet(f"{base}/empty")
    write_texts(spark.range(1).select(F.lit("broken/part-broken.parquet").alias("path"), F.lit("").alias("content")), base)
    _, states = guarded.guarded_sources(
        spark, {s: f"{base}/{s}" for s in ("whole", "broken", "absent", "empty")}, recorded.schema)
    return states.select("system", "source_status", "n_rows", "n_unreadable")


@query("lost_ids", "J1 U2", f"WITH {SENT} SELECT host, inject_id FROM s ANTI JOIN r USING (inject_id)")
def _(spark, d):
    return reconcile.lost_ids(*_inputs(spark, d))


@query("found_ids", "J1", f"WITH {SENT} SELECT host, inject_id FROM s SEMI JOIN r USING (inject_id)")
def _(spark, d):
    return reconcile.found_ids(*_inputs(spark, d))


@query("common_ids", "U2", f"WITH {SENT} SELECT inject_id FROM s INTERSECT SELECT inject_id FROM r")
def _(spark, d):
    return reconcile.common_ids(*_inputs(spark, d))


@query("distinct_targets", "U5", "SELECT DISTINCT target, event_type FROM inject_log")
def _(spark, d):
    return view(spark, d, "inject_log").select("target", "event_type").distinct()


@query("send_ranges", "A6", """
SELECT target, count(DISTINCT inject_id) AS n_ids, CAST(min(timestamp) AS VARCHAR) AS ts_min, CAST(max(timestamp) AS VARCHAR) AS ts_max
FROM inject_log WHERE coalesce(sent_ok, '1') = '1' GROUP BY target""")
def _(spark, d):
    return reconcile.sent_ranges(view(spark, d, "inject_log"))


@query("sent_per_host", "G34", """
SELECT CASE WHEN target LIKE 'http://%' THEN regexp_extract(target, '^http://([^:/]+)', 1) ELSE split_part(target, ':', 1) END AS host,
  count(*) AS n_sent FROM inject_log WHERE coalesce(sent_ok, '1') = '1' GROUP BY 1""")
def _(spark, d):
    return view(spark, d, "inject_log").where(F.coalesce("sent_ok", F.lit("1")) == "1").groupBy(
        parsing.host_of(F.col("target")).alias("host")).agg(F.count(F.lit(1)).alias("n_sent"))


@query("end_to_end_verdict", "B28", f"""
WITH {SENT}, {REPORT}, l AS (SELECT system, round(100.0 * (total_injected - total_recorded) / total_injected, 4) AS x FROM c)
SELECT max(x) FILTER (WHERE system = 'proposed') AS primary_loss, max(x) FILTER (WHERE system = 'baseline') AS other_loss,
  CASE WHEN max(x) FILTER (WHERE system = 'proposed') = 0 AND max(x) FILTER (WHERE system = 'baseline') IS NOT NULL THEN 'PASS' ELSE 'FAIL' END AS verdict FROM l""")
def _(spark, d):
    sent, recorded = _inputs(spark, d)
    return reconcile.end_to_end(reconcile.loss_report(sent, recorded, _systems(spark)))


@query("reconciliation_bounds", "B7", """
SELECT target, CAST(date_trunc('second', min(timestamp)) AS VARCHAR) AS lower_bound,
  CAST(date_trunc('second', max(timestamp)) + INTERVAL 10 MINUTE AS VARCHAR) AS upper_bound FROM inject_log GROUP BY target""")
def _(spark, d):
    spans = view(spark, d, "inject_log").groupBy("target").agg(F.min("timestamp").alias("a"), F.max("timestamp").alias("b"))
    lo, hi = parsing.utc_bounds(F.col("a"), F.col("b"))
    return spans.select("target", lo.alias("lower_bound"), hi.alias("upper_bound"))


@query("merged_send_logs", "A20 A6", """
SELECT concat('edge', CAST(o_orderkey % 4 AS VARCHAR)) AS edge, count(*) AS n_rows,
  count(DISTINCT o_orderkey) AS n_ids, CAST(min(o_orderdate) AS VARCHAR) AS ts_min, CAST(max(o_orderdate) AS VARCHAR) AS ts_max
FROM orders WHERE o_orderkey % 50 <> 0 GROUP BY 1""")
def _(spark, d):
    paths = send_logs.write_edge_logs(view(spark, d, "inject_log"), edges=4)
    merged = send_logs.read_send_logs(spark, paths)
    return merged.where(F.coalesce("sent_ok", F.lit("1")) == "1").groupBy("edge").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_distinct("inject_id").alias("n_ids"),
        F.min("timestamp").alias("ts_min"), F.max("timestamp").alias("ts_max"))
