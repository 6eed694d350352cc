"""Registered queries: operational reports, filters, retention."""

from __future__ import annotations

from pyspark.sql import functions as F

from gapspark.functions.labels import empty_to_unknown
from gapspark.operators import filters, monitor, retention
from gapspark.registry import query
from gapspark.session import shared_dir
from gapspark.sinks.files import write_texts
from gapspark.sources import guarded
from gapspark.sources.driver_tables import load, view

CLEAN = ("inject_id = '' AND sensor_id NOT IN ('203.0.113.10','203.0.113.11') "
         "AND sensor_id NOT IN ('','unknown')")


@query("recent_events", "K1 B10", """
SELECT CAST(timestamp AS VARCHAR) AS timestamp, sensor_id, event_type,
  CAST(severity AS BIGINT) AS severity, count
FROM threat_events WHERE timestamp >= (SELECT max(timestamp) FROM threat_events) - INTERVAL 24 HOUR
ORDER BY timestamp DESC, sensor_id, event_type, severity, count LIMIT 20""")
def _(spark, d):
    return monitor.recent_events(view(spark, d, "threat_events"))


@query("event_type_summary", "G2 B10", """
SELECT event_type, count(*) AS total, CAST(max(severity) AS BIGINT) AS max_severity
FROM threat_events WHERE timestamp >= (SELECT max(timestamp) FROM threat_events) - INTERVAL 240 HOUR
GROUP BY event_type""")
def _(spark, d):
    return monitor.event_type_summary(view(spark, d, "threat_events"), hours=240)


@query("top_sensors", "G3 K2", """
SELECT sensor_id, CAST(sum(count) AS BIGINT) AS total FROM threat_events
WHERE timestamp >= (SELECT max(timestamp) FROM threat_events) - INTERVAL 240 HOUR
GROUP BY sensor_id ORDER BY total DESC, sensor_id LIMIT 10""")
def _(spark, d):
    return monitor.top_sensors(view(spark, d, "threat_events"), hours=240)


@query("health_checks", "G4", """
WITH a AS (SELECT max(timestamp) AS as_of FROM threat_events),
s AS (SELECT count_if(timestamp >= as_of - INTERVAL 5 MINUTE) AS r,
  count(DISTINCT CASE WHEN timestamp >= as_of - INTERVAL 1 HOUR THEN sensor_id END) AS n,
  max(timestamp) AS t FROM threat_events, a)
SELECT 'rows_last_5_minutes' AS "check", CAST(r AS VARCHAR) AS value, CASE WHEN r > 0 THEN 'OK' ELSE 'NG' END AS status FROM s
UNION ALL SELECT 'sensors_last_hour', CAST(n AS VARCHAR), CASE WHEN n > 0 THEN 'OK' ELSE 'NG' END FROM s
UNION ALL SELECT 'latest_event', CAST(t AS VARCHAR), CASE WHEN t IS NOT NULL THEN 'OK' ELSE 'NG' END FROM s""")
def _(spark, d):
    return monitor.health_checks(view(spark, d, "threat_events"))


@query("clean_daily_counts", "G5 B8 B9 K3", f"""
SELECT CAST(CAST(timestamp AS DATE) AS VARCHAR) AS day, CAST(sum(count) AS BIGINT) AS total_count
FROM threat_events WHERE {CLEAN} AND timestamp >= TIMESTAMP '2024-01-02' AND timestamp < TIMESTAMP '2024-01-30'
AND NOT (timestamp >= TIMESTAMP '2024-01-07' AND timestamp < TIMESTAMP '2024-01-13') GROUP BY 1""")
def _(spark, d):
    return monitor.clean_daily_counts(
        view(spark, d, "threat_events"), "2024-01-02", "2024-01-30", ("2024-01-07", "2024-01-13"))


@query("clean_events_by_sensor", "B8", f"""
SELECT sensor_id, event_type, count(*) AS n_rows, CAST(sum(count) AS BIGINT) AS total
FROM threat_events WHERE {CLEAN} GROUP BY 1, 2""")
def _(spark, d):
    return filters.clean_events(view(spark, d, "threat_events")).groupBy("sensor_id", "event_type").agg(
        F.count(F.lit(1)).alias("n_rows"), F.sum("count").alias("total"))


@query("exclude_known_nodes", "J3", """
SELECT sensor_id, count(*) AS n_rows FROM threat_events t
WHERE NOT EXISTS (SELECT 1 FROM known_nodes k WHERE k.ip = t.sensor_id) GROUP BY 1""")
def _(spark, d):
    return filters.exclude_known_nodes(
        view(spark, d, "threat_events"), view(spark, d, "known_nodes")
    ).groupBy("sensor_id").agg(F.count(F.lit(1)).alias("n_rows"))


@query("known_node_ids", "A16", """
SELECT DISTINCT ip FROM known_nodes WHERE ip <> ''
UNION ALL SELECT x FROM (VALUES ('203.0.113.10'), ('203.0.113.11')) v(x)
WHERE NOT EXISTS (SELECT 1 FROM known_nodes WHERE ip <> '')""")
def _(spark, d):
    return filters.known_node_ids(view(spark, d, "known_nodes"))


@query("known_node_ids_fallback", "A16", """
SELECT x AS ip FROM (VALUES ('203.0.113.10'), ('203.0.113.11')) v(x)
WHERE NOT EXISTS (SELECT 1 FROM known_nodes WHERE role = 'retired' AND ip <> '')""")
def _(spark, d):
    return filters.known_node_ids(view(spark, d, "known_nodes").where("role = 'retired'"))


@query("events_with_unreadable_nodes", "A16", """
SELECT CASE WHEN sensor_id IN ('203.0.113.10', '203.0.113.11') THEN 'own' ELSE 'other' END AS kind, 'unreadable' AS source_status, count(*) AS n_rows
FROM threat_events GROUP BY 1""")
def _(spark, d):
    nodes = view(spark, d, "known_nodes")
    base = shared_dir(spark, "nodes")
    nodes.write.parquet(f"{base}/known_nodes")
    write_texts(spark.range(1).select(F.lit("known_nodes/part-broken.parquet").alias("path"), F.lit("PAR1").alias("content")), base)
    ids, status = guarded.guarded_node_ids(spark, f"{base}/known_nodes", nodes.schema)
    events = view(spark, d, "threat_events")
    own = events.join(ids, F.col("sensor_id") == F.col("ip"), "left").select(F.when(F.col("ip").isNotNull(), "own").otherwise("other").alias("kind"))
    return own.groupBy("kind").agg(F.count(F.lit(1)).alias("n_rows")).withColumn("source_status", F.lit(status))


@query("parameterised_select", "A5", """
SELECT sensor_id, count(*) AS n_rows FROM threat_events
WHERE severity >= 3 AND event_type IN ('alert', 'ssh') GROUP BY sensor_id""")
def _(spark, d):
    return spark.sql(
        "SELECT sensor_id, count(*) AS n_rows FROM {events} "
        "WHERE severity >= :floor AND array_contains(:types, event_type) GROUP BY sensor_id",
        args={"floor": 3, "types": F.array(F.lit("alert"), F.lit("ssh"))},
        events=view(spark, d, "threat_events"),
    )


@query("health_snapshot", "G6 S6 J14", """
WITH a AS (SELECT max(timestamp) AS as_of FROM threat_events)
SELECT CAST(max(as_of) AS VARCHAR) AS checked_at, count(*) AS events_last_hour,
  count(DISTINCT sensor_id) AS unique_sensors,
  (SELECT count(*) FROM threat_events WHERE inject_id <> '') AS experiment_table_rows,
  (SELECT CAST(sum(strlen(sensor_id) + strlen(event_type) + strlen(inject_id) + 18) AS BIGINT)
   FROM threat_events WHERE inject_id <> '') AS experiment_table_bytes
FROM threat_events, a WHERE timestamp >= as_of - INTERVAL 1 HOUR""")
def _(spark, d):
    ev = view(spark, d, "threat_events")
    return monitor.health_snapshot(ev, ev.where("inject_id <> ''"))


@query("health_history", "G6", """
SELECT CAST(date_trunc('hour', timestamp) AS VARCHAR) AS checked_at, count(*) AS events_last_hour,
  count(DISTINCT sensor_id) AS unique_sensors FROM threat_events GROUP BY date_trunc('hour', timestamp)""")
def _(spark, d):
    return monitor.health_history(view(spark, d, "threat_events"))


@query("rows_per_day", "G25", """
SELECT CAST(CAST(timestamp AS DATE) AS VARCHAR) AS day, count(*) AS n_rows FROM threat_events GROUP BY 1""")
def _(spark, d):
    return monitor.rows_per_day(view(spark, d, "threat_events"))


@query("empty_source_to_unknown", "B2", """
SELECT CASE WHEN sensor_id = '' THEN 'unknown' ELSE sensor_id END AS sensor_id, count(*) AS n_rows
FROM threat_events GROUP BY 1""")
def _(spark, d):
    return view(spark, d, "threat_events").groupBy(
        empty_to_unknown(F.col("sensor_id")).alias("sensor_id")).agg(F.count(F.lit(1)).alias("n_rows"))


@query("retention_survivors", "S11", """
WITH a AS (SELECT max(timestamp) AS as_of FROM threat_events)
SELECT 'main' AS part, CAST(timestamp AS VARCHAR) AS timestamp, sensor_id FROM threat_events, a
WHERE inject_id = '' AND timestamp >= as_of - INTERVAL 20 DAY
UNION ALL SELECT 'experiment', CAST(timestamp AS VARCHAR), sensor_id FROM threat_events, a
WHERE inject_id <> '' AND timestamp >= as_of - INTERVAL 3 DAY""")
def _(spark, d):
    ev = view(spark, d, "threat_events")
    as_of = filters.latest(ev)
    main = retention.survivors(ev.where("inject_id = ''"), "timestamp", 20, as_of)
    side = retention.survivors(ev.where("inject_id <> ''"), "timestamp", 3, as_of)
    return main.select(F.lit("main").alias("part"), "timestamp", "sensor_id").unionByName(
        side.select(F.lit("experiment").alias("part"), "timestamp", "sensor_id"))


@query("route_split", "S1", """
SELECT CASE WHEN inject_id <> '' THEN 'threat_events_experiment' ELSE 'threat_events' END AS target,
  event_type, count(*) AS n_rows, CAST(sum(count) AS BIGINT) AS total FROM threat_events GROUP BY 1, 2""")
def _(spark, d):
    return view(spark, d, "threat_events").groupBy(
        retention.route(F.col("inject_id")).alias("target"), "event_type").agg(
        F.count(F.lit(1)).alias("n_rows"), F.sum("count").alias("total"))


@query("synthetic_cleanup_split", "S8", """
SELECT CAST(CAST(timestamp AS DATE) AS VARCHAR) AS day, count(*) FILTER (WHERE inject_id <> '') AS removed_rows,
  count(*) FILTER (WHERE inject_id = '') AS kept_rows FROM threat_events GROUP BY 1""")
def _(spark, d):
    return view(spark, d, "threat_events").groupBy(F.to_date("timestamp").alias("day")).agg(
        F.count_if(F.col("inject_id") != "").alias("removed_rows"),
        F.count_if(F.col("inject_id") == "").alias("kept_rows"))


@query("monthly_index_routing", "S13", """
SELECT concat('threat-events-', strftime(o_orderdate, '%Y.%m')) AS index_name, count(*) AS n_rows
FROM orders GROUP BY 1""")
def _(spark, d):
    return load(spark, d, "orders").groupBy(
        retention.month_index(F.col("o_orderdate")).alias("index_name")).agg(F.count(F.lit(1)).alias("n_rows"))


@query("tagged_union", "U1 A2 B25", """
SELECT traffic_class, sensor_id, count(*) AS n_rows, CAST(sum(count) AS BIGINT) AS total FROM (
  SELECT sensor_id, count, '' AS traffic_class FROM threat_events WHERE inject_id = ''
  UNION ALL SELECT sensor_id, count, 'synthetic' FROM threat_events WHERE inject_id <> '') GROUP BY 1, 2""")
def _(spark, d):
    ev = view(spark, d, "threat_events")
    tagged = ev.where("inject_id <> ''").withColumn("traffic_class", F.lit("synthetic"))
    flow = ev.where("inject_id = ''").unionByName(tagged, allowMissingColumns=True)
    return flow.groupBy(F.coalesce("traffic_class", F.lit("")).alias("traffic_class"), "sensor_id").agg(
        F.count(F.lit(1)).alias("n_rows"), F.sum("count").alias("total"))


@query("expired_partitions", "A18", """
WITH c AS (SELECT max(part_date) - 7 AS cutoff FROM partition_inventory)
SELECT CAST(part_date AS VARCHAR) AS part_date, count(*) AS n_parts
FROM partition_inventory, c WHERE part_date < cutoff GROUP BY part_date""")
def _(spark, d):
    return retention.older_than(view(spark, d, "partition_inventory"), "part_date", 7).groupBy(
        "part_date").agg(F.count(F.lit(1)).alias("n_parts"))


@query("drop_until_under", "K5", """
WITH days AS (SELECT part_date, CAST(sum(bytes) AS BIGINT) AS bytes FROM partition_inventory GROUP BY 1),
t AS (SELECT CAST(sum(bytes) AS BIGINT) AS total, max(part_date) AS latest FROM days),
r AS (SELECT part_date, bytes, CAST(coalesce(sum(bytes) OVER (ORDER BY part_date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS freed FROM days)
SELECT CAST(part_date AS VARCHAR) AS part_date, bytes, total - freed - bytes AS bytes_left FROM r, t
WHERE total - freed > 3000000000000 AND part_date < latest - 30""")
def _(spark, d):
    return retention.drop_until_under(
        view(spark, d, "partition_inventory"), F.lit(3_000_000_000_000), min_keep_days=30)


@query("store_size_gaps", "J17", """
SELECT store, reported_gb, actual_gb, actual_gb - reported_gb AS gap_gb,
  actual_gb - reported_gb >= 20 AS alert, actual_gb - reported_gb IS NULL AS unmeasured FROM store_sizes""")
def _(spark, d):
    sizes = view(spark, d, "store_sizes")
    joined = sizes.select("store", "reported_gb").join(sizes.select("store", "actual_gb"), "store", "full_outer")
    return retention.size_gaps(joined)


@query("export_ledger_status", "S7", """
WITH s AS (SELECT CAST(timestamp AS DATE) AS day, count(*) AS n FROM threat_events GROUP BY 1),
e AS (SELECT CAST(timestamp AS DATE) AS day, count(*) AS n FROM threat_events
  WHERE day(timestamp) % 7 <> 0 AND NOT (day(timestamp) % 5 = 0 AND severity = 4) GROUP BY 1)
SELECT CAST(s.day AS VARCHAR) AS day,
  CASE WHEN day(s.day) % 11 = 0 THEN 'export_failed' WHEN s.n = coalesce(e.n, 0) THEN 'success'
       WHEN e.n IS NULL THEN 'export_failed' ELSE 'upload_failed' END AS status,
  CASE WHEN day(s.day) % 11 <> 0 AND s.n = coalesce(e.n, 0) THEN s.n ELSE 0 END AS row_count,
  CASE WHEN day(s.day) % 11 = 0 THEN 'source count failed' WHEN s.n = coalesce(e.n, 0) THEN ''
       WHEN e.n IS NULL THEN 'export missing' ELSE 'row count mismatch' END AS error_message
FROM s LEFT JOIN e ON s.day = e.day""")
def _(spark, d):
    ev = view(spark, d, "threat_events")
    day = F.day("timestamp")
    exported = ev.where((day % 7 != 0) & ~((day % 5 == 0) & (F.col("severity") == 4)))
    source = monitor.rows_per_day(ev)
    failed = source.where(F.day("day") % 11 == 0)
    return retention.export_status(source, monitor.rows_per_day(exported), failed)
