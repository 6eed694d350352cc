"""Engine tables derived from the driver's Parquet tables.

Each view is a base table plus a list of column expressions. The expressions are plain SQL that
means the same in Spark and in DuckDB, so the oracle queries start from the same rows. Measured
values are whole numbers or halves, quarters, ... of them: such sums are exact in any order, so a
rounded mean never depends on the order of addition.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gapspark.session import use_utc

# Two columns of text per sensor event; concat and CASE only, so both engines build equal lines.
_RAW_LINE = """
CASE event_id % 29
 WHEN 0 THEN '{broken'
 WHEN 1 THEN concat('{"timestamp":"', {iso}, '","src_ip":"', {ip}, '","sensor_id":"', {ip}, '","event_type":"', event_type, '","severity":"high"}')
 WHEN 2 THEN concat('{"timestamp":"', {iso}, '","src_ip":"', {ip}, '","sensor_id":"', {ip}, '","event_type":"', event_type, '","alert":"not-an-object"}')
 WHEN 3 THEN concat('{"timestamp":"', {iso}, '","src_ip":"', {ip}, '","sensor_id":"', {ip}, '","event_type":"alert","alert":{"severity":2,"signature":"s"}}')
 WHEN 4 THEN concat('{"timestamp":"', {iso}, '","src_ip":"', {ip}, '","sensor_id":"', {ip}, '","event_type":"', event_type, '","severity":[1]}')
 WHEN 5 THEN concat('{"timestamp":"', {iso}, '","src_ip":"', {ip}, '","sensor_id":"', {ip}, '","event_type":"', event_type, '","severity":1,"count":"many"}')
 WHEN 6 THEN concat('{"src_ip":"', {ip}, '","sensor_id":"', {ip}, '","event_type":"', event_type, '","severity":2}')
 WHEN 7 THEN concat('{"timestamp":"', {iso}, '+0200","src_ip":"', {ip}, '","sensor_id":"', {ip}, '","event_type":"', event_type, '","severity":2,"count":2}')
 WHEN 8 THEN concat('{"timestamp":"', {iso}, '","src_ip":"', {ip}, '","sensor_id":"', {ip}, '","event_type":"', event_type, '","severity":2,"inject_id":null}')
 WHEN 9 THEN concat('{"timestamp":"', {iso}, '","src_ip":"","event_type":"', event_type, '","severity":4}')
 WHEN 10 THEN concat('{"timestamp":"', {iso}, '","src_ip":"', {ip}, '","sensor_id":"', {ip}, '","event_type":"', event_type, '","severity":2,"inject_id":"inj-', CAST(event_id AS STRING), '"}')
 ELSE concat('{"timestamp":"', {iso}, '","src_ip":"', {ip}, '","sensor_id":"', {ip}, '","event_type":"', event_type, '","severity":', CAST(1 + event_id % 4 AS STRING), '}')
END
""".replace("{iso}", "replace(CAST(ts AS STRING), ' ', 'T')").replace(
    "{ip}", "concat('198.51.100.', CAST(user_id AS STRING))")

_BODY = """
CASE event_id % 11
 WHEN 0 THEN '[]'
 WHEN 1 THEN '{bad'
 WHEN 2 THEN concat('[{"event_id":', CAST(event_id AS STRING), '},5]')
 WHEN 3 THEN CAST(event_id AS STRING)
 WHEN 4 THEN concat('[{"event_id":', CAST(event_id AS STRING), '},{"event_id":', CAST(event_id + 1 AS STRING), '}]')
 ELSE concat('{"event_id":', CAST(event_id AS STRING), '}')
END
"""

_HEARTBEAT_BODY = """
CASE event_id % 7
 WHEN 0 THEN concat('{"status":"ok","_received_at":', CAST(1704067200 + event_id AS STRING), '.75}')
 WHEN 1 THEN concat('{"node_id":"n', CAST(user_id % 5 AS STRING), '","_received_at":"', CAST(1704067200 + event_id AS STRING), '"}')
 WHEN 2 THEN concat('{"node_id":"n', CAST(user_id % 5 AS STRING), '","status":"ok","_received_at":"abc"}')
 WHEN 3 THEN '[1,2]'
 WHEN 4 THEN '{oops'
 ELSE concat('{"node_id":"n', CAST(user_id % 5 AS STRING), '","status":"degraded"}')
END
"""

# name -> (base table, column expressions)
VIEWS: dict[str, tuple[str, list[str]]] = {
    "threat_events": ("events", [
        "event_id", "ts AS timestamp",
        "CASE user_id % 50 WHEN 1 THEN '203.0.113.10' WHEN 2 THEN '203.0.113.11' WHEN 3 THEN '' "
        "WHEN 4 THEN 'unknown' ELSE concat('198.51.100.', CAST(user_id AS STRING)) END AS sensor_id",
        "CASE event_type WHEN 'error' THEN 'alert' WHEN 'click' THEN 'http' WHEN 'view' THEN 'flow' "
        "WHEN 'purchase' THEN 'tls' ELSE 'ssh' END AS event_type",
        "CAST(1 + event_id % 4 AS INT) AS severity",
        "CAST(1 + event_id % 3 AS BIGINT) AS count",
        "CASE WHEN event_id % 17 = 0 THEN concat('inj-', CAST(event_id AS STRING)) ELSE '' END AS inject_id",
    ]),
    "heartbeats": ("events", [
        "ts AS timestamp",
        "CASE WHEN event_id % 2 = 0 THEN 'proposed' ELSE 'baseline' END AS node_id",
        "'ok' AS status",
    ]),
    "raw_lines": ("events", ["event_id", "ts AS ingest_ts", f"{_RAW_LINE} AS value"]),
    "raw_bodies": ("events", ["event_id", "ts AS received_at", f"{_BODY} AS body"]),
    "heartbeat_bodies": ("events", ["event_id", "ts AS received_at", f"{_HEARTBEAT_BODY} AS body"]),
    "documents_in": ("events", [
        "ts AS timestamp",
        "CASE user_id % 4 WHEN 0 THEN 'Cowrie' WHEN 1 THEN 'Network' WHEN 2 THEN 'Malware' ELSE 'Other' END AS type",
        "CASE event_type WHEN 'error' THEN 'alert' WHEN 'click' THEN 'http' WHEN 'view' THEN 'flow' "
        "WHEN 'purchase' THEN 'tls' ELSE 'dns' END AS event_type",
        "CASE WHEN event_id % 5 = 0 THEN 22 ELSE 80 END AS dest_port",
        "CASE WHEN event_type = 'error' THEN CAST(1 + event_id % 3 AS INT) END AS alert_severity",
    ]),
    "source_ips": ("events", [
        "event_id",
        "concat(CAST((event_id * 7919) % 224 AS STRING), '.', CAST(user_id % 256 AS STRING), '.', "
        "CAST(event_id % 256 AS STRING), '.9') AS src_ip",
    ]),
    "known_nodes": ("nation", [
        "concat('198.51.100.', CAST(n_nationkey AS STRING)) AS ip",
        "concat('node-', CAST(n_nationkey AS STRING)) AS node_id",
        "CASE WHEN n_regionkey = 0 THEN 'proposed' ELSE 'baseline' END AS role",
    ]),
    "backup_log": ("orders", [
        "CAST(o_orderdate AS DATE) AS backup_date",
        "concat('node-', CAST(o_custkey % 2 AS STRING)) AS node_id",
        "CASE substr(o_orderpriority,1,1) WHEN '1' THEN 'threat_events' WHEN '2' THEN 'heartbeats' "
        "WHEN '3' THEN 'pipeline_health' WHEN '4' THEN 'results_sync' ELSE 'threat_events_local_prune' END AS table_name",
        "CASE o_orderstatus WHEN 'F' THEN 'success' WHEN 'P' THEN 'upload_failed' ELSE 'export_failed' END AS status",
        "o_custkey AS row_count",
        "o_orderdate + o_orderkey * INTERVAL '1' SECOND AS created_at",
    ]),
    "inject_log": ("orders", [
        "CAST(o_orderkey AS STRING) AS inject_id", "o_orderdate AS timestamp",
        "o_orderpriority AS event_type",
        "CASE o_orderstatus WHEN 'F' THEN 'proposed:8000' WHEN 'P' THEN 'http://proposed:8000/events' "
        "ELSE 'baseline:5080' END AS target",
        "CASE WHEN o_orderkey % 50 = 0 THEN '0' WHEN o_orderkey % 50 = 1 THEN NULL ELSE '1' END AS sent_ok",
    ]),
    "recorded_rows": ("lineitem", [
        "CASE WHEN l_partkey % 37 = 0 THEN '' ELSE CAST(l_orderkey AS STRING) END AS inject_id",
        "l_shipdate AS timestamp",
    ]),
    "trials": ("lineitem", [
        "concat('b', CAST(year(l_shipdate) AS STRING)) AS batch",
        "concat(l_returnflag, l_linestatus) AS pattern",
        "l_linenumber AS rps", "l_orderkey AS trial",
        "CASE WHEN l_suppkey % 3 = 0 THEN 0.0 ELSE round(l_discount * 100) END AS baseline_loss",
        "CASE WHEN l_partkey % 2 = 0 THEN 0.0 ELSE round(l_tax * 100) END AS proposed_loss",
        "l_quantity >= 48 AS baseline_verification_failed",
        "l_suppkey % 40 = 0 AS proposed_verification_failed",
        "l_quantity AS baseline_cpu_peak", "l_quantity * (100 - round(l_discount * 100)) / 64 AS proposed_cpu_peak",
        "CASE WHEN l_orderkey % 61 <> 0 THEN floor(l_extendedprice) / 64 END AS baseline_mem_peak",
        "CAST(l_partkey % 100 AS DOUBLE) AS proposed_mem_peak",
    ]),
    "resource_samples": ("lineitem", [
        "concat('f', CAST(l_suppkey % 7 AS STRING)) AS file",
        "l_shipdate AS timestamp",
        "concat(CASE l_suppkey % 3 WHEN 0 THEN 'baseline-' WHEN 1 THEN 'proposed-' ELSE 'other-' END, "
        "CAST(l_linenumber AS STRING)) AS container",
        "CASE WHEN l_orderkey % 97 = 0 THEN 'bad' ELSE CAST(CAST(l_quantity AS INT) AS STRING) END AS cpu_percent",
        "concat(CAST(l_partkey AS STRING), CASE l_orderkey % 4 WHEN 0 THEN 'KiB' WHEN 1 THEN 'MiB' "
        "WHEN 2 THEN 'GiB' ELSE 'xx' END, ' / 4GiB') AS mem_usage",
        "CASE WHEN l_orderkey % 89 = 0 THEN 'n/a' ELSE CAST(CAST(l_partkey % 100 AS INT) AS STRING) END AS mem_percent",
    ]),
    "ablation_trials": ("lineitem", [
        "CAST(l_linenumber * 100 AS INT) AS window_ms", "concat('b', CAST(l_suppkey % 3 AS STRING)) AS batch",
        "l_orderkey AS trial", "l_quantity <> 13 AS count_matches",
        "CASE WHEN l_orderkey % 31 = 0 THEN NULL ELSE l_quantity * 10 END AS upper_mean",
        "CASE WHEN l_orderkey % 31 = 0 THEN NULL ELSE l_quantity * 20 END AS upper_p95",
        "CASE WHEN l_orderkey % 31 = 0 THEN NULL ELSE l_quantity * 30 END AS upper_max",
        "CASE WHEN l_orderkey % 31 = 0 THEN NULL ELSE l_quantity * 2 END AS lower_mean",
        "CASE WHEN l_orderkey % 31 = 0 THEN NULL ELSE l_quantity * 4 END AS lower_p95",
        "CASE WHEN l_orderkey % 31 = 0 THEN NULL ELSE l_quantity * 6 END AS lower_max",
        "CASE WHEN l_orderkey % 97 = 0 THEN NULL ELSE CAST(l_partkey % 101 AS DOUBLE) END AS cpu_peak",
        "CAST(l_partkey % 53 AS DOUBLE) AS mem_percent_peak",
        "CASE WHEN l_suppkey % 11 = 0 THEN concat('stray-', CAST(l_linenumber AS STRING)) ELSE 'obs-ablation-vector' END AS container",
    ]),
    "edge_trials": ("orders", [
        "o_orderkey AS trial_id", "CAST(power(2, o_custkey % 4) AS INT) AS edge_count",
        "CASE WHEN o_orderstatus = 'F' THEN 'fixed-total' ELSE 'scaled' END AS edge_mode",
        "CAST(100 + 50 * (o_orderkey % 3) AS INT) AS base_rps",
        "CASE WHEN o_orderkey % 7 < o_custkey % 4 THEN CAST(o_orderkey % 50 + 1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS loss_rate_percent",
        "o_orderkey % 13 = 0 AS verification_failed", "o_orderkey % 19 <> 0 AS has_meta",
        "o_orderkey % 23 <> 0 AS has_loss",
    ]),
    "drift_runs": ("orders", [
        "CASE o_custkey % 4 WHEN 0 THEN 'sudden' WHEN 1 THEN 'gradual' WHEN 2 THEN 'recurring' ELSE 'none' END AS scenario",
        "CAST(o_orderkey % 997 AS INT) AS trial", "CAST(o_orderkey % 13 AS INT) AS seed",
        "concat('run', CAST(year(o_orderdate) AS STRING)) AS run", "o_orderkey AS run_order",
        "CASE WHEN o_custkey % 9 = 0 THEN NULL ELSE CAST(o_custkey % 14 - 2 AS INT) END AS detection_lag",
        "CAST(o_orderkey % 5 AS INT) AS false_alarms", "CAST(11 AS INT) AS n_evaluated_windows",
    ]),
    "attributions": ("lineitem", [
        "concat(l_returnflag, l_linestatus) AS run",
        "CAST((year(l_shipdate) - 1995) * 12 + month(l_shipdate) - 1 AS BIGINT) AS block",
        "l_linenumber AS feature",
        "CASE WHEN year(l_shipdate) >= 1999 AND l_linenumber <= 2 THEN 3 * (round(l_discount * 100) - round(l_tax * 100)) / 64 "
        "ELSE (round(l_discount * 100) - round(l_tax * 100)) / 64 END AS value",
        "l_quantity AS actual", "l_quantity + (round(l_discount * 100) - round(l_tax * 100)) / 2 AS explained",
        "CASE WHEN year(l_shipdate) >= 1999 THEN round(l_discount * 100) / 4 ELSE round(l_discount * 100) / 128 END AS error",
    ]),
    "partition_inventory": ("orders", [
        "CAST(o_orderdate AS DATE) AS part_date", "o_orderkey AS part_id",
        "CAST(o_custkey * 1000000 AS BIGINT) AS bytes",
    ]),
    "store_sizes": ("supplier", [
        "concat('store-', CAST(s_suppkey AS STRING)) AS store",
        "CAST(s_suppkey % 60 AS BIGINT) AS reported_gb",
        "CAST(s_suppkey % 60 + s_nationkey + s_suppkey % 9 AS BIGINT) AS actual_gb",
    ]),
    "run_dirs": ("orders", [
        "o_orderkey",
        "CASE o_custkey % 5 WHEN 0 THEN 'spike_rps' ELSE concat(CASE o_custkey % 3 WHEN 0 THEN 'spike' "
        "WHEN 1 THEN 'ramp_up' ELSE 'wave' END, '_rps', CAST(o_custkey AS STRING), '_trial', "
        "CAST(o_orderkey % 6 AS STRING)) END AS run_dir",
        "concat(CASE o_custkey % 2 WHEN 0 THEN 'batch_' ELSE 'ablation_batch_' END, "
        "replace(substr(CAST(o_orderdate AS STRING), 1, 10), '-', ''), '_0', "
        "CAST(4 + o_orderkey % 6 AS STRING), '1530') AS batch_dir",
    ]),
}


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    use_utc(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    base, exprs = VIEWS[name]
    return load(spark, sf_dir, base).selectExpr(*exprs)


def view_sql(name: str) -> str:
    base, exprs = VIEWS[name]
    return f"SELECT {', '.join(exprs)} FROM {base}"
