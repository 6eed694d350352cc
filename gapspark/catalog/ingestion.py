"""Registered queries: parsing, validation, routing, burst collapse."""

from __future__ import annotations

from pyspark.sql import functions as F

from gapspark.functions import parsing
from gapspark.operators import collapse, enrich, ingest
from gapspark.registry import query
from gapspark.sources.driver_tables import load, view


def _stamp(x: str) -> str:
    """DuckDB: ISO text with an optional +0200 offset to UTC text, cut to milliseconds."""
    return (f"CAST(date_trunc('milliseconds', CASE WHEN {x} LIKE '%+0200' THEN "
            f"TRY_CAST(replace({x}, '+0200', '') AS TIMESTAMP) - INTERVAL 2 HOUR ELSE TRY_CAST({x} AS TIMESTAMP) END) AS VARCHAR)")


JSON_PARTS = """
WITH p AS (SELECT event_id, ingest_ts, value, json_valid(value) AS ok,
  CASE WHEN json_valid(value) THEN value END AS j FROM raw_lines),
q AS (SELECT *, json_type(j, '$.severity') AS st, json_type(j, '$.alert') AS alt, json_type(j, '$.count') AS ct,
  TRY_CAST(j->>'$.severity' AS BIGINT) AS s1, TRY_CAST(j->>'$.alert.severity' AS BIGINT) AS s2,
  TRY_CAST(j->>'$.count' AS BIGINT) AS c1, coalesce(j->>'$.timestamp', '') AS t FROM p)
"""


@query("edge_parse", "A1 B1 B2 B3", f"""
{JSON_PARTS}
SELECT event_id, coalesce({_stamp('t')}, CAST(date_trunc('milliseconds', ingest_ts) AS VARCHAR)) AS timestamp,
  NOT (ok AND t <> '') AS ts_substituted,
  CASE WHEN coalesce(j->>'$.src_ip', '') = '' THEN 'unknown' ELSE j->>'$.src_ip' END AS sensor_id,
  coalesce(j->>'$.event_type', '') AS event_type, coalesce(j->>'$.inject_id', '') AS inject_id,
  CASE WHEN j->>'$.alert.severity' IS NOT NULL THEN coalesce(s2, 3) WHEN st = 'ARRAY' THEN 3 ELSE coalesce(s1, 3) END AS severity,
  CAST(1 AS BIGINT) AS count, CASE WHEN ok THEN 'ok' ELSE 'parse_error' END AS parse_status FROM q""")
def _(spark, d):
    return ingest.parse_edge(view(spark, d, "raw_lines")).drop("value")


VALID = f"""
{JSON_PARTS},
r AS (SELECT *, CASE WHEN NOT ok THEN 'parse_error'
  WHEN st IS NULL AND alt IS NOT NULL AND alt <> 'OBJECT' THEN 'alert_not_an_object'
  WHEN st = 'ARRAY' OR (st IS NOT NULL AND s1 IS NULL) THEN 'severity_not_an_integer'
  WHEN ct IS NOT NULL AND c1 IS NULL THEN 'count_not_an_integer' END AS reason FROM q)
"""


@query("validated_rows", "B4 B5 S1 S2", f"""
{VALID}
SELECT event_id, reason,
  CASE WHEN reason IS NULL THEN coalesce({_stamp('t')}, CAST(date_trunc('milliseconds', ingest_ts) AS VARCHAR)) END AS timestamp,
  CASE WHEN reason IS NULL THEN t = '' END AS ts_substituted,
  CASE WHEN reason IS NULL THEN coalesce(j->>'$.sensor_id', 'unknown') END AS sensor_id,
  CASE WHEN reason IS NULL THEN coalesce(j->>'$.event_type', 'unknown') END AS event_type,
  CASE WHEN reason IS NULL THEN coalesce(s1, s2, 3) END AS severity,
  CASE WHEN reason IS NULL THEN coalesce(c1, 1) END AS count,
  CASE WHEN reason IS NULL THEN coalesce(j->>'$.inject_id', '') END AS inject_id,
  CASE WHEN reason IS NOT NULL THEN 'quarantine' WHEN coalesce(j->>'$.inject_id', '') <> '' THEN 'threat_events_experiment' ELSE 'threat_events' END AS target
FROM r""")
def _(spark, d):
    return ingest.validate_rows(view(spark, d, "raw_lines")).drop("value", "ingest_ts")


@query("quarantined_payloads", "S2 S3 X6", f"""
{VALID} SELECT event_id, reason, value FROM r WHERE reason IS NOT NULL""")
def _(spark, d):
    return ingest.validate_rows(view(spark, d, "raw_lines")).where("target = 'quarantine'").select(
        "event_id", "reason", "value")


@query("ingest_totals", "X9 G33 S1", f"""
{VALID}
SELECT CASE WHEN reason IS NOT NULL THEN 'quarantine' WHEN coalesce(j->>'$.inject_id', '') <> '' THEN 'threat_events_experiment' ELSE 'threat_events' END AS target,
  coalesce(reason, '') AS reason, count(*) AS n_rows,
  count(*) FILTER (WHERE reason IS NULL AND t = '') AS n_ts_substituted FROM r GROUP BY 1, 2""")
def _(spark, d):
    return ingest.validate_rows(view(spark, d, "raw_lines")).groupBy(
        "target", F.coalesce("reason", F.lit("")).alias("reason")).agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_if("ts_substituted").alias("n_ts_substituted"))


BODIES = """
WITH v AS (SELECT event_id, body, json_valid(body) AS ok, CASE WHEN json_valid(body) THEN json_type(body) END AS t FROM raw_bodies),
x AS (SELECT event_id, CASE WHEN NOT ok THEN 'invalid_json' WHEN t = 'OBJECT' THEN 'accepted'
  WHEN t = 'ARRAY' AND len(list_filter(CASE WHEN t = 'ARRAY' THEN json_extract(body, '$[*]') ELSE [] END, lambda e: json_type(e) <> 'OBJECT')) = 0 THEN 'accepted'
  ELSE 'invalid_event' END AS body_status,
  CASE WHEN t = 'ARRAY' THEN json_extract(body, '$[*]') WHEN t = 'OBJECT' THEN [CAST(body AS JSON)] ELSE [] END AS ev FROM v)
"""


@query("request_bodies", "A3", BODIES + """
SELECT event_id, body_status, CASE WHEN body_status = 'accepted' THEN len(ev) ELSE 0 END AS n_events FROM x""")
def _(spark, d):
    return ingest.decode_bodies(view(spark, d, "raw_bodies")).select(
        "event_id", "body_status", F.when(F.col("body_status") == "accepted", F.size("events")).otherwise(0).alias("n_events"))


@query("accepted_events", "A3", BODIES + """
SELECT b.event_id, CAST(received_at AS VARCHAR) AS received_at, CAST(json_extract(e, '$.event_id') AS BIGINT) AS inner_id
FROM (SELECT event_id, unnest(ev) AS e FROM x WHERE body_status = 'accepted') b JOIN raw_bodies USING (event_id)""")
def _(spark, d):
    return ingest.accepted_events(ingest.decode_bodies(view(spark, d, "raw_bodies"))).select(
        "event_id", "received_at", F.try_variant_get("event", "$.event_id", "bigint").alias("inner_id"))


@query("heartbeat_payloads", "A4 B6", """
WITH v AS (SELECT event_id, received_at, body, json_valid(body) AS ok,
  CASE WHEN json_valid(body) AND json_type(body) = 'OBJECT' THEN body END AS o FROM heartbeat_bodies),
e AS (SELECT *, TRY_CAST(o->>'$._received_at' AS DOUBLE) AS x FROM v)
SELECT event_id, CASE WHEN NOT ok THEN 'invalid_json' WHEN o IS NULL THEN 'invalid_heartbeat' ELSE 'accepted' END AS body_status,
  CASE WHEN o IS NOT NULL THEN CAST(coalesce(make_timestamp(CAST(floor(x) AS BIGINT) * 1000000), date_trunc('second', received_at)) AS VARCHAR) END AS timestamp,
  CASE WHEN o IS NOT NULL THEN x IS NULL END AS ts_substituted,
  CASE WHEN o IS NOT NULL THEN coalesce(o->>'$.node_id', 'unknown') END AS node_id,
  CASE WHEN o IS NOT NULL THEN coalesce(o->>'$.status', 'ok') END AS status,
  CASE WHEN o IS NULL THEN body END AS rejected_body FROM e""")
def _(spark, d):
    return ingest.decode_heartbeats(view(spark, d, "heartbeat_bodies"))


@query("document_normalisation", "A19 B14", f"""
{JSON_PARTS}
SELECT event_id, coalesce({_stamp('t')}, CAST(date_trunc('milliseconds', ingest_ts) AS VARCHAR)) AS event_ts,
  NOT (ok AND t <> '') AS ts_substituted, coalesce(j->>'$.inject_id', '') AS inject_id,
  coalesce(j->>'$.event_type', 'unknown') AS event_type, j->>'$.src_ip' AS src_ip,
  concat('threat-events-', replace(substr(coalesce({_stamp('t')}, CAST(ingest_ts AS VARCHAR)), 1, 7), '-', '.')) AS index_name,
  NOT ok AS parse_failed, CASE WHEN NOT ok THEN value END AS rejected_value FROM q""")
def _(spark, d):
    return ingest.normalise_documents(view(spark, d, "raw_lines"))


BURSTS = """
o AS (SELECT sensor_id, event_type, timestamp, count, severity,
  CASE WHEN timestamp - lag(timestamp) OVER w <= INTERVAL 6 HOUR THEN 0 ELSE 1 END AS b FROM threat_events
  WINDOW w AS (PARTITION BY sensor_id, event_type ORDER BY timestamp)),
i AS (SELECT *, sum(b) OVER (PARTITION BY sensor_id, event_type ORDER BY timestamp ROWS UNBOUNDED PRECEDING) AS g FROM o),
bursts AS (SELECT sensor_id, event_type, min(timestamp) AS first_ts, max(timestamp) AS last_ts, CAST(sum(count) AS BIGINT) AS count,
  CAST(max(severity) AS BIGINT) AS severity, count(*) AS raw_rows,
  min(epoch_us(timestamp)) // 1000 AS f_ms, max(epoch_us(timestamp)) // 1000 AS l_ms FROM i GROUP BY sensor_id, event_type, g)
"""
GAP = 6 * 3600


@query("burst_collapse", "G1", f"""
WITH {BURSTS} SELECT sensor_id, event_type, CAST(last_ts AS VARCHAR) AS timestamp, CAST(first_ts AS VARCHAR) AS first_ts,
  count, severity, raw_rows FROM bursts""")
def _(spark, d):
    return collapse.collapse_bursts(view(spark, d, "threat_events"), GAP)


@query("count_conservation", "G20", f"""
WITH {BURSTS}, r AS (SELECT count(*) AS n FROM threat_events), c AS (SELECT sum(raw_rows) AS s, count(*) AS g FROM bursts)
SELECT n AS raw_event_count, CAST(s AS BIGINT) AS aggregated_count_sum, g AS n_aggregated_groups,
  CAST(s - n AS BIGINT) AS count_diff, s = n AS count_matches FROM r, c""")
def _(spark, d):
    ev = view(spark, d, "threat_events").withColumn("count", F.lit(1).cast("bigint"))
    return collapse.count_conservation(ev, collapse.collapse_bursts(ev, GAP))


def _waits(spark, d):
    ev = view(spark, d, "threat_events").withColumn("ms", F.unix_millis(F.col("timestamp").cast("timestamp")))
    bursts = collapse.collapse_bursts(ev, GAP, ingest_ms="ms")
    return collapse.wait_bounds(bursts.withColumn("observed_ms", F.col("ingest_ms_last") + GAP * 1000))


@query("burst_wait_bounds", "G19 G1", f"""
WITH {BURSTS} SELECT sensor_id, event_type, CAST(first_ts AS VARCHAR) AS first_ts,
  l_ms + 21600000 - f_ms AS wait_upper_ms, CAST(21600000 AS BIGINT) AS wait_lower_ms FROM bursts""")
def _(spark, d):
    return _waits(spark, d).select("sensor_id", "event_type", "first_ts", "wait_upper_ms", "wait_lower_ms")


@query("burst_wait_percentiles", "G18", f"""
WITH {BURSTS}, w AS (SELECT event_type, l_ms + 21600000 - f_ms AS x FROM bursts),
n AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY x) AS rn, count(*) OVER (PARTITION BY event_type) AS n FROM w)
SELECT event_type, round(avg(x), 6) AS mean, max(x) AS max, max(n) AS n_values,
  round(CAST(max(x) FILTER (WHERE rn = least(floor(n * 0.5) + 1, n)) AS DOUBLE), 6) AS p50,
  round(CAST(max(x) FILTER (WHERE rn = least(floor(n * 0.95) + 1, n)) AS DOUBLE), 6) AS p95 FROM n GROUP BY event_type""")
def _(spark, d):
    return collapse.wait_summary(_waits(spark, d), ["event_type"], "wait_upper_ms")


@query("collapsed_record_tail", "A17 G19", """
SELECT event_id % 13 = 0 AS parse_error, count(*) AS n_rows,
  CAST(sum(CASE WHEN event_id % 13 <> 0 THEN event_id % 5 ELSE 0 END) AS BIGINT) AS total_count,
  CAST(sum(CASE WHEN event_id % 13 <> 0 THEN event_id % 7 ELSE 0 END) AS BIGINT) AS total_span_ms FROM events GROUP BY 1""")
def _(spark, d):
    from gapspark.sources.driver_tables import load
    line = F.when(F.col("event_id") % 13 == 0, F.lit('{"count": 1, "vector_ingest_ts_first": "x"}')).otherwise(
        F.to_json(F.struct((F.col("event_id") % 5).alias("count"), F.col("event_id").alias("vector_ingest_ts_first"),
                           (F.col("event_id") + F.col("event_id") % 7).alias("vector_ingest_ts_last"))))
    recs = collapse.parse_collapsed(load(spark, d, "events").select(line.alias("value")))
    good = ~F.col("parse_error")
    return recs.groupBy("parse_error").agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.coalesce(F.sum(F.when(good, F.col("count"))), F.lit(0)).alias("total_count"),
        F.coalesce(F.sum(F.when(good, F.col("ingest_ms_last") - F.col("ingest_ms_first"))), F.lit(0)).cast("bigint").alias("total_span_ms"))


@query("geo_enrichment", "J16", """
WITH g AS (SELECT n_name AS range_name, CAST(n_nationkey AS BIGINT) * 9 * 16777216 AS lo, (CAST(n_nationkey AS BIGINT) * 9 + 6) * 16777216 - 1 AS hi FROM nation),
i AS (SELECT event_id, src_ip, list_reduce(list_transform(string_split(src_ip, '.'), lambda x: CAST(x AS BIGINT)), lambda a, b: a * 256 + b) AS n FROM source_ips)
SELECT event_id, src_ip, range_name FROM i LEFT JOIN g ON n BETWEEN lo AND hi""")
def _(spark, d):
    # the range table is the user's: here every nation has six of each nine first octets
    first = F.col("n_nationkey").cast("bigint") * 9
    ranges = load(spark, d, "nation").select(
        F.col("n_name").alias("range_name"), (first * 16777216).alias("lo"), ((first + 6) * 16777216 - 1).alias("hi"))
    return enrich.geo_lookup(view(spark, d, "source_ips"), ranges, "src_ip", ["range_name"])


@query("memory_sizes", "B13", """
WITH u AS (SELECT mem_usage, trim(split_part(mem_usage, '/', 1)) AS x FROM resource_samples),
p AS (SELECT mem_usage, TRY_CAST(regexp_extract(x, '^([0-9.]+)\\s*(B|KiB|MiB|GiB|TiB)$', 1) AS DOUBLE) AS a,
  regexp_extract(x, '^([0-9.]+)\\s*(B|KiB|MiB|GiB|TiB)$', 2) AS un FROM u)
SELECT DISTINCT mem_usage, round(a * CASE un WHEN 'B' THEN 1.0 / 1048576 WHEN 'KiB' THEN 1.0 / 1024 WHEN 'MiB' THEN 1.0
  WHEN 'GiB' THEN 1024.0 WHEN 'TiB' THEN 1048576.0 END, 6) AS mem_mib FROM p""")
def _(spark, d):
    return view(spark, d, "resource_samples").select("mem_usage").distinct().withColumn(
        "mem_mib", parsing.mem_mib(F.col("mem_usage")))


@query("run_names", "B15", """
SELECT o_orderkey, run_dir, nullif(regexp_extract(run_dir, '^(.+)_rps(\\d+)_trial(\\d+)$', 1), '') AS pattern,
  TRY_CAST(regexp_extract(run_dir, '^(.+)_rps(\\d+)_trial(\\d+)$', 2) AS BIGINT) AS rps,
  TRY_CAST(regexp_extract(run_dir, '^(.+)_rps(\\d+)_trial(\\d+)$', 3) AS BIGINT) AS trial FROM run_dirs""")
def _(spark, d):
    return view(spark, d, "run_dirs").withColumn("r", parsing.run_name(F.col("run_dir"))).select(
        "o_orderkey", "run_dir", "r.pattern", "r.rps", "r.trial")


@query("dates_in_names", "B17", """
WITH s AS (SELECT o_orderkey, batch_dir, regexp_extract(batch_dir, '_(\\d{8})_', 1) AS ymd,
  regexp_extract(batch_dir, '^batch_(\\d{8})_(\\d{6})', 1) AS b, regexp_extract(batch_dir, '^batch_(\\d{8})_(\\d{6})', 2) AS t FROM run_dirs)
SELECT o_orderkey, CAST(CAST(strptime(ymd, '%Y%m%d') AS DATE) AS VARCHAR) AS name_date,
  CASE WHEN b <> '' THEN CAST(CAST(strptime(b || t, '%Y%m%d%H%M%S') AT TIME ZONE 'Europe/Berlin' AS TIMESTAMP) AS VARCHAR) END AS started_utc FROM s""")
def _(spark, d):
    return view(spark, d, "run_dirs").select(
        "o_orderkey", parsing.date_in_name(F.col("batch_dir")).alias("name_date"),
        parsing.batch_start(F.col("batch_dir")).alias("started_utc"))


@query("target_hosts", "B16", """
SELECT target, CASE WHEN target LIKE 'http://%' THEN regexp_extract(target, '^http://([^:/]+)', 1) ELSE split_part(target, ':', 1) END AS host,
  count(*) AS n_rows FROM inject_log GROUP BY 1, 2""")
def _(spark, d):
    return view(spark, d, "inject_log").groupBy("target", parsing.host_of(F.col("target")).alias("host")).agg(
        F.count(F.lit(1)).alias("n_rows"))
