"""Registered queries: windowed features, calendars, sequences."""

from __future__ import annotations

from pyspark.sql import functions as F

from gapspark.operators import features as ft
from gapspark.operators.filters import clean_events
from gapspark.plans.feature_dataset import feature_dataset
from gapspark.registry import query
from gapspark.schemas import FEATURE_COLUMNS, FEATURE_TYPES
from gapspark.sources.driver_tables import view

from gapspark.catalog.monitoring import CLEAN

_COUNTS = ", ".join(f"count(*) FILTER (WHERE event_type = '{t}') AS {t}_count" for t in FEATURE_TYPES)
WINDOWS = f"""
fw AS (SELECT time_bucket(INTERVAL 5 MINUTE, timestamp) AS window_start, count(*) AS event_count,
  count(DISTINCT sensor_id) AS unique_sensors, avg(severity) AS avg_severity, CAST(max(severity) AS BIGINT) AS max_severity,
  {_COUNTS} FROM threat_events GROUP BY 1)
"""


@query("feature_windows", "G7", f"""
WITH {WINDOWS} SELECT * REPLACE (CAST(window_start AS VARCHAR) AS window_start, round(avg_severity, 6) AS avg_severity) FROM fw""")
def _(spark, d):
    return ft.feature_windows(view(spark, d, "threat_events"))


_DOC = ", ".join(f"count(*) FILTER (WHERE event_type = '{t}') AS {t}_count" for t in FEATURE_TYPES if t != "ssh")
DOC_SQL = f"""
SELECT CAST(date_trunc('minute', timestamp) AS VARCHAR) AS window_start, count(*) AS event_count, count(DISTINCT type) AS unique_sensors,
  coalesce(round(avg(alert_severity), 4), 0.0) AS avg_severity, coalesce(CAST(max(alert_severity) AS DOUBLE), 0.0) AS max_severity,
  {_DOC}, count(*) FILTER (WHERE type = 'Cowrie' OR dest_port = 22) AS ssh_count FROM documents_in GROUP BY 1"""


@query("document_minute_features", "G8 B23", DOC_SQL)
def _(spark, d):
    return ft.document_windows(view(spark, d, "documents_in"), exact=True)


@query("document_minute_features_approx", "G8 S9", DOC_SQL)  # a handful of types: the sketch is exact
def _(spark, d):
    return ft.document_windows(view(spark, d, "documents_in"))


_HSUM = ", ".join(f"CAST(coalesce(sum(count) FILTER (WHERE event_type = '{t}'), 0) AS BIGINT) AS {t}_count" for t in FEATURE_TYPES)
HOURLY = f"""
h AS (SELECT date_trunc('hour', timestamp) AS hour, CAST(sum(count) AS BIGINT) AS event_count, count(DISTINCT sensor_id) AS unique_sensors, {_HSUM}
  FROM threat_events WHERE {CLEAN} GROUP BY 1)
"""


@query("hourly_features", "G9", f"WITH {HOURLY} SELECT * REPLACE (CAST(hour AS VARCHAR) AS hour) FROM h")
def _(spark, d):
    return ft.hourly_features(clean_events(view(spark, d, "threat_events")))


@query("hourly_features_on_calendar", "J6 G9", f"""
WITH {HOURLY}, c AS (SELECT unnest(generate_series(TIMESTAMP '2023-12-30', TIMESTAMP '2024-02-01 23:00:00', INTERVAL 1 HOUR)) AS hour)
SELECT CAST(c.hour AS VARCHAR) AS hour, coalesce(event_count, 0) AS event_count, coalesce(unique_sensors, 0) AS unique_sensors,
  {', '.join(f'coalesce({t}_count, 0) AS {t}_count' for t in FEATURE_TYPES)}, h.hour IS NULL AS is_filled
FROM c LEFT JOIN h ON c.hour = h.hour""")
def _(spark, d):
    hourly = ft.hourly_features(clean_events(view(spark, d, "threat_events")))
    return ft.on_hour_calendar(hourly, "2023-12-30", "2024-02-01")


@query("missing_windows", "W4", f"""
WITH {WINDOWS}, g AS (SELECT date_diff('second', window_start, lead(window_start) OVER (ORDER BY window_start)) AS s FROM fw)
SELECT CAST(coalesce(sum(greatest(s // 300 - 1, 0)), 0) AS BIGINT) AS missing_windows,
  count(*) FILTER (WHERE s // 300 - 1 > 0) AS n_gaps, count(*) AS n_windows FROM g""")
def _(spark, d):
    return ft.missing_windows(ft.feature_windows(view(spark, d, "threat_events")))


_Z = ", ".join(f"({c} - avg({c}) OVER ()) / CASE WHEN stddev_pop({c}) OVER () = 0 THEN 1 ELSE stddev_pop({c}) OVER () END AS {c}" for c in FEATURE_COLUMNS)


@query("normalised_windows", "B22", f"""
WITH {WINDOWS}, z AS (SELECT window_start, {_Z} FROM fw)
SELECT CAST(window_start AS VARCHAR) AS window_start, {', '.join(f'round({c}, 6) AS {c}' for c in FEATURE_COLUMNS)} FROM z""")
def _(spark, d):
    w = ft.feature_windows(view(spark, d, "threat_events"))
    return ft.normalise(w, ft.normalisation(w))


SEQ = f"""
WITH {WINDOWS}, i AS (SELECT *, row_number() OVER (ORDER BY window_start) - 1 AS idx, count(*) OVER () AS n FROM fw),
s AS (SELECT idx - 12 AS seq_index, n - 12 AS n_sequences, event_count AS y_events,
  sum(event_count) OVER (ORDER BY idx ROWS BETWEEN 12 PRECEDING AND 1 PRECEDING) AS x_events,
  sum(unique_sensors * (idx % 5)) OVER (ORDER BY idx ROWS BETWEEN 12 PRECEDING AND 1 PRECEDING) AS x_weighted,
  first_value(flow_count) OVER (ORDER BY idx ROWS BETWEEN 12 PRECEDING AND 1 PRECEDING) AS x_first_flow, idx FROM i)
"""


@query("sliding_sequences", "W6", SEQ + """
SELECT seq_index, CAST(x_events AS DOUBLE) AS x_events, CAST(x_first_flow AS DOUBLE) AS x_first_flow,
  CAST(x_weighted AS DOUBLE) AS x_weighted, CAST(y_events AS DOUBLE) AS y_events, CAST(12 AS BIGINT) AS n_steps FROM s WHERE idx >= 12""")
def _(spark, d):
    seq = ft.sliding_sequences(ft.vectors(ft.feature_windows(view(spark, d, "threat_events"))))
    total = F.aggregate("x", F.lit(0.0), lambda a, v: a + F.get(v, F.lit(0)))
    weighted = F.aggregate(
        F.zip_with("x", F.sequence(F.lit(0), F.lit(11)), lambda v, k: F.get(v, F.lit(1)) * ((F.col("seq_index") + k) % 5)),
        F.lit(0.0), lambda a, v: a + v)
    return seq.select("seq_index", total.alias("x_events"), F.get(F.get("x", F.lit(0)), F.lit(8)).alias("x_first_flow"),
                      weighted.alias("x_weighted"), F.get("y", F.lit(0)).alias("y_events"), F.size("x").alias("n_steps"))


@query("sequence_blocks", "W7", SEQ + """
SELECT seq_index // 10 AS block, count(*) AS n_sequences, CAST(sum(y_events) AS DOUBLE) AS y_events FROM s
WHERE idx >= 12 AND (seq_index // 10 + 1) * 10 <= n_sequences GROUP BY 1""")
def _(spark, d):
    windows = ft.feature_windows(view(spark, d, "threat_events"))
    n = windows.agg((F.count(F.lit(1)) - 12).alias("n_total"))
    seq = ft.sliding_sequences(ft.vectors(windows)).crossJoin(F.broadcast(n))
    return ft.fixed_blocks(seq, F.col("n_total")).groupBy("block").agg(
        F.count(F.lit(1)).alias("n_sequences"), F.sum(F.get("y", F.lit(0))).alias("y_events"))


@query("chronological_split", "W8", SEQ + """
SELECT CASE WHEN seq_index < floor(n_sequences * 0.8) THEN 'train' ELSE 'test' END AS part, count(*) AS n_rows,
  min(seq_index) AS first_index, max(seq_index) AS last_index FROM s WHERE idx >= 12 GROUP BY 1""")
def _(spark, d):
    windows = ft.feature_windows(view(spark, d, "threat_events"))
    n = windows.agg((F.count(F.lit(1)) - 12).alias("n_total"))
    seq = ft.sliding_sequences(ft.vectors(windows)).crossJoin(F.broadcast(n))
    return ft.chronological_split(seq, F.col("n_total")).groupBy("part").agg(
        F.count(F.lit(1)).alias("n_rows"), F.min("seq_index").alias("first_index"), F.max("seq_index").alias("last_index"))


@query("feature_dataset", "D10", f"""
WITH {WINDOWS}, z AS (SELECT window_start, row_number() OVER (ORDER BY window_start) - 1 AS idx, count(*) OVER () AS n, {_Z} FROM fw),
s AS (SELECT idx - 12 AS seq_index, n - 12 AS n_sequences, idx, event_count AS y0, ssh_count AS y9,
  sum(event_count) OVER (ORDER BY idx ROWS BETWEEN 12 PRECEDING AND 1 PRECEDING) AS x0 FROM z)
SELECT seq_index, CASE WHEN seq_index < floor(n_sequences * 0.8) THEN 'train' ELSE 'test' END AS part,
  round(y0, 6) AS y_event_count, round(y9, 6) AS y_ssh_count, round(x0, 6) AS x_event_count FROM s WHERE idx >= 12""")
def _(spark, d):
    data = feature_dataset(view(spark, d, "threat_events"))
    return data.select(
        "seq_index", "part", F.get("y", F.lit(0)).alias("y_event_count"), F.get("y", F.lit(9)).alias("y_ssh_count"),
        F.aggregate("x", F.lit(0.0), lambda a, v: a + F.get(v, F.lit(0))).alias("x_event_count"))
