"""Table schemas and value ranges (unsigned columns are widened and range-checked)."""

from __future__ import annotations

from pyspark.sql import types as T


_TYPES = {
    "string": T.StringType(), "timestamp": T.TimestampType(), "date": T.DateType(),
    "smallint": T.ShortType(), "int": T.IntegerType(), "bigint": T.LongType(),
    "double": T.DoubleType(), "boolean": T.BooleanType(),
}


def _schema(**fields: str | T.DataType) -> T.StructType:
    return T.StructType([
        T.StructField(n, _TYPES[t] if isinstance(t, str) else t) for n, t in fields.items()
    ])


THREAT_EVENTS = _schema(
    timestamp="timestamp", sensor_id="string", event_type="string", severity="smallint",
    count="bigint", inject_id="string", traffic_class="string",
)
PIPELINE_HEALTH = _schema(
    checked_at="timestamp", events_last_hour="bigint", unique_sensors="bigint",
    experiment_table_rows="bigint", experiment_table_bytes="bigint",
)
HEARTBEATS = _schema(timestamp="timestamp", node_id="string", status="string")
BACKUP_LOG = _schema(
    backup_date="date", node_id="string", table_name="string", status="string",
    row_count="bigint", error_message="string", created_at="timestamp",
)
KNOWN_NODES = _schema(ip="string", node_id="string", role="string", added_at="timestamp")
SEND_LOG = _schema(
    inject_id="string", timestamp="string", event_type="string", target="string", sent_ok="string",
)
RESOURCE_SAMPLES = _schema(
    timestamp="string", container="string", cpu_percent="string", mem_usage="string",
    mem_percent="string", block_io="string",
)
_SYSTEM_LOSS = _schema(
    total_injected="bigint", total_recorded="bigint", total_lost="bigint",
    loss_rate_percent="double", verification_failed="boolean",
)
LOSS_RESULT = _schema(baseline=_SYSTEM_LOSS, proposed=_SYSTEM_LOSS)
EDGE_META = _schema(
    edge_count="int", edge_mode="string", base_rps="int", per_edge_rps="int", pattern="string",
    duration="int", timestamp="string",
)
_LATENCY = _schema(mean="double", p50="double", p95="double", max="double")
ABLATION_RESULT = _schema(
    window_ms="int", raw_event_count="bigint", aggregated_count_sum="bigint",
    count_matches="boolean", count_diff="bigint", n_aggregated_groups="bigint",
    parse_errors="bigint", latency_upper_ms=_LATENCY, latency_lower_ms=_LATENCY,
)
COLLAPSED_RECORD = _schema(
    sensor_id="string", event_type="string", timestamp="string", severity="int", count="bigint",
    inject_id="string", vector_ingest_ts_first="bigint", vector_ingest_ts_last="bigint",
)
DRIFT_RUN = _schema(
    scenario="string", trial="int", seed="int", fidelity_leads="boolean",
    confirming_detected="boolean", detection_lag="int",
    false_alarm_windows=T.ArrayType(T.IntegerType()), n_evaluated_windows="int",
)

# Ranges of the unsigned columns: severity is one byte, count must not be negative.
SEVERITY_RANGE = (0, 255)
COUNT_RANGE = (0, 2**63 - 1)

FEATURE_TYPES = ("alert", "dns", "http", "tls", "flow", "ssh")
FEATURE_COLUMNS = (
    "event_count", "unique_sensors", "avg_severity", "max_severity",
    "alert_count", "dns_count", "http_count", "tls_count", "flow_count", "ssh_count",
)

# Fixed values of the observed deployment.
KNOWN_SENSOR_IDS = ("203.0.113.10", "203.0.113.11")
UNRESOLVED_SENSOR_IDS = ("", "unknown")
WEEKDAY_LABELS = ("Mon", "Tue", "Wed", "Thu", "Fri", "Sat", "Sun")
MAX_LINE_BYTES = 1_048_576
