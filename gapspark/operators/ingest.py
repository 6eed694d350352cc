"""From raw text to validated rows. Nothing is dropped: each line ends in a row or a reason.

JSON is parsed once into a VARIANT; all later access is typed extraction inside the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gapspark.functions.labels import empty_to_unknown
from gapspark.functions.parsing import epoch_timestamp, iso_timestamp
from gapspark.operators.retention import route
from gapspark.schemas import COUNT_RANGE, MAX_LINE_BYTES, SEVERITY_RANGE

DEFAULT_SEVERITY = 3


def _nested(json: Column) -> Column:
    """Whether a field, given as JSON text, is an object or an array."""
    return F.coalesce(F.substring(json, 1, 1).isin("{", "["), F.lit(False))


def _absent(json: Column) -> Column:
    """Missing field and JSON null are the same: the default applies."""
    return json.isNull() | (json == "null")


def _python_int(json: Column) -> Column:
    """Integer coercion: numbers truncate, booleans are 0/1, texts must be whole numbers."""
    inner = F.substring(json, F.lit(2), F.length(json) - 2)
    return (
        F.when(F.substring(json, 1, 1) == '"', inner.try_cast("bigint"))
        .when(json == "true", 1).when(json == "false", 0)
        .otherwise(F.coalesce(json.try_cast("bigint"), json.try_cast("double").try_cast("bigint")))
    )


def _once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Adds a column that is computed once per row.

    A plain projection may be folded into later ones, and filters are pushed below it with the
    expression copied in; for JSON work that multiplies the parsing. A one-element generator is
    a border the optimizer keeps, and it stays inside whole-stage code generation.
    """
    return df.select("*", F.explode(F.array(value)).alias(name))


def _parsed(
    lines: DataFrame, value: str, texts: dict[str, str], json: dict[str, str] | None = None,
) -> DataFrame:
    """Adds ``_j``: parse state, fields as text, and fields as JSON text (quotes tell the type).

    The line is parsed once. Text of an absent or null field is NULL.
    """
    too_long = F.octet_length(value) > MAX_LINE_BYTES
    with_v = _once(lines, "_v", F.when(~too_long, F.try_parse_json(F.col(value))))
    is_object = F.ltrim(F.col(value), F.lit(" \t\r\n")).startswith("{")
    state = (
        F.when(too_long, "oversize").when(F.col("_v").isNull(), "parse_error")
        .when(~is_object, "not_an_object").otherwise("ok")
    )
    objects = _once(with_v, "_o", F.when(is_object, F.col("_v")))
    return _once(objects, "_j", F.struct(
        state.alias("state"),
        *[F.try_variant_get("_o", path, "string").alias(n) for n, path in texts.items()],
        *[F.to_json(F.try_variant_get("_o", path, "variant")).alias(n) for n, path in (json or {}).items()],
    )).drop("_v", "_o")


def parse_edge(lines: DataFrame, value: str = "value", ingest_ts: str = "ingest_ts") -> DataFrame:
    """Edge rule set: one collapsed-flow row per line, plus ``parse_status``.

    A line that is no JSON object becomes a row of defaults (it did happen, so it is counted) and
    is marked; an over-long line keeps only its mark. A default replaces a value only where the
    text conversion fails, i.e. for nested values; an absent field is an empty text.
    """
    names = ("timestamp", "src_ip", "event_type", "inject_id")
    parsed = _parsed(
        lines, value, {n: f"$.{n}" for n in names},
        {**{f"{n}_json": f"$.{n}" for n in names}, "alert_severity": "$.alert.severity", "severity": "$.severity"},
    )

    def text(name: str, on_nested: str) -> Column:
        return F.when(_nested(F.col(f"_j.{name}_json")), F.lit(on_nested)).otherwise(
            F.coalesce(f"_j.{name}", F.lit("")))

    chosen = F.coalesce(F.nullif("_j.alert_severity", F.lit("null")), "_j.severity")
    typed = _once(parsed, "_r", F.struct(
        iso_timestamp(text("timestamp", "")).alias("event_time"),
        empty_to_unknown(text("src_ip", "")).alias("sensor_id"),
        text("event_type", "unknown").alias("event_type"),
        text("inject_id", "").alias("inject_id"),
        F.coalesce(_python_int(chosen), F.lit(DEFAULT_SEVERITY)).cast("int").alias("severity"),
    ))
    return typed.select(
        *[c for c in lines.columns if c != ingest_ts],
        F.coalesce("_r.event_time", F.date_trunc("MILLISECOND", ingest_ts)).alias("timestamp"),
        F.col("_r.event_time").isNull().alias("ts_substituted"),
        "_r.sensor_id", "_r.event_type", "_r.inject_id", "_r.severity",
        F.lit(1).cast("bigint").alias("count"),
        F.col("_j.state").alias("parse_status"),
    )


def validate_rows(lines: DataFrame, value: str = "value", ingest_ts: str = "ingest_ts") -> DataFrame:
    """Store rule set: typed row and target, or a quarantine reason with the payload unchanged.

    Severity comes from the top level, then from the alert, then the default; a value that is
    present but not usable quarantines the row.
    """
    parsed = _parsed(
        lines, value, {n: f"$.{n}" for n in ("timestamp", "sensor_id", "event_type", "inject_id")},
        {"alert": "$.alert", "alert_severity": "$.alert.severity", "severity": "$.severity", "count": "$.count"},
    )
    alert = F.col("_j.alert")
    no_alert = _absent(alert) | alert.isin("[]", "{}", '""', "0", "0.0", "false")
    no_top = _absent(F.col("_j.severity"))
    chosen = F.when(~no_top, F.col("_j.severity")).when(
        no_alert | F.col("_j.alert_severity").isNull(), str(DEFAULT_SEVERITY)).otherwise(F.col("_j.alert_severity"))
    numbers = _once(parsed, "_k", F.struct(
        (no_top & ~no_alert & ~alert.startswith("{")).alias("bad_alert"),
        _python_int(chosen).alias("severity"),
        _python_int(F.coalesce("_j.count", F.lit("1"))).alias("count"),
        iso_timestamp(F.col("_j.timestamp")).alias("event_time"),
    ))
    severity, count = F.col("_k.severity"), F.col("_k.count")
    reason = (
        F.when(F.col("_j.state") != "ok", F.col("_j.state"))
        .when(F.col("_k.bad_alert"), "alert_not_an_object")
        .when(severity.isNull(), "severity_not_an_integer")
        .when(~severity.between(*SEVERITY_RANGE), "severity_out_of_range")
        .when(count.isNull(), "count_not_an_integer")
        .when(~count.between(*COUNT_RANGE), "count_out_of_range")
    )
    judged = _once(numbers, "reason", reason)
    good = F.col("reason").isNull()
    inject_id = F.coalesce("_j.inject_id", F.lit(""))
    return judged.select(
        *[c for c in lines.columns if c != ingest_ts],
        F.col(ingest_ts), "reason",
        F.when(good, F.coalesce("_k.event_time", F.date_trunc("MILLISECOND", ingest_ts))).alias("timestamp"),
        F.when(good, F.col("_k.event_time").isNull()).alias("ts_substituted"),
        F.when(good, F.coalesce("_j.sensor_id", F.lit("unknown"))).alias("sensor_id"),
        F.when(good, F.coalesce("_j.event_type", F.lit("unknown"))).alias("event_type"),
        F.when(good, severity).cast("int").alias("severity"),
        F.when(good, count).alias("count"),
        F.when(good, inject_id).alias("inject_id"),
        F.when(good, route(inject_id)).otherwise("quarantine").alias("target"),
    )


def decode_bodies(bodies: DataFrame, body: str = "body") -> DataFrame:
    """Request bodies: an object or an array of objects; anything else rejects the whole body.

    Adds ``body_status`` (accepted, invalid_json, invalid_event) and ``events``, an array of
    VARIANT that is empty for ``[]`` and NULL for a rejected body.
    """
    with_v = _once(bodies, "_v", F.try_parse_json(F.col(body)))
    first = F.substring(F.ltrim(F.col(body), F.lit(" \t\r\n")), 1, 1)
    elements = F.when(first == "[", F.try_variant_get("_v", "$", "array<variant>")).when(
        first == "{", F.array("_v")
    )
    with_elements = _once(with_v, "_e", elements)
    all_objects = F.forall("_e", lambda e: F.to_json(e).startswith("{"))
    status = (
        F.when(F.col("_v").isNull(), "invalid_json")
        .when(F.coalesce(all_objects, F.lit(False)), "accepted").otherwise("invalid_event")
    )
    decoded = _once(with_elements, "body_status", status)
    return decoded.withColumn(
        "events", F.when(F.col("body_status") == "accepted", F.col("_e"))
    ).drop("_v", "_e")


def accepted_events(decoded: DataFrame, received_at: str = "received_at") -> DataFrame:
    """One row per accepted event with its receive time."""
    keep = [c for c in decoded.columns if c not in ("events", "body", "body_status")]
    return decoded.where("body_status = 'accepted'").select(*keep, F.explode("events").alias("event"))


def decode_heartbeats(bodies: DataFrame, body: str = "body", received_at: str = "received_at") -> DataFrame:
    """Heartbeat payloads with defaults; a stored receive time wins over the ingest time.

    A rejected body stays unchanged in ``rejected_body``; its status tells why.
    """
    parsed = _parsed(bodies, body, {
        "received": "$._received_at", "node_id": "$.node_id", "status": "$.status"})
    typed = _once(parsed, "_stamp", epoch_timestamp(F.col("_j.received")))
    ok = F.col("_j.state") == "ok"
    return typed.select(
        *[c for c in bodies.columns if c not in (body, received_at)],
        F.when(ok, "accepted").when(F.col("_j.state") == "not_an_object", "invalid_heartbeat")
        .when(F.col("_j.state") == "oversize", "oversize").otherwise("invalid_json").alias("body_status"),
        F.when(ok, F.coalesce("_stamp", F.date_trunc("SECOND", received_at))).alias("timestamp"),
        F.when(ok, F.col("_stamp").isNull()).alias("ts_substituted"),
        F.when(ok, F.coalesce("_j.node_id", F.lit("unknown"))).alias("node_id"),
        F.when(ok, F.coalesce("_j.status", F.lit("ok"))).alias("status"),
        F.when(~ok, F.col(body)).alias("rejected_body"),
    )


def normalise_documents(lines: DataFrame, value: str = "value", ingest_ts: str = "ingest_ts") -> DataFrame:
    """Document-store rule set: event time from the ISO field, two default fields, month index."""
    parsed = _parsed(
        lines, value, {n: f"$.{n}" for n in ("timestamp", "inject_id", "event_type", "src_ip")},
        {"inject_json": "$.inject_id", "type_json": "$.event_type"})
    typed = _once(parsed, "_time", iso_timestamp(F.col("_j.timestamp")))
    at = F.coalesce("_time", F.date_trunc("MILLISECOND", ingest_ts))

    def present(name: str, json: str, default: str) -> Column:
        # a literal false counts as a missing field in this rule set
        return F.when(F.coalesce(F.col(f"_j.{json}"), F.lit("null")).isin("null", "false"), F.lit(default)).otherwise(
            F.col(f"_j.{name}"))

    return typed.select(
        *[c for c in lines.columns if c not in (value, ingest_ts)],
        at.alias("event_ts"),
        F.col("_time").isNull().alias("ts_substituted"),
        present("inject_id", "inject_json", "").alias("inject_id"),
        present("event_type", "type_json", "unknown").alias("event_type"),
        F.col("_j.src_ip").alias("src_ip"),
        F.concat(F.lit("threat-events-"), F.date_format(at, "yyyy.MM")).alias("index_name"),
        (F.col("_j.state") != "ok").alias("parse_failed"),
        F.when(F.col("_j.state") != "ok", F.col(value)).alias("rejected_value"),
    )
