"""Parsing, validation, bodies, routing, sinks and streams on hand cases."""

import json
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from conftest import rows
from gapspark.functions import parsing
from gapspark.operators import ingest
from gapspark.sinks import tables
from gapspark.streaming import jobs

NOW = datetime(2026, 9, 24, 12, 0, 0, 123456)


def lines(spark, texts):
    return spark.createDataFrame([(t, NOW) for t in texts], "value STRING, ingest_ts TIMESTAMP")


def validated(spark, payloads):
    out = ingest.validate_rows(lines(spark, [p if isinstance(p, str) else json.dumps(p) for p in payloads]))
    return {r.value: r for r in out.collect()}


@pytest.mark.parametrize("raw, want", [
    ("2026-09-24T12:00:00.123456+0200", "2026-09-24 10:00:00.123"),
    ("2026-09-24T00:30:00+0100", "2026-09-23 23:30:00"),
    ("2026-09-24T00:30:00+01", "2026-09-23 23:30:00"),
    ("2026-09-24T12:00:00Z", "2026-09-24 12:00:00"),
    ("2026-09-24 12:00:00.5", "2026-09-24 12:00:00.5"),
    ("2026-09-24T12:00:00,25", "2026-09-24 12:00:00.25"),
    ("2026-09-24", "2026-09-24 00:00:00"),
    ("2026", None), ("12:30", None), ("not a time", None), ("", None), ("2026-09-24T12:00:00 Europe/Berlin", None),
    ("2026-13-40T00:00:00", None),
])
def test_event_times(spark, raw, want):
    df = spark.createDataFrame([(raw,)], "t STRING")
    assert df.select(parsing.iso_timestamp(F.col("t")).cast("string")).first()[0] == want


@pytest.mark.parametrize("payload, severity, count, reason", [
    ({"severity": 2}, 2, 1, None), ({"severity": 2.7}, 2, 1, None), ({"severity": -2.7}, None, None, "severity_out_of_range"),
    ({"severity": "3"}, 3, 1, None), ({"severity": " 3 "}, 3, 1, None), ({"severity": True}, 1, 1, None),
    ({"severity": "2.7"}, None, None, "severity_not_an_integer"), ({"severity": "high"}, None, None, "severity_not_an_integer"),
    ({"severity": [1]}, None, None, "severity_not_an_integer"), ({"severity": 300}, None, None, "severity_out_of_range"),
    ({"severity": None, "alert": {"severity": 1}}, 1, 1, None), ({"alert": {"severity": "4"}}, 4, 1, None),
    ({"alert": {"signature": "x"}}, 3, 1, None), ({"alert": {"severity": None}}, None, None, "severity_not_an_integer"),
    ({"alert": {}}, 3, 1, None), ({"alert": None}, 3, 1, None), ({"alert": ""}, 3, 1, None), ({}, 3, 1, None),
    ({"alert": "not-an-object"}, None, None, "alert_not_an_object"), ({"alert": [1]}, None, None, "alert_not_an_object"),
    ({"severity": 1, "alert": "ignored"}, 1, 1, None),
    ({"count": "many"}, None, None, "count_not_an_integer"), ({"count": None}, None, None, "count_not_an_integer"),
    ({"count": -1}, None, None, "count_out_of_range"), ({"count": "7"}, 3, 7, None),
])
def test_row_validation(spark, payload, severity, count, reason):
    good = {"severity": 1, "sensor_id": "s"}
    got = validated(spark, [payload, good]) if payload != good else validated(spark, [payload])
    r = got[json.dumps(payload)]
    assert (r.severity, r["count"], r.reason) == (severity, count, reason)
    assert r.target == ("quarantine" if reason else "threat_events")
    assert got[json.dumps(good)].target == "threat_events"


def test_defaults_routes_and_bad_lines(spark):
    got = validated(spark, [
        {"inject_id": "i1", "timestamp": "2026-09-24T10:00:00"}, {"inject_id": None, "sensor_id": None},
        "{broken", "[1,2]", "5", " {\"sensor_id\": \"x\"}",
    ])
    r = got[json.dumps({"inject_id": "i1", "timestamp": "2026-09-24T10:00:00"})]
    assert (r.target, r.ts_substituted, str(r.timestamp)) == ("threat_events_experiment", False, "2026-09-24 10:00:00")
    r = got[json.dumps({"inject_id": None, "sensor_id": None})]
    assert (r.target, r.sensor_id, r.event_type, r.inject_id, r.ts_substituted) == ("threat_events", "unknown", "unknown", "", True)
    assert r.timestamp == NOW.replace(microsecond=123000)
    assert [got[k].reason for k in ("{broken", "[1,2]", "5")] == ["parse_error", "not_an_object", "not_an_object"]
    assert got[" {\"sensor_id\": \"x\"}"].sensor_id == "x"


def test_edge_rules(spark):
    texts = [json.dumps(p) for p in (
        {"src_ip": "", "severity": 1, "alert": {"severity": 4}}, {"src_ip": "a", "severity": "high"},
        {"src_ip": ["x"], "event_type": {"a": 1}}, {"alert": "text", "severity": 2})] + ["{bad", "x" * (1 << 20) + "x"]
    out = {r.value: r for r in ingest.parse_edge(lines(spark, texts)).collect()}
    pick = lambda i: (out[texts[i]].sensor_id, out[texts[i]].event_type, out[texts[i]].severity, out[texts[i]].parse_status)
    assert [pick(i) for i in range(6)] == [
        ("unknown", "", 4, "ok"), ("a", "", 3, "ok"), ("unknown", "unknown", 3, "ok"), ("unknown", "", 2, "ok"),
        ("unknown", "", 3, "parse_error"), ("unknown", "", 3, "oversize")]


def test_request_bodies(spark):
    bodies = ['[{"a":1},{"a":2}]', '{"a":1}', '[]', '[{"a":1},5]', '7', '"x"', '{bad', 'null']
    df = spark.createDataFrame([(b, NOW) for b in bodies], "body STRING, received_at TIMESTAMP")
    decoded = ingest.decode_bodies(df)
    got = {r.body: (r.body_status, r.n) for r in decoded.select("body", "body_status", F.size("events").alias("n")).collect()}
    assert [got[b][0] for b in bodies] == ["accepted"] * 3 + ["invalid_event"] * 3 + ["invalid_json", "invalid_event"]
    assert (got[bodies[0]][1], got['[]'][1]) == (2, 0)
    assert ingest.accepted_events(decoded).count() == 3


def test_heartbeat_times(spark):
    bodies = ['{"_received_at": 1700000000.9, "node_id": "n"}', '{"_received_at": "abc"}', '{}', '[]', '{x']
    df = spark.createDataFrame([(b, NOW) for b in bodies], "body STRING, received_at TIMESTAMP")
    got = ingest.decode_heartbeats(df.withColumn("b", F.col("body"))).collect()
    by = {r.b: r for r in got}
    assert str(by[bodies[0]].timestamp) == "2023-11-14 22:13:20" and by[bodies[0]].node_id == "n"
    assert by[bodies[1]].ts_substituted and by[bodies[1]].timestamp == NOW.replace(microsecond=0)
    assert (by['{}'].node_id, by['{}'].status) == ("unknown", "ok")
    assert [by[b].body_status for b in bodies[3:]] == ["invalid_heartbeat", "invalid_json"]


@pytest.mark.parametrize("text, want", [
    ("665.4MiB / 1GiB", 665.4), ("1.867GiB / 2GiB", 1.867 * 1024), ("512KiB / 1GiB", 0.5), ("1048576B / 1GiB", 1.0), ("garbage", None)])
def test_memory_sizes(spark, text, want):
    got = spark.createDataFrame([(text,)], "t STRING").select(parsing.mem_mib(F.col("t"))).first()[0]
    assert got == (None if want is None else pytest.approx(want))


@pytest.mark.parametrize("text, want", [
    ("spike_rps1000_trial3", ("spike", 1000, 3)), ("ramp_up_rps5_trial10", ("ramp_up", 5, 10)), ("spike_rps", None)])
def test_run_names(spark, text, want):
    got = spark.createDataFrame([(text,)], "t STRING").select(parsing.run_name(F.col("t")).alias("r")).first().r
    assert (tuple(got) if got else None) == want


@pytest.mark.parametrize("url, want", [
    ("http://Proposed:8000/events", "proposed"), ("localhost:8000", "localhost"), ("baseline:5080", "baseline"), ("10.0.0.1", "10.0.0.1"),
    ("http://user:pw@h.example:1/x", "h.example")])
def test_hosts(spark, url, want):
    assert spark.createDataFrame([(url,)], "u STRING").select(parsing.host_of(F.col("u"))).first()[0] == want


def test_dates_in_names(spark):
    df = spark.createDataFrame([("ablation_batch_20260903_101530",), ("batch_20260712_230000",), ("other",)], "n STRING")
    got = rows(df.select(parsing.date_in_name(F.col("n")).cast("string"), parsing.batch_start(F.col("n")).cast("string")))
    assert got == [("2026-09-03", None), ("2026-07-12", "2026-07-12 21:00:00"), (None, None)]


# --- sinks and streams --------------------------------------------------------------------------

def raw_files(spark, path, n_files=3, per_file=20):
    for f in range(n_files):
        texts = []
        for i in range(per_file):
            k = f * per_file + i
            if k % 10 == 0:
                texts.append("{broken")
            else:
                texts.append(json.dumps({"sensor_id": f"s{k % 4}", "event_type": "ssh", "severity": "high" if k % 7 == 0 else 2,
                                         "inject_id": f"i{k}" if k % 5 == 0 else "", "timestamp": f"2024-01-01T00:00:{k % 60:02d}"}))
        with open(f"{path}/part{f}.log", "w") as out:
            out.write("\n".join(texts) + "\n")


def test_routed_stream_keeps_every_line_and_survives_restart(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    raw_files(spark, str(src))
    base, ckpt = str(tmp_path / "out"), str(tmp_path / "ckpt")
    jobs.routed_ingest(jobs.text_source(spark, str(src), max_files=1), base, ckpt)
    count = lambda: {t: tables.read_route(spark, base, t).count() for t in tables.ROUTES}
    first = count()
    assert sum(first.values()) == 60 and min(first.values()) > 0
    jobs.routed_ingest(jobs.text_source(spark, str(src), max_files=1), base, ckpt)  # nothing new to read
    assert count() == first
    metrics = spark.read.parquet(f"{base}/ingest_metrics").agg(F.sum("n_rows")).first()[0]
    assert metrics == 60
    assert set(r.raw for r in tables.read_route(spark, base, "quarantine").where("reason = 'parse_error'").collect()) == {"{broken"}


def test_byte_bound_of_micro_batches(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    raw_files(spark, str(src))
    size = max(f.stat().st_size for f in src.iterdir())
    base = str(tmp_path / "out")
    jobs.routed_ingest(jobs.text_source(spark, str(src), max_bytes=size), base, str(tmp_path / "ckpt"))
    metrics = spark.read.parquet(f"{base}/ingest_metrics")
    assert metrics.select("batch_id").distinct().count() == 3 and metrics.agg(F.sum("n_rows")).first()[0] == 60


def test_retry_of_a_batch_writes_nothing_twice(spark, tmp_path):
    batch = ingest.validate_rows(lines(spark, ['{"severity": 1}', '{"severity": "bad"}', '{"inject_id": "a"}']))
    for _ in range(2):
        tables.append_routes(batch, 0, str(tmp_path))
    assert [tables.read_route(spark, str(tmp_path), t).count() for t in tables.ROUTES] == [1, 1, 1]


def test_stream_collapse_equals_batch_after_correction(spark, tmp_path):
    t0 = datetime(2024, 1, 1)
    events = [("s", "ssh", t0 + timedelta(seconds=s), 1, 1) for s in (0, 0.5, 1.2, 10, 10.9, 30, 500)]
    schema = "sensor_id STRING, event_type STRING, timestamp TIMESTAMP, severity INT, count BIGINT"
    df = spark.createDataFrame(events, schema)
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = jobs.burst_stream(jobs.table_source(spark, str(tmp_path / "in"), df.schema), "1 second", "10 seconds")
    jobs.run_to_table(stream, str(tmp_path / "t"), str(tmp_path / "c"))
    out = jobs.corrected_bursts(df, spark.read.schema(stream.schema).parquet(str(tmp_path / "t")), 1.0).collect()
    got = sorted(((r.first_ts - t0).total_seconds(), r["count"], r.origin) for r in out)
    assert got == [(0, 3, "stream"), (10, 2, "stream"), (30, 1, "stream"), (500, 1, "correction")]


def test_silence_alarm_and_resent_ids(spark, tmp_path):
    t0 = datetime(2024, 1, 1)
    beats = spark.createDataFrame([("a", t0 + timedelta(minutes=m)) for m in (0, 1, 2, 20, 21)] +
                                  [("b", t0 + timedelta(minutes=m)) for m in range(60)], "node_id STRING, timestamp TIMESTAMP")
    beats.coalesce(1).write.parquet(str(tmp_path / "hb"))
    s = jobs.silence_alarms(jobs.table_source(spark, str(tmp_path / "hb"), beats.schema), "5 minutes", "1 minute")
    jobs.run_to_table(s, str(tmp_path / "hbo"), str(tmp_path / "hbc"))
    got = sorted((r.node_id, (r.last_seen - t0).seconds // 60, (r.alarm_at - t0).seconds // 60) for r in spark.read.schema(s.schema).parquet(str(tmp_path / "hbo")).collect())
    assert got == [("a", 2, 7), ("a", 21, 26)]


def test_total_outage_raises_alarms(spark, tmp_path):
    t0 = datetime(2024, 1, 1)
    beats = spark.createDataFrame([(n, t0 + timedelta(minutes=m)) for n in "ab" for m in (0, 1, 2)], "node_id STRING, timestamp TIMESTAMP")
    clock = spark.createDataFrame([(t0 + timedelta(minutes=m),) for m in range(0, 60, 5)], "timestamp TIMESTAMP")
    beats.coalesce(1).write.parquet(str(tmp_path / "hb"))
    clock.coalesce(1).write.parquet(str(tmp_path / "clock"))
    s = jobs.silence_alarms(jobs.table_source(spark, str(tmp_path / "hb"), beats.schema), "5 minutes", "1 minute",
                            jobs.table_source(spark, str(tmp_path / "clock"), clock.schema))
    jobs.run_to_table(s, str(tmp_path / "out"), str(tmp_path / "ckpt"))
    assert sorted(r.node_id for r in spark.read.schema(s.schema).parquet(str(tmp_path / "out")).collect()) == ["a", "b"]


def test_late_windows_are_corrected(spark, tmp_path):
    t0 = datetime(2024, 1, 1)
    schema = "sensor_id STRING, event_type STRING, timestamp TIMESTAMP, severity INT, count BIGINT"
    events = [("s", "ssh", t0 + timedelta(minutes=m), 1, 1) for m in (0, 1, 7, 40)]
    df = spark.createDataFrame(events, schema)
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = jobs.feature_stream(jobs.table_source(spark, str(tmp_path / "in"), df.schema), "10 minutes")
    jobs.run_to_table(stream, str(tmp_path / "t"), str(tmp_path / "c"))
    late = spark.createDataFrame([("late", "ssh", t0 + timedelta(minutes=2), 1, 1)], schema)
    out = jobs.corrected_windows(df.unionByName(late), spark.read.schema(stream.schema).parquet(str(tmp_path / "t"))).collect()
    got = sorted(((r.window_start - t0).seconds // 60, r.event_count, r.origin) for r in out)
    assert got == [(0, 3, "correction"), (5, 1, "stream"), (40, 1, "correction")]


def test_late_ids_are_added_once(spark):
    t0 = datetime(2024, 1, 1)
    schema = "inject_id STRING, timestamp TIMESTAMP, v INT"
    emitted = spark.createDataFrame([("a", t0, 1)], schema)
    raw = spark.createDataFrame([("a", t0, 1), ("a", t0, 1), ("b", t0 + timedelta(seconds=5), 3), ("b", t0, 2)], schema)
    got = sorted((r.inject_id, r.v, r.origin) for r in jobs.corrected_ids(raw, emitted).collect())
    assert got == [("a", 1, "stream"), ("b", 2, "correction")]


def test_verified_export_day_by_day(spark, tmp_path):
    t0 = datetime(2024, 1, 1)
    data = [(t0 + timedelta(days=d), f"s{i}") for d in range(4) for i in range(5)]
    df = spark.createDataFrame(data, "timestamp TIMESTAMP, sensor_id STRING")
    for day in (1, 2):  # the second call must leave the first day alone and report on its own only
        status = tables.verified_export(df.where(F.dayofmonth("timestamp") == day), str(tmp_path / "days"))
        assert [(str(r.day), r.status, r.row_count) for r in status.collect()] == [(f"2024-01-0{day}", "success", 5)]
    assert spark.read.parquet(str(tmp_path / "days")).count() == 10


def test_cleanup_twice_keeps_both_exports(spark, tmp_path):
    t0 = datetime(2024, 1, 1)
    data = [(t0 + timedelta(days=d), f"s{i}", "inj" if d == 2 or (d + i) % 3 == 0 else "") for d in range(4) for i in range(5)]
    df = spark.createDataFrame(data, "timestamp TIMESTAMP, sensor_id STRING, inject_id STRING").withColumn(
        "event_date", F.to_date("timestamp"))
    table, out = str(tmp_path / "table"), str(tmp_path / "exp")
    for run in ("one", "two"):
        df.write.mode("append").partitionBy("event_date").parquet(table)
        moved, _ = tables.cleanup_synthetic(table, out, spark, run)
        left = spark.read.parquet(table)
        assert moved == sum(1 for r in data if r[2]) and left.where("inject_id <> ''").count() == 0
    assert spark.read.parquet(out).count() == 2 * moved
    assert left.count() + 2 * moved == 2 * len(data)
    with pytest.raises(Exception, match="already exists"):
        tables.cleanup_synthetic(table, out, spark, "two")
    assert tables.expire_days(spark, table, (t0 + timedelta(days=3)).date(), 2) == [t0.date()]
    assert spark.read.parquet(table).select("event_date").distinct().count() == 2
    with pytest.raises(FileNotFoundError):
        tables.drop_days(spark, table, [t0.date()])


def test_retention_and_compaction_act_on_ingested_tables(spark, tmp_path):
    base = str(tmp_path)
    for b, day in enumerate((1, 1, 5)):
        texts = [json.dumps({"sensor_id": f"s{i}", "timestamp": f"2024-01-0{day}T00:00:00"}) for i in range(4)]
        tables.append_routes(ingest.validate_rows(lines(spark, texts)), b, base)
    path = tables.route_path(base, "threat_events")
    tables.compact_days(spark, path, [datetime(2024, 1, 1).date()], 1)
    table = tables.read_route(spark, base, "threat_events")
    assert table.count() == 12 and sorted({r.batch_id for r in table.collect()}) == [1, 2]
    gone = tables.expire_routes(spark, base, datetime(2024, 1, 6).date(), {"threat_events": 3})
    assert gone == {"threat_events": [datetime(2024, 1, 1).date()]}
    assert tables.read_route(spark, base, "threat_events").count() == 4


def test_ledger_retry_adds_nothing(spark, tmp_path):
    rows = spark.createDataFrame([(1,)], "n INT")
    for run in ("a", "a", "b"):
        tables.append_ledger(rows, str(tmp_path / "ledger"), run)
    assert spark.read.parquet(str(tmp_path / "ledger")).count() == 2


def test_feature_export_needs_a_row(spark, tmp_path):
    empty = spark.createDataFrame([], "window_start STRING, event_count INT")
    with pytest.raises(ValueError):
        tables.write_feature_csv(empty, str(tmp_path / "x"))
