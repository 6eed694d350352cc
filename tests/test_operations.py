"""Reports, reconciliation, ledger decisions, features and drift on hand cases."""

from datetime import date, datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import rows
from gapspark.operators import drift as dr
from gapspark.operators import enrich, experiments, ledger, monitor, reconcile, retention
from gapspark.operators import features as ft
from gapspark.plans import drift_study
from gapspark.sources import daily_files, send_logs

T0 = datetime(2026, 7, 15, 12)


def events(spark, data):
    return spark.createDataFrame(
        [(t, s, e, sev, c, inj) for t, s, e, sev, c, inj in data],
        "timestamp TIMESTAMP, sensor_id STRING, event_type STRING, severity SMALLINT, count BIGINT, inject_id STRING")


def test_exclusions_and_half_open_day_range(spark):
    e = events(spark, [(datetime(2026, 7, d, 1), s, "ssh", 1, 2, i) for d, s, i in (
        (6, "a", ""), (7, "a", ""), (12, "a", ""), (13, "a", ""), (13, "unknown", ""), (13, "", ""), (13, "203.0.113.10", ""), (13, "a", "x"))])
    got = rows(monitor.clean_daily_counts(e, "2026-07-01", "2026-08-01", ("2026-07-07", "2026-07-13")))
    assert got == [(date(2026, 7, 6), 2), (date(2026, 7, 13), 2)]


def test_range_filters_reach_the_scan(spark, sf):
    from gapspark.sources.driver_tables import view
    df = monitor.clean_daily_counts(view(spark, sf, "threat_events"), "2024-01-02", "2024-01-30")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(ts," in plan and "LessThan(ts," in plan and "props" not in plan


def test_counts_rows_or_sums_as_defined(spark):
    e = events(spark, [(T0, "a", "ssh", 4, 5, ""), (T0, "b", "ssh", 1, 1, ""), (T0 - timedelta(hours=30), "c", "dns", 1, 9, "")])
    assert rows(monitor.event_type_summary(e)) == [("ssh", 2, 4)]
    assert rows(monitor.top_sensors(e, limit=1)) == [("a", 5)]
    assert {r.check: r.status for r in monitor.health_checks(e).collect()} == {
        "rows_last_5_minutes": "OK", "sensors_last_hour": "OK", "latest_event": "OK"}
    later = {r.check: r.status for r in monitor.health_checks(e, T0 + timedelta(days=1)).collect()}
    assert later == {"rows_last_5_minutes": "NG", "sensors_last_hour": "NG", "latest_event": "OK"}


def test_loss_report(spark):
    sent = spark.createDataFrame([(f"p-{i}", "proposed:8000", "1") for i in range(1, 5)] + [("p-9", "proposed:8000", "0"), ("b-1", "baseline:1", None)],
                                 "inject_id STRING, target STRING, sent_ok STRING")
    recorded = spark.createDataFrame([("p-1",), ("p-2",), ("p-2",), ("b-1",)], "inject_id STRING")
    systems = spark.createDataFrame([("proposed", "proposed", False), ("baseline", "baseline", True)], "system STRING, host STRING, verification_failed BOOLEAN")
    ids = reconcile.sent_ids(sent)
    got = {r.system: r for r in reconcile.loss_report(ids, recorded, systems).collect()}
    p = got["proposed"]
    assert (p.total_injected, p.total_recorded, p.total_lost, p.loss_rate_percent, p.status) == (4, 2, 2, 50.0, "DATA LOSS")
    assert (got["baseline"].loss_rate_percent, got["baseline"].status) == (0.0, "UNVERIFIED")
    assert reconcile.lost_ids(ids, recorded).count() + reconcile.found_ids(ids, recorded).count() == ids.count()
    assert reconcile.end_to_end(reconcile.loss_report(ids, recorded, systems)).first().verdict == "FAIL"
    assert reconcile.sent_ids(sent.drop("sent_ok")).count() == 6


def test_recorded_range_has_slack(spark):
    stored = spark.createDataFrame([("a", T0), ("b", T0 + timedelta(minutes=10)), ("c", T0 + timedelta(minutes=11)), ("", T0)], "inject_id STRING, timestamp TIMESTAMP")
    assert sorted(r[0] for r in reconcile.recorded_ids(stored, T0, T0).collect()) == ["a", "b"]


def test_send_logs_merge(spark, tmp_path):
    for i in range(2):
        (tmp_path / f"edge=e{i}").mkdir()
        (tmp_path / f"edge=e{i}" / "log.csv").write_text("inject_id,timestamp,event_type,target,sent_ok\n" + f"x{i},2024-01-01,ssh,h:1,1\n")
    got = send_logs.read_send_logs(spark, [str(tmp_path / "edge=e0"), str(tmp_path / "edge=e1")])
    assert sorted((r.inject_id, r.edge) for r in got.collect()) == [("x0", "e0"), ("x1", "e1")]


LOG = "backup_date DATE, node_id STRING, table_name STRING, status STRING, row_count BIGINT, created_at TIMESTAMP"


@pytest.mark.parametrize("stored, again, want", [(10, None, "delete"), (12, None, "re_export"), (8, None, "delete"), (None, None, "skip"), (12, 12, "delete"), (12, 11, "keep")])
def test_prune_decisions(spark, stored, again, want):
    day = date(2026, 7, 1)
    log = spark.createDataFrame([(day, "n", "threat_events", "success", 4, T0), (day, "n", "threat_events", "success", 10, T0 + timedelta(hours=1))], LOG)
    rows_now = spark.createDataFrame([(day, stored)] if stored else [], "day DATE, n_rows BIGINT")
    redo = spark.createDataFrame([(day, again)], "day DATE, backed_rows BIGINT") if again else None
    got = ledger.prune_decisions(log, rows_now, as_of=datetime(2026, 7, 20), reexported=redo).collect()
    assert [(r.backed_rows, r.decision) for r in got] == [(10, want)]


def test_prune_needs_age_and_no_earlier_prune(spark):
    log = spark.createDataFrame([
        (date(2026, 7, 1), "n", "threat_events", "success", 1, T0), (date(2026, 7, 1), "n", "threat_events_local_prune", "success", 1, T0),
        (date(2026, 7, 19), "n", "threat_events", "success", 1, T0), (date(2026, 7, 2), "n", "threat_events", "upload_failed", 1, T0)], LOG)
    assert ledger.not_yet_pruned(log, as_of=datetime(2026, 7, 20)).count() == 0


def test_catch_up_caps_per_run_and_says_how_many_remain(spark):
    today = date(2026, 7, 20)
    log = spark.createDataFrame([
        (today - timedelta(days=3), "n", "heartbeats", "success", 1, T0),
        (today - timedelta(days=4), "n", "heartbeats", "success", 1, T0), (today - timedelta(days=4), "n", "heartbeats", "upload_failed", 1, T0 + timedelta(hours=1))], LOG)
    got = [r for r in ledger.catch_up_days(log, as_of=datetime(2026, 7, 20)).collect() if r.table_name == "heartbeats"]
    back = sorted((today - r.backup_date).days for r in got)
    assert back == [2, 4, 5, 6, 7, 8, 9] and {r.remaining for r in got} == {5}


def test_ledger_gaps_use_minute_boundaries(spark):
    t = datetime(2026, 7, 1, 0, 0, 59)
    log = spark.createDataFrame([("n", x) for x in (t, t + timedelta(minutes=480), t + timedelta(minutes=961, seconds=1))], "node_id STRING, created_at TIMESTAMP")
    got = rows(ledger.record_gaps(log, ["node_id"], "created_at", 480).select("gap_minutes"))
    assert got == [(482,)]


def test_export_status_tells_failed_count_from_zero(spark):
    d = lambda xs: spark.createDataFrame([(date(2026, 7, x), n) for x, n in xs], "day DATE, n_rows BIGINT")
    failed = spark.createDataFrame([(date(2026, 7, 4),)], "day DATE")
    got = {r.day.day: (r.status, r.row_count) for r in retention.export_status(d([(1, 5), (2, 5), (3, 0), (5, 5)]), d([(1, 5), (2, 4), (3, 0)]), failed).collect()}
    assert got == {1: ("success", 5), 2: ("upload_failed", 0), 3: ("success", 0), 4: ("export_failed", 0), 5: ("export_failed", 0)}


def test_strict_daily_read(spark, tmp_path):
    df = spark.createDataFrame([(datetime(2026, 7, d, 3), d) for d in (1, 2, 4)], "timestamp TIMESTAMP, v INT")
    base = str(tmp_path / "d")
    df.withColumn("file_day", F.when(F.col("v") == 2, F.lit("2026-07-01")).otherwise(F.to_date("timestamp").cast("string"))).write.partitionBy("file_day").parquet(base)
    r = daily_files.read_days(spark, base, df.schema)
    got = sorted((str(x.file_day), x.violation, x.n_rows) for x in daily_files.day_violations(r, "2026-07-01", "2026-07-04", ("2026-07-03", "2026-07-04")).collect())
    assert got == [("2026-07-01", "rows_of_another_day", 1), ("2026-07-02", "absent_day", 0)]
    with pytest.raises(ValueError, match="absent_day"):
        daily_files.require_complete(r, "2026-07-01", "2026-07-04")


def test_missing_windows_and_no_filling(spark):
    t = lambda m: datetime(2026, 7, 1, 10, m)
    w = spark.createDataFrame([(t(m),) for m in (0, 15, 25, 35)], "window_start TIMESTAMP")
    assert ft.missing_windows(w).first().missing_windows == 4
    e = events(spark, [(t(1), "a", "ssh", 1, 1, ""), (t(2), "a", "dns", 3, 1, ""), (t(21), "b", "ssh", 2, 1, "")])
    got = {r.window_start.minute: (r.event_count, r.unique_sensors, r.avg_severity, r.ssh_count) for r in ft.feature_windows(e).collect()}
    assert got == {0: (2, 1, 2.0, 1), 20: (1, 1, 2.0, 1)}


def test_calendar_fill_is_marked(spark):
    h = spark.createDataFrame([(datetime(2026, 7, 1, 5), 7)], "hour TIMESTAMP, event_count BIGINT")
    got = ft.on_hour_calendar(h, "2026-07-01", "2026-07-01").collect()
    assert len(got) == 24 and [(r.hour.hour, r.event_count) for r in got if not r.is_filled] == [(5, 7)]


def test_normalisation_of_a_constant_column(spark):
    w = spark.createDataFrame([(1.0, 4.0), (3.0, 4.0)], "a DOUBLE, b DOUBLE")
    stats = ft.normalisation(w, ("a", "b"))
    assert stats.first().b_std == 1.0 and stats.first().a_std == 1.0
    assert sorted(rows(ft.normalise(w, stats, ("a", "b")))) == [(-1.0, 0.0), (1.0, 0.0)]


def test_too_short_series_is_an_error():
    with pytest.raises(ValueError, match="Not enough data"):
        ft.require_sequences(5, 5)


def test_geo_lookup_matches_ranges(spark):
    number = lambda a: int.from_bytes(bytes(map(int, a.split("."))), "big")
    ranges = spark.createDataFrame([("a", number("10.0.0.0"), number("10.1.255.255")), ("b", number("200.7.3.4"), number("200.7.3.4"))],
                                   "range_name STRING, lo BIGINT, hi BIGINT")
    ips = ["10.0.0.0", "10.1.255.255", "10.2.0.0", "200.7.3.4", "200.7.3.5", "10.0.0.256", "10.0.0", "10.0.0.1.5", "10.0.0.x", "bad", "", None]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(ips)], "i INT, src_ip STRING")
    got = [r.range_name for r in enrich.geo_lookup(df, ranges, "src_ip", ["range_name"]).orderBy("i").collect()]
    assert got == ["a", "a", None, "b"] + [None] * 8


# --- drift ----------------------------------------------------------------------------------------

def run(spark, flags, mses):
    m = spark.createDataFrame([("r", i, i in flags) for i in range(40)], "run STRING, block BIGINT, drift_detected BOOLEAN")
    e = spark.createDataFrame([("r", i, mses.get(i, 1.0)) for i in range(40)], "run STRING, block BIGINT, mse DOUBLE")
    return dr.verdicts(m, e, ["run"], 18).first()


@pytest.mark.parametrize("detected, dropped, lag, leads, confirmed", [
    (19, 20, -1, True, True), (20, 20, 0, False, True), (28, 20, 8, False, True), (29, 20, 9, False, False),
    (None, 20, None, False, False), (25, None, None, False, False)])
def test_verdicts(spark, detected, dropped, lag, leads, confirmed):
    r = run(spark, {detected}, {dropped: 4.0, 5: 1.0} if dropped else {})
    assert (r.detection_lag, r.fidelity_leads, r.confirming_detected) == (lag, leads, confirmed)


def test_false_alarms_only_when_armed(spark):
    m = spark.createDataFrame([("r", i, i in (3, 20, 25)) for i in range(28)], "run STRING, block BIGINT, drift_detected BOOLEAN")
    r = dr.false_alarms(m, ["run"], 17).first()
    assert (r.false_alarms, r.n_evaluated_windows, r.first_false_alarm) == (2, 11, 20)


def test_run_summaries(spark):
    runs = spark.createDataFrame([("sudden", False, True, 2), ("sudden", False, True, 4), ("sudden", False, False, 12)],
                                 "scenario STRING, fidelity_leads BOOLEAN, confirming_detected BOOLEAN, detection_lag INT")
    r = experiments.drift_run_summary(runs).first()
    assert (r.n_trials, r.confirmed, r.mean_detection_lag, r.lead_verdict) == (3, 2, 3.0, "Not confirmed")
    nulls = spark.createDataFrame([(a, 11) for a in (0, 1, 3, 0)], "false_alarms INT, n_evaluated_windows INT")
    n = experiments.null_run_summary(nulls).first()
    assert (n.false_alarm_trial_count, n.false_alarm_trial_rate, n.false_alarm_window_count, n.evaluated_window_count) == (2, 0.5, 4, 44)


def plain_monitor(shap, fidelity, b, z=2.0, margin=0.01):
    """Plain numpy statement of the adaptive rule for one run; ``shap``: blocks of (samples, features)."""
    def cos(a, c):
        p, q = np.abs(a).mean(0), np.abs(c).mean(0)
        return float(np.clip(p @ q / np.linalg.norm(p) / np.linalg.norm(q), 0, 1))
    loo = [cos(shap[j], np.concatenate([shap[k] for k in range(b) if k != j])) for j in range(b - 1)]
    limit = np.mean(loo) - max(z * np.std(loo), margin) if loo else None
    out = []
    for i in range(len(shap)):
        if i < b - 1:
            out.append(np.mean(fidelity[max(0, i - 4):i + 1]) < 0.5)
        else:
            out.append(bool(limit is not None and cos(shap[i], np.concatenate(shap[:b])) < limit))
    return out


@pytest.mark.parametrize("baseline", [1, 2, 6])
def test_adaptive_monitor(spark, baseline):
    rng = np.random.default_rng(5)
    shap = [rng.normal(0, 1, (10, 4)) * ([1, 1, 1, 1] if i < 8 else [6, 0.2, 1, 1]) for i in range(14)]
    fid = rng.uniform(0.2, 1, 14)
    a = spark.createDataFrame([("r", i, f, float(v)) for i, s in enumerate(shap) for row in s for f, v in enumerate(row)], "run STRING, block BIGINT, feature INT, value DOUBLE")
    f = spark.createDataFrame([("r", i, float(v)) for i, v in enumerate(fid)], "run STRING, block BIGINT, fidelity_score DOUBLE")
    got = {r.block: r.drift_detected for r in dr.monitor_adaptive(f, dr.profiles(a, ["run"]), ["run"], baseline).collect()}
    assert [got[i] for i in range(14)] == plain_monitor(shap, fid, baseline)


def test_linear_forecaster_explains_itself_and_sees_drift(spark):
    rng = np.random.default_rng(2)
    n = 260
    x = np.sin(np.arange(n) / 5) + rng.normal(0, 0.05, n)
    y = np.cos(np.arange(n) / 5) + rng.normal(0, 0.05, n)
    x[200:], y[200:] = rng.normal(0, 3, 60), rng.normal(4, 3, 60)
    t = [(datetime(2024, 1, 1) + timedelta(hours=i), float(a), float(b)) for i, (a, b) in enumerate(zip(x, y))]
    df = spark.createDataFrame(t, "hour TIMESTAMP, a DOUBLE, b DOUBLE")
    mon, verdict = drift_study.drift_study(df, ("a", "b"), "hour", n_normal=200, n_total=n)
    m = mon.collect()
    assert len(m) == 24 and all(r.fidelity_score == pytest.approx(1.0) for r in m)
    v = verdict.first()
    assert v.first_accuracy_drop is not None and v.first_accuracy_drop >= 18
    assert v.false_alarm_blocks_before_change == sorted(r.block for r in m if r.drift_detected and r.block < 18)
