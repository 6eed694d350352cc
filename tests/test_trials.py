"""Trial folders with the files that experiments leave, whole, missing and broken."""

import json

import pytest

from gapspark.session import build_session, shared_dir
from gapspark.sources import trials


def put(base, name, text):
    path = base / name
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text)


CSV = "timestamp,container,cpu_percent,mem_usage,mem_percent,block_io\n1,{s}-1,10.0,1MiB / 2MiB,5.0,0B / 0B\n2,{s}-1,30.0,x,7.0,-\n2,other,99.0,x,9.0,-\n"


def test_trial_folders(spark, tmp_path):
    loss = {"baseline": {"total_injected": 10, "loss_rate_percent": 50.0}, "proposed": {"total_injected": 10, "loss_rate_percent": 0.0}}
    put(tmp_path, "spike_rps100_trial1/loss_rate.json", json.dumps(loss, indent=2))
    put(tmp_path, "spike_rps100_trial1/resource_baseline.csv", CSV.format(s="baseline"))
    put(tmp_path, "spike_rps100_trial1/notes.json", "{}")
    put(tmp_path, "spike_rps100_trial2/resource_proposed.csv", CSV.format(s="proposed"))
    put(tmp_path, "spike_rps100_trial3/loss_rate.json", '{"baseline": {"total_inj')
    put(tmp_path, "spike_rps100_trial4/loss_rate.json", "[]")
    put(tmp_path, "notes/loss_rate.json", json.dumps(loss))
    got = {r.trial: r for r in trials.scan_trials(spark, str(tmp_path)).collect()}
    assert sorted(got) == [1, 2, 3, 4]
    assert (got[1].loss_status, got[1].baseline.loss_rate_percent, got[1].proposed.total_injected) == ("ok", 50.0, 10)
    assert (got[1].baseline_resources.cpu_peak, got[1].baseline_resources.mem_mean, got[1].proposed_resources) == (30.0, 6.0, None)
    assert (got[2].loss_status, got[2].baseline, got[2].proposed_resources.cpu_mean) == ("missing", None, 20.0)
    assert [got[k].loss_status for k in (3, 4)] == ["unreadable", "unreadable"]


def test_edge_ablation_and_drift_folders(spark, tmp_path):
    meta = {"edge_count": 2, "edge_mode": "scaled", "base_rps": 100}
    put(tmp_path, "e/multiedge_1/meta.json", json.dumps(meta, indent=1))
    put(tmp_path, "e/multiedge_1/loss_rate.json", json.dumps({"proposed": {"loss_rate_percent": 1.5}}))
    put(tmp_path, "e/multiedge_2/meta.json", json.dumps(meta))
    put(tmp_path, "e/multiedge_3/meta.json", json.dumps(meta))
    put(tmp_path, "e/multiedge_3/loss_rate.json", json.dumps({"baseline": {"loss_rate_percent": 1.5}}))
    edges = {r.trial_id: r for r in trials.scan_edge_trials(spark, str(tmp_path / "e")).collect()}
    assert [(edges[f"multiedge_{k}"].complete, edges[f"multiedge_{k}"].loss_status) for k in (1, 2, 3)] == [
        (True, "ok"), (False, "missing"), (False, "ok")]
    assert edges["multiedge_1"].loss_rate_percent == 1.5 and edges["multiedge_2"].edge_count == 2

    put(tmp_path, "a/w100_trial1/results.json", json.dumps({"window_ms": 100, "count_matches": True}, indent=1))
    put(tmp_path, "a/w100_trial1/resource_vector.csv", CSV.format(s="v"))
    put(tmp_path, "a/w100_trial2/results.json", "{")
    put(tmp_path, "a/w100_trial3/resource_vector.csv", CSV.format(s="v"))
    ablation = {r.trial: r for r in trials.scan_ablation(spark, str(tmp_path / "a")).collect()}
    assert [(ablation[f"w100_trial{k}"].result_status, ablation[f"w100_trial{k}"].complete) for k in (1, 2, 3)] == [
        ("ok", True), ("unreadable", False), ("missing", False)]
    assert ablation["w100_trial1"].window_ms == 100 and ablation["w100_trial3"].cpu_peak == 99.0

    run = {"scenario": "sudden", "trial": 1, "seed": 42, "detection_lag": 3, "false_alarm_windows": [1, 2]}
    put(tmp_path, "d/cron_run1/sudden_trial1/fidelity_results.json", json.dumps(run, indent=1))
    put(tmp_path, "d/cron_run2/sudden_trial1/fidelity_results.json", "oops")
    drift = {r.run: r for r in trials.scan_drift_runs(spark, str(tmp_path / "d")).collect()}
    assert (drift["cron_run1"].seed, drift["cron_run1"].false_alarm_windows) == (42, [1, 2])
    assert (drift["cron_run2"].result_status, drift["cron_run2"].scenario) == ("unreadable", None)


def test_guarded_reads_tell_empty_from_broken(spark, tmp_path):
    from gapspark.operators.filters import KNOWN_SENSOR_IDS
    from gapspark.sources import guarded

    schema = spark.createDataFrame([], "ip string, n int").schema
    rows = spark.createDataFrame([("10.0.0.1", 1), ("10.0.0.2", 2)], schema)
    rows.repartition(2).write.parquet(f"{tmp_path}/whole")
    rows.write.parquet(f"{tmp_path}/cut")
    rows.limit(0).write.parquet(f"{tmp_path}/empty")
    one = next((tmp_path / "cut").glob("part-*.parquet"))
    (tmp_path / "cut" / "part-half.parquet").write_bytes(one.read_bytes()[:-20])
    (tmp_path / "cut" / "part-none.parquet").write_bytes(b"")
    names = {n: f"{tmp_path}/{n}" for n in ("whole", "cut", "empty", "absent")}
    read, states = guarded.guarded_sources(spark, names, schema)
    got = {r.system: (r.source_status, r.n_rows, r.n_unreadable) for r in states.collect()}
    assert got == {"whole": ("ok", 2, 0), "cut": ("unreadable", 2, 2), "empty": ("ok", 0, 0), "absent": ("missing", 0, 0)}
    assert {r.system: r["count"] for r in read.groupBy("system").count().collect()} == {"whole": 2, "cut": 2}
    ids = {n: guarded.guarded_node_ids(spark, p, schema) for n, p in names.items()}
    assert {r.ip for r in ids["whole"][0].collect()} == {"10.0.0.1", "10.0.0.2"}
    assert all({r.ip for r in ids[n][0].collect()} == set(KNOWN_SENSOR_IDS) for n in ("cut", "empty", "absent"))


def test_shared_folder_is_needed_on_a_cluster():
    class Session:
        class conf:
            get = staticmethod(lambda key, default=None: default)

        class sparkContext:
            master, applicationId = "spark://host:7077", "app-1"

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared_dir(Session, "x")
    Session.sparkContext.master = "local[2]"
    assert shared_dir(Session, "x").rpartition("/")[0] == shared_dir(Session, "y").rpartition("/")[0]
    assert build_session
