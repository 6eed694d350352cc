"""Streaming jobs that keep their own account, on small inputs."""

from datetime import datetime, timedelta

from gapspark.operators import ingest
from gapspark.operators.collapse import KEYS, collapse_bursts
from gapspark.streaming import jobs, watches

T0 = datetime(2024, 1, 1)


def at(seconds):
    return T0 + timedelta(seconds=seconds)


def test_every_silence_alarms_once(spark, tmp_path):
    src, out, checkpoint = (f"{tmp_path}/{n}" for n in ("in", "out", "cp"))
    rows = [("a", at(i)) for i in range(50)] + [("b", at(3)), ("c", None), (None, at(1))]
    schema = "node_id string, timestamp timestamp"
    spark.createDataFrame(rows, schema).repartition(3).write.parquet(src)
    alarms = lambda: [tuple(r) for r in spark.read.schema(watches.ALARMS).parquet(out).select(
        "node_id", "first_seen", "last_seen", "n_heartbeats").collect()]
    beats = spark.readStream.schema(schema).parquet(src)
    query = watches.run_watch(watches.silence_watch(beats, 2), out, checkpoint)
    assert watches.stop_when(query, lambda: bool(query.recentProgress) and len(alarms()) >= 2, 60)
    first = [("a", at(0), at(49), 50), ("b", at(3), at(3), 1)]
    assert sorted(alarms()) == first
    # after a restart the silent nodes stay quiet; a node that came back and stops again alarms again
    spark.createDataFrame([("b", at(100))], schema).write.mode("append").parquet(src)
    query = watches.run_watch(watches.silence_watch(beats, 2), out, checkpoint)
    assert watches.stop_when(query, lambda: len(alarms()) >= 3, 60)
    assert sorted(alarms()) == sorted([*first, ("b", at(100), at(100), 1)])


def test_observed_counts_equal_stored_rows(spark, tmp_path):
    lines = ['{"sensor_id": "s", "event_type": "login"}', "not json", '{"severity": "x"}', '{"timestamp": "2024-01-01T00:00:00Z"}']
    spark.createDataFrame([(x,) for x in lines * 6], "value string").repartition(12).write.text(f"{tmp_path}/in")
    ledger = watches.BatchLedger(spark, "ingest", f"{tmp_path}/ledger", flush=5)
    source = jobs.text_source(spark, f"{tmp_path}/in", max_files=1)
    watches.run_observed(watches.observed_ingest(ingest.validate_rows(source)), f"{tmp_path}/out", f"{tmp_path}/cp", ledger, ("target",))
    counts = ledger.read().selectExpr(
        "count(*)", "sum(received)", "sum(accepted)", "sum(quarantined)", "sum(parse_errors)", "sum(ts_substituted)").first()
    stored = spark.read.parquet(f"{tmp_path}/out")
    bad = stored.where("target = 'quarantine'")
    assert counts[0] >= 12 and tuple(counts)[1:] == (24, 12, 12, 6, 6)
    assert (stored.count(), bad.count()) == (24, 12) and bad.where("reason = 'parse_error'").count() == 6


def test_a_batch_of_one_file_is_read_by_several_tasks(spark, tmp_path):
    line = '{"timestamp":"2024-01-01T00:00:00","sensor_id":"s","event_type":"login","severity":2}'
    n = 20_000  # 1.7 MB: one part, where a part has the usual 4 MB at least
    spark.createDataFrame([(line,)], "value string").selectExpr(f"explode(array_repeat(value, {n})) AS value").coalesce(1).write.text(
        f"{tmp_path}/in")
    cost = spark.conf.get("spark.sql.files.openCostInBytes")
    ledger = watches.BatchLedger(spark, "ingest", f"{tmp_path}/ledger")
    source = jobs.text_source(spark, f"{tmp_path}/in", max_files=1)
    watches.run_observed(watches.observed_ingest(ingest.validate_rows(source)), f"{tmp_path}/out", f"{tmp_path}/cp", ledger)
    stored = spark.read.parquet(f"{tmp_path}/out")
    assert len(stored.inputFiles()) >= 4
    assert stored.where("reason IS NULL").count() == n
    assert ledger.read().selectExpr("count(*)", "sum(received)", "sum(accepted)").first() == (1, n, n)
    assert spark.conf.get("spark.sql.files.openCostInBytes") == cost


def test_tail_counts_groups_and_errors(spark, tmp_path):
    lines = ['{"vector_ingest_ts_first": 1000, "vector_ingest_ts_last": 1400, "count": 3}', "", "{", '{"vector_ingest_ts_first": 1}',
             '{"vector_ingest_ts_first": "5", "vector_ingest_ts_last": 9}']
    spark.createDataFrame([(x,) for x in lines], "value string").repartition(3).write.text(f"{tmp_path}/in")
    ledger = watches.BatchLedger(spark, "tail", f"{tmp_path}/ledger", flush=1)
    from pyspark.sql import functions as F
    tail = watches.collapsed_tail(jobs.text_source(spark, f"{tmp_path}/in", max_files=1), F.lit(2000))
    watches.run_observed(tail, f"{tmp_path}/out", f"{tmp_path}/cp", ledger)
    seen = ledger.read().selectExpr("sum(n_groups)", "sum(parse_errors)", "sum(total_count)").first()
    assert tuple(seen) == (2, 2, 3)
    waits = spark.read.parquet(f"{tmp_path}/out").where("not parse_error").select("wait_upper_ms", "wait_lower_ms").collect()
    assert sorted(map(tuple, waits)) == [(1000.0, 600.0), (1995.0, 1991.0)]


def test_late_rows_are_counted_and_complete_the_bursts(spark, tmp_path):
    schema = "event_id long, sensor_id string, event_type string, timestamp timestamp, count long, severity int"
    row = lambda i, s, t: (i, s, "login", None if t is None else at(t), 1, i % 5)
    deliveries = [
        [row(1, "a", 0), row(2, "a", 8), row(3, "b", 100), row(4, "c", None)],
        [row(5, "a", 18), row(6, "a", 60), row(7, "b", 95)],      # a 18 and b 95 lie behind nothing yet: lateness 90
        [row(8, "a", 300), row(9, "b", 105)],
        [row(10, "a", 70), row(11, "b", 110), row(12, "b", 50), row(13, "d", 20), row(14, "a", 305)],  # all late but a 305
        [],
        [row(15, "a", 400), row(15, "a", 400)],
    ]
    src, base = f"{tmp_path}/in", f"{tmp_path}/out"
    for n, part in enumerate(deliveries):
        spark.createDataFrame(part, schema).write.parquet(f"{src}/delivery={n}")
        watches.burst_ledger(spark.readStream.schema(schema).parquet(f"{src}/*"), base, f"{tmp_path}/cp", 10, 90)
    late = sorted(r.event_id for r in watches.late_table(spark, base).collect())
    assert late == [10, 11, 12, 13]
    totals = watches._ledger(spark, base).selectExpr("sum(n_rows)", "sum(n_late)", "sum(n_untimed)").first()
    assert tuple(totals) == (16, 4, 1)
    columns = [*KEYS, "timestamp", "first_ts", "count", "severity", "raw_rows"]
    everything = spark.createDataFrame([r for d in deliveries for r in d], schema)
    whole = watches.ledger_bursts(spark, base, 10).select(*columns, "origin").collect()
    want = collapse_bursts(everything, 10).select(*columns).collect()
    assert sorted(tuple(r)[:-1] for r in whole) == sorted(map(tuple, want))
    origin = {(r.sensor_id, r.first_ts): r.origin for r in whole}
    assert origin["a", at(0)] == "stream" and origin["a", at(60)] == "correction" and origin["d", at(20)] == "correction"
    assert origin["b", at(95)] == "correction" and origin["a", at(400)] == "correction"  # still open
