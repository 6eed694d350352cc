"""Order-dependent building blocks against brute force, with a hot key and hot values."""

import random
from collections import Counter, defaultdict
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import rows
from gapspark.operators import collapse, coverage, features, intervals, ordered


@pytest.fixture(scope="module")
def samples(spark):
    rng = random.Random(7)
    data = [("hot", float(rng.choice([1, 1, 1, rng.random()])),) for _ in range(700)]
    data += [(f"k{rng.randrange(5)}", rng.gauss(0, 1)) for _ in range(500)] + [(None, 3.0), (None, 5.0), ("hot", None)]
    return data, spark.createDataFrame(data, "k STRING, value DOUBLE")


def by_key(data):
    out = defaultdict(list)
    for k, v in data:
        if v is not None:
            out[k].append(v)
    return out


def test_midranks_match_brute_force_and_keep_null_keys(samples):
    data, df = samples
    got = {(r.k, r.value): r.midrank for r in ordered.midranks(ordered.value_counts(df, ["k"], "value"), ["k"], "value").collect()}
    want = {}
    for k, values in by_key(data).items():
        ordered_values = sorted(values)
        for v in set(values):
            places = [i + 1 for i, x in enumerate(ordered_values) if x == v]
            want[(k, v)] = sum(places) / len(places)
    assert got == pytest.approx(want)


def test_quantiles_match_numpy(samples):
    data, df = samples
    probs = {"q05": 0.05, "q50": 0.5, "q95": 0.95, "q100": 1.0}
    for r in ordered.quantiles(df, ["k"], "value", probs).collect():
        values = by_key(data)[r.k]
        assert r.n_values == len(values)
        for name, p in probs.items():
            assert r[name] == pytest.approx(np.percentile(values, 100 * p))


def test_nearest_rank_quantiles(samples):
    data, df = samples
    for r in ordered.quantiles(df, ["k"], "value", {"p50": 0.5, "p95": 0.95}, "nearest").collect():
        values = sorted(by_key(data)[r.k])
        for name, p in (("p50", 0.5), ("p95", 0.95)):
            assert r[name] == values[min(int(len(values) * p), len(values) - 1)]


def test_next_in_time_crosses_empty_days(spark):
    t0 = datetime(2024, 1, 1, 23, 50)
    times = [t0, t0 + timedelta(minutes=5), t0 + timedelta(days=4), t0 + timedelta(days=4, minutes=1)]
    df = spark.createDataFrame([("a", t) for t in times] + [("b", t0)], "k STRING, ts TIMESTAMP")
    got = {(r.k, r.ts): r.next_ts for r in ordered.next_in_time(df, ["k"], "ts").collect()}
    assert got == {("a", times[0]): times[1], ("a", times[1]): times[2], ("a", times[2]): times[3],
                   ("a", times[3]): None, ("b", t0): None}


def test_sequences_do_not_depend_on_block_size(spark):
    df = spark.range(100).select(F.col("id").alias("idx"), F.array(F.col("id").cast("double")).alias("features"))
    spread, w = ordered.halo_blocks(df, [], "idx", 12, 0, block=16)
    small = spread.withColumn("x", F.collect_list("features").over(w.rowsBetween(-12, -1))).where("_own AND idx >= 12")
    assert sorted((r.idx, tuple(v[0] for v in r.x)) for r in small.collect()) == [
        (i, tuple(float(j) for j in range(i - 12, i))) for i in range(12, 100)]
    assert features.sliding_sequences(df).count() == 88


def test_burst_collapse_matches_brute_force_at_chunk_borders(spark):
    rng = random.Random(3)
    t0 = datetime(2024, 3, 1)
    events = []
    for sensor, step in (("hot", 0.6), ("slow", 30.0)):
        t = 0.0
        for _ in range(800 if sensor == "hot" else 60):
            t += rng.choice([0.0, step / 2, step, 1.0, 1.2])
            events.append((sensor, "ssh", t0 + timedelta(seconds=round(t, 3)), rng.randint(1, 4), rng.randint(1, 3)))
    df = spark.createDataFrame(events, "sensor_id STRING, event_type STRING, timestamp TIMESTAMP, severity INT, count BIGINT")
    want = Counter()
    for sensor in ("hot", "slow"):
        cur = None
        for _, _, t, sev, n in sorted(e for e in events if e[0] == sensor):
            if cur and t - cur[1] <= timedelta(seconds=1):
                cur = [cur[0], max(cur[1], t), cur[2] + n, max(cur[3], sev), cur[4] + 1]
            else:
                if cur:
                    want[(sensor, *cur)] += 1
                cur = [t, t, n, sev, 1]
        want[(sensor, *cur)] += 1
    # no hot key; one hot key in chunks of different length; all keys hot
    for chunk in (600, 2, 7, 86_400):
        got = collapse.collapse_bursts(df, 1.0, chunk_seconds=chunk)
        assert Counter((r.sensor_id, r.first_ts, r.timestamp, r["count"], r.severity, r.raw_rows) for r in got.collect()) == want
    conserved = collapse.count_conservation(df.withColumn("count", F.lit(1)), collapse.collapse_bursts(df.withColumn("count", F.lit(1)), 1.0, chunk_seconds=5)).first()
    assert conserved.count_matches and conserved.raw_event_count == len(events)


@pytest.mark.parametrize("partitions", ["1", "4", "64"])
def test_results_do_not_depend_on_partitioning(spark, samples, partitions):
    _, df = samples
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
        got = sorted(rows(ordered.quantiles(df.repartition(int(partitions)), ["k"], "value", {"m": 0.5})), key=str)
        spark.conf.set("spark.sql.shuffle.partitions", before)
        assert got == sorted(rows(ordered.quantiles(df, ["k"], "value", {"m": 0.5})), key=str)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_gap_intervals_equal_islands_of_missing_slots(spark):
    rng = random.Random(5)
    t0 = datetime(2024, 1, 1, 22, 0, 30)
    beats = [(t0 + timedelta(minutes=m), n, "ok") for n in ("a", "b") for m in range(3000) if rng.random() > 0.4 or m == 0]
    beats += [(t0, "a", "ok"), (t0 + timedelta(minutes=4000), "a", "ok")]
    df = spark.createDataFrame(beats, "timestamp TIMESTAMP, node_id STRING, status STRING")
    slots = 3000
    a = sorted(rows(coverage.gap_intervals(df, slots).select("node_id", "gap_start", "gap_end", "gap_minutes")))
    b = sorted(rows(coverage.islands(coverage.missing_slots(df, slots)).select("node_id", "gap_start", "gap_end", "gap_minutes")))
    assert a == b
    for r in coverage.heartbeat_coverage(df, slots).collect():
        assert r.covered_slots + r.missing_slots == slots
        assert r.missing_slots == sum(x[3] for x in a if x[0] == r.node_id)
        assert (r.rows_after, r.duplicate_extra_rows) == ((1, 1) if r.node_id == "a" else (0, 0))


def test_interval_join_matches_brute_force(spark):
    rng = random.Random(9)
    t0 = datetime(2024, 1, 1)
    starts = [(i, t0 + timedelta(minutes=rng.randrange(6000))) for i in range(40)]
    points = [(t0 + timedelta(minutes=rng.randrange(6000)), i) for i in range(300)]
    s = intervals.around(spark.createDataFrame(starts, "id INT, started TIMESTAMP"), "started")
    p = spark.createDataFrame(points, "at TIMESTAMP, v INT")
    got = sorted((r.id, r.v) for r in intervals.points_in_windows(s, p, "win_lo", "win_hi", "at").collect())
    assert got == sorted((i, v) for i, t in starts for at, v in points
                         if t - timedelta(hours=1) <= at <= t + timedelta(hours=4))
