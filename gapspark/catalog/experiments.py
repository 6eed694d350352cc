"""Registered queries: trials, resource samples, condition summaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from gapspark.functions.labels import significance_marker
from gapspark.operators import experiments as ex
from gapspark.registry import query
from gapspark.session import shared_dir
from gapspark.sinks.files import write_texts
from gapspark.sources import trials as trial_files
from gapspark.sources.driver_tables import load, view

LONG = """
l AS (
 SELECT batch, pattern, rps, trial, 'baseline' AS system, 'loss_rate' AS metric, CAST(baseline_loss AS DOUBLE) AS value, NOT baseline_verification_failed AS verified FROM trials
 UNION ALL SELECT batch, pattern, rps, trial, 'proposed', 'loss_rate', CAST(proposed_loss AS DOUBLE), NOT proposed_verification_failed FROM trials
 UNION ALL SELECT batch, pattern, rps, trial, 'baseline', 'cpu_peak', baseline_cpu_peak, true FROM trials
 UNION ALL SELECT batch, pattern, rps, trial, 'proposed', 'cpu_peak', proposed_cpu_peak, true FROM trials
 UNION ALL SELECT batch, pattern, rps, trial, 'baseline', 'mem_peak', baseline_mem_peak, true FROM trials
 UNION ALL SELECT batch, pattern, rps, trial, 'proposed', 'mem_peak', proposed_mem_peak, true FROM trials),
v AS (SELECT *, CASE WHEN verified THEN value END AS x FROM l),
loss AS (SELECT * FROM v WHERE metric = 'loss_rate')
"""


def _long(spark, d):
    return ex.long_trials(view(spark, d, "trials"))


DESC = ("round(avg(x), 6) AS mean, CASE WHEN count(x) = 1 THEN 0.0 ELSE round(stddev_samp(x), 6) END AS std, "
        "round(min(x), 6) AS min, round(max(x), 6) AS max, count(x) AS n")


@query("condition_summary", "G14 G15 B18", f"""
WITH {LONG} SELECT pattern, CAST(rps AS BIGINT) AS rps, system, metric, count(*) AS n_trials, {DESC},
  count(*) FILTER (WHERE NOT verified) AS n_verification_failed FROM v GROUP BY 1, 2, 3, 4""")
def _(spark, d):
    return ex.condition_summary(_long(spark, d))


@query("pooled_conditions", "G32 U3", f"""
WITH {LONG} SELECT pattern, CAST(rps AS BIGINT) AS rps, system, metric, count(*) AS n_trials, {DESC},
  count(*) FILTER (WHERE NOT verified) AS n_verification_failed FROM v GROUP BY 1, 2, 3, 4""")
def _(spark, d):
    t = view(spark, d, "trials")
    early = F.col("batch") < "b1995"
    return ex.pooled_conditions([t.where(early), t.where(~early | early.isNull())])[0]


@query("trials_per_batch", "G32", "SELECT batch, count(*) AS n_trials FROM trials GROUP BY 1")
def _(spark, d):
    t = view(spark, d, "trials")
    return ex.pooled_conditions([t])[1]


@query("loss_matrix", "G26", f"""
WITH {LONG} SELECT system, pattern, {', '.join(f'round(avg(x) FILTER (WHERE rps = {r}), 6) AS rps_{r}' for r in range(1, 8))}
FROM loss GROUP BY 1, 2""")
def _(spark, d):
    return ex.loss_matrix(_long(spark, d), list(range(1, 8)))


@query("throughput_curve", "G27", f"""
WITH {LONG} SELECT system, pattern, CAST(rps AS BIGINT) AS rps, round(avg(x), 6) AS mean,
  CASE WHEN count(x) = 1 THEN 0.0 ELSE round(stddev_samp(x), 6) END AS std FROM loss GROUP BY 1, 2, 3 HAVING count(x) > 0""")
def _(spark, d):
    return ex.throughput_curve(_long(spark, d))


@query("box_data", "G28", f"""
WITH {LONG} SELECT system, pattern, CAST(rps AS BIGINT) AS rps, count(x) AS n_values,
  round(quantile_cont(x, 0), 6) AS minimum, round(quantile_cont(x, 0.25), 6) AS q25, round(quantile_cont(x, 0.5), 6) AS median,
  round(quantile_cont(x, 0.75), 6) AS q75, round(quantile_cont(x, 1), 6) AS maximum FROM loss WHERE x IS NOT NULL GROUP BY 1, 2, 3""")
def _(spark, d):
    return ex.box_data(_long(spark, d))


PAIRS = """
p AS (SELECT batch, pattern, rps, trial, CAST(baseline_loss AS DOUBLE) - CAST(proposed_loss AS DOUBLE) AS diff FROM trials
  WHERE NOT baseline_verification_failed AND NOT proposed_verification_failed)
"""


@query("paired_differences", "J11", f"WITH {PAIRS} SELECT batch, pattern, CAST(rps AS BIGINT) AS rps, trial, round(diff, 6) AS diff FROM p")
def _(spark, d):
    return ex.paired_differences(view(spark, d, "trials"))


@query("batch_means", "G29", f"""
WITH {PAIRS} SELECT pattern, CAST(rps AS BIGINT) AS rps, batch, round(avg(diff), 6) AS mean_diff FROM p GROUP BY 1, 2, 3""")
def _(spark, d):
    return ex.batch_means(ex.paired_differences(view(spark, d, "trials")))


@query("resource_stats", "G12 A9 B11 B12", """
SELECT file, round(max(TRY_CAST(cpu_percent AS DOUBLE)), 2) AS cpu_peak, round(avg(TRY_CAST(cpu_percent AS DOUBLE)), 2) AS cpu_mean,
  round(max(TRY_CAST(mem_percent AS DOUBLE)), 2) AS mem_peak, round(avg(TRY_CAST(mem_percent AS DOUBLE)), 2) AS mem_mean
FROM resource_samples WHERE starts_with(container, 'proposed-') GROUP BY 1""")
def _(spark, d):
    return ex.resource_stats(view(spark, d, "resource_samples"), ["file"], "proposed-")


TOTALS = """
u AS (SELECT *, trim(split_part(mem_usage, '/', 1)) AS m FROM resource_samples WHERE starts_with(container, 'proposed-')),
k AS (SELECT file, timestamp, TRY_CAST(cpu_percent AS DOUBLE) AS cpu,
  TRY_CAST(regexp_extract(m, '^([0-9.]+)\\s*(B|KiB|MiB|GiB|TiB)$', 1) AS DOUBLE) *
  CASE regexp_extract(m, '^([0-9.]+)\\s*(B|KiB|MiB|GiB|TiB)$', 2) WHEN 'B' THEN 1.0 / 1048576 WHEN 'KiB' THEN 1.0 / 1024
    WHEN 'MiB' THEN 1.0 WHEN 'GiB' THEN 1024.0 WHEN 'TiB' THEN 1048576.0 END AS mem FROM u),
t AS (SELECT file, timestamp, sum(cpu) AS cpu, sum(mem) AS mem FROM k GROUP BY 1, 2)
"""


@query("resource_totals", "G13 B13", f"""
WITH {TOTALS} SELECT file, count(cpu) AS n_timestamps, round(avg(cpu), 1) AS cpu_mean, round(quantile_cont(cpu, 0.5), 1) AS cpu_median,
  round(quantile_cont(cpu, 0.95), 1) AS cpu_p95, round(avg(mem), 1) AS mem_mean, round(quantile_cont(mem, 0.5), 1) AS mem_median,
  round(quantile_cont(mem, 0.95), 1) AS mem_p95 FROM t GROUP BY 1""")
def _(spark, d):
    samples = view(spark, d, "resource_samples").withColumn("stack", F.col("file"))
    return ex.resource_totals(samples, "proposed-", ["stack"]).withColumnRenamed("stack", "file")


@query("readable_series", "B27", """
SELECT file, count(*) AS n_rows, round(avg(TRY_CAST(cpu_percent AS DOUBLE)), 6) AS cpu_mean FROM resource_samples
WHERE TRY_CAST(cpu_percent AS DOUBLE) IS NOT NULL AND TRY_CAST(mem_percent AS DOUBLE) IS NOT NULL GROUP BY 1""")
def _(spark, d):
    return ex.readable_series(view(spark, d, "resource_samples")).groupBy("file").agg(
        F.count(F.lit(1)).alias("n_rows"), F.avg("cpu").alias("cpu_mean"))


def _trial_tree(spark, d):
    """Condition totals of all lines as a trial tree: 6 patterns x 7 rates x 5 trials."""
    li = load(spark, d, "lineitem")
    run = F.concat("l_returnflag", "l_linestatus", F.lit("_rps"), "l_linenumber", F.lit("_trial"), F.col("l_suppkey") % 5)

    def side(column, failed):
        n, lost = F.count(F.lit(1)), F.count_if(F.col(column) > 0.05)
        return F.struct(n.alias("total_injected"), (n - lost).alias("total_recorded"), lost.alias("total_lost"),
                        (100.0 * lost / n).alias("loss_rate_percent"), failed.alias("verification_failed"))

    # every seventh trial folder has no loss file
    loss = li.groupBy(run.alias("run"), F.col("l_linenumber").alias("k"), (F.col("l_suppkey") % 5).alias("t")).agg(
        side("l_discount", F.first(F.lit(False))).alias("baseline"), side("l_tax", F.max(F.col("l_linenumber") == 3)).alias("proposed"))
    samples = li.groupBy(run.alias("run"), (F.col("l_suppkey") % 3).alias("s"), "l_linestatus").agg(
        F.max("l_quantity").alias("q"), F.max("l_partkey").alias("p"))
    system = F.when(F.col("s") == 0, "baseline").otherwise("proposed")
    samples = samples.select(
        "run", system.alias("system"), F.col("s").cast("string").alias("timestamp"),
        F.concat(F.when(F.col("s") == 2, "other").otherwise(system), F.lit("-1")).alias("container"),
        F.col("q").cast("string").alias("cpu_percent"), F.lit("1MiB / 2MiB").alias("mem_usage"),
        (F.col("p") % 100).cast("string").alias("mem_percent"), F.lit("0B / 0B").alias("block_io"))
    base = shared_dir(spark, "trials")
    # and every seventh of the next kind breaks off in the middle
    body = F.to_json(F.struct("baseline", "proposed"), {"pretty": "true"})
    cut = (F.col("k") + F.col("t")) % 7 == 1
    losses = loss.where((F.col("k") + F.col("t")) % 7 != 0).select(
        F.concat("run", F.lit("/loss_rate.json")).alias("path"),
        F.when(cut, F.substring(body, F.lit(1), F.floor(F.length(body) / 2).cast("int"))).otherwise(body).alias("content"))
    columns = ["timestamp", "container", "cpu_percent", "mem_usage", "mem_percent", "block_io"]
    tables = samples.groupBy("run", "system").agg(F.collect_list(F.concat_ws(",", *columns)).alias("rows")).select(
        F.concat("run", F.lit("/resource_"), "system", F.lit(".csv")).alias("path"),
        F.concat(F.lit(",".join(columns) + "\n"), F.array_join("rows", "\n"), F.lit("\n")).alias("content"))
    write_texts(losses.unionByName(tables), base)
    return base


@query("trial_folder_scan", "A10 J10 B15 A9", """
WITH b AS (SELECT concat(l_returnflag, l_linestatus, '_rps', l_linenumber, '_trial', l_suppkey % 5) AS run, concat(l_returnflag, l_linestatus) AS pattern,
  CAST(l_linenumber AS BIGINT) AS rps, l_suppkey % 5 AS trial, * FROM lineitem),
g AS (SELECT run, pattern, rps, trial, count(*) AS n, count(*) FILTER (WHERE l_discount > 0.05) AS bl, count(*) FILTER (WHERE l_tax > 0.05) AS pl,
  max(l_quantity) FILTER (WHERE l_suppkey % 3 = 0) AS bq, max(l_quantity) FILTER (WHERE l_suppkey % 3 = 1) AS pq FROM b GROUP BY 1, 2, 3, 4)
SELECT run, pattern, rps, trial, CASE (rps + trial) % 7 WHEN 0 THEN 'missing' WHEN 1 THEN 'unreadable' ELSE 'ok' END AS loss_status,
  CASE WHEN (rps + trial) % 7 > 1 THEN round(100.0 * bl / n, 6) END AS baseline_loss,
  CASE WHEN (rps + trial) % 7 > 1 THEN round(100.0 * pl / n, 6) END AS proposed_loss,
  CASE WHEN (rps + trial) % 7 > 1 THEN rps = 3 END AS proposed_verification_failed, bq AS baseline_cpu_peak, pq AS proposed_cpu_peak FROM g""")
def _(spark, d):
    scanned = trial_files.scan_trials(spark, _trial_tree(spark, d))
    return scanned.select(
        "run", "pattern", "rps", "trial", "loss_status", F.col("baseline.loss_rate_percent").alias("baseline_loss"),
        F.col("proposed.loss_rate_percent").alias("proposed_loss"),
        F.col("proposed.verification_failed").alias("proposed_verification_failed"),
        F.col("baseline_resources.cpu_peak").alias("baseline_cpu_peak"),
        F.col("proposed_resources.cpu_peak").alias("proposed_cpu_peak"))


@query("edge_folder_scan", "A13", """
WITH g AS (SELECT edge_mode, edge_count, trial_id % 10 AS k, max(loss_rate_percent) AS loss, bool_or(verification_failed) AS failed, min(base_rps) AS base_rps
  FROM edge_trials GROUP BY 1, 2, 3)
SELECT edge_mode, CAST(edge_count AS BIGINT) AS edge_count, CASE k WHEN 3 THEN 'missing' WHEN 5 THEN 'unreadable' ELSE 'ok' END AS loss_status,
  k NOT IN (3, 5) AS complete, count(*) AS n_trials, CAST(sum(base_rps) AS BIGINT) AS sum_base_rps,
  CASE WHEN k NOT IN (3, 5) THEN round(max(loss), 6) END AS max_loss, count(*) FILTER (WHERE failed AND k NOT IN (3, 5)) AS n_unverified FROM g GROUP BY 1, 2, 3, 4, k NOT IN (3, 5)""")
def _(spark, d):
    g = view(spark, d, "edge_trials").groupBy("edge_mode", "edge_count", (F.col("trial_id") % 10).alias("k")).agg(
        F.max("loss_rate_percent").alias("loss"), F.bool_or("verification_failed").alias("failed"), F.min("base_rps").alias("base_rps"))
    folder = F.concat(F.lit("multiedge_"), "edge_mode", F.lit("_"), "edge_count", F.lit("_"), "k", F.lit("/"))
    meta = g.select(F.concat(folder, F.lit("meta.json")).alias("path"),
                    F.to_json(F.struct("edge_count", "edge_mode", "base_rps"), {"pretty": "true"}).alias("content"))
    result = F.to_json(F.struct(F.struct(F.col("loss").alias("loss_rate_percent"), F.col("failed").alias("verification_failed")).alias("proposed")))
    loss = g.where("k <> 3").select(F.concat(folder, F.lit("loss_rate.json")).alias("path"),
                                    F.when(F.col("k") == 5, F.lit("{\"proposed\": {")).otherwise(result).alias("content"))
    base = shared_dir(spark, "edge-trials")
    write_texts(meta.unionByName(loss), base)
    return trial_files.scan_edge_trials(spark, base).groupBy("edge_mode", "edge_count", "loss_status", "complete").agg(
        F.count(F.lit(1)).alias("n_trials"), F.sum("base_rps").alias("sum_base_rps"), F.max("loss_rate_percent").alias("max_loss"),
        F.count_if("verification_failed").alias("n_unverified"))


@query("drift_folder_scan", "A15", """
WITH g AS (SELECT run, scenario, trial % 7 AS k, min(detection_lag) AS lag, min(seed) AS seed FROM drift_runs GROUP BY 1, 2, 3)
SELECT run, scenario, CAST(k AS BIGINT) AS trial, CAST(seed AS BIGINT) AS seed, CAST(lag AS BIGINT) AS detection_lag, 'ok' AS result_status FROM g WHERE k <> 2
UNION ALL SELECT run, NULL, NULL, NULL, NULL, 'unreadable' FROM g WHERE k = 2""")
def _(spark, d):
    g = view(spark, d, "drift_runs").groupBy("run", "scenario", (F.col("trial") % 7).alias("trial")).agg(
        F.min("detection_lag").alias("detection_lag"), F.min("seed").alias("seed"))
    body = F.to_json(F.struct("scenario", "trial", "seed", "detection_lag"), {"pretty": "true"})
    base = shared_dir(spark, "drift-runs")
    write_texts(g.select(
        F.concat("run", F.lit("/"), "scenario", F.lit("_trial"), "trial", F.lit("/fidelity_results.json")).alias("path"),
        F.when(F.col("trial") == 2, F.lit("[1, ")).otherwise(body).alias("content")), base)
    return trial_files.scan_drift_runs(spark, base).select("run", "scenario", "trial", "seed", "detection_lag", "result_status")


@query("edge_trial_scan", "A13 B26", """
SELECT edge_mode, CAST(edge_count AS BIGINT) AS edge_count, has_meta AND has_loss AS complete, count(*) AS n_trials,
  CASE WHEN edge_mode IS NULL THEN NULL ELSE CAST(sum(CASE WHEN edge_mode = 'fixed-total' THEN greatest(1, base_rps // edge_count) ELSE base_rps END) AS BIGINT) END AS sum_per_edge_rps
FROM (SELECT CASE WHEN has_meta THEN edge_mode END AS edge_mode, CASE WHEN has_meta THEN edge_count END AS edge_count, base_rps, has_meta, has_loss
  FROM edge_trials WHERE has_meta OR has_loss) GROUP BY 1, 2, 3""")
def _(spark, d):
    t = view(spark, d, "edge_trials")
    meta = t.where("has_meta").select("trial_id", "edge_mode", "edge_count", "base_rps")
    loss = t.where("has_loss").select("trial_id", "loss_rate_percent", "verification_failed")
    return ex.load_regimes(ex.assemble_edge_trials(meta, loss)).groupBy("edge_mode", "edge_count", "complete").agg(
        F.count(F.lit(1)).alias("n_trials"), F.sum("per_edge_rps").alias("sum_per_edge_rps"))


@query("occurrence_per_dose", "G21", """
SELECT edge_mode, CAST(edge_count AS BIGINT) AS edge_count, count(*) FILTER (WHERE NOT verification_failed) AS n,
  count(*) FILTER (WHERE NOT verification_failed AND loss_rate_percent > 0) AS x, count(*) FILTER (WHERE verification_failed) AS n_unverified
FROM edge_trials GROUP BY 1, 2 HAVING count(*) FILTER (WHERE NOT verification_failed) > 0""")
def _(spark, d):
    return ex.occurrence_counts(view(spark, d, "edge_trials"), ["edge_mode", "edge_count"], "loss_rate_percent", "verification_failed")


@query("ablation_trial_scan", "A14", """
WITH s AS (SELECT l_orderkey AS trial, max(TRY_CAST(c AS DOUBLE)) AS cpu_peak, avg(TRY_CAST(c AS DOUBLE)) AS cpu_mean, count(TRY_CAST(c AS DOUBLE)) AS n,
  string_agg(DISTINCT k, ',' ORDER BY k) AS containers FROM (SELECT l_orderkey, CASE WHEN l_partkey % 41 = 0 THEN 'bad' ELSE CAST(l_quantity AS VARCHAR) END AS c,
  CASE WHEN l_suppkey % 11 = 0 THEN concat('stray-', l_linenumber) ELSE 'obs-ablation-vector' END AS k FROM lineitem) GROUP BY 1)
SELECT coalesce(o_orderkey, s.trial) AS trial, round(cpu_peak, 6) AS cpu_peak, round(cpu_mean, 6) AS cpu_mean, n AS n_resource_samples,
  containers AS containers_seen, o_orderkey IS NOT NULL AND s.trial IS NOT NULL AS complete FROM orders FULL JOIN s ON o_orderkey = s.trial""")
def _(spark, d):
    results = load(spark, d, "orders").select(F.col("o_orderkey").alias("trial"))
    samples = load(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("trial"),
        F.when(F.col("l_partkey") % 41 == 0, "bad").otherwise(F.col("l_quantity").cast("string")).alias("cpu_percent"),
        F.lit("1").alias("mem_percent"),
        F.when(F.col("l_suppkey") % 11 == 0, F.concat(F.lit("stray-"), "l_linenumber")).otherwise("obs-ablation-vector").alias("container"))
    t = ex.assemble_ablation(results, samples)
    return t.select("trial", "cpu_peak", "cpu_mean", "n_resource_samples", F.array_join("containers_seen", ",").alias("containers_seen"), "complete")


@query("ablation_folder_scan", "A14", """
WITH g AS (SELECT l_linenumber AS w, l_suppkey % 20 AS k, count(*) AS n, count(DISTINCT l_partkey) AS g, max(l_quantity) AS cpu, avg(l_quantity) AS cpu_mean,
  max(l_tax) AS up, min(l_tax) AS low FROM lineitem GROUP BY 1, 2)
SELECT concat('w', w * 100, '_trial', k) AS trial, CASE k % 7 WHEN 2 THEN 'unreadable' WHEN 3 THEN 'missing' ELSE 'ok' END AS result_status,
  CASE WHEN k % 7 NOT IN (2, 3) THEN CAST(w * 100 AS BIGINT) END AS window_ms, CASE WHEN k % 7 NOT IN (2, 3) THEN n END AS raw_event_count,
  CASE WHEN k % 7 NOT IN (2, 3) THEN g END AS n_aggregated_groups, CASE WHEN k % 7 NOT IN (2, 3) THEN round(up, 6) END AS upper_mean,
  CASE WHEN k % 7 NOT IN (2, 3) AND k % 7 <> 5 THEN round(low, 6) END AS lower_mean, CASE WHEN k % 7 <> 4 THEN round(CAST(cpu AS DOUBLE), 6) END AS cpu_peak,
  k % 7 NOT IN (2, 3, 4) AS complete FROM g""")
def _(spark, d):
    li = load(spark, d, "lineitem")
    g = li.groupBy(F.col("l_linenumber").alias("w"), (F.col("l_suppkey") % 20).alias("k")).agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("l_partkey").alias("g"), F.max("l_quantity").alias("cpu"),
        F.min("l_quantity").alias("cpu_low"), F.max("l_tax").cast("double").alias("up"), F.min("l_tax").cast("double").alias("low"))
    folder = F.concat(F.lit("batch/w"), F.col("w") * 100, F.lit("_trial"), "k", F.lit("/"))
    kind = F.col("k") % 7  # every seventh folder: a result that breaks off, no result, no samples, no lower bound
    body = F.to_json(F.struct(
        (F.col("w") * 100).alias("window_ms"), F.col("n").alias("raw_event_count"), F.col("n").alias("aggregated_count_sum"),
        F.lit(True).alias("count_matches"), F.col("g").alias("n_aggregated_groups"),
        F.struct(F.col("up").alias("mean")).alias("latency_upper_ms"),
        F.when(kind != 5, F.struct(F.col("low").alias("mean"))).alias("latency_lower_ms")), {"pretty": "true"})
    results = g.where(kind != 3).select(
        F.concat(folder, F.lit("results.json")).alias("path"),
        F.when(kind == 2, F.substring(body, 1, 20)).otherwise(body).alias("content"))
    header = "timestamp,container,cpu_percent,mem_usage,mem_percent,block_io\n"
    line = lambda c: F.concat(F.lit("1,obs-ablation-vector,"), F.col(c).cast("string"), F.lit(",1MiB / 2MiB,1,0B / 0B\n"))
    samples = g.where(kind != 4).select(
        F.concat(folder, F.lit("resource_vector.csv")).alias("path"),
        F.concat(F.lit(header), line("cpu"), F.lit("2,obs-ablation-vector,broken,,,\n"), line("cpu_low")).alias("content"))
    base = shared_dir(spark, "ablation")
    write_texts(results.unionByName(samples), base)
    return trial_files.scan_ablation(spark, base).select(
        "trial", "result_status", "window_ms", "raw_event_count", "n_aggregated_groups", F.col("latency_upper_ms.mean").alias("upper_mean"),
        F.col("latency_lower_ms.mean").alias("lower_mean"), "cpu_peak", "complete")


ABL = ", ".join(
    f"round({f}({s}_{c}), 6) AS {s}_{label}" for s in ("upper", "lower")
    for f, c, label in (("avg", "mean", "mean_of_means"), ("avg", "p95", "mean_of_p95"), ("max", "max", "max_of_max")))
ABL = f"""count(*) AS n_trials, count(*) FILTER (WHERE count_matches) AS n_count_matches, round(count(*) FILTER (WHERE count_matches) / count(*), 6) AS correctness_rate,
  {ABL}, round(avg(cpu_peak), 6) AS cpu_peak_mean, max(cpu_peak) AS cpu_peak_max, round(avg(mem_percent_peak), 6) AS mem_percent_peak_mean,
  count(*) FILTER (WHERE lower_mean IS NULL) AS n_without_latency"""


@query("ablation_summary", "G16", f"SELECT CAST(window_ms AS BIGINT) AS window_ms, {ABL} FROM ablation_trials GROUP BY 1")
def _(spark, d):
    return ex.ablation_summary(view(spark, d, "ablation_trials"))


@query("ablation_per_batch", "G17", f"SELECT batch, CAST(window_ms AS BIGINT) AS window_ms, {ABL} FROM ablation_trials GROUP BY 1, 2")
def _(spark, d):
    return ex.ablation_summary(view(spark, d, "ablation_trials"), ["batch", "window_ms"])


@query("unexpected_containers", "G16", """
SELECT DISTINCT CAST(window_ms AS BIGINT) AS window_ms, container FROM ablation_trials WHERE container <> 'obs-ablation-vector'""")
def _(spark, d):
    return ex.unexpected_containers(view(spark, d, "ablation_trials"))


def _runs(spark, d):
    r = view(spark, d, "drift_runs")
    return r.withColumn("fidelity_leads", F.coalesce(F.col("detection_lag") < 0, F.lit(False))).withColumn(
        "confirming_detected", F.coalesce(F.col("detection_lag") <= 8, F.lit(False)))


RUNS = """
r AS (SELECT *, coalesce(detection_lag < 0, false) AS leads, coalesce(detection_lag <= 8, false) AS conf,
  row_number() OVER (PARTITION BY scenario, trial, seed ORDER BY run, run_order) AS rn FROM drift_runs)
"""


@query("first_wins_runs", "A15 W14", f"""
WITH {RUNS} SELECT scenario, CAST(trial AS BIGINT) AS trial, CAST(seed AS BIGINT) AS seed, run, run_order, CAST(detection_lag AS BIGINT) AS detection_lag FROM r WHERE rn = 1""")
def _(spark, d):
    kept, _ = ex.first_wins(_runs(spark, d), ["scenario", "trial", "seed"], ["run", "run_order"])
    return kept.select("scenario", "trial", "seed", "run", "run_order", "detection_lag")


@query("duplicate_runs", "A15", f"WITH {RUNS} SELECT run, count(*) AS n_trials, count(*) FILTER (WHERE rn > 1) AS n_duplicates FROM r GROUP BY 1")
def _(spark, d):
    return ex.first_wins(_runs(spark, d), ["scenario", "trial", "seed"], ["run", "run_order"])[1]


@query("drift_run_summary", "G30 B20 T6", f"""
WITH {RUNS}, s AS (SELECT scenario, CAST(count(*) AS DOUBLE) AS n, count(*) FILTER (WHERE leads) AS l, CAST(count(*) FILTER (WHERE conf) AS DOUBLE) AS c,
  avg(detection_lag) FILTER (WHERE conf) AS lag FROM r WHERE rn = 1 GROUP BY 1),
w AS (SELECT *, 1.959963984540054 AS z, c / n AS p FROM s)
SELECT scenario, CAST(n AS BIGINT) AS n_trials, l AS leads, CAST(c AS BIGINT) AS confirmed, round(lag, 6) AS mean_detection_lag, round(100 * c / n, 6) AS confirmed_percent,
  round(100 * ((p + z*z/(2*n)) / (1 + z*z/n) - z * sqrt(p*(1-p)/n + z*z/(4*n*n)) / (1 + z*z/n)), 6) AS ci_lower,
  round(100 * ((p + z*z/(2*n)) / (1 + z*z/n) + z * sqrt(p*(1-p)/n + z*z/(4*n*n)) / (1 + z*z/n)), 6) AS ci_upper,
  CASE WHEN 100 * l / n >= 66.7 THEN 'Confirmed' WHEN l > 0 THEN 'Partial' ELSE 'Not confirmed' END AS lead_verdict FROM w""")
def _(spark, d):
    kept, _ = ex.first_wins(_runs(spark, d), ["scenario", "trial", "seed"], ["run", "run_order"])
    return ex.drift_run_summary(kept)


@query("null_run_summary", "G31 T6", """
WITH s AS (SELECT CAST(count(*) AS DOUBLE) AS n, CAST(count(*) FILTER (WHERE false_alarms > 0) AS DOUBLE) AS c, CAST(sum(false_alarms) AS BIGINT) AS fa,
  CAST(sum(n_evaluated_windows) AS BIGINT) AS ev, 1.96 AS z FROM drift_runs WHERE scenario = 'none'), w AS (SELECT *, c / n AS p FROM s)
SELECT CAST(n AS BIGINT) AS n_trials, CAST(c AS BIGINT) AS false_alarm_trial_count, fa AS false_alarm_window_count, ev AS evaluated_window_count,
  round(p, 6) AS false_alarm_trial_rate,
  round(greatest(0, (p + z*z/(2*n) - z * sqrt(p*(1-p)/n + z*z/(4*n*n))) / (1 + z*z/n)), 6) AS wilson_lower,
  round(least(1, (p + z*z/(2*n) + z * sqrt(p*(1-p)/n + z*z/(4*n*n))) / (1 + z*z/n)), 6) AS wilson_upper, round(fa / ev, 6) AS false_alarm_window_rate FROM w""")
def _(spark, d):
    return ex.null_run_summary(_runs(spark, d).where("scenario = 'none'"))


@query("significance_markers", "B20", """
SELECT l_tax AS p, CASE WHEN l_tax < 0.001 THEN '***' WHEN l_tax < 0.01 THEN '**' WHEN l_tax < 0.05 THEN '*' ELSE '' END AS marker, count(*) AS n_rows
FROM lineitem GROUP BY 1, 2""")
def _(spark, d):
    return load(spark, d, "lineitem").groupBy(F.col("l_tax").alias("p"), significance_marker(F.col("l_tax")).alias("marker")).agg(
        F.count(F.lit(1)).alias("n_rows"))
