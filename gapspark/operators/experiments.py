"""Trial-level assembly and condition summaries.

Trials become one long table (batch, pattern, rps, trial, system, metric, value, verified); each
summary is one grouped plan over it. Unverified loss values are left out of statistics and
counted, while the other metrics of the same trial stay in.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gapspark.functions.labels import lead_verdict
from gapspark.functions.parsing import mem_mib
from gapspark.functions.special import wilson_bounds, wilson_clipped
from gapspark.operators.ordered import join_on, quantiles
from gapspark.session import materialize

SYSTEMS = ("baseline", "proposed")
CONDITION = ["pattern", "rps"]
STRAY_FREE_CONTAINER = "obs-ablation-vector"  # fixed value: the only container of that experiment


# --- resource samples -------------------------------------------------------------------------

def own_samples(samples: DataFrame, prefix: str) -> DataFrame:
    """Rows of one stack's containers; the prefix test reaches the scan."""
    return samples.where(F.col("container").startswith(prefix)) if prefix else samples


def resource_stats(samples: DataFrame, keys: list[str], prefix: str = "") -> DataFrame:
    """Peak and mean of CPU and memory percent per key; unreadable values skip per column.

    A key without any readable value in one of the two columns yields no row.
    """
    cpu, mem = F.col("cpu_percent").try_cast("double"), F.col("mem_percent").try_cast("double")
    stats = own_samples(samples, prefix).groupBy(*keys).agg(
        F.round(F.max(cpu), 2).alias("cpu_peak"), F.round(F.avg(cpu), 2).alias("cpu_mean"),
        F.round(F.max(mem), 2).alias("mem_peak"), F.round(F.avg(mem), 2).alias("mem_mean"),
    )
    return stats.where(F.col("cpu_peak").isNotNull() & F.col("mem_peak").isNotNull())


def resource_totals(samples: DataFrame, prefix: str, keys: list[str] | None = None) -> DataFrame:
    """Totals over containers per (file, timestamp), then mean, median and p95 of each series."""
    keys = keys or []
    totals = own_samples(samples, prefix).groupBy(*keys, "file", "timestamp").agg(
        F.sum(F.col("cpu_percent").try_cast("double")).alias("cpu"),
        F.sum(mem_mib(F.col("mem_usage"))).alias("mem"),
    )
    metrics = ("cpu", "mem")
    series = totals.select(*keys, F.explode(F.array(*[
        F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in metrics])).alias("_m")).select(*keys, "_m.*")
    series = materialize(series, "resource-series")  # both passes below read one row per (series, time)
    probs = {"median": 0.5, "p95": 0.95}
    means = series.groupBy(*keys, "metric").agg(F.count("value").alias("n"), F.avg("value").alias("mean"))
    both = join_on(means, quantiles(series, [*keys, "metric"], "value", probs), [*keys, "metric"], "left")
    of = lambda m, c: F.max(F.when(F.col("metric") == m, F.col(c)))
    out = both.groupBy(*keys).agg(
        of("cpu", "n").alias("n_timestamps"),
        *[of(m, c).alias(f"{m}_{c}") for m in metrics for c in ("mean", *probs)])
    return out.select(
        *keys, "n_timestamps",
        *[F.round(f"{m}_{s}", 1).alias(f"{m}_{s}") for m in ("cpu", "mem") for s in ("mean", "median", "p95")],
    )


def readable_series(samples: DataFrame) -> DataFrame:
    """Time-series form: a row stays only if both metrics are readable."""
    cpu, mem = F.col("cpu_percent").try_cast("double"), F.col("mem_percent").try_cast("double")
    return samples.withColumn("cpu", cpu).withColumn("mem", mem).where("cpu IS NOT NULL AND mem IS NOT NULL")


# --- trials -----------------------------------------------------------------------------------

def long_trials(trials: DataFrame) -> DataFrame:
    """Wide trials to (batch, pattern, rps, trial, system, metric, value, verified)."""
    cells = [
        F.struct(
            F.lit(s).alias("system"), F.lit(m).alias("metric"),
            F.col(f"{s}_{c}").cast("double").alias("value"),
            (~F.coalesce(F.col(f"{s}_verification_failed"), F.lit(False)) if m == "loss_rate" else F.lit(True)).alias("verified"),
        )
        for s in SYSTEMS for m, c in (("loss_rate", "loss"), ("cpu_peak", "cpu_peak"), ("mem_peak", "mem_peak"))
    ]
    return trials.select("batch", *CONDITION, "trial", F.inline(F.array(*cells)))


def verified_value() -> Column:
    """The value where it may enter statistics, else NULL (the row still counts)."""
    return F.when(F.col("verified"), F.col("value"))


def describe(value: Column) -> list[Column]:
    """Mean, sample deviation (0 for a single value), extremes, n."""
    n = F.count(value)
    return [
        F.avg(value).alias("mean"), F.when(n == 1, F.lit(0.0)).otherwise(F.stddev_samp(value)).alias("std"),
        F.min(value).alias("min"), F.max(value).alias("max"), n.alias("n"),
    ]


def condition_summary(long: DataFrame, extra_keys: list[str] | None = None) -> DataFrame:
    """Per condition, system and metric: verified statistics plus the unverified count."""
    return long.groupBy(*(extra_keys or []), *CONDITION, "system", "metric").agg(
        F.count(F.lit(1)).alias("n_trials"), *describe(verified_value()),
        F.count_if(~F.col("verified")).alias("n_verification_failed"),
    )


def pooled_conditions(batches: list[DataFrame]) -> tuple[DataFrame, DataFrame]:
    """Union of several batches: (pooled condition summary, trials per batch)."""
    pooled = batches[0]
    for b in batches[1:]:
        pooled = pooled.unionByName(b)
    per_batch = pooled.groupBy("batch").agg(F.count(F.lit(1)).alias("n_trials"))
    return condition_summary(long_trials(pooled)), per_batch


def loss_only(long: DataFrame) -> DataFrame:
    return long.where("metric = 'loss_rate'").withColumn("value", verified_value())


def loss_matrix(long: DataFrame, rates: list[int]) -> DataFrame:
    """Mean verified loss, one row per (system, pattern), one column per rate."""
    means = [F.avg(F.when(F.col("rps") == r, F.col("value"))).alias(f"rps_{r}") for r in rates]
    return loss_only(long).groupBy("system", "pattern").agg(*means)


def throughput_curve(long: DataFrame) -> DataFrame:
    out = loss_only(long).groupBy("system", *CONDITION).agg(*describe(F.col("value")))
    return out.where("n > 0").select("system", *CONDITION, "mean", "std")


def box_data(long: DataFrame) -> DataFrame:
    """Five-number data per condition from exact, distributed quantiles."""
    probs = {"minimum": 0.0, "q25": 0.25, "median": 0.5, "q75": 0.75, "maximum": 1.0}
    return quantiles(loss_only(long), ["system", *CONDITION], "value", probs)


def paired_differences(trials: DataFrame) -> DataFrame:
    """baseline - proposed per trial where both sides are verified."""
    ok = ~F.col("baseline_verification_failed") & ~F.col("proposed_verification_failed")
    return trials.where(ok & F.col("baseline_loss").isNotNull() & F.col("proposed_loss").isNotNull()).select(
        "batch", *CONDITION, "trial", (F.col("baseline_loss") - F.col("proposed_loss")).alias("diff"))


def batch_means(differences: DataFrame) -> DataFrame:
    return differences.groupBy(*CONDITION, "batch").agg(F.avg("diff").alias("mean_diff"))


def occurrence_counts(trials: DataFrame, keys: list[str], loss: str, failed: str) -> DataFrame:
    """Verified trials and those with any loss, per key; a level without verified trials drops."""
    ok = ~F.coalesce(F.col(failed), F.lit(False)) & F.col(loss).isNotNull()
    return trials.groupBy(*keys).agg(
        F.count_if(ok).alias("n"), F.count_if(ok & (F.col(loss) > 0)).alias("x"),
        F.count_if(~ok).alias("n_unverified"),
    ).where("n > 0")


# --- multi-edge and ablation ------------------------------------------------------------------

def assemble_edge_trials(meta: DataFrame, loss: DataFrame) -> DataFrame:
    """Metadata and loss result per trial; incomplete trials stay visible by their flag."""
    m = meta.withColumn("has_meta", F.lit(True))
    x = loss.withColumn("has_loss", F.lit(True))
    both = m.join(x, "trial_id", "full_outer")
    flag = lambda c: F.coalesce(F.col(c), F.lit(False))
    return both.withColumn("complete", flag("has_meta") & flag("has_loss")).drop("has_meta", "has_loss")


def load_regimes(trials: DataFrame) -> DataFrame:
    """Per-edge and total rate of the two regimes: shared total, or full rate on each edge."""
    per_edge = F.when(
        F.col("edge_mode") == "fixed-total",
        F.greatest(F.lit(1), F.floor(F.col("base_rps") / F.col("edge_count"))),
    ).otherwise(F.col("base_rps"))
    return trials.withColumn("per_edge_rps", per_edge.cast("bigint")).withColumn(
        "total_rps", F.col("per_edge_rps") * F.col("edge_count"))


def assemble_ablation(results: DataFrame, samples: DataFrame) -> DataFrame:
    """Trial results with their resource samples; ``complete`` is false when either is missing.

    Rows are parsed tolerantly: each metric is used where it is readable.
    """
    cpu, mem = F.col("cpu_percent").try_cast("double"), F.col("mem_percent").try_cast("double")
    per_trial = samples.groupBy("trial").agg(
        F.max(cpu).alias("cpu_peak"), F.avg(cpu).alias("cpu_mean"),
        F.max(F.when(cpu.isNotNull(), mem)).alias("mem_percent_peak"),
        F.count(cpu).alias("n_resource_samples"),
        F.array_sort(F.collect_set("container")).alias("containers_seen"),
    ).withColumn("_s", F.lit(True))
    joined = results.withColumn("_r", F.lit(True)).join(per_trial, "trial", "full_outer")
    return joined.withColumn("complete", F.col("_r").isNotNull() & F.col("_s").isNotNull()).drop("_r", "_s")


def ablation_summary(trials: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Per collapse window: correctness, waits, resources, trials without a measured wait."""
    n = F.count(F.lit(1))
    return trials.groupBy(*(keys or ["window_ms"])).agg(
        n.alias("n_trials"), F.count_if("count_matches").alias("n_count_matches"),
        (F.count_if("count_matches") / n).alias("correctness_rate"),
        *[f(f"{s}_{c}").alias(f"{s}_{label}")
          for s in ("upper", "lower")
          for f, c, label in ((F.avg, "mean", "mean_of_means"), (F.avg, "p95", "mean_of_p95"), (F.max, "max", "max_of_max"))],
        F.avg("cpu_peak").alias("cpu_peak_mean"), F.max("cpu_peak").alias("cpu_peak_max"),
        F.avg("mem_percent_peak").alias("mem_percent_peak_mean"),
        F.count_if(F.col("lower_mean").isNull()).alias("n_without_latency"),
    )


def unexpected_containers(trials: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Distinct foreign containers per window, as rows."""
    return trials.where(F.col("container") != STRAY_FREE_CONTAINER).select(
        *(keys or ["window_ms"]), "container").distinct()


# --- drift runs -------------------------------------------------------------------------------

def first_wins(runs: DataFrame, keys: list[str], order: list[str]) -> tuple[DataFrame, DataFrame]:
    """Keeps the earliest record per key; counts the later copies per run.

    A minimum over structs combines map-side, so a key repeated without bound is no hot spot.
    """
    rest = [c for c in runs.columns if c not in keys]
    kept = runs.groupBy(*keys).agg(
        F.min_by(F.struct(*rest), F.struct(*order)).alias("_first")
    ).select(*keys, *[F.col(f"_first.{c}").alias(c) for c in rest])
    seen = runs.groupBy("run").agg(F.count(F.lit(1)).alias("n_trials"))
    firsts = kept.groupBy("run").agg(F.count(F.lit(1)).alias("_n"))
    duplicates = join_on(seen, firsts, ["run"], "left").select(
        "run", "n_trials", (F.col("n_trials") - F.coalesce("_n", F.lit(0))).alias("n_duplicates"))
    return kept, duplicates


def drift_run_summary(runs: DataFrame) -> DataFrame:
    """Per scenario: leads, confirmed, mean lag of the confirmed only, interval and verdict."""
    confirmed = F.coalesce(F.col("confirming_detected"), F.lit(False))
    s = runs.groupBy("scenario").agg(
        F.count(F.lit(1)).alias("n_trials"), F.count_if("fidelity_leads").alias("leads"),
        F.count_if(confirmed).alias("confirmed"),
        F.avg(F.when(confirmed, F.col("detection_lag"))).alias("mean_detection_lag"),
    )
    lo, hi = wilson_bounds(F.col("confirmed"), F.col("n_trials"))
    rate = 100 * F.col("leads") / F.col("n_trials")
    return s.select(
        "*", (100 * F.col("confirmed") / F.col("n_trials")).alias("confirmed_percent"),
        (100 * lo).alias("ci_lower"), (100 * hi).alias("ci_upper"), lead_verdict(rate).alias("lead_verdict"),
    )


def null_run_summary(runs: DataFrame) -> DataFrame:
    """Runs without drift: trial-level false alarms with interval, window-level rate without one."""
    s = runs.agg(
        F.count(F.lit(1)).alias("n_trials"),
        F.count_if(F.col("false_alarms") > 0).alias("false_alarm_trial_count"),
        F.coalesce(F.sum("false_alarms"), F.lit(0)).alias("false_alarm_window_count"),
        F.coalesce(F.sum("n_evaluated_windows"), F.lit(0)).alias("evaluated_window_count"),
    )
    lo, hi = wilson_clipped(F.col("false_alarm_trial_count"), F.col("n_trials"))
    return s.select(
        "*",
        (F.col("false_alarm_trial_count") / F.greatest("n_trials", F.lit(1))).alias("false_alarm_trial_rate"),
        lo.alias("wilson_lower"), hi.alias("wilson_upper"),
        (F.col("false_alarm_window_count") / F.greatest("evaluated_window_count", F.lit(1))).alias("false_alarm_window_rate"),
    )
