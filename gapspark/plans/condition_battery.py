"""The full test battery over trials, and the batch-level loss analysis."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gapspark.operators import experiments as ex
from gapspark.operators import hypotheses as hy
from gapspark.operators.ordered import join_on
from gapspark.session import materialize


def condition_battery(trials: DataFrame, n_bootstrap: int = hy.N_BOOTSTRAP) -> DataFrame:
    """Per (pattern, rps, metric): rank test, both bootstrap intervals, occurrence test of losses.

    All metrics are one column of a long table, so each test runs once for all of them. The trials are
    read once: equal samples become one row with a count, and every test reads that table.
    """
    keys = [*ex.CONDITION, "metric"]
    samples = materialize(
        ex.long_trials(trials).withColumn("value", ex.verified_value())
        .groupBy(*keys, "system", "verified", "value").agg(F.count(F.lit(1)).alias("_times")), "samples")
    tests = hy.mann_whitney(samples, keys, weight="_times")
    ci = materialize(hy.bootstrap_ci(samples, [*keys, "system"], n_bootstrap=n_bootstrap, weight="_times"), "intervals")
    for side in ex.SYSTEMS:
        one = ci.where(F.col("system") == side).select(
            *keys, *[F.col(c).alias(f"{side}_{c}") for c in ("lower", "upper", "mean")])
        tests = join_on(tests, one, keys, "left")
    losses = samples.where("metric = 'loss_rate'")
    occurrence = hy.fisher_exact(hy.loss_occurrence(losses, keys, weight="_times"), keys).select(
        *keys, F.col("odds_ratio"), F.col("p_value").alias("occurrence_p"))
    unverified = lambda side: F.coalesce(F.sum(
        F.when(~F.col("verified") & (F.col("system") == side), F.col("_times"))), F.lit(0))
    failed = losses.groupBy(*keys).agg(
        unverified("baseline").alias("baseline_unverified"), unverified("proposed").alias("proposed_unverified"))
    return join_on(join_on(tests, occurrence, keys, "left"), failed, keys, "left")


def trend_per_pattern(trials: DataFrame) -> DataFrame:
    """Occurrence trend over the rate, per pattern (baseline side, verified trials)."""
    levels = ex.occurrence_counts(trials, ex.CONDITION, "baseline_loss", "baseline_verification_failed")
    return hy.cochran_armitage(levels, ["pattern"], "rps")


def trend_per_edge_mode(trials: DataFrame) -> DataFrame:
    levels = ex.occurrence_counts(trials, ["edge_mode", "edge_count"], "loss_rate_percent", "verification_failed")
    return hy.cochran_armitage(levels, ["edge_mode"], "edge_count")


def batch_level_loss(trials: DataFrame) -> DataFrame:
    """Paired differences -> batch means -> exact sign-flip test -> family correction."""
    means = materialize(ex.batch_means(ex.paired_differences(trials)), "batch-means")  # a few rows, read often
    tests = hy.sign_flip_exact(means, ex.CONDITION, "mean_diff", "batch")
    return hy.bonferroni(tests)
