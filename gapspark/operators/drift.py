"""Explanation-based drift monitoring over fixed blocks of sequences.

Inputs are long rows; each block is reduced to one small profile per (run, block, feature) by
map-side combining aggregates, and everything after that works on those profiles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gapspark.operators.ordered import halo_blocks, join_on, running_totals

MAX_CONFIRMING_LAG = 8
ACCURACY_FACTOR = 3.0
RANGE = 4096  # blocks of a run that one window orders


def block_errors(predictions: DataFrame, keys: list[str], error: str = "error") -> DataFrame:
    """MSE and MAE per block; ``error`` is prediction minus truth."""
    return predictions.groupBy(*keys).agg(
        F.avg(F.col(error) * F.col(error)).alias("mse"), F.avg(F.abs(error)).alias("mae"))


def explanation_fidelity(rows: DataFrame, keys: list[str]) -> DataFrame:
    """R² of the additive explanation against the prediction, clipped to [0, 1].

    A constant prediction scores 1 if it is reproduced exactly and 0 otherwise.
    """
    residual = F.sum((F.col("actual") - F.col("explained")) * (F.col("actual") - F.col("explained")))
    s = rows.groupBy(*keys).agg(
        residual.alias("_res"), (F.var_pop("actual") * F.count(F.lit(1))).alias("_tot"),
        F.min("actual").alias("_lo"), F.max("actual").alias("_hi"))
    flat = F.col("_lo") == F.col("_hi")
    score = F.when(flat, F.when(F.col("_res") == 0, 1.0).otherwise(0.0)).otherwise(
        F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - F.col("_res") / F.col("_tot"))))
    return s.select(*keys, score.alias("fidelity_score"))


def profiles(attributions: DataFrame, keys: list[str]) -> DataFrame:
    """Summed absolute attribution and sample count per (keys, block, feature)."""
    return attributions.groupBy(*keys, "block", "feature").agg(
        F.sum(F.abs("value")).alias("s"), F.count(F.lit(1)).alias("n"))


def _cosine(dot: Column, pp: Column, bb: Column) -> Column:
    zero = (pp == 0) | (bb == 0)
    both = (pp == 0) & (bb == 0)
    return F.when(both, 1.0).when(zero, 0.0).otherwise(
        F.greatest(F.lit(0.0), F.least(F.lit(1.0), dot / F.sqrt(pp) / F.sqrt(bb))))


def profile_scores(profile: DataFrame, keys: list[str], baseline_blocks: int) -> DataFrame:
    """Cosine of each block's profile with the baseline profile.

    ``score``: against all baseline blocks. ``score_loo``: for a baseline block, against the
    other baseline blocks, by subtracting its own share from the totals (no pairing of blocks).
    """
    base = profile.where(F.col("block") < baseline_blocks).groupBy(*keys, "feature").agg(
        F.sum("s").alias("_bs"), F.sum("n").alias("_bn"))
    own, total = F.col("s") / F.col("n"), F.col("_bs") / F.col("_bn")
    others = F.coalesce(F.try_divide(F.col("_bs") - F.col("s"), F.col("_bn") - F.col("n")), F.lit(0.0))
    joined = join_on(profile, base, [*keys, "feature"]).select(
        *keys, "block", own.alias("p"), total.alias("b"), others.alias("o"))
    dot = lambda a, b: F.sum(F.col(a) * F.col(b))
    sums = joined.groupBy(*keys, "block").agg(
        dot("p", "b").alias("_pb"), dot("p", "p").alias("_pp"), dot("b", "b").alias("_bb"),
        dot("p", "o").alias("_po"), dot("o", "o").alias("_oo"))
    loo = _cosine(F.col("_po"), F.col("_pp"), F.col("_oo"))
    return sums.select(
        *keys, "block", _cosine(F.col("_pb"), F.col("_pp"), F.col("_bb")).alias("score"),
        F.when(F.col("block") < baseline_blocks - 1, loo).alias("score_loo"))


def _with_trailing_mean(blocks: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Adds ``moving_avg``, the mean of five blocks (fewer at the start). A run is cut into ranges that
    overlap by four blocks, so one long run is many tasks' work."""
    ranges = blocks.withColumn("_range", F.floor(F.col("block") / F.lit(RANGE)))
    placed = running_totals(ranges, keys, "block", {"_idx": F.lit(1)}, bucket="_range").drop("_range")
    halo, window = halo_blocks(placed, keys, "_idx", 4, 0, RANGE)
    mean = F.avg(value).over(window.rowsBetween(-4, 0))
    return halo.withColumn("moving_avg", mean).where("_own").select(*blocks.columns, "moving_avg")


def monitor_absolute(fidelity: DataFrame, keys: list[str], threshold: float = 0.5) -> DataFrame:
    """Trailing mean of five blocks (fewer at the start) below a fixed threshold."""
    return _with_trailing_mean(fidelity, keys, "fidelity_score").withColumn(
        "drift_detected", F.col("moving_avg") < threshold)


def monitor_adaptive(
    fidelity: DataFrame, profile: DataFrame, keys: list[str], baseline_blocks: int,
    threshold: float = 0.5, drift_zscore: float = 2.0, min_margin: float = 0.01,
) -> DataFrame:
    """Profile score against a threshold learned from the baseline blocks.

    Blocks before the baseline is complete follow the absolute rule and show their leave-one-out
    score. The threshold is the mean leave-one-out score minus the larger of z deviations and the
    minimum margin; with a single baseline block there is no spread and nothing is detected.
    """
    scores = join_on(fidelity, profile_scores(profile, keys, baseline_blocks), [*keys, "block"])
    armed = F.col("block") >= baseline_blocks - 1
    margin = lambda sd: F.greatest(F.lit(drift_zscore) * sd, F.lit(min_margin))
    baseline_fidelity = F.when(F.col("block") < baseline_blocks, F.col("fidelity_score"))
    limits = scores.groupBy(*keys).agg(
        (F.avg(baseline_fidelity) - margin(F.stddev_pop(baseline_fidelity))).alias("_fid"),
        (F.avg("score_loo") - margin(F.stddev_pop("score_loo"))).alias("_prof"))
    joined = _with_trailing_mean(join_on(scores, limits, keys), keys, "fidelity_score")
    detected = F.when(armed, F.coalesce(F.col("score") < F.col("_prof"), F.lit(False))).otherwise(
        F.col("moving_avg") < threshold)
    return joined.select(
        *keys, "block", "fidelity_score", "moving_avg",
        F.when(armed, F.col("score")).otherwise(F.col("score_loo")).alias("profile_score"),
        F.when(armed, F.col("_fid")).alias("effective_threshold"),
        F.when(armed, F.col("_prof")).alias("profile_threshold"), detected.alias("drift_detected"))


def first_detection(monitor: DataFrame, keys: list[str]) -> DataFrame:
    return monitor.groupBy(*keys).agg(F.min(F.when(F.col("drift_detected"), F.col("block"))).alias("first_detection"))


def first_accuracy_drop(errors: DataFrame, keys: list[str], drift_block: int) -> DataFrame:
    """First block from the drift block on whose MSE exceeds three times the baseline mean."""
    base = errors.groupBy(*keys).agg(F.avg(F.when(F.col("block") < drift_block, F.col("mse"))).alias("_base"))
    dropped = (F.col("block") >= drift_block) & (F.col("mse") > ACCURACY_FACTOR * F.col("_base"))
    return join_on(errors, base, keys).groupBy(*keys).agg(
        F.min(F.when(dropped, F.col("block"))).alias("first_accuracy_drop"))


def verdicts(monitor: DataFrame, errors: DataFrame, keys: list[str], drift_block: int) -> DataFrame:
    """Lead (strictly earlier), lag and confirmation per run."""
    joined = join_on(first_detection(monitor, keys), first_accuracy_drop(errors, keys, drift_block), keys, "left")
    lag = F.col("first_detection") - F.col("first_accuracy_drop")
    return joined.select(
        *keys, "first_detection", "first_accuracy_drop", lag.alias("detection_lag"),
        F.coalesce(lag < 0, F.lit(False)).alias("fidelity_leads"),
        F.coalesce(lag <= MAX_CONFIRMING_LAG, F.lit(False)).alias("confirming_detected"))


def false_alarms(monitor: DataFrame, keys: list[str], first_eval_block: int) -> DataFrame:
    """Flagged blocks once the monitor is armed, with the number of evaluated blocks."""
    evaluated = F.col("block") >= first_eval_block
    return monitor.groupBy(*keys).agg(
        F.count_if(evaluated & F.col("drift_detected")).alias("false_alarms"),
        F.count_if(evaluated).alias("n_evaluated_windows"),
        F.min(F.when(evaluated & F.col("drift_detected"), F.col("block"))).alias("first_false_alarm"))


def alarms_before_change(monitor: DataFrame, keys: list[str], drift_block: int) -> DataFrame:
    """Flagged blocks before the change, in order: false alarms, since nothing had drifted yet. Their
    number is bounded by the blocks of the normal period."""
    early = F.when(F.col("drift_detected") & (F.col("block") < drift_block), F.col("block"))
    return monitor.groupBy(*keys).agg(F.sort_array(F.collect_list(early)).alias("false_alarm_blocks_before_change"))
