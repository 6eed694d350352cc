"""Forecast, attribution and drift study over a feature series."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gapspark.operators import drift as dr
from gapspark.operators import features as ft
from gapspark.operators.ordered import join_on
from gapspark.session import materialize

BACKGROUND = 20
BLOCK = 10


def series_sequences(windows: DataFrame, columns: tuple[str, ...], ts: str, n_normal: int) -> DataFrame:
    """Sequences of the whole series, normalised by its first ``n_normal`` windows."""
    indexed = ft.positions(windows, [], ts, "idx")
    z = ft.normalise(indexed, ft.normalisation(indexed.where(F.col("idx") < n_normal), columns), columns)
    packed = z.select("idx", F.array(*[F.col(c).cast("double") for c in columns]).alias("features"))
    return ft.sliding_sequences(packed).withColumn("x", F.flatten("x"))


def replicate_weight(seed: int, index: str = "seq_index"):
    """Bootstrap weight of a training row: a Poisson(1) draw from a hash of (seed, row)."""
    u = F.pmod(F.xxhash64(F.lit(seed), F.col(index)), F.lit(1_000_003)) / F.lit(1_000_003.0)
    weight = F.lit(5.0)
    total, term = 0.0, np.exp(-1.0)
    bounds = []
    for k in range(5):
        total += term
        bounds.append((k, total))
        term /= k + 1
    for k, bound in reversed(bounds):
        weight = F.when(u < bound, F.lit(float(k))).otherwise(weight)
    return weight


def fit_forecaster(
    training: DataFrame, n_targets: int, seed: int | None = None, ridge: float = 0.01,
) -> tuple[np.ndarray, np.ndarray]:
    """One ridge model per target on the flattened sequence, all from a single pass.

    Every partition reduces to the weighted moments of inputs and targets, which add up cell by
    cell; the driver solves one system of fixed size, inputs by inputs. The penalty acts on
    standardised inputs and targets. Returns coefficients (targets x inputs) and intercepts.
    """
    weight = F.lit(1.0) if seed is None else replicate_weight(seed)
    rows = training.select("x", "y", weight.alias("w"))

    def moments(frames):
        total = 0.0
        for pdf in frames:
            if len(pdf):
                z = np.column_stack([np.ones(len(pdf)), np.stack(pdf["x"].to_list()), np.stack(pdf["y"].to_list())])
                total = total + (z * pdf["w"].to_numpy()[:, None]).T @ z
        if not np.isscalar(total):
            yield pd.DataFrame({"cell": np.arange(total.size), "value": total.ravel()})

    cells = rows.mapInPandas(moments, "cell bigint, value double").groupBy("cell").agg(F.sum("value")).collect()
    side = int(round(len(cells) ** 0.5))
    m = np.zeros(side * side)
    m[[c[0] for c in cells]] = [c[1] for c in cells]
    m = m.reshape(side, side) / m[0]
    mean, cov = m[0, 1:], m[1:, 1:] - np.outer(m[0, 1:], m[0, 1:])
    n_inputs = side - 1 - n_targets
    std = np.sqrt(np.maximum(np.diag(cov), 0))
    scale = np.where(std > 0, std, 1.0)
    corr = cov / np.outer(scale, scale)
    inputs, targets = slice(0, n_inputs), slice(n_inputs, None)
    coef = np.zeros((n_targets, n_inputs))
    for k in range(n_targets):
        y = n_inputs + k
        system = corr[inputs, inputs] + ridge / scale[y] * np.eye(n_inputs)
        coef[k] = np.linalg.lstsq(system, corr[inputs, y], rcond=None)[0] * scale[y] / scale[inputs]
    return coef, mean[targets] - coef @ mean[inputs]


def apply_forecaster(sequences: DataFrame, coef: np.ndarray, intercept: np.ndarray, background: np.ndarray) -> DataFrame:
    """Per sequence: forecast error, scalar output, explained output and its attributions.

    The scalar output is the mean over targets. For a linear forecaster its Shapley values are
    exact: coefficient times distance from the background mean.
    """
    mean_coef = coef.mean(axis=0)
    base = float(intercept.mean() + mean_coef @ background)

    def score(frames):
        for pdf in frames:
            x, y = np.stack(pdf["x"].to_list()), np.stack(pdf["y"].to_list())
            predicted = x @ coef.T + intercept
            parts = (x - background) * mean_coef
            out = pdf[["seq_index", "block"]].copy()
            out["mse"] = ((predicted - y) ** 2).mean(axis=1)
            out["mae"] = np.abs(predicted - y).mean(axis=1)
            out["actual"] = predicted.mean(axis=1)
            out["explained"] = base + parts.sum(axis=1)
            out["parts"] = parts.tolist()
            yield out

    return sequences.select("seq_index", "block", "x", "y").mapInPandas(
        score, "seq_index bigint, block bigint, mse double, mae double, actual double, explained double, parts array<double>")


def drift_study(
    windows: DataFrame, columns: tuple[str, ...], ts: str, n_normal: int, n_total: int,
    seeds: tuple[int, ...] = (42,),
) -> tuple[DataFrame, DataFrame]:
    """(monitor rows, verdicts) per seed; a seed is one bootstrap replicate of the training rows.

    Training rows are the first 80 % of the normal period; blocks hold ten sequences and an
    incomplete tail block is dropped. The baseline covers the blocks before the change; blocks flagged
    there are listed with the verdict as false alarms.
    """
    seq_len = ft.SEQUENCE_LENGTH
    ft.require_sequences(n_normal, seq_len)
    sequences = materialize(series_sequences(windows, columns, ts, n_normal), "sequences")
    blocks = ft.fixed_blocks(sequences, F.lit(n_total - seq_len), BLOCK)
    n_train = int((n_normal - seq_len) * 0.8)
    training = sequences.where(F.col("seq_index") < n_train)
    first_rows = sequences.where(F.col("seq_index") < min(BACKGROUND, n_train)).select("x").collect()
    background = np.mean([r["x"] for r in first_rows], axis=0)
    baseline = max((n_normal - seq_len) // BLOCK, 1)
    scored = None
    for seed in seeds:
        coef, intercept = fit_forecaster(training, len(columns), seed)
        one = apply_forecaster(blocks, coef, intercept, background).withColumn("seed", F.lit(seed))
        scored = one if scored is None else scored.unionByName(one)
    scored = materialize(scored, "scored")
    keys = ["seed"]
    attributions = scored.select("seed", "block", F.posexplode("parts").alias("feature", "value"))
    fidelity = dr.explanation_fidelity(scored, [*keys, "block"])
    monitor = dr.monitor_adaptive(fidelity, dr.profiles(attributions, keys), keys, baseline)
    errors = scored.groupBy(*keys, "block").agg(F.avg("mse").alias("mse"), F.avg("mae").alias("mae"))
    monitor = materialize(monitor, "monitor")
    verdicts = dr.verdicts(monitor, errors, keys, baseline)
    return monitor, join_on(verdicts, dr.alarms_before_change(monitor, keys, baseline), keys)
