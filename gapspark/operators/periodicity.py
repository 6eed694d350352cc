"""Daily series: grouping, detrending, permutation and surrogate tests of periodicity.

Daily series are aggregates with one row per calendar day, so a whole series is a short array.
The resampling is spread instead: one row per (series, replicate), never one task per series.
"""

from __future__ import annotations

from hashlib import md5

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gapspark.operators.ordered import halo_blocks, join_on, midranks, spread, value_counts
from gapspark.schemas import WEEKDAY_LABELS
from gapspark.session import materialize

N_PERM = 10_000
SEED = 42
ALPHA = 0.05
EPS2_FLOOR = 0.14
BAND_STEPS = 41
BURN_IN = 100


# --- grouping ---------------------------------------------------------------------------------

def calendar_parts(daily: DataFrame, period: int = 24, day: str = "day") -> DataFrame:
    """Weekday (Mon = 0) and cycle phase counted from the first day of the data."""
    first = daily.agg(F.min(day).alias("_first"))
    return daily.crossJoin(F.broadcast(first)).select(
        *daily.columns, F.weekday(day).alias("weekday"),
        F.pmod(F.date_diff(F.col(day), F.col("_first")), F.lit(period)).alias("phase"))


def _grouped(labels: DataFrame, groups: DataFrame, key: str) -> DataFrame:
    return labels.join(groups, key, "left").select(
        *labels.columns, F.coalesce("n_days", F.lit(0)).alias("n_days"),
        F.coalesce("total", F.lit(0)).alias("total"), "mean_count", "median_count")


def _group_stats(parts: DataFrame, key: str, value: str) -> DataFrame:
    return parts.groupBy(key).agg(
        F.count(F.lit(1)).alias("n_days"), F.sum(value).alias("total"),
        F.avg(value).alias("mean_count"), F.median(value).alias("median_count"))


def by_weekday(daily: DataFrame, value: str = "total_count") -> DataFrame:
    """All seven labels appear, also those without a day."""
    labels = daily.sparkSession.range(1).select(F.posexplode(
        F.array(*[F.lit(x) for x in WEEKDAY_LABELS])).alias("weekday", "label"))
    return _grouped(labels, _group_stats(calendar_parts(daily), "weekday", value), "weekday")


def by_cycle_phase(daily: DataFrame, period: int = 24, value: str = "total_count") -> DataFrame:
    labels = daily.sparkSession.range(period).select(F.col("id").cast("int").alias("phase"))
    return _grouped(labels, _group_stats(calendar_parts(daily, period), "phase", value), "phase")


def regime_description(daily: DataFrame, late_start: str, value: str = "total_count") -> DataFrame:
    """Quartiles before and after a change day, ratio of medians, extreme days (one row)."""
    v, late = F.col(value), F.col("day") >= F.lit(late_start).cast("date")
    probs = F.array(*[F.lit(p) for p in (0.25, 0.5, 0.75)])
    s = daily.agg(
        F.count_if(~late).alias("n_early"), F.count_if(late).alias("n_late"),
        F.percentile(F.when(~late, v), probs).alias("_e"), F.percentile(F.when(late, v), probs).alias("_l"),
        F.max_by("day", F.struct(v, F.date_diff(F.lit("9999-01-01"), "day"))).alias("max_day"), F.max(v).alias("max_count"),
        F.min_by("day", F.struct(v, "day")).alias("min_day"), F.min(v).alias("min_count"))
    q = lambda a, i: F.get(a, F.lit(i))
    return s.select(
        "n_early", "n_late",
        *[q(a, i).alias(f"{name}_{label}") for a, name in (("_e", "early"), ("_l", "late"))
          for i, label in enumerate(("q25", "median", "q75"))],
        (q("_l", 1) / q("_e", 1)).alias("late_over_early_median"),
        "max_day", "max_count", "min_day", "min_count")


# --- series -----------------------------------------------------------------------------------

def log_series(daily: DataFrame, value: str = "total_count") -> DataFrame:
    """``y = ln(count)``; a zero count has no logarithm and stays NULL, flagged as a violation."""
    v = F.col(value)
    return daily.withColumn("y", F.when(v > 0, F.ln(v.cast("double")))).withColumn("log_violation", ~(v > 0))


def variant_series(logs: DataFrame, variants: dict[str, tuple[list[str], str]], start: str) -> DataFrame:
    """(variant, detrend, idx, day, weekday, y): one series per sensitivity variant.

    ``variants``: name -> (days to leave out, detrending mode). All variants share one plan.
    """
    specs = F.array(*[
        F.struct(F.lit(name).alias("variant"), F.lit(mode).alias("detrend"),
                 F.array(*[F.lit(x) for x in days]).cast("array<date>").alias("_drop"))
        for name, (days, mode) in variants.items()])
    rows = logs.where(F.col("day") >= F.lit(start).cast("date")).select("day", "y", F.inline(specs)).where(
        ~F.array_contains("_drop", F.col("day")))
    along = Window.partitionBy("variant").orderBy("day")
    return rows.select(
        "variant", "detrend", (F.row_number().over(along) - 1).cast("bigint").alias("idx"), "day",
        F.weekday("day").alias("weekday"), "y")


def linear_detrend(series: DataFrame, keys: list[str]) -> DataFrame:
    x = F.col("idx").cast("double")
    fit = series.groupBy(*keys).agg(F.regr_slope("y", x).alias("_s"), F.regr_intercept("y", x).alias("_i"))
    return join_on(series, fit, keys).withColumn(
        "resid", F.col("y") - (F.col("_s") * x + F.col("_i"))).drop("_s", "_i")


def rolling_median_detrend(series: DataFrame, keys: list[str], window: int = 15) -> DataFrame:
    """Subtracts a centred rolling median whose half-width shrinks symmetrically at both ends."""
    half = window // 2
    sizes = series.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    blocks, w = halo_blocks(join_on(series, sizes, keys), keys, "idx", half, half)
    i = F.col("idx")
    h = F.least(F.lit(half), i, F.col("_n") - 1 - i).cast("int")
    centre = F.least(i, F.lit(half)).cast("int")
    near = blocks.withColumn("_near", F.collect_list("y").over(w.rowsBetween(-half, half))).where("_own")
    inner = F.sort_array(F.slice("_near", centre - h + 1, 2 * h + 1))
    return near.withColumn("resid", F.col("y") - F.get(inner, h)).drop("_near", "_own", "_block", "_n")


def detrended(series: DataFrame) -> DataFrame:
    """Residuals by each variant's own detrending mode."""
    keys = ["variant"]
    linear = linear_detrend(series.where("detrend = 'linear'"), keys)
    rolling = rolling_median_detrend(series.where("detrend = 'rolling'"), keys)
    return linear.unionByName(rolling.select(*linear.columns))


def ar1_fit(resid: DataFrame, keys: list[str]) -> DataFrame:
    """Lag-1 coefficient and innovation deviation of the centred residuals."""
    resid = materialize(resid, "residuals")  # one row per day, read three times below
    centred = join_on(resid, resid.groupBy(*keys).agg(F.avg("resid").alias("_m")), keys).withColumn(
        "_r", F.col("resid") - F.col("_m"))
    lagged = centred.withColumn("_lag", F.lag("_r").over(Window.partitionBy(*keys).orderBy("idx"))).where(
        "_lag IS NOT NULL")
    phi = lagged.groupBy(*keys).agg((F.sum(F.col("_r") * F.col("_lag")) / F.sum(F.col("_lag") * F.col("_lag"))).alias("phi"))
    return join_on(lagged, phi, keys).groupBy(*keys).agg(
        F.max("phi").alias("phi"), F.stddev_samp(F.col("_r") - F.col("phi") * F.col("_lag")).alias("sigma"))


# --- resampling -------------------------------------------------------------------------------

def as_arrays(resid: DataFrame, keys: list[str]) -> DataFrame:
    """One row per series: residuals, weekdays and residual ranks in day order."""
    ranks = midranks(value_counts(resid, keys, "resid"), keys, "resid").select(*keys, "resid", "midrank", "n")
    rows = join_on(resid, ranks, [*keys, "resid"])
    n = F.col("n").cast("double")
    return rows.groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.struct("idx", "resid", "weekday", "midrank"))).alias("_a"),
        F.sum(n * n - 1).alias("_ties"), F.count(F.lit(1)).alias("n_days"),
    ).select(
        *keys, "n_days", F.col("_a.resid").alias("resid"), F.col("_a.weekday").alias("weekday"),
        F.col("_a.midrank").alias("ranks"), "_ties")


def permutations(arrays: DataFrame, keys: list[str], n_perm: int = N_PERM, seed: int = SEED) -> DataFrame:
    """One row per (series, permutation) with shuffled ``resid`` and ``ranks``.

    The order comes from a hash of (seed, permutation, position): reproducible anywhere and
    independent of partitioning.
    """
    chunks = F.explode(F.sequence(F.lit(0), F.lit((n_perm - 1) // 100)))
    perm = F.explode(F.sequence(
        F.col("_chunk") * 100, F.least(F.col("_chunk") * 100 + 99, F.lit(n_perm - 1))))
    rows = spread(arrays.withColumn("_chunk", chunks), *keys, "_chunk").withColumn("perm", perm).drop("_chunk")
    keyed = F.transform("resid", lambda r, i: F.struct(
        F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("perm").cast("string"), i.cast("string")).cast("binary")).alias("h"),
        r.alias("r"), F.get("ranks", i).alias("k")))
    shuffled = rows.withColumn("_s", F.array_sort(keyed))
    return shuffled.withColumn("resid", F.col("_s.r")).withColumn("ranks", F.col("_s.k")).drop("_s")


def _h_statistic() -> Column:
    """Tie-corrected Kruskal-Wallis H of ``ranks`` by ``weekday``."""
    n = F.col("n_days").cast("double")
    total = F.lit(0.0)
    for k in range(7):
        member = F.transform("weekday", lambda w: (w == k).cast("double"))
        size = F.aggregate(member, F.lit(0.0), lambda a, m: a + m)
        rank_sum = F.aggregate(F.zip_with(member, F.col("ranks"), lambda m, r: m * r), F.lit(0.0), lambda a, x: a + x)
        total = total + F.coalesce(F.try_divide(rank_sum * rank_sum, size), F.lit(0.0))
    h = 12 / (n * (n + 1)) * total - 3 * (n + 1)
    return h / (1 - F.col("_ties") / (n * n * n - n))


def weekday_permutation_test(arrays: DataFrame, keys: list[str], n_perm: int = N_PERM, seed: int = SEED) -> DataFrame:
    """H of the weekday groups, effect size, and its permutation p."""
    observed = arrays.select(*keys, "n_days", _h_statistic().alias("H"))
    permuted = permutations(arrays, keys, n_perm, seed).select(*keys, _h_statistic().alias("_h"))
    counted = join_on(permuted, observed, keys).groupBy(*keys).agg(
        F.count_if(F.col("_h") >= F.col("H") - 1e-9).alias("_ge"))
    return join_on(observed, counted, keys).select(
        *keys, "n_days", "H", (F.col("H") / (F.col("n_days") - 1)).alias("eps2"),
        ((F.col("_ge") + 1) / F.lit(float(n_perm + 1))).alias("p"))


def _band_power(y: np.ndarray, period: float, half_width: float) -> np.ndarray:
    """Largest normalised Lomb-Scargle power in the band, for each row of ``y``."""
    t = np.arange(y.shape[1], dtype=float)
    w = 2 * math.pi / np.linspace(period - half_width, period + half_width, BAND_STEPS)
    y = y - y.mean(axis=1, keepdims=True)
    shift = np.arctan2(np.sin(2 * np.outer(t, w)).sum(0), np.cos(2 * np.outer(t, w)).sum(0)) / (2 * w)
    phase = np.outer(t, w) - w * shift
    c, s = np.cos(phase), np.sin(phase)
    power = (y @ c) ** 2 / (c**2).sum(0) + (y @ s) ** 2 / (s**2).sum(0)
    return power.max(axis=1) / (y**2).sum(axis=1)


def band_power(series: DataFrame, keep: list[str], bands: dict[str, tuple[float, float]]) -> DataFrame:
    """Adds one power column per band to rows holding a ``resid`` array (Arrow batches, numpy)."""
    fields = {f.name: f.dataType.simpleString() for f in series.schema.fields}

    def compute(frames):
        for pdf in frames:
            out = pdf[keep].copy()
            for name, (period, half_width) in bands.items():
                power = np.empty(len(pdf))
                lengths = pdf["resid"].map(len).to_numpy()
                for n in np.unique(lengths):
                    rows = np.flatnonzero(lengths == n)
                    power[rows] = _band_power(np.stack(pdf["resid"].iloc[rows].to_list()), period, half_width)
                out[name] = power
            yield out

    ddl = ", ".join([*(f"`{k}` {fields[k]}" for k in keep), *(f"`{b}` double" for b in bands)])
    return series.select(*keep, "resid").mapInPandas(compute, ddl)


def _hashed_normals(label: str, first: int, count: int, length: int) -> np.ndarray:
    """Standard normal draws that any engine can repeat: draw k of surrogate r is made from the md5 of
    ``label:r:k``, two numbers of 52 bits, by the Box-Muller rule."""
    digits = [md5(f"{label}:{r}:{k}".encode()).hexdigest() for r in range(first, first + count) for k in range(length)]
    u = np.array([(int(h[:13], 16) + 1, int(h[13:26], 16)) for h in digits], np.float64) / 2.0**52
    return (np.sqrt(-2 * np.log(u[:, 0])) * np.cos(2 * np.pi * u[:, 1])).reshape(count, length)


def ar1_surrogates(fits: DataFrame, keys: list[str], n: int = N_PERM, seed: int = SEED) -> DataFrame:
    """One row per (series, surrogate): a simulated AR(1) path of the same length.

    The recursion runs inside tasks over ranges of surrogates; draws depend only on
    (seed, series, surrogate, day), by a hash that SQL has too.
    """
    step = 250
    ranges = spread(
        fits.withColumn("_range", F.explode(F.sequence(F.lit(0), F.lit((n - 1) // step)))).withColumn(
            "_label", F.concat_ws(":", F.lit(str(seed)), *[F.col(k).cast("string") for k in keys])), *keys, "_range")
    types = {f.name: f.dataType.simpleString() for f in fits.schema.fields}

    def simulate(frames):
        for pdf in frames:
            for i in range(len(pdf)):
                row = pdf.iloc[i]
                first, days = int(row["_range"]) * step, int(row["n_days"])
                noise = row["sigma"] * _hashed_normals(row["_label"], first, min(step, n - first), days + BURN_IN)
                path = np.empty_like(noise)
                path[:, 0] = noise[:, 0]
                for k in range(1, noise.shape[1]):
                    path[:, k] = row["phi"] * path[:, k - 1] + noise[:, k]
                out = pd.DataFrame({"resid": path[:, BURN_IN:].tolist()})
                for k in keys:
                    out[k] = row[k]
                yield out[[*keys, "resid"]]

    ddl = ", ".join([*(f"`{k}` {types[k]}" for k in keys), "resid array<double>"])
    return ranges.select(*keys, "n_days", "phi", "sigma", "_label", "_range").mapInPandas(simulate, ddl)


def _exceedances(replicates: DataFrame, observed: DataFrame, keys: list[str], bands, label: str) -> DataFrame:
    powers = band_power(replicates, keys, bands)
    seen = observed.select(*keys, *[F.col(b).alias(f"_obs_{b}") for b in bands])
    return join_on(powers, seen, keys).groupBy(*keys).agg(
        *[F.count_if(F.col(b) >= F.col(f"_obs_{b}")).alias(f"{label}_{b}") for b in bands])


def periodicity_test(
    arrays: DataFrame, keys: list[str], bands: dict[str, tuple[float, float]],
    n_perm: int = N_PERM, seed: int = SEED, fits: DataFrame | None = None,
) -> DataFrame:
    """Band powers with permutation p and, given AR(1) ``fits``, surrogate p; the larger counts."""
    observed = band_power(arrays, [*keys, "n_days"], bands)
    shuffled = permutations(arrays, keys, n_perm, seed)
    out = join_on(observed, _exceedances(shuffled, observed, keys, bands, "_perm"), keys)
    p = lambda c: (F.col(c) + 1) / F.lit(float(n_perm + 1))
    columns = [*keys, "n_days"]
    if fits is not None:
        with_days = join_on(fits, observed.select(*keys, "n_days"), keys)
        surrogates = ar1_surrogates(with_days, keys, n_perm, seed)
        out = join_on(out, _exceedances(surrogates, observed, keys, bands, "_ar1"), keys)
        out = join_on(out, fits.select(*keys, F.col("phi").alias("ar1_phi")), keys)
        columns.append("ar1_phi")
    for b in bands:
        columns += [F.col(b).alias(f"power_{b}"), p(f"_perm_{b}").alias(f"p_perm_{b}")]
        if fits is not None:
            columns += [p(f"_ar1_{b}").alias(f"p_ar1_{b}"), F.greatest(p(f"_perm_{b}"), p(f"_ar1_{b}")).alias(f"p_{b}")]
    return out.select(*columns)
