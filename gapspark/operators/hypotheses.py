"""Grouped statistical tests: every condition is tested in the same distributed plan.

Samples are first reduced to value counts, which combine map-side; rank statistics then work on
distinct values only, so neither a large condition nor heavy ties end up in one task.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from gapspark.functions.special import (
    chi2_upper_tail, ln_factorial, normal_two_sided, normal_upper_tail, student_two_sided,
)
from gapspark.operators.ordered import (
    join_on, midranks, quantile_bucket, running_totals, spread, value_counts,
)
from gapspark.session import materialize

N_BOOTSTRAP = 10_000
SEED = 42
EXACT_SIDE = 8  # a side this small and no ties: the exact rank-sum distribution applies
PERIOD = 840  # of the counts below: the least common multiple of 1 to 8
LISTABLE_FLIPS = 48  # values whose half sums, 2 ** 24 of them, can be listed
FEW_CELLS = 512  # distinct values of a block that are drawn one by one
MANY_COPIES = 64  # samples per distinct value from which on numpy's own draw is the faster one
SLOTS = 1 << 12  # of a table of Poisson counts
GRID_DIGITS = 6  # decimal places that a common grid of values may have
GRID_CELLS, GRID_WORK = 1 << 22, 1 << 33  # sums on the grid, and steps over them, up to which one task counts a key
WHOLE_CELLS = 1 << 53  # up to here doubles hold every whole number
HEAD_STATES, HEAD_WORK = 1 << 16, 1 << 24  # sums of large steps that are listed, at once and in all
GRID_SIDE, GRID_CHUNK = 1 << 12, 1 << 19  # frequencies that share a table of angles, and that are held at once
UNIT_LEAST, UNIT_WORK, UNITS = 1 << 20, 1 << 28, 1 << 20  # frequencies of a unit, factors of one, units of a key


# --- two samples ------------------------------------------------------------------------------

def _cumulated(m: int) -> list[int]:
    """How many multisets of at most m parts have a sum of at most t, for the first t."""
    size = PERIOD * (m + 2)
    counts = [1] + [0] * (size - 1)
    for part in (1, *range(1, m + 1)):  # the part 1 twice: once for itself, once to cumulate
        for t in range(part, size):
            counts[t] += counts[t - part]
    return counts


def _below(table: list[int], m: int, t: int) -> int:
    """The cumulated count at any t: along one residue it is a polynomial of degree m."""
    if t < 0:
        return 0
    k, r = divmod(t, PERIOD)
    steps = [table[r + PERIOD * i] for i in range(m + 1)]
    total, factor = 0, 1
    for j in range(m + 1):
        total += factor * steps[0]
        factor = factor * (k - j) // (j + 1)
        steps = [y - x for x, y in zip(steps, steps[1:])]
    return total


def _exact_rank_sum_p(n1: int, n2: int, u: float, tables: dict[int, list[int]]) -> float:
    """Two-sided exact p of the rank-sum statistic: P(U >= max(u, n1*n2-u)), doubled.

    U counts pairs, so its frequencies are those of partitions inside an m by n box, m the small
    side: all partitions of at most m parts, less those with too large parts (inclusion and
    exclusion over subsets of the m sides). Whole numbers throughout; the work does not depend on n.
    """
    m, n = min(n1, n2), max(n1, n2)
    if m not in tables:
        tables[m] = _cumulated(m)
    table = tables[m]
    tail = int(round(n1 * n2 - max(u, n1 * n2 - u)))
    shifts = {0: 1}
    for i in range(1, m + 1):
        for at, sign in list(shifts.items()):
            if at + n + i <= tail:
                shifts[at + n + i] = shifts.get(at + n + i, 0) - sign
    hits = sum(sign * _below(table, m, tail - at) for at, sign in shifts.items())
    return min(1.0, 2 * hits / math.comb(m + n, m))


@F.pandas_udf(T.DoubleType())
def _exact_p(n1: pd.Series, n2: pd.Series, u: pd.Series) -> pd.Series:
    tables: dict[int, list[int]] = {}
    return pd.Series([
        None if pd.isna(x) else _exact_rank_sum_p(int(a), int(b), float(x), tables)
        for a, b, x in zip(n1, n2, u)
    ], dtype="float64")


def mann_whitney(
    samples: DataFrame, keys: list[str], side: str = "system", value: str = "value",
    sides: tuple[str, str] = ("baseline", "proposed"), exact: bool = True, weight: str | None = None,
) -> DataFrame:
    """U of the first side, two-sided p and rank-biserial r = 1 - 2U/(n1 n2) per key.

    Ties use the corrected normal approximation with continuity correction; a tie-free key with
    a side of at most eight values gets the exact p. Fewer than two values on a side gives NULLs,
    one common value p = 1 and r = 0. ``weight``: how many samples a row stands for.
    """
    times = F.col(weight) if weight else F.lit(1)
    first, second = (F.sum(F.when(F.col(side) == s, times).otherwise(0)) for s in sides)
    cells = samples.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(
        first.alias("_n1"), second.alias("_n2")
    ).withColumn("n", F.col("_n1") + F.col("_n2")).where("n > 0")
    n = F.col("n").cast("double")
    s = midranks(cells, keys, value).groupBy(*keys).agg(
        F.sum("_n1").alias("n_baseline"), F.sum("_n2").alias("n_proposed"),
        F.sum(F.col("midrank") * F.col("_n1")).alias("_r1"),
        F.sum(n * n * n - n).alias("_ties"), F.count(F.lit(1)).alias("_distinct"),
    )
    n1, n2 = F.col("n_baseline").cast("double"), F.col("n_proposed").cast("double")
    total = n1 + n2
    enough = (n1 >= 2) & (n2 >= 2)
    varied = enough & (F.col("_distinct") > 1)
    u = F.when(varied, F.col("_r1") - n1 * (n1 + 1) / 2)
    spread = F.sqrt(n1 * n2 / 12 * ((total + 1) - F.col("_ties") / (total * (total - 1))))
    z = (F.greatest(u, n1 * n2 - u) - n1 * n2 / 2 - 0.5) / spread
    p = F.least(F.lit(1.0), 2 * normal_upper_tail(z))
    out = s.withColumn("U", u)
    if exact:
        small = varied & (F.least(n1, n2) <= EXACT_SIDE) & (F.col("_ties") == 0)
        out = out.withColumn("_u_small", F.when(small, u))
        p = F.coalesce(_exact_p("n_baseline", "n_proposed", "_u_small"), p)
    return out.select(
        *keys, "n_baseline", "n_proposed", "U",
        F.when(varied, p).when(enough, F.lit(1.0)).alias("p_value"),
        F.when(varied, 1 - 2 * u / (n1 * n2)).when(enough, F.lit(0.0)).alias("effect_size_r"),
    )


def loss_occurrence(
    samples: DataFrame, keys: list[str], side: str = "system", value: str = "value", weight: str | None = None,
) -> DataFrame:
    """2x2 table per key: trials with and without any loss on both sides."""
    v, b, p = F.col(value), F.col(side) == "baseline", F.col(side) == "proposed"
    times = F.col(weight) if weight else F.lit(1)
    number = lambda which: F.sum(F.when(which, times).otherwise(0))
    return samples.where(v.isNotNull()).groupBy(*keys).agg(
        number(b & (v > 0)).alias("baseline_loss_count"), number(b).alias("n_baseline"),
        number(p & (v > 0)).alias("proposed_loss_count"), number(p).alias("n_proposed"),
    )


def fisher_exact(table: DataFrame, keys: list[str]) -> DataFrame:
    """Two-sided exact p and odds ratio of the occurrence tables.

    All tables with the same margins are enumerated as rows, in blocks so that a large margin
    spreads over tasks; p sums the probabilities not above the observed one.
    """
    a, c = F.col("baseline_loss_count"), F.col("proposed_loss_count")
    n1, n2 = F.col("n_baseline"), F.col("n_proposed")
    k = a + c
    block = 8192

    fixed = (
        ln_factorial(n1) + ln_factorial(n2) + ln_factorial(k) + ln_factorial(n1 + n2 - k)
        - ln_factorial(n1 + n2)
    )

    def ln_prob(x):
        return F.col("_fixed") - (
            ln_factorial(x) + ln_factorial(n1 - x) + ln_factorial(k - x) + ln_factorial(n2 - k + x))

    usable = table.where((n1 > 0) & (n2 > 0)).withColumn("_fixed", fixed)
    lo, hi = F.greatest(F.lit(0), k - n2), F.least(n1, k)
    blocks = usable.withColumn("_obs", ln_prob(a)).withColumn("_hi", hi).withColumn(
        "_from", F.explode(F.sequence(lo, hi, F.lit(block))))
    terms = spread(blocks, *keys, "_from").withColumn("_x", F.explode(F.sequence(
        F.col("_from"), F.least("_hi", F.col("_from") + block - 1)))).withColumn("_p", ln_prob(F.col("_x")))
    summed = terms.groupBy(*keys).agg(
        F.sum(F.when(F.col("_p") <= F.col("_obs") + F.lit(1e-7), F.exp("_p"))).alias("_sum"))
    odds = F.try_divide(a * (n2 - c), (n1 - a) * c)
    return join_on(table, summed, keys, "left").select(
        *keys, "baseline_loss_count", "n_baseline", "proposed_loss_count", "n_proposed",
        odds.cast("double").alias("odds_ratio"), F.least(F.lit(1.0), F.col("_sum")).alias("p_value"),
    )


# --- more than two samples --------------------------------------------------------------------

def cochran_armitage(levels: DataFrame, keys: list[str], dose: str) -> DataFrame:
    """Trend of occurrence over dose levels with equally spaced scores.

    ``levels``: one row per (key, dose) with n and x. Fewer than three levels give NULLs, zero
    variance z = 0 and p = 1. The window orders dose levels, a handful of rows per key.
    """
    per_key = Window.partitionBy(*keys)
    scored = levels.where("n > 0").withColumn("_t", (F.row_number().over(per_key.orderBy(dose)) - 1).cast("double"))
    n, x, t = F.col("n").cast("double"), F.col("x").cast("double"), F.col("_t")
    s = scored.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_levels"), F.sum(n).alias("_n"), F.sum(x).alias("_x"),
        F.sum(n * t).alias("_nt"), F.sum(n * t * t).alias("_ntt"), F.sum(x * t).alias("_xt"),
    )
    pbar, tbar = F.col("_x") / F.col("_n"), F.col("_nt") / F.col("_n")
    top = F.col("_xt") - tbar * F.col("_x") - pbar * (F.col("_nt") - tbar * F.col("_n"))
    variance = pbar * (1 - pbar) * (F.col("_ntt") - F.col("_n") * tbar * tbar)
    enough = F.col("n_levels") >= 3
    flat = variance <= 1e-12
    z = top / F.sqrt(F.when(~flat, variance))
    return s.select(
        *keys, "n_levels",
        F.when(enough & flat, F.lit(0.0)).when(enough, z).alias("z_statistic"),
        F.when(enough & flat, F.lit(1.0)).when(enough, normal_two_sided(z)).alias("p_two_sided"),
        F.when(enough & flat, F.lit(1.0)).when(enough, normal_upper_tail(z)).alias("p_increasing"),
    )


def kruskal_wallis(samples: DataFrame, keys: list[str], group: str, value: str = "value") -> DataFrame:
    """H with tie correction and its chi-square p per key; NULL below two groups."""
    cells = materialize(samples.where(F.col(value).isNotNull() & F.col(group).isNotNull()).groupBy(
        *keys, value, group).agg(F.count(F.lit(1)).alias("n")), "value-counts")
    at_value = cells.groupBy(*keys, value).agg(F.sum("n").alias("n"))
    ranked = midranks(at_value, keys, value)
    n = F.col("n").cast("double")
    ties = ranked.groupBy(*keys).agg(F.sum(n * n * n - n).alias("_ties"), F.sum(n).alias("_n"))
    rank_sums = join_on(cells, ranked.drop("n"), [*keys, value]).groupBy(*keys, group).agg(
        F.sum(F.col("midrank") * F.col("n")).alias("_r"), F.sum("n").alias("_g"))
    s = join_on(
        rank_sums.groupBy(*keys).agg(
            F.sum(F.col("_r") * F.col("_r") / F.col("_g")).alias("_rr"), F.count(F.lit(1)).alias("n_groups")),
        ties, keys)
    big = F.col("_n")
    correction = 1 - F.col("_ties") / (big * big * big - big)
    h = (12 / (big * (big + 1)) * F.col("_rr") - 3 * (big + 1)) / F.when(correction > 0, correction)
    enough, flat = F.col("n_groups") >= 2, correction <= 0
    return s.select(
        *keys, "n_groups", big.cast("bigint").alias("n_values"),
        F.when(enough & flat, F.lit(0.0)).when(enough, h).alias("H_statistic"),
        F.when(enough & flat, F.lit(1.0)).when(enough, chi2_upper_tail(h, F.col("n_groups") - 1)).alias("p_value"),
    )


def spearman(pairs: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """Rank correlation with its t-approximated two-sided p per key.

    The pairs are written once, and both columns are ranked in one long table.
    """
    complete = materialize(pairs.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(
        *keys, F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y")), "complete-pairs")
    long = complete.select(*keys, F.explode(F.array(
        F.struct(F.lit("x").alias("axis"), F.col("_x").alias("at")), F.struct(F.lit("y").alias("axis"), F.col("_y").alias("at")))
    ).alias("_p")).select(*keys, F.col("_p.axis").alias("_axis"), F.col("_p.at").alias("_at"))
    ranks = materialize(midranks(value_counts(long, [*keys, "_axis"], "_at"), [*keys, "_axis"], "_at"), "ranks")
    out = complete
    for axis in ("x", "y"):
        own = ranks.where(F.col("_axis") == axis).select(*keys, F.col("_at").alias(f"_{axis}"), F.col("midrank").alias(f"_rank_{axis}"))
        out = join_on(out, own, [*keys, f"_{axis}"])
    s = out.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.corr("_rank_x", "_rank_y").alias("rho"))
    t = F.col("rho") * F.sqrt((F.col("n") - 2) / F.when(F.abs("rho") < 1, 1 - F.col("rho") * F.col("rho")))
    p = F.when(F.abs("rho") >= 1, F.lit(0.0)).otherwise(student_two_sided(t, F.col("n") - 2))
    return s.select(*keys, "n", "rho", F.when(F.col("n") > 2, p).alias("p_value"))


# --- resampling -------------------------------------------------------------------------------

def _rng(*parts: int) -> np.random.Generator:
    return np.random.default_rng([int(p) & 0xFFFFFFFFFFFFFFFF for p in parts])


def _poisson_counts(rng: np.random.Generator, mean: float, shape: tuple[int, int]) -> np.ndarray:
    """Poisson counts of one mean, as floats: a slot of the unit interval is drawn and looked up; only in
    the few slots where the count changes the place inside the slot is drawn too."""
    k = np.arange(int(mean + 12 * math.sqrt(mean) + 30))
    cdf = np.cumsum(np.exp(k * math.log(mean) - mean - np.array([math.lgamma(i + 1) for i in k.tolist()])))
    edges = np.searchsorted(cdf, np.arange(SLOTS + 1) / SLOTS, "right")
    table = np.where(edges[:-1] == edges[1:], edges[:-1], -1).astype(float)
    slots = rng.integers(0, SLOTS, shape, dtype=np.uint16)
    counts = table[slots]
    split = counts < 0
    places = (slots[split] + rng.random(int(split.sum()))) / SLOTS
    counts[split] = np.minimum(np.searchsorted(cdf, places, "right"), len(k) - 1)
    return counts


def _resampled_sums(rng: np.random.Generator, own: np.ndarray, values: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Sums of ``own[r]`` draws with replacement from a block's samples, for each replicate r.

    Counts of a multinomial draw are independent Poisson counts, given their total. Values with the
    same number of samples have the same mean, so a block with many values draws Poisson counts from
    tables, for a few samples less than wanted; a replicate that exceeds its number is drawn again, and
    what a replicate lacks is drawn one by one. The distribution is that of the multinomial draw.
    """
    mass = int(weights.sum())
    base = mass - 8 * math.sqrt(mass)
    kinds, place = np.unique(weights, return_inverse=True)
    if len(values) < FEW_CELLS or mass > MANY_COPIES * len(values) or 4 * len(kinds) > len(values):
        return rng.multinomial(own, weights / mass) @ values
    cells = np.split(np.argsort(place, kind="stable"), np.cumsum(np.bincount(place))[:-1])
    sums, drawn, todo = np.zeros(len(own)), np.zeros(len(own), np.int64), np.arange(len(own))
    while len(todo):
        s, d = np.zeros(len(todo)), np.zeros(len(todo))
        for kind, at in zip(kinds.tolist(), cells):
            counts = _poisson_counts(rng, base * kind / mass, (len(todo), len(at)))
            s += counts @ values[at]
            d += counts.sum(1)
        sums[todo], drawn[todo] = s, d
        todo = todo[d > own[todo]]
    rest = own - drawn
    single = np.repeat(values, weights)[rng.integers(0, mass, int(rest.sum()))]
    return sums + np.bincount(np.repeat(np.arange(len(own)), rest), weights=single, minlength=len(own))


def _draws_of_children(draws: DataFrame, parents: DataFrame, keys: list[str], level: int, seed: int) -> DataFrame:
    """One step down the tree of blocks: each node's draws, per replicate, dealt to its children by mass."""
    fields = draws.schema
    key_ddl = "".join(f"`{k}` {fields[k].dataType.simpleString()}, " for k in keys)

    def deal(frames):
        for pdf in frames:
            found = []
            for row in pdf.to_dict("records"):
                mass = np.asarray(row["_masses"], dtype=np.int64)
                own = np.asarray(row["_draws"], dtype=np.int64)
                if len(mass) == 1:
                    dealt = own[:, None]
                else:
                    dealt = _rng(seed, row["_key"], level, row["_node"], row["_range"]).multinomial(own, mass / mass.sum())
                out = pd.DataFrame({
                    "_key": row["_key"], "_node": np.asarray(row["_children"], dtype=np.int64), "_range": row["_range"],
                    "_draws": list(dealt.T)})
                for k in keys:
                    out[k] = row[k]
                found.append(out[[*keys, "_key", "_node", "_range", "_draws"]])
            if found:
                yield pd.concat(found)

    paired = spread(join_on(draws, parents, [*keys, "_node"]), *keys, "_node", "_range")
    return paired.mapInPandas(deal, f"{key_ddl}_key bigint, _node bigint, _range int, _draws array<bigint>")


def bootstrap_ci(
    samples: DataFrame, keys: list[str], value: str = "value", n_bootstrap: int = N_BOOTSTRAP,
    confidence: float = 0.95, seed: int = SEED, cell_block: int = 2048, rep_block: int = 500, fanout: int = 256,
    weight: str | None = None,
) -> DataFrame:
    """Percentile bootstrap interval of the mean per key.

    A resample with replacement is a multinomial draw over the distinct values. Values lie in blocks,
    and blocks are the leaves of a tree in which a node has at most ``fanout`` children: the n draws of
    a replicate go from the root to the blocks level by level, then to the values inside each block. A
    row holds the masses of one node's children or the values of one block, never all of a key, and
    (node, range of replicates) is the unit of work. Draws depend only on (seed, key, level, node,
    range), not on partitioning or on other keys. ``weight``: how many samples a row stands for.
    """
    counts = materialize(value_counts(samples, keys, value, weight=weight), "value-counts")
    sizes = counts.groupBy(*keys).agg(
        F.sum("n").alias("n_values"), F.count(F.lit(1)).alias("_cells"),
        F.sum(F.col(value) * F.col("n")).alias("_total"))
    n_blocks = F.ceil(F.col("_cells") / F.lit(cell_block))
    blocks = materialize(
        join_on(counts, sizes, keys)
        .withColumn("_node", F.pmod(F.xxhash64(value), n_blocks))
        .groupBy(*keys, "_node").agg(
            F.sum("n").alias("_mass"), (F.max("_cells") > cell_block).alias("_large"),
            F.array_sort(F.collect_list(F.struct(F.col(value).cast("double").alias("v"), F.col("n").alias("n")))).alias("_list"))
        .withColumn("_values", F.col("_list.v")).withColumn("_counts", F.col("_list.n")).drop("_list"), "value-blocks")

    levels = [blocks.select(*keys, "_node", "_mass")]  # from the blocks to the root
    widest = blocks.agg(F.max("_node")).first()[0] or 0
    parents = []
    while widest > 0:
        below = levels[-1]
        parent = F.floor(F.col("_node") / F.lit(fanout)).cast("bigint")
        grouped = below.groupBy(*keys, parent.alias("_parent")).agg(
            F.sum("_mass").alias("_mass"), F.array_sort(F.collect_list(F.struct("_node", "_mass"))).alias("_of"))
        parents.append(grouped.select(
            *keys, F.col("_parent").alias("_node"), F.col("_of._node").alias("_children"), F.col("_of._mass").alias("_masses")))
        levels.append(grouped.select(*keys, F.col("_parent").alias("_node"), "_mass"))
        widest //= fanout

    last = (n_bootstrap + rep_block - 1) // rep_block - 1
    key_hash = F.xxhash64(*[F.col(k) for k in keys]) if keys else F.lit(0).cast("bigint")
    replicates = F.least(F.lit(rep_block), F.lit(n_bootstrap) - F.col("_range") * rep_block)
    draws = sizes.select(
        *keys, key_hash.alias("_key"), F.lit(0).cast("bigint").alias("_node"), "n_values",
        F.explode(F.sequence(F.lit(0), F.lit(last))).alias("_range"),
    ).select(*keys, "_key", "_node", "_range", F.array_repeat("n_values", replicates).alias("_draws"))
    for level in reversed(range(len(parents))):
        draws = _draws_of_children(draws, parents[level], keys, level + 1, seed)

    key_ddl = "".join(f"`{k}` {counts.schema[k].dataType.simpleString()}, " for k in keys)

    def sum_inside_block(frames):
        for pdf in frames:
            sums = []
            for row in pdf.to_dict("records"):
                values = np.asarray(row["_values"], dtype=float)
                weights = np.asarray(row["_counts"], dtype=np.int64)
                own = np.asarray(row["_draws"], dtype=np.int64)
                if len(values) == 1:
                    part = own * values[0]
                else:
                    rng = _rng(seed, row["_key"], 0, row["_node"], row["_range"])
                    if row["_large"]:
                        part = _resampled_sums(rng, own, values, weights)
                    else:  # a key of one block has bounded work
                        part = rng.multinomial(own, weights / weights.sum()) @ values
                sums.append(part.tolist())
            out = pdf[[*keys, "_range"]].copy()
            out["_sums"] = sums
            yield out

    paired = spread(join_on(draws, blocks.drop("_mass"), [*keys, "_node"]), *keys, "_node", "_range")
    inside = paired.mapInPandas(sum_inside_block, f"{key_ddl}_range int, _sums array<double>")
    means = inside.select(*keys, "_range", F.posexplode("_sums").alias("_rep", "_sum")).groupBy(
        *keys, "_range", "_rep").agg(F.sum("_sum").alias("_sum"))
    alpha = (1 - confidence) / 2
    bounds = means.groupBy(*keys).agg(F.percentile("_sum", F.array(F.lit(alpha), F.lit(1 - alpha))).alias("_q"))
    enough = F.col("n_values") >= 2
    return join_on(sizes, bounds, keys, "left").select(
        *keys, "n_values",
        F.when(enough, F.get("_q", F.lit(0)) / F.col("n_values")).alias("lower"),
        F.when(enough, F.get("_q", F.lit(1)) / F.col("n_values")).alias("upper"),
        F.when(enough, F.col("_total") / F.col("n_values")).alias("mean"),
    )


def _grid_p(steps: np.ndarray, copies: np.ndarray, observed: int) -> float:
    """P(|sum of +-steps| >= |observed|) by the product of the generating polynomials: the chance of
    every total of flipped steps, one shift and sum for each value."""
    total = int((steps * copies).sum())
    if observed == 0:
        return 1.0
    chance = np.zeros(total + 1)
    chance[0], reach = 1.0, 0
    for step, n in zip(steps.tolist(), copies.tolist()):
        for _ in range(n):
            flipped = chance[: reach + 1] / 2
            chance[: reach + 1] = flipped
            chance[step : reach + step + 1] += flipped
            reach += step
    # a total t of flipped steps leaves the sum total - 2 t
    return min(1.0, 2.0 * float(chance[: (total - abs(observed)) // 2 + 1].sum()))


def _tilt(ends: np.ndarray, weights: np.ndarray, sizes: np.ndarray, copies: np.ndarray) -> float:
    """The exponent that moves the mean of the flipped total to the ends; 0 if it lies below them anyhow."""

    def above(tilt: float) -> float:
        own = weights * np.exp(tilt * (ends - ends.max()))
        return float((own * ends).sum() / own.sum() - (copies * sizes / (1 + np.exp(np.minimum(tilt * sizes, 700.0)))).sum())

    if above(0.0) >= 0:
        return 0.0
    low, high = 0.0, 1.0 / float((sizes * copies).sum())
    while above(high) < 0:
        low, high = high, 2 * high
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if above(mid) < 0 else (low, mid)
    return high


def _grid_plan(steps: np.ndarray, copies: np.ndarray, observed: int, states: int = HEAD_STATES) -> tuple:
    """What ``_grid_part`` needs for P(flipped total <= end), and the part of that chance known already.

    Totals of the largest steps are listed as long as that makes the rest cheaper: a total that no rest
    can carry over the end counts whole, one beyond the end not at all. The others go on, each with the
    room left to the end. A step far from all others thus costs nothing, and few distinct totals are
    listed to the end.
    """
    order = np.argsort(-steps)
    steps, copies = steps[order], copies[order]
    reach = int((steps * copies).sum())
    end = (reach - abs(observed)) // 2
    if end * 2 == reach:
        return 1.0, 0.0, 0, [], [], [], []
    known, at, weights, work = 0.0, np.zeros(1, np.int64), np.ones(1), 0
    least, best = math.inf, None
    for i in range(len(steps) + 1):
        left = int(copies[i]) if i < len(steps) else 0
        while True:
            cost = (len(steps) - i + len(at)) * (reach + 1) if len(at) else 0
            if cost < least:
                least, best = cost, (known, at, weights, i, left)
            work += len(at) + HEAD_WORK // 4096  # no more than so many rounds
            if not left or not len(at) or len(at) > states or work > HEAD_WORK:
                break
            left -= 1
            reach -= int(steps[i])
            at, found = np.unique(np.concatenate([at, at + steps[i]]), return_inverse=True)
            weights = np.bincount(found, weights=np.concatenate([weights, weights]) / 2)
            sure, open_ = at + reach <= end, (at <= end) & (at + reach > end)
            known += float(weights[sure].sum())
            at, weights = at[open_], weights[open_]
        if not len(at) or len(at) > states or work > HEAD_WORK:
            break
    known, at, weights, i, left = best
    steps, copies = steps[i:], np.concatenate([[left] if i < len(steps) else [], copies[i + 1 :]]).astype(np.int64)
    steps, copies = steps[copies > 0], copies[copies > 0]
    at, weights = at[weights > 0], weights[weights > 0]
    ends = end - at
    if len(ends):  # with less room than the least step no flip is left but none
        none = ends < steps[-1]
        known += float(weights[none].sum()) * 2.0 ** -float(copies.sum())
        ends, weights = ends[~none], weights[~none]
    if not len(ends):
        return min(1.0, 2 * known), 0.0, 0, [], [], [], []
    tilt = _tilt(ends, weights, steps, copies)
    scale = float((copies * (np.log1p(np.exp(-tilt * steps)) - math.log(2.0))).sum())
    weights = np.exp(np.log(weights) + scale + tilt * ends)
    cells = (int((steps * copies).sum()) + 1) | 1  # an odd number, so frequencies other than 0 come in pairs
    sums = np.expm1(-tilt * (ends + 1.0)) / math.expm1(-tilt) if tilt else ends + 1.0
    return 2 * (known + float((weights * sums).sum()) / cells), tilt, cells, steps, copies, ends, weights


def _turns(step: int, k: np.ndarray | list[int], cells: int) -> np.ndarray:
    """exp(2 pi i step k / cells); whole turns are dropped while the numbers are whole."""
    rest = np.array([step * int(x) % cells for x in k], np.int64) if isinstance(k, list) else step * k % cells
    return np.exp(2j * np.pi / cells * rest)


def _grid_part(first: int, last: int, tilt: float, cells: int, sizes: np.ndarray, copies: np.ndarray, ends: np.ndarray, weights: np.ndarray) -> float:
    """The share of the frequencies first to last in the two-sided p.

    The chance of a total is the inverse Fourier transform of the product of (1 + turned step) / 2, and
    the sum up to an end has a closed form per frequency, so frequencies need neither each other nor
    memory for the totals. Steps are weighed by exp(-tilt step), so a small p keeps its digits.
    """
    side = int(min(GRID_SIDE, (1 << 62) // cells))
    near = np.arange(side, dtype=np.int64)
    factors = np.exp(-tilt * sizes)
    edge = float((weights * np.exp(-tilt * (ends + 1.0))).sum())
    total = 0.0
    for begin in range(first, last + 1, GRID_CHUNK):
        stop = min(begin + GRID_CHUNK, last + 1)
        starts = list(range(begin, stop, side))
        product = np.ones((len(starts), side), complex)
        turned = np.empty(side, complex)
        for size, n, r in zip(sizes.tolist(), copies.tolist(), factors.tolist()):
            table, base = _turns(size, near, cells) * (r / (1 + r)), 1 / (1 + r)
            for row, start in zip(product, _turns(size, starts, cells)):
                np.multiply(table, start, out=turned)
                turned += base
                row *= turned if n == 1 else turned**n
        sums = np.zeros_like(product)
        for end, weight in zip(ends.tolist(), weights.tolist()):
            table = weight * _turns(end, near, cells).conj()
            for row, start in zip(sums, _turns(end, starts, cells).conj()):
                np.multiply(table, start, out=turned)
                row += turned
        angle = 2j * np.pi / cells * np.arange(begin, stop)
        own, kernel = product.ravel()[: stop - begin], sums.ravel()[: stop - begin] - edge * np.exp(angle)
        total += float((own * kernel / -np.expm1(angle - tilt)).real.sum())
    return 4 * total / cells


def _by_frequencies(gathered: DataFrame, keys: list[str]) -> DataFrame:
    """``_p`` of keys with more cells than one task should step over, as a sum over units of frequencies."""

    @F.pandas_udf("_p double, _tilt double, _cells bigint, _sizes array<bigint>, _copies array<bigint>, _ends array<bigint>, _weights array<double>")
    def plan(observed: pd.Series, sizes: pd.Series, copies: pd.Series) -> pd.DataFrame:
        return pd.DataFrame(
            [_grid_plan(np.asarray(s, np.int64), np.asarray(n, np.int64), int(o)) for o, s, n in zip(observed, sizes, copies)],
            columns=["_p", "_tilt", "_cells", "_sizes", "_copies", "_ends", "_weights"])

    @F.pandas_udf(T.DoubleType())
    def part(
        first: pd.Series, last: pd.Series, tilt: pd.Series, cells: pd.Series, sizes: pd.Series, copies: pd.Series,
        ends: pd.Series, weights: pd.Series,
    ) -> pd.Series:
        return pd.Series([
            _grid_part(int(f), int(e), float(t), int(c), *map(np.asarray, arrays))
            for f, e, t, c, *arrays in zip(first, last, tilt, cells, sizes, copies, ends, weights)], dtype="float64")

    planned = materialize(spread(gathered, *keys).withColumn(
        "_plan", plan("_observed", F.col("_steps.s"), F.col("_steps.n"))).select(*keys, "_plan.*"), "grid-plans")
    half = F.floor(F.col("_cells") / 2)
    width = F.greatest(F.lit(UNIT_LEAST), F.floor(F.lit(UNIT_WORK) / F.size("_sizes")), F.ceil(half / UNITS))
    units = planned.where(F.col("_cells") > 0).withColumn("_width", width).withColumn(
        "_unit", F.explode(F.sequence(F.lit(0).cast("bigint"), F.ceil(half / F.col("_width")) - 1)))
    first = F.col("_unit") * F.col("_width") + 1
    parts = spread(units, *keys, "_unit").select(*keys, part(
        first, F.least(first + F.col("_width") - 1, half), "_tilt", "_cells", "_sizes", "_copies", "_ends", "_weights").alias("_part"))
    rest = parts.groupBy(*keys).agg(F.sum("_part").alias("_rest"))
    p = F.col("_p") + F.coalesce("_rest", F.lit(0.0))
    return join_on(planned.select(*keys, "_p"), rest, keys, "left").select(*keys, F.least(F.lit(1.0), p).alias("_p"))


def sign_flip_on_grid(values: DataFrame, keys: list[str], value: str, finest: int = WHOLE_CELLS) -> DataFrame:
    """Exact two-sided sign-flip p of the keys whose values lie on a common decimal grid, for any number
    of values: ``_p`` and ``_why`` (``off_grid``, ``grid_too_fine`` or NULL) per key.

    Values become whole steps of the grid and their counts, so what is gathered per key is bounded by
    the grid's cells and not by the rows. One task steps over the cells of a small grid; a larger one is
    summed over its frequencies, by as many tasks as there are. ``finest``: the most cells a key may have,
    for callers whose values may lie on any grid; beyond ``WHOLE_CELLS`` doubles hold no whole steps.
    """
    scaled = [F.col(value) * F.lit(10.0**d) for d in range(GRID_DIGITS + 1)]
    nonzero = values.where(F.col(value) != 0)
    # the tolerance covers what a mean of decimal numbers rounds
    whole = nonzero.groupBy(*keys).agg(*[
        F.bool_and(F.abs(s - F.round(s)) <= 1e-9 * F.greatest(F.lit(1.0), F.abs(s))).alias(f"_g{d}") for d, s in enumerate(scaled)])
    digits = F.coalesce(*[F.when(F.col(f"_g{d}"), F.lit(d)) for d in range(GRID_DIGITS + 1)])
    grids = whole.select(*keys, digits.alias("_digits"))
    stepped = join_on(nonzero, grids, keys).where(F.col("_digits").isNotNull()).select(
        *keys, F.round(F.col(value) * F.pow(F.lit(10.0), F.col("_digits"))).cast("decimal(38,0)").alias("_step"))
    counts = stepped.groupBy(*keys, F.abs("_step").alias("_size")).agg(
        F.count(F.lit(1)).alias("_n"), F.sum("_step").alias("_sum"))
    counts = materialize(counts, "grid-steps")
    sums = counts.groupBy(*keys).agg(
        F.sum(F.col("_size") * F.col("_n")).alias("_cells"), F.sum("_n").alias("_flips"), F.abs(F.sum("_sum")).alias("_observed"))
    state = materialize(join_on(grids, sums, keys, "left").withColumn("_why", F.when(
        F.col("_digits").isNull(), "off_grid").when(F.col("_cells") > min(finest, WHOLE_CELLS), "grid_too_fine")).withColumn(
        "_small", (F.col("_cells") <= GRID_CELLS) & (F.col("_cells").cast("double") * F.col("_flips") <= GRID_WORK)), "grid-state")

    def gather(some: DataFrame) -> DataFrame:
        own = some.where(F.col("_why").isNull()).select(*keys, F.col("_observed").cast("long").alias("_observed"))
        return join_on(counts, own, keys).groupBy(*keys).agg(
            F.max("_observed").alias("_observed"),
            F.collect_list(F.struct(F.col("_size").cast("long").alias("s"), F.col("_n").alias("n"))).alias("_steps"))

    @F.pandas_udf(T.DoubleType())
    def chance(observed: pd.Series, steps: pd.Series) -> pd.Series:
        return pd.Series([
            _grid_p(np.array([x["s"] for x in own], np.int64), np.array([x["n"] for x in own], np.int64), int(o))
            for o, own in zip(observed, steps)], dtype="float64")

    tested = spread(gather(state.where("_small")), *keys).select(*keys, chance("_observed", "_steps").alias("_p"))
    large = state.where(~F.col("_small") & F.col("_why").isNull())
    if large.limit(1).count():
        tested = tested.unionByName(_by_frequencies(gather(large), keys))
    return join_on(state.select(*keys, "_why"), tested, keys, "left")


def sign_flip_exact(
    values: DataFrame, keys: list[str], value: str, order: str, listable: int = LISTABLE_FLIPS, finest: int = GRID_CELLS,
) -> DataFrame:
    """Exact two-sided sign-flip test of a zero mean per key; zeros carry no information.

    Keys with up to ``listable`` non-zero values count all 2^n sign patterns without listing them: the
    values are split in two halves, each half lists its 2^(n/2) signed sums, and pairs reaching the
    observed sum are counted by an ordered pass that is split by value, so a long list never sits in one
    task. Keys with more values are counted on their common decimal grid (``sign_flip_on_grid``). Only
    where there is none, or one of more than ``finest`` cells, the p is NULL and ``status`` says why;
    ``sign_flip_sampled`` is the test to name for such keys. Callers whose cells are bounded by their
    rows name ``WHOLE_CELLS``: the work is then in proportion to them, and no key is refused.
    """
    values = materialize(values.select(*keys, value, order), "sign-flip-values")
    nonzero = values.where(F.col(value) != 0)
    sizes = materialize(nonzero.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_size"), F.count_if(F.col(value) > 0).alias("n_positive"),
        F.count_if(F.col(value) < 0).alias("n_negative")), "sign-flip-sizes")
    many = sizes.where(F.col("_size") > listable).select(*keys)
    on_grid = sign_flip_on_grid(join_on(values, many, keys), keys, value, finest) if many.limit(1).count() else None
    # decided before anything is gathered
    checked = join_on(nonzero, sizes.where(F.col("_size") <= listable), keys)
    s = checked.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_n"), F.abs(F.sum(value)).alias("_obs"),
        F.transform(F.array_sort(F.collect_list(F.struct(order, value))), lambda r: F.abs(r[value])).alias("_v"),
    )
    half = F.floor(F.col("_n") / 2).cast("int")
    halves = s.select(*keys, "_n", "_obs", F.explode(F.array(
        F.struct(F.lit(0).alias("part"), F.slice("_v", F.lit(1), half).alias("v")),
        F.struct(F.lit(1).alias("part"), F.slice("_v", half + 1, F.col("_n").cast("int") - half).alias("v")),
    )).alias("_h"))
    size = F.size("_h.v")
    high = F.floor(size / 2).cast("int")  # two-step expansion keeps each array short
    masks = halves.withColumn("_hi", F.explode(F.sequence(
        F.lit(0).cast("bigint"), F.pow(F.lit(2), high).cast("bigint") - 1)))
    masks = masks.withColumn("_lo", F.explode(F.sequence(
        F.lit(0).cast("bigint"), F.pow(F.lit(2), size - high).cast("bigint") - 1)))
    mask = F.col("_hi") * F.pow(F.lit(2), size - high).cast("bigint") + F.col("_lo")
    signed = F.aggregate(
        F.transform("_h.v", lambda x, i: F.when(
            F.floor(F.col("_mask") / F.pow(F.lit(2), i)).cast("bigint") % 2 == 1, -x).otherwise(x)),
        F.lit(0.0), lambda acc, x: acc + x)
    sums = masks.withColumn("_mask", mask).withColumn("_sum", signed)
    reach = F.col("_obs") - F.lit(1e-12)
    points = sums.select(
        *keys, "_n", "_obs", (F.col("_h.part") == 1).cast("int").alias("_kind"),
        F.when(F.col("_h.part") == 1, F.col("_sum")).otherwise(reach - F.col("_sum")).alias("_at"))
    points = materialize(points, "sign-flip-sums")
    bucketed = quantile_bucket(points, keys, "_at").withColumn("_order", F.struct("_at", "_kind"))
    counted = running_totals(bucketed, keys, "_order", {"_before": F.col("_kind")})
    hits = counted.groupBy(*keys).agg(
        F.sum(F.when(F.col("_kind") == 0, -F.col("_before").cast("double"))).alias("_minus"),
        F.sum("_kind").cast("double").alias("_right"), F.count_if(F.col("_kind") == 0).cast("double").alias("_left"),
        F.max("_obs").alias("_o"))
    upper = F.col("_left") * F.col("_right") + F.col("_minus")
    all_patterns = F.col("_left") * F.col("_right")
    p = F.when(F.col("_o") - 1e-12 <= 0, F.lit(1.0)).otherwise(2 * upper / all_patterns)
    tested = hits.select(*keys, p.alias("_p"), F.lit(None).cast("string").alias("_why"))
    if on_grid is not None:
        tested = tested.unionByName(on_grid.select(*tested.columns))
    everyone = values.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_values"))
    out = join_on(join_on(everyone, sizes, keys, "left"), tested, keys, "left")
    zero = F.lit(0).cast("bigint")
    return out.select(
        *keys, "n_values", F.coalesce("n_positive", zero).alias("n_positive"),
        F.coalesce("n_negative", zero).alias("n_negative"),
        F.when(F.col("_why").isNull(), F.coalesce("_p", F.lit(1.0))).alias("p_value"),
        F.coalesce("_why", F.lit("exact")).alias("status"))


def sign_flip_sampled(
    values: DataFrame, keys: list[str], value: str, order: str, n_draws: int = N_BOOTSTRAP, seed: int = SEED,
) -> DataFrame:
    """Sign-flip test by random signs, for any number of values; (hits + 1) / (draws + 1).

    A draw's sign of a value depends on (seed, draw, key, order) alone. Sums combine map-side, in
    blocks of draws, so neither a key nor a draw sits in one task.
    """
    nonzero = values.where(F.col(value) != 0)
    flips = F.transform(
        F.sequence(F.lit(0), F.lit(n_draws - 1)),
        lambda r: F.when(F.xxhash64(F.lit(seed), r, *[F.col(k) for k in keys], F.col(order)) % 2 == 0, F.col(value))
        .otherwise(-F.col(value)))
    sums = nonzero.select(*keys, F.posexplode(flips).alias("_draw", "_signed")).groupBy(*keys, "_draw").agg(
        F.abs(F.sum("_signed")).alias("_sum"))
    observed = nonzero.groupBy(*keys).agg(F.abs(F.sum(value)).alias("_obs"))
    hits = join_on(sums, observed, keys).groupBy(*keys).agg(
        F.count_if(F.col("_sum") >= F.col("_obs") - F.lit(1e-12)).alias("_hits"))
    everyone = values.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_values"))
    p = (F.col("_hits") + 1) / F.lit(n_draws + 1.0)
    return join_on(everyone, hits, keys, "left").select(*keys, "n_values", F.coalesce(p, F.lit(1.0)).alias("p_value"))


# --- families of tests ------------------------------------------------------------------------

def bonferroni(tests: DataFrame, p: str = "p_value", alpha: float = 0.05) -> DataFrame:
    family = tests.agg(F.count(p).alias("_m"))
    adjusted = F.least(F.lit(1.0), F.col(p) * F.col("_m"))
    return tests.crossJoin(F.broadcast(family)).withColumn("p_bonferroni", adjusted).withColumn(
        "significant", F.coalesce(F.col(p) * F.col("_m") < alpha, F.lit(False))
    ).withColumn("significant_raw", F.coalesce(F.col(p) < alpha, F.lit(False))).drop("_m")


def holm(tests: DataFrame, family: list[str], p: str = "p_value", tie: list[str] | None = None) -> DataFrame:
    """Step-down adjustment within each family; the window orders one row per test."""
    per = Window.partitionBy(*family)
    ordered = per.orderBy(p, *(tie or []))
    m, rank = F.count(p).over(per), F.row_number().over(ordered)
    step = F.least(F.lit(1.0), (m - rank + 1) * F.col(p))
    return tests.withColumn("_step", step).withColumn(
        "p_holm", F.max("_step").over(ordered.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    ).drop("_step")


def profile_repeatability(profiles: DataFrame, keys: list[str], run: str, feature: str, value: str,
                          block: int = 512) -> DataFrame:
    """Smallest and largest cosine between repeated profiles of the same window.

    A run's profile becomes one unit vector (as pairs of feature and value). Runs lie in blocks of at
    most ``block`` per key, and every pair of blocks is one row of work: a block product of the Gram
    matrix, of which only the number, minimum and maximum of the cosines go on. Runs with a feature in
    common make a pair; a profile that is zero throughout has no cosine.
    """
    squares = profiles.groupBy(*keys, run).agg(F.sum(F.col(value) * F.col(value)).alias("_sq"))
    units = join_on(profiles, squares, [*keys, run]).groupBy(*keys, run).agg(F.collect_list(F.struct(
        F.xxhash64(F.col(feature)).alias("f"), F.try_divide(F.col(value), F.sqrt("_sq")).alias("x"))).alias("_vector"))
    sizes = squares.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / F.lit(block)).alias("_blocks"))
    dealt = join_on(units, sizes, keys).withColumn("_block", F.pmod(F.xxhash64(F.col(run)), F.col("_blocks")))
    blocks = materialize(dealt.groupBy(*keys, "_block").agg(F.collect_list("_vector").alias("_runs")), "run-blocks")
    numbers = blocks.select(*keys, "_block")
    partners = numbers.withColumnRenamed("_block", "_other")
    pairs = spread(join_on(numbers, partners, keys).where(F.col("_block") <= F.col("_other")), *keys, "_block", "_other")
    left = join_on(pairs, blocks, [*keys, "_block"])
    right = blocks.withColumnRenamed("_block", "_other").withColumnRenamed("_runs", "_runs2")
    met = join_on(left, right, [*keys, "_other"])
    fields = {f.name: f.dataType.simpleString() for f in met.schema.fields}
    ddl = "".join(f"`{k}` {fields[k]}, " for k in keys) + "_n long, _low double, _high double"

    def cosines(batches):
        for batch in batches:
            found = []
            for own, other, twin in zip(*(c.to_pylist() for c in batch.columns[len(keys):])):
                names = {f: i for i, f in enumerate(sorted({x["f"] for runs in (own, other) for r in runs for x in r}))}
                matrices = []
                for runs in (own, other):
                    m, there = np.zeros((len(runs), len(names))), np.zeros((len(runs), len(names)))
                    for i, r in enumerate(runs):
                        for x in r:
                            m[i, names[x["f"]]] += np.nan if x["x"] is None else x["x"]
                            there[i, names[x["f"]]] = 1
                    matrices.append((m, there))
                (m, here), (n, there) = matrices
                pick = (here @ there.T) > 0
                if twin:
                    pick &= np.triu(np.ones(pick.shape, bool), 1)
                cos = (m @ n.T)[pick]
                known = cos[~np.isnan(cos)]
                found.append((len(cos), float(known.min()) if len(known) else None, float(known.max()) if len(known) else None))
            measures = [pa.array(c, t) for c, t in zip(zip(*found), (pa.int64(), pa.float64(), pa.float64()))]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keys)], *measures], names=[*keys, "_n", "_low", "_high"])

    each = met.select(*keys, "_runs", "_runs2", (F.col("_block") == F.col("_other")).alias("_same")).mapInArrow(cosines, ddl)
    return each.groupBy(*keys).agg(
        F.sum("_n").alias("n_pairs"), F.min("_low").alias("min_cosine"), F.max("_high").alias("max_cosine")
    ).where("n_pairs > 0")
