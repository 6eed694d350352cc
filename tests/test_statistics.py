"""Tests, intervals and resampling against brute force and published values."""

import collections
import datetime
import itertools
import math
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import rows
from gapspark import registry
from gapspark.functions import special as sp
from gapspark.operators import experiments as ex
from gapspark.operators import hypotheses as hy
from gapspark.operators import ordered
from gapspark.operators import periodicity as pe
from gapspark.plans import condition_battery


def value(spark, column):
    return spark.range(1).select(column).first()[0]


@pytest.mark.parametrize("z", [-8.0, -2.5, -0.3, 0.0, 0.7, 1.959963984540054, 3.3, 7.5, 12.0, 38.0])
def test_normal_tail(spark, z):
    assert value(spark, sp.normal_upper_tail(F.lit(z))) == pytest.approx(0.5 * math.erfc(z / math.sqrt(2)), rel=1e-7, abs=1e-300)


@pytest.mark.parametrize("x, df, want", [
    (3.841459, 1, 0.05), (5.991465, 2, 0.05), (7.814728, 3, 0.05), (12.591587, 6, 0.05), (35.172462, 23, 0.05), (0.0, 4, 1.0)])
def test_chi2_tail(spark, x, df, want):
    assert value(spark, sp.chi2_upper_tail(F.lit(x), F.lit(df))) == pytest.approx(want, abs=1e-6)


@pytest.mark.parametrize("t, df, want", [(12.7062, 1, 0.05), (4.30265, 2, 0.05), (2.228139, 10, 0.05), (2.131450, 15, 0.05), (1.0, 1, 0.5)])
def test_student_tail(spark, t, df, want):
    assert value(spark, sp.student_two_sided(F.lit(t), F.lit(df))) == pytest.approx(want, abs=1e-5)


@pytest.mark.parametrize("n", [0, 1, 5, 15, 16, 40, 1000, 10**7])
def test_ln_factorial(spark, n):
    assert value(spark, sp.ln_factorial(F.lit(n))) == pytest.approx(math.lgamma(n + 1), rel=1e-12, abs=1e-12)


@pytest.mark.parametrize("k, n, lo, hi", [(0, 10, 0.0, 0.2775), (10, 10, 0.7225, 1.0), (0, 0, 0.0, 1.0)])
def test_wilson(spark, k, n, lo, hi):
    a, b = sp.wilson_clipped(F.lit(k), F.lit(n))
    got = spark.range(1).select(a, b).first()
    assert tuple(got) == pytest.approx((lo, hi), abs=1e-3)


def pairs(spark, base, prop, key="c"):
    return spark.createDataFrame(
        [(key, "baseline", float(x)) for x in base] + [(key, "proposed", float(x)) for x in prop],
        "c STRING, system STRING, value DOUBLE")


def brute_u(a, b):
    return sum(1.0 if x > y else 0.5 if x == y else 0.0 for x in a for y in b)


def test_mann_whitney_exact_without_ties(spark):
    a, b = [1.0, 4.0, 6.5, 9.0], [2.0, 3.0, 5.0, 7.0, 8.0]
    r = hy.mann_whitney(pairs(spark, a, b), ["c"]).first()
    u = brute_u(a, b)
    everything = a + b
    us = [brute_u(list(c), [x for x in everything if x not in c]) for c in itertools.combinations(everything, len(a))]
    top = max(u, len(a) * len(b) - u)
    assert r.U == u and r.effect_size_r == pytest.approx(1 - 2 * u / 20)
    assert r.p_value == pytest.approx(min(1.0, 2 * sum(x >= top for x in us) / len(us)))


def test_mann_whitney_asymptotic_with_ties(spark):
    rng = random.Random(1)
    a, b = [float(rng.randrange(6)) for _ in range(40)], [float(rng.randrange(1, 8)) for _ in range(30)]
    r = hy.mann_whitney(pairs(spark, a, b), ["c"]).first()
    n1, n2, u = 40, 30, brute_u(a, b)
    ties = sum(t**3 - t for t in (sum(x == v for x in a + b) for v in set(a + b)))
    s = math.sqrt(n1 * n2 / 12 * ((n1 + n2 + 1) - ties / ((n1 + n2) * (n1 + n2 - 1))))
    z = (max(u, n1 * n2 - u) - n1 * n2 / 2 - 0.5) / s
    assert r.U == u and r.p_value == pytest.approx(math.erfc(z / math.sqrt(2)), rel=1e-9)


def test_mann_whitney_degenerate(spark):
    few = hy.mann_whitney(pairs(spark, [1.0], [2.0, 3.0]), ["c"]).first()
    flat = hy.mann_whitney(pairs(spark, [2.0, 2.0], [2.0, 2.0]), ["c"]).first()
    assert (few.U, few.p_value, few.effect_size_r) == (None, None, None)
    assert (flat.U, flat.p_value, flat.effect_size_r) == (None, 1.0, 0.0)


def fisher_p(a, n1, c, n2):
    k, total = a + c, math.comb(n1 + n2, a + c)
    probs = {x: math.comb(n1, x) * math.comb(n2, k - x) / total for x in range(max(0, k - n2), min(n1, k) + 1)}
    return sum(p for p in probs.values() if p <= probs[a] * (1 + 1e-7))


@pytest.mark.parametrize("a, n1, c, n2", [(8, 10, 1, 11), (0, 5, 0, 5), (3, 7, 3, 7), (60, 100, 40, 90), (5, 5, 0, 5)])
def test_fisher(spark, a, n1, c, n2):
    t = spark.createDataFrame([("x", a, n1, c, n2)], "k STRING, baseline_loss_count BIGINT, n_baseline BIGINT, proposed_loss_count BIGINT, n_proposed BIGINT")
    r = hy.fisher_exact(t, ["k"]).first()
    assert r.p_value == pytest.approx(fisher_p(a, n1, c, n2), rel=1e-9)
    odds = a * (n2 - c) / ((n1 - a) * c) if (n1 - a) * c else None
    assert r.odds_ratio == (None if odds is None else pytest.approx(odds))


def levels(spark, xs, n=20):
    return spark.createDataFrame([("p", 10 ** i, n, x) for i, x in enumerate(xs)], "k STRING, dose INT, n BIGINT, x BIGINT")


def test_trend(spark):
    rising = hy.cochran_armitage(levels(spark, [0, 1, 3, 8, 15]), ["k"], "dose").first()
    flat = hy.cochran_armitage(levels(spark, [0, 0, 0, 0, 0]), ["k"], "dose").first()
    two = hy.cochran_armitage(levels(spark, [0, 5]), ["k"], "dose").first()
    assert rising.z_statistic > 0 and rising.p_increasing < 0.05
    assert (flat.z_statistic, flat.p_two_sided) == (0.0, 1.0)
    assert (two.z_statistic, two.p_two_sided, two.n_levels) == (None, None, 2)


def groups(spark, data):
    return spark.createDataFrame([("k", g, float(v)) for g, vs in data.items() for v in vs], "k STRING, g STRING, value DOUBLE")


def test_kruskal(spark):
    r = hy.kruskal_wallis(groups(spark, {"a": [1, 2, 3], "b": [4, 5, 6], "c": [7, 8, 9]}), ["k"], "g").first()
    assert r.H_statistic == pytest.approx(7.2) and r.p_value == pytest.approx(math.exp(-3.6))
    same = hy.kruskal_wallis(groups(spark, {"a": [1, 1], "b": [1]}), ["k"], "g").first()
    one = hy.kruskal_wallis(groups(spark, {"a": [1, 2]}), ["k"], "g").first()
    assert (same.H_statistic, same.p_value, one.H_statistic, one.p_value) == (0.0, 1.0, None, None)


def test_sign_flip_matches_enumeration(spark):
    rng = random.Random(4)
    sets = {"odd": [rng.gauss(0.4, 1) for _ in range(9)], "even": [rng.choice([-1.0, 0.0, 1.0, 2.0]) for _ in range(8)],
            "zeros": [0.0, 0.0], "one": [0.7]}
    df = spark.createDataFrame([(k, i, v) for k, vs in sets.items() for i, v in enumerate(vs)], "k STRING, i INT, v DOUBLE")
    for r in hy.sign_flip_exact(df, ["k"], "v", "i").collect():
        nz = [abs(v) for v in sets[r.k] if v]
        obs = abs(sum(sets[r.k]))
        hits = sum(abs(sum(s * v for s, v in zip(signs, nz))) >= obs - 1e-12 for signs in itertools.product((-1, 1), repeat=len(nz)))
        assert r.p_value == pytest.approx(hits / 2 ** len(nz))
        assert (r.n_values, r.n_positive) == (len(sets[r.k]), sum(v > 0 for v in sets[r.k]))


def test_sign_flip_handles_many_batches_exactly(spark):
    df = spark.createDataFrame([("k", i, 1.0 if i % 4 else -1.0) for i in range(24)], "k STRING, i INT, v DOUBLE")
    obs = 12
    want = sum(math.comb(24, j) for j in range(25) if abs(24 - 2 * j) >= obs) / 2**24
    assert hy.sign_flip_exact(df, ["k"], "v", "i").first().p_value == pytest.approx(want)


@pytest.mark.parametrize("n1, n2", [(2, 3), (4, 4), (8, 9), (3, 12)])
def test_exact_rank_sums_match_enumeration(n1, n2):
    places = range(n1 + n2)
    us = [sum(c) - n1 * (n1 - 1) // 2 for c in itertools.combinations(places, n1)]
    for u in set(us):
        far = max(u, n1 * n2 - u)
        want = min(1.0, 2 * sum(x >= far for x in us) / len(us))
        assert hy._exact_rank_sum_p(n1, n2, float(u), {}) == pytest.approx(want)


def test_exact_rank_sum_of_a_huge_side_needs_no_array():
    n, m = 10**9, 8
    p = hy._exact_rank_sum_p(m, n, m * n / 2 + 1.5 * math.sqrt(m * n * (m + n + 1) / 12), {})
    assert 0.12 < p < 0.15


def test_many_values_of_one_key_do_not_stop_the_others(spark):
    data = [("big", i, 1.0 if i % 3 else -1.0) for i in range(60)] + [("small", i, 1.0) for i in range(6)]
    df = spark.createDataFrame(data, "k STRING, i INT, v DOUBLE")
    got = {r.k: r for r in hy.sign_flip_exact(df, ["k"], "v", "i").collect()}
    want = sum(math.comb(60, j) for j in range(61) if abs(60 - 2 * j) >= 20) / 2**60
    assert (got["big"].p_value, got["big"].status, got["big"].n_positive) == (pytest.approx(want), "exact", 40)
    assert (got["small"].p_value, got["small"].status) == (pytest.approx(2 / 64), "exact")
    sampled = {r.k: r.p_value for r in hy.sign_flip_sampled(df, ["k"], "v", "i", 2000).collect()}
    assert sampled["big"] == pytest.approx(want, abs=0.01) and sampled["small"] == pytest.approx(2 / 64, abs=0.02)


def test_sign_flip_on_a_grid_equals_listing(spark):
    rng = random.Random(6)
    sets = {"whole": [rng.randint(-9, 9) for _ in range(14)], "means": [rng.randint(-400, 400) / 500 for _ in range(15)],
            "zeros": [0.0] * 5, "even": [1.5, -1.5]}
    df = spark.createDataFrame([(k, i, float(v)) for k, vs in sets.items() for i, v in enumerate(vs)], "k STRING, i INT, v DOUBLE")
    listed = {r.k: r for r in hy.sign_flip_exact(df, ["k"], "v", "i").collect()}
    on_grid = {r.k: r for r in hy.sign_flip_exact(df, ["k"], "v", "i", listable=1).collect()}
    for k in sets:
        assert on_grid[k].p_value == pytest.approx(listed[k].p_value) and on_grid[k].status == listed[k].status == "exact"
    off = [("odd", i, math.sqrt(i + 2)) for i in range(50)] + [("fine", i, 10.0**6 + i + 0.000001) for i in range(50)]
    out = hy.sign_flip_exact(spark.createDataFrame(off, "k STRING, i INT, v DOUBLE"), ["k"], "v", "i").collect()
    assert {(r.k, r.p_value, r.status) for r in out} == {("odd", None, "off_grid"), ("fine", None, "grid_too_fine")}


@pytest.mark.parametrize("largest, states", [(1, 0), (9, 0), (9, 8), (400, 0), (400, 1 << 16)])
def test_sums_over_frequencies_equal_counted_patterns(largest, states):
    rng = random.Random(largest)
    for case in range(12):
        values = [rng.choice((-1, 1, 1, 1)[: 2 + case % 3]) * rng.randint(1, largest) for _ in range(rng.randint(2, 60))]
        values += [10**6 + case, 10**6][: case % 4]
        patterns = {0: 1}
        for v in values:
            patterns = dict(sum((collections.Counter({t + f: n for t, n in patterns.items()}) for f in (0, abs(v))), collections.Counter()))
        total, observed = sum(map(abs, values)), abs(sum(values))
        want = sum(n for t, n in patterns.items() if abs(total - 2 * t) >= observed) / 2 ** len(values)
        steps = collections.Counter(map(abs, values))
        p, tilt, cells, *rest = hy._grid_plan(np.array([*steps]), np.array([*steps.values()]), observed, states)
        if cells:
            rest, third = [np.asarray(x) for x in rest], cells // 6
            p += hy._grid_part(1, third, tilt, cells, *rest) if third else 0.0
            p += hy._grid_part(third + 1, cells // 2, tilt, cells, *rest)
        assert min(1.0, p) == pytest.approx(want, rel=1e-11)


def test_sign_flip_on_a_large_grid_is_exact(spark):
    rng = random.Random(8)
    sets = {None: [rng.randint(10**5, 2 * 10**5) * (1 if i % 3 else -1) for i in range(52)],
            "few totals": [10.0**6 * rng.choice([-1, 1, 1]) for _ in range(60)],
            "one far off": [10**12, *[rng.choice([-2, -1, 1, 2]) for _ in range(50)]],
            "one sign": [rng.randint(10**7, 10**8) for _ in range(49)]}
    df = spark.createDataFrame([(k, i, float(v)) for k, vs in sets.items() for i, v in enumerate(vs)], "k STRING, i INT, v DOUBLE")
    got = {r.k: r for r in hy.sign_flip_exact(df, ["k"], "v", "i", finest=hy.WHOLE_CELLS).collect()}
    assert {r.status for r in got.values()} == {"exact"}

    def dense(values):
        return hy._grid_p(np.array([abs(v) for v in values], np.int64), np.ones(len(values), np.int64), int(sum(values)))

    assert sum(map(abs, sets[None])) > hy.GRID_CELLS
    assert got[None].p_value == pytest.approx(dense(sets[None]), rel=1e-10)
    assert got["few totals"].p_value == pytest.approx(dense([v // 10**6 for v in sets["few totals"]]), rel=1e-10)
    assert got["one far off"].p_value == pytest.approx(dense([200, *sets["one far off"][1:]]), rel=1e-10)
    assert got["one sign"].p_value == pytest.approx(2.0**-48, rel=1e-10)


def test_the_many_batches_query_tests_every_flag(spark, tmp_path):
    rng = random.Random(9)
    months = [datetime.datetime(1992 + i // 12, 1 + i % 12, 3) for i in range(60)]
    quantity = {"A": lambda: 100_003.0 * rng.randint(1, 9), "N": lambda: rng.randint(1, 9) / 7, "R": lambda: float(rng.randint(1, 50))}
    lines = [(flag, m, rng.randint(1, 3), q()) for flag, q in quantity.items() for m in months for _ in range(2)]
    lines.append(("R", datetime.datetime(1998, 1, 1), 2, 10.0**11))
    spark.createDataFrame(lines, "l_returnflag STRING, l_shipdate TIMESTAMP, l_linenumber INT, l_quantity DOUBLE").coalesce(1).write.parquet(
        f"{tmp_path}/lineitem.parquet")
    entry = registry.entries()["sign_flip_many_batches"]
    con = duckdb.connect()
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM read_parquet('{tmp_path}/lineitem.parquet/*.parquet')")
    want = sorted(con.execute(entry.oracle).fetchall())
    got = sorted(rows(entry.run(spark, str(tmp_path))))
    assert [r[:4] + r[5:] for r in got] == [r[:4] + r[5:] for r in want] and len(got) == 3
    assert [r[4] for r in got] == pytest.approx([r[4] for r in want], abs=2e-6)


@pytest.mark.parametrize("block", [512, 3])
def test_profile_cosines_match_plain_pairs(spark, block):
    rng = random.Random(3)
    data = [(k, r, f, rng.random()) for k in "ab" for r in range(11) for f in range(6) if rng.random() < 0.8]
    data += [("z", 1, 0, 0.0), ("z", 2, 0, 1.0), ("one", 1, 0, 1.0), ("apart", 1, 0, 1.0), ("apart", 2, 1, 1.0)]
    out = hy.profile_repeatability(spark.createDataFrame(data, "k STRING, run INT, f INT, v DOUBLE"), ["k"], "run", "f", "v", block).collect()
    got = {r.k: (r.n_pairs, r.min_cosine, r.max_cosine) for r in out}
    runs = {}
    for k, r, f, v in data:
        runs.setdefault(k, {}).setdefault(r, {})[f] = v
    for k in "ab":
        cos = []
        for x, y in itertools.combinations(runs[k].values(), 2):
            if x.keys() & y.keys():
                cos.append(sum(x[f] * y[f] for f in x.keys() & y.keys()) / math.sqrt(sum(v * v for v in x.values()) * sum(v * v for v in y.values())))
        assert got[k] == (len(cos), pytest.approx(min(cos)), pytest.approx(max(cos)))
    assert got["z"] == (1, None, None) and "one" not in got and "apart" not in got


@pytest.mark.parametrize("df, x, want", [(2000, 2000.0, 0.4957949), (2001, 2001.0, 0.4957960), (1, 3.841458820694124, 0.05),
                                         (2, 5.991464547107979, 0.05), (9, 16.91897760462045, 0.05), (5, 0.0, 1.0)])
def test_chi_square_tail_for_few_and_many_degrees(spark, df, x, want):
    p = sp.chi2_upper_tail(F.lit(x), F.lit(df))
    assert spark.range(1).select(p.alias("p")).first().p == pytest.approx(want, abs=1e-6)


def test_student_tail_for_many_degrees(spark):
    p = lambda t, df: spark.range(1).select(sp.student_two_sided(F.lit(t), F.lit(df)).alias("p")).first().p
    assert p(1.96, 5_000_000_000) == pytest.approx(0.04999579, abs=1e-7)
    assert p(2.0, 1000) == pytest.approx(p(2.0, 1001), abs=1e-5)


def test_buckets_fit_after_as_many_rounds_as_needed(spark, monkeypatch):
    monkeypatch.setattr(ordered, "SPLIT", 3)
    monkeypatch.setattr(ordered, "BUCKET_ABOVE", 7)
    df = spark.range(1000).select((F.col("id") % 3 == 0).alias("k"), (F.col("id") * F.col("id") % 997).alias("v"))
    counts = ordered.value_counts(df, ["k"], "v")
    placed = ordered.quantile_bucket(counts, ["k"], "v").collect()
    sizes, paths = {}, {}
    for r in placed:
        sizes[r.k, tuple(r["_bucket"])] = sizes.get((r.k, tuple(r["_bucket"])), 0) + 1
        paths.setdefault(r.k, []).append((r.v, tuple(r["_bucket"])))
    assert max(sizes.values()) <= 7 and max(len(p) for _, p in sizes) >= 4  # many rounds
    for own in paths.values():
        own.sort()
        assert [p for _, p in own] == sorted(p for _, p in own)
    q = {r.k: (r.a, r.b) for r in ordered.quantiles(df, ["k"], "v", {"a": 0.5, "b": 0.95}).collect()}
    values = {k: sorted(r.v for r in df.collect() if r.k == k) for k in (True, False)}
    assert q == {k: tuple(np.quantile(v, [0.5, 0.95])) for k, v in values.items()}
    heavy = spark.range(500).select(F.lit(1).alias("k"), F.lit(2.0).alias("v"))  # one value cannot be split
    assert ordered.quantile_bucket(heavy, ["k"], "v").select("_bucket").distinct().count() == 1


def test_holm_and_bonferroni(spark):
    df = spark.createDataFrame([("f", "a", 0.01), ("f", "b", 0.04), ("f", "c", 0.03)], "f STRING, t STRING, p_value DOUBLE")
    assert {r.t: r.p_holm for r in hy.holm(df, ["f"]).collect()} == pytest.approx({"a": 0.03, "c": 0.06, "b": 0.06})
    assert {r.t: (r.p_bonferroni, r.significant) for r in hy.bonferroni(df).collect()} == {
        "a": (pytest.approx(0.03), True), "b": (pytest.approx(0.12), False), "c": (pytest.approx(0.09), False)}


def test_bootstrap_agrees_with_plain_resampling_and_ignores_partitioning(spark):
    rng = random.Random(8)
    data = {"many_values": [rng.gauss(5, 2) for _ in range(300)], "few_values": [float(rng.randrange(3)) for _ in range(200)], "single": [1.0]}
    df = spark.createDataFrame([(k, v) for k, vs in data.items() for v in vs], "k STRING, value DOUBLE")
    out = {r.k: r for r in hy.bootstrap_ci(df, ["k"], n_bootstrap=4000, cell_block=64).collect()}
    again = {r.k: r for r in hy.bootstrap_ci(df.repartition(7), ["k"], n_bootstrap=4000, cell_block=64).collect()}
    for k, r in out.items():
        assert list(again[k])[2:] == pytest.approx(list(r)[2:], rel=1e-12) if r.lower is not None else again[k] == r
    assert (out["single"].lower, out["single"].mean) == (None, None)
    gen = np.random.default_rng(0)
    for k in ("many_values", "few_values"):
        v = np.array(data[k])
        means = gen.choice(v, (4000, len(v))).mean(axis=1)
        half = 4 * v.std() / math.sqrt(len(v)) / math.sqrt(4000) * 3
        assert out[k].mean == pytest.approx(v.mean())
        assert out[k].lower == pytest.approx(np.percentile(means, 2.5), abs=half)
        assert out[k].upper == pytest.approx(np.percentile(means, 97.5), abs=half)


def test_bootstrap_deals_draws_down_a_tree_of_any_depth(spark):
    rng = random.Random(5)
    wide = [("wide", rng.gauss(5, 2)) for _ in range(700)]
    other = [("other", float(v)) for v in range(30)]
    schema = "k STRING, value DOUBLE"
    run = lambda rows: {r.k: r for r in hy.bootstrap_ci(
        spark.createDataFrame(rows, schema), ["k"], n_bootstrap=2000, cell_block=2, rep_block=300, fanout=4).collect()}
    both, alone = run(wide + other), run(other)
    assert list(both["other"])[2:] == pytest.approx(list(alone["other"])[2:], rel=1e-12)  # deeper trees of other keys change nothing
    v = np.array([x for _, x in wide])
    error = v.std() / math.sqrt(len(v))
    assert both["wide"].lower == pytest.approx(v.mean() - 1.96 * error, abs=0.2 * error)
    assert both["wide"].upper == pytest.approx(v.mean() + 1.96 * error, abs=0.2 * error)
    assert hy.bootstrap_ci(spark.createDataFrame([], schema), ["k"], n_bootstrap=100).collect() == []


def test_spearman(spark):
    df = spark.createDataFrame([("k", float(i), float(v)) for i, v in enumerate([2, 1, 4, 3, 5, 7, 6, 8])], "k STRING, x DOUBLE, y DOUBLE")
    r = hy.spearman(df, ["k"], "x", "y").first()
    assert r.rho == pytest.approx(1 - 6 * 6 / (8 * 63)) and 0 < r.p_value < 0.01


def test_condition_rules(spark):
    schema = ("batch STRING, pattern STRING, rps INT, trial INT, baseline_loss DOUBLE, proposed_loss DOUBLE, baseline_verification_failed BOOLEAN, "
              "proposed_verification_failed BOOLEAN, baseline_cpu_peak DOUBLE, proposed_cpu_peak DOUBLE, baseline_mem_peak DOUBLE, proposed_mem_peak DOUBLE")
    t = spark.createDataFrame([("b", "p", 1, 1, 50.0, 0.0, False, False, 1.0, 1.0, 1.0, 1.0), ("b", "p", 1, 2, 100.0, 0.0, True, False, 3.0, 1.0, 1.0, 1.0)], schema)
    got = {(r.system, r.metric): r for r in ex.condition_summary(ex.long_trials(t)).collect()}
    loss, cpu = got["baseline", "loss_rate"], got["baseline", "cpu_peak"]
    assert (loss["mean"], loss["std"], loss.n, loss.n_trials, loss.n_verification_failed) == (50.0, 0.0, 1, 2, 1)
    assert (cpu["mean"], cpu.n) == (2.0, 2)
    assert ex.paired_differences(t).count() == 1
    battery = condition_battery.condition_battery(t, n_bootstrap=200)
    assert {r.metric for r in battery.collect()} == {"loss_rate", "cpu_peak", "mem_peak"}


def test_resource_totals_and_stats(spark):
    schema = "file STRING, timestamp STRING, container STRING, cpu_percent STRING, mem_usage STRING, mem_percent STRING"
    a = [("f", t, c, str(v), "1MiB / 2MiB", "5") for t, c, v in (("t1", "proposed-a", 10), ("t1", "proposed-b", 20), ("t2", "proposed-a", 30), ("t2", "proposed-b", 40))]
    r = ex.resource_totals(spark.createDataFrame(a + [("f", "t1", "other", "99", "9GiB / 9GiB", "1")], schema), "proposed-").first()
    assert (r.n_timestamps, r.cpu_mean, r.cpu_median) == (2, 50.0, 50.0)
    two = ex.resource_totals(spark.createDataFrame([("f", "t", "proposed-a", "10", "1MiB / 1", "1"), ("g", "t", "proposed-a", "30", "1MiB / 1", "1")], schema), "proposed-").first()
    assert (two.n_timestamps, two.cpu_mean) == (2, 20.0)
    bad = spark.createDataFrame([("f", "t", "proposed-a", "10", "1MiB / 1", "n/a")], schema)
    assert ex.resource_stats(bad, ["file"], "proposed-").count() == 0


# --- periodicity --------------------------------------------------------------------------------

def daily(spark, data):
    return spark.createDataFrame([(d, c) for d, c in data], "day STRING, total_count BIGINT").withColumn("day", F.to_date("day"))


def test_weekday_and_phase_groups(spark):
    wd = {r.label: (r.n_days, r.total) for r in pe.by_weekday(daily(spark, [("2026-07-01", 100), ("2026-07-06", 200), ("2026-07-08", 300)])).collect()}
    assert wd == {"Mon": (1, 200), "Tue": (0, 0), "Wed": (2, 400), "Thu": (0, 0), "Fri": (0, 0), "Sat": (0, 0), "Sun": (0, 0)}
    ph = {r.phase: (r.n_days, r.total) for r in pe.by_cycle_phase(daily(spark, [("2026-07-01", 100), ("2026-07-02", 200), ("2026-07-25", 300)])).collect()}
    assert len(ph) == 24 and ph[0] == (2, 400) and ph[1] == (1, 200) and ph[5] == (0, 0)


def test_zero_counts_are_reported_not_imputed(spark):
    got = {str(r.day): (r.y, r.log_violation) for r in pe.log_series(daily(spark, [("2026-07-01", 0), ("2026-07-02", 1)])).collect()}
    assert got == {"2026-07-01": (None, True), "2026-07-02": (0.0, False)}


def test_rolling_median_matches_definition(spark):
    rng = random.Random(2)
    y = [rng.random() for _ in range(40)]
    s = spark.createDataFrame([("v", i, v) for i, v in enumerate(y)], "variant STRING, idx BIGINT, y DOUBLE")
    got = {r.idx: r.resid for r in pe.rolling_median_detrend(s, ["variant"]).collect()}
    for i, v in enumerate(y):
        h = min(7, i, len(y) - 1 - i)
        assert got[i] == pytest.approx(v - np.median(y[i - h:i + h + 1]))


def test_weekly_signal_is_found_and_noise_is_not(spark):
    rng = np.random.default_rng(1)
    n = 70
    noise = rng.normal(0, 0.1, n)
    series = {"weekly": np.sin(2 * np.pi * np.arange(n) / 7) + noise, "noise": noise}
    rows_ = [(k, i, i % 7, float(v)) for k, vs in series.items() for i, v in enumerate(vs)]
    resid = spark.createDataFrame(rows_, "variant STRING, idx BIGINT, weekday INT, resid DOUBLE")
    arrays = pe.as_arrays(resid, ["variant"])
    kw = {r.variant: r for r in pe.weekday_permutation_test(arrays, ["variant"], n_perm=300).collect()}
    pt = {r.variant: r for r in pe.periodicity_test(arrays, ["variant"], {"7d": (7.0, 0.5)}, n_perm=300, fits=pe.ar1_fit(resid, ["variant"])).collect()}
    assert kw["weekly"].p == pytest.approx(1 / 301) and kw["weekly"].eps2 > 0.5 and kw["noise"].p > 0.01
    assert pt["weekly"].p_7d == pytest.approx(1 / 301) and pt["noise"].p_7d > 0.01
    assert all(1 / 301 <= r.p_7d <= 1 for r in pt.values()) and 0.9 < pt["weekly"].power_7d <= 1


def test_permutations_keep_the_values(spark):
    resid = spark.createDataFrame([("v", i, i % 7, float(i)) for i in range(20)], "variant STRING, idx BIGINT, weekday INT, resid DOUBLE")
    p = pe.permutations(pe.as_arrays(resid, ["variant"]), ["variant"], n_perm=50)
    got = rows(p.select("perm", F.array_sort("resid"), "resid"))
    assert len(got) == 50 and all(r[1] == [float(i) for i in range(20)] for r in got)
    assert len({tuple(r[2]) for r in got}) == 50


def test_trailing_mean_of_a_long_run(spark, monkeypatch):
    from gapspark.operators import drift

    monkeypatch.setattr(drift, "RANGE", 16)
    rng = random.Random(2)
    data = [("long", b, rng.random()) for b in range(300) if b % 11] + [("short", b, rng.random()) for b in range(3)]
    out = drift.monitor_absolute(spark.createDataFrame(data, "run STRING, block LONG, fidelity_score DOUBLE"), ["run"]).collect()
    assert len(out) == len(data)
    for run in ("long", "short"):
        own = sorted((b, v) for r, b, v in data if r == run)
        want = {b: sum(v for _, v in own[max(0, i - 4) : i + 1]) / len(own[max(0, i - 4) : i + 1]) for i, (b, _) in enumerate(own)}
        assert {r.block: r.moving_avg for r in out if r.run == run} == pytest.approx(want)


class NoMultinomial:
    """A generator whose draw per value and replicate, the slow one, is not to be used."""

    def __init__(self, seed):
        own = np.random.default_rng(seed)
        self.integers, self.random = own.integers, own.random


@pytest.mark.parametrize("copies", [1, 3, 20])
def test_resampled_sums_of_large_blocks_have_the_multinomial_distribution(copies):
    rng = np.random.default_rng(copies)
    weights = rng.integers(max(1, copies // 2), copies * 3 // 2 + 1, 2048)
    mass = int(weights.sum())
    own = rng.binomial(20 * mass, 1 / 20, 500)
    draw = lambda values, n: hy._resampled_sums(NoMultinomial(n), own, values, weights)
    assert (draw(np.ones(2048), 0) == own).all()  # every replicate has exactly its number of draws
    for share in (0.001, 0.2, 0.5):
        inside = (np.arange(2048) < max(2, int(2048 * share))).astype(float)
        p = float((inside * weights).sum() / mass)
        z = np.concatenate([(draw(inside, n) - own * p) / np.sqrt(own * p * (1 - p)) for n in range(8)])
        assert abs(z.mean()) < 5 / np.sqrt(len(z)) and abs(z.var() - 1) < 0.15


def test_resampled_sums_of_few_or_heavy_values_are_multinomial_draws():
    for weights in (np.arange(1, 100), np.full(600, 1000), np.arange(1, 601)):
        own, values = np.full(20, weights.sum()), np.arange(len(weights)) / 4
        got = hy._resampled_sums(np.random.default_rng(3), own, values, weights)
        assert (got == np.random.default_rng(3).multinomial(own, weights / weights.sum()) @ values).all()
