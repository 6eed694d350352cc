"""Registered queries: grouped statistical tests."""

from __future__ import annotations

from pyspark.sql import functions as F

from gapspark.catalog.experiments import LONG, PAIRS
from gapspark.functions import parsing
from gapspark.functions import special as sp
from gapspark.operators import experiments as ex
from gapspark.operators import hypotheses as hy
from gapspark.operators import intervals
from gapspark.operators.ordered import midranks, value_counts
from gapspark.plans import condition_battery as battery
from gapspark.registry import query
from gapspark.session import materialize
from gapspark.sources.driver_tables import load, view


def _horner(x: str, coefficients) -> str:
    out = repr(coefficients[0])
    for c in coefficients[1:]:
        out = f"({out} * {x} + {c!r})"
    return out


def tail_sql(z: str) -> str:
    """Upper normal tail for z >= 0 as SQL text."""
    near = f"exp(-{z} * {z} / 2) * {_horner(z, sp._HART_NUM)} / {_horner(z, sp._HART_DEN)}"
    far = f"exp(-{z} * {z} / 2) / ({z} + 1.0 / ({z} + 2.0 / ({z} + 3.0 / ({z} + 4.0 / ({z} + 0.65))))) / 2.506628274631"
    return f"(CASE WHEN {z} > 37 THEN 0.0 WHEN {z} < 7.07106781186547 THEN {near} ELSE {far} END)"


def _long(spark, d):
    return ex.long_trials(view(spark, d, "trials")).withColumn("value", ex.verified_value())


RANKS = """
rk AS (SELECT *, rank() OVER (PARTITION BY pattern, rps, metric ORDER BY x) + (count(*) OVER (PARTITION BY pattern, rps, metric, x) - 1) / 2 AS mr,
  count(*) OVER (PARTITION BY pattern, rps, metric, x) AS tie FROM v WHERE x IS NOT NULL)
"""


@query("mann_whitney", "T1 W9 T0", f"""
WITH {LONG}, {RANKS},
s AS (SELECT pattern, rps, metric, CAST(count(*) FILTER (WHERE system = 'baseline') AS DOUBLE) AS n1, CAST(count(*) FILTER (WHERE system = 'proposed') AS DOUBLE) AS n2,
  sum(mr) FILTER (WHERE system = 'baseline') AS r1, sum(CAST(tie AS DOUBLE) * tie - 1) AS ties FROM rk GROUP BY 1, 2, 3),
u AS (SELECT *, r1 - n1 * (n1 + 1) / 2 AS u1 FROM s),
z AS (SELECT *, (greatest(u1, n1 * n2 - u1) - n1 * n2 / 2 - 0.5) / sqrt(n1 * n2 / 12 * ((n1 + n2 + 1) - ties / ((n1 + n2) * (n1 + n2 - 1)))) AS z FROM u),
a AS (SELECT *, abs(z) AS az FROM z), t AS (SELECT *, {tail_sql('az')} AS tail FROM a)
SELECT pattern, CAST(rps AS BIGINT) AS rps, metric, CAST(n1 AS BIGINT) AS n_baseline, CAST(n2 AS BIGINT) AS n_proposed, round(u1, 6) AS "U",
  round(least(1, 2 * CASE WHEN z >= 0 THEN tail ELSE 1 - tail END), 6) AS p_value, round(1 - 2 * u1 / (n1 * n2), 6) AS effect_size_r FROM t""")
def _(spark, d):
    return hy.mann_whitney(_long(spark, d), [*ex.CONDITION, "metric"])


@query("midranks", "W9", f"""
WITH {LONG}, {RANKS} SELECT DISTINCT pattern, CAST(rps AS BIGINT) AS rps, metric, round(x, 6) AS value, tie AS n, round(mr, 6) AS midrank FROM rk""")
def _(spark, d):
    keys = [*ex.CONDITION, "metric"]
    return midranks(value_counts(_long(spark, d), keys, "value"), keys, "value")


OCC = """
oc AS (SELECT pattern, rps, count(*) FILTER (WHERE system = 'baseline' AND x > 0) AS a, count(*) FILTER (WHERE system = 'baseline') AS n1,
  count(*) FILTER (WHERE system = 'proposed' AND x > 0) AS c, count(*) FILTER (WHERE system = 'proposed') AS n2 FROM loss WHERE x IS NOT NULL GROUP BY 1, 2)
"""


@query("fisher_loss_occurrence", "T2 T0", f"""
WITH {LONG}, {OCC},
e AS (SELECT *, a + c AS k, unnest(generate_series(greatest(0, a + c - n2), least(n1, a + c))) AS xx FROM oc),
lb AS (SELECT *, lgamma(n1 + 1) + lgamma(n2 + 1) + lgamma(k + 1) + lgamma(n1 + n2 - k + 1) - lgamma(n1 + n2 + 1) AS base FROM e),
q AS (SELECT *, base - lgamma(xx + 1) - lgamma(n1 - xx + 1) - lgamma(k - xx + 1) - lgamma(n2 - k + xx + 1) AS lp,
  base - lgamma(a + 1) - lgamma(n1 - a + 1) - lgamma(c + 1) - lgamma(n2 - c + 1) AS lo FROM lb)
SELECT pattern, CAST(rps AS BIGINT) AS rps, a AS baseline_loss_count, n1 AS n_baseline, c AS proposed_loss_count, n2 AS n_proposed,
  round(a * (n2 - c) / nullif((n1 - a) * c, 0), 6) AS odds_ratio, round(least(1, sum(CASE WHEN lp <= lo + 1e-7 THEN exp(lp) END)), 6) AS p_value
FROM q GROUP BY pattern, rps, a, n1, c, n2""")
def _(spark, d):
    long = _long(spark, d).where("metric = 'loss_rate'")
    return hy.fisher_exact(hy.loss_occurrence(long, ex.CONDITION), ex.CONDITION)


def _trend_sql(key: str) -> str:
    return f"""
sc AS (SELECT *, CAST(row_number() OVER (PARTITION BY {key} ORDER BY dose) - 1 AS DOUBLE) AS t FROM lv WHERE n > 0),
b AS (SELECT {key}, count(*) AS n_levels, sum(x) / sum(n) AS pbar, sum(n * t) / sum(n) AS tbar FROM sc GROUP BY 1),
z AS (SELECT sc.{key}, any_value(n_levels) AS n_levels, sum(n * (x / n - pbar) * (t - tbar)) AS num,
  any_value(pbar) * (1 - any_value(pbar)) * sum(n * (t - tbar) * (t - tbar)) AS var FROM sc JOIN b ON sc.{key} = b.{key} GROUP BY 1),
y AS (SELECT *, num / sqrt(var) AS z, abs(num / sqrt(var)) AS az FROM z), w AS (SELECT *, {tail_sql('az')} AS tail FROM y)
SELECT {key}, n_levels, round(z, 6) AS z_statistic, round(2 * tail, 6) AS p_two_sided, round(CASE WHEN z >= 0 THEN tail ELSE 1 - tail END, 6) AS p_increasing FROM w"""


@query("trend_per_pattern", "T3 T3a", f"""
WITH {LONG}, lv AS (SELECT pattern, rps AS dose, count(*) AS n, count(*) FILTER (WHERE x > 0) AS x FROM loss WHERE system = 'baseline' AND x IS NOT NULL GROUP BY 1, 2),
{_trend_sql('pattern')}""")
def _(spark, d):
    return battery.trend_per_pattern(view(spark, d, "trials"))


@query("trend_per_edge_mode", "T3 T3b", f"""
WITH lv AS (SELECT edge_mode, edge_count AS dose, count(*) AS n, count(*) FILTER (WHERE loss_rate_percent > 0) AS x FROM edge_trials
  WHERE NOT verification_failed GROUP BY 1, 2), {_trend_sql('edge_mode')}""")
def _(spark, d):
    return battery.trend_per_edge_mode(view(spark, d, "edge_trials"))


CHI2_SQL = """
CASE WHEN h <= 0 THEN 1.0 WHEN dof % 2 = 0 THEN exp(-h / 2) * list_sum(list_transform(range(0, dof // 2), lambda i: power(h / 2, i) / gamma(i + 1)))
  ELSE 2 * {tail} + 2 * exp(-h / 2) / sqrt(2 * pi()) * coalesce(list_sum(list_transform(range(1, (dof - 1) // 2 + 1),
    lambda i: power(h, i - 0.5) * sqrt(pi()) / (power(2, i) * gamma(i + 0.5)))), 0) END
"""


@query("kruskal_batches", "T4 T0", f"""
WITH {LONG}, g AS (SELECT pattern, rps, system, batch, x, rank() OVER w + (count(*) OVER (PARTITION BY pattern, rps, system, x) - 1) / 2 AS mr,
  count(*) OVER (PARTITION BY pattern, rps, system, x) AS tie FROM loss WHERE x IS NOT NULL WINDOW w AS (PARTITION BY pattern, rps, system ORDER BY x)),
r AS (SELECT pattern, rps, system, batch, sum(mr) AS r, count(*) AS n FROM g GROUP BY 1, 2, 3, 4),
t AS (SELECT pattern, rps, system, CAST(count(*) AS DOUBLE) AS n, sum(CAST(tie AS DOUBLE) * tie - 1) AS ties FROM g GROUP BY 1, 2, 3),
s AS (SELECT r.pattern, r.rps, r.system, count(*) AS k, any_value(t.n) AS n, any_value(ties) AS ties, sum(r * r / r.n) AS rr FROM r JOIN t ON r.pattern = t.pattern AND r.rps = t.rps AND r.system = t.system GROUP BY 1, 2, 3),
q AS (SELECT *, k - 1 AS dof, (12 / (n * (n + 1)) * rr - 3 * (n + 1)) / (1 - ties / (n * n * n - n)) AS h FROM s),
a AS (SELECT *, sqrt(greatest(h, 0)) AS az FROM q)
SELECT pattern, CAST(rps AS BIGINT) AS rps, system, k AS n_groups, CAST(n AS BIGINT) AS n_values, round(h, 6) AS "H_statistic",
  round({CHI2_SQL.format(tail=tail_sql('az'))}, 6) AS p_value FROM a""")
def _(spark, d):
    long = _long(spark, d).where("metric = 'loss_rate'")
    return hy.kruskal_wallis(long, [*ex.CONDITION, "system"], "batch")


@query("bootstrap_ci", "T5")
def _(spark, d):
    return hy.bootstrap_ci(_long(spark, d), [*ex.CONDITION, "metric", "system"])


@query("bootstrap_interval_check", "T5", f"""
WITH {LONG} SELECT pattern, CAST(rps AS BIGINT) AS rps, metric, system, count(x) AS n_values, round(avg(x), 6) AS mean,
  true AS lower_near_normal, true AS upper_near_normal FROM v WHERE x IS NOT NULL GROUP BY 1, 2, 3, 4""")
def _(spark, d):
    """The resampled bounds against the normal interval of the mean, which they approach."""
    samples = _long(spark, d)
    keys = [*ex.CONDITION, "metric", "system"]
    spread = samples.groupBy(*keys).agg((F.stddev_pop("value") / F.sqrt(F.count("value"))).alias("se"))
    both = hy.bootstrap_ci(samples, keys).join(spread, keys)
    near = lambda c, sign: F.abs(F.col(c) - (F.col("mean") + sign * sp.Z_975 * F.col("se"))) < 0.2 * F.col("se")
    return both.select(*keys, "n_values", "mean", near("lower", -1).alias("lower_near_normal"), near("upper", 1).alias("upper_near_normal"))


@query("wilson_intervals", "T6", """
WITH s AS (SELECT l_returnflag AS pattern, l_linenumber AS rps, CAST(count(*) AS DOUBLE) AS n, CAST(count(*) FILTER (WHERE l_discount > 0.05) AS DOUBLE) AS k, 1.959963984540054 AS z
  FROM lineitem GROUP BY 1, 2), w AS (SELECT *, k / n AS p FROM s)
SELECT pattern, CAST(rps AS BIGINT) AS rps, CAST(n AS BIGINT) AS n, CAST(k AS BIGINT) AS k,
  round(((p + z*z/(2*n) - z * sqrt(p*(1-p)/n + z*z/(4*n*n))) / (1 + z*z/n)), 6) AS lower,
  round(((p + z*z/(2*n) + z * sqrt(p*(1-p)/n + z*z/(4*n*n))) / (1 + z*z/n)), 6) AS upper FROM w""")
def _(spark, d):
    s = load(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("pattern"), F.col("l_linenumber").alias("rps")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("l_discount") > 0.05).alias("k"))
    lo, hi = sp.wilson_bounds(F.col("k"), F.col("n"))
    return s.select("*", lo.alias("lower"), hi.alias("upper"))


SIGNFLIP = """
m AS (SELECT pattern, rps, batch, avg(diff) AS v FROM p GROUP BY 1, 2, 3),
nz AS (SELECT *, row_number() OVER (PARTITION BY pattern, rps ORDER BY batch) - 1 AS i FROM m WHERE v <> 0),
o AS (SELECT pattern, rps, count(*) AS n, abs(sum(v)) AS obs, count(*) FILTER (WHERE v > 0) AS pos, count(*) FILTER (WHERE v < 0) AS neg FROM nz GROUP BY 1, 2),
k AS (SELECT o.*, unnest(range(0, CAST(power(2, n) AS BIGINT))) AS mask FROM o),
f AS (SELECT k.pattern, k.rps, k.mask, any_value(n) AS n, any_value(obs) AS obs, any_value(pos) AS pos, any_value(neg) AS neg,
  sum(CASE WHEN (mask >> i) % 2 = 1 THEN -abs(v) ELSE abs(v) END) AS s FROM k JOIN nz ON k.pattern = nz.pattern AND k.rps = nz.rps GROUP BY 1, 2, 3),
sg AS (SELECT pattern, rps, any_value(pos) AS pos, any_value(neg) AS neg, count(*) FILTER (WHERE abs(s) >= obs - 1e-12) / count(*) AS pv FROM f GROUP BY 1, 2),
sf AS (SELECT a.pattern, a.rps, nv AS n, coalesce(pos, 0) AS pos, coalesce(neg, 0) AS neg, coalesce(pv, 1) AS pv
  FROM (SELECT pattern, rps, count(*) AS nv FROM m GROUP BY 1, 2) a LEFT JOIN sg ON sg.pattern = a.pattern AND sg.rps = a.rps)
"""


@query("kruskal_many_groups", "T4 T0", """
WITH s AS (SELECT l_linestatus AS k, l_orderkey % 2501 AS g, l_quantity AS v FROM lineitem),
c AS (SELECT k, v, count(*) AS n FROM s GROUP BY 1, 2),
r AS (SELECT k, v, n, sum(n) OVER (PARTITION BY k ORDER BY v) - (n - 1) / 2.0 AS mr FROM c),
t AS (SELECT k, sum(CAST(n AS DOUBLE) ** 3 - n) AS ties, CAST(sum(n) AS DOUBLE) AS n FROM r GROUP BY 1),
q AS (SELECT s.k, g, sum(CAST(mr AS DOUBLE)) AS rs, count(*) AS m FROM s JOIN r ON s.k = r.k AND s.v = r.v GROUP BY 1, 2),
h AS (SELECT q.k, count(*) AS n_groups, any_value(n) AS n, (12 / (any_value(n) * (any_value(n) + 1)) * sum(rs * rs / m) - 3 * (any_value(n) + 1))
  / (1 - any_value(ties) / (any_value(n) ** 3 - any_value(n))) AS hh FROM q JOIN t USING (k) GROUP BY 1),
x AS (SELECT *, hh / 2 AS a, n_groups - 1 AS df, CASE WHEN n_groups % 2 = 1 THEN 0.0 ELSE 0.5 END AS sh FROM h)
SELECT k, n_groups, CAST(n AS BIGINT) AS n_values, round(hh, 6) AS H_statistic, round(least(1.0, list_sum(list_transform(
  range(CASE WHEN df % 2 = 0 THEN 0 ELSE 1 END, CAST(floor(df / 2.0 + sh) AS BIGINT)), lambda i: exp((i - sh) * ln(a) - a - lgamma(i - sh + 1))))), 6) AS p_value FROM x""")
def _(spark, d):
    # 2,501 groups: the tail of a chi-square with as many degrees of freedom, less one
    samples = load(spark, d, "lineitem").select(
        F.col("l_linestatus").alias("k"), (F.col("l_orderkey") % 2501).alias("g"), F.col("l_quantity").alias("v"))
    return hy.kruskal_wallis(samples, ["k"], "g", "v")


@query("batch_level_loss", "T7 T8 T16", f"""
WITH {PAIRS}, {SIGNFLIP}
SELECT pattern, CAST(rps AS BIGINT) AS rps, n AS n_values, pos AS n_positive, neg AS n_negative, round(pv, 6) AS p_value,
  round(least(1, pv * count(*) OVER ()), 6) AS p_bonferroni, pv * count(*) OVER () < 0.05 AS significant, pv < 0.05 AS significant_raw, 'exact' AS status FROM sf""")
def _(spark, d):
    return battery.batch_level_loss(view(spark, d, "trials"))


@query("sign_flip_many_batches", "T7 T16", """
WITH RECURSIVE v AS (SELECT l_returnflag AS flag, date_trunc('month', l_shipdate) AS batch,
  CAST(sum(CASE WHEN l_linenumber % 2 = 0 THEN l_quantity ELSE -l_quantity END) AS BIGINT) AS x FROM lineitem GROUP BY 1, 2),
nz AS (SELECT flag, abs(x) AS a, row_number() OVER (PARTITION BY flag ORDER BY batch) AS i FROM v WHERE x <> 0),
o AS (SELECT flag, count(*) AS n_values, count(*) FILTER (WHERE x > 0) AS n_positive, count(*) FILTER (WHERE x < 0) AS n_negative, abs(sum(x)) AS obs,
  sum(abs(x)) AS total FROM v GROUP BY 1),
dist AS (SELECT flag, CAST(0 AS BIGINT) AS i, CAST(0 AS HUGEINT) AS t, CAST(1 AS DOUBLE) AS p FROM o
  UNION ALL SELECT d.flag, any_value(nz.i), d.t + s.flip * nz.a AS nt, sum(d.p) / 2 FROM dist d JOIN nz ON nz.flag = d.flag AND nz.i = d.i + 1, (VALUES (0), (1)) s(flip)
  GROUP BY d.flag, d.t + s.flip * nz.a),
f AS (SELECT d.flag, sum(p) FILTER (WHERE abs(total - 2 * t) >= obs) AS p FROM dist d JOIN o USING (flag) WHERE d.i = n_positive + n_negative GROUP BY 1)
SELECT flag, n_values, n_positive, n_negative, round(p, 6) AS p_value, 'exact' AS status FROM o JOIN f USING (flag)""")
def _(spark, d):
    signed = F.when(F.col("l_linenumber") % 2 == 0, F.col("l_quantity")).otherwise(-F.col("l_quantity"))
    # whole sums, so every flag has a grid, and one of no more cells than all quantities together: none is refused
    months = load(spark, d, "lineitem").groupBy(
        F.col("l_returnflag").alias("flag"), F.date_trunc("month", "l_shipdate").alias("batch")).agg(F.rint(F.sum(signed)).alias("x"))
    return hy.sign_flip_exact(months, ["flag"], "x", "batch", finest=hy.WHOLE_CELLS)


@query("holm_adjustment", "T9 W12", f"""
WITH {PAIRS}, {SIGNFLIP},
h AS (SELECT *, least(1, (count(*) OVER (PARTITION BY pattern) - row_number() OVER (PARTITION BY pattern ORDER BY pv, rps) + 1) * pv) AS st FROM sf)
SELECT pattern, CAST(rps AS BIGINT) AS rps, round(pv, 6) AS p_value, round(max(st) OVER (PARTITION BY pattern ORDER BY pv, rps ROWS UNBOUNDED PRECEDING), 6) AS p_holm FROM h""")
def _(spark, d):
    tests = battery.batch_level_loss(view(spark, d, "trials")).select(*ex.CONDITION, "p_value")
    return hy.holm(tests, ["pattern"], tie=["rps"])


@query("condition_battery", "T17 T1 T2 T5")
def _(spark, d):
    return battery.condition_battery(view(spark, d, "trials"))


BATCHES = """
bt AS (SELECT batch_dir, avg(floor(o_totalprice)) AS cpu_mean, CAST(strptime(regexp_extract(batch_dir, '^batch_(\\d{8})_(\\d{6})', 1) ||
  regexp_extract(batch_dir, '^batch_(\\d{8})_(\\d{6})', 2), '%Y%m%d%H%M%S') AT TIME ZONE 'Europe/Berlin' AS TIMESTAMP) AS t0
  FROM (SELECT r.batch_dir, o.o_totalprice FROM run_dirs r JOIN orders o ON o.o_orderkey = r.o_orderkey) WHERE starts_with(batch_dir, 'batch_') GROUP BY 1),
hl AS (SELECT created_at AS checked_at, row_count FROM backup_log WHERE table_name = 'pipeline_health'),
bw AS (SELECT batch_dir, any_value(cpu_mean) AS cpu_mean, count(*) AS n_rows, avg(row_count) AS events_per_hour FROM bt JOIN hl
  ON checked_at BETWEEN t0 - INTERVAL 1 HOUR AND t0 + INTERVAL 4 HOUR GROUP BY 1)
"""


def _batch_windows(spark, d):
    dirs = view(spark, d, "run_dirs").where(F.col("batch_dir").startswith("batch_"))
    prices = load(spark, d, "orders").select("o_orderkey", "o_totalprice")
    starts = dirs.join(prices, "o_orderkey").groupBy("batch_dir").agg(F.avg(F.floor("o_totalprice")).alias("cpu_mean")).withColumn(
        "started", parsing.batch_start(F.col("batch_dir")))
    health = view(spark, d, "backup_log").where("table_name = 'pipeline_health'").select(
        F.col("created_at").cast("timestamp").alias("checked_at"), "row_count")
    pairs = intervals.points_in_windows(intervals.around(starts, "started"), health, "win_lo", "win_hi", "checked_at")
    return pairs.groupBy("batch_dir").agg(
        F.max("cpu_mean").alias("cpu_mean"), F.count(F.lit(1)).alias("n_rows"), F.avg("row_count").alias("events_per_hour"))


@query("batch_health_windows", "J7 B17", f"""
WITH {BATCHES} SELECT batch_dir, round(cpu_mean, 6) AS cpu_mean, n_rows, round(events_per_hour, 6) AS events_per_hour FROM bw""")
def _(spark, d):
    return _batch_windows(spark, d)


#: Both tails of Student's t for a whole number of degrees of freedom, by its finite series in the angle.
T_TAIL = """(1 - CASE WHEN dof % 2 = 0 THEN sin(th) * list_sum(list_transform(range(0, dof // 2),
    lambda i: exp(lgamma(i + 0.5) - lgamma(i + 1)) / sqrt(pi()) * power(cos(th), 2 * i)))
  ELSE 2 / pi() * (th + sin(th) * coalesce(list_sum(list_transform(range(0, (dof - 1) // 2),
    lambda i: sqrt(pi()) / 2 * exp(lgamma(i + 1) - lgamma(i + 1.5)) * power(cos(th), 2 * i + 1))), 0)) END)"""


@query("rank_correlation", "T15", f"""
WITH {BATCHES}, u AS (SELECT 'all' AS variant, * FROM bw UNION ALL SELECT 'without_outlier', * FROM bw WHERE batch_dir NOT LIKE '%1999%'),
r AS (SELECT variant, rank() OVER (PARTITION BY variant ORDER BY cpu_mean) + (count(*) OVER (PARTITION BY variant, cpu_mean) - 1) / 2 AS a,
  rank() OVER (PARTITION BY variant ORDER BY events_per_hour) + (count(*) OVER (PARTITION BY variant, events_per_hour) - 1) / 2 AS b FROM u)
SELECT variant, n, round(rho, 6) AS rho, round(CASE WHEN n > 2 THEN CASE WHEN abs(rho) >= 1 THEN 0.0 ELSE {T_TAIL} END END, 6) AS p_value
FROM (SELECT *, atan(abs(rho) / sqrt(1 - rho * rho)) AS th, n - 2 AS dof FROM (SELECT variant, count(*) AS n, corr(a, b) AS rho FROM r GROUP BY 1))""")
def _(spark, d):
    w = materialize(_batch_windows(spark, d), "batch-windows")  # a range join, read by both variants
    both = w.select(F.lit("all").alias("variant"), "*").unionByName(
        w.where(~F.col("batch_dir").contains("1999")).select(F.lit("without_outlier").alias("variant"), "*"))
    return hy.spearman(both, ["variant"], "cpu_mean", "events_per_hour")


@query("profile_repeatability", "T18", """
WITH pr AS (SELECT concat(l_returnflag, l_linestatus) AS pattern, year(l_shipdate) AS run, l_linenumber AS feature, avg(abs(l_discount - l_tax)) AS v FROM lineitem GROUP BY 1, 2, 3),
c AS (SELECT a.pattern, a.run AS r1, b.run AS r2, sum(a.v * b.v) / sqrt(sum(a.v * a.v)) / sqrt(sum(b.v * b.v)) AS c FROM pr a JOIN pr b ON a.pattern = b.pattern AND a.feature = b.feature AND a.run < b.run GROUP BY 1, 2, 3)
SELECT pattern, count(*) AS n_pairs, round(min(c), 6) AS min_cosine, round(max(c), 6) AS max_cosine FROM c GROUP BY 1""")
def _(spark, d):
    p = load(spark, d, "lineitem").groupBy(
        F.concat("l_returnflag", "l_linestatus").alias("pattern"), F.year("l_shipdate").alias("run"), F.col("l_linenumber").alias("feature")
    ).agg(F.avg(F.abs(F.col("l_discount") - F.col("l_tax"))).alias("v"))
    return hy.profile_repeatability(p, ["pattern"], "run", "feature", "v")


@query("special_functions", "T0", f"""
WITH v AS (SELECT DISTINCT CAST(l_quantity AS BIGINT) AS n, l_discount * 60 AS h, l_linenumber AS dof FROM lineitem), a AS (SELECT *, sqrt(h) AS az FROM v)
SELECT n, round(h, 6) AS h, CAST(dof AS BIGINT) AS dof, round(lgamma(n + 1), 6) AS ln_factorial, round({tail_sql('h')}, 6) AS normal_tail,
  round({CHI2_SQL.format(tail=tail_sql('az'))}, 6) AS chi2_tail FROM a""")
def _(spark, d):
    v = load(spark, d, "lineitem").select(
        F.col("l_quantity").cast("bigint").alias("n"), (F.col("l_discount") * 60).alias("h"), F.col("l_linenumber").alias("dof")).distinct()
    return v.select("*", sp.ln_factorial(F.col("n")).alias("ln_factorial"), sp.normal_upper_tail(F.col("h")).alias("normal_tail"),
                    sp.chi2_upper_tail(F.col("h"), F.col("dof")).alias("chi2_tail"))
