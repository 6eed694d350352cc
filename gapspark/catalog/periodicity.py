"""Registered queries: daily series, detrending, periodicity tests."""

from __future__ import annotations

from pyspark.sql import functions as F

from gapspark.catalog.monitoring import CLEAN
from gapspark.operators import periodicity as pe
from gapspark.operators.filters import day_range
from gapspark.operators.monitor import clean_daily_counts
from gapspark.plans.periodicity_claims import BANDS, periodicity_claims
from gapspark.registry import query
from gapspark.session import materialize, shared_dir
from gapspark.sources import daily_files
from gapspark.sources.driver_tables import view

START = "2024-01-03"
DROPS = ["2024-01-10", "2024-01-12", "2024-01-13"]
VARIANTS = {
    "main": ([], "linear"), "drop_days": (DROPS, "linear"), "drop_one": (["2024-01-20"], "linear"),
    "drop_both": ([*DROPS, "2024-01-20"], "linear"), "rolling_median": ([], "rolling"),
}


def _daily(spark, d):
    """One row per day; written once, because fits and medians of every variant read it."""
    events = view(spark, d, "threat_events")
    return materialize(clean_daily_counts(events, *day_range(events)), "daily-counts")


DAILY = f"""
dy AS (SELECT CAST(timestamp AS DATE) AS day, CAST(sum(count) AS BIGINT) AS c FROM threat_events WHERE {CLEAN}
  GROUP BY 1)
"""
SERIES = f"""
{DAILY},
va AS (SELECT 'main' AS variant, 'linear' AS mode, [] AS dr UNION ALL SELECT 'drop_days', 'linear', ['2024-01-10', '2024-01-12', '2024-01-13']
  UNION ALL SELECT 'drop_one', 'linear', ['2024-01-20'] UNION ALL SELECT 'drop_both', 'linear', ['2024-01-10', '2024-01-12', '2024-01-13', '2024-01-20']
  UNION ALL SELECT 'rolling_median', 'rolling', []),
se AS (SELECT variant, mode, day, ln(c) AS y, row_number() OVER (PARTITION BY variant ORDER BY day) - 1 AS idx, count(*) OVER (PARTITION BY variant) AS n,
  isodow(day) - 1 AS wd FROM dy, va WHERE day >= DATE '2024-01-03' AND NOT list_contains(dr, CAST(day AS VARCHAR))),
fi AS (SELECT variant, regr_slope(y, idx) AS sl, regr_intercept(y, idx) AS ic FROM se GROUP BY 1),
md AS (SELECT a.variant, a.idx, quantile_cont(b.y, 0.5) AS m FROM se a JOIN se b ON a.variant = b.variant
  AND b.idx BETWEEN a.idx - least(7, a.idx, a.n - 1 - a.idx) AND a.idx + least(7, a.idx, a.n - 1 - a.idx) GROUP BY 1, 2),
re AS (SELECT se.*, CASE WHEN mode = 'linear' THEN y - (sl * se.idx + ic) ELSE y - m END AS r FROM se JOIN fi USING (variant) JOIN md ON md.variant = se.variant AND md.idx = se.idx)
"""


def _resid(spark, d):
    return pe.detrended(pe.variant_series(pe.log_series(_daily(spark, d)), VARIANTS, START))


def _arrays(spark, d):
    """One row per variant; written once, because the tests read it several times."""
    return materialize(pe.as_arrays(materialize(_resid(spark, d), "residuals"), ["variant"]), "series")


_GROUP = "count(c) AS n_days, CAST(coalesce(sum(c), 0) AS BIGINT) AS total, round(avg(c), 6) AS mean_count, quantile_cont(c, 0.5) AS median_count"


@query("weekday_groups", "G24 B24", f"""
WITH {DAILY}, lb AS (SELECT i - 1 AS weekday, ['Mon', 'Tue', 'Wed', 'Thu', 'Fri', 'Sat', 'Sun'][i] AS label FROM range(1, 8) t(i))
SELECT weekday, label, {_GROUP} FROM lb LEFT JOIN dy ON isodow(day) - 1 = weekday GROUP BY 1, 2""")
def _(spark, d):
    return pe.by_weekday(_daily(spark, d))


@query("cycle_phase_groups", "G24 B24", f"""
WITH {DAILY}, ph AS (SELECT day, c, date_diff('day', (SELECT min(day) FROM dy), day) % 24 AS p FROM dy)
SELECT i AS phase, {_GROUP} FROM range(0, 24) t(i) LEFT JOIN ph ON p = i GROUP BY 1""")
def _(spark, d):
    return pe.by_cycle_phase(_daily(spark, d))


_Q = ", ".join(
    f"quantile_cont(c, {p}) FILTER (WHERE day {op} DATE '2024-01-20') AS {n}_{l}"
    for n, op in (("early", "<"), ("late", ">=")) for p, l in ((0.25, "q25"), (0.5, "median"), (0.75, "q75")))


@query("regime_description", "G23", f"""
WITH {DAILY}, q AS (SELECT count(*) FILTER (WHERE day < DATE '2024-01-20') AS n_early, count(*) FILTER (WHERE day >= DATE '2024-01-20') AS n_late, {_Q},
  max(c) AS max_count, min(c) AS min_count FROM dy)
SELECT *, round(late_median / early_median, 6) AS late_over_early_median,
  (SELECT CAST(min(day) AS VARCHAR) FROM dy WHERE c = (SELECT max(c) FROM dy)) AS max_day,
  (SELECT CAST(min(day) AS VARCHAR) FROM dy WHERE c = (SELECT min(c) FROM dy)) AS min_day FROM q""")
def _(spark, d):
    return pe.regime_description(_daily(spark, d), "2024-01-20")


@query("log_daily_counts", "B21", f"""
WITH {DAILY} SELECT CAST(day AS VARCHAR) AS day, c AS total_count, round(ln(c), 6) AS y, false AS log_violation FROM dy""")
def _(spark, d):
    return pe.log_series(_daily(spark, d))


@query("detrended_series", "T14 W10 T13", f"""
WITH {SERIES} SELECT variant, idx, CAST(day AS VARCHAR) AS day, wd AS weekday, round(r, 6) AS resid FROM re""")
def _(spark, d):
    return _resid(spark, d).select("variant", "idx", "day", "weekday", "resid")


@query("ar1_fit", "W11", f"""
WITH {SERIES}, c AS (SELECT variant, idx, r - avg(r) OVER (PARTITION BY variant) AS r0 FROM re),
g AS (SELECT variant, r0, lag(r0) OVER (PARTITION BY variant ORDER BY idx) AS r1 FROM c),
p AS (SELECT variant, sum(r0 * r1) / sum(r1 * r1) AS phi FROM g WHERE r1 IS NOT NULL GROUP BY 1)
SELECT g.variant, round(any_value(phi), 6) AS phi, round(stddev_samp(r0 - phi * r1), 6) AS sigma FROM g JOIN p USING (variant) WHERE r1 IS NOT NULL GROUP BY 1""")
def _(spark, d):
    return pe.ar1_fit(_resid(spark, d), ["variant"])


PERM = f"""
{SERIES},
pm AS (SELECT variant, n, perm, r, row_number() OVER (PARTITION BY variant, perm ORDER BY md5('42:' || perm || ':' || idx)) - 1 AS pos,
  rank() OVER (PARTITION BY variant, perm ORDER BY r) + (count(*) OVER (PARTITION BY variant, perm, r) - 1) / 2 AS mr FROM re, range(0, 10000) t(perm)),
"""


WEEKDAY = f"""
ob AS (SELECT variant, n, idx, wd, rank() OVER (PARTITION BY variant ORDER BY r) + (count(*) OVER (PARTITION BY variant, r) - 1) / 2 AS mr,
  count(*) OVER (PARTITION BY variant, r) AS tie FROM re),
tc AS (SELECT variant, 1 - sum(CAST(tie AS DOUBLE) * tie - 1) / (power(any_value(n), 3) - any_value(n)) AS cf FROM ob GROUP BY 1),
sz AS (SELECT variant, wd, count(*) AS g FROM ob GROUP BY 1, 2),
oh AS (SELECT variant, any_value(n) AS n, (12 / (any_value(n) * (any_value(n) + 1)) * sum(rs * rs / g) - 3 * (any_value(n) + 1)) AS h0
  FROM (SELECT variant, wd, any_value(n) AS n, sum(mr) AS rs, count(*) AS g FROM ob GROUP BY 1, 2) GROUP BY 1),
pr AS (SELECT pm.variant, perm, ob.wd, sum(pm.mr) AS rs, any_value(pm.n) AS n FROM pm JOIN ob ON ob.variant = pm.variant AND ob.idx = pm.pos GROUP BY 1, 2, 3),
hp AS (SELECT pr.variant, perm, 12 / (any_value(n) * (any_value(n) + 1)) * sum(rs * rs / g) - 3 * (any_value(n) + 1) AS hx
  FROM pr JOIN sz ON sz.variant = pr.variant AND sz.wd = pr.wd GROUP BY 1, 2),
ge AS (SELECT hp.variant, count(*) FILTER (WHERE hx / cf >= h0 / cf - 1e-9) AS ge FROM hp JOIN oh USING (variant) JOIN tc USING (variant) GROUP BY 1)
"""


@query("weekday_permutation_test", "T10 J15", f"""
WITH {PERM} {WEEKDAY}SELECT variant, n AS n_days, round(h0 / cf, 6) AS "H", round(h0 / cf / (n - 1), 6) AS eps2, round((ge + 1) / 10001, 6) AS p FROM oh JOIN tc USING (variant) JOIN ge USING (variant)""")
def _(spark, d):
    return pe.weekday_permutation_test(_arrays(spark, d), ["variant"])


FREQ = """
fq AS (SELECT band, 2 * pi() / (c - h + i * (2 * h / 40)) AS w, i FROM (VALUES ('7d', 7.0::DOUBLE, 0.5::DOUBLE), ('24d', 24.0::DOUBLE, 1.0::DOUBLE)) b(band, c, h), range(0, 41) t(i)),
tau AS (SELECT variant, band, i, w, atan2(sum(sin(2 * w * idx)), sum(cos(2 * w * idx))) / 2 AS ph FROM re, fq GROUP BY 1, 2, 3, 4),
ba AS (SELECT re.variant, band, i, idx, cos(w * idx - ph) AS cc, sin(w * idx - ph) AS ss FROM re JOIN tau ON tau.variant = re.variant),
nm AS (SELECT variant, band, i, sum(cc * cc) AS c2, sum(ss * ss) AS s2 FROM ba GROUP BY 1, 2, 3),
ce AS (SELECT variant, idx, r - avg(r) OVER (PARTITION BY variant) AS y FROM re), en AS (SELECT variant, sum(y * y) AS yy FROM ce GROUP BY 1),
po AS (SELECT ba.variant, ba.band, ba.i, sum(y * cc) AS yc, sum(y * ss) AS ys FROM ba JOIN ce ON ce.variant = ba.variant AND ce.idx = ba.idx GROUP BY 1, 2, 3),
bp AS (SELECT po.variant, po.band, max((yc * yc / c2 + ys * ys / s2) / yy) AS power FROM po JOIN nm ON nm.variant = po.variant AND nm.band = po.band AND nm.i = po.i JOIN en ON en.variant = po.variant GROUP BY 1, 2)
"""


@query("band_power", "T11", f"""
WITH {SERIES}, {FREQ} SELECT variant, round(max(power) FILTER (WHERE band = '7d'), 6) AS "7d", round(max(power) FILTER (WHERE band = '24d'), 6) AS "24d" FROM bp GROUP BY 1""")
def _(spark, d):
    return pe.band_power(_arrays(spark, d), ["variant"], BANDS)


BAND_PERM = """
pc AS (SELECT pm.variant, perm, pos, pm.r - m AS y FROM pm JOIN (SELECT variant, avg(r) AS m FROM re GROUP BY 1) a ON a.variant = pm.variant),
pp AS (SELECT pc.variant, perm, band, ba.i, sum(y * cc) AS yc, sum(y * ss) AS ys FROM pc JOIN ba ON ba.variant = pc.variant AND ba.idx = pc.pos GROUP BY 1, 2, 3, 4),
px AS (SELECT pp.variant, perm, pp.band, max((yc * yc / c2 + ys * ys / s2) / yy) AS power FROM pp JOIN nm ON nm.variant = pp.variant AND nm.band = pp.band AND nm.i = pp.i JOIN en ON en.variant = pp.variant GROUP BY 1, 2, 3),
ge AS (SELECT px.variant, px.band, count(*) FILTER (WHERE px.power >= bp.power) AS ge FROM px JOIN bp ON bp.variant = px.variant AND bp.band = px.band GROUP BY 1, 2)
"""


@query("periodicity_permutation_test", "T12 J15", f"""
WITH {PERM} {FREQ}, {BAND_PERM}SELECT bp.variant, (SELECT any_value(n) FROM se WHERE se.variant = bp.variant) AS n_days,
  round(max(power) FILTER (WHERE bp.band = '7d'), 6) AS power_7d, round(max((ge + 1) / 10001) FILTER (WHERE bp.band = '7d'), 6) AS p_perm_7d,
  round(max(power) FILTER (WHERE bp.band = '24d'), 6) AS power_24d, round(max((ge + 1) / 10001) FILTER (WHERE bp.band = '24d'), 6) AS p_perm_24d
FROM bp JOIN ge ON ge.variant = bp.variant AND ge.band = bp.band GROUP BY 1""")
def _(spark, d):
    return pe.periodicity_test(_arrays(spark, d), ["variant"], BANDS)


AR1 = """
c0 AS (SELECT variant, idx, r - avg(r) OVER (PARTITION BY variant) AS r0 FROM re),
g0 AS (SELECT variant, r0, lag(r0) OVER (PARTITION BY variant ORDER BY idx) AS r1 FROM c0),
p0 AS (SELECT variant, sum(r0 * r1) / sum(r1 * r1) AS phi FROM g0 WHERE r1 IS NOT NULL GROUP BY 1),
ft AS (SELECT g0.variant, any_value(phi) AS phi, stddev_samp(r0 - phi * r1) AS sigma, count(*) + 1 AS n FROM g0 JOIN p0 USING (variant) WHERE r1 IS NOT NULL GROUP BY 1),
path AS (SELECT variant, s, CAST(0 AS BIGINT) AS k, phi, sigma, n, sigma * {z0} AS x FROM ft, range(0, 10000) t(s)
  UNION ALL SELECT variant, s, k + 1, phi, sigma, n, phi * x + sigma * {z1} FROM path WHERE k < n + 99),
sg AS (SELECT variant, s, k - 100 AS pos, x - avg(x) OVER (PARTITION BY variant, s) AS y FROM path WHERE k >= 100),
se2 AS (SELECT variant, s, sum(y * y) AS yy FROM sg GROUP BY 1, 2),
sp AS (SELECT sg.variant, s, band, ba.i, sum(y * cc) AS yc, sum(y * ss) AS ys FROM sg JOIN ba ON ba.variant = sg.variant AND ba.idx = sg.pos GROUP BY 1, 2, 3, 4),
sx AS (SELECT sp.variant, sp.s, sp.band, max((yc * yc / c2 + ys * ys / s2) / yy) AS power FROM sp JOIN nm ON nm.variant = sp.variant AND nm.band = sp.band AND nm.i = sp.i
  JOIN se2 ON se2.variant = sp.variant AND se2.s = sp.s GROUP BY 1, 2, 3),
ga AS (SELECT sx.variant, sx.band, count(*) FILTER (WHERE sx.power >= bp.power) AS ge FROM sx JOIN bp ON bp.variant = sx.variant AND bp.band = sx.band GROUP BY 1, 2)
"""


def _normal_sql(k: str) -> str:
    """The draw of surrogate s at step k, from the md5 of its name."""
    h = f"md5('42:' || variant || ':' || s || ':' || {k})"
    part = lambda at: f"CAST('0x' || substr({h}, {at}, 13) AS BIGINT)"
    return f"sqrt(-2 * ln(({part(1)} + 1) / 4503599627370496.0)) * cos(2 * pi() * ({part(14)} / 4503599627370496.0))"


AR1 = AR1.format(z0=_normal_sql("0"), z1=_normal_sql("(k + 1)"))


@query("periodicity_claims", "T13 T12 T9 B24", f"""
WITH RECURSIVE {PERM} {WEEKDAY}, {FREQ}, {BAND_PERM.replace('ge AS (', 'gp AS (')}, {AR1},
wk AS (SELECT variant, n AS n_days, h0 / cf AS hh, h0 / cf / (n - 1) AS eps2, (ge + 1) / 10001 AS p FROM oh JOIN tc USING (variant) JOIN ge USING (variant)),
bd AS (SELECT variant, band, power, (gp.ge + 1) / 10001 AS pp, (ga.ge + 1) / 10001 AS pa FROM bp JOIN gp USING (variant, band) JOIN ga USING (variant, band)),
ts AS (SELECT variant, 'weekday' AS test, p FROM wk UNION ALL SELECT variant, band, greatest(pp, pa) FROM bd),
rk AS (SELECT variant, test, p, row_number() OVER (PARTITION BY variant ORDER BY p, test) AS i FROM ts),
hm AS (SELECT variant, test, max(least(1, (4 - i) * p)) OVER (PARTITION BY variant ORDER BY i) AS ph FROM rk)
SELECT wk.variant, n_days, round(hh, 6) AS "H", round(eps2, 6) AS eps2, round(wk.p, 6) AS p_weekday, round(any_value(phi), 6) AS ar1_phi,
  {", ".join(f"round(max({c}) FILTER (WHERE band = '{b}'), 6) AS {n}_{b}" for b in ("7d", "24d") for n, c in (("power", "power"), ("p_perm", "pp"), ("p_ar1", "pa"), ("p", "greatest(pp, pa)")))},
  {", ".join(f"(SELECT round(ph, 6) FROM hm WHERE hm.variant = wk.variant AND test = '{t}') AS p_holm_{t}" for t in ("weekday", "7d", "24d"))},
  (SELECT bool_or(ph < 0.05 AND (test <> 'weekday' OR wk.eps2 >= 0.14)) FROM hm WHERE hm.variant = wk.variant) AS claim_periodicity
FROM wk JOIN bd ON bd.variant = wk.variant JOIN ft ON ft.variant = wk.variant GROUP BY wk.variant, n_days, hh, eps2, wk.p""")
def _(spark, d):
    return periodicity_claims(_daily(spark, d), VARIANTS, START)


@query("daily_file_violations", "A11 S7", """
WITH f AS (SELECT CAST(timestamp AS DATE) + CAST(CASE WHEN event_id % 1000 = 7 THEN 1 ELSE 0 END AS INT) AS file_day, CAST(timestamp AS DATE) AS day FROM threat_events),
k AS (SELECT * FROM f WHERE file_day <> DATE '2024-01-15'),
c AS (SELECT CAST(unnest(generate_series(DATE '2024-01-01', DATE '2024-01-30', INTERVAL 1 DAY)) AS DATE) AS file_day)
SELECT CAST(file_day AS VARCHAR) AS file_day, 'absent_day' AS violation, CAST(0 AS BIGINT) AS n_rows FROM c WHERE (file_day < DATE '2024-01-07' OR file_day >= DATE '2024-01-13')
  AND NOT EXISTS (SELECT 1 FROM k WHERE k.file_day = c.file_day)
UNION ALL SELECT CAST(file_day AS VARCHAR), 'rows_of_another_day', count(*) FROM k WHERE day <> file_day AND file_day <= DATE '2024-01-30'
  AND (file_day < DATE '2024-01-07' OR file_day >= DATE '2024-01-13') GROUP BY 1""")
def _(spark, d):
    ev = view(spark, d, "threat_events")
    day = F.date_add(F.to_date("timestamp"), F.when(F.col("event_id") % 1000 == 7, 1).otherwise(0))
    base = shared_dir(spark, "daily-files")
    filed = ev.withColumn("file_day", day).where(F.col("file_day") != F.lit("2024-01-15").cast("date"))
    filed.hint("rebalance", "file_day").write.partitionBy("file_day").parquet(base)
    rows = daily_files.read_days(spark, base, ev.schema)
    return daily_files.day_violations(rows, "2024-01-01", "2024-01-30", ("2024-01-07", "2024-01-13"))
