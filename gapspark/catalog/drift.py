"""Registered queries: forecast errors, fidelity, drift monitor, verdicts."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import functions as F

from gapspark.catalog.features import WINDOWS
from gapspark.operators import drift as dr
from gapspark.operators import features as ft
from gapspark.operators.filters import clean_events, day_range
from gapspark.plans import drift_study as study
from gapspark.registry import query
from gapspark.schemas import FEATURE_COLUMNS
from gapspark.sources.driver_tables import view

BASE = 36  # baseline blocks of the attribution fixture

MON = f"""
pf AS (SELECT run, block, feature, sum(abs(value)) AS s, count(*) AS n FROM attributions GROUP BY 1, 2, 3),
fd AS (SELECT run, block, CASE WHEN min(actual) = max(actual) THEN CASE WHEN sum((actual - explained) * (actual - explained)) = 0 THEN 1 ELSE 0 END
  ELSE greatest(0, least(1, 1 - sum((actual - explained) * (actual - explained)) / (var_pop(actual) * count(*)))) END AS fid FROM attributions GROUP BY 1, 2),
bs AS (SELECT run, feature, sum(s) AS bs, sum(n) AS bn FROM pf WHERE block < {BASE} GROUP BY 1, 2),
sc AS (SELECT pf.run, block, sum(s / n * bs / bn) / sqrt(sum(s / n * s / n)) / sqrt(sum(bs / bn * bs / bn)) AS score,
  sum(s / n * (bs - s) / (bn - n)) / sqrt(sum(s / n * s / n)) / sqrt(sum((bs - s) / (bn - n) * (bs - s) / (bn - n))) AS loo
  FROM pf JOIN bs ON pf.run = bs.run AND pf.feature = bs.feature GROUP BY 1, 2),
j AS (SELECT sc.run, sc.block, score, CASE WHEN sc.block < {BASE - 1} THEN loo END AS loo, fid,
  avg(fid) OVER (PARTITION BY sc.run ORDER BY sc.block ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS ma FROM sc JOIN fd ON sc.run = fd.run AND sc.block = fd.block),
lm AS (SELECT run, avg(fid) FILTER (WHERE block < {BASE}) - greatest(2 * stddev_pop(fid) FILTER (WHERE block < {BASE}), 0.01) AS tf,
  avg(loo) - greatest(2 * stddev_pop(loo), 0.01) AS tp FROM j GROUP BY 1),
mo AS (SELECT j.run, block, fid, ma, CASE WHEN block >= {BASE - 1} THEN score ELSE loo END AS ps, CASE WHEN block >= {BASE - 1} THEN tf END AS tf,
  CASE WHEN block >= {BASE - 1} THEN tp END AS tp, CASE WHEN block >= {BASE - 1} THEN score < tp ELSE ma < 0.5 END AS dd FROM j JOIN lm ON j.run = lm.run),
er AS (SELECT run, block, avg(error * error) AS mse, avg(abs(error)) AS mae FROM attributions GROUP BY 1, 2)
"""


def _monitor(spark, d):
    a = view(spark, d, "attributions")
    return dr.monitor_adaptive(dr.explanation_fidelity(a, ["run", "block"]), dr.profiles(a, ["run"]), ["run"], BASE)


@query("block_errors", "D2", f"WITH {MON} SELECT run, block, round(mse, 6) AS mse, round(mae, 6) AS mae FROM er")
def _(spark, d):
    return dr.block_errors(view(spark, d, "attributions"), ["run", "block"])


@query("explanation_fidelity", "D4", f"WITH {MON} SELECT run, block, round(fid, 6) AS fidelity_score FROM fd")
def _(spark, d):
    return dr.explanation_fidelity(view(spark, d, "attributions"), ["run", "block"])


@query("profile_scores", "D5 J13", f"WITH {MON} SELECT run, block, round(score, 6) AS score, CASE WHEN block < {BASE - 1} THEN round(loo, 6) END AS score_loo FROM sc")
def _(spark, d):
    return dr.profile_scores(dr.profiles(view(spark, d, "attributions"), ["run"]), ["run"], BASE)


@query("drift_monitor", "D6 W5", f"""
WITH {MON} SELECT run, block, round(fid, 6) AS fidelity_score, round(ma, 6) AS moving_avg, round(ps, 6) AS profile_score,
  round(tf, 6) AS effective_threshold, round(tp, 6) AS profile_threshold, dd AS drift_detected FROM mo""")
def _(spark, d):
    return _monitor(spark, d)


@query("drift_monitor_absolute", "D6a W5", f"""
WITH {MON} SELECT run, block, round(fid, 6) AS fidelity_score, round(ma, 6) AS moving_avg, ma < 0.99 AS drift_detected FROM mo""")
def _(spark, d):
    return dr.monitor_absolute(dr.explanation_fidelity(view(spark, d, "attributions"), ["run", "block"]), ["run"], 0.99)


@query("accuracy_drops", "D7 W13", f"""
WITH {MON}, b AS (SELECT run, avg(mse) AS m FROM er WHERE block < {BASE} GROUP BY 1)
SELECT er.run, min(block) FILTER (WHERE block >= {BASE} AND mse > 3 * m) AS first_accuracy_drop FROM er JOIN b ON er.run = b.run GROUP BY 1""")
def _(spark, d):
    return dr.first_accuracy_drop(dr.block_errors(view(spark, d, "attributions"), ["run", "block"]), ["run"], BASE)


@query("drift_verdicts", "D8 J12 W13", f"""
WITH {MON}, b AS (SELECT run, avg(mse) AS m FROM er WHERE block < {BASE} GROUP BY 1),
a AS (SELECT er.run, min(block) FILTER (WHERE block >= {BASE} AND mse > 3 * m) AS fa FROM er JOIN b ON er.run = b.run GROUP BY 1),
f AS (SELECT run, min(block) FILTER (WHERE dd) AS fd FROM mo GROUP BY 1)
SELECT f.run, fd AS first_detection, fa AS first_accuracy_drop, fd - fa AS detection_lag, coalesce(fd < fa, false) AS fidelity_leads,
  coalesce(fd - fa <= 8, false) AS confirming_detected FROM f LEFT JOIN a ON f.run = a.run""")
def _(spark, d):
    errors = dr.block_errors(view(spark, d, "attributions"), ["run", "block"])
    return dr.verdicts(_monitor(spark, d), errors, ["run"], BASE)


@query("false_alarm_blocks", "D9", f"""
WITH {MON} SELECT run, count(*) FILTER (WHERE block >= {BASE - 1} AND dd) AS false_alarms, count(*) FILTER (WHERE block >= {BASE - 1}) AS n_evaluated_windows,
  min(block) FILTER (WHERE block >= {BASE - 1} AND dd) AS first_false_alarm FROM mo GROUP BY 1""")
def _(spark, d):
    return dr.false_alarms(_monitor(spark, d), ["run"], BASE - 1)


@query("alarms_before_change", "D11 D9", f"""
WITH {MON} SELECT run, coalesce(string_agg(CAST(block AS VARCHAR), ',' ORDER BY block) FILTER (WHERE block < {BASE} AND dd), '') AS blocks,
  count(*) FILTER (WHERE block < {BASE} AND dd) AS n_blocks FROM mo GROUP BY 1""")
def _(spark, d):
    early = dr.alarms_before_change(_monitor(spark, d), ["run"], BASE)
    blocks = F.col("false_alarm_blocks_before_change")
    return early.select("run", F.concat_ws(",", F.transform(blocks, lambda b: b.cast("string"))).alias("blocks"), F.size(blocks).alias("n_blocks"))


_VECTOR = ", ".join(f"CAST({c} AS DOUBLE)" for c in FEATURE_COLUMNS)


@query("attribution_values", "D3", f"""
WITH {WINDOWS}, i AS (SELECT row_number() OVER (ORDER BY window_start) - 1 AS idx, count(*) OVER () AS n, [{_VECTOR}] AS v FROM fw),
e AS (SELECT s.idx AS seq, (w.idx - s.idx) * 10 + f AS j, w.v[f + 1] AS x FROM i s JOIN i w ON w.idx BETWEEN s.idx AND s.idx + 11, range(0, 10) t(f) WHERE s.idx < s.n - 12),
b AS (SELECT j, avg(x) AS m FROM e WHERE seq < 20 GROUP BY 1)
SELECT seq AS seq_index, round(sum(x / (e.j + 1)), 6) AS actual, round(sum((x - m) / (e.j + 1)), 6) AS contribution,
  round(max(CASE WHEN e.j = 0 THEN x - m END), 6) AS first_part, round(max(CASE WHEN e.j = 119 THEN (x - m) / 120 END), 6) AS last_part
FROM e JOIN b ON e.j = b.j GROUP BY 1""")
def _(spark, d):
    import numpy as np
    series = ft.vectors(ft.feature_windows(view(spark, d, "threat_events")))
    seq = ft.sliding_sequences(series).withColumn("x", F.flatten("x")).withColumn("block", F.lit(0).cast("bigint"))
    seq = study.materialize(seq, "sequences")
    background = np.mean([r["x"] for r in seq.where("seq_index < 20").select("x").collect()], axis=0)
    coef = np.tile(1.0 / np.arange(1, 121), (len(FEATURE_COLUMNS), 1))
    scored = study.apply_forecaster(seq, coef, np.zeros(len(FEATURE_COLUMNS)), background)
    return scored.select("seq_index", "actual", F.aggregate("parts", F.lit(0.0), lambda a, v: a + v).alias("contribution"),
                         F.get("parts", F.lit(0)).alias("first_part"), F.get("parts", F.lit(119)).alias("last_part"))


def _hourly_study(spark, d):
    events = view(spark, d, "threat_events")
    first, end = day_range(events)
    hourly = ft.hourly_features(clean_events(events))
    series = ft.on_hour_calendar(hourly, str(first), str(end - timedelta(days=1))).drop("is_filled")
    columns = tuple(c for c in series.columns if c != "hour")
    hours = 24 * (end - first).days
    return study.drift_study(series, columns, "hour", n_normal=hours * 2 // 3, n_total=hours, seeds=(42, 43))


@query("observed_drift_study", "D11 D1 D3 D8")
def _(spark, d):
    return _hourly_study(spark, d)[1]


@query("observed_drift_monitor", "D11 D1 D3 D6")
def _(spark, d):
    return _hourly_study(spark, d)[0]


@query("forecast_by_block", "D1 D2 D3")
def _(spark, d):
    windows = ft.feature_windows(view(spark, d, "threat_events"))
    n = windows.count()
    n_normal = int(n * 0.8)
    sequences = study.materialize(study.series_sequences(windows, FEATURE_COLUMNS, "window_start", n_normal), "sequences")
    coef, intercept = study.fit_forecaster(sequences.where(F.col("seq_index") < n_normal - 12), len(FEATURE_COLUMNS))
    import numpy as np
    scored = study.apply_forecaster(ft.fixed_blocks(sequences, F.lit(n - 12)), coef, intercept, np.zeros(coef.shape[1]))
    return scored.groupBy("block").agg(F.avg("mse").alias("mse"), F.avg("mae").alias("mae"), F.count(F.lit(1)).alias("n_sequences"))
