"""The registry: contract, coverage, and a few queries against their oracles."""

import collections
import math

import duckdb
import pytest

import __spark_entry__ as contract
from gapspark import registry
from gapspark.sources.driver_tables import VIEWS

WITHOUT_ORACLE = {
    "bootstrap_ci", "condition_battery", "forecast_by_block", "observed_drift_monitor",
    "observed_drift_study",
}
QUICK = [
    "clean_daily_counts", "heartbeat_coverage", "backup_log_gaps", "sent_vs_recorded", "burst_collapse",
    "validated_rows", "feature_windows", "condition_summary", "trend_per_pattern", "drift_monitor", "geo_enrichment",
]


def test_every_query_has_an_oracle_or_a_reason():
    own = registry.entries().keys()  # the optional training-data queries are tested with their operators
    q, o = contract.queries().keys() & own, contract.oracle_sql().keys() & own
    assert set(q) - set(o) == WITHOUT_ORACLE and len(q) > 140
    assert all(base in {"events", "orders", "lineitem", "nation", "supplier"} for base, _ in VIEWS.values())


def test_flagship_runs(spark):
    assert contract.entry(spark).count() == 2


def norm(v):
    return None if isinstance(v, float) and math.isnan(v) else (0.0 if v == 0 and isinstance(v, float) else v)


@pytest.mark.parametrize("name", QUICK)
def test_query_equals_oracle(spark, sf, name):
    e = registry.entries()[name]
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in ("events", "orders", "lineitem", "nation", "supplier"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    df = e.run(spark, sf)
    rel = con.sql(e.oracle)
    cols = sorted(df.columns)
    assert cols == sorted(rel.columns)
    got = collections.Counter(tuple(norm(v) for v in r) for r in df.select(*cols).collect())
    order = [rel.columns.index(c) for c in cols]
    assert got == collections.Counter(tuple(norm(r[i]) for i in order) for r in rel.fetchall())
