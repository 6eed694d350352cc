"""Given tables are read once: what several branches need is written first."""

from __future__ import annotations

import re

import pytest

from gapspark import registry

#: Query and how many reads of given tables it needs: one for each table it is about.
READS = {
    "mann_whitney": 1, "rank_correlation": 3, "batch_level_loss": 1, "kruskal_batches": 1, "heartbeat_coverage": 1,
    "condition_battery": 1, "resource_totals": 1, "gap_intervals": 1, "weekday_permutation_test": 1,
}


@pytest.mark.parametrize("name", READS)
def test_given_tables_are_read_once(spark, sf, name, monkeypatch):
    plans = []
    writer = type(spark.range(1).write)
    plain = writer.parquet

    def recorded(self, *args, **kwargs):
        plans.append(self._df._jdf.queryExecution().executedPlan().toString())
        return plain(self, *args, **kwargs)

    monkeypatch.setattr(writer, "parquet", recorded)
    plans.append(registry.entries()[name].run(spark, sf)._jdf.queryExecution().executedPlan().toString())
    given = re.escape(str(sf))
    assert sum(len(re.findall(rf"Location: [^\[]*\[file:{given}", p)) for p in plans) <= READS[name]
    assert not any("CartesianProduct" in p for p in plans)
