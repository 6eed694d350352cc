import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

from gapspark.session import build_session  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    s = build_session(
        "tests", "local[8]", spark__sql__shuffle__partitions="4", spark__ui__enabled="false",
        spark__driver__memory="4g", spark__default__parallelism="4",
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(autouse=True)
def small_buckets(monkeypatch):
    """Tests take the path of large keys already at a handful of rows."""
    from gapspark.operators import ordered

    monkeypatch.setattr(ordered, "BUCKET_ABOVE", 20)


@pytest.fixture
def sf():
    return SF


def rows(df):
    return [tuple(r) for r in df.collect()]
