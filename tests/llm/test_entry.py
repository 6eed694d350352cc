"""The optional queries: registered with the others, and the rest stands without them."""

import importlib
import os
import subprocess
import sys

import __spark_entry__ as contract
from gapspark.llm import queries

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def test_all_are_registered():
    found = contract.queries()
    assert {f"op{n}" for n in range(1, 14)} == {k.partition("_")[0] for k in queries.QUERIES}
    assert queries.QUERIES.keys() | {"pipeline"} <= found.keys()
    assert contract.oracle_sql().keys() <= found.keys()
    assert importlib.import_module("corpus_pipeline").run is found["pipeline"]


def test_entry_without_the_folder(tmp_path):
    for name in ("gapspark", "__spark_entry__.py"):
        os.symlink(f"{ROOT}/{name}", tmp_path / name) if name.endswith(".py") else None
    (tmp_path / "gapspark").mkdir()
    for name in os.listdir(f"{ROOT}/gapspark"):
        if name != "llm":
            os.symlink(f"{ROOT}/gapspark/{name}", tmp_path / "gapspark" / name)
    code = "import sys; sys.path.insert(0, '.'); import importlib.util as u; " \
           "s = u.spec_from_file_location('e', '__spark_entry__.py'); m = u.module_from_spec(s); " \
           "m.__dict__['__file__'] = '__spark_entry__.py'; s.loader.exec_module(m); " \
           "q = m.queries(); print(len(q), any(k.startswith('op') or k == 'pipeline' for k in q))"
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, env={
        k: v for k, v in os.environ.items() if k != "PYTHONPATH"})
    n, any_left = out.stdout.split()
    assert int(n) > 140 and any_left == "False", out.stderr
