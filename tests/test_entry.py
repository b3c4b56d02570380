"""The driver's contract, with and without the training-data subpackage."""

import os
import pathlib
import shutil
import subprocess
import sys

import duckdb
import pytest

import __spark_entry__ as entry

ROOT, DATA = pathlib.Path(entry.__file__).parent, pathlib.Path("/root/testdata/sf0.001")


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries()) and len(entry.queries()) > 80


def test_without_the_subpackage(tmp_path):
    shutil.copytree(ROOT / "steadfast", tmp_path / "steadfast", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert q and not any(x.startswith('op') or x == 'pipeline' for x in q) and set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"})


def test_nothing_else_imports_the_subpackage():
    for path in (ROOT / "steadfast").rglob("*.py"):
        if "llm" not in path.parts:
            assert "steadfast.llm" not in path.read_text(), path


@pytest.mark.skipif(not DATA.exists(), reason="needs the test tables")
def test_entry_and_some_oracles(spark):
    assert entry.entry(spark).count() == 3
    con = duckdb.connect()
    for t in ("events", "orders", "lineitem", "customer", "part"):
        con.execute(f"create view {t} as select * from read_parquet('{DATA}/{t}.parquet')")
    for name in ("hd_quartiles_by_flag", "linear_quantiles", "cliff_delta", "hist_fixed", "cusum", "mann_kendall", "asymptotic_interval", "summary_statistics"):
        ours, theirs = entry.queries()[name](spark, str(DATA)).toPandas(), con.execute(entry.oracle_sql()[name]).df()
        key = [c for c in ours.columns if ours[c].dtype.kind not in "f"]
        ours, theirs = (d[sorted(d.columns)].sort_values(key, key=lambda s: s.astype(str)).reset_index(drop=True) for d in (ours, theirs))
        assert list(ours.columns) == list(theirs.columns) and len(ours) == len(theirs)
        for c in ours.columns:
            if ours[c].dtype.kind == "f":
                assert ours[c].tolist() == pytest.approx(theirs[c].tolist(), abs=2e-3 if name == "hd_quartiles_by_flag" else 2e-6, nan_ok=True), (name, c)
            else:
                assert ours[c].astype(str).tolist() == theirs[c].astype(str).tolist(), (name, c)
