import datetime
import os
import shutil
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as E
from sparkloom.plans import catalog

ROOT = Path(__file__).resolve().parents[1]
SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in Path(SMALL).glob("*.parquet"):
        c.execute(f"CREATE VIEW {t.stem} AS SELECT * FROM '{t}'")
    return c


def norm(v):
    if isinstance(v, float):
        return round(v, 6)
    return v.replace(tzinfo=None) if isinstance(v, datetime.datetime) else v


@pytest.mark.skipif(not Path(SMALL).exists(), reason="no test tables")
@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query_agrees_with_its_sql(spark, con, name):
    got = E.queries()[name](spark, SMALL)
    cols = sorted(got.columns)
    rows = sorted((tuple(norm(r[c]) for c in cols) for r in got.collect()), key=repr)
    if name not in E.oracle_sql():
        assert rows
        return
    want = con.sql(E.oracle_sql()[name])
    assert sorted(want.columns) == cols
    at = [want.columns.index(c) for c in cols]
    assert rows == sorted((tuple(norm(r[i]) for i in at) for r in want.fetchall()), key=repr)


@pytest.mark.skipif(not Path(SMALL).exists(), reason="no test tables")
def test_entry(spark):
    assert E.entry(spark).columns == ["id", "name", "n_callers"] and E.entry(spark).count() > 0


def test_works_without_the_corpus_operators(tmp_path):
    shutil.copytree(ROOT, tmp_path / "r", ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__"))
    code = "import __spark_entry__ as e; q = e.queries(); assert q and not any(n.startswith('op') or n == 'pipeline' for n in q); assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "r", check=True, env=os.environ | {"PYTHONPATH": str(tmp_path / "r")})


def test_nothing_else_imports_the_corpus_operators():
    for p in (ROOT / "sparkloom").rglob("*.py"):
        if "llm" not in p.relative_to(ROOT).parts:
            assert "sparkloom.llm" not in p.read_text(), p
