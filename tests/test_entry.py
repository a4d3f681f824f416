import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from tablewright.plans import catalogue

ROOT = Path(__file__).resolve().parent.parent
DATA = Path("/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def text(v):
    if v is None or v != v:
        return "-"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, (int, float)):
        return f"{float(v):.9g}"
    return str(v)


def test_oracles_name_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_runs(spark):
    assert entry.entry(spark).columns == ["key", "tag", "target_name", "severity"]


@pytest.mark.skipif(not DATA.exists(), reason="no test tables here")
@pytest.mark.parametrize("name", list(catalogue.ORACLES))
def test_query_equals_its_oracle(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    want = con.sql(catalogue.ORACLES[name])
    columns = sorted(want.columns)
    rows = [dict(zip(want.columns, r)) for r in want.fetchall()]
    own = catalogue.QUERIES[name](spark, str(DATA))
    assert sorted(own.columns) == columns
    assert sorted(tuple(text(r[c]) for c in columns) for r in rows) == sorted(tuple(text(r[c]) for c in columns) for r in own.collect())


def test_imports_without_the_llm_folder(tmp_path):
    import shutil

    shutil.copytree(ROOT / "tablewright", tmp_path / "tablewright", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert q and not any(n.startswith('op') for n in q); e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={"PATH": "/usr/bin:/bin", "HOME": str(tmp_path)})
