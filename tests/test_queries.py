"""Every query with SQL gives what DuckDB gives, at the smallest scale."""

from __future__ import annotations

import math
import os
import shutil
import subprocess
import sys

import duckdb
import pytest

from gridwake.plans import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def _value(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v + 0.0:.6g}"
    return str(int(v)) if hasattr(v, "__int__") and not isinstance(v, str) and not isinstance(v, bool) and float(v) == int(v) else str(v)


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted(tuple(_value(r[k]) for k in order) for r in rows)


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_sql(spark, sf, duck, name):
    df = catalog.queries()[name](spark, sf)
    rel = duck.sql(catalog.oracle_sql()[name])
    assert sorted(df.columns) == sorted(rel.columns)
    assert _rows(df.columns, df.collect()) == _rows(rel.columns, rel.fetchall())


#: Queries without SQL, and how many rows each has at the smallest scale; tests/test_sensor.py holds their operators against plain loops.
ROWS = {"c02_plane_ransac": 8}


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql())))
def test_runs(spark, sf, name):
    rows = catalog.queries()[name](spark, sf).collect()
    assert len(rows) == ROWS.get(name, len(rows)) > 0


def test_entry_without_the_corpus_subpackage():
    code = "import sys; sys.modules['gridwake.llm'] = None; sys.modules['corpus_pipeline'] = None; import __spark_entry__ as e; q = e.queries(); assert 'g14_cluster_summary' in q and not any(k.startswith('op') or k == 'pipeline' for k in q); assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], check=True, timeout=120)


def test_entry_where_the_corpus_folders_are_gone(tmp_path):
    """A copy without the subpackage, its tests and the pipeline imports and has all other queries; a fault inside the subpackage is an error."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    own = tmp_path / "copy"
    shutil.copytree(root, own, ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__"))
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 100 and not any(k.startswith('op') or k == 'pipeline' for k in q); assert set(e.oracle_sql()) <= set(q)"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    subprocess.run([sys.executable, "-c", code], check=True, timeout=120, cwd=own, env=env)
    (own / "corpus_pipeline.py").write_text("ORACLE_SQL = None\nrun = None\n")
    (own / "gridwake" / "llm").mkdir()
    (own / "gridwake" / "llm" / "__init__.py").write_text("")
    (own / "gridwake" / "llm" / "registry.py").write_text("import a_module_that_is_not_there\n")
    got = subprocess.run([sys.executable, "-c", "import __spark_entry__"], timeout=120, cwd=own, env=env, capture_output=True, text=True)
    assert got.returncode != 0 and "a_module_that_is_not_there" in got.stderr
