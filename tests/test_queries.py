"""Every query of the package outside `llm` against its SQL, over whole tables, and the entry without `llm`."""

from __future__ import annotations

import glob
import os
import shutil
import subprocess
import sys

import duckdb
import pytest
from plumbline.plans.oracle import ORACLE_SQL
from plumbline.plans.queries import QUERIES

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return c


def plain(rows, columns):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted(repr(tuple(round(v, 9) if isinstance(v := r[k], float) else v for k in order)) for r in rows)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    df = QUERIES[name](spark, SF)
    rows = [tuple(r) for r in df.collect()]
    if name not in ORACLE_SQL:
        assert rows
        return
    out = con.execute(ORACLE_SQL[name])
    columns = [d[0] for d in out.description]
    assert sorted(df.columns) == sorted(columns)
    assert plain(rows, df.columns) == plain(out.fetchall(), columns)


def test_entry_without_llm(tmp_path):
    for part in ("plumbline", "__spark_entry__.py"):
        at = os.path.join(ROOT, part)
        shutil.copytree(at, tmp_path / part, ignore=shutil.ignore_patterns("llm", "__pycache__")) if os.path.isdir(at) else shutil.copy(at, tmp_path / part)
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; q, s = e.queries(), e.oracle_sql(); assert len(q) > 80 and set(s) <= set(q) and not any(k.startswith('op') and k[2].isdigit() for k in q) and 'pipeline' not in q"], cwd=tmp_path, env=env, capture_output=True, text=True)
    assert done.returncode == 0, done.stderr


@pytest.mark.parametrize("name", ["type_constraints", "formula_eval", "type_matches", "type_parse"])
def test_small_tables_are_dealt_out(spark, name):
    """A table in one file is evaluated on all cores."""
    plan = QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert f"Repartition {spark.sparkContext.defaultParallelism}, true" in plan
