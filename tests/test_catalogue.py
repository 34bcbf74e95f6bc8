"""Each query of the catalogue against its SQL."""

import os
import subprocess
import sys
from pathlib import Path

import pytest

from vellum.plans import catalogue

ROOT = Path(__file__).resolve().parents[1]


@pytest.fixture(scope="module")
def con(sf):
    import duckdb

    c = duckdb.connect()
    for f in os.listdir(sf):
        c.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{sf}/{f}'")
    return c


@pytest.mark.parametrize("name", [n for n in catalogue.QUERIES if n in catalogue.ORACLES])
def test_query_equals_sql(spark, sf, con, name):
    got = catalogue.QUERIES[name](spark, sf)
    want = con.sql(catalogue.ORACLES[name])
    order = sorted(got.columns)
    assert sorted(want.columns) == order
    assert sorted(map(repr, map(tuple, got.select(*order).collect()))) == sorted(map(repr, want.select(*[f'"{c}"' for c in order]).fetchall()))


@pytest.mark.parametrize("name", [n for n in catalogue.QUERIES if n not in catalogue.ORACLES])
def test_query_runs(spark, sf, name):
    assert catalogue.QUERIES[name](spark, sf).count() > 0


def test_without_the_other_part(tmp_path):
    """The rest works where the subpackage and the pipeline are missing."""
    import shutil

    shutil.copytree(ROOT / "vellum", tmp_path / "vellum", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 40 and not any(n.startswith('op') or n == 'pipeline' for n in q); assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"})
