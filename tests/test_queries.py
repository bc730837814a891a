"""Every query with SQL gives DuckDB's rows on the small tables; the others give rows."""

import math
import os
import shutil
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

from tessera.jobs import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return c


def rows(df):
    def cell(v):
        if v is None or (isinstance(v, float) and math.isnan(v)):
            return ""
        return f"{v:.5f}" if isinstance(v, float) else str(v)

    return sorted(tuple(map(cell, r)) for r in df[sorted(df.columns)].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, con, name):
    got = catalog.QUERIES[name](spark, SF).toPandas()
    if name not in catalog.ORACLE_SQL:
        assert len(got)
        return
    want = con.execute(catalog.ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_entry_without_corpus_operators(tmp_path):
    """A copy without the corpus operators and the pipeline imports, and registers the library's own queries."""
    import __spark_entry__ as e

    assert set(catalog.QUERIES) <= set(e.queries()) and set(e.oracle_sql()) <= set(e.queries())
    root = Path(e.__file__).parent
    shutil.copytree(root / "tessera", tmp_path / "tessera", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    ask = "import __spark_entry__ as e, tessera; print(tessera.__file__); print(*sorted(e.queries())); print(*sorted(e.oracle_sql()))"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    made = subprocess.run([sys.executable, "-c", ask], cwd=tmp_path, env=env, capture_output=True, text=True, check=True).stdout.splitlines()[-3:]
    assert made[0].startswith(str(tmp_path)) and made[1].split() == sorted(catalog.QUERIES) and made[2].split() == sorted(catalog.ORACLE_SQL)
