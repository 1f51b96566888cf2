"""Every registered query against its SQL twin on the smallest tables."""

import os

import duckdb
import pytest

from docloom.plans import registry
from docloom.session import TABLES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        path = f"{SF}/{name}.parquet"
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


def normal(frame):
    columns = sorted(frame.columns)
    text = frame[columns].astype(object).map(lambda v: "~" if v is None or v != v else str(round(v, 6)) if isinstance(v, float) else str(v))
    return columns, sorted(map(tuple, text.itertuples(index=False)))


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query_matches_sql(spark, sql, name):
    found = registry.QUERIES[name](spark, SF).toPandas()
    assert name in registry.ORACLES
    assert normal(found) == normal(sql.execute(registry.ORACLES[name]).df())


@pytest.mark.parametrize("gone", [("docloom/llm", "tests/llm"), ("docloom/llm", "tests/llm", "corpus_pipeline.py"), ("corpus_pipeline.py",)])
def test_entry_imports_without_the_llm_parts(tmp_path, gone):
    """On a copy of the repository in which they are deleted."""
    import shutil
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    copy = tmp_path / "copy"
    skipped = shutil.ignore_patterns(".git", "__pycache__", ".pytest_cache")
    shutil.copytree(root, copy, ignore=lambda at, names: {*skipped(at, names), *(n for n in names if os.path.relpath(os.path.join(at, n), root) in gone)})
    assert not any((copy / name).exists() for name in gone)
    code = (
        "import sys, __spark_entry__ as e\nfound, sql = e.queries(), e.oracle_sql()\n"
        "assert len(found) >= 40 and 'pipeline' not in found and set(sql) <= set(found)\n"
        "assert any(n.startswith('op1_') for n in found) == (sys.argv[1] == 'True')"
    )
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    subprocess.run([sys.executable, "-c", code, str("docloom/llm" not in gone and os.path.isdir(f"{root}/docloom/llm"))], check=True, cwd=copy, env=env)
