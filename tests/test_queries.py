"""Every audit query against its SQL, at the smallest scale."""

import duckdb
import pytest

from sievelake.plans import queries

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def canon(df):
    df = df[sorted(df.columns)]
    return list(df.columns), sorted(tuple(map(str, r)) for r in df.itertuples(index=False))


@pytest.mark.parametrize("name", queries.QUERIES)
def test_query(spark, duck, name):
    assert canon(queries.QUERIES[name](spark, SF).toPandas()) == canon(duck.sql(queries.ORACLES[name]).df())


def test_entry_without_the_optional_part(tmp_path):
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).resolve().parent.parent
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    shutil.copytree(root / "sievelake", tmp_path / "sievelake", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    code = "import __spark_entry__ as e; q = e.queries(); assert q and set(q) == set(e.oracle_sql()); print(len(q))"
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, env={"PATH": "/usr/bin:/bin"})
    assert done.returncode == 0, done.stderr
