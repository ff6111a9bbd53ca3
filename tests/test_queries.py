"""Every query against its SQL twin on the smallest tables, and the promise that the corpus operators can be left out."""

import os
import subprocess
import sys

import duckdb
import pytest

from tidemark.plans import QUERIES, SQL

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(small):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    return con


def cells(row):
    return tuple("" if v is None else repr(float(v)) if isinstance(v, float) else str(int(v)) if isinstance(v, bool) else str(v) for v in row)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, small, name):
    got = QUERIES[name](spark, small)
    columns = sorted(got.columns)
    rows = sorted(cells(r) for r in got.select(*columns).collect())
    if name not in SQL:
        return
    found = duck.execute(SQL[name])
    names = [x[0] for x in found.description]
    assert sorted(names) == columns
    assert rows == sorted(cells([r[names.index(c)] for c in columns]) for r in found.fetchall())


def test_works_without_the_corpus_operators(tmp_path):
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = f"""
import sys
sys.path.insert(0, {root!r})
class Gone:
    def find_spec(self, name, path=None, target=None):
        if name.startswith("tidemark.llm") or name == "corpus_pipeline":
            raise ModuleNotFoundError(name)
sys.meta_path.insert(0, Gone())
import __spark_entry__ as e
assert len(e.queries()) > 90 and not any(k.startswith("op") for k in e.queries()) and set(e.oracle_sql()) <= set(e.queries())
"""
    subprocess.run([sys.executable, "-c", code], check=True, cwd=tmp_path)
