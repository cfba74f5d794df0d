"""Every query with SQL gives what DuckDB gives, at the smallest scale."""

import os

import duckdb
import pytest

from textloom.plans import ORACLE_SQL, QUERIES

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    if not os.path.isdir(FOLDER):
        pytest.skip("no test tables")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{FOLDER}/{t}.parquet'")
    return con


def normal(v):
    return repr(round(v, 5) + 0.0) if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_equal(spark, duck, name):
    df = QUERIES[name](spark, FOLDER)
    cols = sorted(df.columns)
    got = sorted(str([normal(r[c]) for c in cols]) for r in df.collect())
    cursor = duck.execute(ORACLE_SQL[name])
    names = [x[0] for x in cursor.description]
    assert sorted(names) == cols
    want = sorted(str([normal(dict(zip(names, r))[c]) for c in cols]) for r in cursor.fetchall())
    assert got == want


def test_every_other_query_has_a_plain_version():
    import pathlib

    own = (pathlib.Path(__file__).parent / "test_without_sql.py").read_text()
    assert not [name for name in set(QUERIES) - set(ORACLE_SQL) if f'QUERIES["{name}"]' not in own]
