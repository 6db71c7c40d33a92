"""Every registered query against the SQL that gives the same rows, on small tables."""

import decimal
import math
from pathlib import Path

import duckdb
import pytest

from ferrowick import queries


def norm(value):
    if isinstance(value, decimal.Decimal):
        value = float(value)
    if isinstance(value, float):
        return None if math.isnan(value) else float(f"{value:.9g}")
    return value


@pytest.fixture(scope="module")
def db(sf_dir):
    con = duckdb.connect()
    for path in Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS FROM '{path}'")
    return con


@pytest.mark.parametrize("name", list(queries.QUERIES))
def test_query(spark, sf_dir, db, name):
    df = queries.QUERIES[name](spark, sf_dir)
    rows = df.collect()
    if name not in queries.ORACLE_SQL:
        assert rows
        return
    result = db.execute(queries.ORACLE_SQL[name])
    columns = [d[0] for d in result.description]
    assert sorted(columns) == sorted(df.columns)
    want = sorted(([norm(x) for x in row] for row in result.fetchall()), key=repr)
    got = sorted(([norm(r[c]) for c in columns] for r in rows), key=repr)
    assert got == want
