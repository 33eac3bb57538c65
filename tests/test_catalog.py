"""Every query with SQL gives DuckDB's rows."""

import math
from pathlib import Path

import duckdb
import pytest

from cairn.plans import catalog


def plain(v):
    if v is None:
        return None
    if isinstance(v, bool):
        return v
    if hasattr(v, "as_integer_ratio") or v.__class__.__name__ == "Decimal":
        v = float(v)
        return "nan" if math.isnan(v) else v
    return str(v)


def close(a, b):
    return a == b or isinstance(a, float) and isinstance(b, float) and math.isclose(a, b, rel_tol=1e-6, abs_tol=2e-4)


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in data), key=lambda r: tuple((x is None, str(round(x, 2)) if isinstance(x, float) else str(x)) for x in r))


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for p in Path(sf).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


@pytest.mark.parametrize("name", list(catalog.QUERIES))
def test_query(spark, sf, duck, name):
    df = catalog.QUERIES[name](spark, sf)
    got = rows(df.columns, df.collect())
    if name not in catalog.ORACLE_SQL:
        assert got
        return
    out = duck.execute(catalog.ORACLE_SQL[name])
    columns = [d[0] for d in out.description]
    assert sorted(columns) == sorted(df.columns)
    want = rows(columns, out.fetchall())
    assert len(got) == len(want)
    assert all(close(x, y) for a, b in zip(got, want) for x, y in zip(a, b)), (got[:3], want[:3])
