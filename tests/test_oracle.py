"""Every query of the library against its SQL in DuckDB, over the smallest tables."""

import importlib
import os

import duckdb
import pytest

from almanax.plans import registry

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events".split()
SQL = registry.oracle_sql()
#: Tests against plain code, of the queries that have no SQL.
NO_SQL = {"glonass_positions": ("test_plans", "test_glonass_positions_of_all_suppliers_and_times")}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        path = f"{SF_DIR}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    return con


def rows(found, names):
    def plain(v):
        return None if v is None or v != v else round(float(v), 7) + 0.0 if isinstance(v, (int, float)) and not isinstance(v, bool) else v

    return sorted((tuple(plain(r[n]) for n in names) for r in found), key=lambda r: tuple(str(x) for x in r))


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, duck, name):
    df = registry.queries()[name](spark, SF_DIR)
    names = sorted(df.columns)
    got = rows((r.asDict() for r in df.collect()), names)
    if name not in SQL:
        module, test = NO_SQL[name]  # a query without SQL needs a test by brute force
        assert got and callable(getattr(importlib.import_module(module), test))
        return
    result = duck.execute(SQL[name])
    columns = [c[0] for c in result.description]
    assert sorted(columns) == names
    assert got == rows((dict(zip(columns, r, strict=True)) for r in result.fetchall()), names)
