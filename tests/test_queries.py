"""Every registered query against its SQL on the small tables, or for rows where SQL has none."""

import duckdb
import pytest

from tideline import registry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in ("events", "orders", "lineitem"):
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_equals_sql(spark, con, name):
    got = registry.QUERIES[name](spark, SF).toPandas()
    want = con.execute(registry.ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    columns = sorted(got.columns)
    a = got[columns].sort_values(columns).reset_index(drop=True)
    b = want[columns].sort_values(columns).reset_index(drop=True)
    assert len(a) == len(b) > 0
    for c in columns:
        if a[c].dtype.kind == "f":
            assert ((a[c] - b[c]).abs().fillna(0) <= 1e-4 * (1 + b[c].abs().fillna(0))).all() and (a[c].isna() == b[c].isna()).all(), c
        else:
            assert (a[c].astype(str) == b[c].astype(str)).all(), c


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE_SQL)))
def test_has_rows(spark, name):
    rows = registry.QUERIES[name](spark, SF)
    assert rows.count() > 0
