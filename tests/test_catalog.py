"""Every query with an oracle against DuckDB, on the smallest tables."""

import decimal
import os

import duckdb
import pytest

from curata.plans import catalog, planning  # noqa: F401 - planning adds its queries

SF = os.environ.get("CATALOG_SF", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(x):
    if isinstance(x, (list, tuple)):
        return [plain(v) for v in x]
    return round(float(x), 9) if isinstance(x, (float, decimal.Decimal)) else x


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    got = sorted(([plain(r[c]) for c in sorted(df.columns)] for r in df.collect()), key=repr)
    if name not in catalog.ORACLES:
        assert got
        return
    r = duck.execute(catalog.ORACLES[name])
    columns = [d[0] for d in r.description]
    assert sorted(columns) == sorted(df.columns)
    order = sorted(range(len(columns)), key=columns.__getitem__)
    want = sorted(([plain(row[i]) for i in order] for row in r.fetchall()), key=repr)
    assert got == want
