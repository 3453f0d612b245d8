"""Every query with a DuckDB twin gives its rows, at the smallest scale."""

import math
from pathlib import Path

import duckdb
import pytest

from sluice import catalog, catalog_files  # noqa: F401  adds its queries

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not Path(DATA).exists(), reason="the driver's tables are not here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return con


def plain(rows):
    out = []
    for r in rows:
        out.append(tuple("" if v is None or (isinstance(v, float) and math.isnan(v)) else repr(float(v)) if isinstance(v, float) else str(v) for v in r))
    return sorted(out)


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_same_rows(spark, duck, name):
    got = catalog.queries()[name](spark, DATA)
    columns = sorted(got.columns)
    want = duck.execute(f"select {', '.join(chr(34) + c + chr(34) for c in columns)} from ({catalog.oracle_sql()[name]})").fetchall()
    assert plain(map(tuple, got.select(*columns).collect())) == plain(want)


def test_entry(spark):
    assert catalog.entry(spark, DATA).count() > 0
