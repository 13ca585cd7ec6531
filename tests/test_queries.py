"""Every registered query against its SQL in DuckDB, over the smallest tables."""

import math
from decimal import Decimal

import duckdb
import pytest

from factloom.plans import catalog

SF_DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF_DIR}/{t}.parquet'")
    return c


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return "null"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, (int, float, Decimal)):
        return f"{float(v):.9g}"
    if isinstance(v, (list, tuple)):
        return str([plain(x) for x in v])
    return v.isoformat() if hasattr(v, "isoformat") else str(v)


@pytest.mark.parametrize("name", sorted(catalog.oracles()))
def test_query_equals_its_sql(spark, con, name):
    found = catalog.plans()[name](spark, SF_DIR)
    columns = sorted(found.columns)
    got = sorted(tuple(map(plain, r)) for r in found.select(*columns).collect())
    result = con.execute(catalog.oracles()[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    order = [names.index(c) for c in columns]
    assert got == sorted(tuple(plain(r[i]) for i in order) for r in result.fetchall())


@pytest.mark.parametrize("name", sorted(set(catalog.plans()) - set(catalog.oracles())))
def test_queries_without_sql_run(spark, name):
    assert catalog.plans()[name](spark, SF_DIR).count() > 0
