"""Every registered query against its SQL on DuckDB, over the smallest tables."""

from __future__ import annotations

import decimal
import math
from collections import Counter

import duckdb
import pytest

from caselight.plans.registry import QUERIES

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 9)
    if isinstance(v, decimal.Decimal):
        return round(float(v), 9)
    if isinstance(v, list | tuple):
        return tuple(map(plain, v))
    return v


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, duck, name):
    query = QUERIES[name]
    df = query.run(spark, DATA)
    rows = Counter(tuple(map(plain, r)) for r in df.collect())
    if query.sql is None:
        assert rows
        return
    found = duck.execute(query.sql)
    names = [d[0] for d in found.description]
    assert sorted(names) == sorted(df.columns)
    at = [names.index(c) for c in df.columns]
    assert rows == Counter(tuple(plain(r[k]) for k in at) for r in found.fetchall())
