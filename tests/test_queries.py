"""Every registered query of the measurement domain against its SQL in DuckDB."""

import datetime
import math
from decimal import Decimal

import duckdb
import pytest

from tidemark.plans import registry

TABLES = "region nation customer supplier part orders lineitem events".split()
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, (Decimal, float)):
        return "nan" if math.isnan(v) else f"{float(v):.9g}"
    return v.isoformat() if isinstance(v, datetime.date) else v


def rows(names, values):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in values), key=repr)


@pytest.mark.parametrize("name", sorted(registry.ORACLE))
def test_matches_sql(spark, duck, name):
    got = registry.QUERIES[name](spark, SF)
    want = duck.execute(registry.ORACLE[name])
    names = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(names)
    assert rows(got.columns, got.collect()) == rows(names, want.fetchall())


def test_every_query_has_sql():
    assert set(registry.QUERIES) == set(registry.ORACLE)
