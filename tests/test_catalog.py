"""Every registered query of the engine itself against its SQL twin."""

import math
from collections import Counter

import duckdb
import pytest

from sievespark import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{sf_dir}/{t}.parquet')")
    return con


def plain(value):
    return repr(round(value, 9)) if isinstance(value, float) and not math.isnan(value) else repr(value)


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(names), Counter(tuple(plain(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, duck, sf_dir, name):
    found = catalog.queries()[name](spark, sf_dir)
    got = rows_of(found.columns, [tuple(r) for r in found.collect()])
    sql = catalog.oracle_sql().get(name)
    if sql is None:
        assert got[1]
        return
    twin = duck.execute(sql)
    want = rows_of([d[0] for d in twin.description], twin.fetchall())
    assert got[0] == want[0]
    assert got[1] == want[1]


def test_flagship(spark, sf_dir):
    assert catalog.flagship(spark, sf_dir).count() > 0
