"""Queries against their SQL, both over the whole smallest tables."""

import math
from pathlib import Path

import duckdb
import pytest

from foliospark.plans import catalog

SMALL = "/root/testdata/sf0.001"
NAMES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 5) + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return round(float(v), 5) if hasattr(v, "as_tuple") else v


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for n in NAMES:
        if Path(f"{SMALL}/{n}.parquet").exists():
            con.execute(f"create view {n} as select * from '{SMALL}/{n}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_oracle(spark, duck, name):
    df = catalog.queries()[name](spark, SMALL)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    result = duck.execute(catalog.oracle_sql()[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    want = sorted((tuple(plain(r[names.index(c)]) for c in columns) for r in result.fetchall()), key=repr)
    assert got == want


def test_entry(spark):
    assert catalog.FLAGSHIP(spark, SMALL).count() > 0
