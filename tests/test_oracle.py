"""Registered queries against their SQL, to six digits; what has no SQL is run whole."""

import math

import duckdb
import pytest

from quillmesh.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
AT = "/root/testdata/sf0.01"


#: Queries whose tables may hold nothing to find at the smallest size.
MAY_BE_EMPTY = {"similar_link_clusters"}


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{AT}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6) + 0.0
    return str(v)[:19] if hasattr(v, "isoformat") else v


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_matches_sql(spark, duck, name):
    df = registry.queries()[name](spark, AT)
    cols = sorted(df.columns)
    r = duck.execute(registry.oracle_sql()[name])
    at = [[d[0] for d in r.description].index(c) for c in cols]
    want = sorted((tuple(plain(x[i]) for i in at) for x in r.fetchall()), key=repr)
    assert sorted((tuple(plain(x[c]) for c in cols) for x in df.collect()), key=repr) == want


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_runs(spark, name):
    rows = registry.queries()[name](spark, "/root/testdata/sf0.001").collect()
    assert rows or name in MAY_BE_EMPTY
