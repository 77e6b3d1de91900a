import duckdb
import pytest

import __spark_entry__ as entry
from quire.plans import queries as plans

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con(small):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{small}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return None if v != v else round(v, 9)
    return v


@pytest.mark.parametrize("name", sorted(plans.SQL))
def test_query_matches_its_sql(spark, small, con, name):
    got = plans.QUERIES[name](spark, small)
    want = con.execute(plans.SQL[name])
    columns = sorted(d[0] for d in want.description)
    assert sorted(got.columns) == columns
    order = [[d[0] for d in want.description].index(c) for c in columns]
    a = sorted((tuple(plain(r[c]) for c in columns) for r in got.collect()), key=repr)
    b = sorted((tuple(plain(r[i]) for i in order) for r in want.fetchall()), key=repr)
    assert a == b


def test_entry_and_names(spark):
    assert sum(r.pages for r in entry.entry(spark).collect()) > 0
    names = entry.queries()
    assert set(entry.oracle_sql()) <= set(names) and set(plans.QUERIES) <= set(names)
