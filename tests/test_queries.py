"""Every registered query against the SQL it claims to equal, over the smallest tables."""

import duckdb
import pytest

from waveloom.plans import catalogue

SMALL = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    return c


def plain(rows):
    return sorted([tuple(list(v) if isinstance(v, (list, tuple)) else v for v in r) for r in rows], key=repr)


@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_equals_sql(spark, duck, name):
    got = catalogue.QUERIES[name](spark, SMALL)
    want = duck.execute(catalogue.SQL[name])
    columns = [c[0] for c in want.description]
    assert sorted(columns) == sorted(got.columns)
    assert plain(got.select(*columns).collect()) == plain(want.fetchall())


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.SQL)))
def test_gives_rows(spark, name):
    assert catalogue.QUERIES[name](spark, SMALL).count() > 0
