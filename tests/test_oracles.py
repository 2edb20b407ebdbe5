"""Registered queries against DuckDB on the smallest tables."""

import duckdb
import pytest

from lapwing.plans import catalogue

D = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events".split():
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{D}/{t}.parquet'")
    return c


def rows(records, names, order):
    def plain(v):
        return None if v is None or v != v else float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else v

    return sorted(repr(tuple(plain(r[names.index(c)]) for c in order)) for r in records)


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_matches_sql(spark, con, name):
    df = catalogue.QUERIES[name](spark, D)
    cur = con.execute(catalogue.ORACLES[name])
    theirs = [c[0] for c in cur.description]
    assert sorted(df.columns) == sorted(theirs)
    assert rows(df.collect(), df.columns, sorted(theirs)) == rows(cur.fetchall(), theirs, sorted(theirs))


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLES)))
def test_runs(spark, name):
    assert catalogue.QUERIES[name](spark, D).count() > 0
