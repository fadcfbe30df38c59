"""Every query of the library against its SQL in DuckDB on the smallest tables."""

import duckdb
import pytest

from trailspark.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def plain(v):
    if isinstance(v, float):
        return round(v, 5) + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return v


@pytest.mark.parametrize("name", sorted(catalog.ORACLE))
def test_same_rows(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    mine = sorted(repr(tuple(plain(v) for v in r)) for r in df.select(*cols).collect())
    got = duck.execute(catalog.ORACLE[name])
    names = [d[0] for d in got.description]
    assert sorted(names) == cols
    theirs = sorted(repr(tuple(plain(r[names.index(c)]) for c in cols)) for r in got.fetchall())
    assert mine == theirs


def test_only_the_bootstrap_has_no_sql():
    """Its query is held against loops in test_plans."""
    assert set(catalog.QUERIES) - set(catalog.ORACLE) == {"wave_fits"}
