"""The relational operators' queries against the SQL that gives the same rows."""

from pathlib import Path

import duckdb
import pytest

from trackloom.plans import registry

DATA = Path("/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents pages".split()

pytestmark = pytest.mark.skipif(not DATA.exists(), reason="the given tables are not here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def plain(rows):
    return sorted(repr(tuple(int(x) if isinstance(x, (int, bool)) else x for x in r)) for r in rows)


@pytest.mark.parametrize("name", list(registry.QUERIES))
def test_same_rows(spark, duck, name):
    got = registry.QUERIES[name](spark, str(DATA))
    columns = sorted(got.columns)
    want = duck.sql(f"SELECT {', '.join(columns)} FROM ({registry.ORACLES[name]})").fetchall()
    assert plain(tuple(r) for r in got.select(*columns).collect()) == plain(want)


def test_every_query_has_sql():
    assert registry.QUERIES.keys() == registry.ORACLES.keys()
    assert registry.FLAGSHIP in registry.QUERIES
