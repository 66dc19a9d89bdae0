"""Each query against its SQL on the smallest tables: names, types and values."""

import duckdb
import pytest

from tessera.plans.oracles import ORACLES
from tessera.plans.queries import QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def rows(arrow, cols):
    return sorted(map(repr, zip(*[arrow.column(c).to_pylist() for c in cols])))


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, duck, sf, name):
    want = duck.sql(ORACLES[name]).to_arrow_table()
    got = QUERIES[name](spark, sf).toArrow()
    cols = sorted(want.column_names)
    assert sorted(got.column_names) == cols
    assert [got.schema.field(c).type for c in cols] == [want.schema.field(c).type for c in cols]
    assert rows(got, cols) == rows(want, cols) and got.num_rows


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
