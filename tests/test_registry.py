"""Every registered query against its SQL at the smallest scale."""

import duckdb
import pytest

import __spark_entry__ as registered

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
          "labels conversations").split()
QUERIES, SQL = ({k: v for k, v in each.items() if k != "pipeline" and not (k[:2] == "op" and k[2].isdigit())}
                for each in (registered.queries(), registered.oracle_sql()))


@pytest.fixture(scope="module")
def con(small):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    return con


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL)


@pytest.mark.parametrize("name", list(QUERIES))
def test_equals_sql(spark, small, con, name):
    df = QUERIES[name](spark, small)
    columns = sorted(df.columns)
    cur = con.execute(SQL[name])
    names = [c[0] for c in cur.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    expect = sorted((str([r[i] for i in at]) for r in cur.fetchall()))
    assert sorted(str([r[c] for c in columns]) for r in df.collect()) == expect


def test_entry(spark):
    assert registered.entry(spark).count() > 0
