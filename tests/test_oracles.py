"""Every query that has SQL gives DuckDB's rows on the smallest tables; the others run and keep their schema."""

import datetime
import decimal

import duckdb
import pytest

import __spark_entry__ as entry
from ledgerleaf.plans import registry

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{FOLDER}/{t}.parquet')")
    return con


def plain(value):
    if isinstance(value, (float, decimal.Decimal)):
        return repr(round(float(value), 9) + 0.0)
    if isinstance(value, (datetime.datetime, datetime.date)):
        return str(value)
    return value


def rows(names, records):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(repr([plain(r[i]) for i in order]) for r in records)


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_same_rows(spark, duck, name):
    frame = registry.QUERIES[name](spark, FOLDER)
    want = duck.execute(registry.ORACLES[name])
    names = [c[0] for c in want.description]
    assert sorted(frame.columns) == sorted(names)
    assert rows(frame.columns, frame.collect()) == rows(names, want.fetchall())


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_runs(spark, name):
    assert registry.QUERIES[name](spark, FOLDER).count() > 0


def test_entry(spark):
    assert entry.entry(spark).columns == ["query_id", "chunk_id", "label", "rank", "similarity"]
    assert set(entry.oracle_sql()) <= set(entry.queries())
