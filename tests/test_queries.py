"""Every registered query of the core against its SQL, and the registry's contract."""

import glob
import os

import duckdb
import pandas as pd
import pytest

from quillspark import queries as core

WITHOUT_SQL = set()


def rows(frame):
    frame = frame[sorted(frame.columns)]
    clean = lambda v: None if v is None or v is pd.NaT or (isinstance(v, float) and v != v) else round(float(v), 6) if isinstance(v, int | float) else str(v)
    return sorted((tuple(clean(v) for v in r) for r in frame.itertuples(index=False)), key=str)


@pytest.fixture(scope="module")
def duck(data):
    con = duckdb.connect()
    for path in glob.glob(data + "/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


@pytest.mark.parametrize("name", sorted(core.ORACLE))
def test_query_equals_sql(spark, data, duck, name):
    got = core.QUERIES[name](spark, data).toPandas()
    expected = duck.execute(core.ORACLE[name]).fetch_df()
    assert sorted(got.columns) == sorted(expected.columns)
    assert rows(got) == rows(expected)


def test_which_queries_have_no_sql():
    assert set(core.QUERIES) - set(core.ORACLE) == WITHOUT_SQL


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_upserted_merges_late_rows_with_a_held_table(spark, data, monkeypatch):
    merged = []
    upsert = core.indexing.upsert

    def counted(current, incoming, **more):
        merged.append((current.count(), incoming.count()))
        return upsert(current, incoming, **more)

    monkeypatch.setattr(core.indexing, "upsert", counted)
    rows = core.QUERIES["upserted"](spark, data).collect()
    current, incoming = merged[-1]
    assert current > 0 and incoming > 0 and len(rows) == len({r.id for r in rows}) >= current
