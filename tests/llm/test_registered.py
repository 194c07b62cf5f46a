"""Registered queries that have SQL, against it; all others give rows."""

import glob
import os

import duckdb
import pytest

from quillspark.llm import queries


@pytest.fixture(scope="module")
def duck(data):
    con = duckdb.connect()
    for path in glob.glob(data + "/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_query_equals_sql(spark, data, duck, name):
    got = queries.QUERIES[name](spark, data).toPandas()
    expected = duck.execute(queries.ORACLE[name]).fetch_df()
    assert sorted(got.columns) == sorted(expected.columns)
    rows = lambda f: sorted(map(tuple, f[sorted(f.columns)].values.tolist()))
    assert rows(got) == rows(expected) and len(got) > 0


def test_found_columns(spark, data):
    columns = {
        "p1_found": ["id", "noise"], "p2_found": ["id_a", "id_b"], "p3_found": ["id_a", "id_b"], "p4_found": ["id", "line_no"],
        "p5_found": ["id"], "p6_ids": ["doc_id", "ids"], "p8_found": ["doc_id"],
    }
    for name in ("p5_found", "p6_ids", "p8_found", "p4_found", "p2_found"):
        df = queries.QUERIES[name](spark, data)
        assert df.columns == columns[name] and df.count() == df.distinct().count() > 0


def test_every_text_comes_out_without_its_repeated_lines(spark, data):
    given = {r.id: r.text for r in spark.read.parquet(f"{data}/chunks.parquet").select("id", "text").collect()}
    changed = {r.id: r.text for r in queries.QUERIES["p4_cleaned"](spark, data).collect()}
    rows = queries.QUERIES["p4_texts"](spark, data).collect()
    assert {r.id: r.text for r in rows} == given | changed and len(rows) == len(given) > len(changed) > 0
