"""Every query with an oracle gives DuckDB's rows."""

import math
import os

import duckdb
import pytest

from siltstone.catalog import ORACLES, QUERIES


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    fix = lambda x: round(x, 5) if isinstance(x, float) and math.isfinite(x) else x
    return sorted((tuple(fix(r[i]) for i in order) for r in data), key=repr)


@pytest.fixture(scope="module")
def db(sf_dir):
    con = duckdb.connect()
    for f in os.listdir(sf_dir):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{sf_dir}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(spark, db, sf_dir, name):
    got = QUERIES[name](spark, sf_dir)
    want = db.execute(ORACLES[name])
    columns = [c[0] for c in want.description]
    assert sorted(got.columns) == sorted(columns)
    a, b = rows(got.columns, [tuple(r) for r in got.collect()]), rows(columns, want.fetchall())
    assert len(a) == len(b) and a == b


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, sf_dir, name):
    assert QUERIES[name](spark, sf_dir).count() > 0


def test_citations_are_sought_in_whole_texts(spark, tmp_path):
    long = "word " * 40 + "[b.txt:3] and " + "[a.txt:99] at the end"
    docs = spark.createDataFrame([(1, long, "en", "a.txt", 10), (2, "short", "en", "b.txt", 100)], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = {(r.doc_id, r.cited, r.line, r.valid) for r in QUERIES["citation_validate"](spark, str(tmp_path)).collect()}
    assert got == {(1, "b.txt", 3, True), (1, "a.txt", 99, False), (1, "a.txt", 37, False), (2, "b.txt", 74, True)}


def test_every_hundredth_row_is_a_query(spark, sf_dir):
    got = {r.query_id for r in QUERIES["vector_topk_multi"](spark, sf_dir).collect()}
    assert got == {r.vec_id for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").where("vec_id % 100 = 0").collect()} and len(got) > 1
