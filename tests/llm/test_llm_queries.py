"""Queries against their SQL, and the pipeline stage by stage."""

import duckdb
import pytest

import corpus_pipeline
from pathloom.llm import common, queries

TABLES = "documents embeddings pages benchmark labels conversations".split()
SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_oracle(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    got = queries.QUERIES[name](spark, SMALL)
    cols = sorted(got.columns)
    want = con.execute(f"SELECT {', '.join(cols)} FROM ({queries.ORACLES[name]})").fetchall()
    key = lambda r: tuple((x is None, str(x)) for x in r)
    assert sorted(map(tuple, got.select(*cols).collect()), key=key) == sorted(want, key=key)


def test_stages_keep_the_columns_and_follow_each_other(spark):
    docs = common.table(spark, SMALL, "documents")
    columns, before = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES:
        docs = common.stored(stage(spark, docs, SMALL))
        if name != "packing":
            assert docs.columns == columns and docs.count() <= before and docs.filter("doc_id is null").count() == 0
            before = docs.count()
            kept = {r.doc_id for r in docs.select("doc_id").collect()}
    assert {r.doc_id for r in docs.collect()} == kept


def test_stages_take_odd_rows(spark, make, odd_rows):
    docs = make(odd_rows)
    for _, stage in corpus_pipeline.STAGES:
        docs = common.stored(stage(spark, docs, SMALL))
    assert docs.filter("doc_id is null").count() >= 1
    docs = make([])
    for _, stage in corpus_pipeline.STAGES:
        docs = common.stored(stage(spark, docs, SMALL))
    assert docs.count() == 0
