"""The pipeline's stages one after another on the smallest tables, and the queries' SQL."""

import os

import duckdb
import pytest

import corpus_pipeline
from strata.llm import entries, toxicity
from strata.llm.tables import materialize

DIR = os.environ.get("STRATA_TEST_DIR", "/root/testdata/sf0.001")


def test_stages(spark):
    docs = entries.table(spark, DIR, "documents")
    model = toxicity.train(docs, entries.table(spark, DIR, "labels"))
    rejected = {r["doc_id"] for r in toxicity.score_documents(docs, model).where("rejected").collect()}
    seen = {r["doc_id"] for r in docs.collect()}
    columns = docs.columns
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before, docs = docs, materialize(stage(spark, docs, DIR), f"stage-{k}")
        if name != "encode":
            assert docs.columns == columns, name
        ids = {r["doc_id"] for r in docs.select("doc_id").collect()}
        if name == "toxicity":
            assert ids == seen - rejected
        elif name == "exact dedup":
            assert ids == {r["doc_id"] for r in _exact(before)}
        elif name == "encode":
            assert docs.count() == before.count()
        assert ids <= seen
        seen = ids


def _exact(docs):
    best = {}
    for r in docs.collect():
        key = "".join(c for c in r["text"] or "" if c not in " \t\n\x0b\x0c\r")
        if key not in best or (-len(r["text"] or ""), r["doc_id"]) < (-len(best[key]["text"] or ""), best[key]["doc_id"]):
            best[key] = r
    return best.values()


@pytest.mark.parametrize("name", entries.ORACLE_SQL)
def test_sql(spark, name):
    con = duckdb.connect()
    for file in os.listdir(DIR):
        con.execute(f"CREATE VIEW {file.split('.')[0]} AS SELECT * FROM '{DIR}/{file}'")
    expected = con.execute(entries.ORACLE_SQL[name])
    columns = [c[0] for c in expected.description]
    got = entries.QUERIES[name](spark, DIR)
    assert sorted(got.columns) == sorted(columns)
    assert sorted(map(repr, (tuple(r[c] for c in columns) for r in got.collect()))) == sorted(map(repr, expected.fetchall()))
