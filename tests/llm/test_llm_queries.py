"""Registered queries of the training-data operators: checking SQL, and the pipeline against its parts."""

import duckdb
import pytest

import __spark_entry__ as contract
import corpus_pipeline
from tabulon.llm import oracles, queries
from tabulon.plans.views import TABLES
from tests.llm import helpers
from tests.test_queries import cells


@pytest.mark.parametrize("name", sorted(oracles.SQL))
def test_query_equals_sql(spark, sf, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    df = queries.REGISTRY[name](spark, sf)
    cursor = con.execute(oracles.SQL[name])
    columns = [d[0] for d in cursor.description]
    assert sorted(df.columns) == sorted(columns)
    assert cells(df.columns, df.collect()) == cells(columns, cursor.fetchall())


def test_removed_bytes_of_the_whole_table(spark, sf):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    got = queries.op3_suffix_array_dedup(spark, sf).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()
    assert sorted((tuple(r) for r in got), key=str) == helpers.repeats(docs, 50)


def test_all_are_registered():
    names = contract.queries()
    assert all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 14)) and "pipeline" in names


def test_pipeline_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    for number, (_, stage) in enumerate(corpus_pipeline.STAGES):
        before = {r["doc_id"]: r["text"] for r in docs.collect()} if number < 4 else None
        made = stage(spark, docs, sf)
        if number == 4:
            assert {r["doc_id"] for r in made.collect()} == {r["doc_id"] for r in docs.collect()}
            break
        assert made.columns == columns
        docs = made.checkpoint()
        after = {r["doc_id"]: r["text"] for r in docs.collect()}
        assert set(after) <= set(before)
        if number == 1:
            parts = helpers.components(list(before.items()), 5, 80)
            assert set(after) == {d for d in before if parts[d][1] == d}
        if number == 2:
            removed = {d: (n, gone) for d, n, gone, _, _ in helpers.repeats(list(before.items()), 50)}
            assert set(after) == set(before)
            assert all(after[d] == before[d] for d in after if removed[d][1] == 0)
            assert all(len(after[d].encode()) <= removed[d][0] - removed[d][1] for d in after)


def test_pipeline_takes_nulls_and_clashing_columns(spark, sf):
    docs = spark.createDataFrame(
        [(None, None, None, None, None), (1, "", "en", "s", 0), (2, "word " * 30_000, None, "s", 150_000), (2, "word " * 30_000, None, "s", 150_000)],
        "doc_id long, text string, lang string, source string, n_chars long").selectExpr("*", "1 as score", "'x' as token", "2 as chunk", "0 as component_id")
    for number, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, sf).checkpoint()
        assert number == 4 or docs.columns == corpus_pipeline.COLUMNS
