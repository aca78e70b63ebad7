"""The registered queries and the pipeline on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from hushtext.llm.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_queries_equal_sql(spark, name):
    con = duckdb.connect()
    for table in ("pages", "embeddings", "documents", "benchmark"):
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    rows = QUERIES[name](spark, SF)
    expected = con.sql(ORACLE_SQL[name])
    assert sorted(rows.columns) == sorted(expected.columns)
    names = sorted(rows.columns)
    got = sorted(map(repr, (tuple(r[c] for c in names) for r in rows.collect())))
    assert got == sorted(map(repr, expected.select(*[f'"{c}"' for c in names]).fetchall()))


def test_every_query_is_registered():
    assert {f"op{n}" for n in range(1, 14)} == {q.split("_")[0] for q in QUERIES}
    assert set(QUERIES) | {"pipeline"} <= set(entry.queries())


def test_pipeline_keeps_the_columns_of_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "near_duplicates", "personal_data", "source_mix", "sentence_pieces"]
    rows = corpus_pipeline.run(spark, SF).collect()
    assert rows and all(r.restored for r in rows)
    assert {r.doc_id for r in rows} <= {r.doc_id for r in docs.select("doc_id").collect()}


@pytest.mark.parametrize("stage", corpus_pipeline.STAGES[1:4], ids=lambda s: s[0])
def test_stages_on_an_empty_table(spark, stage):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = stage[1](spark, docs.limit(0), SF)
    assert out.columns == docs.columns and out.count() == 0
