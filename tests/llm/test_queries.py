"""The registered queries and the pipeline over the smallest shared tables."""

import duckdb
import pytest

import corpus_pipeline
from stratalog.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.CHECK_SQL))
def test_query_equals_its_sql(spark, name):
    db = duckdb.connect()
    for t in ("documents", "embeddings", "labels", "benchmark"):
        db.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got = queries.QUERIES[name](spark, SF).toPandas()
    want = db.sql(queries.CHECK_SQL[name]).df()
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    a, b = (x[cols].astype(str).sort_values(cols, ignore_index=True) for x in (got, want))
    assert a.equals(b)


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, n = docs.columns, docs.count()
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, SF)
        if k < 4:
            docs = docs.cache()
            assert docs.columns == columns
            left = docs.count()
            assert 0.5 * n <= left <= n
    assert docs.select("doc_id").distinct().count() == left
