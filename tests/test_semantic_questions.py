"""Questions without a vector lose their candidates in the semantic rank, so they aren't searched."""

import duckdb
import pytest
from pyspark.sql import functions as F

from corpusmill.plans import retrieval_queries as rq
from corpusmill.plans.queries import oracle_sql, queries


@pytest.mark.parametrize("name", ["b11_semantic_rank", "b12_rrf"])
def test_only_questions_with_a_vector_are_searched(spark, monkeypatch, tmp_path, name):
    spark.range(1, 61).select(F.col("id").cast("int").alias("doc_id"), F.concat_ws(" ", F.lit("the king"), F.concat(F.lit("w"), F.col("id") % 7), F.concat(F.lit("v"), F.col("id") % 11)).alias("text")).coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    spark.range(40).select(F.format_string("c%03d", "id").alias("cluster_id"), F.concat(F.lit("the w"), F.col("id") % 7, F.lit(" v"), F.col("id") % 11).alias("cluster_label")).coalesce(1).write.parquet(f"{tmp_path}/tsk_clusters.parquet")
    vectors = [(i, [float(i % 5), float(i % 13), 1.0]) for i in [1, 2, 3, 9, 10, 17, 50, 105, 120, 140, 999]]  # six are questions
    spark.createDataFrame(vectors, "vec_id int, embedding array<float>").coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    asked = []

    def search(index, questions, *rest, **more):
        asked.append(questions.count())
        return real(index, questions, *rest, **more)

    real = rq.search
    monkeypatch.setattr(rq, "search", search)
    got = queries()[name](spark, str(tmp_path))
    assert asked == [6]
    for table in ("documents", "tsk_clusters", "embeddings"):
        duckdb.execute(f"CREATE OR REPLACE VIEW {table} AS SELECT * FROM '{tmp_path}/{table}.parquet/*.parquet'")
    want = duckdb.sql(oracle_sql()[name])
    rows = [tuple(r[c] for c in want.columns) for r in got.collect()]
    assert sorted(rows, key=str) == sorted(want.fetchall(), key=str) and len(rows) > 100
