"""The index kept as documents with their terms, compared with the index by terms."""

import pytest
from pyspark.sql import functions as F

from corpusmill.operators import lexical

TEXTS = ["The king's ship", "ship", None, "", "  ", "ÄB_c 12 ab\tKing", "kingK İx", "end", "start of the the river", "…", "naïve the king, the ship & the river"]


def _rows(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize("chunk", [4, 8 << 20])
def test_a_kept_index_has_the_same_tables(spark, monkeypatch, chunk):
    monkeypatch.setattr(lexical, "CHUNK_BYTES", chunk)
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id int, text string").coalesce(1)
    plain, kept = lexical.build_index(docs, "doc_id", "text"), lexical.build_index(docs, "doc_id", "text", keep=True)
    assert kept.documents is not None
    for name in ("postings", "terms", "stats"):
        a, b = getattr(plain, name), getattr(kept, name)
        assert _rows(a) == _rows(b.select(*a.columns)) and a.dtypes == b.dtypes


@pytest.mark.parametrize("extra", [(3, "ship ship"), (None, "ship")])
def test_ids_that_repeat_or_are_null_are_counted_as_before(spark, extra):
    docs = spark.createDataFrame([*enumerate(TEXTS), extra], "doc_id int, text string")
    plain, kept = lexical.build_index(docs, "doc_id", "text"), lexical.build_index(docs, "doc_id", "text", keep=True)
    assert kept.documents is None
    assert all(_rows(getattr(plain, n)) == _rows(getattr(kept, n)) for n in ("postings", "terms", "stats"))


def test_a_batch_is_searched_without_an_exchange_of_postings(spark, monkeypatch):
    """Several blocks in one task, and several passes, give what the index by terms gives, ties included."""
    monkeypatch.setattr(lexical, "LEAST_DOCS", 100)
    monkeypatch.setattr(lexical, "DOCS_A_BLOCK", 50)
    monkeypatch.setattr(lexical, "QUESTIONS_A_PASS", 20)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 30)
    try:
        docs = spark.createDataFrame([(600 - i, " ".join(["the"] * (1 + i % 3) + [f"w{i % 7}", f"v{i % 11}"] + ["x"] * (i % 5))) for i in range(600)], "doc_id int, text string")
        asked = spark.createDataFrame([(i, f"v{i % 11} the w{i % 7} the" if i % 4 else f"w{i % 7} the nowhere") for i in range(90)], "query_id int, text string")
        plain, kept = lexical.build_index(docs, "doc_id", "text"), lexical.build_index(docs, "doc_id", "text", keep=True)
        a, b = (lexical.search(x, asked, "query_id", "text", 6, docs).withColumn("score", F.round("score", 9)) for x in (plain, kept))
        assert _rows(a) == _rows(b) and b.count() == 90 * 6
        alone = lexical.question_terms(asked, "query_id", "text").groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("first_at", "term", "times"))).alias("terms"))
        found = lexical.best_documents(kept, alone, 6)
        assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_an_empty_table_is_kept(spark):
    docs = spark.createDataFrame([], "doc_id int, text string")
    asked = spark.createDataFrame([(1, "king")], "query_id int, text string")
    assert lexical.search(lexical.build_index(docs, "doc_id", "text", keep=True), asked, "query_id", "text", 3, docs).count() == 0
