"""A block's candidates travel as one row of lists a question, and are ranked as rows would be."""

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from corpusmill.operators import lexical


def test_a_block_hands_on_one_row_a_question(spark, monkeypatch):
    monkeypatch.setattr(lexical, "LEAST_DOCS", 100)
    docs = spark.createDataFrame([(i, f"the v{i % 11} w{i % 7}") for i in range(600)], "doc_id int, text string")
    asked = spark.createDataFrame([(i, f"v{i % 11} the w{i % 7}") for i in range(77)], "query_id int, text string")
    terms = lexical.question_terms(asked, "query_id", "text").groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("first_at", "term", "times"))).alias("terms"))
    for keep in (True, False):
        found = lexical.best_documents(lexical.build_index(docs, "doc_id", "text", keep=keep), terms, 20)
        assert found.count() <= 77 * 4  # four blocks; with a row for each candidate 77 * 20 at least
        assert found.filter(F.size("score") > 20).isEmpty()


@pytest.mark.parametrize("kind", ["int", "string"])
@pytest.mark.parametrize("batch", [3, 10_000])
def test_lists_are_ranked_as_rows_are(spark, kind, batch):
    """Lists of a question in several batches, equal scores, null orders and a null question."""
    random = np.random.default_rng(5)
    rows = []
    for query in [None, *range(12)]:
        ids = random.permutation(200).tolist()
        for part in range(5):
            own = ids[part * 40 : part * 40 + int(random.integers(1, 40))]
            value = (random.integers(1, 6, len(own)) + random.uniform(-1e-11, 1e-11, len(own))).tolist()
            rows.append((query, [str(i) for i in own], value, random.integers(0, 2, len(own)).tolist(), [None if i == 7 else i for i in own]))
    found = spark.createDataFrame(rows, "query_id int, doc_id array<string>, score array<double>, first_at array<int>, ord array<int>")
    found = found.withColumn("doc_id", F.col("doc_id").cast(f"array<{kind}>"))
    each = found.select("query_id", F.inline(F.arrays_zip("doc_id", "score", "first_at", "ord")))
    want = each.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.round("score", 9).desc(), "first_at", "ord"))).filter("rank <= 10")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        got = lexical.ranked_lists(found, 10)
        assert got.select("query_id", "doc_id", "score", "rank").exceptAll(want.select("query_id", "doc_id", "score", "rank")).isEmpty()
        assert got.count() == want.count() and dict(got.dtypes)["doc_id"] == kind
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_kept_terms_are_one_string_a_document(spark):
    docs = spark.createDataFrame([(1, "Ship, ship of the king"), (2, "…"), (3, None), (4, "")], "doc_id int, text string")
    kept = lexical.build_index(docs, "doc_id", "text", keep=True).documents
    assert dict(kept.dtypes)["words"] == "string"
    held = {r["doc_id"]: (r["words"] and dict(zip(r["words"].split(" "), r["tfs"], strict=True)), r["dl"]) for r in kept.collect()}
    assert held == {1: ({"ship": 2, "of": 1, "the": 1, "king": 1}, 5), 2: (None, 0), 3: (None, 0), 4: (None, 0)}
