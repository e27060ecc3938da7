"""The retrieval plans read their questions once, and derived inputs occupy all cores."""

import pytest
from pyspark.sql import functions as F

from corpusmill.operators import lexical
from corpusmill.plans.fallback import fallback_retrieve
from corpusmill.plans.pipeline import Corpus, retrieve
from corpusmill.session import cut_lineage, spread


@pytest.mark.parametrize("plan", [retrieve, fallback_retrieve])
def test_questions_are_read_once(spark, plan):
    seen = spark.sparkContext.accumulator(0)

    def count(text):
        seen.add(1)
        return text

    verses = spark.createDataFrame([(f"GEN 1:{i}", "GEN", 1, i, f"the king of word{i}", "BSB") for i in range(1, 9)], "doc_id string, book string, chapter int, verse int, text string, translation string")
    guards = spark.createDataFrame([(1, ["king"], ["GEN 1:2"], ["word5"])], "rule int, keywords array<string>, items array<string>, excludes array<string>")
    lists = spark.createDataFrame([(1, ["ship"], ["GEN 1:3"], "prepend")], "rule int, keywords array<string>, items array<string>, mode string")
    asked = spark.createDataFrame([("a", "the king of word4"), ("b", "a ship"), ("c", "Genesis 1:4")], "query_id string, text string")
    questions = asked.withColumn("text", F.udf(count, "string").asNondeterministic()("text"))
    found = plan(questions, Corpus(verses, lexical.build_index(verses, "doc_id", "text"), guards=guards, lists=lists)).collect()
    assert {r["query_id"] for r in found} == {"a", "b", "c"}
    assert seen.value == 3


def test_a_derived_input_is_spread(spark):
    rows = cut_lineage(spark.range(100).coalesce(1))
    assert spread(rows, derived=True).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    assert spread(rows).rdd.getNumPartitions() == 1
