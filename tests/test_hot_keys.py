"""Operators with a third of all rows on one key, nulls and ties, compared with brute force."""

import random

import pytest
from pyspark.sql import functions as F

from corpusmill.functions import editions
from corpusmill.functions import text as tx
from corpusmill.operators import graph, lexical, ranking, rules, sequence
from corpusmill.plans.fallback import fallback_retrieve
from corpusmill.plans.pipeline import Corpus
from corpusmill.sources import tables


def test_places_in_parts_are_those_of_one_sort(spark):
    rng = random.Random(1)
    rows = [("hot" if rng.random() < 0.4 else f"k{rng.randrange(9)}", rng.randrange(5), f"x{i:04d}") for i in range(900)] + [(None, 1, "x"), (None, 2, "y")]
    df = spark.createDataFrame(rows, "k string, v int, i string")
    got = {(r["k"], r["i"]): r["place"] for r in ranking.place_in_parts(df, ["k"], [(F.col("v"), True), (F.substring("i", 1, 3), False)], [F.col("i")]).collect()}
    for key in {k for k, *_ in rows}:
        own = sorted((r for r in rows if r[0] == key), key=lambda r: (-r[1], r[2]))
        assert [got[key, r[2]] for r in own] == list(range(1, len(own) + 1))


def test_strongest_links_of_a_hot_source(spark):
    rng = random.Random(2)
    rows = [("hot" if i % 3 == 0 else f"s{i % 50}", f"t{rng.randrange(200):03d}", rng.choice([None, 1, 7, 7, 30])) for i in range(1_500)]
    best = {}
    for s, t, v in rows:
        best[s, t] = max((x for x in (best.get((s, t)), v) if x is not None), default=None)
    df = spark.createDataFrame(rows, "s string, t string, v int")
    every = {(r["s"], r["t"]): (r["v"], r["place"]) for r in graph.strongest_links(df, "s", "t", "v").collect()}
    assert {k: v for k, (v, _) in every.items()} == best
    for s in {s for s, _ in best}:
        own = sorted((t for x, t in best if x == s), key=lambda t: (-(best[s, t] or 0), t))
        assert [every[s, t][1] for t in own] == list(range(1, len(own) + 1))
    few = {(r["s"], r["t"]): r["place"] for r in graph.strongest_links(df, "s", "t", "v", 4).collect()}
    assert few == {k: p for k, (_, p) in every.items() if p <= 4}


@pytest.mark.parametrize("kind", ["long", "string", "timestamp"])
def test_budgets_of_a_hot_group(spark, kind):
    rng = random.Random(3)
    rows = [("hot" if i % 3 == 0 else f"g{i % 40}", i, "x" * rng.choice([0, 3, 30, 300])) for i in range(1_200)] + [(None, 5_000, "x" * 900), (None, 5_001, "x"), ("one", 6_000, None)]
    df = spark.createDataFrame(rows, "g string, i long, t string")
    order = {"long": F.col("i"), "string": F.format_string("%06d", "i"), "timestamp": F.timestamp_seconds("i")}[kind]
    got = sorted(r["i"] for r in sequence.prefix_budget(df.withColumn("o", order), ["g"], ["o"], "t", 250).collect())
    want = []
    for group in {g for g, *_ in rows}:
        used = 0
        for k, (_, i, t) in enumerate(sorted((r for r in rows if r[0] == group), key=lambda r: r[1])):
            used += -(-len(t or "") // 3)
            if used > 250 and k:
                break
            want.append(i)
    assert got == sorted(want)


def test_components_around_a_hub(spark):
    rows = [("hub", f"n{i:04d}") for i in range(600)] + [(f"a{i:03d}", f"a{i + 1:03d}") for i in range(60)] + [("z", "z"), ("hub", "hub"), (None, "q")]
    got = {r["node"]: r["root"] for r in graph.components(spark.createDataFrame(rows, "a string, b string"), "a", "b").collect()}
    assert got == {"hub": "hub"} | {f"n{i:04d}": "hub" for i in range(600)} | {f"a{i:03d}": "a000" for i in range(61)} | {"z": "z"}


TOPIC_RULES = [("royal", "king", 0.9), ("royal", "CROWN", 0.7), ("river", "the river", 1.4), ("odd", "c+", 0.6), ("weak", "king", 0.1), ("none", "zebra", 1.0)]


def test_tags_by_words_and_phrases(spark):
    texts = [(1, "The KING by the river"), (2, "kingdom of rivers"), (3, None), (4, ""), (5, "crown, c+ b"), (6, "crown king")] + [(100 + i, "king") for i in range(50)]
    df = spark.createDataFrame([(*t, "z") for t in texts], "id int, text string, topic_id string")
    rule = spark.createDataFrame(TOPIC_RULES, "topic_id string, keyword string, confidence double")
    got = {(r["id"], r["topic_id"]): (r["confidence"], r["place"]) for r in rules.tag_rows(df, rule, "id", "text").collect()}
    assert {k: v for k, v in got.items() if k[0] < 100} == {(1, "river"): (1.0, 1), (1, "royal"): (0.9, 2), (5, "royal"): (0.7, 1), (6, "royal"): (0.9, 1)}
    assert sum(k[0] >= 100 for k in got) == 50 and rules.tag_rows(df.limit(0), rule, "id", "text").count() == 0
    assert {tuple(r) for r in rules.items_of_topics(rules.tag_rows(df, rule, "id", "text"), "id").filter("id < 100").collect()} == {("river", 1), ("royal", 1), ("royal", 5), ("royal", 6)}


def test_topics_by_words_then_by_vectors(spark):
    asked = spark.createDataFrame([(1, "king and covenant", [1.0, 0.0]), (2, "nothing shared", [0.0, 1.0]), (3, None, [0.1, 0.1]), (4, "bread one two three", None)], "query_id int, text string, query_vector array<double>")
    topics = spark.createDataFrame([("a", ["king", "covenant", "king"], [1.0, 0.0]), ("b", ["king", "x1x", "x2x", "x3x", "x4x"], [0.0, 0.9]), ("c", ["bread", "p1p", "p2p", "p3p"], [0.5, 0.5]), ("d", [], [0.0, 0.2])], "topic_id string, words array<string>, topic_vector array<double>")
    got = {(r["query_id"], r["topic_id"]): (round(r["score"], 6), r["place"]) for r in rules.detect_topics(asked, topics).collect()}
    assert got == {(1, "a"): (1.0, 1), (2, "b"): (0.9, 1), (2, "c"): (0.5, 2), (4, "c"): (0.25, 1)}


def test_a_stored_index_is_read_in_its_terms_partitions(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"w{i % 97} common") for i in range(500)], "doc_id int, text string")
    lexical.save_index(lexical.build_index(docs, "doc_id", "text"), str(tmp_path / "i"))
    asked = spark.createDataFrame([(1, "w5"), (2, "w6 w7")], "query_id int, text string")
    found = lexical.search(lexical.load_index(spark, str(tmp_path / "i")), asked, "query_id", "text", 3)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert any("PartitionFilters: [" in x and "bucket" in x.partition("PartitionFilters: [")[2].partition("]")[0] for x in plan.split("\n"))
    assert {(r["query_id"], r["doc_id"] % 97) for r in found.collect()} <= {(1, 5), (2, 6), (2, 7)} and found.count() == 6


def test_fallback_plan(spark):
    verses = spark.createDataFrame([("GEN 1:1", "GEN", 1, 1, "in the beginning light"), ("GEN 1:2", "GEN", 1, 2, "the waters light"), ("GEN 1:3", "GEN", 1, 3, "let there be light"), ("JHN 3:16", "JHN", 3, 16, "so loved")], "doc_id string, book string, chapter int, verse int, text string").withColumn("translation", F.lit("BSB"))
    corpus = Corpus(verses, lexical.build_index(verses, "doc_id", "text"))
    asked = spark.createDataFrame([(1, "who made light"), (2, "covenant and John 3:16"), (3, "John 3:16 and Genesis 1:2"), (4, "none"), (5, None)], "query_id int, text string")
    first = spark.createDataFrame([(1, ["covenant"], ["GEN 1:3", "EXO 9:9"])], "rule int, keywords array<string>, items array<string>")
    got = {}
    for r in fallback_retrieve(asked, corpus, None, first).orderBy("query_id", "place").collect():
        got.setdefault(r["query_id"], []).append(r["item"])
    assert set(got[1]) == {"GEN 1:1", "GEN 1:2", "GEN 1:3"} and got[2] == ["GEN 1:3", "JHN 3:16"] and got[3] == ["JHN 3:16", "GEN 1:2"] and 4 not in got and 5 not in got
    corpus.guards = spark.createDataFrame([(1, ["light"], ["JHN 3:16"], ["waters"])], "rule int, keywords array<string>, items array<string>, excludes array<string>")
    guarded = [r["item"] for r in fallback_retrieve(asked, corpus).filter("query_id = 1").orderBy("place").collect()]
    assert guarded[0] == "JHN 3:16" and set(guarded[1:]) == {"GEN 1:1", "GEN 1:3"}


def test_translations(one):
    for given, want in ((None, "BSB"), ("", "BSB"), ("   ", "BSB"), ("NIV", "BSB"), ("BS", "BSB"), ("kjv", "KJV"), ("  Web ", "WEB"), ("NHEB", "NHEB"), ("aSv", "ASV")):
        assert one(editions.allowed_translation(F.lit(given).cast("string"))) == want
    assert one(editions.translation_alias(F.lit(" niv "))) == "NIV" and one(editions.translation_alias(F.lit("x"), {"X": "BSB"})) == "BSB"


def test_settings_and_retries(one):
    assert one(editions.number_or(F.lit("  "), 3.0)) == 3 and one(editions.number_or(F.lit("1e2"), 3.0)) == 100 and one(editions.number_or(F.lit("Infinity"), 3.0)) == 3
    assert one(editions.flag(F.lit(None).cast("string"), True)) and not one(editions.flag(F.lit("true"), True))
    assert one(editions.retry_delays(150, 4, 2_000)) == [150, 300, 600] and one(editions.retry_delays(150, 0, 2_000)) == []
    assert one(editions.allowed_origin(F.lit("http://localhost:3000"), ["https://a.b"], True)) and one(editions.allowed_origin(F.lit("http://localhost:3000"), [])) is None


def test_nested_content():
    assert tables.flat_text({"children": ["a", {"content": [{"text": "b"}, None, ["c"]]}, {"text": "d", "content": "x"}]}) == "abcd"
    deep = "x"
    for _ in range(5_000):
        deep = [deep]
    assert tables.flat_text(deep) == "x" and tables.flat_text(None) == ""


def test_hashed_vectors(spark):
    rows = spark.createDataFrame([(1, "a b a"), (2, "b a a!"), (3, ""), (4, None)], "id int, text string")
    got = {r["id"]: r["vector"] for r in tx.hashed_vectors(rows, "id", "text", 16).collect()}
    assert set(got) == {1, 2} and got[1] == got[2] and len(got[1]) == 16
