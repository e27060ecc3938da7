import math
import random

import pytest
from pyspark.sql import functions as F

from corpusmill.operators import evaluate, fusion, graph, lexical, lookup, rules, sequence, sets, vectors
from corpusmill.sources import readers, writers

DOCS = [(1, "the king took the bread"), (2, "bread and wine"), (3, "the king"), (4, ""), (5, None), (6, "king king king")]


def docs(spark):
    return spark.createDataFrame(DOCS, "doc_id int, text string")


def ask(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts, 1)), "query_id int, text string")


def test_bm25_by_hand(spark):
    index = lexical.build_index(docs(spark), "doc_id", "text")
    got = {(r["query_id"], r["doc_id"]): r["score"] for r in lexical.search(index, ask(spark, "king", "king king"), "query_id", "text").collect()}
    avg, idf = (5 + 3 + 2 + 0 + 0 + 3) / 6, math.log((6 - 3 + 0.5) / 3.5 + 1)
    want = idf * 3 * 2.2 / (3 + 1.2 * (0.35 + 0.65 * 3 / avg))
    assert got[1, 6] == pytest.approx(want) and got[2, 6] == pytest.approx(2 * want)
    assert {d for q, d in got if q == 1} == {1, 3, 6}


def test_ties_follow_the_question_then_the_documents(spark):
    rows = spark.createDataFrame([(2, "b"), (1, "a"), (3, "a")], "doc_id int, text string")
    found = lexical.search(lexical.build_index(rows, "doc_id", "text"), ask(spark, "b a"), "query_id", "text").orderBy("rank").collect()
    assert [r["doc_id"] for r in found] == [2, 1, 3]


def test_phrase_boost_stays_within_the_window(spark):
    many = spark.createDataFrame([(i, f"red stone {i}" if i % 2 else f"stone red {i}") for i in range(200)], "doc_id int, text string")
    index = lexical.build_index(many, "doc_id", "text")
    plain = lexical.search(index, ask(spark, "red stone"), "query_id", "text", 150)
    boosted = lexical.search(index, ask(spark, "red stone"), "query_id", "text", 150, many).orderBy("rank").collect()
    assert plain.count() == 150 and len(boosted) == 150
    assert all(r["doc_id"] % 2 for r in boosted[:50]) and boosted[100]["doc_id"] >= 100


def test_empty_index_and_question(spark):
    index = lexical.build_index(docs(spark).limit(0), "doc_id", "text")
    assert index.stats.first()["n_docs"] == 0 and lexical.search(index, ask(spark, "king", "", "?"), "query_id", "text").count() == 0


def test_index_round_trip(spark, tmp_path):
    index = lexical.build_index(docs(spark), "doc_id", "text")
    lexical.save_index(index, str(tmp_path / "i"))
    back = lexical.load_index(spark, str(tmp_path / "i"))
    one, two = (sorted(map(tuple, lexical.search(i, ask(spark, "king bread"), "query_id", "text").collect())) for i in (index, back))
    assert one == two and one


def test_min_max_and_gate(spark):
    rows = spark.createDataFrame([(1, 1, 3.0, 1), (1, 2, 1.0, 2), (2, 1, 5.0, 1)], "query_id int, doc_id int, score double, rank int")
    norm = {(r["query_id"], r["doc_id"]): r["norm"] for r in fusion.min_max(rows).collect()}
    assert norm == {(1, 1): 1.0, (1, 2): 0.0, (2, 1): 1.0}
    opened = {r["query_id"]: r["open"] for r in fusion.gate(rows, ask(spark, "a b c d", "a b c d"), "query_id", "text").collect()}
    assert opened == {1: False, 2: True}
    assert fusion.clamp_top_k(None) == 5 and fusion.clamp_top_k(100) == 8 and fusion.clamp_top_k(6.9) == 6


def test_diagnostics_of_one_result(spark):
    rows = spark.createDataFrame([(1, 1, 0.0, 1)], "query_id int, doc_id int, score double, rank int")
    assert fusion.diagnostics(rows).first()["entropy"] == 0
    low = {r["query_id"]: r["low"] for r in fusion.low_confidence(rows, ask(spark, "a", "b"), "query_id").collect()}
    assert low == {1: True, 2: True}


def test_vectors_of_other_lengths_and_zeros(spark):
    rows = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, [1.0]), (4, None), (5, [2.0, 0.0])], "doc_id int, doc_vector array<double>")
    asked = spark.createDataFrame([(1, [1.0, 0.0])], "query_id int, query_vector array<double>")
    assert [(r["doc_id"], r["rank"]) for r in vectors.nearest(asked, rows, 5).orderBy("rank").collect()] == [(1, 1), (5, 2)]


def test_store_contract(spark):
    store = vectors.LexicalStore(lexical.build_index(docs(spark), "doc_id", "text"), docs(spark))
    assert not store.is_ready()
    store.init(), store.init()
    found = store.query(ask(spark, "king bread"), 2).orderBy("rank").collect()
    assert store.is_ready() and len(found) <= 2 and all(0 <= r["score"] <= 1 for r in found)


def test_islands_and_merges(spark):
    rows = spark.createDataFrame([("G", v, f"t{v}") for v in (1, 2, 4, 5, 6, 9)] + [("G", None, "x")], "b string, v int, t string")
    merged = sequence.merge_runs(rows, ["b"], "v", "t")
    assert sorted((r["first"], r["last"], r["text"]) for r in merged.filter("first is not null").collect()) == [(1, 2, "t1 t2"), (4, 6, "t4 t5 t6"), (9, 9, "t9")]
    listed = spark.createDataFrame([(1, 1, "G", 5, "a"), (1, 2, "G", 6, "b"), (1, 3, "G", 5, "c"), (1, 4, "H", 6, "d")], "q int, o int, b string, v int, t string")
    got = sequence.merge_in_order(listed, "q", "o", "v", ["b"], "t").orderBy("ord").collect()
    assert [r["text"] for r in got] == ["a b", "c", "d"]


def test_prefix_budget(spark):
    def kept(*lengths):
        rows = spark.createDataFrame([(1, i, "x" * n) for i, n in enumerate(lengths)], "g int, i int, t string")
        return [r["i"] for r in sequence.prefix_budget(rows, ["g"], ["i"], "t", 10).orderBy("i").collect()]

    assert kept(90, 3) == [0] and kept(15, 15) == [0, 1] and kept(15, 18, 3) == [0] and kept(0, 30) == [0, 1]


def test_frames_and_neighbours(spark):
    rows = spark.createDataFrame([("G", v, f"t{v}") for v in (1, 2, 3, 5)], "b string, v int, t string")
    got = {r["v"]: r["window_ids"] for r in sequence.frames(rows, ["b"], "v", "v", "t", 1).collect()}
    assert got == {1: [1, 2], 2: [1, 2, 3], 3: [2, 3, 5], 5: [3, 5]}
    keys = spark.createDataFrame([("G", 1, 10), ("G", 4, 20)], "b string, v int, ord int")
    assert sorted(r["v"] for r in sequence.neighbours(keys, rows, ["b"], "v").collect()) == [1, 2, 3, 5]


def test_greedy_merges(spark):
    rows = spark.createDataFrame([(1, 1, list("abc"), 0.5), (1, 2, list("abcd"), 0.4), (1, 3, list("xy"), 0.9)], "q int, o int, m array<string>, s double")
    got = sequence.merge_overlapping(rows, "q", "o", "m", "s").orderBy("rank").collect()
    assert [(list(r["m"]), r["s"]) for r in got] == [(["x", "y"], 0.9), (["a", "b", "c", "d"], 0.5)]


def test_first_wins_is_idempotent(spark):
    rows = spark.createDataFrame([(1, "A", 1), (1, "a", 2), (1, None, 3), (1, None, 4)], "q int, k string, o int")
    once = sequence.first_wins(rows, [F.upper("k")], "o")
    assert sorted(r["o"] for r in once.collect()) == [1, 3] == sorted(r["o"] for r in sequence.first_wins(once, [F.upper("k")], "o").collect())


def test_layer_texts(one):
    assert one(sequence.merge_texts(F.array(F.lit("a"), F.lit("ab"), F.lit("c"), F.lit("b")))) == "ab\nc"
    assert one(sequence.merge_texts(F.array().cast("array<string>"))) is None


def test_components_match_brute_force(spark):
    rng = random.Random(3)
    pairs = [(f"n{rng.randrange(60)}", f"n{rng.randrange(60)}") for _ in range(45)] + [("z1", f"z{i}") for i in range(2, 40)] + [(f"c{i}", f"c{i + 1}") for i in range(30)] + [("s", "s"), ("s", None)]
    root = {n: n for p in pairs for n in p if n}
    for _ in root:
        for a, b in pairs:
            if a and b:
                root[a] = root[b] = min(root[a], root[b])
    got = {r["node"]: r["root"] for r in graph.components(spark.createDataFrame(pairs, "a string, b string"), "a", "b").collect()}
    assert got == root


def test_components_of_nothing(spark):
    assert graph.components(spark.createDataFrame([], "a string, b string"), "a", "b").count() == 0


def test_expand_links(spark):
    edges = spark.createDataFrame([("A", "B", 11), ("A", "C", 10), ("A", "D", None), ("B", "E", 50), ("A", "E", 40), ("A", "A", 99)], "s string, t string, v int")
    primary = spark.createDataFrame([(1, "A"), (1, "B")], "q int, i string")
    assert [(r["t"], r["v"]) for r in graph.expand_links(primary, edges, "q", "i", "s", "t", "v").collect()] == [("E", 50)]


def test_fallback_chain(spark):
    keys = spark.createDataFrame([(1,), (2,), (2,), (3,)], "k int")
    a, b = spark.createDataFrame([(1, "a"), (2, "")], "k int, t string"), spark.createDataFrame([(1, "x"), (2, "b")], "k int, t string")
    got = sorted((r["k"], r["t"], r["source"]) for r in lookup.resolve(keys, [a, b], ["k"], "t").collect())
    assert got == [(1, "a", 1), (2, "b", 2), (2, "b", 2)]
    assert lookup.resolve(keys, [a, b], ["k"], "t", keep_missing=True).count() == 4


def test_morphology_priority(spark):
    words = spark.createDataFrame([("G", 1, "שמר", "H1", None), ("G", 2, "אחר", "H2", None), ("G", 3, "אחר", "H9", "kept"), ("G", 4, "גדל", None, None)], "b string, ord int, w string, s string, m string")
    tagged = spark.createDataFrame([("G", 1, "xx", "H1", "lemma"), ("G", 2, "שָׁמַר", "H1", "both"), ("G", 3, "אחר", "H7", "word"), ("G", 4, "גדל", "H8", "null lemma")], "b string, p int, w string, s string, m string")
    got = {r["ord"]: r["m"] for r in lookup.match_morphology(words, tagged, ["b"], "w", "s", "p", "m").collect()}
    assert got == {1: "both", 2: "word", 3: "kept", 4: "null lemma"}


def test_upsert(spark):
    old = spark.createDataFrame([(1, "a", "e"), (2, "b", "f"), (None, "n", "n")], "k int, t string, e string")
    new = spark.createDataFrame([(2, "B", None, 1), (3, "C", "g", 1), (3, "CC", "h", 2), (None, "N", None, 1)], "k int, t string, e string, o int")
    got = {(r["k"], r["t"], r["e"]) for r in sets.upsert(old, new, ["k"], ["t"], ["e"], "o").collect()}
    assert got == {(1, "a", "e"), (2, "B", "f"), (3, "CC", "h"), (None, "N", "n")}


def test_guards_and_lists(spark):
    asked = ask(spark, "the covenant now", "nothing")
    listed = spark.createDataFrame([(1, "a", 1, "red river"), (1, "p", 2, "red river"), (1, "b", 3, "hill"), (2, "a", 1, "red river")], "query_id int, item string, place int, text string")
    guards = spark.createDataFrame([(1, ["covenant"], ["p", "q"], ["river"])], "rule int, keywords array<string>, items array<string>, excludes array<string>")
    got = sorted((r["query_id"], r["place"], r["item"]) for r in rules.guard(asked, listed, guards).collect())
    assert got == [(1, 1, "p"), (1, 2, "q"), (1, 3, "b"), (2, 1, "a")]
    lists = spark.createDataFrame([(1, ["covenant"], ["z"], "replace"), (2, ["now"], ["y"], "prepend")], "rule int, keywords array<string>, items array<string>, mode string")
    got = sorted((r["query_id"], r["place"], r["item"]) for r in rules.curated(asked, listed, lists).collect())
    assert got == [(1, 1, "z"), (2, 1, "a")]


def test_prefix_relevance(spark):
    found = spark.createDataFrame([(1, "JHN 3:15-17", 1), (1, "JHN 3:16-17", 2), (1, "JHN 3:160", 3)], "query_id int, item string, rank int")
    want = spark.createDataFrame([(1, "JHN 3:16")], "query_id int, item string")
    marked = evaluate.relevance(found, want)
    assert {r["rank"]: r["hit"] for r in marked.collect()} == {1: False, 2: True, 3: False}
    row = evaluate.ranking_metrics(marked).first()
    assert (row["hit_at_1"], row["hit_at_5"], row["mrr"], row["precision_at_5"]) == (0, 1, 0.5, pytest.approx(1 / 3, abs=1e-6))


def test_cross_reference_lines(spark):
    lines = [("From Verse\tTo Verse\tVotes",), ("Gen.1.1\tJohn.1.1-John.1.3\t52",), ("Gen.1.1-Gen.1.2\tExod.1.1\tx",), ("bad",), ("Gen.1.1\tNope",)]
    got = sorted(map(tuple, readers.cross_reference_lines(spark.createDataFrame(lines, "value string")).collect()))
    assert got == [("GEN 1:1", "EXO 1:1", None), *[("GEN 1:1", f"JHN 1:{v}", 52) for v in (1, 2, 3)], ("GEN 1:2", "EXO 1:1", None)]


def test_readers_of_files(spark, tmp_path):
    (tmp_path / "BSB-2JN.json").write_text('{"1": {"1": "a", "2": "b"}}')
    assert sorted(map(tuple, readers.translation_books(spark, str(tmp_path / "*.json")).collect())) == [("BSB", "2JN", 1, 1, "a"), ("BSB", "2JN", 1, 2, "b")]
    (tmp_path / "v.txt").write_text('﻿Book;Chapter;Verse;Text\nGEN;1;1;"In; the [note]beginning"\n')
    assert [tuple(r) for r in readers.verse_table(spark, str(tmp_path / "v.txt"), "KJV").collect()] == [("KJV", "GEN", 1, 1, "In; the beginning")]
    (tmp_path / "i-2JN.json").write_text('{"1": {"1": [{"w": "a", "i": "x"}, {"w": "b", "i": null}]}}')
    assert [tuple(r) for r in readers.layer_words(spark, str(tmp_path / "i-*.json"), "w:string,i:string").orderBy("at").collect()] == [("2JN", 1, 1, 1, "a", "x"), ("2JN", 1, 1, 2, "b", None)]
    osis = spark.createDataFrame([('<verse osisID="Gen.1.1"><w lemma="b/7225" morph="HR/Ncfsa">ab/cd</w> <w lemma="x">e</w></verse>',)], "text string")
    assert [tuple(r) for r in readers.osis_words(osis).orderBy("at").collect()] == [("Gen", 1, 1, 1, "abcd", "H7225", "HR/Ncfsa"), ("Gen", 1, 1, 2, "e", None, None)]
    assert readers.json_table(spark, [str(tmp_path / "none.json")], spark.range(1).schema).count() == 0


def test_wrapped_and_nested_json(spark):
    wrapped = spark.createDataFrame([('var d = {"H1": {"short": "a"}}; x',), ("broken",)], "text string")
    assert [r["value"] for r in readers.wrapped_json(wrapped, "map<string,struct<short:string>>").collect()][1] is None
    nested = spark.createDataFrame([('{"books":[{"name":"Genesis","chapters":[{"chapter":1,"verses":[{"verse":1,"text":"a"}]}]}]}',)], "text string")
    assert [tuple(r) for r in readers.nested_books(nested).collect()] == [("Genesis", 1, 1, "a")]


def test_envelopes(spark, tmp_path):
    path = str(tmp_path / "t")
    assert not writers.unchanged(spark, path, "h")
    writers.write_envelope(spark, spark.range(3), path, writers.Envelope("v1", "test", "h"))
    assert writers.unchanged(spark, path, "h") and writers.read_envelope(spark, path, "v1").count() == 3
    with pytest.raises(ValueError, match="version"):
        writers.read_envelope(spark, path, "v2")
    writers.write_partitioned(spark.createDataFrame([("A", 1), ("B", 2)], "b string, v int"), str(tmp_path / "p"), ["b"], ["v"])
    assert spark.read.parquet(str(tmp_path / "p")).filter("b = 'A'").count() == 1
    body, table = writers.report(spark.range(2), "Two")
    assert "| 1 |" in table and '"rows"' in body
