"""The search by blocks of documents, compared with brute force."""

import math
from collections import Counter

from pyspark.sql import functions as F

from corpusmill.operators import lexical


def test_pairs_of_questions_and_documents_are_never_rows(spark, monkeypatch):
    """Many questions share a word with all documents: blocks, passes and equal questions give what brute force gives."""
    monkeypatch.setattr(lexical, "LEAST_DOCS", 100)
    monkeypatch.setattr(lexical, "QUESTIONS_A_PASS", 20)
    texts = {i: " ".join(["the"] * (1 + i % 3) + [f"w{i % 7}", f"v{i % 11}"] + ["x"] * (i % 5)) for i in range(600)}
    asked = {i: f"v{i % 11} the w{i % 7} the" if i % 4 else f"w{i % 7} the nowhere" for i in range(90)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id int, text string")
    index = lexical.build_index(docs, "doc_id", "text")
    questions = spark.createDataFrame(list(asked.items()), "query_id int, text string")
    words = {d: t.split() for d, t in texts.items()}
    df = Counter(w for t in words.values() for w in set(t))
    average = sum(map(len, words.values())) / len(words)
    want = set()
    for q, text in asked.items():
        terms = text.split()
        rows = []
        for d, own in words.items():
            score = sum(math.log((len(words) - df[w] + 0.5) / (df[w] + 0.5) + 1) * own.count(w) * 2.2 / (own.count(w) + 1.2 * (0.35 + 0.65 * len(own) / average)) for w in terms if w in own)
            rows.append((-round(score, 9), min(i for i, w in enumerate(terms) if w in own), d))
        want |= {(q, d, rank) for rank, (_, _, d) in enumerate(sorted(rows)[:6], 1)}
    got = lexical.search(index, questions, "query_id", "text", 6)
    assert {(r["query_id"], r["doc_id"], r["rank"]) for r in got.collect()} == want
    alone = lexical.question_terms(questions, "query_id", "text").groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("first_at", "term", "times"))).alias("terms"))
    assert lexical.best_documents(index, alone, 6).count() <= 90 * 6 * 4  # of 54 000 pairs; four blocks
