"""Queries over whole tables, compared with brute force."""

import os

import pytest

from corpusmill.operators import vectors
from corpusmill.plans.queries import queries

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")


def voted_edges(spark):
    """Every edge with more than ten votes and two different ends."""
    rows = spark.read.parquet(f"{DATA}/cross_references.parquet").collect()
    found = set()
    for r in rows:
        if r["source"] is not None and r["target"] is not None and (r["votes"] or 0) > 10:
            a, b = (f"{x['book'].strip().upper()} {x['chapter']}:{x['verse']}" if None not in (x["book"], x["chapter"], x["verse"]) else None for x in (r["source"], r["target"]))
            if a and b and a != b:
                found.add((r["edge_id"], a, b, r["votes"]))
    return found


def roots(edges):
    up = {}

    def top(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for _, a, b, _ in edges:
        x, y = sorted((top(a), top(b)))
        up[y] = x
    return {x: top(x) for x in up}


def test_components_over_all_voted_edges(spark):
    edges = voted_edges(spark)
    want = roots(edges)
    assert any(votes <= 60 for *_, votes in edges)
    assert {(r["node"], r["root"]) for r in queries()["r2_components"](spark, DATA).collect()} == set(want.items())
    size, total = {}, {}
    for root in want.values():
        size[root] = size.get(root, 0) + 1
    for _, a, _, votes in edges:
        total[want[a]] = total.get(want[a], 0) + votes
    found = queries()["r3_roll_up"](spark, DATA).collect()
    assert {(r["root"], r["size"], r["vote_total"]) for r in found} == {(x, n, total.get(x, 0)) for x, n in size.items()}
    assert [r["root"] for r in sorted(found, key=lambda r: r["number"])] == sorted(size, key=lambda x: (-size[x], x))


def test_ordered_cross_of_windows_of_any_size(spark):
    rows = spark.read.parquet(f"{DATA}/passage_windows.parquet").collect()
    want = sorted((r["passage_id"], a, b) for r in rows for a in r["verse_ids"] or [] for b in r["verse_ids"])
    assert any(len(r["verse_ids"] or []) > 5 for r in rows)
    assert sorted((r["passage_id"], r["a"], r["b"]) for r in queries()["u7_ordered_cross"](spark, DATA).collect()) == want


def test_nearest_answers_every_question_in_blocks(spark, monkeypatch):
    whole = sorted(map(tuple, queries()["b16_nearest"](spark, DATA).collect()))
    ids = [r["vec_id"] for r in spark.read.parquet(f"{DATA}/embeddings.parquet").select("vec_id").collect()]
    assert {r[0] for r in whole} == {i for i in ids if i % 50 == 0} and len(whole) == 10 * len({r[0] for r in whole})
    monkeypatch.setattr(vectors, "QUESTIONS_A_PASS", 3)
    assert sorted(map(tuple, queries()["b16_nearest"](spark, DATA).collect())) == whole


def test_every_link_is_inserted(spark):
    rows = spark.read.parquet(f"{DATA}/cross_references.parquet").collect()
    found = queries()["k6_insert_missing"](spark, DATA).collect()
    assert {tuple(r) for r in found} == {(r["edge_id"], r["votes"]) for r in rows}
    early = [r["edge_id"] for r in rows if r["loaded_at"].month < 4]
    assert len(found) == len(early) + len({r["edge_id"] for r in rows} - set(early))


def test_neighbours_of_every_document(spark):
    keys = {r["primary_ref"].upper() for r in spark.read.parquet(f"{DATA}/documents.parquet").collect() if r["primary_ref"]}
    latest = {}
    for r in spark.read.parquet(f"{DATA}/verses.parquet").collect():
        if (r["text"] or "").strip(" ") and (r["translation"] or "").strip(" ").upper() == "BSB":
            at = (r["book"].strip(" ").upper(), r["chapter"], r["verse"])
            if at not in latest or (r["loaded_at"], -r["row_id"]) > (latest[at]["loaded_at"], -latest[at]["row_id"]):
                latest[at] = r
    want = {r["row_id"] for (b, c, v), r in latest.items() if any(f"{b} {c}:{v + d}" in keys for d in (-1, 0, 1))}
    assert {r["row_id"] for r in queries()["w4_neighbours"](spark, DATA).collect()} == want
