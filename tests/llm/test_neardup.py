import random
import re

import numpy as np
from pyspark.sql import functions as F

from corpusmill.llm import neardup


def sets(rows):
    return {i: set(re.findall(r"[^\W\d_]+", t.lower())) for i, t in rows if t and re.search(r"[^\W\d_]", t)}


def brute(rows, threshold):
    words = sets(rows)
    return {(a, b) for a in words for b in words if a < b and len(words[a] & words[b]) >= threshold * len(words[a] | words[b])}


def texts(count, seed=1, vocabulary=400):
    rng = random.Random(seed)
    common = [f"the{chr(97 + i)}" for i in range(6)]
    letters = "abcdefghijklmnopqrst"
    words = ["".join(rng.choice(letters) for _ in range(6)) for _ in range(vocabulary)]
    out = []
    for i in range(count):
        if out and rng.random() < 0.4:
            base = rng.choice(out)[1].split()
            for _ in range(rng.randrange(4)):
                base[rng.randrange(len(base))] = rng.choice(words)
            rng.shuffle(base)
            out.append((i, " ".join(base)))
        else:
            out.append((i, " ".join(rng.sample(common, 4) + rng.sample(words, rng.randrange(1, 16)))))
    return out


def frame(spark, rows):
    return spark.createDataFrame([(i, t, 1, "y") for i, t in rows], "id long, body string, size int, words string")


def test_pairs_match_brute_force(spark):
    rows = texts(400)
    for threshold in (0.6, 0.8):
        got = {tuple(r) for r in neardup.near_duplicate_pairs(frame(spark, rows), "id", "body", threshold).collect()}
        assert got == brute(rows, threshold)


def test_blocks_match_too(spark, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK_ROWS", 16)
    monkeypatch.setattr(neardup, "COMMON_TEXTS", 4)
    rows = texts(250, seed=8, vocabulary=40)
    for threshold in (0.3, 0.6):
        got = {tuple(r) for r in neardup.near_duplicate_pairs(frame(spark, rows), "id", "body", threshold).collect()}
        assert got == brute(rows, threshold)


def test_both_orders_are_the_same(spark, monkeypatch):
    rows = texts(300, seed=3, vocabulary=60)
    classes = neardup.text_classes(neardup.word_sets(frame(spark, rows).select("id", "body"), "id", "body")).select("class_id", "words")
    sent = neardup.ordered_words(classes, 0.6)
    monkeypatch.setattr(neardup, "WORDS_HELD", 5)
    joined = neardup.ordered_words(classes, 0.6)
    assert sorted(map(tuple, sent.collect())) == sorted(tuple(r[c] for c in sent.columns) for r in joined.collect())
    got = {tuple(r) for r in neardup.near_duplicate_pairs(frame(spark, rows), "id", "body", 0.6).collect()}
    assert got == brute(rows, 0.6)


def test_edges(spark):
    rows = [(1, "A b c"), (2, "c, B! a"), (3, None), (4, ""), (5, "123 †"), (6, "a b c d e"), (7, "Élan vital"), (8, "élan VITAL 7"), (1, "A b c"), (9, "x " * 50_000)]
    got = {tuple(r) for r in neardup.near_duplicate_pairs(frame(spark, rows), "id", "body", 0.6).collect()}
    assert got == {(1, 2), (1, 6), (2, 6), (7, 8)}
    members, classes, links = neardup.near_duplicate_groups(frame(spark, rows), "id", "body", 0.6)
    assert {tuple(r) for r in members.collect()} == {(1, 1), (2, 1), (6, 6), (7, 7), (8, 7), (9, 9)}
    assert {(r["class_id"], r["copies"]) for r in classes.collect()} == {(1, 2), (6, 1), (7, 2), (9, 1)}
    assert [(r["a"], r["b"], r["similarity"]) for r in links.collect()] == [(1, 6, 0.6)]


def test_empty_table(spark):
    assert neardup.near_duplicate_pairs(frame(spark, []), "id", "body", 0.6).count() == 0


def test_many_copies_are_one_class(spark):
    rows = spark.range(5_000).select(F.col("id"), F.lit("same words here").alias("body"))
    members, classes, links = neardup.near_duplicate_groups(rows, "id", "body", 0.6)
    assert classes.count() == 1 and links.count() == 0 and members.select("class_id").distinct().count() == 1


def test_fingerprints_never_lengthen_the_distance():
    rng = np.random.default_rng(3)
    pool = rng.integers(-(2**62), 2**62, 60)
    chosen = [np.sort(rng.choice(pool, rng.integers(1, 40), replace=False)) for _ in range(40)]
    prints = neardup.fingerprints(np.concatenate(chosen), np.concatenate([[0], np.cumsum([len(c) for c in chosen])]))
    i, j = (x.ravel() for x in np.indices((40, 40)))
    folded = neardup.distances(prints, i, j)
    assert all(d <= len(set(chosen[a]) ^ set(chosen[b])) for a, b, d in zip(i, j, folded, strict=True))


def clustered(seed, trees=3):
    """(prints, sizes, node) of rows near forty middles, in several trees."""
    rng = np.random.default_rng(seed)
    prints = np.repeat(rng.integers(0, 2**63, (40, 4), dtype=np.uint64), 50, axis=0)
    prints[:, 0] ^= np.uint64(1) << rng.integers(0, 64, len(prints)).astype(np.uint64)
    return prints, rng.integers(14, 27, len(prints)), np.sort(rng.integers(0, trees, len(prints)))


def allowed(prints, sizes, node, i, j):
    near = neardup.distances(prints, i, j) <= np.floor(0.25 * (sizes[i] + sizes[j]) + 1e-9)
    return near & (node[i] == node[j]) & (np.minimum(sizes[i], sizes[j]) >= 0.6 * np.maximum(sizes[i], sizes[j]) - 1e-9)


def test_trees_prune_and_lose_nothing():
    prints, sizes, node = clustered(5)
    found, work = set(), 0
    for a, b, n in neardup.forest_pairs(prints, sizes, node, 0.6):
        found |= {(int(min(x, y)), int(max(x, y))) for x, y in zip(a, b, strict=True)}
        work += n
    i, j = np.triu_indices(len(prints), 1)
    met = allowed(prints, sizes, node, i, j)
    assert found == set(zip(i[met].tolist(), j[met].tolist(), strict=True))
    assert work < (node[i] == node[j]).sum()


def test_two_sides_meet_once():
    prints, sizes, node = clustered(9)
    sides = np.random.default_rng(2).random(len(prints)) < 0.5
    found = [(int(min(x, y)), int(max(x, y))) for a, b, _ in neardup.forest_pairs(prints, sizes, node, 0.6, sides=sides) for x, y in zip(a, b, strict=True)]
    i, j = np.triu_indices(len(prints), 1)
    met = allowed(prints, sizes, node, i, j) & (sides[i] != sides[j])
    assert sorted(found) == sorted(zip(i[met].tolist(), j[met].tolist(), strict=True))


def test_rows_at_one_distance_are_split():
    prints = np.repeat(np.arange(3, dtype=np.uint64)[:, None], 4, axis=1)[np.array([0] * 100)]
    pairs = sum(len(a) for a, _, _ in neardup.forest_pairs(prints, np.full(100, 5), np.zeros(100, dtype=int), 0.6))
    assert pairs == 100 * 99 // 2
