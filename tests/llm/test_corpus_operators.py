import random

import pytest
from pyspark.sql import functions as F

from corpusmill.llm import mixing, packing, reading, tokens, topn

SCHEMA = "g string, item long, score double, salt int, place string"


def best(rows, n):
    groups = {}
    for g, i, s in set(rows):
        if g is not None and i is not None and s is not None and s == s:
            groups.setdefault(g, []).append((-s, i))
    return {(g, i, k + 1) for g, v in groups.items() for k, (_, i) in enumerate(sorted(v)[:n])}


@pytest.mark.parametrize("heavy_rows", [10, 100_000])
def test_top_n_in_hot_and_cold_groups(spark, heavy_rows):
    rng = random.Random(1)
    rows = [("hot", i, float(rng.randrange(400))) for i in range(3_000)] + [("ties", i, 7.0) for i in range(900)] + [(f"g{rng.randrange(60)}", i, float(rng.randrange(20))) for i in range(500)]
    rows += [("hot", i, s) for _, i, s in rows[:50]] + [("g1", None, 1.0), (None, 1, 1.0), ("g1", 9_999, None), ("few", 1, 2.0), ("g2", 8_888, float("nan"))]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA)
    got = {(r["g"], r["item"], r["place"]) for r in topn.top_n_per_group(df, ["g"], "score", "item", 5, heavy_rows, 4).collect()}
    assert got == best(rows, 5)


def test_top_n_of_nothing(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert topn.top_n_per_group(df, ["g"], "score", "item", 5).count() == 0


def test_heavy_group_with_repeated_winners(spark):
    rows = [("hot", 1, 9.0)] * 500 + [("hot", i, 1.0) for i in range(2, 200)]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA)
    assert {(r["item"], r["place"]) for r in topn.top_n_per_group(df, ["g"], "score", "item", 3, 10, 4).collect()} == {(1, 1), (2, 2), (3, 3)}


def test_rank_within_has_no_gaps(spark):
    df = spark.range(1_000).withColumn("k", F.when(F.col("id") < 700, 0).otherwise(F.col("id") % 7))
    for k, ranks in df.transform(lambda d: tokens.rank_within(d, ["k"], [F.col("id")], 8)).groupBy("k").agg(F.sort_array(F.collect_list("rank")).alias("r")).collect():
        assert list(ranks) == list(range(len(ranks))), k


def check_packing(rows, packed, capacity):
    load, seen = {}, {}
    for r in packed:
        seen.setdefault(r["item"], []).append((r["size_from"], r["size_to"]))
        if r["container"] is not None:
            load[r["container"]] = load.get(r["container"], 0) + r["size_to"] - r["size_from"]
    assert all(v <= capacity for v in load.values()) and sorted(load) == list(range(len(load)))
    for item, size in rows:
        parts = sorted(seen[item])
        assert parts[-1][1] == max(0, size or 0) and (len(parts) == 1 or size > capacity)
        assert all(a[1] == b[0] for a, b in zip(parts, parts[1:], strict=False))
    return len(load)


def test_packing_is_close_to_the_bound(spark):
    rng = random.Random(3)
    rows = [(i, rng.choice([rng.randrange(1, 400), rng.randrange(1, 60), 130])) for i in range(2_000)] + [(5_000, 1_234), (5_001, None), (5_002, 0), (5_003, 512), (5_004, 1_024)]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "item long, size int, rank int, container int")
    used = check_packing(rows, packing.pack_items(df, "item", "size", 512).collect(), 512)
    bound = -(-sum(max(0, s or 0) for _, s in rows) // 512)
    assert used <= bound * 1.01 + 1


def test_packing_of_nothing_and_of_one_size(spark):
    assert packing.pack_items(spark.createDataFrame([], "item long, size int"), "item", "size", 10).count() == 0
    rows = [(i, 6) for i in range(50)]
    assert check_packing(rows, packing.pack_items(spark.createDataFrame(rows, "item long, size int"), "item", "size", 10).collect(), 10) == 50


def optimum(sizes, capacity):
    best_ = [len(sizes)]

    def place(i, bins):
        if len(bins) >= best_[0]:
            return
        if i == len(sizes):
            best_[0] = len(bins)
            return
        for k in range(len(bins)):
            if bins[k] + sizes[i] <= capacity:
                bins[k] += sizes[i]
                place(i + 1, bins)
                bins[k] -= sizes[i]
        place(i + 1, [*bins, sizes[i]])

    place(0, [])
    return best_[0]


def test_packing_against_the_optimum():
    rng = random.Random(6)
    over = 0
    for _ in range(60):
        sizes = sorted((rng.randrange(5, 60) for _ in range(9)), reverse=True)
        histogram = {s: sizes.count(s) for s in sizes}
        runs = packing.plan_packing(histogram, 100)
        left = dict(histogram)
        for times, use in runs:
            assert sum(s * n for s, n in use.items()) <= 100
            for s, n in use.items():
                left[s] -= times * n
        assert not any(left.values())
        over += packing.containers(runs) - optimum(sizes, 100)
    assert over <= 2


WEIGHTS = "source string, target_share double, max_repeats int"


def mixture(spark, docs, weights, total=None):
    df = spark.createDataFrame([(*d, 9, "c") for d in docs], "doc_id long, source string, tokens long, rank int, copies string")
    given, report = mixing.mix_sources(df, "doc_id", "source", "tokens", spark.createDataFrame(weights, WEIGHTS), total)
    return {r["doc_id"]: r["copies"] for r in given.collect()}, {r["source"]: r for r in report.collect()}


def test_shares_are_met_within_the_caps(spark):
    rng = random.Random(2)
    docs = [(i, "Big Source ", rng.randrange(20, 400)) for i in range(1_500)] + [(10_000 + i, "small", rng.randrange(20, 400)) for i in range(120)] + [(20_000 + i, "mid-dle", rng.randrange(20, 400)) for i in range(400)]
    docs += [(30_000, None, 50), (30_001, "unlisted", 50), (30_002, "small", 0), (30_003, "small", None)]
    given, report = mixture(spark, docs, [("big_source", 0.5, 1), ("small", 0.2, 4), ("mid_dle", 0.29, 2), ("absent", 0.01, 3)])
    assert set(given) == {d[0] for d in docs} and given[30_000] == given[30_001] == given[30_002] == given[30_003] == 0
    for s, want in (("big_source", 0.5), ("small", 0.2), ("mid_dle", 0.29)):
        assert report[s]["actual_share"] == pytest.approx(want / 0.99, abs=0.01)
    assert report["absent"]["tokens"] == 0 and report["small"]["max_copies"] <= 4 and report["big_source"]["max_copies"] <= 1
    assert max(c for i, c in given.items() if i < 10_000) <= 1


def test_a_source_of_equal_documents(spark):
    docs = [(i, "a", 100) for i in range(999)] + [(5_000 + i, "b", 100) for i in range(300)]
    given, report = mixture(spark, docs, [("a", 0.5, 1), ("b", 0.5, 3)])
    assert report["a"]["mixed_tokens"] == pytest.approx(report["b"]["mixed_tokens"], rel=0.01)


def test_mixing_nothing(spark):
    given, report = mixture(spark, [], [("a", 1.0, 2)])
    assert given == {} and report["a"]["mixed_tokens"] == 0 and report["a"]["actual_share"] == 0


def test_token_counts_of_long_texts():
    path = tokens.default_vocabulary()
    rng = random.Random(4)
    text = " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randrange(1, 9))) for _ in range(90_000))
    assert tokens.count_tokens(text, path) == len(tokens.encoder(path).encode_ordinary(text))


EASY, HARD = "the cat saw a dog . it was a good dog .".split(), "notwithstanding the preontological hermeneutics whereby postdogmatic exegesis presupposes".split()


def document(rng, hard, words=120):
    out = []
    while len(out) < words:
        pool = HARD if rng.random() < hard else EASY
        out += [*rng.choices(pool, k=6 if pool is EASY else 18), "."]
    return " ".join(out)


def test_held_out_reading_levels(spark):
    rng = random.Random(1)
    docs, labels, truth = [], [], {}
    for i in range(240):
        band = 4 if i % 2 else 1
        docs.append((i, document(rng, 0.9 if band == 4 else 0.05), band, "x"))
        truth[i] = band
        if i < 160:
            labels += [(i, band, "a")] * rng.randrange(1, 3)
    docs += [(1_000, None, 0, ""), (1_001, "", 0, ""), (1_002, " \n.", 0, ""), (0, docs[0][1], 0, "")]
    df = spark.createDataFrame(docs, "doc_id long, text string, band int, words string")
    out = reading.reading_levels(df, "doc_id", "text", spark.createDataFrame(labels, "doc_id long, band int, rater string")).collect()
    assert len(out) == len(docs)
    held = [(r["band"], truth[r["doc_id"]]) for r in out if 160 <= r["doc_id"] < 240]
    assert sum(a == b for a, b in held) / len(held) >= 0.95
    assert all(r["band"] is None and r["words"] in (0, 1) for r in out if r["doc_id"] >= 1_000)
    none = reading.reading_levels(df, "doc_id", "text", spark.createDataFrame([], "doc_id long, band int, rater string"))
    assert none.filter("band is not null").count() == 0 and none.count() == len(docs)
    assert reading.reading_levels(df.limit(0), "doc_id", "text", spark.createDataFrame(labels, "doc_id long, band int, rater string")).count() == 0


def test_isotonic_is_monotone():
    import numpy as np

    x, y = reading.isotonic(np.array([3.0, 1.0, 2.0, 4.0]), np.array([2.0, 1.0, 3.0, 4.0]))
    assert (np.diff(y) >= 0).all() and np.interp(2.5, x, y) == 2.5


def test_dominated_fillings():
    counts = {3: 1, 4: 1, 7: 1, 8: 1}
    mask = sum(1 << s for s in counts)
    assert packing.dominated({3: 1, 4: 1}, 0, counts, mask)  # 7 takes the place of 3 and 4
    assert packing.dominated({7: 1}, 1, counts, mask) and not packing.dominated({7: 1}, 0, counts, mask)
    assert not packing.dominated({8: 1}, 2, counts, mask) and packing.dominated({8: 1}, 3, counts, mask)


def test_packing_searches_histograms_of_any_size(monkeypatch):
    rng = random.Random(8)
    histogram = {s: rng.randrange(1, 4) for s in rng.sample(range(400, 2_000), 700)}
    tried = []
    real = packing.complete_bins
    monkeypatch.setattr(packing, "complete_bins", lambda *a: tried.append(a) or real(*a))
    runs = packing.plan_packing(histogram, 2_048)
    bound = -(-sum(s * n for s, n in histogram.items()) // 2_048)
    assert len(tried) >= len(packing.ACCEPTED) or packing.containers(runs) == bound
    left = dict(histogram)
    for times, use in runs:
        assert sum(s * n for s, n in use.items()) <= 2_048
        for s, n in use.items():
            left[s] -= times * n
    assert not any(left.values())
