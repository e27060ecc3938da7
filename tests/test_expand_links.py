"""Expansion by cross-references where a source has many targets, compared with brute force."""

import random

from pyspark.sql import functions as F

from corpusmill.operators import graph


def test_a_sources_targets_are_cut_before_groups_meet_them(spark):
    rng = random.Random(5)
    edges = [(f"s{rng.randrange(4)}", f"{'s' if rng.random() < 0.05 else 't'}{rng.randrange(60)}", rng.randrange(5, 40)) for _ in range(900)]
    primary = [(g, f"s{rng.randrange(4)}") for g in range(40) for _ in range(1 + g % 4)]
    best = {}
    for s, t, v in edges:
        if v > 10:
            best[s, t] = max(v, best.get((s, t), 0))
    want = set()
    for g in range(40):
        own = {s for x, s in primary if x == g}
        found = {}
        for (s, t), v in best.items():
            if s in own and t not in own:
                found[t] = max(v, found.get(t, 0))
        want |= {(g, t, v, i) for i, (t, v) in enumerate(sorted(found.items(), key=lambda x: (-x[1], x[0]))[:3], 1)}
    got = graph.expand_links(spark.createDataFrame(primary, "g int, i string"), spark.createDataFrame(edges, "a string, b string, votes int"), "g", "i", "a", "b", "votes")
    assert {tuple(r) for r in got.select("g", "b", "votes", "place").collect()} == want
    plan = got._jdf.queryExecution().optimizedPlan().toString().split("\n")
    assert sum("Window [row_number" in x for x in plan) == 2, plan  # of sources, then of groups
    assert got.groupBy("g").count().agg(F.max("count")).first()[0] == 3
