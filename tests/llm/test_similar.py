import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from corpusmill.llm import similar

SCHEMA = "id string, embedding array<float>, list int, score string"


def brute(rows, k, least=None):
    out = {}
    for i, v in rows:
        near = []
        for j, w in rows:
            if i != j and len(v) == len(w):
                a, b = np.array(v, dtype=float), np.array(w, dtype=float)
                c = round(float(a @ b / np.sqrt((a @ a) * (b @ b))), 9)
                if least is None or c >= least:
                    near.append((-c, j))
        out[i] = [j for _, j in sorted(near)[:k]]
    return out


def clustered(count, dim=24, groups=12, seed=1):
    rng = np.random.default_rng(seed)
    middles = rng.normal(size=(groups, dim))
    rows = middles[rng.integers(groups, size=count)] + 0.5 * rng.normal(size=(count, dim))
    return [(f"r{i:05d}", [float(x) for x in np.float32(v)]) for i, v in enumerate(rows)]


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 0, "x") for i, v in rows], SCHEMA)


def test_recall_against_brute_force(spark):
    rows = clustered(1500)
    config = similar.ListIndexConfig(list_rows=60, sample_rows=700)
    found = {}
    for r in similar.similar_vectors(frame(spark, rows), 5, None, config).collect():
        found.setdefault(r["id"], []).append((r["place"], r["other"]))
    want = brute(rows, 5)
    hits = sum(len({o for _, o in found.get(i, [])} & set(w)) for i, w in want.items())
    assert set(found) == set(want) and hits / (5 * len(want)) >= 0.9
    assert all([p for p, _ in sorted(f)] == [1, 2, 3, 4, 5] for f in found.values())


def test_blocks_give_the_same_rows(spark):
    rows = clustered(400, seed=4)
    wide = similar.ListIndexConfig(list_rows=1000, least_lists=1)
    narrow = similar.ListIndexConfig(list_rows=1000, least_lists=1, block_rows=90)
    one, two = (sorted(map(tuple, similar.similar_vectors(frame(spark, rows), 4, None, c).collect())) for c in (wide, narrow))
    assert one == two and {(i, o) for i, o, *_ in one} == {(i, o) for i, w in brute(rows, 4).items() for o in w}


def test_unusable_copies_and_lengths(spark):
    nan = float("nan")
    rows = [("a", [1.0, 0.0]), ("b", [2.0, 0.0]), ("c", [1.0, 0.1]), ("d", []), ("e", None), ("f", [0.0, 0.0]), ("g", [nan, 1.0]), ("h", [1.0, 0.0, 0.0]), ("i", [1.0, 0.0, 0.2]), (None, [1.0, 0.0]), ("j", [float("inf"), 0.0]), ("k", [1e30, 1e29])]
    found = similar.similar_vectors(frame(spark, rows), 5, 0.8)
    pairs = {(r["id"], r["other"]) for r in found.collect()}
    assert {i for p in pairs for i in p} == {"a", "b", "c", "h", "i", "k"}
    assert ("h", "a") not in pairs and ("h", "i") in pairs and ("k", "c") in pairs


def test_ties_are_ordered_by_id_even_in_a_large_group_of_copies(spark):
    rows = [(f"c{i:03d}", [1.0, 2.0, 3.0]) for i in range(60)] + [("x", [3.0, 2.0, 1.0])]
    found = similar.similar_vectors(frame(spark, rows).repartition(3), 5)
    own = [r["other"] for r in found.filter("id = 'c000'").orderBy("place").collect()]
    assert own == [f"c{i:03d}" for i in range(1, 6)]
    pairs = {tuple(r) for r in similar.mutual_pairs(found).collect()}
    assert pairs == {(f"c{i:03d}", f"c{j:03d}") for i in range(6) for j in range(i + 1, 6)}
    classes = similar.copy_classes(frame(spark, rows)).groupBy("class_id").agg(F.count("*").alias("n"), F.max("copies").alias("c")).collect()
    assert {(r["class_id"], r["n"], r["c"]) for r in classes} == {("c000", 60, 60), ("x", 1, 1)}


def test_empty_table(spark):
    empty = frame(spark, [])
    assert similar.similar_vectors(empty, 5).count() == 0 and similar.copy_classes(empty).count() == 0


def test_encoding_round_trip():
    rows = np.array([[0.5, -0.25, 3.0], [0.1, 0.2, 0.3], [1e-9, 1.0, 7e4]], dtype=np.float32)
    codes = similar.encode_rows(rows)
    assert [len(c) for c in codes] == [6, 12, 12] and (similar.decode_rows(codes, 3) == rows).all()


def test_graph_finds_the_nearest_lists():
    rng = np.random.default_rng(2)
    centroids = similar.unit_rows(rng.normal(size=(400, 16)).astype(np.float32))
    graph = similar.CentroidGraph(centroids, 16)
    rows = similar.unit_rows(rng.normal(size=(300, 16)).astype(np.float32))
    square, lists = graph.search(rows, 10)
    exact = (rows @ centroids.T).argmax(axis=1)
    assert (lists[:, 0] == exact).mean() > 0.9 and (np.diff(square, axis=1) >= -1e-5).all()


def parallel(count, dim=384, seed=5):
    """Vectors of one direction and different norms, and some of other directions."""
    rng = np.random.default_rng(seed)
    v = rng.normal(size=dim)
    rows = [(f"p{i:04d}", [float(x) for x in np.float32(v * s)]) for i, s in enumerate(rng.uniform(0.1, 9.0, count))]
    return rows + [(f"z{i:04d}", [float(x) for x in np.float32(w)]) for i, w in enumerate(rng.normal(size=(20, dim)))]


def test_parallel_vectors_are_ordered_by_id(spark):
    for count in (12, 30, 300):
        rows = parallel(count)
        found = similar.similar_vectors(frame(spark, rows), 5, 0.8)
        pairs = {tuple(r) for r in similar.mutual_pairs(found).collect()}
        assert pairs == {(f"p{i:04d}", f"p{j:04d}") for i in range(6) for j in range(i + 1, 6)}


def test_every_copy_has_its_neighbours(spark):
    rows = [(f"c{i:03d}", [1.0, 2.0, 3.0]) for i in range(40)] + [("x", [3.0, 2.0, 1.0]), ("a", [1.0, 2.0, 3.5])]
    want = brute(rows, 5)
    for parts in (1, 3):
        found = {}
        for r in similar.similar_to_all(frame(spark, rows).repartition(parts), 5).orderBy("id", "place").collect():
            found.setdefault(r["id"], []).append(r["other"])
        assert found == want


def test_lists_are_balanced_by_where_rows_go():
    rng = np.random.default_rng(4)
    middles = rng.normal(size=(30, 24))
    rows = similar.unit_rows((middles[np.minimum(rng.geometric(0.15, 6000) - 1, 29)] + 0.4 * rng.normal(size=(6000, 24))).astype(np.float32))
    centroids = similar.balanced_centroids(rows, 60)
    count = np.bincount(similar._nearest(rows, centroids), minlength=60)
    assert len(centroids) == 60 and count.max() <= 3 * 100 and count.min() >= 100 // 5


def test_calibration_widens_the_ratio():
    rng = np.random.default_rng(6)
    rows = similar.unit_rows(rng.normal(size=(3000, 32)).astype(np.float32))  # no clusters: neighbours lie in many lists
    config = similar.ListIndexConfig()
    graph = similar.CentroidGraph(similar.balanced_centroids(rows, 40), 16)
    visits, ratio = similar.calibrated_visits(graph, rows, config)
    assert ratio > 1.1 and visits > 8


def test_large_lists_are_split_for_postings_and_visitors():
    rng = np.random.default_rng(7)
    rows = np.float32(rng.normal(size=(600, 8)) * 0.01 + 1)
    config = similar.ListIndexConfig(least_lists=1, block_rows=100)
    graph = similar.CentroidGraph(similar.balanced_centroids(similar.unit_rows(rows), 1), 16)
    index = {8: similar.ListIndex(graph, 1, 1.0, np.array([6]), np.array([6]))}
    batch = pa.RecordBatch.from_arrays([pa.array([f"r{i:04d}" for i in range(600)]), pa.array([r.tolist() for r in rows], pa.list_(pa.float32()))], ["id", "embedding"])
    cells = {}
    for out in similar._postings(lambda: index, config, 6)([batch]):
        for b, p, i, posted, visits in zip(*(out.column(c).to_pylist() for c in ("block", "part", "id", "posted", "visits")), strict=True):
            cells.setdefault((b, p), []).append((i, posted, visits))
    assert len(cells) == 36 and max(map(len, cells.values())) < 300
    assert all(len({p for (b, p), rows in cells.items() for n, posted, _ in rows if n == i and posted}) == 6 for i in ("r0000", "r0599"))
    met = {(a, c) for rows in cells.values() for a, posted, _ in rows if posted for c, _, visits in rows if visits}
    assert len(met) == 600 * 600
