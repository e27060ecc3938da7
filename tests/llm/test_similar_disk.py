"""What the search of similar vectors sends: small codes, once to each group of lists, for visits that pairs need."""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from corpusmill.llm import similar


def near_pairs(count, dim=48, seed=3):
    """Rows of isolated directions, every one with a near copy: a sample has few of these pairs."""
    rng = np.random.default_rng(seed)
    rows = rng.normal(size=(count // 2, dim))
    return np.float32(np.round(np.concatenate([rows, rows + 0.25 * rng.normal(size=rows.shape)]) * 32) / 32)


def test_short_codes_lose_nothing():
    rows = np.array([[0.5, -0.25, 3.0], [0.1, 0.2, 0.3], [1e-9, 1.0, 7e4], [0.0, -0.0, 1.0], [127 / 256, -1 / 256, 0], [128 / 256, 1 / 256, 0]], dtype=np.float32)
    codes = similar.encode_short(rows)
    back = similar.decode_rows(codes, 3)
    assert [len(c) for c in codes] == [4, 12, 12, 6, 4, 6] and (back == rows).all() and (np.signbit(back) == np.signbit(rows)).all()


def test_pairs_above_a_least_similarity_need_few_visits(spark):
    rows = near_pairs(1600)
    df = spark.createDataFrame([(f"r{i:05d}", v.tolist()) for i, v in enumerate(rows)], "id string, embedding array<float>")
    config = similar.ListIndexConfig(list_rows=20, sample_rows=400, sample_a_list=2)
    index = similar.build_index(df, config, 0.8)[48]
    assert index.visits * 4 < similar.build_index(df, config)[48].visits  # neighbours within a sample are nobody's neighbours
    batch = pa.RecordBatch.from_arrays([pa.array([f"r{i:05d}" for i in range(len(rows))]), pa.array([r.tolist() for r in rows], pa.list_(pa.float32()))], ["id", "embedding"])
    index.groups = similar.grouped_lists(index.graph.centroids, 8)
    sent = [r for out in similar._postings(lambda: {48: index}, config, 6)([batch]) for r in out.to_pylist()]
    lists = sum(len({*r["posted"], *r["visits"]}) for r in sent)
    assert len({(r["id"], r["cell"]) for r in sent}) == len(sent) < lists and max(len(r["code"]) for r in sent) <= 97


def test_pairs_are_found_across_groups_of_lists(spark):
    rows = near_pairs(1600)
    df = spark.createDataFrame([(f"r{i:05d}", v.tolist()) for i, v in enumerate(rows)], "id string, embedding array<float>")
    found = similar.mutual_pairs(similar.similar_vectors(df, 5, 0.8, similar.ListIndexConfig(list_rows=100, sample_rows=800)))
    unit = similar.unit_rows_wide(rows)
    a, b = np.nonzero(np.triu(unit @ unit.T >= 0.8, 1))
    want = {(f"r{i:05d}", f"r{j:05d}") for i, j in zip(a, b, strict=True)}
    got = {tuple(r) for r in found.collect()}
    assert got <= want and len(got) >= 0.97 * len(want) and found.groupBy("id_a", "id_b").count().filter(F.col("count") > 1).count() == 0
