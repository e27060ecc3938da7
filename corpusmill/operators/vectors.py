"""Exact vector search for a bounded set of questions, and the interface of interchangeable stores."""

from __future__ import annotations

from typing import Protocol

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from corpusmill.operators.fusion import min_max
from corpusmill.operators.lexical import Index, search

#: Questions of one pass over the vectors, which every task holds, and of one matrix product.
QUESTIONS_A_PASS, QUESTION_BLOCK = 16_384, 1_024
#: Digits to which scores, relative to the largest, count as equal.
EQUAL_DIGITS = 10


def _rows(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Flat values, offsets and lengths of a list column; a null list has no values, a null value is NaN."""
    lengths = np.asarray(column.value_lengths().fill_null(0), dtype=np.int64)
    flat = column.flatten()
    flat = flat.fill_null(float("nan")) if flat.null_count else flat
    return np.asarray(flat, dtype=np.float64), np.concatenate([[0], np.cumsum(lengths)]), lengths


def _by_length(column: pa.Array):
    """(length, positions, matrix) for the rows of each positive length."""
    values, offsets, lengths = _rows(column)
    for dim in np.unique(lengths[lengths > 0]):
        at = np.flatnonzero(lengths == dim)
        yield int(dim), at, np.stack([values[offsets[i] : offsets[i] + dim] for i in at])


def _unit(rows: np.ndarray) -> np.ndarray:
    """Rows of length one; NaN where there is no such row."""
    with np.errstate(invalid="ignore", divide="ignore"):
        wide = rows / np.abs(rows).max(axis=1, keepdims=True)
        return wide / np.sqrt(np.einsum("ij,ij->i", wide, wide))[:, None]


def _best(asked: dict[int, tuple[list, np.ndarray]], k: int, cosine: bool, kinds: tuple[pa.DataType, pa.DataType]):
    """Per batch the best rows for every question, unless earlier rows of the task leave them no place."""

    def run(batches):
        held = {dim: np.full((len(ids), k), -np.inf) for dim, (ids, _) in asked().items()}
        for batch in batches:
            for dim, at, rows in _by_length(batch.column("doc_vector")):
                if dim not in held:
                    continue
                ids, questions = asked()[dim]
                names = batch.column("doc_id").take(pa.array(at))
                order = pc.sort_indices(names)  # columns in the order of ids, so that a tie prefers the left one
                names, rows = names.take(order), rows[np.asarray(order)]
                rows = _unit(rows) if cosine else rows
                for i in range(0, len(ids), QUESTION_BLOCK):
                    score = questions[i : i + QUESTION_BLOCK] @ rows.T
                    score[~np.isfinite(score)] = -np.inf
                    wide = max(1e-300, float(np.abs(score[np.isfinite(score)]).max(initial=0)))
                    rank = np.round(score / wide, EQUAL_DIGITS) - np.arange(score.shape[1]) / score.shape[1] * 10.0 ** -(EQUAL_DIGITS + 1)
                    width = min(k, score.shape[1])
                    top = np.argpartition(-rank, width - 1, axis=1)[:, :width]
                    value = np.take_along_axis(score, top, 1)
                    least = held[dim][i : i + QUESTION_BLOCK].min(axis=1, keepdims=True)
                    r, c = np.nonzero((value > -np.inf) & (value >= least - wide * 10.0**-EQUAL_DIGITS))
                    both = np.hstack([held[dim][i : i + QUESTION_BLOCK], value])
                    held[dim][i : i + QUESTION_BLOCK] = -np.partition(-both, k - 1, axis=1)[:, :k]
                    yield pa.RecordBatch.from_arrays([pa.array([ids[i + x] for x in r], kinds[0]), names.take(pa.array(top[r, c])).cast(kinds[1]), pa.array(value[r, c])], ["query_id", "doc_id", "score"])

    return run


def nearest(questions: DataFrame, vectors: DataFrame, k: int = 10, cosine: bool = True) -> DataFrame:
    """(query_id, doc_id, score, rank): the ``k`` rows of ``vectors`` (doc_id, doc_vector) nearest to each question.

    ``questions`` has (query_id, query_vector) and is meant to be far smaller than ``vectors``: it is counted, and
    ``QUESTIONS_A_PASS`` at a time are sent to all tasks, which multiply them block by block with their batches of
    vectors. Every question meets every vector of its length. A null, empty or zero vector or one with NaN has no
    cosine and is left out. Scores equal to ten digits are ordered by doc_id.
    """
    spark = vectors.sparkSession
    rows = vectors.select("doc_id", "doc_vector").filter(F.size("doc_vector") > 0)
    asked = questions.select("query_id", "query_vector").filter(F.size("query_vector") > 0)
    passes = max(1, -(-asked.count() // QUESTIONS_A_PASS))
    asked = asked.withColumn("pass", F.pmod(F.xxhash64("query_id"), F.lit(passes)))
    kinds = to_arrow_schema(asked.select("query_id").schema).field(0).type, to_arrow_schema(rows.select("doc_id").schema).field(0).type
    schema = f"query_id {asked.schema['query_id'].dataType.simpleString()}, doc_id {rows.schema['doc_id'].dataType.simpleString()}, score double"
    out = None
    for i in range(passes):
        part = asked.filter(F.col("pass") == i).select("query_id", "query_vector").toArrow().combine_chunks()  # about QUESTIONS_A_PASS rows
        names = part.column("query_id").to_pylist()
        made = {}
        for dim, at, block in _by_length(part.column("query_vector").combine_chunks() if part.num_rows else pa.array([], pa.list_(pa.float64()))):
            made[dim] = ([names[j] for j in at], _unit(block) if cosine else block)
        sent = spark.sparkContext.broadcast(made)
        found = rows.mapInArrow(_best(lambda sent=sent: sent.value, k, cosine, kinds), schema)
        out = found if out is None else out.unionByName(found)
    by = Window.partitionBy("query_id").orderBy(F.round("score", EQUAL_DIGITS).desc(), F.col("doc_id"))
    return out.withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= k)


class Store(Protocol):
    """A store of documents that answers questions with scores from 0 to 1, best first."""

    name: str

    def is_ready(self) -> bool: ...

    def init(self) -> None: ...

    def query(self, questions: DataFrame, top_k: int = 10) -> DataFrame: ...


class LexicalStore:
    """A store over an inverted index; ``questions`` has (query_id, text)."""

    name = "lexical"

    def __init__(self, index: Index, docs: DataFrame):
        self.index, self.docs, self.ready = index, docs, False

    def is_ready(self) -> bool:
        return self.ready

    def init(self) -> None:
        self.ready = True

    def query(self, questions: DataFrame, top_k: int = 10) -> DataFrame:
        self.init()
        found = search(self.index, questions, "query_id", "text", top_k, self.docs)
        return min_max(found, out="score_").select("query_id", "doc_id", F.col("score_").alias("score"), "rank")


class VectorStore:
    """A store over exact cosines; ``questions`` has (query_id, query_vector), negative cosines count as 0."""

    name = "vectors"

    def __init__(self, vectors: DataFrame):
        self.vectors, self.ready = vectors, False

    def is_ready(self) -> bool:
        return self.ready

    def init(self) -> None:
        self.ready = True

    def query(self, questions: DataFrame, top_k: int = 10) -> DataFrame:
        self.init()
        found = nearest(questions, self.vectors, top_k)
        return found.withColumn("score", F.greatest(F.lit(0.0), F.least(F.lit(1.0), "score")))
