"""Registered queries over the operators, and the SQL they are checked against."""

from __future__ import annotations

from corpusmill.plans import data_queries, pipeline_queries, retrieval_queries, source_queries, stream_queries  # noqa: F401
from corpusmill.plans.registry import ORACLES, QUERIES


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
