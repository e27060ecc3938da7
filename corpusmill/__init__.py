"""Ranked retrieval, sequence, graph and text analytics as PySpark DataFrame operators."""

__all__ = ["functions", "operators", "plans", "sources", "streaming"]
