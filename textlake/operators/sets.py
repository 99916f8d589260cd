"""Set operations on frames of ``doc_id``."""

from __future__ import annotations

from pyspark.sql import DataFrame


def and_(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select("doc_id").intersect(b.select("doc_id"))


def or_(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select("doc_id").union(b.select("doc_id")).distinct()


def xor(a: DataFrame, b: DataFrame) -> DataFrame:
    """Ids in just one of two sets."""
    both = a.select("doc_id").distinct().union(b.select("doc_id").distinct())
    return both.groupBy("doc_id").count().filter("count = 1").select("doc_id")


def not_(a: DataFrame, every: DataFrame) -> DataFrame:
    """Ids of ``every`` that are not in ``a``."""
    return every.select("doc_id").distinct().join(a.select("doc_id"), "doc_id", "left_anti")
