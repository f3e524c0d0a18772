"""The registered queries of the core operators, by area, and the SQL that they are held against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillspan.catalog import answers, derived, graphs, records, search, texts  # noqa: F401  they register their queries
from quillspan.catalog.registry import ORACLES, QUERIES


def flagship(spark: SparkSession, folder: str) -> DataFrame:
    """Hybrid search: BM25 and dense lists over the chunks, fused by reciprocal ranks."""
    return search.hybrid_rrf(spark, folder)


__all__ = ["ORACLES", "QUERIES", "flagship"]
