"""Registered queries of the engine and their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators import fingerprint
from . import checks, cited, corpus, desk, flows, layout, live, reading, records  # noqa: F401  (they register their queries)
from .registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES", "flagship"]


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate documents: fingerprints, near pairs, verification, clusters."""
    return fingerprint.clusters(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
