"""All registered queries and the flagship."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import candidates as C
from . import catalog_model, catalog_report, catalog_sinks, catalog_streams, catalog_tables, catalog_text
from .registry import ORACLES, QUERIES

__all__ = ["catalog_model", "catalog_report", "catalog_sinks", "catalog_streams", "catalog_tables", "ORACLES", "QUERIES", "flagship"]


def flagship(spark: SparkSession, sf: str) -> DataFrame:
    """Candidates per category over all documents: guards, parse, detect, verify, group."""
    found = C.candidates_of(catalog_text.audited(spark, sf))
    return found.groupBy("category").agg(
        F.count(F.lit(1)).alias("candidates"), F.sum(F.size("occurrences")).alias("occurrences"), F.countDistinct("doc_id").alias("documents")
    )
