"""Query op1: groups of documents with similar 5-word shingles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import ngramjoin
from .common import table


def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngramjoin.jaccard_groups(table(spark, sf_dir, "documents", "doc_id", "text"))


QUERIES = {"op1_ngram_join": op1_ngram_join}
ORACLE_SQL: dict = {}
