"""Query op5: counts, the base test and the weakly supervised verdict of every document."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import quality
from .common import table


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents", "doc_id", "text")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "quality"
    )


QUERIES = {"op5_quality_rules": op5_quality_rules}
ORACLE_SQL: dict = {}
