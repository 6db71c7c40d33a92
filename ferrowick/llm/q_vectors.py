"""Query op3: near-duplicate embeddings within each label."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import vectordup
from .common import table


def op3_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectordup.near_duplicates(table(spark, sf_dir, "embeddings", "vec_id", "embedding", "label"))


QUERIES = {"op3_embedding_dedup": op3_embedding_dedup}
ORACLE_SQL: dict = {}
