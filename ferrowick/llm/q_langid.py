"""Query op9: the language of every document, learnt from the documents outside fold 0."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import langid
from .common import table

FOLDS = 5


def fold(key: Column) -> Column:
    """A document's fold by its id; a null id is as an empty one, whose remainder is 0, so it is held out and teaches nothing."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % FOLDS


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text", "lang")
    trees = langid.learn(docs.where(fold(F.col("doc_id")) != 0))
    out = langid.identify(docs.select("doc_id", "text"), trees).drop("text")
    return out.select("doc_id", (fold(F.col("doc_id")) == 0).alias("held_out"), F.col("_lang_pred").alias("lang_pred"), F.col("_lang_score").alias("score"))


QUERIES = {"op9_language_id": op9_language_id}
ORACLE_SQL: dict = {}
