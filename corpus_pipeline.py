"""Stages that turn `documents` into packed training sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written and read again as the next one's docs.
All but the last return the columns of `documents`. SQL can't express the stages (language models, near duplicates,
tokenizers), so their rows are tested against brute-force versions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ferrowick.llm import langid, linededup, ngramjoin, q_packing, secrets
from ferrowick.llm.common import Scratch, new_path

#: A document whose best language is less probable than this under equal priors is of no known language.
LEAST_LANGUAGE_SCORE = 0.5


def with_text(docs: DataFrame, text: Column) -> DataFrame:
    """`docs` with another text and, where there is such a column, its length."""
    out = docs.withColumn("text", text)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of a language that the corpus's labels teach; those without letters and those of no one language go."""
    found = langid.identify(docs, langid.learn(docs))
    kept = (F.col("_lang_pred") != langid.UNDETERMINED) & (F.col("_lang_score") >= LEAST_LANGUAGE_SCORE)
    return found.where(kept).select(*docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that repeat over documents; the largest document id that holds such a line keeps it."""
    out = linededup.dedup_lines(docs)
    return with_text(out, F.col("text")).select(*docs.columns)


def ngram_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, the one with the smallest id."""
    groups = ngramjoin.jaccard_groups(docs.select("doc_id", "text"))
    going = groups.where("component_id <> doc_id").select("doc_id").distinct()
    return docs.join(going.hint("shuffle_hash"), "doc_id", "left_anti").select(*docs.columns)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their secrets put as [secret]."""
    ledger = secrets.BlobLedger(spark, new_path(spark, "ledger"))
    ledger.scan(docs.select("doc_id", "text"))
    hits = ledger.findings().select(F.col("blob").alias("_blob"), F.col("spans").alias("_spans"))
    found = docs.withColumn("_blob", F.sha2(F.coalesce("text", F.lit("")), 256)).join(hits.hint("shuffle_hash"), "_blob", "left")
    return with_text(found, F.when(F.col("_spans").isNull(), F.col("text")).otherwise(secrets.redacted(F.col("text"), F.col("_spans")))).select(*docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of at most 2,048 tokens."""
    return q_packing.packed(docs)


STAGES = [
    ("language ID", language_id),
    ("line dedup", line_dedup),
    ("n-gram Jaccard join", ngram_join),
    ("secret scans", secret_scan),
    ("packing", packing),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to the table documents. A stage's table goes when the next one is written; the last stage reads its own."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    scratch = Scratch(spark)
    for name, stage in STAGES[:-1]:
        before, docs = docs, scratch.stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        scratch.free(before)
    return STAGES[-1][1](spark, docs, sf_dir)
