"""Query op4: every document encoded by byte-level BPE and decoded again."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe
from .common import table

VOCABULARY = "byte_bpe_multi_50k.tiktoken"


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    using = (public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN)
    out = bpe.round_trip(table(spark, sf_dir, "documents", "doc_id", "text"), *using)
    return out.select(
        "doc_id",
        (F.octet_length("_bpe_ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("_bpe_ids", 256).alias("ids_sha256"),
        F.sha2("_bpe_bytes", 256).alias("decoded_sha256"),
    )


QUERIES = {"op4_byte_bpe": op4_byte_bpe}
ORACLE_SQL: dict = {}
