"""Query op6: every document's ids written to sorted shards and read back."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shards, tokens
from .common import new_path, table

VOCABULARY = "word_bpe_49k.json"
END = 2


def encode_with_end(path: str):
    def prepare():
        own, end = tokens.encoder(path, False), END.to_bytes(4, "little")
        return lambda texts: [ids + end for ids in own.encode(texts)]

    return prepare


def op6_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    written = shards.write_shards(docs, new_path(spark, "shards"), encode_with_end(public_tokenizers.path(VOCABULARY)))
    return shards.read_shards(written).select("doc_id", "start", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))


QUERIES = {"op6_token_shards": op6_token_shards}
ORACLE_SQL: dict = {}
