"""Query op7: all documents packed into sequences of at most 2,048 tokens."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import packing, tokens
from .common import table

VOCABULARY = "byte_bpe_50k.json"
END = 1


def encode_with_end(path: str):
    """A maker of functions from texts to ids with the end id."""

    def prepare():
        own, end = tokens.encoder(path, True), END.to_bytes(4, "little")
        return lambda texts: [ids + end for ids in own.encode(texts)]

    return prepare


def packed(docs: DataFrame) -> DataFrame:
    out = packing.pack_documents(docs, encode_with_end(public_tokenizers.path(VOCABULARY)))
    return out.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(table(spark, sf_dir, "documents", "doc_id", "text"))


QUERIES = {"op7_packing": op7_packing}
ORACLE_SQL: dict = {}
