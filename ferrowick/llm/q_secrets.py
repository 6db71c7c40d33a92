"""Query op8: secrets of every document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import secrets
from .common import new_path, table


def spelled(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["stop"])), ",")


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents come as two commits to one ledger: of the second, blobs that the first had aren't scanned again."""
    ledger = secrets.BlobLedger(spark, new_path(spark, "ledger"))
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    later = F.pmod(F.coalesce(F.xxhash64("doc_id"), F.lit(0)), F.lit(2)) == 1
    found = ledger.scan(docs.where(~later)).unionByName(ledger.scan(docs.where(later)))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("spans", lambda s: s["rank"] < len(secrets.BASE_RULES))
    return found.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(spelled(base), 256).alias("base_sha256"), spelled(F.col("spans")).alias("spans"))


QUERIES = {"op8_secret_scan": op8_secret_scan}
ORACLE_SQL: dict = {}
