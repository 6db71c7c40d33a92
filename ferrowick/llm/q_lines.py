"""Query op2: documents without their repeated lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import linededup
from .common import table


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = linededup.dedup_lines(table(spark, sf_dir, "documents", "doc_id", "text"))
    return out.select("doc_id", F.col("_line_n_lines").alias("n_lines"), F.col("_line_n_dropped").alias("n_dropped"), F.sha2("text", 256).alias("kept_sha256"))


QUERIES = {"op2_line_dedup": op2_line_dedup}

ORACLE_SQL = {
    "op2_line_dedup": """
WITH split AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS n FROM documents),
keyed AS (
  SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM split),
hot AS (
  SELECT k, max(doc_id) AS last_doc FROM keyed WHERE length(k) >= 20 GROUP BY k HAVING count(DISTINCT doc_id) >= 3),
marked AS (
  SELECT keyed.*, hot.k IS NOT NULL AND hot.last_doc <> doc_id AS dropped FROM keyed LEFT JOIN hot USING (k))
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (dropped)::BIGINT AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY n) FILTER (NOT dropped), '')) AS kept_sha256
FROM marked GROUP BY doc_id"""
}
