"""Registry of the queries of this subpackage."""

from __future__ import annotations

from . import q_bpe, q_chat, q_langid, q_lines, q_ngram, q_packing, q_quality, q_secrets, q_shards, q_vectors

QUERIES: dict = {}
ORACLE_SQL: dict = {}
for module in (q_bpe, q_chat, q_langid, q_lines, q_ngram, q_packing, q_quality, q_secrets, q_shards, q_vectors):
    QUERIES |= module.QUERIES
    ORACLE_SQL |= module.ORACLE_SQL
