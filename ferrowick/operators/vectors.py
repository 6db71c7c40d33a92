"""Exact vector search."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import cosine_similarity
from ..model import ModelError


def top_k(df: DataFrame, vector: str, query: list[float], k: int, key: str, dimensions: int | None = None) -> DataFrame:
    """The k rows most similar to a query, equal similarities in order of key. Only each partition's k best rows are gathered."""
    if dimensions is not None and len(query) != dimensions:
        raise ModelError(f"the column has {dimensions} dimensions, the query {len(query)}")
    scored = df.withColumn("similarity", cosine_similarity(F.col(vector), F.array(*map(F.lit, query))))
    return scored.where("similarity IS NOT NULL").orderBy(F.desc("similarity"), key).limit(k)


#: Queries and rows that are compared in one block.
QUERY_BLOCK, ROW_BLOCK = 512, 8192


def top_k_of_each(df: DataFrame, vector: str, key: str, queries: DataFrame, k: int) -> DataFrame:
    """query_id, key, similarity: for each row of `queries` (same columns) the k rows of `df` most similar to it, equal ones in order of key.

    Blocks of queries meet blocks of rows, each pair of blocks in one group of bounded size, of which a query's k best
    leave. Null vectors, zero ones and those with null components are similar to nothing.
    """
    usable = F.col("v").isNotNull() & ~F.exists("v", lambda x: x.isNull()) & F.exists("v", lambda x: x != 0)
    side = lambda x: x.select(F.col(key).alias("id"), F.col(vector).cast("array<double>").alias("v")).where(usable)
    rows, asked = side(df), side(queries)
    n_rows, n_asked = (-(-x.count() // size) or 1 for x, size in ((rows, ROW_BLOCK), (asked, QUERY_BLOCK)))
    place = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    both = rows.select("*", F.lit(False).alias("asks"), every(n_asked).alias("q")).withColumn("r", place(n_rows))
    both = both.unionByName(asked.select("*", F.lit(True).alias("asks"), every(n_rows).alias("r")).withColumn("q", place(n_asked)))

    def best(block: pd.DataFrame) -> pd.DataFrame:
        out = []
        for _, same in block.groupby(block["v"].map(len)):
            unit = np.array(same["v"].tolist(), np.float64)
            unit /= np.linalg.norm(unit, axis=1, keepdims=True)
            asks, ids = same["asks"].to_numpy(), same["id"].to_numpy()
            order = np.argsort(ids[~asks], kind="stable")
            found = unit[asks] @ unit[~asks][order].T
            first = np.argsort(-found, axis=1, kind="stable")[:, :k]
            for query, row, at in zip(ids[asks], found, first, strict=True):
                out.append(pd.DataFrame({"query_id": query, "id": ids[~asks][order][at], "similarity": row[at]}))
        return pd.concat(out) if out else pd.DataFrame({"query_id": [], "id": [], "similarity": []})

    kind = df.schema[key].dataType.simpleString()
    found = both.groupBy("q", "r").applyInPandas(best, f"query_id {kind}, id {kind}, similarity double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("similarity"), "id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("id").alias(key), "similarity")
