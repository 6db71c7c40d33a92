"""Append-only logs of a view's refreshes, and its state as of any time.

Snapshot mode appends all rows of each refresh. Delta mode appends rows that changed, and a tombstone, with all but the
key null, for each key that went. Logs hold sys_recorded_at and, in delta mode, sys_op (upsert or delete).
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.scratch import settings

AT, OP = "sys_recorded_at", "sys_op"


def same(left: str, right: str, columns: list[str]) -> Column:
    """Null-safe equality of columns of two aliased frames."""
    return reduce(and_, [F.col(f"{left}.{c}").eqNullSafe(F.col(f"{right}.{c}")) for c in columns])


def stamp(at: str) -> Column:
    return F.lit(at).cast("timestamp")


def append_snapshot(log: DataFrame | None, rows: DataFrame, at: str) -> DataFrame:
    new = rows.withColumn(AT, stamp(at))
    return new if log is None else log.unionByName(new)


def changes(log: DataFrame | None, rows: DataFrame, key: list[str], at: str) -> DataFrame:
    """What a refresh adds to the log."""
    if log is None:
        return rows.withColumns({AT: stamp(at), OP: F.lit("upsert")})
    now = current(log, key)
    upserts = rows.alias("n").join(now.alias("o"), same("n", "o", rows.columns), "left_anti").withColumns({AT: stamp(at), OP: F.lit("upsert")})
    gone = now.select(*key).alias("o").join(rows.select(*key).alias("n"), same("o", "n", key), "left_anti")
    empty = [F.col(c) if c in key else F.lit(None).cast(rows.schema[c].dataType).alias(c) for c in rows.columns]
    return upserts.unionByName(gone.select(*empty).withColumns({AT: stamp(at), OP: F.lit("delete")}))


def append_delta(log: DataFrame | None, rows: DataFrame, key: list[str], at: str) -> DataFrame:
    new = changes(log, rows, key, at)
    return new if log is None else log.unionByName(new)


def stored_delta(log: DataFrame | None, rows: DataFrame, key: list[str], at: str, path: str) -> DataFrame:
    """As `append_delta`, for a log kept in a folder. Shuffles are cut at 8 MB, as rows of a log compress well: a task sorts some
    hundred thousand rows, however many there are."""
    spark = rows.sparkSession
    new = changes(log, rows, key, at)
    with settings(spark, adaptive__advisoryPartitionSizeInBytes="8m"):
        new.write.mode("append").parquet(path)
    return spark.read.schema(new.schema).parquet(path)


def snapshot_as_of(log: DataFrame, at: str) -> DataFrame:
    """Rows of the last refresh at or before a time."""
    known = log.where(F.col(AT) <= stamp(at))
    last = known.agg(F.max(AT).alias("__last"))
    return known.join(F.broadcast(last), F.col(AT) == F.col("__last")).drop(AT, "__last")  # one row


def delta_as_of(log: DataFrame, key: list[str], at: str | None = None) -> DataFrame:
    """The newest row of each key at or before a time, without deleted ones."""
    known = log if at is None else log.where(F.col(AT) <= stamp(at))
    rest = [c for c in log.columns if c not in (*key, AT, OP)]
    # Dealt out first: a part of the log seldom holds two versions of a key, and max_by would sort each part before the shuffle.
    newest = known.repartition(*key).groupBy(*key).agg(F.max_by(F.struct(*rest, OP), F.col(AT)).alias("r"))
    return newest.where(F.col(f"r.{OP}") != "delete").select(*[F.col(c) if c in key else F.col(f"r.{c}").alias(c) for c in log.columns if c not in (AT, OP)])


def current(log: DataFrame, key: list[str]) -> DataFrame:
    return delta_as_of(log, key)


def valid_at(df: DataFrame, at: str, valid_from: str = "valid_from", valid_to: str = "valid_to") -> DataFrame:
    """Rows valid at a time: from is inclusive, to exclusive or open."""
    return df.where((F.col(valid_from) <= stamp(at)) & (F.col(valid_to).isNull() | (F.col(valid_to) > stamp(at))))
