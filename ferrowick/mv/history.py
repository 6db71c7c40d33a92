"""Entities with history, and the hubs, links and satellites of a vault.

A change feed has rows of (key, attributes, time); rows of one key at one time are told apart by `order`.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.aggregates import Entity
from . import bitemporal


def business_hash(*columns: str) -> Column:
    """MD5 of the values, each with its length before it, so that no two lists of values share a text; null is `-`."""
    parts = [F.coalesce(F.concat(F.length(F.col(c).cast("string")).cast("string"), F.lit(":"), F.col(c).cast("string")), F.lit("-")) for c in columns]
    return F.md5(F.concat(*parts))


def scd2(df: DataFrame, key: list[str], attributes: list[str], at: str, order: list[str] | None = None) -> DataFrame:
    """key, attributes, valid_from and valid_to (null: still valid): one row for each time that a key's attributes changed.

    Repeated states are one row. A state that another of the same key replaces at the same time has valid_from = valid_to.
    """
    by_key = Window.partitionBy(*key).orderBy(at, *(order or []))
    first = F.row_number().over(by_key) == 1
    moved = reduce(or_, [~F.col(a).eqNullSafe(F.lag(a).over(by_key)) for a in attributes], F.lit(False))
    changes = df.select(*key, *attributes, F.col(at).alias("valid_from"), *(order or []), (first | moved).alias("__new")).where("__new")
    again = Window.partitionBy(*key).orderBy("valid_from", *(order or []))
    return changes.withColumn("valid_to", F.lead("valid_from").over(again)).select(*key, *attributes, "valid_from", "valid_to")


def record(entity: Entity, history: str, log: DataFrame | None, df: DataFrame, at: str) -> DataFrame:
    """The entity's log after a refresh: `none` replaces it, `snapshot` appends all rows, `scd2` those that changed."""
    rows = entity.lower(df)
    if history == "none":
        return rows
    if history == "snapshot":
        return bitemporal.append_snapshot(log, rows, at)
    if history == "scd2":
        return bitemporal.append_delta(log, rows, list(entity.key), at)
    raise ValueError(f"no history {history}")


def hub(df: DataFrame, key: list[str], at: str) -> DataFrame:
    """hub_key, the business key and the time it was first seen. Rows without any part of a key are none."""
    known = df.dropna(how="all", subset=key)
    return known.groupBy(*key).agg(F.min(at).alias("first_seen")).select(business_hash(*key).alias("hub_key"), *key, "first_seen")


def link(df: DataFrame, ends: dict[str, list[str]], at: str) -> DataFrame:
    """link_key, the hub key of each end, and the time the link was first seen. `ends`: business keys by name."""
    every = [c for key in ends.values() for c in key]
    known = df.dropna(how="any", subset=every).groupBy(*every).agg(F.min(at).alias("first_seen"))
    return known.select(business_hash(*every).alias("link_key"), *[business_hash(*key).alias(name) for name, key in ends.items()], "first_seen")


def satellite(df: DataFrame, key: list[str], attributes: list[str], at: str, order: list[str] | None = None) -> DataFrame:
    """hub_key, attributes, their hash and the times from and to which they held."""
    rows = scd2(df, key, attributes, at, order)
    return rows.select(business_hash(*key).alias("hub_key"), *attributes, business_hash(*attributes).alias("state"), "valid_from", "valid_to")
