"""Row deltas between two states of a view, a ledger of them, and its folds."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

VERSION = "refresh_version"


def row_json(columns: list[str], prefix: str = "") -> Column:
    """Canonical JSON of a row: columns by name, nulls and microseconds kept."""
    times = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}
    return F.to_json(F.struct(*[F.col(f"{prefix}{c}").alias(c) for c in sorted(columns)]), {"ignoreNullFields": "false", **times})


def without(df: DataFrame, keys: DataFrame, key: list[str]) -> DataFrame:
    """The rows of `df` whose key is not among `keys`; null keys are equal."""
    other = keys.select(*[F.col(f"`{k}`").alias(f"__key_{k}") for k in key])
    return df.join(other, reduce(lambda a, b: a & b, [F.col(f"`{k}`").eqNullSafe(F.col(f"`__key_{k}`")) for k in key]), "left_anti")


def row_delta(old: DataFrame, new: DataFrame, key: list[str], exclude: tuple[str, ...] = ()) -> DataFrame:
    """key, change_type (insert, update, delete), old_hash, new_hash, old_values, new_values of the rows that differ."""
    compared = [c for c in new.columns if c not in exclude]

    def side(df: DataFrame, name: str) -> DataFrame:
        values = row_json(compared)
        return df.select(*[F.col(k).alias(f"{name}_{k}") for k in key], F.md5(values).alias(f"{name}_hash"), row_json(new.columns).alias(f"{name}_values"))

    match = None
    for k in key:
        test = F.col(f"old_{k}").eqNullSafe(F.col(f"new_{k}"))
        match = test if match is None else match & test
    both = side(old, "old").join(side(new, "new"), match, "full")
    kind = F.when(F.col("old_hash").isNull(), "insert").when(F.col("new_hash").isNull(), "delete").when(F.col("old_hash") != F.col("new_hash"), "update")
    changed = both.withColumn("change_type", kind).where("change_type IS NOT NULL")
    return changed.select(*[F.coalesce(f"new_{k}", f"old_{k}").alias(k) for k in key], "change_type", "old_hash", "new_hash", "old_values", "new_values")


def append(ledger: DataFrame | None, delta: DataFrame, version: int) -> DataFrame:
    """The ledger with a refresh's delta. Whether a delta is empty, and so takes no version, is the caller's test."""
    new = delta.withColumn(VERSION, F.lit(version).cast("long"))
    return new if ledger is None else ledger.unionByName(new)


def forward(ledger: DataFrame, key: list[str], version: int, schema: str) -> DataFrame:
    """The state after a version, from the start: each key's last event up to it, unless that is a delete."""
    last = ledger.where(F.col(VERSION) <= version).groupBy(*key).agg(F.max_by(F.struct("change_type", "new_values"), VERSION).alias("e"))
    return last.where("e.change_type <> 'delete'").select(F.from_json("e.new_values", schema).alias("v")).select("v.*")


def reverse(live: DataFrame, ledger: DataFrame, key: list[str], version: int, schema: str) -> DataFrame:
    """The state after a version, from the live state back: keys changed since get the old values of their first later event."""
    later = ledger.where(F.col(VERSION) > version).groupBy(*key).agg(F.min_by(F.struct("change_type", "old_values"), VERSION).alias("e"))
    kept = without(live, later, key)
    back = later.where("e.change_type <> 'insert'").select(F.from_json("e.old_values", schema).alias("v")).select("v.*")
    return kept.unionByName(back.select(*live.columns))


def apply(target: DataFrame, delta: DataFrame, key: list[str], schema: str) -> DataFrame:
    """Incremental maintenance: `target` with a delta of its one input applied by key."""
    kept = without(target, delta, key)
    rows = delta.where("change_type <> 'delete'").select(F.from_json("new_values", schema).alias("v")).select("v.*")
    return kept.unionByName(rows.select(*target.columns))


def land(target: DataFrame, rows: DataFrame, key: list[str] | None, mode: str) -> DataFrame:
    """replace; append, which upserts where there is a key; or upsert."""
    if mode == "replace":
        return rows
    if not key:
        return target.unionByName(rows)
    return without(target, rows, key).unionByName(rows)


def latest_changes(events: DataFrame, key: list[str], order: list[str], op: str = "op") -> DataFrame:
    """Change events as state: each key's last event in `order`, deletes dropped."""
    rest = [c for c in events.columns if c not in key]
    last = events.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("e"))
    return last.where(F.col(f"e.{op}") != "delete").select(*[F.col(c) if c in key else F.col(f"e.{c}").alias(c) for c in events.columns if c != op])


def content_hash(df: DataFrame) -> tuple[int, int]:
    """Row count and a sum of row hashes: equal for equal multisets of rows in any order."""
    row = df.agg(F.count("*").alias("n"), F.sum(F.xxhash64(row_json(df.columns)).cast("decimal(38,0)")).alias("h")).first()
    return row["n"], int(row["h"] or 0)
