"""Inserts, updates and deletes as new states of a table (copy on write), under the role's rules.

A role changes only rows it sees and columns shown to it unmasked. Presets of the table are set on every row that is
written. Each function returns the whole new table, for the caller to write.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..govern import NotAllowed
from ..model import ModelError
from ..mv.delta import land
from .filters import where


def _rule(engine, table: str) -> Column:
    """Which rows the role may change; a row on which the rule is null is not one of them."""
    role, domain = engine.model.role(engine.role), engine.model.table(table).domain
    if role.domains is not None and domain not in role.domains:
        raise NotAllowed(f"{engine.role} may not write domain {domain}")
    rule = role.rows.get(table, role.domain_rows.get(domain))
    return F.coalesce(F.expr(rule), F.lit(False)) if rule else F.lit(True)


def _may_set(engine, table: str, columns) -> None:
    role = engine.model.role(engine.role)
    closed = {c for t, c in (*role.masks, *role.hidden) if t == table}
    if closed & set(columns):
        raise NotAllowed(f"{engine.role} may not set {sorted(closed & set(columns))}")


def _preset(engine, table: str, df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.expr(e).cast(df.schema[c].dataType) for c, e in engine.model.table(table).presets})


def _raw(engine, table: str) -> DataFrame:
    return engine.overlay[table] if table in engine.overlay else engine.load(table)


def insert(engine, table: str, rows: DataFrame, upsert: bool = False) -> DataFrame:
    """The table with new rows; with `upsert` they replace those of equal key that the role may change. Missing columns are null."""
    now, rule = _raw(engine, table), _rule(engine, table)
    _may_set(engine, table, rows.columns)
    if extra := set(rows.columns) - set(now.columns):
        raise ModelError(f"{table} has no columns {sorted(extra)}")
    full = now.limit(0).unionByName(rows, allowMissingColumns=True).select(*now.columns)
    full = _preset(engine, table, full).where(rule)
    if not upsert:
        return now.unionByName(full)
    key = list(engine.model.table(table).key)
    held = now.where(~rule).select(*key)  # rows of other roles' keys stay as they are
    return land(now, full.join(held, key, "left_anti"), key, "upsert")


def update(engine, table: str, values: dict[str, str], where_: dict) -> DataFrame:
    """The table with SQL expressions set on the rows that a where tree picks among those the role sees."""
    now = _raw(engine, table)
    _may_set(engine, table, values)
    hit = F.coalesce(_rule(engine, table) & where(where_, now.schema), F.lit(False))
    new = dict(values) | dict(engine.model.table(table).presets)
    return now.withColumn("__hit", hit).select(*[F.when(F.col("__hit"), F.expr(new[c]).cast(now.schema[c].dataType)).otherwise(F.col(c)).alias(c) if c in new else F.col(c) for c in now.columns])


def delete(engine, table: str, where_: dict) -> DataFrame:
    """The table without the rows that a where tree picks among those the role sees."""
    now = _raw(engine, table)
    return now.where(~F.coalesce(_rule(engine, table) & where(where_, now.schema), F.lit(False)))
