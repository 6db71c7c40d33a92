"""Governed views: what a role sees of a table.

Rules are applied inside the view, before anything a query does, so no expression, join or ordering can reach what is
hidden: predicates and aggregates see masked values. A rule on the nullable side of an outer join filters that side only.
"""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .model import Mask, ModelError, Role, SemanticModel, Table
from .plans.inspect import parts_of

# The values that the names MIN and MAX stand for in constant masks.
EXTREMES = {
    "short": (-(2**15), 2**15 - 1), "int": (-(2**31), 2**31 - 1), "long": (-(2**63), 2**63 - 1),
    "date": ("0001-01-01", "9999-12-31"), "timestamp": ("0001-01-01 00:00:00", "9999-12-31 23:59:59"),
}


class NotAllowed(PermissionError):
    """The role may not see the table, the column or the join."""


def masked(column: str, kind: T.DataType, mask: Mask) -> Column:
    """The mask's expression, checked against the column's type."""
    here = F.col(f"`{column}`")
    if mask.kind == "regex":
        if not isinstance(kind, T.StringType):
            raise ModelError(f"a regex mask needs a text column; {column} is {kind.simpleString()}")
        return F.regexp_replace(here, mask.pattern, mask.replacement)
    if mask.kind == "truncate":
        if not isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)):
            raise ModelError(f"a truncating mask needs a date or timestamp; {column} is {kind.simpleString()}")
        return F.date_trunc(mask.unit, here).cast(kind)
    if mask.kind == "constant":
        value = mask.value
        if value in ("MIN", "MAX"):
            name = {"bigint": "long", "smallint": "short", "timestamp_ntz": "timestamp"}.get(kind.simpleString(), kind.simpleString())
            if name not in EXTREMES:
                raise ModelError(f"{column} has no {value}")
            value = EXTREMES[name][value == "MAX"]
        return F.lit(value).cast(kind)
    raise ModelError(f"no mask of kind {mask.kind}")


def visible_columns(columns: list[str], role: Role, table: str) -> list[str]:
    return [c for c in columns if (table, c) not in role.hidden]


def may_read(role: Role, table: Table) -> bool:
    """Whether the table is of the role's domains."""
    return table.derived or role.domains is None or table.domain in role.domains


def governed(df: DataFrame, model: SemanticModel, role_name: str, table: str) -> DataFrame:
    """`df` as the role sees it: rows, then masks, then visible columns. Row rules see true values."""
    role, known = model.role(role_name), model.table(table)
    if not may_read(role, known):
        raise NotAllowed(f"{role_name} may not read domain {known.domain}")
    rule = role.rows.get(table, None if known.derived else role.domain_rows.get(known.domain))
    out = df.where(rule) if rule else df
    masks = {c: m for (t, c), m in role.masks.items() if t == table}
    shown = visible_columns(df.columns, role, table)
    return out.select(*[masked(c, df.schema[c].dataType, masks[c]).alias(c) if c in masks else F.col(f"`{c}`") for c in shown])


def capped(df: DataFrame, role: Role, limit: int | None = None) -> DataFrame:
    """At most the role's row cap; a role without one has full results."""
    limits = [x for x in (role.row_cap, limit) if x is not None]
    return df.limit(min(limits)) if limits else df


def check_complexity(spec, max_depth: int | None, max_nodes: int | None) -> None:
    """Refuse a nested field selection that is too deep or too wide; None is no limit."""

    def measure(fields) -> tuple[int, int]:
        depth, nodes = 1, len(fields)
        for f in fields:
            if isinstance(f, dict):
                for inner in f.values():
                    d, n = measure(inner["fields"] if isinstance(inner, dict) else inner)
                    depth, nodes = max(depth, d + 1), nodes + n
        return depth, nodes

    depth, nodes = measure(spec)
    if max_depth is not None and depth > max_depth or max_nodes is not None and nodes > max_nodes:
        raise NotAllowed(f"selection of depth {depth} with {nodes} fields exceeds {max_depth} and {max_nodes}")


#: Kinds of plan nodes of statements that do more than read.
WRITES = re.compile("Insert|Command|Create|Drop|Delete|Update|Merge|Alter|Truncate|Cache|Load|Refresh|Analyze|Set[A-Z]|UseN|Call|Replace|Describe|Show")


def check_statement(spark: SparkSession, statement: str, readable: set[str]) -> None:
    """Refuse a statement that reads anything but `readable` tables and its own common table expressions, or that writes.

    Path relations, catalog tables and temporary views of others are none of the model's, so they are refused by their
    names. A common table expression may not be named as one of them either, as it could stand for it elsewhere.
    """
    relations, ctes, kinds = parts_of(spark, statement)
    if did := sorted(k for k in kinds if WRITES.search(k)):
        raise NotAllowed(f"only queries may be run, not {did}")
    foreign = {r for r in relations - ctes if r not in readable} | {c for c in ctes - readable if spark.catalog.tableExists(c)}
    if foreign:
        raise NotAllowed(f"not among the tables that this role may read: {sorted(foreign)}")


def result_key(df: DataFrame, role: Role) -> str:
    """A cache key that equal queries of equally governed roles share. Volatile queries have none: see plans.inspect."""
    rules = repr((sorted(role.rows.items()), sorted(role.domain_rows.items()), sorted(map(repr, role.masks.items())), sorted(role.hidden)))
    return hashlib.sha256(f"{df.semanticHash()}|{role.name}|{rules}".encode()).hexdigest()
