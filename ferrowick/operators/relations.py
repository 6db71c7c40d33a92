"""Selecting from tables with nested relationships, and joins along the model's paths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..model import ModelError, Relationship
from ..types import comparable
from .filters import order_by, where


def link(left: DataFrame, right: DataFrame, r: Relationship, prefix: str) -> tuple[DataFrame, Column]:
    """`right` with its columns prefixed, and the condition that joins it. Sides of different type families compare as text."""
    a = left.select(F.expr(r.source_column).alias("k")).schema["k"].dataType
    b = right.select(F.expr(r.target_column).alias("k")).schema["k"].dataType
    keyed = right.withColumn("__key", F.expr(r.target_column)).select(*[F.col(c).alias(f"{prefix}{c}") for c in [*right.columns, "__key"]])
    one, two = comparable(F.expr(r.source_column), a, F.col(f"{prefix}__key"), b)
    return keyed, one == two


def join_flat(left: DataFrame, right: DataFrame, r: Relationship, how: str = "left", prefix: str = "") -> DataFrame:
    """One row for each match, the target's columns prefixed."""
    keyed, condition = link(left, right, r, prefix)
    return left.join(keyed, condition, how).drop(f"{prefix}__key")


def top_per_parent(df: DataFrame, keys: list[str], order: list, limit: int, offset: int = 0) -> DataFrame:
    """Rows offset + 1 to offset + limit of each group, in a total order given by the caller."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order_by(order)))
    return df.withColumn("__place", place).where((F.col("__place") > offset) & (F.col("__place") <= offset + limit)).drop("__place")


def distinct_on(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The first row of each group. The order is required: without one the row would be arbitrary."""
    if not order:
        raise ModelError("distinct_on needs an order")
    return top_per_parent(df, keys, order, 1)


def nested(engine, table: str, df: DataFrame, name: str, spec: dict) -> tuple[DataFrame, Column]:
    """`df` joined with a relationship, and the column that holds it: a struct to one, an array of structs to many.

    `spec`: fields, and where, order_by, limit and offset for each parent.
    """
    r = engine.model.relationship(table, name)
    right = engine.table(r.target)
    right = right.where(where(spec.get("where"), right.schema))
    key = f"__{name}_key"
    keyed = right.withColumn(key, F.expr(r.target_column))
    if "limit" in spec or "offset" in spec:
        if not spec.get("order_by"):
            raise ModelError(f"a limit on {name} needs an order")
        keyed = top_per_parent(keyed, [key], spec["order_by"], spec.get("limit", 2**31 - 1), spec.get("offset", 0))
    inner, fields = selected(engine, r.target, keyed, spec["fields"])
    row = F.struct(*[c.alias(n) for n, c in fields])
    left_type = df.select(F.expr(r.source_column).alias("k")).schema["k"].dataType
    one, two = comparable(F.expr(r.source_column), left_type, F.col(key), right.select(F.expr(r.target_column).alias("k")).schema["k"].dataType)
    if r.many:
        place = F.struct(*[F.col(c) for c, _ in map(_named, spec["order_by"])]) if spec.get("order_by") else row
        rows = inner.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(place.alias("o"), row.alias("row")))).alias(f"__{name}"))
        listed = F.transform(F.coalesce(F.col(f"__{name}"), F.array()), lambda x: x["row"])
        if spec.get("order_by") and all(d.startswith("desc") for _, d in map(_named, spec["order_by"])):
            listed = F.reverse(listed)
        return df.join(rows, one == two, "left"), listed
    rows = inner.select(F.col(key), row.alias(f"__{name}"))
    return df.join(rows, one == two, "left"), F.col(f"__{name}")


def _named(item) -> tuple[str, str]:
    return (item, "asc") if isinstance(item, str) else item


def selected(engine, table: str, df: DataFrame, fields: list) -> tuple[DataFrame, list[tuple[str, Column]]]:
    """Resolve field specs: a name, (alias, name or SQL expression), or {relationship: fields or a spec of them}."""
    out: list[tuple[str, Column]] = []
    virtual = {"_name_": table, "_domain_": engine.model.table(table).domain}
    for f in fields:
        if isinstance(f, dict):
            for name, spec in f.items():
                df, column = nested(engine, table, df, name, spec if isinstance(spec, dict) else {"fields": spec})
                out.append((name, column))
        elif isinstance(f, tuple):
            out.append((f[0], F.lit(virtual[f[1]]) if f[1] in virtual else F.expr(f[1])))
        elif f in virtual:
            out.append((f, F.lit(virtual[f])))
        elif f in df.columns:
            out.append((f, F.col(f"`{f}`")))
        else:
            raise ModelError(f"{table} has no column {f} that this role sees")
    return df, out


def select(engine, table: str, fields: list, where_: dict | None = None, order: list | None = None, limit: int | None = None, offset: int | None = None, distinct: list[str] | None = None, sample: float | None = None, seed: int = 0) -> DataFrame:
    """Rows of one governed table with nested relationships. `sample` is a percentage above 0 and up to 100."""
    virtual = {"_name_": table, "_domain_": engine.model.table(table).domain}
    df = engine.table(table)
    df = df.where(where(where_, df.schema, virtual))
    if sample is not None:
        if not 0 < sample <= 100:
            raise ModelError("a sample is a percentage above 0 and up to 100")
        df = df.sample(fraction=sample / 100, seed=seed)
    if distinct:
        df = distinct_on(df, distinct, order or [])
    if order:
        df = df.orderBy(*order_by(order))
    if offset:
        df = df.offset(offset)
    df = engine.capped(df, limit)
    df, columns = selected(engine, table, df, fields)
    # The joins of nested selections keep no order.
    if order and any(isinstance(f, dict) for f in fields):
        df = df.orderBy(*order_by(order))
    return df.select(*[c.alias(n) for n, c in columns])


def normalized(engine, table: str, fields: list) -> dict[str, DataFrame]:
    """A nested selection shredded into one distinct table for each relationship path, with the key that links it to its parent."""
    out: dict[str, DataFrame] = {}

    def visit(name: str, at: str, df: DataFrame, fields: list, extra: list[str]) -> None:
        plain = [f for f in fields if not isinstance(f, dict)]
        out[name] = df.select(*dict.fromkeys([*extra, *plain])).distinct()
        for f in fields:
            if isinstance(f, dict):
                for rel, inner in f.items():
                    r = engine.model.relationship(at, rel)
                    keys = df.select(F.expr(r.source_column).alias("__k")).distinct()
                    right = engine.table(r.target)
                    matched = right.join(keys, F.expr(r.target_column) == F.col("__k"), "left_semi")
                    visit(f"{name}.{rel}", r.target, matched, inner, [r.target_column])

    visit(table, table, engine.table(table), fields, list(engine.model.table(table).key))
    return out


def pruned_cycles(edges: list[tuple[str, str]], start: str) -> tuple[list[tuple[str, str]], list[tuple[str, str]]]:
    """Join edges reached from `start` without, and those that would close, a cycle."""
    kept, back, path, done = [], [], set(), set()

    def visit(node: str) -> None:
        path.add(node)
        for edge in edges:
            if edge[0] == node:
                if edge[1] in path:
                    back.append(edge)
                else:
                    kept.append(edge)
                    if edge[1] not in done:
                        visit(edge[1])
        path.discard(node)
        done.add(node)

    visit(start)
    return kept, back
