"""Aggregates, grouping, having, metrics over joined dimensions, entities and facts."""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..model import ModelError, SemanticModel
from .filters import COMPARISONS, where
from .relations import join_flat

FUNCTIONS = {"sum": F.sum, "avg": F.avg, "stddev": F.stddev_samp, "variance": F.var_samp, "min": F.min, "max": F.max, "count_distinct": F.count_distinct}
NUMERIC_ONLY = {"sum", "avg", "stddev", "variance"}


def measures(schema: T.StructType, spec: dict, condition: Column | None = None) -> list[Column]:
    """Aggregate columns `function_column`, and `count`. With a condition each sees only the rows that meet it."""
    out = []
    for name, columns in spec.items():
        if name == "count":
            out.append((F.count("*") if condition is None else F.count(F.when(condition, 1))).alias("count"))
            continue
        if name not in FUNCTIONS:
            raise ModelError(f"no aggregate {name}")
        for c in columns:
            kind = schema[c].dataType
            if name in NUMERIC_ONLY and not isinstance(kind, T.NumericType):
                raise ModelError(f"{name} needs a number; {c} is {kind.simpleString()}")
            value = F.col(c) if condition is None else F.when(condition, F.col(c))
            out.append(FUNCTIONS[name](value).alias(f"{name}_{c}"))
    return out


def aggregate(df: DataFrame, spec: dict, where_: dict | None = None, filter_: dict | None = None) -> DataFrame:
    """One row of aggregates."""
    kept = df.where(where(where_, df.schema))
    return kept.agg(*measures(df.schema, spec, where(filter_, df.schema) if filter_ else None))


def group_by(df: DataFrame, by: list[str], spec: dict, where_: dict | None = None, filter_: dict | None = None, having: dict | None = None, nodes: list[str] | None = None) -> DataFrame:
    """Aggregates for each group. `having`: {aggregate column: {op: value}}; `nodes`: columns of the rows to list as `nodes`."""
    columns = measures(df.schema, spec, where(filter_, df.schema) if filter_ else None)
    if nodes:
        columns.append(F.sort_array(F.collect_list(F.struct(*nodes))).alias("nodes"))
    out = df.where(where(where_, df.schema)).groupBy(*by).agg(*columns)
    tests = [COMPARISONS[op](F.col(name), value) for name, test in (having or {}).items() for op, value in test.items()]
    return out.where(reduce(and_, tests)) if tests else out


def joined_for(engine, start: str, dimensions: list[str], max_hops: int = 6) -> tuple[DataFrame, dict[str, str]]:
    """`start` joined along the shortest relationship paths to the tables of `table.column` dimensions.

    Only paths to one, by columns, are taken, so measures aren't counted twice. Returns the column that each dimension has.
    """
    df, columns, done = engine.table(start), {}, {start: ""}
    for dimension in dimensions:
        table, _, column = dimension.rpartition(".")
        table = table or start
        if table not in done:
            paths = [p for p in engine.model.paths(start, table, max_hops) if all(not r.many and r.source_column.isidentifier() for r in p)]
            if not paths:
                raise ModelError(f"no path to one from {start} to {table}")
            for r in paths[0]:
                if r.target not in done:
                    before = done[r.source]
                    moved = type(r)(r.name, r.source, f"`{before}{r.source_column}`", r.target, r.target_column, r.many)
                    done[r.target] = f"{r.target}__"
                    df = join_flat(df, engine.table(r.target), moved, "left", done[r.target])
        columns[dimension] = f"{done[table]}{column}"
        if columns[dimension] not in df.columns:
            raise ModelError(f"no column {dimension} that this role sees")
    return df, columns


def metric_query(engine, names: list[str], dimensions: list[str], filters: list[str] | None = None) -> DataFrame:
    """Metrics of one table by dimensions of it and of tables it points to; columns are named by their last part."""
    found = [engine.model.metrics[n] for n in names]
    if len({m.table for m in found}) != 1:
        raise ModelError("metrics of one query are of one table")
    df, columns = joined_for(engine, found[0].table, dimensions)
    for f in filters or []:
        df = df.where(f)
    keys = [F.col(columns[d]).alias(d.rpartition(".")[2]) for d in dimensions]
    return df.groupBy(*keys).agg(*[F.expr(m.expression).alias(m.name) for m in found])


def expand_metrics(sql: str, model: SemanticModel) -> str:
    """`metric('name')` in an expression, replaced by the metric's own in parentheses."""

    def put(m: re.Match) -> str:
        if m[1] not in model.metrics:
            raise ModelError(f"no metric {m[1]}")
        return f"({model.metrics[m[1]].expression})"

    return re.sub(r"\bmetric\(\s*'([^']+)'\s*\)", put, sql)


@dataclass(frozen=True)
class Entity:
    """A keyed projection. With `dedupe` the newest row by `version` (or else the largest) of each key stays."""

    key: tuple[str, ...]
    attributes: tuple[str, ...] = ()
    version: str | None = None
    dedupe: bool = True

    def lower(self, df: DataFrame) -> DataFrame:
        own = df.select(*self.key, *self.attributes, *([self.version] if self.version and self.version not in self.attributes else []))
        if not self.dedupe:
            return own.select(*self.key, *self.attributes)
        rest = F.struct(*([self.version] if self.version else []), *self.attributes)
        best = own.groupBy(*self.key).agg(F.max(rest).alias("r")) if self.attributes or self.version else own.distinct()
        return best.select(*self.key, *[F.col(f"r.{a}").alias(a) for a in self.attributes])


@dataclass(frozen=True)
class Fact:
    """Measures {column: SQL aggregate} at a grain; without measures the distinct grain itself."""

    grain: tuple[str, ...]
    measures: tuple[tuple[str, str], ...] = ()

    def lower(self, df: DataFrame) -> DataFrame:
        if not self.measures:
            return df.select(*self.grain).distinct()
        return df.groupBy(*self.grain).agg(*[F.expr(e).alias(n) for n, e in self.measures])
