"""Answering aggregate queries from materialized joins and aggregates.

A query is a value, rewritten before any DataFrame is built. A view is used only where it gives the same rows: the
inputs must carry no rules for the role, as the view was filled without them.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.relations import join_flat
from ..plans.inspect import attribute_names

# How an aggregate of aggregates gives the aggregate.
AGAIN = {"sum": "sum", "count": "sum", "min": "min", "max": "max"}


@dataclass(frozen=True)
class AggregateQuery:
    """`joins`: relationship names from `table`; columns of joined tables are `relationship__column`. Measures: (name, function, column)."""

    table: str
    joins: tuple[str, ...] = ()
    by: tuple[str, ...] = ()
    measures: tuple[tuple[str, str, str], ...] = ()
    filters: frozenset[str] = frozenset()

    def base(self, engine) -> DataFrame:
        df = engine.table(self.table)
        for name in self.joins:
            r = engine.model.relationship(self.table, name)
            df = join_flat(df, engine.table(r.target), r, "left", f"{name}__")
        return df

    def run(self, engine) -> DataFrame:
        return summarised(self.base(engine), self)


def summarised(df: DataFrame, query: AggregateQuery) -> DataFrame:
    for f in sorted(query.filters):
        df = df.where(f)
    return df.groupBy(*query.by).agg(*[measure(fn, column).alias(name) for name, fn, column in query.measures])


def measure(fn: str, column: str):
    if fn == "count":
        return F.count("*") if column == "*" else F.count(column)
    return {"sum": F.sum, "avg": F.avg, "min": F.min, "max": F.max}[fn](column)


@dataclass(frozen=True)
class JoinView:
    """A stored join of `table` with relationships, columns named as in a query."""

    name: str
    table: str
    joins: tuple[str, ...]
    fresh: bool = True


@dataclass(frozen=True)
class AggregateView:
    """A stored aggregate. Besides its measures it holds, for each average, a sum and a count of the column."""

    name: str
    query: AggregateQuery
    fresh: bool = True

    def columns(self) -> dict[tuple[str, str], str]:
        return {(fn, column): f"{fn}__{column}".replace("*", "rows") for _, fn, column in self.query.measures}

    def fill(self, engine) -> DataFrame:
        named = tuple((name, fn, column) for (fn, column), name in self.columns().items())
        return replace(self.query, measures=named).run(engine)


@dataclass(frozen=True)
class Catalog:
    joins: tuple[JoinView, ...] = ()
    aggregates: tuple[AggregateView, ...] = ()
    stored: dict[str, DataFrame] = field(default_factory=dict)


def ungoverned(engine, query: AggregateQuery) -> bool:
    """Whether the role has no rule on any table of the query."""
    role = engine.model.role(engine.role)
    tables = {query.table, *(engine.model.relationship(query.table, j).target for j in query.joins)}
    ruled = set(role.rows) | {t for t, _ in role.masks} | {t for t, _ in role.hidden}
    domains = {engine.model.table(t).domain for t in tables}
    return not (tables & ruled or domains & set(role.domain_rows))


def answer(engine, query: AggregateQuery, catalog: Catalog) -> tuple[DataFrame, str | None]:
    """The query's rows and the name of the view they came from, if any: an aggregate first, else the widest join."""
    if ungoverned(engine, query):
        for view in catalog.aggregates:
            if (df := from_aggregate(query, view, catalog.stored)) is not None:
                return df, view.name
        fitting = [v for v in catalog.joins if v.fresh and v.table == query.table and set(v.joins) <= set(query.joins)]
        if fitting:
            view = max(fitting, key=lambda v: len(v.joins))
            rest = tuple(j for j in query.joins if j not in view.joins)
            df = replace(query, joins=rest).base(engine.with_tables(**{query.table: catalog.stored[view.name]}))
            return summarised(df, query), view.name
    return query.run(engine), None


def from_aggregate(query: AggregateQuery, view: AggregateView, stored: dict[str, DataFrame]) -> DataFrame | None:
    """Re-aggregate a view whose keys include the query's and whose filters are among the query's."""
    own, columns = view.query, view.columns()
    if not view.fresh or own.table != query.table or set(own.joins) != set(query.joins) or not set(query.by) <= set(own.by) or not own.filters <= query.filters:
        return None
    df = stored[view.name]
    for f in sorted(query.filters - own.filters):
        if not attribute_names(df.sparkSession, f) <= set(own.by):
            return None
        df = df.where(f)
    out = []
    for name, fn, column in query.measures:
        if fn in AGAIN and (fn, column) in columns:
            out.append(F.expr(f"{AGAIN[fn]}(`{columns[fn, column]}`)").alias(name))
        elif fn == "avg" and {("sum", column), ("count", column)} <= columns.keys():
            out.append((F.sum(columns["sum", column]) / F.sum(columns["count", column])).alias(name))
        else:
            return None
    return df.groupBy(*query.by).agg(*out)

