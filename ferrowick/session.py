"""An engine: a Spark session, a model, where the tables are, and the role that asks."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession

from . import govern
from .model import SemanticModel
from .operators import aggregates, relations


@dataclass(frozen=True)
class Engine:
    """`load` gives a table's data by name. `overlay` replaces tables for this engine, for instance by their state at a time."""

    spark: SparkSession
    model: SemanticModel
    load: Callable[[str], DataFrame]
    role: str
    overlay: dict[str, DataFrame] = field(default_factory=dict)

    def table(self, name: str) -> DataFrame:
        """The table as the role sees it."""
        raw = self.overlay[name] if name in self.overlay else self.load(name)
        return govern.governed(raw, self.model, self.role, name)

    def capped(self, df: DataFrame, limit: int | None = None) -> DataFrame:
        return govern.capped(df, self.model.role(self.role), limit)

    def with_tables(self, **overlay: DataFrame) -> Engine:
        return replace(self, overlay=self.overlay | overlay)

    def select(self, table: str, fields: list, **options) -> DataFrame:
        role = self.model.role(self.role)
        govern.check_complexity(fields, role.max_depth, role.max_fields)
        return relations.select(self, table, fields, **options)

    def aggregate(self, table: str, spec: dict, **options) -> DataFrame:
        return aggregates.aggregate(self.table(table), spec, **options)

    def group_by(self, table: str, by: list[str], spec: dict, **options) -> DataFrame:
        return self.capped(aggregates.group_by(self.table(table), by, spec, **options))

    def metrics(self, names: list[str], dimensions: list[str], filters: list[str] | None = None) -> DataFrame:
        return self.capped(aggregates.metric_query(self, names, dimensions, filters))

    def sql(self, statement: str) -> DataFrame:
        """A Spark SQL query over the governed tables of the model that the role may read, and its metrics by metric('name')."""
        return self.capped(self.uncapped_sql(statement))

    def uncapped_sql(self, statement: str) -> DataFrame:
        """The query's whole rows, for views that the role's own statements read."""
        role = self.model.role(self.role)
        readable = {name for name, table in self.model.tables.items() if govern.may_read(role, table)}
        expanded = aggregates.expand_metrics(statement, self.model)
        govern.check_statement(self.spark, expanded, readable)
        for name in self.model.tables:
            if name in readable:
                self.table(name).createOrReplaceTempView(name)
            else:
                self.spark.catalog.dropTempView(name)
        return self.spark.sql(expanded)
