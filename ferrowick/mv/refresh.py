"""Stored views: filled, refreshed, read back, and tables made from governed statements.

A store is a folder that driver and executors share. Each refresh of a view is a folder of its own, numbered upwards,
which counts once Spark has marked it as whole: readers keep the version they opened, and a refresh that is lost halfway
leaves the one before it in place. Of older versions the last stays; those before it are deleted.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession

from ..govern import NotAllowed
from ..model import ModelError, Table
from ..plans.inspect import dependencies


@dataclass(frozen=True)
class Store:
    spark: SparkSession
    folder: str

    def _system(self, place: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(place)
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def versions(self, name: str, whole: bool = True) -> list[int]:
        """Versions of a view, oldest first: the whole ones, or with those that a lost refresh began."""
        system, path = self._system(f"{self.folder}/{name}")
        if not system.exists(path):
            return []
        found = sorted(int(s.getPath().getName()) for s in system.listStatus(path))
        return [v for v in found if not whole or system.exists(self._system(f"{self.folder}/{name}/{v}/_SUCCESS")[1])]

    def read(self, name: str) -> DataFrame:
        known = self.versions(name)
        if not known:
            raise ModelError(f"{name} is not stored")
        return self.spark.read.parquet(f"{self.folder}/{name}/{known[-1]}")

    def refresh(self, name: str, rows: DataFrame, max_rows: int | None = None) -> str:
        """Store `rows` as the view's next version: CREATED at first, then REPLACED.

        A view of more than `max_rows` rows is SKIPPED before anything is written, and what was stored stays; rows are
        never cut. A column list that differs from the stored one is an error, as readers rely on it.
        """
        if max_rows is not None and rows.count() > max_rows:
            return "SKIPPED"
        known = self.versions(name)
        if known and (was := self.read(name).columns) != rows.columns:
            raise ModelError(f"{name} is stored with columns {was}, not {rows.columns}")
        following = max(self.versions(name, whole=False), default=0) + 1
        rows.write.parquet(f"{self.folder}/{name}/{following}")
        for old in known[:-1]:
            system, path = self._system(f"{self.folder}/{name}/{old}")
            system.delete(path, True)
        return "REPLACED" if known else "CREATED"


def stored_view(store: Store, name: str, rows: DataFrame, max_rows: int | None = None) -> DataFrame:
    """The view as it is after a refresh."""
    store.refresh(name, rows, max_rows)
    return store.read(name)


def registered(engine, name: str, rows: DataFrame):
    """An engine that has `rows`, governed already by what they were read from, as one more table."""
    if name in engine.model.tables:
        raise ModelError(f"{name} is a table already")
    model = replace(engine.model, tables=engine.model.tables | {name: Table(name, derived=True)})
    return replace(engine, model=model, overlay=engine.overlay | {name: rows})


def create_table(engine, store: Store, name: str, statement: str):
    """Store the rows of a governed statement, and an engine of the same role that has them as a table.

    A role with a row cap may not: its table would hold a part of the rows and nothing would say so. Nor may it take the
    name of a table, or of what is stored.
    """
    if engine.model.role(engine.role).row_cap is not None:
        raise NotAllowed(f"{engine.role} has a row cap, so it can't store whole results")
    if name in engine.model.tables or store.versions(name):
        raise ModelError(f"{name} exists already")
    store.refresh(name, engine.uncapped_sql(statement))
    return registered(engine, name, store.read(name))


def with_views(engine, views: dict[str, str]):
    """An engine that has the views, statements over tables and other views in any order, as tables.

    They are plans within the statement that reads them, so Spark prunes and pushes filters through all levels. The
    role's rules hold at the tables that they read.
    """
    order, cyclic = dependencies(engine.spark, views)
    if cyclic:
        raise ModelError(f"views read each other in a circle: {cyclic}")
    for name in order:
        engine = registered(engine, name, engine.uncapped_sql(views[name]))
    return engine
