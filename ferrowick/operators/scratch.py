"""Written tables of a loop over edges, and shuffles whose number of partitions follows from the number of rows."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Rows that a task of a loop takes, so that its memory doesn't grow with the graph.
TASK_ROWS = 2_000_000
LEAST_TASKS = 8


def tasks_for(rows: int) -> int:
    return max(LEAST_TASKS, -(-rows // TASK_ROWS))


@contextmanager
def settings(spark: SparkSession, **values: str) -> Iterator[None]:
    """Spark SQL settings (`__` for a dot) of the queries that run inside."""
    names = {f"spark.sql.{k.replace('__', '.')}": v for k, v in values.items()}
    before = {k: spark.conf.get(k) for k in names}
    try:
        for k, v in names.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def dealt_for(spark: SparkSession, rows: int):
    """Shuffles inside have a partition for each TASK_ROWS rows. Coalescing goes by compressed bytes, and equal labels compress so
    well that a task would get very many rows."""
    return settings(spark, shuffle__partitions=str(tasks_for(rows)), adaptive__coalescePartitions__enabled="false")


class Scratch:
    """Tables in the checkpoint folder. They go when the loop ends, or as soon as they are freed."""

    def __init__(self, spark: SparkSession):
        self.spark, self.tables, self.names = spark, [], []
        self.folder = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/ferrowick-{uuid.uuid4().hex}"

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_) -> None:
        for name in self.names:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        self._delete(self.folder)

    def _delete(self, path: str) -> None:
        where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(where, True)

    def _path(self) -> str:
        return f"{self.folder}/{uuid.uuid4().hex}"

    def stored(self, df: DataFrame) -> DataFrame:
        """Cut lineage: write `df` and read it again. Shuffle files of the query that writes it go when it ends."""
        path = self._path()
        with settings(self.spark, classic__shuffleDependency__fileCleanup__enabled="true"):
            df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.tables.append((out, path))
        return out

    def distinct(self, edges: DataFrame) -> DataFrame:
        """As `stored`, for edges whose number is not known yet: 8 MB of them are about a million."""
        with settings(self.spark, adaptive__advisoryPartitionSizeInBytes="8m"):
            return self.stored(edges)

    def added(self, table: DataFrame, rows: DataFrame) -> DataFrame:
        """A stored table with more rows."""
        path = next(path for t, path in self.tables if t is table)
        rows.write.mode("append").parquet(path)
        out = self.spark.read.schema(table.schema).parquet(path)
        self.tables = [(out if t is table else t, p) for t, p in self.tables]
        return out

    def bucketed(self, df: DataFrame, key: str, buckets: int, rows: int, *parts: str) -> DataFrame:
        """`df` as a table with buckets by a key: joins and groups by that key don't deal its rows out again."""
        name, tasks = f"ferrowick_{uuid.uuid4().hex}", buckets * -(-tasks_for(rows) // buckets)  # a task's rows are of one bucket
        self.names.append(name)
        with settings(self.spark, classic__shuffleDependency__fileCleanup__enabled="true"):
            writer = df.repartition(tasks, key).write.format("parquet").bucketBy(buckets, key).option("path", self._path())
            (writer.partitionBy(*parts) if parts else writer).saveAsTable(name)
        return self.spark.table(name)

    def free(self, df: DataFrame) -> None:
        for t, path in self.tables:
            if t is df:
                self._delete(path)
        self.tables = [x for x in self.tables if x[0] is not df]
