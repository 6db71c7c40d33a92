"""Folders of files as tables, SQLite files, and result formats."""

from __future__ import annotations

import re
import sqlite3
from collections.abc import Iterator
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


def snake(name: str) -> str:
    return re.sub(r"[^A-Za-z0-9]+", "_", re.sub(r"(?<=[a-z0-9])(?=[A-Z])", "_", name)).strip("_").lower()


def read_file(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """A file by its ending, with snake-case columns. A schema spares the pass that infers one."""
    kind = path.rstrip("/").rsplit(".", 1)[-1].lower()
    reader = spark.read if schema is None else spark.read.schema(schema)
    if kind == "parquet":
        df = reader.parquet(path)
    elif kind == "csv":
        df = reader.csv(path, header=True, inferSchema=schema is None)
    elif kind in ("json", "ndjson", "jsonl"):
        df = reader.json(path)
    elif kind == "orc":
        df = reader.orc(path)
    else:
        raise ValueError(f"no reader for {path}")
    return df.select(*[F.col(f"`{c}`").alias(snake(c)) for c in df.columns])


def crawl(spark: SparkSession, folder: str) -> dict[str, str]:
    """Table names and paths of the files in a folder, seen through Spark's own file system."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    system = path.getFileSystem(spark._jsc.hadoopConfiguration())
    found = {}
    for status in system.listStatus(path):
        name = status.getPath().getName()
        if re.search(r"\.(parquet|csv|json|ndjson|jsonl|orc)$", name, re.I):
            found[snake(name.rsplit(".", 1)[0])] = status.getPath().toString()
    return found


class RowRange(InputPartition):
    def __init__(self, low: int, high: int):
        self.low, self.high = low, high


class SqliteReader(DataSourceReader):
    def __init__(self, path: str, table: str, schema: T.StructType, parts: int):
        self.path, self.table, self.schema, self.parts = path, table, schema, parts

    def _rows(self, query: str, *args) -> Iterator[tuple]:
        with sqlite3.connect(f"file:{self.path}?mode=ro", uri=True) as db:
            yield from db.execute(query, args)

    def partitions(self) -> list[RowRange]:
        low, high = next(self._rows(f'SELECT coalesce(min(rowid), 0), coalesce(max(rowid), -1) FROM "{self.table}"'))
        step = max(-(-(high - low + 1) // self.parts), 1)
        return [RowRange(k, k + step) for k in range(low, high + 1, step)] or [RowRange(0, 0)]

    def read(self, part: RowRange) -> Iterator[tuple]:
        columns = ", ".join(f'"{c}"' for c in self.schema.names)
        yield from self._rows(f'SELECT {columns} FROM "{self.table}" WHERE rowid >= ? AND rowid < ?', part.low, part.high)


def affinity(declared: str) -> T.DataType:
    """The type for a column's declared one, by the rules by which that database stores values; numbers that may be whole or not are doubles."""
    name = declared.upper()
    if "INT" in name or "BOOL" in name:
        return T.LongType()
    if any(x in name for x in ("CHAR", "CLOB", "TEXT", "DATE", "TIME")):
        return T.StringType()
    if "BLOB" in name:
        return T.BinaryType()
    return T.DoubleType() if any(x in name for x in ("REAL", "FLOA", "DOUB", "NUMERIC", "DECIMAL")) else T.StringType()


class SqliteSource(DataSource):
    """Options path, table and parts; read by ranges of row ids. The file must be where the executors see it."""

    @classmethod
    def name(cls) -> str:
        return "sqlite_file"

    def schema(self) -> T.StructType:
        with sqlite3.connect(f"file:{self.options['path']}?mode=ro", uri=True) as db:
            columns = db.execute(f"PRAGMA table_info(\"{self.options['table']}\")").fetchall()
        return T.StructType([T.StructField(c[1], affinity(c[2])) for c in columns])

    def reader(self, schema: T.StructType) -> SqliteReader:
        return SqliteReader(self.options["path"], self.options["table"], schema, int(self.options.get("parts", "8")))


def sqlite_tables(path: str) -> list[str]:
    with sqlite3.connect(f"file:{Path(path)}?mode=ro", uri=True) as db:
        return [r[0] for r in db.execute("SELECT name FROM sqlite_master WHERE type = 'table' ORDER BY name")]


def read_sqlite(spark: SparkSession, path: str, table: str, parts: int = 8) -> DataFrame:
    spark.dataSource.register(SqliteSource)
    return spark.read.format("sqlite_file").options(path=path, table=table, parts=str(parts)).load()


def dotted(schema: T.StructType, prefix: str = "") -> list[Column]:
    """Columns for flat formats: struct fields by dotted name, arrays and maps as JSON."""
    out = []
    for f in schema.fields:
        path = f"{prefix}`{f.name}`"
        name = path.replace("`", "")
        if isinstance(f.dataType, T.StructType):
            out += dotted(f.dataType, f"{path}.")
        elif isinstance(f.dataType, (T.ArrayType, T.MapType)):
            out.append(F.to_json(F.col(path)).alias(name))
        else:
            out.append(F.col(path).alias(name))
    return out


def write_result(df: DataFrame, path: str, kind: str) -> None:
    """json (one object a line), csv, parquet or orc; nested columns are flattened for csv."""
    flat = df.select(*dotted(df.schema)) if kind == "csv" else df
    writer = flat.write.mode("overwrite")
    {"json": writer.json, "csv": lambda p: writer.csv(p, header=True), "parquet": writer.parquet, "orc": writer.orc}[kind](path)


def deliver(df: DataFrame, path: str, threshold: int = 1000, kind: str = "parquet") -> tuple[str, DataFrame | None]:
    """("inline", rows) for results of up to `threshold` rows, ("redirect", None) for larger ones, which are at `path`.

    The query runs once: its rows are written as Parquet, at `path` or beside it where another kind is asked for, and
    counted from there. Rows given inline are read from that table.
    """
    held = path if kind == "parquet" else f"{path}.rows"
    df.write.mode("overwrite").parquet(held)
    rows = df.sparkSession.read.schema(df.schema).parquet(held)
    if rows.count() <= threshold:
        return "inline", rows
    if kind != "parquet":
        write_result(rows, path, kind)
    return "redirect", None
