"""Shared pieces: the folder for written tables, word rules, table loading."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The six ASCII blanks that separate words, as a Java character class.
BLANKS = r"\x20\x09-\x0D"
WORD_SEPARATORS = f"[{BLANKS}]+"


def shared_folder(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; where unset in local mode (tests), one of our own, set for the session."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="ferrowick-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def new_path(spark: SparkSession, label: str) -> str:
    """A path in the shared folder that no other run uses."""
    return f"{shared_folder(spark).rstrip('/')}/ferrowick/{label}-{uuid.uuid4().hex}"


@contextmanager
def shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """Queries begun inside drop their shuffle files when they end: a table that is written needs them no longer."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def stored(df: DataFrame, label: str) -> DataFrame:
    """Cut lineage: write `df` as Parquet in the shared folder and read it again."""
    spark = df.sparkSession
    path = new_path(spark, label)
    with shuffles_freed(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def delete(spark: SparkSession, path: str) -> None:
    """Remove a table that is no longer needed, through the file system of its path."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


class Scratch:
    """Written tables of one computation. They go when it ends, or as soon as they are freed."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_) -> None:
        for _, path in self.paths:
            delete(self.spark, path)
        self.paths = []

    def stored(self, df: DataFrame, label: str) -> DataFrame:
        """Cut lineage, as `stored` does."""
        path = new_path(self.spark, label)
        with shuffles_freed(self.spark):
            df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths.append((out, path))
        return out

    def free(self, *tables: DataFrame) -> None:
        """Remove these tables now."""
        for df, path in self.paths:
            if any(df is t for t in tables):
                delete(self.spark, path)
        self.paths = [(df, path) for df, path in self.paths if not any(df is t for t in tables)]


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """The named columns of one input table."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def lower_ascii(text: Column) -> Column:
    """Lower-case A-Z alone."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words_of(text: Column) -> Column:
    """Maximal runs of characters that are no ASCII blank; an empty array for null or blank text."""
    parts = F.split(F.coalesce(text, F.lit("")), WORD_SEPARATORS)
    return F.filter(parts, lambda w: w != "")
