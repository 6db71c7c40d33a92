"""Change events: parsing, landing, polling, debouncing, windows. All work on batch and streaming frames alike where Spark does."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..mv.delta import content_hash, latest_changes, without


def debezium(df: DataFrame, column: str, row_schema: str) -> DataFrame:
    """operation (insert, update, delete), ts and row of change envelopes, bare or under `payload`. A delete has the row before it."""
    kind = f"op string, ts_ms bigint, before struct<{row_schema}>, after struct<{row_schema}>"
    body = F.from_json(F.coalesce(F.get_json_object(column, "$.payload"), F.col(column)), kind)
    out = df.withColumn("__e", body).where("__e.op IS NOT NULL")
    op = F.when(F.col("__e.op").isin("c", "r"), "insert").when(F.col("__e.op") == "u", "update").when(F.col("__e.op") == "d", "delete")
    row = F.when(F.col("__e.op") == "d", F.col("__e.before")).otherwise(F.col("__e.after"))
    return out.select(op.alias("operation"), F.timestamp_millis("__e.ts_ms").alias("ts"), row.alias("row"))


def land_changes(events: DataFrame, key: list[str], order: list[str], folder: str, checkpoint: str):
    """A streaming query that keeps the current rows by key in `folder`/version=N, one version a batch; runs what is there and ends.

    Within a batch each key's last event counts; a batch that is run again writes the same version again.
    """
    spark = events.sparkSession

    def land(batch: DataFrame, number: int) -> None:
        before = read_version(spark, folder, number - 1)
        # Keys touched by the batch leave the state; those whose last event is no delete come back.
        fresh = latest_changes(batch, key, order)
        kept = fresh if before is None else without(before, batch, key).unionByName(fresh)
        kept.write.mode("overwrite").parquet(f"{folder}/version={number}")

    return events.writeStream.foreachBatch(land).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_version(spark: SparkSession, folder: str, number: int) -> DataFrame | None:
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/version={number}")
    if number < 0 or not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return None
    return spark.read.parquet(f"{folder}/version={number}")


def poll(df: DataFrame, watermark: str, last, limit: int | None = None) -> tuple[DataFrame, object]:
    """Rows beyond a high-water mark, oldest first, and the new mark. The mark is compared in the column's own type.

    With a limit, the rows that share the last one's mark come too, as the next poll asks for greater ones only.
    """
    new = df if last is None else df.where(F.col(watermark) > F.lit(last))
    some = new if limit is None else new.orderBy(watermark).limit(limit)
    mark = some.agg(F.max(watermark)).first()[0]
    if mark is None:
        return new.limit(0), last
    return new.where(F.col(watermark) <= F.lit(mark)).orderBy(watermark), mark


def poll_replaced(df: DataFrame, last: tuple[int, int] | None) -> tuple[bool, tuple[int, int]]:
    """Whether a table's content differs from when its hash was taken, in whatever order its rows come."""
    now = content_hash(df)
    return now != last, now


def debounced(df: DataFrame, key: list[str], at: str, quiet: str, most: str) -> DataFrame:
    """Bursts of events: a burst ends after `quiet` without events, or `most` after its first one.

    Returns key, first, last, events and fires (when the burst is let through).
    """
    w = Window.partitionBy(*key).orderBy(at)
    gap = F.col(at) > F.lag(at).over(w) + F.expr(f"INTERVAL {quiet}")
    runs = df.withColumn("__run", F.sum(F.coalesce(gap, F.lit(True)).cast("int")).over(w))
    begin = F.min(at).over(Window.partitionBy(*key, "__run"))
    part = F.floor((F.unix_micros(F.col(at).cast("timestamp")) - F.unix_micros(begin.cast("timestamp"))) / F.lit(_micros(df.sparkSession, most)))
    parts = runs.withColumn("__part", part)
    out = parts.groupBy(*key, "__run", "__part").agg(F.min(at).alias("first"), F.max(at).alias("last"), F.count("*").alias("events"))
    fires = F.least(F.col("last") + F.expr(f"INTERVAL {quiet}"), F.col("first") + F.expr(f"INTERVAL {most}"))
    return out.select(*key, "first", "last", "events", fires.alias("fires"))


def _micros(spark: SparkSession, interval: str) -> int:
    return spark.sql(f"SELECT unix_micros(TIMESTAMP '1970-01-01 00:00:00' + INTERVAL {interval})").first()[0]


def windowed(df: DataFrame, at: str, size: str, by: list[str], measures: list[Column], slide: str | None = None, lateness: str | None = None) -> DataFrame:
    """Tumbling or sliding windows; on a stream late rows beyond `lateness` are dropped and finished windows forgotten."""
    source = df.withWatermark(at, lateness) if lateness else df
    window = F.window(at, size, slide) if slide else F.window(at, size)
    return source.groupBy(window.alias("w"), *by).agg(*measures).select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *by, *[c for c in _names(source, by, measures)])


def _names(df: DataFrame, by: list[str], measures: list[Column]) -> list[str]:
    return df.groupBy(*by).agg(*measures).columns[len(by) :]


def on_change(events: DataFrame, rerun: Callable[[int], None], checkpoint: str):
    """Run a query again after each batch of changes to what it reads."""

    def step(batch: DataFrame, number: int) -> None:
        if not batch.isEmpty():
            rerun(number)

    return events.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
