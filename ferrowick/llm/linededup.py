"""Line dedup over levelled sorted runs.

A run is a table of line keys, bucketed and sorted by key, with the number of documents that held the key in its
batch and the largest id of them. Documents come in batches. Each batch is merge-anti-joined with the runs: keys
that no run holds become a new run of level 0, so runs never share a key; keys that are known already go to a
tally of the batch. When a level holds `fanout` runs they are compacted into one run of the next level: each key is
rewritten once a level and there are few runs to join. All runs of a folder have the same buckets, so a merge deals out only
the batch. What repeats is read off the runs and the tallies: a key in no tally has the count in its run; the others' are
added up, with their run merge-joined once.

Runs are durable. A folder's name tells which batches a run covers, so a folder can be opened again and later
documents meet the lines of earlier ones; a run whose batches another one covers is one that a compaction had no time to remove.

A line's key is the line without blanks at its ends, A-Z lower-cased, held as two 64-bit hashes. Keys of at least
`min_chars` code points that occur in at least `min_docs` documents lose all their lines except in the largest
document id that holds them.

Defined results: null or empty text is one empty line; a key repeated inside one document counts once; rows that
share a document id count as one document; rows with null id count as one document that loses to all others, and each
gets the drops of its own text;
an empty table gives no rows; other columns pass through unchanged, names that clash included. All of it is
DataFrame functions; counts are summed before they are dealt out, so a line in all documents is a row a task.
"""

from __future__ import annotations

import re
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BLANKS, Scratch, delete, lower_ascii, new_path, shuffles_freed, stored

KEY = ("k1", "k2")
#: Keys of all runs together that one bucket is meant to hold, some 100 MB.
BUCKET_KEYS = 4_000_000
#: Names inside this module start so, to keep clear of the documents' own columns.
OWN = "_line_"


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def stripped(line: Column) -> Column:
    return lower_ascii(F.regexp_replace(line, rf"\A[{BLANKS}]+|[{BLANKS}]+\z", ""))


def hashes(key: Column) -> Column:
    return F.struct(F.xxhash64(key).alias("k1"), F.xxhash64(F.lit(1), key).alias("k2"))


def long_keys(text: Column, min_chars: int) -> Column:
    """The distinct keys of a text's lines that are long enough."""
    keys = F.filter(F.transform(lines_of(text), stripped), lambda k: F.length(k) >= min_chars)
    return F.transform(F.array_distinct(keys), hashes)


class LineRuns:
    """The runs and tallies of a folder. `buckets` holds for a new folder; an old one keeps its own."""

    def __init__(self, spark: SparkSession, folder: str, buckets: int = 32, fanout: int = 3):
        self.spark, self.folder, self.buckets, self.fanout = spark, folder, buckets, fanout
        self.spans: dict[tuple[int, int], str] = {}  # table of each run by its first and last batch
        self.batches = 0
        held = [m for m in map(re.compile(r"run-(\d+)-(\d+)-(\d+)").fullmatch, self._finished()) if m]
        spans = [(int(m[1]), int(m[2])) for m in held]
        for (low, high), m in zip(spans, held, strict=True):
            if any(a <= low and high <= b and (a, b) != (low, high) for a, b in spans):
                delete(spark, f"{folder}/{m[0]}")
                continue
            self.buckets, self.batches = int(m[3]), max(self.batches, high + 1)
            name = f"line_run_{uuid.uuid4().hex}"
            spark.sql(
                f"CREATE TABLE {name} (k1 BIGINT, k2 BIGINT, n_docs BIGINT, last_doc BIGINT) USING parquet OPTIONS (path '{folder}/{m[0]}') "
                f"CLUSTERED BY (k1, k2) SORTED BY (k1, k2) INTO {self.buckets} BUCKETS"
            )
            self.spans[low, high] = name

    def _finished(self) -> list[str]:
        """Names of the tables in the folder that were written to their end."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path
        system = path(self.folder).getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not system.exists(path(self.folder)):
            return []
        names = [s.getPath().getName() for s in system.listStatus(path(self.folder))]
        return [n for n in names if system.exists(path(f"{self.folder}/{n}/_SUCCESS"))]

    def _write(self, rows: DataFrame, low: int, high: int) -> DataFrame:
        name, path = f"line_run_{uuid.uuid4().hex}", f"{self.folder}/run-{low}-{high}-{self.buckets}"
        with shuffles_freed(self.spark):
            rows.repartition(self.buckets, *KEY).write.mode("overwrite").bucketBy(self.buckets, *KEY).sortBy(*KEY).option("path", path).saveAsTable(name)
        self.spans[low, high] = name
        return self.spark.table(name)

    def runs(self) -> list[DataFrame]:
        return [self.spark.table(name) for name in self.spans.values()]

    def tallies(self) -> DataFrame | None:
        """Counts of keys by batch, where an earlier batch has them in its run."""
        if self.batches < 2:
            return None
        return self.spark.read.schema("k1 long, k2 long, n_docs long, last_doc long").parquet(*[f"{self.folder}/tally-{k}" for k in range(1, self.batches)])

    def unseen(self, keys: DataFrame) -> DataFrame:
        """The rows of `keys` whose key no run holds."""
        return reduce(lambda rows, run: rows.join(run.select(*KEY).hint("merge"), list(KEY), "left_anti"), self.runs(), keys)

    def add(self, batch: DataFrame) -> None:
        """Take in (k1, k2, n_docs, last_doc), one row for each key, of documents that no earlier batch held.

        The tally is written before the run, whose presence ends the batch.
        """
        k = self.batches
        with Scratch(self.spark) as scratch:
            batch = scratch.stored(batch, "line-batch")
            if k:
                new = scratch.stored(self.unseen(batch), "line-new")
                with shuffles_freed(self.spark):
                    batch.join(new.select(*KEY), list(KEY), "left_anti").write.mode("overwrite").parquet(f"{self.folder}/tally-{k}")
                self._write(new, k, k)
            else:
                self._write(batch, k, k)
        self.batches += 1
        while len(same := self._smallest()) >= self.fanout:
            names = [self.spans.pop(s) for s in same]
            self._write(reduce(DataFrame.unionByName, map(self.spark.table, names)), same[0][0], same[-1][1])
            for (low, high), name in zip(same, names, strict=True):
                self.spark.sql(f"DROP TABLE {name}")
                delete(self.spark, f"{self.folder}/run-{low}-{high}-{self.buckets}")

    def _smallest(self) -> list[tuple[int, int]]:
        """The last runs that are of one level: of as many batches each."""
        spans = sorted(self.spans)
        size = spans[-1][1] - spans[-1][0]
        return [s for s in spans if s[1] - s[0] == size]

    def repeated(self, min_docs: int) -> DataFrame:
        """Keys in at least `min_docs` documents, with the largest document id."""
        runs = reduce(DataFrame.unionByName, self.runs())
        if (tallies := self.tallies()) is None:
            return runs.where(F.col("n_docs") >= min_docs)
        again = tallies.groupBy(*KEY).agg(F.sum("n_docs").alias("more"), F.max("last_doc").alias("later"))
        both = runs.join(again, list(KEY), "left")
        counted = both.select(*KEY, (F.col("n_docs") + F.coalesce("more", F.lit(0))).alias("n_docs"), F.greatest("last_doc", "later").alias("last_doc"))
        return counted.where(F.col("n_docs") >= min_docs)

    def close(self) -> None:
        """Forget the tables' names; the files stay in the folder."""
        for name in self.spans.values():
            self.spark.sql(f"DROP TABLE {name}")
        self.spans = {}


def dedup_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", min_chars: int = 20, min_docs: int = 3, batches: int = 4, folder: str | None = None) -> DataFrame:
    """`docs` with `text` shortened, and with _line_n_lines and _line_n_dropped.

    With `folder`, lines of documents that were given with it before count too, and those of these documents are kept
    there. Their ids must be new; a line that an earlier document keeps is kept there.
    """
    spark = docs.sparkSession
    # Rows of null id are told apart by their text, so that none has to gather the drops of all.
    own = F.when(F.col(key).isNull(), F.xxhash64(text))
    keyed = docs.select(F.col(key).alias("doc_id"), own.alias("row"), F.explode(long_keys(F.col(text), min_chars)).alias("k")).select("doc_id", "row", "k.*").distinct()
    with Scratch(spark) as scratch:
        keyed = keyed.withColumn("batch", F.pmod(F.coalesce(F.xxhash64("doc_id"), F.lit(0)), F.lit(batches)).cast("int"))
        pairs = scratch.stored(keyed, "line-keys")
        buckets = max(8, -(-pairs.count() // BUCKET_KEYS))
        at = folder or new_path(spark, "line-runs")
        runs = LineRuns(spark, at, buckets)
        n_docs = F.count("doc_id") + F.max(F.col("doc_id").isNull().cast("long"))
        for k in range(batches):
            runs.add(pairs.where(F.col("batch") == k).groupBy(*KEY).agg(n_docs.alias("n_docs"), F.max("doc_id").alias("last_doc")))
        repeated = scratch.stored(runs.repeated(min_docs), "line-repeated")
        runs.close()
        if folder is None:
            delete(spark, at)
        losing = pairs.join(repeated, list(KEY)).where(~F.col("doc_id").eqNullSafe(F.col("last_doc")))
        drops = losing.groupBy("doc_id", "row").agg(F.collect_list(F.struct(*KEY)).alias(f"{OWN}drops"))
        drops = stored(drops.select(F.col("doc_id").alias(f"{OWN}id"), F.col("row").alias(f"{OWN}row"), f"{OWN}drops"), "line-drops")
    same = F.col(key).eqNullSafe(F.col(f"{OWN}id")) & own.eqNullSafe(F.col(f"{OWN}row"))
    joined = docs.join(drops.hint("shuffle_hash"), same, "left")

    def stays(line: Column) -> Column:
        bare = stripped(line)
        return (F.length(bare) < min_chars) | ~F.array_contains(F.col(f"{OWN}drops"), hashes(bare))

    body = F.coalesce(F.col(text), F.lit(""))
    kept = joined.withColumn(f"{OWN}kept", F.when(F.col(f"{OWN}drops").isNotNull(), F.filter(lines_of(F.col(text)), stays)))
    n_lines = F.length(body) - F.length(F.translate(body, "\n", "")) + 1
    return kept.withColumns(
        {
            text: F.coalesce(F.array_join(f"{OWN}kept", "\n"), body),
            f"{OWN}n_lines": n_lines.cast("long"),
            f"{OWN}n_dropped": F.coalesce(n_lines - F.size(f"{OWN}kept"), F.lit(0)).cast("long"),
        }
    ).drop(f"{OWN}kept", f"{OWN}drops", f"{OWN}id", f"{OWN}row")
