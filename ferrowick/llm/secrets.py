"""Secret scans with an incremental ledger of blobs.

A version of a path is addressed by the SHA-256 of its content (its blob). The ledger is a folder of Parquet
tables that holds which blobs were scanned under which rule version, with their findings. A scan reads the
versions, takes the blobs not yet in the ledger under the rules at hand, scans one copy of each, adds the
result to the ledger, and joins the findings back to all paths and versions of those blobs.

Defined results: null text is scanned as empty; equal texts are scanned once and get the same spans; a repeated
path keeps each of its rows; an empty table gives no rows and adds nothing. Offsets count code points.
All of it is DataFrame functions; a scan is one row's work and whole texts are scanned.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stored

SPANS = "array<struct<start:int,rank:int,kind:string,stop:int>>"


@dataclass(frozen=True)
class Rule:
    """A kind of secret: matches of `pattern`, kept if `group` has at least `least` characters."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1


# The base rules. A run of hex digits is maximal, and so is a key's tail, so for these the least length is in the pattern.
BASE_RULES = (
    Rule("assign", r"""(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 6),
    Rule("access", r"AKIA[A-Z0-9]{16,}"),
    Rule("hex", r"[0-9a-f]{24,}"),
)
# Further rules for tokens that carry their issuer's mark.
MORE_RULES = (
    Rule("private_key", r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----"),
    Rule("hub_token", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("chat_token", r"xox[abprs]-[A-Za-z0-9-]{20,}"),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"),
)
RULES = BASE_RULES + MORE_RULES


def rules_version(rules: tuple[Rule, ...] = RULES) -> str:
    return hashlib.sha256(repr(rules).encode()).hexdigest()[:16]


def spans_of(text: Column, rule: Rule, rank: int) -> Column:
    """Spans of one rule: the gaps between matches and the matches, in turn, give the offsets."""
    none = F.array().cast(SPANS)
    parts = F.zip_with(
        F.split(text, rule.pattern, -1),
        F.arrays_zip(F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0)).alias("whole"), F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group)).alias("part")),
        lambda gap, match: F.struct(F.length(gap).alias("gap"), F.length(match["whole"]).alias("whole"), F.length(match["part"]).alias("part")),
    )
    start = F.struct(F.lit(0).alias("at"), none.alias("found"))

    def step(acc: Column, p: Column) -> Column:
        begin = acc["at"] + p["gap"]
        end = begin + F.coalesce(p["whole"], F.lit(0))
        span = F.struct(begin.alias("start"), F.lit(rank).alias("rank"), F.lit(rule.kind).alias("kind"), end.alias("stop"))
        return F.struct(end.alias("at"), F.when(p["part"] >= rule.least, F.concat(acc["found"], F.array(span))).otherwise(acc["found"]).alias("found"))

    return F.when(text.rlike(rule.pattern), F.aggregate(parts, start, step, lambda acc: acc["found"])).otherwise(none)


def scan(blobs: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text") -> DataFrame:
    """Adds `spans`, in order of start and then of the rules as listed."""
    return blobs.withColumn("spans", F.sort_array(F.concat(*[spans_of(F.col(text), r, k) for k, r in enumerate(rules)])))


class BlobLedger:
    """Which (blob, rule version) pairs were scanned, and what was found. Each scan adds one Parquet part; a folder may be opened again."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder, self.parts = spark, folder, 0
        path = spark._jvm.org.apache.hadoop.fs.Path
        system = path(folder).getFileSystem(spark._jsc.hadoopConfiguration())
        while system.exists(path(f"{folder}/part={self.parts}/_SUCCESS")):  # a part that wasn't written to its end is written again
            self.parts += 1

    def seen(self, version: str) -> DataFrame | None:
        if not self.parts:
            return None
        paths = [f"{self.folder}/part={k}" for k in range(self.parts)]
        return self.spark.read.parquet(*paths).where(F.col("version") == version).select("blob", "spans")

    def scan(self, versions: DataFrame, rules: tuple[Rule, ...] = RULES, keys: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
        """`keys` and `spans` of every row of `versions`. Each key tuple names one version of one path."""
        version = rules_version(rules)
        body = versions.select(*keys, F.coalesce(F.col(text), F.lit("")).alias("text")).withColumn("blob", F.sha2("text", 256))
        where = stored(body.select(*keys, "blob"), "blobs")  # without texts
        new = where.groupBy("blob").agg(F.min(F.struct(*keys)).alias("first"))
        if (seen := self.seen(version)) is not None:
            new = new.join(seen.select("blob"), "blob", "left_anti")
        # One text of each new blob: the row whose key comes first. Repeated rows with that key give the blob once more; they are dropped below.
        firsts = new.select(F.col("blob").alias("blob_"), *[F.col(f"first.{k}").alias(f"{k}_") for k in keys])
        same = F.col("blob") == F.col("blob_")
        for k in keys:
            same = same & F.col(k).eqNullSafe(F.col(f"{k}_"))
        texts = body.join(firsts.hint("shuffle_hash"), same, "left_semi")
        found = scan(texts, rules).select("blob", "spans").dropDuplicates(["blob"])
        found.withColumn("version", F.lit(version)).write.mode("overwrite").parquet(f"{self.folder}/part={self.parts}")
        self.parts += 1
        hits = self.seen(version).where(F.size("spans") > 0)
        return where.join(hits, "blob", "left").withColumn("spans", F.coalesce("spans", F.array().cast(SPANS)))

    def findings(self, rules: tuple[Rule, ...] = RULES) -> DataFrame:
        """(blob, spans) of all blobs scanned under these rules that hold a secret."""
        return self.seen(rules_version(rules)).where(F.size("spans") > 0)


def redacted(text: Column, spans: Column) -> Column:
    """`text` with each stretch of spans that overlap put as [secret]. `spans` in order of start."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("parts"))

    def step(acc: Column, span: Column) -> Column:
        gap = F.concat(F.substring(text, acc["at"] + 1, span["start"] - acc["at"]), F.lit("[secret]"))
        parts = F.when(span["start"] >= acc["at"], F.concat(acc["parts"], F.array(gap))).otherwise(acc["parts"])
        return F.struct(F.greatest(acc["at"], span["stop"]).alias("at"), parts.alias("parts"))

    return F.aggregate(spans, start, step, lambda acc: F.concat(F.array_join(acc["parts"], ""), F.substring(text, acc["at"] + 1, F.length(text))))
