"""Data-quality checks: all checks of a table in one pass, results as rows of an envelope."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RESULT = "scan_id string, dataset string, column_name string, check_name string, check_type string, outcome string, metric_value double, threshold string, rows_tested long, failed_rows long"
COMPARE = {"=": lambda a, b: a == b, "!=": lambda a, b: a != b, "<": lambda a, b: a < b, "<=": lambda a, b: a <= b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b}


@dataclass(frozen=True)
class Check:
    """A count or percentage of failing rows, or an aggregate, against a threshold (comparison, number).

    Types: missing, invalid (options: pattern, values, low, high, min_length, max_length), duplicate, row_count, avg, sum, min,
    max, min_length, max_length, avg_length, distinct. `mostly` is the least share of rows that must pass, in place of a threshold.
    """

    name: str
    type: str
    column: str = ""
    threshold: tuple[str, float] = ("=", 0)
    warn: tuple[str, float] | None = None
    percent: bool = False
    mostly: float | None = None
    options: dict = field(default_factory=dict)


def failing(check: Check) -> Column | None:
    """The condition on a row that fails, for checks of rows. Missing values are no invalid ones."""
    c, o = F.col(check.column) if check.column else None, check.options
    if check.type == "missing":
        return c.isNull()
    if check.type != "invalid":
        return None
    bad = F.lit(False)
    if "pattern" in o:
        bad = bad | ~c.rlike(o["pattern"])
    if "values" in o:
        bad = bad | ~c.isin(o["values"])
    if "low" in o:
        bad = bad | (c < o["low"])
    if "high" in o:
        bad = bad | (c > o["high"])
    if "min_length" in o:
        bad = bad | (F.length(c) < o["min_length"])
    if "max_length" in o:
        bad = bad | (F.length(c) > o["max_length"])
    return c.isNotNull() & bad


def metric(check: Check) -> Column:
    c = F.col(check.column) if check.column else None
    if (bad := failing(check)) is not None:
        return F.count_if(bad)
    return {
        "row_count": lambda: F.count("*"), "avg": lambda: F.avg(c), "sum": lambda: F.sum(c), "min": lambda: F.min(c), "max": lambda: F.max(c),
        "min_length": lambda: F.min(F.length(c)), "max_length": lambda: F.max(F.length(c)), "avg_length": lambda: F.avg(F.length(c)),
        "distinct": lambda: F.count_distinct(c), "duplicate": lambda: F.count(c) - F.count_distinct(c),
    }[check.type]()


def scan(df: DataFrame, dataset: str, checks: list[Check], scan_id: str = "scan") -> DataFrame:
    """One result for each check: outcome pass, warn or fail; error where there was nothing to measure."""
    values = [metric(c).cast("double").alias(f"m{k}") for k, c in enumerate(checks)]
    measured = df.agg(F.count("*").alias("n"), *values)
    rows = []
    for k, c in enumerate(checks):
        counted = c.type in ("missing", "invalid", "duplicate")
        value = F.col(f"m{k}")
        shown = F.try_divide(value * 100, F.col("n")) if c.percent and counted else value
        if c.mostly is not None:
            test, said = (F.col("n") - value) >= c.mostly * F.col("n"), f"mostly {c.mostly}"
        else:
            test, said = COMPARE[c.threshold[0]](shown, F.lit(float(c.threshold[1]))), f"{c.threshold[0]} {c.threshold[1]}"
        outcome = F.when(shown.isNull(), "error").when(test, "pass")
        if c.warn:
            outcome = outcome.when(COMPARE[c.warn[0]](shown, F.lit(float(c.warn[1]))), "warn")
        rows.append(
            F.struct(
                F.lit(scan_id).alias("scan_id"), F.lit(dataset).alias("dataset"), F.lit(c.column).alias("column_name"), F.lit(c.name).alias("check_name"), F.lit(c.type).alias("check_type"),
                outcome.otherwise("fail").alias("outcome"), shown.alias("metric_value"), F.lit(said).alias("threshold"), F.col("n").alias("rows_tested"),
                (value.cast("long") if counted else F.lit(None).cast("long")).alias("failed_rows"),
            )
        )
    return measured.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def checks_of(contract: dict) -> list[Check]:
    """Checks of a parsed contract: {checks: [{name, type, column, must: "<= 5", warn, percent, mostly, ...options}]}."""
    out = []
    for c in contract["checks"]:
        rest = {k: v for k, v in c.items() if k not in ("name", "type", "column", "must", "warn", "percent", "mostly")}

        def limit(text: str) -> tuple[str, float]:
            sign, number = text.split()
            return sign, float(number)

        out.append(Check(c["name"], c["type"], c.get("column", ""), limit(c["must"]) if "must" in c else ("=", 0), limit(c["warn"]) if "warn" in c else None, c.get("percent", False), c.get("mostly"), rest))
    return out


def gate(df: DataFrame, condition: str, mode: str) -> str:
    """Preflight: CONTINUE, or ABORT where any (or, by mode, not all) rows meet the condition. Stops at the first such row."""
    bad = df.where(condition) if mode == "any" else df.where(f"NOT ({condition}) OR ({condition}) IS NULL")
    return "CONTINUE" if bad.limit(1).isEmpty() else "ABORT"


def contracted(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """`df` if it has exactly the canonical types of a contract, in its order; an error otherwise."""
    from ..types import canonical, canonical_of

    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise TypeError(f"missing columns: {missing}")
    for name, kind in columns.items():
        if canonical_of(df.schema[name].dataType) != canonical(kind):
            raise TypeError(f"{name} is {df.schema[name].dataType.simpleString()}, not {kind}")
    return df.select(*columns)
