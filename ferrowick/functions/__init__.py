"""Scalar functions of the graph query language, as Spark columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def substring0(text: Column, start: int, length: int | None = None) -> Column:
    """Zero-based substring."""
    return F.substring(text, start + 1, length if length is not None else 2**31 - 1)


def split_literal(text: Column, separator: str) -> Column:
    """Split at a literal separator; Spark's own takes a pattern."""
    return F.split(text, f"\\Q{separator}\\E", -1)


def matches(text: Column, pattern: str) -> Column:
    """Whether the pattern is found anywhere in the text."""
    return F.regexp_like(text, F.lit(pattern))


def slice_list(items: Column, start: int | None = None, stop: int | None = None) -> Column:
    """items[start..stop], zero-based, stop exclusive, negative positions from the end."""
    n = F.size(items)
    at = lambda k, default: default if k is None else (F.lit(k) if k >= 0 else F.greatest(n + k, F.lit(0)))
    low, high = at(start, F.lit(0)), at(stop, n)
    return F.slice(items, low + 1, F.greatest(F.least(high, n) - low, F.lit(0)))


def item(items: Column, k: int) -> Column:
    """items[k], zero-based, negative from the end, null when out of range."""
    return F.try_element_at(items, F.lit(k + 1 if k >= 0 else k))


def tail(items: Column) -> Column:
    return slice_list(items, 1)


def all_match(items: Column, test) -> Column:
    return F.forall(items, test)


def any_match(items: Column, test) -> Column:
    return F.exists(items, test)


def none_match(items: Column, test) -> Column:
    return ~F.exists(items, test)


def single_match(items: Column, test) -> Column:
    return F.size(F.filter(items, test)) == 1


def reduce_list(items: Column, start: Column, step) -> Column:
    return F.aggregate(items, start, step)


def xor(a: Column, b: Column) -> Column:
    return a != b


def is_empty(value: Column, is_list: bool) -> Column:
    return F.size(value) == 0 if is_list else F.length(value) == 0


def to_integer(value: Column) -> Column:
    """Null where the value is no number; fractions are cut."""
    return value.try_cast("double").try_cast("bigint")


def to_float(value: Column) -> Column:
    return value.try_cast("double")


def to_boolean(value: Column) -> Column:
    return value.try_cast("boolean")


def percentile_cont(column: str, p: float) -> Column:
    return F.expr(f"percentile_cont({p}) WITHIN GROUP (ORDER BY {column})")


def percentile_disc(column: str, p: float) -> Column:
    return F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY {column})")


def from_unix_timestamp(seconds: Column) -> Column:
    return F.timestamp_seconds(seconds)


def cents_to_decimal(cents: Column) -> Column:
    return (cents.cast("decimal(18,0)") / 100).cast("decimal(18,2)")


def json_value(json: Column, path: str, kind: str = "string") -> Column:
    """A dot path promoted to a typed column."""
    return F.get_json_object(json, f"$.{path}").cast(kind)


def cosine_similarity(a: Column, b: Column) -> Column:
    """Null for vectors of different lengths and for zero vectors."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    size = F.sqrt(dot(a, a) * dot(b, b))
    return F.when((F.size(a) == F.size(b)) & (size > 0), dot(a, b) / size)
