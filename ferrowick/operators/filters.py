"""Filters given as values: where trees, REST and JSON:API parameters, pushed-down predicates."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..model import ModelError

# Comparisons by name. All follow SQL's three-valued logic except the two distinctness tests.
COMPARISONS = {
    "eq": lambda c, v: c == v,
    "neq": lambda c, v: c != v,
    "gt": lambda c, v: c > v,
    "gte": lambda c, v: c >= v,
    "lt": lambda c, v: c < v,
    "lte": lambda c, v: c <= v,
    "in": lambda c, v: c.isin(list(v)),
    "not_in": lambda c, v: ~c.isin(list(v)),
    "like": lambda c, v: c.like(v),
    "not_like": lambda c, v: ~c.like(v),
    "ilike": lambda c, v: c.ilike(v),
    "not_ilike": lambda c, v: ~c.ilike(v),
    "is_null": lambda c, v: c.isNull() if v else c.isNotNull(),
    "between": lambda c, v: c.between(*v),
    "distinct_from": lambda c, v: ~c.eqNullSafe(v),
    "not_distinct_from": lambda c, v: c.eqNullSafe(v),
}
# Comparisons that boolean and nested columns have.
REDUCED = {"eq", "neq", "is_null", "in"}
TEMPORAL = (T.DateType, T.TimestampType, T.TimestampNTZType)


def value_for(kind: T.DataType, value):
    """ISO strings become timestamps or dates where the column is temporal."""
    if isinstance(value, (list, tuple)):
        return [value_for(kind, v) for v in value]
    return F.lit(value).cast(kind) if isinstance(kind, TEMPORAL) and isinstance(value, str) else value


def compare(name: str, kind: T.DataType, column: Column, op: str, value) -> Column:
    if op not in COMPARISONS or (isinstance(kind, (T.BooleanType, T.StructType, T.ArrayType, T.MapType)) and op not in REDUCED):
        raise ModelError(f"{name} has no comparison {op}")
    return COMPARISONS[op](column, value if op == "is_null" else value_for(kind, value))


def where(spec: dict | None, schema: T.StructType, constants: dict[str, str] | None = None) -> Column:
    """A where tree as a condition: {column: {op: value}}, _and, _or and _not; siblings are ANDed and an empty tree is true.

    `constants` are virtual columns such as a table's name; their comparisons fold to true or false.
    """
    parts = []
    for name, test in (spec or {}).items():
        if name in ("_and", "_or"):
            inner = [where(x, schema, constants) for x in test]
            parts.append(reduce(and_ if name == "_and" else or_, inner) if inner else F.lit(True))
        elif name == "_not":
            parts.append(~where(test, schema, constants))
        else:
            known = constants and name in constants
            if not known and name not in schema.names:
                raise ModelError(f"no column {name}")
            column, kind = (F.lit(constants[name]), T.StringType()) if known else (F.col(f"`{name}`"), schema[name].dataType)
            parts += [compare(name, kind, column, op, value) for op, value in test.items()]
    return reduce(and_, parts) if parts else F.lit(True)


def rest_where(filters: list[dict]) -> dict:
    """[{field, comparator, value}] as a where tree."""
    return {"_and": [{f["field"]: {f["comparator"]: f["value"]}} for f in filters]}


def order_by(items: list[str | tuple[str, str]]) -> list[Column]:
    """Names, or (name, direction): asc or desc, with _nulls_first or _nulls_last. Nulls go last unless said otherwise."""
    out = []
    for item in items:
        name, direction = (item, "asc") if isinstance(item, str) else item
        if not re.fullmatch(r"(asc|desc)(_nulls_(first|last))?", direction):
            raise ModelError(f"no direction {direction}")
        full = direction if "nulls" in direction else f"{direction}_nulls_last"
        out.append(getattr(F.col(name), full)())
    return out


@dataclass(frozen=True)
class Request:
    """What a JSON:API query string asks for."""

    where: dict = field(default_factory=dict)
    fields: list[str] | None = None
    sort: list[tuple[str, str]] = field(default_factory=list)
    include: list[str] = field(default_factory=list)
    limit: int = 25
    offset: int = 0


def jsonapi_request(params: dict[str, str], table: str) -> Request:
    """filter[field][op], fields[table], sort, include, page[number] and page[size]."""
    tests, fields, sort, include, number, size = [], None, [], [], 1, 25
    for key, value in params.items():
        if m := re.fullmatch(r"filter\[(\w+)\](?:\[(\w+)\])?", key):
            op = m[2] or "eq"
            tests.append({m[1]: {op: value.split(",") if op in ("in", "not_in") else value}})
        elif key == f"fields[{table}]":
            fields = value.split(",")
        elif key == "sort":
            sort = [(x.lstrip("-"), "desc" if x.startswith("-") else "asc") for x in value.split(",")]
        elif key == "include":
            include = value.split(",")
        elif key == "page[number]":
            number = max(int(value), 1)
        elif key == "page[size]":
            size = max(int(value), 1)
    return Request({"_and": tests} if tests else {}, fields, sort, include, size, (number - 1) * size)
