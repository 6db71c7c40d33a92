"""The fourteen canonical column types and how they map to Spark."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import types as T

# Canonical types and their Spark types. Timestamps are UTC without zone; uuid and json are held as text.
SPARK_TYPES = {
    "smallint": T.ShortType(), "integer": T.IntegerType(), "bigint": T.LongType(), "text": T.StringType(), "boolean": T.BooleanType(),
    "float": T.FloatType(), "double": T.DoubleType(), "numeric": T.DecimalType(38, 9), "date": T.DateType(), "timestamp": T.TimestampNTZType(),
    "time": T.StringType(), "uuid": T.StringType(), "bytea": T.BinaryType(), "json": T.StringType(),
}
# Other names of the canonical types.
ALIASES = {
    "int2": "smallint", "tinyint": "smallint", "int": "integer", "int4": "integer", "int8": "bigint", "long": "bigint", "varchar": "text", "char": "text", "string": "text",
    "bool": "boolean", "bit": "boolean", "real": "float", "float4": "float", "float8": "double", "double precision": "double", "decimal": "numeric", "datetime": "timestamp",
    "timestamptz": "timestamp", "timestamp with time zone": "timestamp", "binary": "bytea", "varbinary": "bytea", "blob": "bytea", "jsonb": "json",
}
# Families within which types compare as they are.
FAMILIES = {
    "numeric": ("smallint", "integer", "bigint", "float", "double", "numeric"),
    "string": ("text", "uuid", "json", "time"),
    "temporal": ("date", "timestamp"),
}


class UnknownType(ValueError):
    """A type name that is not in the vocabulary. Nothing falls back to text silently."""


def canonical(name: str) -> str:
    bare = re.sub(r"\s*\(.*\)", "", name.strip().lower())
    found = ALIASES.get(bare, bare)
    if found not in SPARK_TYPES:
        raise UnknownType(name)
    return found


def spark_type(name: str) -> T.DataType:
    """The Spark type of a canonical name or alias; numeric(p, s) keeps its precision."""
    size = re.fullmatch(r"(?:numeric|decimal)\s*\(\s*(\d+)\s*(?:,\s*(\d+)\s*)?\)", name.strip().lower())
    return T.DecimalType(int(size[1]), int(size[2] or 0)) if size else SPARK_TYPES[canonical(name)]


def canonical_of(kind: T.DataType) -> str:
    """The canonical name of a Spark type; nested types and maps count as json."""
    if isinstance(kind, T.DecimalType):
        return "numeric"
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return "timestamp"
    if isinstance(kind, (T.ArrayType, T.StructType, T.MapType, T.VariantType)):
        return "json"
    if isinstance(kind, T.ByteType):
        return "smallint"
    for name, own in SPARK_TYPES.items():
        if type(own) is type(kind):
            return name
    raise UnknownType(kind.simpleString())


def family(name: str) -> str:
    return next((f for f, names in FAMILIES.items() if name in names), name)


def comparable(left: Column, left_type: T.DataType, right: Column, right_type: T.DataType) -> tuple[Column, Column]:
    """Both sides of an equality; as text where their families differ."""
    if family(canonical_of(left_type)) == family(canonical_of(right_type)):
        return left, right
    return left.cast("string"), right.cast("string")


def schema(columns: dict[str, str]) -> T.StructType:
    return T.StructType([T.StructField(name, spark_type(kind)) for name, kind in columns.items()])
