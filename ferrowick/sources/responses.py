"""JSON responses as rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..types import spark_type


def flatten(df: DataFrame, column: str, root: str, fields: dict[str, tuple[str, str]]) -> DataFrame:
    """Rows of the list at `root` (a dot path, empty for the top) of a JSON column; fields: {name: (dot path, canonical type)}.

    An object at the root counts as a list of one; values that don't fit their type are null.
    """
    body = F.get_json_object(column, f"$.{root}" if root else "$")
    listed = F.when(body.startswith("["), body).otherwise(F.concat(F.lit("["), body, F.lit("]")))
    items = df.withColumn("__item", F.explode(F.from_json(listed, "array<string>")))
    rest = [c for c in df.columns if c != column]
    return items.select(*rest, *[F.get_json_object("__item", f"$.{path}").try_cast(spark_type(kind)).alias(name) for name, (path, kind) in fields.items()])


def key_values(df: DataFrame, column: str, root: str = "") -> DataFrame:
    """A map-shaped response as (key, value) rows."""
    body = F.get_json_object(column, f"$.{root}") if root else F.col(column)
    rest = [c for c in df.columns if c != column]
    return df.select(*rest, F.explode(F.from_json(body, "map<string,string>")).alias("key", "value"))


def tabular(df: DataFrame, column: str, columns: list[str], rows: str = "data.values", names: str = "data.fields") -> DataFrame:
    """Responses with a list of column names and a list of value lists: each wanted column by its place in the names."""
    fields = F.from_json(F.get_json_object(column, f"$.{names}"), "array<string>")
    values = F.explode(F.from_json(F.get_json_object(column, f"$.{rows}"), "array<array<string>>"))
    out = df.select(fields.alias("__f"), values.alias("__v"))
    return out.select(*[F.try_element_at("__v", F.array_position("__f", c).cast("int")).alias(c) for c in columns])


def graph_nodes(df: DataFrame, column: str, properties: list[str]) -> DataFrame:
    """id, labels and chosen properties of the nodes of graph-shaped responses, each node once."""
    kind = "array<struct<graph:struct<nodes:array<struct<id:string,labels:array<string>,properties:map<string,string>>>>>>"
    nodes = df.select(F.explode(F.from_json(F.get_json_object(column, "$.results[0].data"), kind)).alias("d")).select(F.explode("d.graph.nodes").alias("n"))
    return nodes.select("n.id", "n.labels", *[F.col("n.properties").getItem(p).alias(p) for p in properties]).distinct()


def graph_relationships(df: DataFrame, column: str) -> DataFrame:
    kind = "array<struct<graph:struct<relationships:array<struct<id:string,type:string,startNode:string,endNode:string>>>>>"
    rels = df.select(F.explode(F.from_json(F.get_json_object(column, "$.results[0].data"), kind)).alias("d")).select(F.explode("d.graph.relationships").alias("r"))
    return rels.select("r.*").distinct()


def bindings(df: DataFrame, column: str, variables: list[str]) -> DataFrame:
    """SPARQL result bindings: the value of each variable."""
    rows = df.select(F.explode(F.from_json(F.get_json_object(column, "$.results.bindings"), "array<map<string,struct<value:string>>>")).alias("b"))
    return rows.select(*[F.col("b").getItem(v)["value"].alias(v) for v in variables])


def promoted(df: DataFrame, column: str, paths: dict[str, tuple[str, str]]) -> DataFrame:
    """JSON dot paths as typed columns next to the JSON: {name: (path, canonical type)}."""
    return df.withColumns({name: F.get_json_object(column, f"$.{path}").try_cast(spark_type(kind)) for name, (path, kind) in paths.items()})


def avro_columns(schema: dict) -> dict[str, str]:
    """Canonical types of an Avro record's fields; unions with null take the other branch; nested ones are json."""
    plain = {"int": "integer", "long": "bigint", "float": "float", "double": "double", "boolean": "boolean", "bytes": "bytea", "string": "text", "enum": "text"}
    logical = {"date": "date", "timestamp-millis": "timestamp", "timestamp-micros": "timestamp", "uuid": "uuid", "decimal": "numeric"}
    out = {}
    for f in schema["fields"]:
        kind = f["type"]
        if isinstance(kind, list):
            kind = next(k for k in kind if k != "null")
        if isinstance(kind, dict):
            kind = logical.get(kind.get("logicalType")) or plain.get(kind["type"], "json")
        else:
            kind = plain.get(kind, "json")
        out[f["name"]] = kind
    return out


def in_window(at: Column, now: Column, window: str) -> Column:
    """A topic's default time window; `now` is passed in, so that a query can be run again."""
    return at >= now - F.expr(f"INTERVAL {window}")
