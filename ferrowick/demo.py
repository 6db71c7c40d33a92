"""The semantic model of the sample tables, and engines over a folder of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .model import Mask, Metric, Relationship, Role, SemanticModel, Table
from .session import Engine

MODEL = SemanticModel.of(
    tables=[
        Table("region", ("r_regionkey",), "geography"), Table("nation", ("n_nationkey",), "geography"), Table("customer", ("c_custkey",), "sales"),
        Table("supplier", ("s_suppkey",), "supply"), Table("part", ("p_partkey",), "supply"), Table("orders", ("o_orderkey",), "sales"),
        Table("lineitem", ("l_orderkey", "l_linenumber"), "sales"), Table("events", ("event_id",), "activity"), Table("documents", ("doc_id",), "content"),
        Table("embeddings", ("vec_id",), "content"), Table("pages", ("page_id",), "content"),
    ],
    relationships=[
        Relationship("customer", "orders", "o_custkey", "customer", "c_custkey"),
        Relationship("lines", "orders", "o_orderkey", "lineitem", "l_orderkey", many=True),
        Relationship("part", "lineitem", "l_partkey", "part", "p_partkey"),
        Relationship("supplier", "lineitem", "l_suppkey", "supplier", "s_suppkey"),
        Relationship("nation", "customer", "c_nationkey", "nation", "n_nationkey"),
        Relationship("home", "supplier", "s_nationkey", "nation", "n_nationkey"),
        Relationship("region", "nation", "n_regionkey", "region", "r_regionkey"),
        Relationship("priority_code", "orders", "substring(o_orderpriority, 1, 1)", "region", "r_regionkey"),
    ],
    roles=[
        Role("admin"),
        Role("analyst", parent="sales", row_cap=10_000),
        Role("sales", domains=("sales", "geography", "supply"), rows={"orders": "o_orderstatus = 'F'", "customer": "c_mktsegment = 'BUILDING'"}, masks={("customer", "c_name"): Mask("regex", "[0-9]", "#"), ("customer", "c_acctbal"): Mask("constant", value=None), ("orders", "o_orderdate"): Mask("truncate", unit="month")}, hidden=frozenset({("customer", "c_nationkey")})),
        Role("regional", domain_rows={"geography": "1 = 1"}, rows={"customer": "c_nationkey IN (SELECT n_nationkey FROM nation_all WHERE n_regionkey = 1)"}),
        Role("masker", masks={("orders", "o_totalprice"): Mask("constant", value=0.0), ("customer", "c_custkey"): Mask("constant", value="MAX")}),
        Role("short", row_cap=7),
    ],
    metrics=[
        Metric("order_count", "orders", "count(*)"),
        Metric("order_value", "orders", "sum(CAST(o_totalprice AS DECIMAL(18,2)))"),
        Metric("revenue", "lineitem", "sum(CAST(l_extendedprice AS DECIMAL(18,2)) * CAST(1 - l_discount AS DECIMAL(6,4)))"),
        Metric("line_count", "lineitem", "count(*)"),
    ],
)


def engine(spark: SparkSession, folder: str, role: str = "admin") -> Engine:
    def load(name: str) -> DataFrame:
        return spark.read.parquet(f"{folder}/{name}.parquet")

    return Engine(spark, MODEL, load, role)
