"""Registry of the queries over the relational tables, each with the SQL that gives the same rows."""

from __future__ import annotations

import hashlib
import tempfile
import uuid
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import functions as fn
from .demo import MODEL, engine
from .mv import bitemporal, delta, history, refresh, rewrite
from .operators import aggregates, graph, paging, relations, vectors
from .operators.filters import jsonapi_request, order_by, rest_where, where
from .plans import calendars, freshness, inspect, quality
from .sources import responses
from .streaming import changes

QUERIES: dict = {}
ORACLE_SQL: dict = {}
MONEY = "DECIMAL(18,2)"


def query(sql: str | None = None):
    """Register a function under its name."""

    def keep(function):
        QUERIES[function.__name__] = function
        if sql:
            ORACLE_SQL[function.__name__] = sql
        return function

    return keep


# --- The flagship: a governed selection with a nested relationship ---


@query("""
SELECT o_orderkey, o_totalprice, CASE WHEN c_custkey IS NULL THEN NULL ELSE regexp_replace(c_name, '[0-9]', '#', 'g') END AS customer_name, date_trunc('month', o_orderdate)::DATE AS month
FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_mktsegment = 'BUILDING') ON o_custkey = c_custkey
WHERE o_orderstatus = 'F' AND o_totalprice > 1000
ORDER BY o_totalprice DESC, o_orderkey LIMIT 10""")
def governed_selection(spark: SparkSession, sf: str) -> DataFrame:
    rows = engine(spark, sf, "analyst").select(
        "orders", ["o_orderkey", "o_totalprice", "o_orderdate", {"customer": ["c_name"]}], where_={"o_totalprice": {"gt": 1000}}, order=[("o_totalprice", "desc"), "o_orderkey"], limit=10
    )
    return rows.select("o_orderkey", "o_totalprice", F.col("customer.c_name").alias("customer_name"), F.to_date("o_orderdate").alias("month"))


# --- Projection, filters, ordering ---


@query("""SELECT o_orderkey FROM orders WHERE (o_orderstatus = 'O' OR o_totalprice < 2000) AND o_orderpriority LIKE '1%' AND NOT (o_custkey IN (1, 2, 3)) AND o_custkey IS NOT NULL""")
def rel_where_tree(spark, sf):
    tree = {"_or": [{"o_orderstatus": {"eq": "O"}}, {"o_totalprice": {"lt": 2000}}], "o_orderpriority": {"like": "1%"}, "_not": {"o_custkey": {"in": [1, 2, 3]}}, "_and": [{"o_custkey": {"is_null": False}}, {}]}
    return engine(spark, sf).select("orders", ["o_orderkey"], where_=tree)


@query("""SELECT p_partkey FROM part WHERE p_size BETWEEN 10 AND 20 AND p_type ILIKE '%brass%' AND p_brand IS DISTINCT FROM 'Brand#11' AND p_brand NOT IN ('Brand#12')""")
def rel_like_in_null(spark, sf):
    tree = {"p_size": {"between": [10, 20]}, "p_type": {"ilike": "%brass%"}, "p_brand": {"distinct_from": "Brand#11", "not_in": ["Brand#12"]}}
    return engine(spark, sf).select("part", ["p_partkey"], where_=tree)


@query("""SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-01-10 00:00:00' AND ts < TIMESTAMP '2024-01-11 12:00:00'""")
def rel_iso_timestamp(spark, sf):
    return engine(spark, sf).select("events", ["event_id"], where_={"ts": {"gte": "2024-01-10T00:00:00", "lt": "2024-01-11T12:00:00"}})


@query("""SELECT event_id, json_extract_string(props, '$.k')::BIGINT AS k FROM events WHERE json_extract_string(props, '$.k')::BIGINT > 50""")
def rel_json_path(spark, sf):
    df = engine(spark, sf).select("events", ["event_id", ("k", "CAST(get_json_object(props, '$.k') AS BIGINT)")])
    return df.where("k > 50")


@query("""SELECT 'orders' AS source, 'sales' AS domain, count(*) AS n FROM orders""")
def rel_virtual_columns(spark, sf):
    df = engine(spark, sf).select("orders", [("source", "_name_"), ("domain", "_domain_")], where_={"_name_": {"eq": "orders"}})
    return df.groupBy("source", "domain").agg(F.count("*").alias("n"))


@query("""SELECT c_custkey FROM customer WHERE c_acctbal >= 5000 AND c_mktsegment IN ('BUILDING', 'MACHINERY')""")
def rel_rest_filter(spark, sf):
    filters = [{"field": "c_acctbal", "comparator": "gte", "value": 5000}, {"field": "c_mktsegment", "comparator": "in", "value": ["BUILDING", "MACHINERY"]}]
    return engine(spark, sf).select("customer", ["c_custkey"], where_=rest_where(filters))


@query("""SELECT s_suppkey, s_name FROM supplier WHERE s_acctbal > 0 ORDER BY s_acctbal DESC, s_suppkey LIMIT 5 OFFSET 5""")
def rel_jsonapi(spark, sf):
    r = jsonapi_request({"filter[s_acctbal][gt]": "0", "fields[supplier]": "s_suppkey,s_name", "sort": "-s_acctbal,s_suppkey", "page[number]": "2", "page[size]": "5"}, "supplier")
    return engine(spark, sf).select("supplier", r.fields, where_=r.where, order=r.sort, limit=r.limit, offset=r.offset)


@query("""WITH big AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 5)
SELECT c_mktsegment, CASE WHEN sum(n) > 100 THEN 'many' ELSE 'few' END AS size, sum(n)::BIGINT AS n FROM customer JOIN big ON c_custkey = o_custkey GROUP BY c_mktsegment""")
def rel_sql(spark, sf):
    return engine(spark, sf).sql(
        "WITH big AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 5) "
        "SELECT c_mktsegment, CASE WHEN sum(n) > 100 THEN 'many' ELSE 'few' END AS size, sum(n) AS n FROM customer JOIN big ON c_custkey = o_custkey GROUP BY c_mktsegment"
    )


@query("""SELECT e.event_id, row_number() OVER (PARTITION BY event_type ORDER BY CASE WHEN value > 50 THEN NULL ELSE user_id END ASC NULLS FIRST, e.event_id DESC)::INTEGER AS place FROM events e""")
def order_nulls(spark, sf):
    df = engine(spark, sf).table("events").withColumn("u", F.expr("CASE WHEN value > 50 THEN NULL ELSE user_id END"))
    ordered = order_by([("u", "asc_nulls_first"), ("event_id", "desc")])
    return df.withColumn("place", F.row_number().over(graph.Window.partitionBy("event_type").orderBy(*ordered))).select("event_id", "place")


@query("""SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20 OFFSET 40""")
def offset_page(spark, sf):
    return engine(spark, sf).select("orders", ["o_orderkey", "o_totalprice"], order=[("o_totalprice", "desc"), "o_orderkey"], limit=20, offset=40)


@query("""SELECT o_orderkey, o_orderpriority FROM orders ORDER BY o_orderpriority DESC, o_orderkey LIMIT 30 OFFSET 30""")
def cursor_page(spark, sf):
    df, order = engine(spark, sf).select("orders", ["o_orderkey", "o_orderpriority"]), [("o_orderpriority", "desc"), ("o_orderkey", "asc")]
    return paging.page(df, order, first=30, after=paging.page(df, order, first=30).last).rows


@query("""SELECT o_orderkey, o_orderpriority FROM orders ORDER BY o_orderpriority DESC, o_orderkey LIMIT 10 OFFSET 20""")
def cursor_page_back(spark, sf):
    df, order = engine(spark, sf).select("orders", ["o_orderkey", "o_orderpriority"]), [("o_orderpriority", "desc"), ("o_orderkey", "asc")]
    return paging.page(df, order, last=10, before=paging.page(df.where("true"), order, first=31).last).rows


@query()
def sample_bernoulli(spark, sf):
    return engine(spark, sf).select("lineitem", ["l_orderkey", "l_linenumber"], sample=10, seed=42)


@query("""SELECT count(*) AS n FROM (SELECT * FROM orders LIMIT 7)""")
def row_cap(spark, sf):
    return engine(spark, sf, "short").select("orders", ["o_orderkey"], limit=100).agg(F.count("*").alias("n"))


# --- Joins ---


@query("""SELECT o_orderkey, c_name, n_name FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey WHERE o_totalprice > 400000""")
def join_m2o(spark, sf):
    df = engine(spark, sf).select("orders", ["o_orderkey", {"customer": ["c_name", {"nation": ["n_name"]}]}], where_={"o_totalprice": {"gt": 400000}})
    return df.select("o_orderkey", "customer.c_name", "customer.nation.n_name")


@query("""SELECT o_orderkey, count(l_orderkey) AS n_lines, coalesce(sum(l_quantity::BIGINT), 0)::BIGINT AS quantity FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderkey""")
def join_o2m_count(spark, sf):
    df = engine(spark, sf).select("orders", ["o_orderkey", {"lines": ["l_linenumber", "l_quantity"]}])
    total = F.aggregate("lines", F.lit(0).cast("long"), lambda a, x: a + x["l_quantity"].cast("long"))
    return df.select("o_orderkey", F.size("lines").cast("long").alias("n_lines"), total.alias("quantity"))


@query("""SELECT o_orderkey, l_partkey, l_extendedprice, place::INTEGER AS place FROM (
  SELECT o_orderkey, l_partkey, l_extendedprice, row_number() OVER (PARTITION BY o_orderkey ORDER BY l_extendedprice DESC, l_partkey, l_linenumber, l_suppkey, l_shipdate) AS place
  FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_orderstatus = 'P') WHERE place <= 2""")
def join_lateral_topn(spark, sf):
    order = [("l_extendedprice", "desc"), "l_partkey", "l_linenumber", "l_suppkey", "l_shipdate"]
    orders, lines = engine(spark, sf).table("orders").where("o_orderstatus = 'P'"), engine(spark, sf).table("lineitem")
    best = relations.top_per_parent(relations.join_flat(orders, lines, MODEL.relationships["lines"], "inner"), ["o_orderkey"], order, 2)
    place = F.row_number().over(graph.Window.partitionBy("o_orderkey").orderBy(*order_by(order)))
    return best.withColumn("place", place).select("o_orderkey", "l_partkey", "l_extendedprice", "place")


@query("""SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')""")
def join_semi(spark, sf):
    e = engine(spark, sf)
    return e.table("customer").join(e.table("orders").where("o_orderstatus = 'P'"), F.expr("o_custkey = c_custkey"), "left_semi").select("c_custkey")


@query("""SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)""")
def join_anti(spark, sf):
    e = engine(spark, sf)
    return e.table("customer").join(e.table("orders"), F.expr("o_custkey = c_custkey"), "left_anti").select("c_custkey")


@query("""SELECT o_orderkey, r_name FROM orders LEFT JOIN region ON substring(o_orderpriority, 1, 1) = CAST(r_regionkey AS VARCHAR)""")
def join_cast_varchar(spark, sf):
    e = engine(spark, sf)
    return relations.join_flat(e.table("orders"), e.table("region"), MODEL.relationships["priority_code"]).select("o_orderkey", "r_name")


@query("""SELECT o_orderkey, l_linenumber, l_partkey, l_suppkey FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE o_orderstatus = 'P'""")
def flat_join(spark, sf):
    e = engine(spark, sf)
    df = relations.join_flat(e.table("orders").where("o_orderstatus = 'P'"), e.table("lineitem"), MODEL.relationships["lines"], "inner")
    return df.select("o_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


@query("""SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS n FROM orders) WHERE n = 1""")
def distinct_on(spark, sf):
    return engine(spark, sf).select("orders", ["o_custkey", "o_orderkey"], distinct=["o_custkey"], order=[("o_orderdate", "desc"), "o_orderkey"])


@query("""SELECT DISTINCT c_custkey, c_mktsegment FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)""")
def join_normalized(spark, sf):
    return relations.normalized(engine(spark, sf), "orders", ["o_orderkey", {"customer": ["c_mktsegment"]}])["orders.customer"]


# --- Aggregates ---


@query(f"""SELECT count(*) AS count, sum(CAST(o_totalprice AS {MONEY}))::DOUBLE AS total, round(avg(o_totalprice), 4) AS mean, round(stddev_samp(o_totalprice), 4) AS deviation, min(o_orderkey) AS low, max(o_orderdate)::VARCHAR AS newest FROM orders WHERE o_orderstatus = 'F'""")
def agg_global(spark, sf):
    df = engine(spark, sf).table("orders").withColumn("price", F.col("o_totalprice").cast(MONEY))
    out = aggregates.aggregate(df, {"count": True, "sum": ["price"], "avg": ["o_totalprice"], "stddev": ["o_totalprice"], "min": ["o_orderkey"], "max": ["o_orderdate"]}, where_={"o_orderstatus": {"eq": "F"}})
    return out.select("count", F.col("sum_price").cast("double").alias("total"), F.round("avg_o_totalprice", 4).alias("mean"), F.round("stddev_o_totalprice", 4).alias("deviation"), F.col("min_o_orderkey").alias("low"), F.col("max_o_orderdate").cast("string").alias("newest"))


@query("""SELECT l_returnflag, l_linestatus, count(*) AS count, sum(l_quantity::BIGINT)::BIGINT AS sum_quantity, min(l_linenumber) AS min_l_linenumber, max(l_suppkey) AS max_l_suppkey FROM lineitem GROUP BY ALL""")
def agg_group_by(spark, sf):
    df = engine(spark, sf).table("lineitem").withColumn("quantity", F.col("l_quantity").cast("long"))
    return aggregates.group_by(df, ["l_returnflag", "l_linestatus"], {"count": True, "sum": ["quantity"], "min": ["l_linenumber"], "max": ["l_suppkey"]})


@query("""SELECT o_custkey, count(*) FILTER (o_orderstatus = 'F') AS count, max(o_orderkey) FILTER (o_orderstatus = 'F') AS max_o_orderkey FROM orders GROUP BY o_custkey""")
def agg_filter(spark, sf):
    return engine(spark, sf).group_by("orders", ["o_custkey"], {"count": True, "max": ["o_orderkey"]}, filter_={"o_orderstatus": {"eq": "F"}})


@query("""SELECT o_custkey, count(*) AS count, min(o_orderkey) AS min_o_orderkey FROM orders GROUP BY o_custkey HAVING count(*) >= 12 AND min(o_orderkey) < 5000""")
def agg_having(spark, sf):
    return engine(spark, sf).group_by("orders", ["o_custkey"], {"count": True, "min": ["o_orderkey"]}, having={"count": {"gte": 12}, "min_o_orderkey": {"lt": 5000}})


@query("""SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)""")
def agg_cube(spark, sf):
    return engine(spark, sf).table("lineitem").cube("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"))


@query("""SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)""")
def agg_rollup(spark, sf):
    return engine(spark, sf).table("orders").rollup("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"))


@query("""SELECT event_type, round(quantile_cont(value, 0.9), 4) AS p90, quantile_disc(value, 0.5) AS median FROM events GROUP BY event_type""")
def agg_percentile(spark, sf):
    return engine(spark, sf).table("events").groupBy("event_type").agg(F.round(fn.percentile_cont("value", 0.9), 4).alias("p90"), fn.percentile_disc("value", 0.5).alias("median"))


@query(f"""SELECT r_name, c_mktsegment, sum(CAST(o_totalprice AS {MONEY}))::DOUBLE AS order_value, count(*) AS order_count FROM orders LEFT JOIN customer ON o_custkey = c_custkey
LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey GROUP BY ALL""")
def agg_metric_by_dim(spark, sf):
    df = engine(spark, sf).metrics(["order_value", "order_count"], ["region.r_name", "customer.c_mktsegment"])
    return df.withColumn("order_value", F.col("order_value").cast("double"))


@query("""SELECT p_brand, count(*) AS line_count FROM lineitem LEFT JOIN part ON l_partkey = p_partkey WHERE l_returnflag = 'R' GROUP BY p_brand""")
def agg_metric_view(spark, sf):
    return engine(spark, sf).metrics(["line_count"], ["part.p_brand"], ["l_returnflag = 'R'"])


@query(f"""SELECT o_orderstatus, (sum(CAST(o_totalprice AS {MONEY})) / count(*))::DECIMAL(18,2)::DOUBLE AS mean FROM orders GROUP BY o_orderstatus""")
def agg_metric_call(spark, sf):
    df = engine(spark, sf).sql("SELECT o_orderstatus, metric('order_value') / metric('order_count') AS mean FROM orders GROUP BY o_orderstatus")
    return df.select("o_orderstatus", F.col("mean").cast(MONEY).cast("double").alias("mean"))


@query(f"""SELECT l_suppkey, l_returnflag, count(*) AS n, sum(CAST(l_extendedprice AS {MONEY}))::DOUBLE AS price FROM lineitem GROUP BY ALL""")
def agg_fact_reduce(spark, sf):
    fact = aggregates.Fact(("l_suppkey", "l_returnflag"), (("n", "count(*)"), ("price", f"CAST(sum(CAST(l_extendedprice AS {MONEY})) AS DOUBLE)")))
    return fact.lower(engine(spark, sf).table("lineitem"))


@query("""SELECT DISTINCT l_suppkey, l_partkey FROM lineitem""")
def agg_fact_keys(spark, sf):
    return aggregates.Fact(("l_suppkey", "l_partkey")).lower(engine(spark, sf).table("lineitem"))


@query("""SELECT o_custkey, o_orderkey AS last_order, o_orderstatus FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS n FROM orders) WHERE n = 1""")
def entity_latest(spark, sf):
    entity = aggregates.Entity(("o_custkey",), ("o_orderkey", "o_orderstatus"), "o_orderdate")
    return entity.lower(engine(spark, sf).table("orders")).withColumnRenamed("o_orderkey", "last_order")


@query("""SELECT n_regionkey, count(*) AS count, string_agg(n_name, ',' ORDER BY n_name) AS names FROM nation GROUP BY n_regionkey""")
def agg_nodes_per_group(spark, sf):
    df = engine(spark, sf).group_by("nation", ["n_regionkey"], {"count": True}, nodes=["n_name"])
    return df.select("n_regionkey", "count", F.array_join(F.transform("nodes", lambda x: x["n_name"]), ",").alias("names"))


@query("""SELECT count(*) AS n FROM lineitem""")
def cheap_count(spark, sf):
    return spark.read.parquet(f"{sf}/lineitem.parquet").agg(F.count("*").alias("n"))


# --- Windows and set operations ---


@query("""SELECT o_orderkey, rank() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC)::INTEGER AS r, dense_rank() OVER (PARTITION BY o_custkey ORDER BY o_orderstatus)::INTEGER AS d, ntile(3) OVER (PARTITION BY o_custkey ORDER BY o_orderkey)::INTEGER AS t FROM orders""")
def win_rank(spark, sf):
    w = "(PARTITION BY o_custkey ORDER BY {})"
    return engine(spark, sf).table("orders").selectExpr("o_orderkey", f"rank() OVER {w.format('o_totalprice DESC')} AS r", f"dense_rank() OVER {w.format('o_orderstatus')} AS d", f"ntile(3) OVER {w.format('o_orderkey')} AS t")


@query(f"""SELECT o_orderkey, sum(CAST(o_totalprice AS {MONEY})) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)::DOUBLE AS recent FROM orders""")
def win_frame_sum(spark, sf):
    return engine(spark, sf).table("orders").selectExpr("o_orderkey", f"CAST(sum(CAST(o_totalprice AS {MONEY})) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS DOUBLE) AS recent")


@query("""SELECT event_id, lag(event_type) OVER w AS previous, lead(event_id, 2) OVER w AS later, first_value(event_id) OVER w AS opened FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)""")
def win_lag(spark, sf):
    w = "(PARTITION BY user_id ORDER BY ts, event_id)"
    return engine(spark, sf).table("events").selectExpr("event_id", f"lag(event_type) OVER {w} AS previous", f"lead(event_id, 2) OVER {w} AS later", f"first_value(event_id) OVER {w} AS opened")


@query("""SELECT 'region' AS label, r_regionkey::VARCHAR AS id, NULL AS n_name, r_name FROM region UNION ALL SELECT 'nation', n_nationkey::VARCHAR, n_name, NULL FROM nation""")
def set_union_all(spark, sf):
    return graph.label_union(engine(spark, sf), ["region", "nation"]).select("label", "id", "n_name", "r_name")


@query("""SELECT o_custkey FROM orders WHERE o_orderstatus = 'F' INTERSECT SELECT o_custkey FROM orders WHERE o_orderstatus = 'P'""")
def set_intersect(spark, sf):
    df = engine(spark, sf).table("orders")
    return df.where("o_orderstatus = 'F'").select("o_custkey").intersect(df.where("o_orderstatus = 'P'").select("o_custkey"))


@query("""SELECT o_custkey FROM orders WHERE o_orderstatus = 'F' EXCEPT ALL SELECT o_custkey FROM orders WHERE o_orderstatus = 'O'""")
def set_except(spark, sf):
    df = engine(spark, sf).table("orders")
    return df.where("o_orderstatus = 'F'").select("o_custkey").exceptAll(df.where("o_orderstatus = 'O'").select("o_custkey"))


# --- Governance ---


@query("""SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F'""")
def gov_rls(spark, sf):
    return engine(spark, sf, "sales").table("orders").select("o_orderkey")


@query("""SELECT c_custkey, c_name FROM customer WHERE c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1)""")
def gov_rls_subquery(spark, sf):
    spark.read.parquet(f"{sf}/nation.parquet").createOrReplaceTempView("nation_all")
    return engine(spark, sf, "regional").table("customer").select("c_custkey", "c_name")


@query("""SELECT upper(regexp_replace(c_name, '[0-9]', '#', 'g')) AS shown, count(*) AS n FROM customer WHERE c_mktsegment = 'BUILDING' GROUP BY 1""")
def gov_mask_regex(spark, sf):
    return engine(spark, sf, "analyst").sql("SELECT upper(c_name) AS shown, count(*) AS n FROM customer GROUP BY 1")


@query("""SELECT strftime(date_trunc('month', o_orderdate), '%Y-%m-%d') AS month, count(*) AS n FROM orders WHERE o_orderstatus = 'F' GROUP BY 1""")
def gov_mask_truncate(spark, sf):
    df = engine(spark, sf, "sales").table("orders")
    return df.groupBy(F.date_format("o_orderdate", "yyyy-MM-dd").alias("month")).agg(F.count("*").alias("n"))


@query("""SELECT 0.0::DOUBLE AS top, 9223372036854775807::BIGINT AS key, count(*) AS n FROM orders""")
def gov_mask_constant(spark, sf):
    e = engine(spark, sf, "masker")
    key = e.table("customer").agg(F.max("c_custkey").alias("key"))
    return e.table("orders").agg(F.max("o_totalprice").alias("top"), F.count("*").alias("n")).crossJoin(F.broadcast(key))  # one row each


@query("""SELECT column_name FROM (VALUES ('c_custkey'), ('c_name'), ('c_acctbal'), ('c_mktsegment')) t(column_name)""")
def gov_visibility(spark, sf):
    return spark.createDataFrame([(c,) for c in engine(spark, sf, "sales").table("customer").columns], "column_name string")


@query("""SELECT o_orderkey, c_name FROM orders LEFT JOIN (SELECT c_custkey, regexp_replace(c_name, '[0-9]', '#', 'g') AS c_name FROM customer WHERE c_mktsegment = 'BUILDING') ON o_custkey = c_custkey WHERE o_orderstatus = 'F'""")
def gov_outer_join(spark, sf):
    # Analyst's rules without its row cap, which is row_cap's subject.
    return engine(spark, sf, "sales").sql("SELECT o_orderkey, c_name FROM orders LEFT JOIN customer ON o_custkey = c_custkey")


# --- Bitemporal logs, deltas, landing ---

_STATES = """
WITH s1 AS (SELECT o_orderkey AS id, o_orderstatus AS status, o_totalprice AS price, o_orderdate AS at FROM orders),
s2 AS (SELECT o_orderkey AS id, CASE WHEN o_orderpriority = '1-URGENT' THEN 'X' ELSE o_orderstatus END AS status, o_totalprice AS price, o_orderdate + INTERVAL 1 MICROSECOND AS at FROM orders WHERE o_orderstatus <> 'P'
  UNION ALL SELECT -1 - o_orderkey, o_orderstatus, o_totalprice, o_orderdate FROM orders WHERE o_orderstatus = 'F'),
s3 AS (SELECT o_orderkey AS id, o_orderstatus AS status, CASE WHEN o_totalprice > 300000 THEN 0 ELSE o_totalprice END AS price, o_orderdate AS at FROM orders WHERE o_orderstatus <> 'F')
"""
_STATE_SCHEMA = "id bigint, status string, price double, at timestamp"
_TIMES = ("2024-01-01 00:00:00", "2024-02-01 00:00:00", "2024-03-01 00:00:00")


def _states(spark, sf) -> list[DataFrame]:
    """Three refreshes of one view over all orders: inserts, updates (some by a microsecond alone), deletes and returns."""
    o = engine(spark, sf).table("orders").withColumn("at", F.col("o_orderdate").cast("timestamp"))
    one = o.selectExpr("o_orderkey AS id", "o_orderstatus AS status", "o_totalprice AS price", "at")
    two = o.where("o_orderstatus <> 'P'").selectExpr("o_orderkey AS id", "CASE WHEN o_orderpriority = '1-URGENT' THEN 'X' ELSE o_orderstatus END AS status", "o_totalprice AS price", "at + INTERVAL '0.000001' SECOND AS at")
    two = two.unionByName(o.where("o_orderstatus = 'F'").selectExpr("-1 - o_orderkey AS id", "o_orderstatus AS status", "o_totalprice AS price", "at"))
    three = o.where("o_orderstatus <> 'F'").selectExpr("o_orderkey AS id", "o_orderstatus AS status", "CASE WHEN o_totalprice > 300000 THEN 0 ELSE o_totalprice END AS price", "at")
    return [one, two, three]


def _delta_log(spark, sf) -> DataFrame:
    log, path = None, f"{_shared(spark).rstrip('/')}/ferrowick/log-{uuid.uuid4().hex}"
    for rows, at in zip(_states(spark, sf), _TIMES, strict=True):
        log = bitemporal.stored_delta(log, rows, ["id"], at, path)
    return log


def _ledger(spark, sf) -> DataFrame:
    states, ledger = _states(spark, sf), None
    for k, new in enumerate(states):
        ledger = delta.append(ledger, delta.row_delta(states[k - 1] if k else new.limit(0), new, ["id"]), k + 1)
    return ledger


@query(_STATES + "SELECT * FROM s2")
def bt_snapshot_asof(spark, sf):
    log = None
    for rows, at in zip(_states(spark, sf), _TIMES, strict=True):
        log = bitemporal.append_snapshot(log, rows, at)
    return bitemporal.snapshot_as_of(log, "2024-02-15 00:00:00")


@query(_STATES + "SELECT * FROM s2")
def bt_delta_asof(spark, sf):
    return bitemporal.delta_as_of(_delta_log(spark, sf), ["id"], "2024-02-15 00:00:00")


@query(_STATES + "SELECT * FROM s3")
def bt_delta_current(spark, sf):
    return bitemporal.current(_delta_log(spark, sf), ["id"])


@query("""SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderdate <= TIMESTAMP '1997-01-01' AND (o_orderstatus = 'O' OR o_orderdate + INTERVAL 90 DAY > TIMESTAMP '1997-01-01')""")
def bt_valid_time(spark, sf):
    df = engine(spark, sf).table("orders").withColumns({"valid_from": F.col("o_orderdate"), "valid_to": F.expr("CASE WHEN o_orderstatus <> 'O' THEN o_orderdate + INTERVAL 90 DAYS END")})
    return bitemporal.valid_at(df, "1997-01-01 00:00:00").select("o_orderkey", "o_orderstatus")


@query(_STATES + "SELECT s2.status, count(*) AS n FROM s2 GROUP BY 1")
def bt_overlay(spark, sf):
    then = bitemporal.delta_as_of(_delta_log(spark, sf), ["id"], "2024-02-15 00:00:00").selectExpr("id AS o_orderkey", "status AS o_orderstatus", "price AS o_totalprice")
    return engine(spark, sf).with_tables(orders=then).sql("SELECT o_orderstatus AS status, count(*) AS n FROM orders GROUP BY 1")


@query(_STATES + """SELECT coalesce(s2.id, s1.id) AS id, CASE WHEN s1.id IS NULL THEN 'insert' WHEN s2.id IS NULL THEN 'delete' ELSE 'update' END AS change_type
FROM s1 FULL JOIN s2 ON s1.id = s2.id WHERE s1.id IS NULL OR s2.id IS NULL OR s1.status IS DISTINCT FROM s2.status OR s1.price IS DISTINCT FROM s2.price OR s1.at IS DISTINCT FROM s2.at""")
def row_delta_diff(spark, sf):
    s1, s2, _ = _states(spark, sf)
    return delta.row_delta(s1, s2, ["id"]).select("id", "change_type")


@query(_STATES + "SELECT * FROM s2")
def ledger_forward(spark, sf):
    return delta.forward(_ledger(spark, sf), ["id"], 2, _STATE_SCHEMA)


@query(_STATES + "SELECT * FROM s1")
def ledger_reverse(spark, sf):
    return delta.reverse(_states(spark, sf)[2], _ledger(spark, sf), ["id"], 1, _STATE_SCHEMA)


@query(_STATES + "SELECT * FROM s3")
def mv_incremental(spark, sf):
    states = _states(spark, sf)
    return delta.apply(states[1], delta.row_delta(states[1], states[2], ["id"]), ["id"], _STATE_SCHEMA)


@query("""SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1 AND event_type <> 'logout'""")
def cdc_latest(spark, sf):
    df = engine(spark, sf).table("events").withColumn("op", F.when(F.col("event_type") == "logout", "delete").otherwise("update"))
    return delta.latest_changes(df, ["user_id"], ["ts", "event_id"]).select("user_id", "event_id", "event_type")


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 10 = 0 THEN 'Z' ELSE o_orderstatus END AS o_orderstatus FROM orders""")
def land_upsert(spark, sf):
    df = engine(spark, sf).table("orders").select("o_orderkey", "o_orderstatus")
    return delta.land(df, df.where("o_orderkey % 10 = 0").withColumn("o_orderstatus", F.lit("Z")), ["o_orderkey"], "upsert")


# --- Rewrites onto materialized views ---


def _shared(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; where it is unset in local mode (tests), one of our own, set for the session."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="ferrowick-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def _store(spark: SparkSession, sf: str, use: str = "views") -> refresh.Store:
    """The store of the views over a folder of tables; a query that runs again refreshes its view."""
    return refresh.Store(spark, f"{_shared(spark)}/{use}/{hashlib.md5(sf.encode()).hexdigest()}")

_BY_SEGMENT = rewrite.AggregateQuery("orders", ("customer",), ("customer__c_mktsegment", "o_orderstatus"), (("n", "count", "*"), ("low", "min", "o_orderkey"), ("keys", "sum", "o_orderkey"), ("total", "count", "o_orderkey")))


@query("""SELECT c_mktsegment AS customer__c_mktsegment, count(*) AS n, max(o_orderkey) AS top FROM orders LEFT JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus = 'F' GROUP BY 1""")
def mv_join_rewrite(spark, sf):
    e = engine(spark, sf)
    view = rewrite.JoinView("orders_customer", "orders", ("customer",))
    catalog = rewrite.Catalog(joins=(view,), stored={view.name: refresh.stored_view(_store(spark, sf), view.name, rewrite.AggregateQuery("orders", ("customer",)).base(e))})
    asked = rewrite.AggregateQuery("orders", ("customer",), ("customer__c_mktsegment",), (("n", "count", "*"), ("top", "max", "o_orderkey")), frozenset({"o_orderstatus = 'F'"}))
    out, used = rewrite.answer(e, asked, catalog)
    assert used == view.name
    return out


@query("""SELECT l_returnflag, p_size AS part__p_size, s_nationkey AS supplier__s_nationkey, count(*) AS n FROM lineitem LEFT JOIN part ON l_partkey = p_partkey LEFT JOIN supplier ON l_suppkey = s_suppkey GROUP BY ALL""")
def mv_join_partial(spark, sf):
    e = engine(spark, sf)
    view = rewrite.JoinView("lines_part", "lineitem", ("part",))
    catalog = rewrite.Catalog(joins=(view,), stored={view.name: refresh.stored_view(_store(spark, sf), view.name, rewrite.AggregateQuery("lineitem", ("part",)).base(e))})
    asked = rewrite.AggregateQuery("lineitem", ("part", "supplier"), ("l_returnflag", "part__p_size", "supplier__s_nationkey"), (("n", "count", "*"),))
    out, used = rewrite.answer(e, asked, catalog)
    assert used == view.name
    return out


@query("""SELECT c_mktsegment AS customer__c_mktsegment, count(*) AS orders, min(o_orderkey) AS first, round(avg(o_orderkey), 4) AS mean FROM orders LEFT JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus <> 'P' GROUP BY 1""")
def mv_agg_rewrite(spark, sf):
    e = engine(spark, sf)
    view = rewrite.AggregateView("by_segment", _BY_SEGMENT)
    catalog = rewrite.Catalog(aggregates=(view,), stored={view.name: refresh.stored_view(_store(spark, sf), view.name, view.fill(e))})
    asked = rewrite.AggregateQuery("orders", ("customer",), ("customer__c_mktsegment",), (("orders", "count", "*"), ("first", "min", "o_orderkey"), ("mean", "avg", "o_orderkey")), frozenset({"o_orderstatus <> 'P'"}))
    out, used = rewrite.answer(e, asked, catalog)
    assert used == view.name
    return out.withColumn("mean", F.round("mean", 4))


# --- Calendars and event time ---


def _by_window(spark, sf, calendar: calendars.Calendar, cadence: str) -> DataFrame:
    windows = calendars.windows(spark, calendar, cadence, date(2024, 1, 1), date(2024, 2, 1))
    return calendars.assign(engine(spark, sf).table("events"), "ts", windows).groupBy("window_id").agg(F.count("*").alias("n"))


@query("""SELECT strftime(ts, '%Y-%m-%d') AS window_id, count(*) AS n FROM events GROUP BY 1""")
def cal_daily(spark, sf):
    return _by_window(spark, sf, calendars.Calendar(), "daily")


@query("""SELECT 'FY' || (year(o_orderdate) + CASE WHEN month(o_orderdate) >= 4 THEN 1 ELSE 0 END) || '-Q' || ((month(o_orderdate) + 8) % 12 // 3 + 1) AS window_id, count(*) AS n FROM orders GROUP BY 1""")
def cal_fiscal_quarter(spark, sf):
    windows = calendars.windows(spark, calendars.Calendar("fiscal", first_month=4), "quarterly", date(1990, 1, 1), date(2002, 1, 1))
    return calendars.assign(engine(spark, sf).table("orders"), "o_orderdate", windows).groupBy("window_id").agg(F.count("*").alias("n"))


@query("""SELECT 'R2024-P' || CASE WHEN d < 28 THEN '01' ELSE '02' END AS window_id, count(*) AS n FROM (SELECT date_diff('day', DATE '2024-01-01', ts::DATE) AS d FROM events) GROUP BY 1""")
def cal_retail_445(spark, sf):
    return _by_window(spark, sf, calendars.Calendar("retail", retail_start=date(2024, 1, 1)), "monthly")


@query("""SELECT CASE WHEN ts < TIMESTAMP '2024-01-17' THEN '2023-12-20' ELSE '2024-01-17' END AS window_id, count(*) AS n FROM events GROUP BY 1""")
def cal_nth_weekday(spark, sf):
    windows = calendars.tiles(spark, calendars.nth_weekdays("3WE", date(2023, 12, 1), date(2024, 3, 1)))
    return calendars.assign(engine(spark, sf).table("events"), "ts", windows).groupBy("window_id").agg(F.count("*").alias("n"))


@query("""SELECT event_type, count(*) AS n FROM events WHERE ts >= TIMESTAMP '2024-01-20 12:00:00' - INTERVAL 24 HOUR AND event_type = 'view' GROUP BY 1""")
def kafka_window(spark, sf):
    now = F.lit("2024-01-20 12:00:00").cast("timestamp")
    return engine(spark, sf).table("events").where(responses.in_window(F.col("ts"), now, "24 HOURS")).where("event_type = 'view'").groupBy("event_type").agg(F.count("*").alias("n"))


@query("""WITH g AS (SELECT *, CASE WHEN ts <= lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 2 HOUR THEN 0 ELSE 1 END AS new FROM events),
r AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS run FROM g),
p AS (SELECT *, epoch_us(ts) - epoch_us(min(ts) OVER (PARTITION BY user_id, run)) AS since FROM r)
SELECT user_id, min(ts) AS first, max(ts) AS last, count(*) AS events FROM p GROUP BY user_id, run, since // 21600000000""")
def debounce_sessions(spark, sf):
    return changes.debounced(engine(spark, sf).table("events"), ["user_id"], "ts", "2 HOURS", "6 HOURS").drop("fires")


@query("""SELECT time_bucket(INTERVAL 6 HOUR, ts) AS window_start, event_type, count(*) AS n FROM events GROUP BY 1, 2""")
def tumbling_events(spark, sf):
    return changes.windowed(engine(spark, sf).table("events"), "ts", "6 hours", ["event_type"], [F.count("*").alias("n")]).drop("window_end")


@query("""SELECT event_id FROM events WHERE event_id > 4000 ORDER BY event_id LIMIT 100""")
def poll_watermark(spark, sf):
    return changes.poll(engine(spark, sf).table("events"), "event_id", 4000, 100)[0].select("event_id")


# --- Graph patterns and algorithms ---

_SUPPLIES = "SELECT DISTINCT l_partkey AS src, l_suppkey AS dst FROM lineitem"


def _supplies(spark, sf) -> DataFrame:
    return engine(spark, sf).table("lineitem").selectExpr("l_partkey AS src", "l_suppkey AS dst").distinct()


def _supplied(spark, sf) -> DataFrame:
    """The whole graph of parts and their suppliers: a part's node is twice its key, a supplier's twice its key and one."""
    return _supplies(spark, sf).selectExpr("2 * src AS src", "2 * dst + 1 AS dst")


def _nations(spark, sf) -> DataFrame:
    """A small graph: nations linked by orders of customers from suppliers."""
    e = engine(spark, sf)
    df = graph.match(e, "o", "orders", (graph.Hop("o", "customer", "c"), graph.Hop("o", "lines", "l"), graph.Hop("l", "supplier", "s")), {"o_orderstatus": {"eq": "P"}})
    return df.where("c_c_nationkey < s_s_nationkey AND l_l_quantity = 50").selectExpr("c_c_nationkey AS src", "s_s_nationkey AS dst").distinct()


_NATIONS = "SELECT DISTINCT c_nationkey AS src, s_nationkey AS dst FROM orders JOIN customer ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN supplier ON s_suppkey = l_suppkey WHERE o_orderstatus = 'P' AND l_quantity = 50 AND c_nationkey < s_nationkey"
_BOTH = f"e AS ({_NATIONS}), b AS (SELECT src, dst FROM e UNION SELECT dst, src FROM e)"


@query("""SELECT n_name, s_name FROM nation JOIN supplier ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA'""")
def cy_match(spark, sf):
    e = engine(spark, sf)
    df = graph.match(e, "s", "supplier", (graph.Hop("s", "home", "n"), graph.Hop("n", "region", "r", {"r_name": {"eq": "ASIA"}})))
    return df.select(F.col("n_n_name").alias("n_name"), F.col("s_s_name").alias("s_name"))


@query("""SELECT c_custkey, o_orderkey FROM customer LEFT JOIN (SELECT * FROM orders WHERE o_totalprice > 400000) ON o_custkey = c_custkey""")
def cy_optional(spark, sf):
    df = graph.match(engine(spark, sf), "c", "customer", (graph.Hop("c", "customer", "o", {"o_totalprice": {"gt": 400000}}, optional=True),))
    return df.select(F.col("c_c_custkey").alias("c_custkey"), F.col("o_o_orderkey").alias("o_orderkey"))


@query(f"""WITH RECURSIVE {_BOTH}, w(start, node, hops) AS (SELECT DISTINCT src, src, 0 FROM b UNION SELECT start, dst, hops + 1 FROM w JOIN b ON node = src WHERE hops < 3)
SELECT start, node, hops FROM w WHERE hops >= 1""")
def cy_varlen(spark, sf):
    both = graph.both_ways(_nations(spark, sf))
    return graph.walks(both, both.select(F.col("src").alias("node")).distinct(), 1, 3)


@query(f"""WITH RECURSIVE {_BOTH}, w(start, node, hops) AS (SELECT DISTINCT src, src, 0 FROM b UNION SELECT start, dst, hops + 1 FROM w JOIN b ON node = src WHERE hops < 4)
SELECT start, node, min(hops) AS hops FROM w GROUP BY start, node""")
def cy_shortest(spark, sf):
    both = graph.both_ways(_nations(spark, sf))
    return graph.shortest_paths(both, both.select(F.col("src").alias("node")).distinct(), 4).drop("path")


@query(f"""WITH RECURSIVE {_BOTH}, w(start, node, hops, path) AS (SELECT DISTINCT src, src, 0, [src] FROM b UNION ALL SELECT start, dst, hops + 1, list_append(path, dst) FROM w JOIN b ON node = src WHERE hops < 3 AND NOT list_contains(path, dst))
SELECT start, node, hops, count(*) AS n FROM w WHERE hops > 0 GROUP BY ALL""")
def cy_all_paths(spark, sf):
    both = graph.both_ways(_nations(spark, sf))
    paths = graph.all_simple_paths(both, both.select(F.col("src").alias("node")).distinct(), 3)
    return paths.groupBy("start", "node", "hops").agg(F.count("*").alias("n"))


@query("""SELECT n_regionkey, string_agg(n_name, '|' ORDER BY n_name) AS names, count(DISTINCT n_name) AS n FROM nation GROUP BY n_regionkey""")
def cy_collect(spark, sf):
    df = graph.pattern_list(engine(spark, sf).table("nation"), ["n_regionkey"], F.col("n_name"))
    return df.select("n_regionkey", F.array_join("items", "|").alias("names"), F.size(F.array_distinct("items")).cast("long").alias("n"))


@query("""SELECT k, count(*) AS n FROM (SELECT unnest(range(1, p_size + 1)) AS k FROM part) GROUP BY k""")
def cy_unwind(spark, sf):
    return engine(spark, sf).table("part").select(F.explode(F.sequence(F.lit(1).cast("long"), F.col("p_size").cast("long"))).alias("k")).groupBy("k").agg(F.count("*").alias("n"))


@query("""SELECT p_partkey, string_split(p_name, ' ')[1] AS head, string_split(p_name, ' ')[-1] AS final, array_to_string(string_split(p_name, ' ')[2:3], ' ') AS middle, reverse(left(p_name, 3)) AS initials, instr(p_type, 'BRASS') > 0 AS brass, (p_size % 7)::INTEGER AS rest FROM part""")
def cy_list_fns(spark, sf):
    words = fn.split_literal(F.col("p_name"), " ")
    return engine(spark, sf).table("part").select(
        "p_partkey", fn.item(words, 0).alias("head"), fn.item(words, -1).alias("final"), F.array_join(fn.slice_list(words, 1, 3), " ").alias("middle"),
        F.reverse(fn.substring0(F.col("p_name"), 0, 3)).alias("initials"), F.contains("p_type", F.lit("BRASS")).alias("brass"), (F.col("p_size") % 7).alias("rest"),
    )


@query("""SELECT o_orderkey, count(l_orderkey) FILTER (l_quantity > 30) AS n_big, bool_or(l_returnflag = 'R') AS returned, sum(l_linenumber)::BIGINT AS total FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_orderstatus = 'P' GROUP BY o_orderkey""")
def cy_pattern_comp(spark, sf):
    e = engine(spark, sf)
    df = graph.match(e, "o", "orders", (graph.Hop("o", "lines", "l"),), {"o_orderstatus": {"eq": "P"}})
    items = graph.pattern_list(df, ["o_o_orderkey"], F.struct("l_l_quantity", "l_l_returnflag", "l_l_linenumber"))
    return items.select(
        F.col("o_o_orderkey").alias("o_orderkey"), F.size(F.filter("items", lambda x: x["l_l_quantity"] > 30)).cast("long").alias("n_big"), fn.any_match(F.col("items"), lambda x: x["l_l_returnflag"] == "R").alias("returned"),
        fn.reduce_list(F.col("items"), F.lit(0).cast("long"), lambda a, x: a + x["l_l_linenumber"]).alias("total"),
    )


@query("""SELECT r_name, n FROM (SELECT r_name, (SELECT count(*) FROM nation WHERE n_regionkey = r_regionkey) AS n FROM region) WHERE n > 0""")
def cy_count_subquery(spark, sf):
    return engine(spark, sf).sql("SELECT r_name, n FROM (SELECT r_name, (SELECT count(*) FROM nation WHERE n_regionkey = r_regionkey) AS n FROM region) WHERE n > 0")


@query(f"""WITH e AS ({_SUPPLIES}), p AS (SELECT 'P' || src AS a, 'S' || dst AS b FROM e)
SELECT node, sum(i)::BIGINT AS in_degree, sum(o)::BIGINT AS out_degree FROM (SELECT a AS node, 0 AS i, 1 AS o FROM p UNION ALL SELECT b, 1, 0 FROM p) GROUP BY node""")
def graph_degree(spark, sf):
    return graph.degrees(_supplies(spark, sf).selectExpr("concat('P', src) AS src", "concat('S', dst) AS dst"))


def _checkpointed(spark: SparkSession) -> None:
    """Iterations cut lineage with checkpoints; a session without a folder for them (tests) gets one."""
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(_shared(spark))


@query()
def graph_pagerank(spark, sf):
    _checkpointed(spark)
    return graph.pagerank(_supplied(spark, sf)).withColumn("rank", F.round("rank", 9))


@query(f"""WITH {_BOTH}, d AS (SELECT src AS node, count(*) AS d FROM b GROUP BY src),
t AS (SELECT x.src AS node, count(*) // 2 AS t FROM b x JOIN b y ON x.dst = y.src JOIN b z ON y.dst = z.src AND z.dst = x.src GROUP BY x.src)
SELECT node, coalesce(t, 0)::BIGINT AS triangles, CASE WHEN d > 1 THEN round(2.0 * coalesce(t, 0) / (d * (d - 1)), 6) ELSE 0 END::DOUBLE AS clustering FROM d LEFT JOIN t USING (node)""")
def graph_clustering(spark, sf):
    _checkpointed(spark)
    return graph.clustering(_nations(spark, sf)).select("node", F.col("triangles").cast("long"), F.round("clustering", 6).alias("clustering"))


@query(f"""WITH RECURSIVE {_BOTH}, w(start, node, hops) AS (SELECT DISTINCT src, src, 0 FROM b UNION SELECT start, dst, hops + 1 FROM w JOIN b ON node = src WHERE hops < 4),
m AS (SELECT start, node, min(hops) AS h FROM w GROUP BY ALL) SELECT start AS node, round(count(*) / sum(h), 6) AS closeness FROM m WHERE h > 0 GROUP BY start""")
def graph_closeness(spark, sf):
    edges = _nations(spark, sf)
    return graph.closeness(edges, graph.nodes_of(edges), 4).withColumn("closeness", F.round("closeness", 6))


@query()
def graph_betweenness(spark, sf):
    _checkpointed(spark)
    edges = _nations(spark, sf)
    return graph.betweenness(edges, graph.nodes_of(edges)).withColumn("betweenness", F.round("betweenness", 6))


@query()
def graph_eigenvector(spark, sf):
    _checkpointed(spark)
    return graph.eigenvector(_supplied(spark, sf)).withColumn("centrality", F.round("centrality", 6))


@query()
def graph_core(spark, sf):
    _checkpointed(spark)
    return graph.core_numbers(_supplied(spark, sf))


@query()
def graph_communities(spark, sf):
    _checkpointed(spark)
    return graph.communities(_supplied(spark, sf))


# --- Data quality, vectors, lineage, responses, table functions ---


@query("""SELECT 'no_price' AS check_name, 'pass' AS outcome, 0.0::DOUBLE AS metric_value, count(*) AS rows_tested FROM orders
UNION ALL SELECT 'repeated', CASE WHEN count(o_custkey) = count(DISTINCT o_custkey) THEN 'pass' ELSE 'fail' END, (count(o_custkey) - count(DISTINCT o_custkey))::DOUBLE, count(*) FROM orders
UNION ALL SELECT 'status', 'fail', count(*) FILTER (o_orderstatus NOT IN ('F', 'O'))::DOUBLE, count(*) FROM orders
UNION ALL SELECT 'mostly_cheap', CASE WHEN count(*) FILTER (o_totalprice <= 300000) >= 0.5 * count(*) THEN 'pass' ELSE 'fail' END, count(*) FILTER (o_totalprice > 300000)::DOUBLE, count(*) FROM orders
UNION ALL SELECT 'rows', 'warn', count(*)::DOUBLE, count(*) FROM orders
UNION ALL SELECT 'priority_length', 'pass', max(length(o_orderpriority))::DOUBLE, count(*) FROM orders""")
def dq_checks(spark, sf):
    contract = {
        "checks": [
            {"name": "no_price", "type": "missing", "column": "o_totalprice"},
            {"name": "repeated", "type": "duplicate", "column": "o_custkey"},
            {"name": "status", "type": "invalid", "column": "o_orderstatus", "values": ["F", "O"]},
            {"name": "mostly_cheap", "type": "invalid", "column": "o_totalprice", "high": 300000, "mostly": 0.5},
            {"name": "rows", "type": "row_count", "must": "< 0", "warn": "> 0"},
            {"name": "priority_length", "type": "max_length", "column": "o_orderpriority", "must": "<= 20"},
        ]
    }
    out = quality.scan(engine(spark, sf).table("orders"), "orders", quality.checks_of(contract))
    return out.select("check_name", "outcome", "metric_value", "rows_tested")


@query("""WITH s AS (SELECT q.vec_id AS query_id, e.vec_id, list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]) AS s FROM embeddings q, embeddings e WHERE q.vec_id % 50 = 0)
SELECT query_id, vec_id, round(s, 6) AS similarity FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY s DESC, vec_id) <= 10""")
def vec_topk(spark, sf):
    """The search's stated queries, every row whose id is divisible by 50, against all rows."""
    df = engine(spark, sf).table("embeddings")
    return vectors.top_k_of_each(df, "embedding", "vec_id", df.where("vec_id % 50 = 0"), 10).withColumn("similarity", F.round("similarity", 6))


@query()
def lineage_edges(spark, sf):
    e = engine(spark, sf)
    df = e.table("orders").join(e.table("customer"), F.expr("o_custkey = c_custkey")).groupBy("c_mktsegment").agg(F.sum("o_totalprice").alias("total"))
    rows = [(out, i, found["transform"]) for out, found in inspect.column_lineage(df).items() for i in found["inputs"]]
    return spark.createDataFrame(rows, "output string, input string, transform string")


@query("""SELECT event_id, 'k' AS key, json_extract_string(props, '$.k') AS value FROM events""")
def json_key_values(spark, sf):
    return responses.key_values(engine(spark, sf).table("events").select("event_id", "props"), "props")


@query("""SELECT user_id, event_id AS id, event_type AS kind, value FROM events""")
def json_flatten(spark, sf):
    items = F.to_json(F.struct(F.struct(F.collect_list(F.struct("event_id", "event_type", "value")).alias("items")).alias("data")))
    df = engine(spark, sf).table("events").groupBy("user_id").agg(items.alias("body"))
    return responses.flatten(df, "body", "data.items", {"id": ("event_id", "bigint"), "kind": ("event_type", "text"), "value": ("value", "double")})


@query("""SELECT event_id, json_extract_string(props, '$.k')::INTEGER AS k FROM events""")
def json_promotion(spark, sf):
    return responses.promoted(engine(spark, sf).table("events"), "props", {"k": ("k", "integer")}).select("event_id", "k")


@query("""SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'insert' WHEN event_id % 3 = 1 THEN 'update' ELSE 'delete' END AS operation, user_id FROM events""")
def debezium_events(spark, sf):
    row = F.struct("event_id", "user_id")
    op = F.expr("CASE event_id % 3 WHEN 0 THEN 'c' WHEN 1 THEN 'u' ELSE 'd' END")
    body = F.struct(op.alias("op"), F.unix_millis(F.col("ts").cast("timestamp")).alias("ts_ms"), F.when(op == "d", row).alias("before"), F.when(op != "d", row).alias("after"))
    df = engine(spark, sf).table("events").select(F.when(F.col("event_id") % 2 == 0, F.to_json(F.struct(body.alias("payload")))).otherwise(F.to_json(body)).alias("value"))
    return changes.debezium(df, "value", "event_id bigint, user_id bigint").select("row.event_id", "operation", "row.user_id")


@query("""SELECT count(*) AS n FROM orders WHERE o_totalprice > 1000""")
def preflight_gate(spark, sf):
    df = engine(spark, sf).table("orders")
    verdict = quality.gate(df, "o_totalprice < 0", "any")
    return df.where(F.lit(verdict == "CONTINUE") & where({"o_totalprice": {"gt": 1000}}, df.schema)).agg(F.count("*").alias("n"))


@query("""SELECT o_orderkey AS id, o_totalprice * 0.01 AS score FROM orders WHERE o_orderstatus = 'P'""")
def table_function(spark, sf):
    """A command over a whole table: batches in and out, its columns held to a contract."""
    given = quality.contracted(engine(spark, sf).table("orders").where("o_orderstatus = 'P'").selectExpr("o_orderkey AS id", "o_totalprice AS price"), {"id": "bigint", "price": "double"})

    def score(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pc.multiply(b.column(1), 0.01)], ["id", "score"])

    return quality.contracted(given.mapInArrow(score, "id long, score double"), {"id": "bigint", "score": "double"})


# --- Stored views, entities with history, vaults, probes ---


@query("""SELECT o_orderstatus, count(*) AS n FROM orders WHERE o_totalprice > 1000 GROUP BY 1""")
def mv_refresh(spark, sf):
    """Created, replaced, and skipped by a refresh with more rows than the view may hold."""
    orders = engine(spark, sf).table("orders")
    by_status = lambda df: df.groupBy("o_orderstatus").agg(F.count("*").alias("n"))
    store = _store(spark, sf, f"refresh-{uuid.uuid4().hex}")
    assert store.refresh("by_status", by_status(orders)) == "CREATED"
    assert store.refresh("by_status", by_status(orders.where("o_totalprice > 1000")), max_rows=10) == "REPLACED"
    assert store.refresh("by_status", orders.selectExpr("o_orderstatus", "o_orderkey AS n"), max_rows=10) == "SKIPPED"
    return store.read("by_status")


@query("""SELECT c_mktsegment, count(*) AS n, max(o_orderkey) AS top FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_mktsegment = 'BUILDING') ON o_custkey = c_custkey WHERE o_orderstatus = 'F' GROUP BY 1""")
def ctas_query(spark, sf):
    """A table from a governed statement, read by another; the role's rules hold in it."""
    e = refresh.create_table(engine(spark, sf, "sales"), _store(spark, sf, f"made-{uuid.uuid4().hex}"), "placed", "SELECT o_orderkey, c_mktsegment FROM orders LEFT JOIN customer ON o_custkey = c_custkey")
    return e.sql("SELECT c_mktsegment, count(*) AS n, max(o_orderkey) AS top FROM placed GROUP BY 1")


@query("""SELECT c_custkey, count(*) AS n FROM customer JOIN orders ON o_custkey = c_custkey WHERE c_mktsegment = 'BUILDING' AND o_orderstatus = 'F' AND o_totalprice > 5000 GROUP BY 1 HAVING count(*) > 1""")
def view_inlining(spark, sf):
    """Views over views, named in any order, under a role's rules."""
    views = {"busy": "SELECT * FROM per_customer WHERE n > 1", "per_customer": "SELECT c_custkey, count(*) AS n FROM customer JOIN large ON o_custkey = c_custkey GROUP BY 1", "large": "SELECT * FROM orders WHERE o_totalprice > 5000"}
    return refresh.with_views(engine(spark, sf, "sales"), views).sql("SELECT * FROM busy")


_SCD2 = """WITH c AS (SELECT user_id, event_type, ts, event_id, row_number() OVER w AS k, lag(event_type) OVER w AS was FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
h AS (SELECT user_id, event_type, ts AS valid_from, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS valid_to FROM c WHERE k = 1 OR event_type IS DISTINCT FROM was) """


@query(_SCD2 + "SELECT * FROM h")
def entity_scd2(spark, sf):
    return history.scd2(engine(spark, sf).table("events"), ["user_id"], ["event_type"], "ts", ["event_id"])


@query(_STATES + "SELECT id, status, price FROM s2")
def entity_snapshot(spark, sf):
    log = None
    for rows, at in zip(_states(spark, sf), _TIMES, strict=True):
        log = history.record(aggregates.Entity(("id",), ("status", "price")), "snapshot", log, rows, at)
    return bitemporal.snapshot_as_of(log, "2024-02-15 00:00:00")


_HASHED = "md5(coalesce(length({0}::VARCHAR) || ':' || {0}::VARCHAR, '-'))"


@query(f"""SELECT {_HASHED.format("o_custkey")} AS hub_key, o_custkey, min(o_orderdate) AS first_seen FROM orders WHERE o_custkey IS NOT NULL GROUP BY o_custkey""")
def vault_hub(spark, sf):
    return history.hub(engine(spark, sf).table("orders"), ["o_custkey"], "o_orderdate")


@query(f"""SELECT md5(length(l_partkey::VARCHAR) || ':' || l_partkey || length(l_suppkey::VARCHAR) || ':' || l_suppkey) AS link_key, {_HASHED.format("l_partkey")} AS part, {_HASHED.format("l_suppkey")} AS supplier, min(l_shipdate) AS first_seen
FROM lineitem WHERE l_partkey IS NOT NULL AND l_suppkey IS NOT NULL GROUP BY l_partkey, l_suppkey""")
def vault_link(spark, sf):
    return history.link(engine(spark, sf).table("lineitem"), {"part": ["l_partkey"], "supplier": ["l_suppkey"]}, "l_shipdate")


@query(_SCD2 + f"""SELECT {_HASHED.format("user_id")} AS hub_key, event_type, {_HASHED.format("event_type")} AS state, valid_from, valid_to FROM h""")
def vault_satellite(spark, sf):
    return history.satellite(engine(spark, sf).table("events"), ["user_id"], ["event_type"], "ts", ["event_id"])


@query("""SELECT 'watermark' AS kind, max(event_id)::VARCHAR AS token FROM events UNION ALL SELECT 'count', count(*)::VARCHAR FROM events""")
def freshness_probes(spark, sf):
    events = engine(spark, sf).table("events")
    tokens = [freshness.probe(events, kind, "event_id").select(F.lit(kind).alias("kind"), "token") for kind in ("watermark", "count")]
    return tokens[0].unionByName(tokens[1])
