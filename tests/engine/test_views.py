import datetime

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ferrowick.demo import engine
from ferrowick.mv import bitemporal, delta, rewrite
from ferrowick.operators import graph
from ferrowick.plans import calendars, inspect, quality
from ferrowick.sources import files, responses
from ferrowick.streaming import changes

SCHEMA = "id int, region string, amount int"


def states(spark):
    rows = [[(1, "a", 10), (2, "b", 20)], [(1, "a", 11), (2, "b", 20), (3, None, 30)], [(1, "a", 11), (3, None, 30)], [(1, "a", 11), (2, "b", 99), (3, None, 30)]]
    return [spark.createDataFrame(r, SCHEMA) for r in rows], rows


def test_log_and_ledger_give_every_state(spark):
    frames, rows = states(spark)
    log = ledger = None
    for k, df in enumerate(frames):
        log = bitemporal.append_delta(log, df, ["id"], f"2024-0{k + 1}-01 00:00:00")
        ledger = delta.append(ledger, delta.row_delta(frames[k - 1] if k else df.limit(0), df, ["id"]), k + 1)
    as_set = lambda df: sorted(map(tuple, df.select("id", "region", "amount").collect()))
    for k, own in enumerate(rows):
        assert as_set(bitemporal.delta_as_of(log, ["id"], f"2024-0{k + 1}-15 00:00:00")) == sorted(own)
        assert as_set(delta.forward(ledger, ["id"], k + 1, SCHEMA)) == as_set(delta.reverse(frames[-1], ledger, ["id"], k + 1, SCHEMA)) == sorted(own)
    assert log.where("sys_op = 'delete'").select("region", "amount").first() == (None, None)
    assert bitemporal.delta_as_of(log, ["id"], "2023-01-01 00:00:00").isEmpty()


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 6), st.sampled_from(["x", "y", None])), unique_by=lambda r: r[0]), st.lists(st.tuples(st.integers(0, 6), st.sampled_from(["x", "y", None])), unique_by=lambda r: r[0]))
def test_a_delta_turns_one_state_into_the_other(spark, old, new):
    a, b = (spark.createDataFrame(r, "id int, v string") for r in (old, new))
    assert sorted(map(tuple, delta.apply(a, delta.row_delta(a, b, ["id"]), ["id"], "id int, v string").collect())) == sorted(new)


def test_content_hash_ignores_order(spark):
    df = spark.range(50).withColumn("v", F.col("id") % 7)
    assert delta.content_hash(df) == delta.content_hash(df.orderBy(F.desc("id"))) != delta.content_hash(df.where("id > 0"))


def test_views_are_left_alone_under_rules(spark, sf_dir):
    view = rewrite.JoinView("v", "orders", ("customer",))
    catalog = rewrite.Catalog(joins=(view,), stored={"v": rewrite.AggregateQuery("orders", ("customer",)).base(engine(spark, sf_dir))})
    asked = rewrite.AggregateQuery("orders", ("customer",), ("customer__c_mktsegment",), (("n", "count", "*"),))
    assert rewrite.answer(engine(spark, sf_dir, "sales"), asked, catalog)[1] is None
    own = rewrite.AggregateView("a", asked)
    catalog = rewrite.Catalog(aggregates=(own,), stored={"a": own.fill(engine(spark, sf_dir))})
    narrower = rewrite.AggregateQuery("orders", ("customer",), (), (("n", "count", "*"),), frozenset({"o_orderstatus = 'F'"}))
    assert rewrite.answer(engine(spark, sf_dir), narrower, catalog)[1] is None


def test_inspection(spark, sf_dir):
    e = engine(spark, sf_dir)
    assert inspect.tables_of(spark, "WITH x AS (SELECT * FROM a) SELECT * FROM x JOIN b ON EXISTS (SELECT 1 FROM c)") == {"a", "b", "c"}
    assert inspect.dependencies(spark, {"v1": "SELECT * FROM t", "v2": "SELECT * FROM v1", "v3": "SELECT * FROM v4", "v4": "SELECT * FROM v3"}) == (["v1", "v2"], ["v3", "v4"])
    df = e.table("orders")
    assert inspect.nondeterminism(df.limit(3)) == ["limit without order"] and not inspect.nondeterminism(df.orderBy("o_orderkey").limit(3))
    assert inspect.nondeterminism(df.withColumn("r", F.rand(1)))
    found = inspect.column_lineage(df.selectExpr("o_totalprice * 2 AS twice", "1 AS one", "o_orderkey"))
    assert found["twice"] == {"inputs": ["orders.o_totalprice"], "transform": "function"} and found["one"]["transform"] == "constant" and found["o_orderkey"]["transform"] == "identity"
    assert inspect.downstream([("a", "b"), ("b", "c"), ("x", "y")], "a") == {"b", "c"}
    assert inspect.definition_version("SELECT  1", {"a": "1"}) == inspect.definition_version("SELECT 1", {"a": "1"}) != inspect.definition_version("SELECT 1", {"a": "2"})


def test_calendars():
    d = datetime.date
    c = calendars.Calendar("gregorian", "America/New_York")
    assert calendars.instant(d(2024, 3, 11), c.zone) - calendars.instant(d(2024, 3, 10), c.zone) == datetime.timedelta(hours=23)
    fiscal = calendars.boundaries(calendars.Calendar("fiscal", first_month=10), "quarterly", d(2024, 1, 5), d(2024, 4, 1))
    assert fiscal == [("FY2024-Q2", d(2024, 1, 1), d(2024, 4, 1)), ("FY2024-Q3", d(2024, 4, 1), d(2024, 7, 1))]
    retail = calendars.boundaries(calendars.Calendar("retail", retail_start=d(2024, 2, 4)), "quarterly", d(2024, 2, 4), d(2025, 1, 1))
    assert [(b - a).days for _, a, b in retail] == [91] * 4
    assert calendars.nth_weekdays("LFR", d(2024, 1, 1), d(2024, 2, 29)) == [d(2024, 1, 26), d(2024, 2, 23)]
    assert calendars.recurrences("FREQ=MONTHLY;BYMONTHDAY=15", d(2024, 1, 1), d(2024, 2, 20)) == [d(2024, 1, 15), d(2024, 2, 15)]
    with pytest.raises(ValueError):
        calendars.recurrences("FREQ=DAILY;COUNT=3", d(2024, 1, 1), d(2024, 2, 1))


def test_quality_and_contracts(spark):
    df = spark.createDataFrame([(1, "a"), (2, None), (2, "zz")], "id int, s string")
    empty = quality.scan(df.limit(0), "t", [quality.Check("m", "max", "id")]).first()
    assert empty["outcome"] == "error" and empty["rows_tested"] == 0
    got = {r["check_name"]: r for r in quality.scan(df, "t", [quality.Check("null", "missing", "s", ("<=", 40), percent=True), quality.Check("dup", "duplicate", "id")]).collect()}
    assert got["null"]["outcome"] == "pass" and got["dup"]["failed_rows"] == 1 and got["dup"]["outcome"] == "fail"
    assert quality.gate(df, "id > 1", "any") == "ABORT" and quality.gate(df, "id > 0", "all") == "CONTINUE" and quality.gate(df, "s > ''", "all") == "ABORT"
    with pytest.raises(TypeError):
        quality.contracted(df, {"id": "boolean"})


def test_responses(spark):
    body = '{"results":[{"data":[{"graph":{"nodes":[{"id":"1","labels":["A"],"properties":{"n":"x"}}],"relationships":[{"id":"9","type":"R","startNode":"1","endNode":"2"}]}}]}]}'
    df = spark.createDataFrame([(body,)], "body string")
    assert [tuple(r) for r in responses.graph_nodes(df, "body", ["n"]).collect()] == [("1", ["A"], "x")]
    assert [tuple(r) for r in responses.graph_relationships(df, "body").collect()] == [("9", "R", "1", "2")]
    table = spark.createDataFrame([('{"data":{"fields":["a","b"],"values":[[1,"x"],[2,null]]}}',)], "body string")
    assert [tuple(r) for r in responses.tabular(table, "body", ["b", "a"]).collect()] == [("x", "1"), (None, "2")]
    sparql = spark.createDataFrame([('{"results":{"bindings":[{"s":{"type":"uri","value":"u"}},{}]}}',)], "body string")
    assert [r["s"] for r in responses.bindings(sparql, "body", ["s"]).collect()] == ["u", None]
    one = spark.createDataFrame([('{"d":{"id":"7","t":"x"}}',)], "body string")
    assert [tuple(r) for r in responses.flatten(one, "body", "d", {"id": ("id", "integer"), "t": ("t", "integer")}).collect()] == [(7, None)]
    assert responses.avro_columns({"fields": [{"name": "a", "type": ["null", "long"]}, {"name": "b", "type": {"type": "int", "logicalType": "date"}}, {"name": "c", "type": {"type": "map"}}]}) == {"a": "bigint", "b": "date", "c": "json"}


def test_files(spark, tmp_path):
    import sqlite3

    (tmp_path / "OrderLines.csv").write_text("orderId,Unit Price\n1,2.5\n2,3.5\n")
    (tmp_path / "notes.txt").write_text("x")
    spark.range(3).write.parquet(str(tmp_path / "numbers.parquet"))
    found = files.crawl(spark, str(tmp_path))
    assert found.keys() == {"order_lines", "numbers"}
    assert [tuple(r) for r in files.read_file(spark, found["order_lines"]).collect()] == [(1, 2.5), (2, 3.5)]
    with sqlite3.connect(tmp_path / "db.sqlite") as db:
        db.execute("CREATE TABLE t (id INTEGER, name TEXT, price REAL)")
        db.executemany("INSERT INTO t VALUES (?, ?, ?)", [(k, f"n{k}", k / 2) for k in range(100)])
    assert files.sqlite_tables(str(tmp_path / "db.sqlite")) == ["t"]
    df = files.read_sqlite(spark, str(tmp_path / "db.sqlite"), "t", 4)
    assert df.count() == 100 and df.agg(F.sum("price")).first()[0] == sum(range(100)) / 2
    nested = spark.sql("SELECT 1 AS a, named_struct('x', 2, 'y', array(1, 2)) AS s")
    files.write_result(nested, str(tmp_path / "out"), "csv")
    assert spark.read.csv(str(tmp_path / "out"), header=True).columns == ["a", "s.x", "s.y"]
    assert files.deliver(spark.range(5), str(tmp_path / "o1"), 5)[0] == "inline" and files.deliver(spark.range(6), str(tmp_path / "o2"), 5)[0] == "redirect"
    rolled = spark.range(6).selectExpr("id", "rand() AS x", "named_struct('a', id) AS s")
    kind, rows = files.deliver(rolled, str(tmp_path / "o3"), 6, "csv")
    assert kind == "inline" and rows.collect() == rows.collect() and rows.columns == rolled.columns
    assert files.deliver(rolled, str(tmp_path / "o4"), 5, "csv")[0] == "redirect" and spark.read.csv(str(tmp_path / "o4"), header=True).count() == 6
    assert spark.read.parquet(str(tmp_path / "o2")).count() == 6


def test_streams_land_changes_by_key(spark, tmp_path):
    rows = lambda r: spark.createDataFrame(r, "id int, v string, seq int, op string").coalesce(1).write.mode("append").json(str(tmp_path / "in"))
    state = lambda n: sorted(tuple(r)[:2] for r in changes.read_version(spark, str(tmp_path / "out"), n).collect())
    rows([(1, "a", 1, "insert"), (2, "b", 2, "insert"), (1, "c", 3, "update")])
    source = spark.readStream.schema("id int, v string, seq int, op string").json(str(tmp_path / "in"))
    changes.land_changes(source, ["id"], ["seq"], str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert state(0) == [(1, "c"), (2, "b")]
    rows([(2, None, 4, "delete"), (3, "d", 5, "insert"), (1, "e", 6, "update")])
    changes.land_changes(source, ["id"], ["seq"], str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert state(1) == [(1, "e"), (3, "d")]


def test_stream_windows(spark, tmp_path):
    at = lambda m: datetime.datetime(2024, 1, 1, 0, m)
    spark.createDataFrame([(at(1), "a"), (at(4), "a"), (at(11), "b"), (at(50), "a")], "ts timestamp, k string").write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema("ts timestamp, k string").parquet(str(tmp_path / "in"))
    out = changes.windowed(source, "ts", "10 minutes", ["k"], [F.count("*").alias("n")], lateness="5 minutes")
    out.writeStream.format("memory").queryName("windows_out").outputMode("complete").trigger(availableNow=True).start().awaitTermination()
    assert sorted((r["window_start"].minute, r["k"], r["n"]) for r in spark.table("windows_out").collect()) == [(0, "a", 2), (10, "b", 1), (50, "a", 1)]
    last = changes.poll_replaced(spark.range(3).toDF("id"), None)[1]
    assert changes.poll_replaced(spark.range(3).toDF("id"), last)[0] is False


def test_graph_algorithms_on_known_graphs(spark, tmp_path):
    spark.sparkContext.setCheckpointDir(str(tmp_path))
    path = spark.createDataFrame([(1, 2), (2, 3), (3, 4)], "src int, dst int")
    star = spark.createDataFrame([(0, k) for k in range(1, 5)] + [(1, 2)], "src int, dst int")
    by = lambda df, c: {r["node"]: round(r[c], 4) for r in df.collect()}
    assert by(graph.betweenness(path, graph.nodes_of(path), 4), "betweenness") == {1: 0, 2: 2, 3: 2, 4: 0}
    assert by(graph.clustering(star), "clustering") == {0: round(1 / 6, 4), 1: 1.0, 2: 1.0, 3: 0.0, 4: 0.0}
    assert by(graph.core_numbers(star, 5), "core") == {0: 2, 1: 2, 2: 2, 3: 1, 4: 1}
    assert by(graph.closeness(path, graph.nodes_of(path), 5), "closeness")[1] == 0.5
    ranks = by(graph.pagerank(star.selectExpr("dst AS src", "src AS dst"), 15), "rank")
    assert abs(sum(ranks.values()) - 1) < 1e-3 and max(ranks, key=ranks.get) == 0
    two = spark.createDataFrame([(1, 2), (2, 3), (1, 3), (11, 12), (12, 13), (11, 13)], "src int, dst int")
    assert by(graph.communities(two, 6), "community") == {1: 1, 2: 1, 3: 1, 11: 11, 12: 11, 13: 11}
    assert {r["node"]: r["hops"] for r in graph.shortest_paths(path, spark.createDataFrame([(1,)], "node int"), 3).collect()} == {1: 0, 2: 1, 3: 2, 4: 3}
    eigen = by(graph.eigenvector(star), "centrality")
    assert max(eigen, key=eigen.get) == 0
