"""Stored views, tables from statements, views over views, histories and freshness."""

import datetime

import pytest
from pyspark.sql import functions as F

from ferrowick.demo import engine
from ferrowick.govern import NotAllowed
from ferrowick.model import ModelError
from ferrowick.mv import bitemporal, history, refresh
from ferrowick.operators.aggregates import Entity
from ferrowick.plans.freshness import Copy, Policy, landing, probe, signal_of


def test_refresh(spark, tmp_path):
    store = refresh.Store(spark, f"file://{tmp_path}")
    with pytest.raises(ModelError):
        store.read("v")
    rows = lambda n: spark.range(n).withColumn("s", F.lit(n))
    assert store.refresh("v", rows(3), max_rows=3) == "CREATED"
    before = store.read("v")
    assert store.refresh("v", rows(4), max_rows=3) == "SKIPPED" and store.read("v").count() == 3
    assert store.refresh("v", rows(2)) == "REPLACED"
    assert before.count() == 3 and store.read("v").count() == 2  # readers keep the version that they opened
    assert store.refresh("v", rows(0)) == "REPLACED" and store.read("v").count() == 0
    assert store.versions("v") == [2, 3]
    with pytest.raises(ModelError):
        store.refresh("v", rows(1).withColumnRenamed("s", "t"))
    # A refresh that was lost halfway leaves a folder without a mark; it is neither read nor written into.
    (tmp_path / "v" / "4").mkdir()
    assert store.read("v").count() == 0
    assert store.refresh("v", rows(5)) == "REPLACED" and store.read("v").count() == 5 and store.versions("v") == [3, 5]
    # A view may be filled from what it holds.
    assert store.refresh("v", store.read("v").unionByName(rows(1))) == "REPLACED" and store.read("v").count() == 6


def test_tables_from_statements(spark, sf_dir, tmp_path):
    store = refresh.Store(spark, f"file://{tmp_path}")
    e = engine(spark, sf_dir, "sales")
    made = refresh.create_table(e, store, "names", "SELECT c_custkey, c_name FROM customer")
    assert made.sql("SELECT count(*) AS n FROM names").first()["n"] == e.table("customer").count()
    assert all("#" in r["c_name"] for r in made.sql("SELECT c_name FROM names").collect())
    for name in ("names", "orders"):
        with pytest.raises(ModelError):
            refresh.create_table(e, store, name, "SELECT 1 AS x")
    with pytest.raises(NotAllowed):
        refresh.create_table(engine(spark, sf_dir, "analyst"), store, "all_orders", "SELECT * FROM orders")
    with pytest.raises(NotAllowed):
        refresh.create_table(e, store, "taken", "SELECT * FROM events")
    with pytest.raises(NotAllowed):
        e.sql("SELECT * FROM names")  # an engine without the table


def test_views_over_views(spark, sf_dir):
    e = engine(spark, sf_dir, "analyst")
    both = refresh.with_views(e, {"b": "SELECT * FROM a WHERE o_orderkey > 10", "a": "SELECT o_orderkey FROM orders"})
    assert both.sql("SELECT * FROM b").count() == e.table("orders").where("o_orderkey > 10").count()
    with pytest.raises(ModelError):
        refresh.with_views(e, {"a": "SELECT * FROM b", "b": "SELECT * FROM a"})
    with pytest.raises(NotAllowed):
        refresh.with_views(e, {"a": "SELECT * FROM events"})


def test_scd2(spark):
    rows = [(1, "a", 1, 1), (1, "a", 2, 2), (1, "b", 3, 3), (1, None, 3, 4), (1, None, 5, 5), (1, "a", 6, 6), (2, None, 1, 7), (None, "x", 1, 8), (None, "x", 2, 9)]
    df = spark.createDataFrame(rows, "k int, s string, at int, seq int")
    got = {tuple(r) for r in history.scd2(df, ["k"], ["s"], "at", ["seq"]).collect()}
    assert got == {(1, "a", 1, 3), (1, "b", 3, 3), (1, None, 3, 6), (1, "a", 6, None), (2, None, 1, None), (None, "x", 1, None)}
    assert history.scd2(df.limit(0), ["k"], ["s"], "at").count() == 0


def test_hashes_and_hubs(spark):
    df = spark.createDataFrame([("a", "bc", 2), ("ab", "c", 1), ("a", "bc", 1), (None, "c", 1), (None, None, 1), ("-", None, 1)], "x string, y string, at int")
    got = history.hub(df, ["x", "y"], "at").collect()
    assert len(got) == len({r["hub_key"] for r in got}) == 4
    assert {(r["x"], r["y"]): r["first_seen"] for r in got}["a", "bc"] == 1
    ends = history.link(df, {"left": ["x"], "right": ["y"]}, "at")
    assert ends.count() == 2 and ends.select("left").join(history.hub(df, ["x"], "at").withColumnRenamed("hub_key", "left"), "left", "left_anti").isEmpty()


def test_entity_histories(spark):
    states = [spark.createDataFrame(r, "id int, s string, extra int") for r in ([(1, "a", 0), (2, "b", 0)], [(1, "c", 0), (3, "d", 0)])]
    entity, times = Entity(("id",), ("s",)), ("2024-01-01 00:00:00", "2024-01-02 00:00:00")
    logs = {}
    for kind in ("none", "snapshot", "scd2"):
        for rows, at in zip(states, times, strict=True):
            logs[kind] = history.record(entity, kind, logs.get(kind), rows, at)
    now = {(1, "c"), (3, "d")}
    assert {tuple(r) for r in logs["none"].collect()} == now
    assert {tuple(r) for r in bitemporal.snapshot_as_of(logs["snapshot"], times[0]).collect()} == {(1, "a"), (2, "b")}
    assert {tuple(r) for r in bitemporal.current(logs["scd2"], ["id"]).collect()} == now
    with pytest.raises(ValueError):
        history.record(entity, "other", None, states[0], times[0])


def test_freshness(spark):
    now, hour = datetime.datetime(2024, 1, 2, 12), datetime.timedelta(hours=1)
    old, new = now - 2 * hour, now - hour / 2
    ttl, token, both = Policy(ttl=hour), Policy(probe=True), Policy(ttl=hour, probe=True)
    assert [ttl.state(Copy("c", at), now) for at in (None, old, now - hour, new)] == ["STALE", "STALE", "STALE", "FRESH"]
    assert all(p.state(Copy("c", new, ok=False), now) == "FAILED" for p in (ttl, token, both))
    assert [token.state(Copy("c", old, True, a, b), now) for a, b in ((None, None), (None, "x"), ("x", "x"), ("x", "y"))] == ["FAILED", "STALE", "FRESH", "STALE"]
    assert [both.state(Copy("c", at, True, a, b), now) for at, a, b in ((new, "x", "y"), (old, "x", "x"), (old, "x", None))] == ["FRESH", "FRESH", "STALE"]
    base = Copy("base", old)
    middle = Copy("middle", new, inputs=[base])
    top = Copy("top", new, inputs=[middle])
    assert Policy(ttl=hour).state(top, now) == "FRESH" and Policy(ttl=hour, transitive=True).state(top, now) == "STALE"
    base.refreshed, base.inputs = new, [top]
    assert Policy(ttl=hour, transitive=True).state(top, now) == "FRESH"
    base.ok = False
    assert Policy(ttl=hour, transitive=True).state(top, now) == "FAILED"
    assert [signal_of(*x) for x in ((None, None), (None, "kafka"), ("probe", "kafka"))] == ["ttl", "kafka", "probe"]
    assert [landing(*x) for x in (("kafka", "at"), ("ttl", "at"), ("ttl", None), ("signal", None))] == ["cdc", "append", "replace", "replace"]
    with pytest.raises(ModelError):
        signal_of("sometimes", None)
    df = spark.range(4)
    assert [probe(df, k, "id").first()["token"] for k in ("watermark", "count", "none")] == ["3", "4", None]
    assert probe(df, "hash").first() == probe(df.orderBy(F.desc("id")), "hash").first() != probe(spark.range(3), "hash").first()
