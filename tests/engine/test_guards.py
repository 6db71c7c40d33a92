"""Statements that a role may run, exact deltas, polls, limits, order, vector search."""

import sqlite3
from dataclasses import replace
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from ferrowick.demo import engine
from ferrowick.govern import NotAllowed
from ferrowick.model import Role
from ferrowick.mv import delta
from ferrowick.operators.vectors import top_k_of_each
from ferrowick.sources.files import affinity, read_sqlite
from ferrowick.streaming import changes


@pytest.mark.parametrize(
    "statement",
    [
        "SELECT count(*) FROM parquet.`{sf}/customer.parquet`",
        "SELECT * FROM other_view",
        "SELECT * FROM (WITH other_view AS (SELECT 1 AS x) SELECT * FROM other_view) JOIN other_view",
        "SELECT (SELECT max(id) FROM other_view) FROM customer",
        "SELECT * FROM customer WHERE c_custkey IN (SELECT id FROM other_view)",
        "SELECT * FROM events",
        "CREATE OR REPLACE TEMPORARY VIEW mine AS SELECT * FROM customer",
        "INSERT INTO customer SELECT * FROM customer",
        "DROP VIEW other_view",
        "SHOW TABLES",
    ],
)
def test_other_relations_and_statements_are_refused(spark, sf_dir, statement):
    spark.range(3).createOrReplaceTempView("other_view")
    e = engine(spark, sf_dir, "sales")
    if "events" in statement and (e.model.role("sales").domains is None or e.model.table("events").domain in e.model.role("sales").domains):
        pytest.skip("the role may read it")
    with pytest.raises(NotAllowed):
        e.sql(statement.format(sf=sf_dir))


def test_own_expressions_are_allowed(spark, sf_dir):
    e = engine(spark, sf_dir, "sales")
    want = e.table("customer").count()
    assert e.sql("WITH a AS (SELECT * FROM customer), b AS (SELECT * FROM a) SELECT count(*) AS n FROM b").first()["n"] == want
    assert e.sql("SELECT count(*) AS n FROM customer c WHERE EXISTS (SELECT 1 FROM nation) AND c_custkey IN (SELECT c_custkey FROM customer)").first()["n"] == want


def test_complexity_limits(spark, sf_dir):
    e = engine(spark, sf_dir)
    e = replace(e, model=replace(e.model, roles={**e.model.roles, "narrow": Role("narrow", max_depth=1, max_fields=2)}), role="narrow")
    assert e.select("orders", ["o_orderkey"]).count()
    for fields in (["o_orderkey", {"customer": ["c_name"]}], ["o_orderkey", "o_custkey", "o_orderstatus"]):
        with pytest.raises(NotAllowed):
            e.select("orders", fields)


AT = datetime(2024, 1, 1, 12, 0, 0, 123)
SCHEMA = "id bigint, at timestamp, v double"


def test_deltas_keep_microseconds_and_null_keys(spark):
    old = spark.createDataFrame([(1, AT, 1.5), (None, AT, None), (3, AT, 0.1)], SCHEMA)
    new = spark.createDataFrame([(1, AT + timedelta(microseconds=543), 1.5), (None, AT, 2.0), (4, None, 0.1)], SCHEMA)
    change = delta.row_delta(old, new, ["id"])
    assert sorted((r["id"] or 0, r["change_type"]) for r in change.collect()) == [(0, "update"), (1, "update"), (3, "delete"), (4, "insert")]
    rows = lambda df: sorted(map(tuple, df.collect()), key=repr)
    assert rows(delta.apply(old, change, ["id"], SCHEMA)) == rows(new)
    ledger = delta.append(delta.append(None, delta.row_delta(old.limit(0), old, ["id"]), 1), change, 2)
    assert rows(delta.forward(ledger, ["id"], 2, SCHEMA)) == rows(new)
    assert rows(delta.reverse(new, ledger, ["id"], 1, SCHEMA)) == rows(old)
    assert rows(delta.land(old, new, ["id"], "upsert")) == rows(new.unionByName(old.where("id = 3")))


def test_polls_lose_no_ties(spark):
    df, last, seen = spark.createDataFrame([(k, k // 3) for k in range(10)], "id int, mark int"), None, []
    for _ in range(10):
        rows, last = changes.poll(df, "mark", last, 2)
        seen += [r["id"] for r in rows.collect()]
    assert sorted(seen) == list(range(10))


def test_nested_selections_keep_the_order(spark, sf_dir):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = engine(spark, sf_dir).select("orders", ["o_totalprice", {"customer": ["c_name"]}], order=[("o_totalprice", "desc")], limit=30).collect()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    prices = [r["o_totalprice"] for r in rows]
    assert len(prices) == 30 and prices == sorted(prices, reverse=True)


def test_top_k_of_each_matches_numpy(spark, monkeypatch):
    from ferrowick.operators import vectors

    monkeypatch.setattr(vectors, "ROW_BLOCK", 20)
    monkeypatch.setattr(vectors, "QUERY_BLOCK", 3)
    rng = np.random.default_rng(1)
    x = rng.integers(-2, 3, (150, 4)).astype(float)
    x[7] = 0
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)] + [(500, None)], "k int, v array<double>")
    got = {}
    for r in top_k_of_each(df, "v", "k", df.where("k % 10 = 0"), 5).collect():
        got.setdefault(r["query_id"], []).append(round(r["similarity"], 9))
    for k in range(0, 150, 10):
        if not x[k].any():
            assert k not in got
            continue
        sims = sorted((round(float(x[k] @ y / np.linalg.norm(x[k]) / np.linalg.norm(y)), 9) for y in x if y.any()), reverse=True)[:5]
        np.testing.assert_allclose(sorted(got[k], reverse=True), sims)


def test_sqlite_types(spark, tmp_path):
    assert [affinity(x).simpleString() for x in ("BIGINT", "smallint", "BOOLEAN", "VARCHAR(3)", "DATE", "NUMERIC(5,2)", "REAL", "BLOB", "")] == ["bigint", "bigint", "bigint", "string", "string", "double", "double", "binary", "string"]
    with sqlite3.connect(path := f"{tmp_path}/a.db") as db:
        db.execute("CREATE TABLE t (id BIGINT, price NUMERIC, ok BOOLEAN, name TEXT)")
        db.executemany("INSERT INTO t VALUES (?, ?, ?, ?)", [(k, k + 0.5, k % 2, f"n{k}") for k in range(20)])
    rows = read_sqlite(spark, path, "t", 3).orderBy("id").select(F.col("id"), "price", "ok", "name").collect()
    assert [tuple(r) for r in rows] == [(k, k + 0.5, k % 2, f"n{k}") for k in range(20)]
