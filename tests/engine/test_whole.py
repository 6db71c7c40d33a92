"""Queries give whole results on tables that pass the bounds of a role or a loop."""

import random

from ferrowick import queries
from ferrowick.demo import MODEL
from ferrowick.mv import bitemporal
from ferrowick.operators import graph

from .test_queries import db, norm  # noqa: F401


def test_outer_join_gives_more_rows_than_the_cap(spark, tmp_path, sf_dir, db):  # noqa: F811
    cap = MODEL.role("analyst").row_cap
    orders = spark.range(cap + 500).selectExpr("id AS o_orderkey", "id % 100 AS o_custkey", "'F' AS o_orderstatus", "1.0D AS o_totalprice", "TIMESTAMP '1995-01-01' AS o_orderdate", "'1-URGENT' AS o_orderpriority")
    orders.write.parquet(f"{tmp_path}/orders.parquet")
    for path in ("region", "nation", "customer", "supplier", "part", "lineitem"):
        (tmp_path / f"{path}.parquet").symlink_to(f"{sf_dir}/{path}.parquet")
    sql = queries.ORACLE_SQL["gov_outer_join"].replace("FROM orders", f"FROM '{tmp_path}/orders.parquet/*.parquet'")
    got = sorted(([norm(x) for x in r] for r in queries.gov_outer_join(spark, str(tmp_path)).collect()), key=repr)
    want = sorted(([norm(x) for x in r] for r in db.execute(sql).fetchall()), key=repr)
    assert len(got) == cap + 500
    assert got == want


def brute_cores(links):
    """By node: the largest k at which peeling nodes of fewer than k neighbours leaves it."""
    out, near, k = {}, {}, 0
    for a, b in links:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    while near:
        weak = [n for n in near if len(near[n]) <= k]
        for n in weak:
            out[n] = k
            for m in near.pop(n):
                near.get(m, set()).discard(n)
        k += not weak
    return out


def test_cores_above_ten(spark, tmp_path):
    spark.sparkContext.setCheckpointDir(str(tmp_path / "checkpoints"))
    rng = random.Random(4)
    links = {(a, b) for a in range(16) for b in range(a)}  # a core of 15
    links |= {(100 + a, 100 + b) for a in range(30) for b in range(a) if rng.random() < 0.6}
    links |= {(rng.randrange(16), 200 + k) for k in range(20)} | {(220 + k, 221 + k) for k in range(5)} | {(300, k) for k in range(301, 306)}
    want = brute_cores(links)
    edges = spark.createDataFrame(sorted(links), "src int, dst int")
    for cap in (None, 12):
        got = graph.core_numbers(edges, *[cap] * (cap is not None)).collect()
        assert len(got) == len(want)
        assert {r["node"]: r["core"] for r in got} == {n: min(c, cap or c) for n, c in want.items()}
    assert max(want.values()) == 15 and want[300] == 1
    assert graph.core_numbers(edges.limit(0)).count() == 0


def test_graph_core_has_no_bound(spark, tmp_path, monkeypatch):
    spark.sparkContext.setCheckpointDir(str(tmp_path / "checkpoints"))
    links = [(a, b) for a in range(13) for b in range(a)]
    monkeypatch.setattr(queries, "_supplied", lambda *_: spark.createDataFrame(links, "src int, dst int"))
    assert {r["node"]: r["core"] for r in queries.graph_core(spark, str(tmp_path)).collect()} == brute_cores(links)


def test_measures_of_the_whole_part_supplier_graph(spark, tmp_path, sf_dir, db):  # noqa: F811
    spark.sparkContext.setCheckpointDir(str(tmp_path / "checkpoints"))
    links = db.execute("SELECT DISTINCT 2 * l_partkey, 2 * l_suppkey + 1 FROM lineitem").fetchall()
    nodes = {n for link in links for n in link}
    near = {n: [] for n in nodes}
    for a, b in links:
        near[a].append(b)
        near[b].append(a)
    got = {name: {r["node"]: r[1] for r in getattr(queries, name)(spark, sf_dir).collect()} for name in ("graph_pagerank", "graph_eigenvector", "graph_core", "graph_communities")}
    assert all(set(x) == nodes for x in got.values())
    assert got["graph_core"] == brute_cores(links)
    out, rank, value, label = {a: [b for x, b in links if x == a] for a, _ in links}, dict.fromkeys(nodes, 1 / len(nodes)), dict.fromkeys(nodes, 1.0), {n: n for n in nodes}
    for _ in range(20):
        given = dict.fromkeys(nodes, 0.0)
        for a, to in out.items():
            for b in to:
                given[b] += rank[a] / len(to)
        lost = 1 - sum(given.values())
        rank = {n: 0.15 / len(nodes) + 0.85 * (given[n] + lost / len(nodes)) for n in nodes}
    for _ in range(30):
        value = {n: value[n] + sum(value[m] for m in near[n]) for n in nodes}
        length = sum(v * v for v in value.values()) ** 0.5
        value = {n: v / length for n, v in value.items()}
    for _ in range(10):
        votes = {n: {label[n]: 1} for n in nodes}
        for n in nodes:
            for m in near[n]:
                votes[n][label[m]] = votes[n].get(label[m], 0) + 2
        label = {n: max(v, key=lambda c: (v[c], -c)) for n, v in votes.items()}
    assert got["graph_communities"] == label
    assert all(abs(got["graph_pagerank"][n] - rank[n]) < 1e-8 and abs(got["graph_eigenvector"][n] - value[n]) < 2e-6 for n in nodes)


def test_betweenness_of_a_long_path(spark, tmp_path, monkeypatch):
    spark.sparkContext.setCheckpointDir(str(tmp_path / "checkpoints"))
    monkeypatch.setattr(queries, "_nations", lambda *_: spark.createDataFrame([(k, k + 1) for k in range(7)], "src int, dst int"))
    assert {r["node"]: r["betweenness"] for r in queries.graph_betweenness(spark, str(tmp_path)).collect()} == {k: k * (7 - k) for k in range(8)}


def shuffled(spark, run) -> int:
    """Bytes that all tasks write to shuffles in a run, without broadcast joins."""

    def total():
        sc = spark.sparkContext._jsc.sc()
        sc.listenerBus().waitUntilEmpty(30_000)
        found = sc.statusStore().executorList(False)
        return sum(found.apply(k).totalShuffleWrite() for k in range(found.size()))

    before, threshold = total(), spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        run().collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    return total() - before


def dense(spark, more=()):
    return spark.createDataFrame([(7919 * a, 7907 * b + 1) for a in range(400) for b in range(50)] + list(more), "src long, dst long")


def test_sums_over_edges_deal_out_no_edges_in_a_round(spark, tmp_path):
    spark.sparkContext.setCheckpointDir(str(tmp_path / "checkpoints"))
    edges = dense(spark)
    for run in (graph.eigenvector, graph.pagerank):
        few, many = (shuffled(spark, lambda n=n: run(edges, rounds=n)) for n in (2, 7))
        assert (many - few) / 5 < 60_000, run  # 40,000 directed edges


def test_cores_deal_out_edges_once(spark, tmp_path):
    spark.sparkContext.setCheckpointDir(str(tmp_path / "checkpoints"))
    path = [(-k, -k - 1) for k in range(1, 24)]  # peeled from its ends in twelve rounds
    few, many = (shuffled(spark, lambda more=more: graph.core_numbers(dense(spark, more))) for more in (path[:1], path))
    assert many - few < 400_000


def test_communities_give_a_task_no_more_rows_on_a_larger_graph(spark, tmp_path, monkeypatch):
    spark.sparkContext.setCheckpointDir(str(tmp_path / "checkpoints"))
    monkeypatch.setattr("ferrowick.operators.scratch.TASK_ROWS", 1000, raising=False)
    spark.sparkContext.setJobGroup("labels", "")
    try:
        got = {r["node"]: r["community"] for r in graph.communities(dense(spark), rounds=2).collect()}
    finally:
        spark.sparkContext._jsc.clearJobGroup()
    status = spark.sparkContext.statusTracker()
    stages = [status.getStageInfo(s) for j in status.getJobIdsForGroup("labels") for s in status.getJobInfo(j).stageIds]
    assert len(got) == 450
    assert sum(s is not None and s.numTasks >= 40 for s in stages) >= 4


def test_a_log_is_not_sorted_before_it_is_dealt_out(spark, tmp_path):
    states = [spark.range(50).selectExpr("id", f"CASE WHEN id % {k} = 0 THEN {k} END AS v") for k in (2, 3)] + [spark.range(20, 60).selectExpr("id", "1 AS v")]
    held = log = None
    for k, rows in enumerate(states):
        log = bitemporal.append_delta(log, rows, ["id"], f"2024-01-0{k + 1} 00:00:00")
        held = bitemporal.stored_delta(held, rows, ["id"], f"2024-01-0{k + 1} 00:00:00", f"{tmp_path}/log")
    assert sorted(map(tuple, held.collect()), key=repr) == sorted(map(tuple, log.collect()), key=repr)
    now = bitemporal.current(held, ["id"])
    assert sorted(map(tuple, now.collect())) == [(k, 1) for k in range(20, 60)]
    plan = now._jdf.queryExecution().sparkPlan().toString() + now._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1]
    assert "Sort" not in plan[plan.rindex("Exchange") :]
