"""Graph patterns over registered relationships, and algorithms over edge tables.

Nodes are rows of tables and edges are relationships; a pattern is a chain of joins. Traversals are loops of joins with a
fixed number of rounds, or until nothing is left (cores, betweenness); their frontiers are tables, never driver lists. Long loops cut lineage with
written tables; those over whole graphs write the edges once, in buckets by source, and deal out what nodes hold only.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..model import ModelError
from .filters import where
from .relations import join_flat
from .scratch import Scratch, dealt_for, tasks_for


@dataclass(frozen=True)
class Hop:
    """One step of a pattern: a relationship from `source` to a new variable. `optional` keeps rows without a match."""

    source: str
    relationship: str
    variable: str
    where: dict = field(default_factory=dict)
    optional: bool = False


def match(engine, variable: str, table: str, hops: tuple[Hop, ...] = (), where_: dict | None = None) -> DataFrame:
    """One row for each match, with columns `variable_column`. Conditions on an optional variable are part of its join."""
    start = engine.table(table)
    df = start.where(where(where_, start.schema)).select(*[F.col(c).alias(f"{variable}_{c}") for c in start.columns])
    tables = {variable: table}
    for hop in hops:
        if hop.source not in tables:
            raise ModelError(f"no variable {hop.source}")
        r = engine.model.relationship(tables[hop.source], hop.relationship)
        right = engine.table(r.target)
        right = right.where(where(hop.where, right.schema))
        moved = type(r)(r.name, r.source, f"{hop.source}_{r.source_column}", r.target, r.target_column, r.many)
        df = join_flat(df, right, moved, "left" if hop.optional else "inner", f"{hop.variable}_")
        tables[hop.variable] = r.target
    return df


def label_union(engine, tables: list[str]) -> DataFrame:
    """Nodes of several tables in one, with their label and id; columns that a table lacks are null."""
    parts = []
    for t in tables:
        key = engine.model.table(t).key
        df = engine.table(t)
        parts.append(df.select(F.lit(t).alias("label"), F.concat_ws("|", *[F.col(k).cast("string") for k in key]).alias("id"), *df.columns))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def edges_of(engine, name: str) -> DataFrame:
    """(src, dst) of a relationship, by the keys of its tables."""
    r = engine.model.relationships[name]
    source, target = engine.table(r.source), engine.table(r.target)
    a, b = engine.model.table(r.source).key[0], engine.model.table(r.target).key[0]
    left = source.select(F.col(a).alias("src"), F.expr(r.source_column).alias("k"))
    right = target.select(F.col(b).alias("dst"), F.expr(r.target_column).alias("j"))
    return left.join(right, F.col("k") == F.col("j")).select("src", "dst")


def both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()


def walks(edges: DataFrame, starts: DataFrame, low: int, high: int) -> DataFrame:
    """(start, node, hops) of every walk of low to high edges. Walks may repeat nodes; equal ends at a length count once."""
    front = starts.select(F.col("node").alias("start"), "node", F.lit(0).alias("hops"))
    out = front if low == 0 else None
    for k in range(1, high + 1):
        front = front.join(edges, F.col("node") == F.col("src")).select("start", F.col("dst").alias("node"), F.lit(k).alias("hops")).distinct()
        if k >= low:
            out = front if out is None else out.unionByName(front)
    return out


def shortest_paths(edges: DataFrame, starts: DataFrame, max_hops: int) -> DataFrame:
    """(start, node, hops, path): one shortest path to each node within reach, the smallest among equally short ones."""
    reached = starts.select(F.col("node").alias("start"), "node", F.lit(0).alias("hops"), F.array("node").alias("path"))
    front = reached
    for k in range(1, max_hops + 1):
        step = front.join(edges, F.col("node") == F.col("src")).select("start", F.col("dst").alias("node"), F.lit(k).alias("hops"), F.concat("path", F.array("dst")).alias("path"))
        new = step.join(reached.select("start", "node"), ["start", "node"], "left_anti")
        front = new.groupBy("start", "node").agg(F.min("hops").alias("hops"), F.min("path").alias("path"))
        reached = reached.unionByName(front)
    return reached


def all_simple_paths(edges: DataFrame, starts: DataFrame, max_hops: int) -> DataFrame:
    """(start, node, hops, path) of every path that visits no node twice."""
    front = starts.select(F.col("node").alias("start"), "node", F.lit(0).alias("hops"), F.array("node").alias("path"))
    out = None
    for k in range(1, max_hops + 1):
        front = front.join(edges, F.col("node") == F.col("src")).where(~F.array_contains("path", F.col("dst")))
        front = front.select("start", F.col("dst").alias("node"), F.lit(k).alias("hops"), F.concat("path", F.array("dst")).alias("path"))
        out = front if out is None else out.unionByName(front)
    return out


def degrees(edges: DataFrame) -> DataFrame:
    """node, in_degree and out_degree of every node of the edges."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("src").alias("node"), F.lit(1).alias("o"), F.lit(0).alias("i")), F.struct(F.col("dst").alias("node"), F.lit(0).alias("o"), F.lit(1).alias("i")))).alias("e"))
    return ends.groupBy("e.node").agg(F.sum("e.i").alias("in_degree"), F.sum("e.o").alias("out_degree"))


def nodes_of(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array("src", "dst")).alias("node")).distinct()


#: Edges of a loop that sums values are in SOURCES buckets by source; those of a bucket are in BLOCKS parts by target.
SOURCES, BLOCKS = 4, 8


def _summing(scratch: Scratch, edges: DataFrame, rows: int) -> list[DataFrame]:
    """The edges once for all rounds: a round deals out no edges, but a value for each node and, for each node, as many sums as there
    are SOURCES. A task holds the values of a bucket's nodes and the sums of a block's."""
    table = scratch.bucketed(edges.select("src", "dst", F.pmod(F.hash("dst"), F.lit(BLOCKS)).alias("block")), "src", SOURCES, rows, "block")
    return [table.where(F.col("block") == k) for k in range(BLOCKS)]


def _summed(parts: list[DataFrame], values: DataFrame) -> DataFrame:
    """node, v: the sum of `values` (node, v) over the sources of each node's edges."""
    got = [p.join(values.hint("shuffle_hash"), F.col("src") == F.col("node")).select(F.col("dst").alias("node"), "v") for p in parts]
    return reduce(DataFrame.unionByName, got).groupBy("node").agg(F.sum("v").alias("v"))


def pagerank(edges: DataFrame, rounds: int = 20, damping: float = 0.85) -> DataFrame:
    """node, rank. What nodes without successors hold is shared by all; ranks sum to 1."""
    with Scratch(edges.sparkSession) as scratch:
        edges = scratch.distinct(edges.select("src", "dst").distinct())
        rows = edges.count()
        with dealt_for(edges.sparkSession, rows):
            parts = _summing(scratch, edges, rows)
            nodes = scratch.stored(edges.select(F.col("src").alias("node"), F.lit(1).alias("n")).unionByName(edges.select(F.col("dst").alias("node"), F.lit(0).alias("n"))).groupBy("node").agg(F.sum("n").alias("n")))
            scratch.free(edges)
            total = nodes.count()
            ranks, got = nodes.withColumn("rank", F.lit(1.0 / max(total, 1))), None
            for _ in range(rounds):
                given = _summed(parts, ranks.where("n > 0").select("node", (F.col("rank") / F.col("n")).alias("v")))
                last, got = got, scratch.stored(nodes.join(given, "node", "left").select("node", "n", F.coalesce("v", F.lit(0.0)).alias("got")))
                scratch.free(last)
                lost = F.broadcast(got.agg((1 - F.sum("got")).alias("lost")))  # one row
                ranks = got.crossJoin(lost).select("node", "n", ((1 - damping) / total + damping * (F.col("got") + F.col("lost") / total)).alias("rank"))
            return ranks.select("node", "rank").checkpoint()


def eigenvector(edges: DataFrame, rounds: int = 30) -> DataFrame:
    """node, centrality of the undirected graph by power iteration on A + I, scaled to length 1."""
    with Scratch(edges.sparkSession) as scratch:
        both = scratch.distinct(both_ways(edges))
        rows = both.count()
        with dealt_for(edges.sparkSession, rows):
            nodes = scratch.stored(both.select(F.col("src").alias("node")).distinct())
            parts = _summing(scratch, both.unionByName(nodes.select(F.col("node").alias("src"), F.col("node").alias("dst"))), rows)
            scratch.free(both)
            values, got = nodes.withColumn("v", F.lit(1.0)), None
            for _ in range(rounds):
                last, got = got, scratch.stored(_summed(parts, values))
                scratch.free(last)
                norm = F.broadcast(got.agg(F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("norm")))  # one row
                values = got.crossJoin(norm).select("node", (F.col("v") / F.col("norm")).alias("v"))
            return values.select("node", F.col("v").alias("centrality")).checkpoint()


def closeness(edges: DataFrame, starts: DataFrame, max_hops: int) -> DataFrame:
    """node, closeness of the undirected graph from each start within max_hops: reached / sum of distances."""
    reached = shortest_paths(both_ways(edges), starts, max_hops).where("hops > 0")
    return reached.groupBy(F.col("start").alias("node")).agg((F.count("*") / F.sum("hops")).alias("closeness"))


def betweenness(edges: DataFrame, starts: DataFrame, max_hops: int | None = None) -> DataFrame:
    """node, betweenness: dependencies of shortest paths from the starts, up to max_hops if given, in the undirected graph.

    Counts of shortest paths grow level by level from each start; dependencies are gathered back in the reverse order.
    """
    both = both_ways(edges).checkpoint()
    levels = [starts.select(F.col("node").alias("start"), "node", F.lit(1.0).alias("paths"))]
    seen = levels[0].select("start", "node")
    while max_hops is None or len(levels) <= max_hops:
        step = levels[-1].join(both, F.col("node") == F.col("src")).select("start", F.col("dst").alias("node"), "paths")
        new = step.join(seen, ["start", "node"], "left_anti").groupBy("start", "node").agg(F.sum("paths").alias("paths")).checkpoint()
        if new.isEmpty():
            break
        levels.append(new)
        seen = seen.unionByName(new.select("start", "node"))
    if len(levels) == 1:
        return nodes_of(both).withColumn("betweenness", F.lit(0.0))
    flow, out = levels[-1].select("start", "node", "paths", F.lit(0.0).alias("d")), None
    for above in reversed(levels[:-1]):
        back = flow.join(both, F.col("node") == F.col("dst")).select("start", F.col("src").alias("up"), ((1 + F.col("d")) / F.col("paths")).alias("share"))
        given = back.groupBy("start", F.col("up").alias("node")).agg(F.sum("share").alias("share"))
        flow = above.join(given, ["start", "node"], "left").select("start", "node", "paths", (F.col("paths") * F.coalesce("share", F.lit(0.0))).alias("d")).checkpoint()
        mine = flow.where("node <> start").groupBy("node").agg(F.sum("d").alias("d"))
        out = mine if out is None else out.unionByName(mine)
    return nodes_of(both).join(out.groupBy("node").agg((F.sum("d") / 2).alias("d")), "node", "left").select("node", F.coalesce("d", F.lit(0.0)).alias("betweenness"))


def clustering(edges: DataFrame) -> DataFrame:
    """node, triangles and clustering coefficient of the undirected graph.

    Edges point to the end of higher degree, so a hub's neighbours are not paired with each other.
    """
    both = both_ways(edges.where("src <> dst"))
    degree = both.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("d"))
    known = both.join(degree.select(F.col("node").alias("src"), F.col("d").alias("ds")), "src").join(degree.select(F.col("node").alias("dst"), F.col("d").alias("dd")), "dst")
    up = known.where(F.struct("ds", "src") < F.struct(F.col("dd"), F.col("dst"))).select("src", "dst").checkpoint()
    a, b = up.select("src", F.col("dst").alias("x")), up.select("src", F.col("dst").alias("y"))
    wedges = a.join(b, "src").where("x <> y")
    closed = wedges.join(up.select(F.col("src").alias("x"), F.col("dst").alias("y")), ["x", "y"])
    found = closed.select(F.explode(F.array("src", "x", "y")).alias("node")).groupBy("node").agg(F.count("*").alias("t"))
    t = F.coalesce("t", F.lit(0))
    return degree.join(found, "node", "left").select("node", t.alias("triangles"), F.when(F.col("d") > 1, 2 * t / (F.col("d") * (F.col("d") - 1))).otherwise(0.0).alias("clustering"))


def core_numbers(edges: DataFrame, max_core: int | None = None) -> DataFrame:
    """node, core: the largest k whose k-core holds the node, or max_core where that is given and less.

    Nodes of least degree are taken away until none are left; a node's core is the highest least degree so far. The edges stay as they
    are: those of the nodes that go tell their other ends to count one less, so each edge is dealt out once in all rounds.
    """
    with Scratch(edges.sparkSession) as scratch:
        both = scratch.distinct(both_ways(edges.where("src <> dst")))
        rows = both.count()
        with dealt_for(edges.sparkSession, rows):
            near = scratch.bucketed(both, "src", tasks_for(rows), rows)
            scratch.free(both)
            alive = scratch.stored(near.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("d")))
            core, out = 0, scratch.stored(alive.select("node", F.lit(0).alias("core")).limit(0))
            while (least := alive.agg(F.min("d")).first()[0]) is not None:
                core = max(core, least)
                if max_core is not None and core >= max_core:
                    out = scratch.added(out, alive.select("node", F.lit(max_core).alias("core")))
                    break
                going = alive.where(F.col("d") <= core).select("node")
                out = scratch.added(out, going.withColumn("core", F.lit(core)))
                lost = near.join(going.hint("shuffle_hash"), F.col("src") == F.col("node")).groupBy(F.col("dst").alias("node")).agg(F.count("*").alias("n"))
                last, alive = alive, scratch.stored(alive.where(F.col("d") > core).join(lost, "node", "left").select("node", (F.col("d") - F.coalesce("n", F.lit(0))).alias("d")))
                scratch.free(last)
            return out.checkpoint()


def communities(edges: DataFrame, rounds: int = 10) -> DataFrame:
    """node, community by label propagation: each round a node takes its neighbours' commonest label, the smallest of equals."""
    with Scratch(edges.sparkSession) as scratch:
        both = scratch.distinct(both_ways(edges.where("src <> dst")))
        rows = both.count()
        with dealt_for(edges.sparkSession, rows):
            near = scratch.bucketed(both, "src", tasks_for(rows), rows)
            scratch.free(both)
            labels = scratch.stored(near.select(F.col("src").alias("node"), F.col("src").alias("community")).distinct())
            for _ in range(rounds):
                told = near.join(labels.hint("shuffle_hash"), F.col("src") == F.col("node")).select(F.col("dst").alias("node"), "community", F.lit(2).alias("w"))
                # A node's own label counts as half a vote, so two nodes don't swap labels for ever.
                votes = told.unionByName(labels.withColumn("w", F.lit(1))).groupBy("node", "community").agg(F.sum("w").alias("n"))
                best = votes.groupBy("node").agg(F.max(F.struct("n", (-F.col("community")).alias("c"))).alias("best"))
                last, labels = labels, scratch.stored(best.select("node", (-F.col("best.c")).alias("community")))
                scratch.free(last)
            return labels.checkpoint()


def pattern_list(df: DataFrame, keys: list[str], value: Column, name: str = "items") -> DataFrame:
    """Pattern comprehension: the values of all matches of each key, sorted."""
    return df.groupBy(*keys).agg(F.sort_array(F.collect_list(value)).alias(name))


def first_by(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__n = 1").drop("__n")
