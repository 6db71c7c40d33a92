"""Facts about queries, read off Spark's own plans."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession


def _items(seq) -> list:
    return [seq.apply(k) for k in range(seq.size())]


def _walk(plan):
    yield plan
    for child in _items(plan.children()):
        yield from _walk(child)


def _kind(node) -> str:
    return node.getClass().getSimpleName()


def attribute_names(spark: SparkSession, condition: str) -> set[str]:
    """The column names in a SQL condition."""
    expression = spark._jsparkSession.sessionState().sqlParser().parseExpression(condition)
    names = expression.references().toSeq() if expression.resolved() else None
    if names is not None:
        return {a.name() for a in _items(names)}
    found, todo = set(), [expression]
    while todo:
        e = todo.pop()
        if _kind(e) == "UnresolvedAttribute":
            found.add(e.name().split(".")[-1].strip("`"))
        todo += _items(e.children())
    return found


def tables_of(spark: SparkSession, sql: str) -> set[str]:
    """The relations that a statement reads."""
    relations, ctes, _ = parts_of(spark, sql)
    return relations - ctes


def parts_of(spark: SparkSession, sql: str) -> tuple[set[str], set[str], set[str]]:
    """(relations that a statement names, names of its common table expressions, kinds of its plan's nodes)."""
    plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(sql)
    found, ctes, kinds, todo = set(), set(), set(), [plan]
    while todo:
        node = todo.pop()
        kinds.add(_kind(node))
        if _kind(node) == "UnresolvedRelation":
            found.add(node.tableName())
        if _kind(node) == "UnresolvedWith":
            for pair in _items(node.cteRelations()):
                ctes.add(pair._1())
                todo.append(pair._2())
        todo += _items(node.children())
        for e in _items(node.expressions()):
            inner = [e]
            while inner:
                x = inner.pop()
                if hasattr(x, "plan") and "Subquery" in _kind(x) or _kind(x) in ("Exists", "ListQuery", "InSubquery"):
                    try:
                        todo.append(x.plan())
                    except Exception:  # noqa: BLE001  an expression of another shape has no plan
                        pass
                inner += _items(x.children())
    return found, ctes, kinds


def dependencies(spark: SparkSession, views: dict[str, str]) -> tuple[list[str], list[str]]:
    """(views in an order in which each follows what it reads, views that are part of a cycle or follow one)."""
    reads = {name: tables_of(spark, sql) & views.keys() for name, sql in views.items()}
    order: list[str] = []
    while ready := sorted(n for n, r in reads.items() if n not in order and r <= set(order)):
        order += ready
    return order, sorted(views.keys() - set(order))


def nondeterminism(df: DataFrame) -> list[str]:
    """Why a query may give other rows when run again: volatile expressions, or a limit without an order."""
    found = []
    for node in _walk(df._jdf.queryExecution().analyzed()):
        if _kind(node) in ("GlobalLimit", "LocalLimit", "Sample"):
            below = {_kind(n) for n in _walk(node.children().head())}
            if "Sort" not in below and _kind(node) == "GlobalLimit":
                found.append("limit without order")
        for e in _items(node.expressions()):
            if not e.deterministic():
                found.append(f"volatile: {e.sql()}")
    return found


def column_lineage(df: DataFrame) -> dict[str, dict]:
    """For each output column: `inputs`, the source columns it is made of, and `transform`: identity, constant, function or aggregate."""
    plan = df._jdf.queryExecution().analyzed()
    made: dict[int, tuple[set[str], str]] = {}

    def refs(expression) -> set[str]:
        out: set[str] = set()
        for a in _items(expression.references().toSeq()):
            out |= made.get(a.exprId().id(), ({a.name()}, "identity"))[0]
        return out

    def visit(node) -> None:
        children = _items(node.children())
        for child in children:
            visit(child)
        if not children:
            label = source_name(node)
            for a in _items(node.output()):
                made[a.exprId().id()] = ({f"{label}.{a.name()}" if label else a.name()}, "identity")
        for e in _items(node.expressions()):
            if _kind(e) == "Alias":
                child = e.child()
                names = refs(child)
                kind = "identity" if _kind(child) == "AttributeReference" else "constant" if not names else "aggregate" if _kind(node) == "Aggregate" and "AggregateExpression" in {_kind(x) for x in _walk(child)} else "function"
                if kind == "identity":
                    kind = made.get(child.exprId().id(), (names, "identity"))[1]
                made[e.exprId().id()] = (names, kind)
        if _kind(node) == "Union":
            for k, a in enumerate(_items(node.output())):
                names = set().union(*[made.get(_items(c.output())[k].exprId().id(), (set(), ""))[0] for c in children])
                made[a.exprId().id()] = (names, "union")

    def source_name(node) -> str:
        try:
            files = node.relation().location().inputFiles()
            return files[0].rstrip("/").split("/")[-1].split(".")[0] if len(files) == 1 else files[0].rstrip("/").split("/")[-2].split(".")[0]
        except Exception:  # noqa: BLE001  a relation without files has no name of its own
            return ""

    visit(plan)
    return {a.name(): {"inputs": sorted(made[a.exprId().id()][0]), "transform": made[a.exprId().id()][1]} for a in _items(plan.output())}


def downstream(edges: list[tuple[str, str]], start: str) -> set[str]:
    """Everything that depends on a column or table."""
    found, todo = set(), [start]
    while todo:
        at = todo.pop()
        for a, b in edges:
            if a == at and b not in found:
                found.add(b)
                todo.append(b)
    return found


def definition_version(sql: str, inputs: dict[str, str]) -> str:
    """A hash of a definition and of the versions of what it reads."""
    return hashlib.sha256(repr((" ".join(sql.split()), sorted(inputs.items()))).encode()).hexdigest()[:16]


def hinted(df: DataFrame, hints: dict[str, str]) -> DataFrame:
    """Join hints by name: broadcast, merge, shuffle_hash, rebalance."""
    allowed = {"broadcast", "merge", "shuffle_hash", "rebalance"}
    for name in hints.values():
        if name not in allowed:
            raise ValueError(f"no hint {name}")
        df = df.hint(name)
    return df
