"""The semantic model: tables, relationships, roles and metrics. Plain values; nothing here touches data."""

from __future__ import annotations

from dataclasses import dataclass, field, replace


class ModelError(ValueError):
    """A name that the model doesn't have, or a rule that doesn't fit it."""


@dataclass(frozen=True)
class Table:
    """A registered relation. `key` identifies a row; `presets` are column expressions set on insert or update. A `derived`
    one holds what a role's statement read, so it belongs to no domain and has rules only by its own name."""

    name: str
    key: tuple[str, ...] = ()
    domain: str = "default"
    presets: tuple[tuple[str, str], ...] = ()
    derived: bool = False


@dataclass(frozen=True)
class Relationship:
    """A join path from `source` to `target`: a column or SQL expression on each side. `many`: whether a source row has many targets."""

    name: str
    source: str
    source_column: str
    target: str
    target_column: str
    many: bool = False


@dataclass(frozen=True)
class Mask:
    """How a column is shown: kind is `regex` (pattern, replacement), `constant` (value) or `truncate` (unit of time)."""

    kind: str
    pattern: str = ""
    replacement: str = ""
    value: object = None
    unit: str = "month"


@dataclass(frozen=True)
class Role:
    """What a role may see. Row rules are SQL predicates by table, or by domain where a table has none of its own."""

    name: str
    parent: str | None = None
    domains: tuple[str, ...] | None = None
    rows: dict[str, str] = field(default_factory=dict)
    domain_rows: dict[str, str] = field(default_factory=dict)
    masks: dict[tuple[str, str], Mask] = field(default_factory=dict)
    hidden: frozenset[tuple[str, str]] = frozenset()
    row_cap: int | None = None
    max_depth: int | None = None
    max_fields: int | None = None


@dataclass(frozen=True)
class Metric:
    """A named aggregate of one table's columns, without a grain."""

    name: str
    table: str
    expression: str


@dataclass(frozen=True)
class SemanticModel:
    tables: dict[str, Table]
    relationships: dict[str, Relationship] = field(default_factory=dict)
    roles: dict[str, Role] = field(default_factory=dict)
    metrics: dict[str, Metric] = field(default_factory=dict)

    @classmethod
    def of(cls, tables=(), relationships=(), roles=(), metrics=()) -> SemanticModel:
        model = cls(*({x.name: x for x in items} for items in (tables, relationships, roles, metrics)))
        for r in model.relationships.values():
            for name in (r.source, r.target):
                model.table(name)
        for m in model.metrics.values():
            model.table(m.table)
        return model

    def table(self, name: str) -> Table:
        if name not in self.tables:
            raise ModelError(f"no table {name}")
        return self.tables[name]

    def relationship(self, source: str, name: str) -> Relationship:
        """The relationship of that name at `source`, turned round where it is declared at the other end."""
        found = self.relationships.get(name)
        if found is None or source not in (found.source, found.target):
            raise ModelError(f"{source} has no relationship {name}")
        if found.source == source:
            return found
        return replace(found, source=found.target, source_column=found.target_column, target=found.source, target_column=found.source_column, many=not found.many)

    def role(self, name: str) -> Role:
        """A role with what it inherits; its own rules win over its parent's."""
        if name not in self.roles:
            raise ModelError(f"no role {name}")
        own, seen = self.roles[name], {name}
        while own.parent is not None:
            if own.parent in seen:
                raise ModelError(f"role {name} inherits from itself")
            seen.add(own.parent)
            above = self.roles[own.parent]
            own = replace(
                own,
                parent=above.parent,
                domains=above.domains if own.domains is None else own.domains,
                rows=above.rows | own.rows,
                domain_rows=above.domain_rows | own.domain_rows,
                masks=above.masks | own.masks,
                hidden=above.hidden | own.hidden,
                row_cap=above.row_cap if own.row_cap is None else own.row_cap,
            )
        return own

    def paths(self, start: str, end: str, max_hops: int) -> list[tuple[Relationship, ...]]:
        """All chains of relationships from one table to another that use none twice, shortest first."""
        found, frontier = [], [((), start)]
        for _ in range(max_hops):
            grown = []
            for path, at in frontier:
                used = {r.name for r in path}
                for name, r in self.relationships.items():
                    if name not in used and at in (r.source, r.target):
                        step = self.relationship(at, name)
                        grown.append(((*path, step), step.target))
            found += [path for path, at in grown if at == end]
            frontier = grown
        return found
