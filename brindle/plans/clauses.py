"""The clauses of a query: an immutable value that is merged, hashed and compiled."""

from __future__ import annotations

from dataclasses import dataclass, fields, replace

from brindle.plans.windows import WindowColumn


@dataclass(frozen=True)
class Join:
    kind: str  # inner, left, right
    table: object  # a table's name, a model or a query
    alias: str
    left: str
    right: str


@dataclass(frozen=True)
class Cte:
    name: str
    body: object  # a query or SQL text
    columns: tuple[str, ...] = ()
    recursive: str | None = None


@dataclass(frozen=True)
class Clauses:
    select: tuple | None = None
    raw_select: tuple = ()
    subselects: tuple = ()  # (query, alias)
    where: tuple = ()
    or_where: tuple = ()
    joins: tuple[Join, ...] = ()
    group_by: tuple[str, ...] = ()
    having: tuple = ()
    windows: tuple[WindowColumn, ...] = ()
    unions: tuple = ()  # (query or (sql, params), all)
    ctes: tuple[Cte, ...] = ()
    order_by: tuple = ()  # (kind, expression, descending)
    limit: int | None = None
    offset: int | None = None
    distinct: bool = False
    trashed: str = "without"  # without, with, only
    lock: str | None = None
    cache: tuple | None = None
    error: Exception | None = None

    def merge(self, other: Clauses) -> Clauses:
        """Lists append, single values of ``other`` win where it has them, the first error stays."""
        changed = {}
        for f in fields(self):
            a, b = getattr(self, f.name), getattr(other, f.name)
            if f.name == "error":
                changed[f.name] = a or b
            elif f.name == "select":
                changed[f.name] = a if b is None else b
            elif isinstance(a, tuple) and f.name != "cache":
                changed[f.name] = a + b
            elif b != f.default:
                changed[f.name] = b
        return replace(self, **changed)
