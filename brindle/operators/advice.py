"""Advice on a query by its clauses, and rules that a project sets for its queries."""

from __future__ import annotations

from dataclasses import dataclass

from brindle.errors import QueryError
from brindle.plans.predicates import Condition, Group, Raw


def conditions(query) -> list:
    """All conditions of a query, groups flattened."""
    todo, found = [*query.clauses.where, *query.clauses.or_where], []
    while todo:
        c = todo.pop(0)
        if isinstance(c, Group):
            todo += c.members
        else:
            found.append(c)
    return found


def analyze(query) -> list[str]:
    """What may make the query slow or unsteady."""
    c, listed, out = query.clauses, conditions(query), []
    if c.select is None and not c.raw_select and not c.group_by:
        out.append("reads every column: select those that are needed")
    if not listed and c.limit is None and not c.group_by:
        out.append("reads the whole table: no filter and no limit")
    for x in listed:
        if isinstance(x, Condition) and x.operator in ("like", "contains", "ends_with") and (x.operator != "like" or str(x.args[0]).startswith("%")):
            out.append(f"{x.name}: a pattern with an open start can't be pushed to the scan")
        if isinstance(x, Condition) and x.operator == "not_in":
            out.append(f"{x.name}: NOT IN leaves out rows with NULL")
        if isinstance(x, Raw) and "(" in x.sql:
            out.append("a function around a column in a raw filter can't be pushed to the scan")
    if len(c.or_where) > 3:
        out.append("many alternatives: a list with in may say the same")
    if c.order_by and c.limit is None:
        out.append("orders all rows: a limit makes it a top-k")
    if (c.limit is not None or c.offset) and not c.order_by:
        out.append("a limit without an order gives any rows")
    return out


def complexity(query) -> int:
    """A score: what makes plans wide weighs more."""
    c = query.clauses
    return 1 + 2 * len(c.joins) + 2 * len(c.unions) + 2 * len(c.ctes) + 3 * len(c.subselects) + 2 * len(c.windows) + 2 * bool(c.group_by) + len(c.having) + len(conditions(query)) + bool(c.distinct)


@dataclass(frozen=True)
class Rules:
    """Limits for queries: rows they may ask for, joins, values of a list, raw fragments, relations loaded along and their depth.
    A Database with ``rules`` checks them before every read of rows."""

    max_rows: int | None = None
    max_joins: int | None = None
    max_in_values: int | None = None
    forbid_raw: bool = False
    max_relations: int | None = None
    max_depth: int | None = None

    def check_paths(self, paths) -> None:
        """Relations to load, as dotted paths."""
        if self.max_relations is not None and len({".".join(p.split(".")[: i + 1]) for p in paths for i in range(p.count(".") + 1)}) > self.max_relations:
            raise QueryError(f"a query may load {self.max_relations} relations at most")
        if self.max_depth is not None and any(p.count(".") + 1 > self.max_depth for p in paths):
            raise QueryError(f"relations may be loaded {self.max_depth} deep at most")

    def check(self, query) -> None:
        c, listed = query.clauses, conditions(query)
        if self.max_rows is not None and (c.limit is None or c.limit > self.max_rows):
            raise QueryError(f"a query may ask for {self.max_rows} rows at most")
        if self.max_joins is not None and len(c.joins) > self.max_joins:
            raise QueryError(f"a query may join {self.max_joins} tables at most")
        if self.max_in_values is not None and any(isinstance(x, Condition) and x.operator in ("in", "not_in") and len(list(x.args[0])) > self.max_in_values for x in listed):
            raise QueryError(f"a list may have {self.max_in_values} values at most")
        if self.forbid_raw and (c.raw_select or any(isinstance(x, Raw) for x in [*listed, *c.having])):
            raise QueryError("raw fragments are not allowed")
