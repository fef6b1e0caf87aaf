"""Aggregates and the HAVING conditions on them."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from brindle.errors import QueryError

_OPS = {"gt": "__gt__", "gte": "__ge__", "lt": "__lt__", "lte": "__le__", "eq": "__eq__", "ne": "__ne__"}


@dataclass(frozen=True)
class Aggregate:
    """An aggregate of a column: count, count_distinct, sum (0 for no values), avg, min or max."""

    name: str
    column: str | None = None

    def build(self, resolve: Callable[[str], Column]) -> Column:
        if self.name == "count":
            return F.count(resolve(self.column) if self.column else F.lit(1))
        c = resolve(self.column)
        if self.name == "sum":
            return F.coalesce(F.sum(c), F.lit(0))
        if self.name == "count_distinct":
            return F.count_distinct(c)
        return {"avg": F.avg, "min": F.min, "max": F.max}[self.name](c)

    def _condition(self, op: str, value) -> Having:
        if value is None and op not in ("eq", "ne"):
            raise QueryError("NULL has no order in HAVING")
        if value is not None and self.name in ("count", "count_distinct", "sum", "avg") and (isinstance(value, bool) or not isinstance(value, (int, float)) and type(value).__name__ != "Decimal"):
            raise QueryError(f"{self.name} compares with a number")
        return Having(self, op, value)

    def gt(self, value) -> Having:
        return self._condition("gt", value)

    def gte(self, value) -> Having:
        return self._condition("gte", value)

    def lt(self, value) -> Having:
        return self._condition("lt", value)

    def lte(self, value) -> Having:
        return self._condition("lte", value)

    def eq(self, value) -> Having:
        return self._condition("eq", value)

    def ne(self, value) -> Having:
        return self._condition("ne", value)


def count(column: str | None = None) -> Aggregate:
    return Aggregate("count", column)


def count_distinct(column: str) -> Aggregate:
    return Aggregate("count_distinct", column)


def sum_of(column: str) -> Aggregate:
    return Aggregate("sum", column)


def avg(column: str) -> Aggregate:
    return Aggregate("avg", column)


def min_of(column: str) -> Aggregate:
    return Aggregate("min", column)


def max_of(column: str) -> Aggregate:
    return Aggregate("max", column)


@dataclass(frozen=True)
class Having:
    aggregate: Aggregate
    op: str
    value: object

    def compare(self, made: Column) -> Column:
        if self.value is None:
            return made.isNull() if self.op == "eq" else made.isNotNull()
        return getattr(made, _OPS[self.op])(F.lit(self.value))
