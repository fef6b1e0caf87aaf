"""The fluent query builder. Every method returns a new query; nothing runs before a terminal."""

from __future__ import annotations

import base64
import json
import math
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, replace
from itertools import islice

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from brindle.errors import NotFound, QueryError
from brindle.model import Attribute, Model
from brindle.plans import windows as W
from brindle.plans.aggregates import Aggregate, Having
from brindle.plans.clauses import Clauses, Cte, Join
from brindle.plans.compile import Compiled
from brindle.plans.predicates import OPERATORS, Condition, Exists, Group, InQuery, Raw, Related, bound, checked
from brindle.sources.database import Database, current


def name_of(column) -> str:
    return f"{column.model.table}.{column.name}" if isinstance(column, Attribute) else column


def names_of(columns) -> tuple[str, ...]:
    if isinstance(columns, (str, Attribute)):
        return (name_of(columns),)
    return tuple(name_of(c) for c in columns)


def _condition(operator: str, column, args: tuple) -> Condition:
    if operator.startswith("column_"):
        args = (name_of(args[0]),)
    return Condition(name_of(column), operator, args)


class Filters:
    """The where_ methods over ``_and(condition)``, made from the table of operators."""

    def _and(self, condition):
        raise NotImplementedError

    def where_raw(self, sql: str, *params):
        return self._and(Raw(checked(sql), params))

    def where_col(self, condition):
        return self._and(condition)


class Alternatives:
    """The or_where_ methods over ``_or(condition)``."""

    def _or(self, condition):
        raise NotImplementedError

    def or_where_raw(self, sql: str, *params):
        return self._or(Raw(checked(sql), params))

    def or_where_col(self, condition):
        return self._or(condition)


for _op in OPERATORS:
    setattr(Filters, f"where_{_op}", (lambda op: lambda self, column, *args: self._and(_condition(op, column, args)))(_op))
    setattr(Alternatives, f"or_where_{_op}", (lambda op: lambda self, column, *args: self._or(_condition(op, column, args)))(_op))


@dataclass(frozen=True)
class OrGroup(Filters):
    """Members of a group of conditions: its where_ methods add one; nested groups are members too."""

    any: bool = True
    members: tuple = ()

    def _and(self, condition):
        return replace(self, members=(*self.members, condition))

    def nested_or(self, build: Callable[[OrGroup], OrGroup]) -> OrGroup:
        return self._and(build(OrGroup(True)).group())

    def nested_and(self, build: Callable[[OrGroup], OrGroup]) -> OrGroup:
        return self._and(build(OrGroup(False)).group())

    def group(self) -> Group:
        return Group(self.any, self.members)


@dataclass(frozen=True)
class OrBranches(Alternatives):
    """begin_or() ... end_or(): or_where_ starts a branch, and_where_ adds to the branch at hand."""

    query: Query
    branches: tuple[tuple, ...] = ()

    def _or(self, condition):
        return replace(self, branches=(*self.branches, (condition,)))

    def _extend(self, condition):
        *before, last = self.branches or ((),)
        return replace(self, branches=(*before, (*last, condition)))

    def and_where_raw(self, sql: str, *params):
        return self._extend(Raw(checked(sql), params))

    def end_or(self) -> Query:
        members = tuple(b[0] if len(b) == 1 else Group(False, b) for b in self.branches if b)
        return self.query._and(Group(True, members)) if members else self.query


for _op in OPERATORS:
    setattr(OrBranches, f"and_where_{_op}", (lambda op: lambda self, column, *args: self._extend(_condition(op, column, args)))(_op))


@dataclass(frozen=True)
class Page:
    """A page of rows with the count of all."""

    items: list
    total: int
    page: int
    per_page: int

    @property
    def last_page(self) -> int:
        return max(1, math.ceil(self.total / self.per_page))

    @property
    def has_next_page(self) -> bool:
        return self.page < self.last_page

    @property
    def has_previous_page(self) -> bool:
        return self.page > 1

    def map(self, f: Callable) -> Page:
        return replace(self, items=[f(x) for x in self.items])


@dataclass(frozen=True)
class CursorPage:
    items: list
    next_cursor: str | None


def page_offset(page: int, per_page: int) -> int:
    if page < 1 or per_page < 1:
        raise QueryError("pages and their sizes start at 1")
    if (page - 1) * per_page > 2**31 - 1:
        raise QueryError("the page is out of range")
    return (page - 1) * per_page


@dataclass(frozen=True)
class Query(Filters, Alternatives):
    model: Model
    db: Database
    clauses: Clauses = Clauses()

    # building

    def _with(self, **changed) -> Query:
        return replace(self, clauses=replace(self.clauses, **changed))

    def _fail(self, message: str) -> Query:
        return self if self.clauses.error else self._with(error=QueryError(message))

    def _and(self, condition) -> Query:
        return self._with(where=(*self.clauses.where, condition))

    def _or(self, condition) -> Query:
        return self._with(or_where=(*self.clauses.or_where, condition))

    def where_any(self, build: Callable[[OrGroup], OrGroup]) -> Query:
        group = build(OrGroup(True)).group()
        return self._and(group) if group.members else self

    def where_all(self, build: Callable[[OrGroup], OrGroup]) -> Query:
        group = build(OrGroup(False)).group()
        return self._and(group) if group.members else self

    def begin_or(self) -> OrBranches:
        return OrBranches(self)

    def when(self, condition: bool, build: Callable[[Query], Query]) -> Query:
        return build(self) if condition else self

    def when_some(self, value, build: Callable[[Query, object], Query]) -> Query:
        return self if value is None else build(self, value)

    def apply_scope(self, scope: Callable[[Query], Query]) -> Query:
        return scope(self)

    def with_trashed(self) -> Query:
        return self._with(trashed="with")

    def without_trashed(self) -> Query:
        return self._with(trashed="without")

    def only_trashed(self) -> Query:
        return self._with(trashed="only") if self.model.soft_delete else self._fail(f"{self.model.table} has no soft delete")

    # subqueries

    def where_in_subquery(self, column, sub: Query) -> Query:
        return self._and(InQuery(name_of(column), sub))

    def where_not_in_subquery(self, column, sub: Query) -> Query:
        """NOT IN with SQL's NULLs: a NULL in the subquery leaves no row."""
        return self._and(InQuery(name_of(column), sub, False))

    def where_exists(self, sub: Query) -> Query:
        return self._and(Exists(sub))

    def where_not_exists(self, sub: Query) -> Query:
        return self._and(Exists(sub, False))

    def where_has(self, related: Model, foreign_key, local_key, constrain: Callable[[Query], Query] = lambda q: q) -> Query:
        """Rows with a related row; the closure filters it, and trashed ones don't count unless it says so."""
        return self._and(Exists(constrain(Query(related, self.db)), True, _last(foreign_key), name_of(local_key)))

    def where_doesnt_have(self, related: Model, foreign_key, local_key, constrain: Callable[[Query], Query] = lambda q: q) -> Query:
        return self._and(Exists(constrain(Query(related, self.db)), False, _last(foreign_key), name_of(local_key)))

    def has_related(self, table: str, foreign_key: str, local_key: str, column: str, value) -> Query:
        return self._and(Related(self.db, table, foreign_key, name_of(local_key), (column, value)))

    def has_no_related(self, table: str, foreign_key: str, local_key: str, column: str, value) -> Query:
        return self._and(Related(self.db, table, foreign_key, name_of(local_key), (column, value), False))

    def has_any_related(self, table: str, foreign_key: str, local_key: str) -> Query:
        return self._and(Related(self.db, table, foreign_key, name_of(local_key)))

    def has_no_related_at_all(self, table: str, foreign_key: str, local_key: str) -> Query:
        return self._and(Related(self.db, table, foreign_key, name_of(local_key), (), False))

    # projection and joins

    def select(self, *columns) -> Query:
        return self._with(select=names_of(columns))

    def add_select(self, column) -> Query:
        return self._with(select=(*(self.clauses.select or ()), name_of(column)))

    def select_raw(self, expression: str, *params) -> Query:
        return self._with(raw_select=(*self.clauses.raw_select, bound(expression, params)))

    def select_subquery(self, sub: Query, alias: str) -> Query:
        return self._with(subselects=(*self.clauses.subselects, (sub, alias)))

    def distinct(self) -> Query:
        return self._with(distinct=True)

    def _join(self, kind: str, table, alias: str | None, left, right) -> Query:
        name = table.table if isinstance(table, Model) else table
        if not isinstance(name, str) or not name.replace("_", "a").replace(".", "a").isalnum():
            return self._fail(f"{name!r} is no table name")
        return self._with(joins=(*self.clauses.joins, Join(kind, table, alias or name, name_of(left), name_of(right))))

    def inner_join(self, table, left, right) -> Query:
        return self._join("inner", table, None, left, right)

    def inner_join_as(self, table, alias: str, left, right) -> Query:
        return self._join("inner", table, alias, left, right)

    def left_join(self, table, left, right) -> Query:
        return self._join("left", table, None, left, right)

    def left_join_as(self, table, alias: str, left, right) -> Query:
        return self._join("left", table, alias, left, right)

    def right_join(self, table, left, right) -> Query:
        return self._join("right", table, None, left, right)

    def right_join_as(self, table, alias: str, left, right) -> Query:
        return self._join("right", table, alias, left, right)

    def join(self, kind: str, model: Model, left, right) -> Query:
        return self._join(kind, model, None, left, right)

    def join_as(self, kind: str, model: Model, alias: str, left, right) -> Query:
        return self._join(kind, model, alias, left, right)

    def select_with_linked(self, local_columns, table: str, local_column, linked_column: str, linked_columns: Sequence[str]) -> Query:
        return self.left_join(table, local_column, f"{table}.{linked_column}").select(*names_of(local_columns), *(f"{table}.{c}" for c in linked_columns))

    def select_also_linked(self, table: str, local_column, linked_column: str, linked_columns: Sequence[str]) -> Query:
        return self.select_with_linked([f"{self.model.table}.{c}" for c in self.model.names], table, local_column, linked_column, linked_columns)

    # groups, windows, order

    def group_by(self, *columns) -> Query:
        return self._with(group_by=self.clauses.group_by + names_of(columns))

    def having(self, condition: Having) -> Query:
        return self._with(having=(*self.clauses.having, condition))

    def having_raw(self, sql: str, *params) -> Query:
        return self._with(having=(*self.clauses.having, Raw(checked(sql), params)))

    def window(self, column: W.WindowColumn) -> Query:
        return self._with(windows=(*self.clauses.windows, column))

    def _shorthand(self, made: W.WindowColumn, partition_by, order_by, descending: bool) -> Query:
        return self.window(made.partition_by(*names_of(partition_by)).order_by(name_of(order_by), descending))

    def row_number(self, alias: str, partition_by, order_by, descending: bool = False) -> Query:
        return self._shorthand(W.row_number(alias), partition_by, order_by, descending)

    def rank(self, alias: str, partition_by, order_by, descending: bool = False) -> Query:
        return self._shorthand(W.rank(alias), partition_by, order_by, descending)

    def dense_rank(self, alias: str, partition_by, order_by, descending: bool = False) -> Query:
        return self._shorthand(W.dense_rank(alias), partition_by, order_by, descending)

    def lag(self, alias: str, column: str, offset: int, partition_by, order_by, descending: bool = False) -> Query:
        return self._shorthand(W.lag(alias, column, offset), partition_by, order_by, descending)

    def lead(self, alias: str, column: str, offset: int, partition_by, order_by, descending: bool = False) -> Query:
        return self._shorthand(W.lead(alias, column, offset), partition_by, order_by, descending)

    def running_sum(self, alias: str, column: str, partition_by, order_by, descending: bool = False) -> Query:
        return self._shorthand(W.aggregate(alias, "sum", column).frame("rows"), partition_by, order_by, descending)

    def ntile(self, alias: str, buckets: int, partition_by, order_by, descending: bool = False) -> Query:
        return self._shorthand(W.ntile(alias, buckets), partition_by, order_by, descending)

    def first_value(self, alias: str, column: str, partition_by, order_by, descending: bool = False) -> Query:
        return self._shorthand(W.first_value(alias, column), partition_by, order_by, descending)

    def order_by(self, column, direction: str = "asc") -> Query:
        word = direction.strip().lower()
        if word not in ("asc", "ascending", "desc", "descending"):
            return self._fail(f"{direction!r} is no direction")
        return self._with(order_by=(*self.clauses.order_by, ("column", name_of(column), word.startswith("desc"))))

    def order_asc(self, column) -> Query:
        return self.order_by(column, "asc")

    def order_desc(self, column) -> Query:
        return self.order_by(column, "desc")

    def order_by_raw(self, expression: str, direction: str = "asc") -> Query:
        return self._with(order_by=(*self.clauses.order_by, ("raw", checked(expression), direction.lower().startswith("desc"))))

    def sort(self, spec: str) -> Query:
        """A request's order: ``-a,b desc,+c``; columns of the model only."""
        query = self
        for part in filter(None, (p.strip() for p in spec.split(","))):
            word, _, direction = part.lstrip("+-").partition(" ")
            if part[0] in "+-" and direction.strip():
                return self._fail(f"{part!r} has two directions")
            if word.split(".")[-1] not in self.model.names:
                return self._fail(f"{self.model.table} has no column {word}")
            query = query.order_by(word, direction.strip() or ("desc" if part[0] == "-" else "asc"))
        return query

    def reverse(self) -> Query:
        """The same order the other way round."""
        return self._with(order_by=tuple((kind, name, not descending) for kind, name, descending in self.clauses.order_by))

    def reorder(self, column, direction: str = "asc") -> Query:
        return self._with(order_by=()).order_by(column, direction)

    def latest(self) -> Query:
        return self.order_desc(self.model.created_at)

    def oldest(self) -> Query:
        return self.order_asc(self.model.created_at)

    def latest_by(self, column) -> Query:
        return self.order_desc(column)

    def oldest_by(self, column) -> Query:
        return self.order_asc(column)

    def limit(self, n: int) -> Query:
        return self._with(limit=n)

    def offset(self, n: int) -> Query:
        return self._with(offset=n)

    def page(self, page: int, per_page: int) -> Query:
        try:
            return self.offset(page_offset(page, per_page)).limit(per_page)
        except QueryError as e:
            return self._fail(str(e))

    # sets, common tables, fragments

    def union(self, other: Query) -> Query:
        return self._with(unions=(*self.clauses.unions, (other, False)))

    def union_all(self, other: Query) -> Query:
        return self._with(unions=(*self.clauses.unions, (other, True)))

    def union_raw(self, sql: str, *params) -> Query:
        return self._with(unions=(*self.clauses.unions, ((sql, params), False)))

    def union_all_raw(self, sql: str, *params) -> Query:
        return self._with(unions=(*self.clauses.unions, ((sql, params), True)))

    def with_cte(self, cte: Cte) -> Query:
        return self._with(ctes=(*self.clauses.ctes, cte))

    def with_query(self, name: str, query: Query) -> Query:
        return self.with_cte(Cte(name, query))

    def with_query_columns(self, name: str, columns: Sequence[str], query: Query) -> Query:
        return self.with_cte(Cte(name, query, tuple(columns)))

    def with_recursive_cte(self, name: str, columns: Sequence[str], base: str, step: str) -> Query:
        return self.with_cte(Cte(name, base, tuple(columns), step))

    def consolidate(self) -> Clauses:
        return self.clauses

    def apply(self, fragment: Clauses) -> Query:
        return replace(self, clauses=self.clauses.merge(fragment))

    # locks have nothing to lock in a snapshot of files: they are checked and do nothing

    def lock_for_update(self) -> Query:
        return self._with(lock="update")

    def lock_for_share(self) -> Query:
        return self._with(lock="share")

    def skip_locked(self) -> Query:
        return self if self.clauses.lock else self._fail("skip_locked needs a lock")

    def nowait(self) -> Query:
        return self if self.clauses.lock else self._fail("nowait needs a lock")

    # cache

    def cache_for(self, seconds: float, key: str = "", tags: Sequence[str] = ()) -> Query:
        """Keep the result for a while, under all that the query says (and ``key``); tags drop it by name."""
        return self._with(cache=(seconds, key, tuple(tags)))

    def cache_with_key(self, key: str, seconds: float) -> Query:
        return self.cache_for(seconds, key)

    def no_cache(self) -> Query:
        return self._with(cache=None)

    # terminals

    def compiled(self) -> Compiled:
        return Compiled(self)

    def validate(self) -> None:
        """Raise the query's first error, or what compiling it finds, without running it."""
        Compiled(self, dry=True).frame()

    def frame(self) -> DataFrame:
        """The whole query as a DataFrame."""
        return Compiled(self).frame()

    def _rows(self, df: DataFrame, what: str) -> list[Row]:
        """Run a terminal: rules are checked before, the journal hears of it."""
        if self.db.rules:
            self.db.rules.check(self)
        if self.db.journal is None:
            return df.collect()
        with self.db.journal.timing(self.model.table, what) as told:
            rows = df.collect()
            told[0] = len(rows)
        return rows

    def get(self) -> list[Row]:
        Compiled(self, dry=True).check_model_columns()
        return self._rows(self._cached(), "get")

    def _cached(self) -> DataFrame:
        from brindle.operators.cache import remembered

        return remembered(self) if self.clauses.cache else self.frame()

    def get_json(self) -> list[dict]:
        return [r.asDict(recursive=True) for r in self._rows(self._cached(), "get_json")]

    def json_rows(self) -> DataFrame:
        """Rows as JSON texts, without the model's hidden columns: one column, ``json``."""
        df = self.frame()
        return df.select(F.to_json(F.struct(*[c for c in df.columns if c not in self.model.hidden])).alias("json"))

    def get_as(self, schema: str) -> DataFrame:
        df = self.frame()
        from pyspark.sql import types as T

        return df.select([df[f.name].cast(f.dataType).alias(f.name) for f in T.StructType.fromDDL(schema).fields])

    def first(self) -> Row | None:
        one = self.limit(1 if self.clauses.limit is None else min(1, self.clauses.limit))
        rows = one._rows(one.frame(), "first")
        return rows[0] if rows else None

    def first_or_fail(self) -> Row:
        row = self.first()
        if row is None:
            raise NotFound(f"no {self.model.table}")
        return row

    def last(self) -> Row | None:
        query = self._with(order_by=())
        for key in self.model.primary_key:
            query = query.order_desc(key)
        return query.first()

    def _by_key(self, key) -> Query:
        keys = key if isinstance(key, (tuple, list)) else (key,)
        if len(keys) != len(self.model.primary_key):
            raise QueryError(f"the key of {self.model.table} has {len(self.model.primary_key)} columns")
        query = self
        for name, value in zip(self.model.primary_key, keys):
            query = query.where_eq(f"{self.model.table}.{name}", value)
        return query

    def find(self, key) -> Row | None:
        c = self.clauses
        if c.limit is not None or c.offset is not None or c.unions:
            raise QueryError("find goes with filters only")
        return self._by_key(key).first()

    def find_or_fail(self, key) -> Row:
        row = self.find(key)
        if row is None:
            raise NotFound(f"no {self.model.table} with key {key!r}")
        return row

    def _counted(self) -> DataFrame:
        """Rows to count: order, limit and offset don't matter."""
        return Compiled(self._with(order_by=(), limit=None, offset=None)).frame()

    def count(self) -> int:
        return self._counted().count()

    def exists(self) -> bool:
        return not self._counted().isEmpty()

    def aggregates(self, **wanted: Aggregate) -> DataFrame:
        """One row with several aggregates over what limit and offset leave."""
        c = self.clauses
        if c.group_by or c.having or c.windows:
            raise QueryError("aggregates don't go with groups or windows")
        for a in wanted.values():
            if a.column and a.column.split(".")[-1] in self.model.encrypted:
                raise QueryError(f"{a.column} is encrypted")
        compiled = Compiled(self)
        df = compiled.rows_to_aggregate()
        return df.agg(*[a.build(compiled.resolve).alias(alias) for alias, a in wanted.items()])

    def _one(self, aggregate: Aggregate):
        return self.aggregates(value=aggregate).first()["value"]

    def sum(self, column):
        return self._one(Aggregate("sum", name_of(column)))

    def avg(self, column):
        return self._one(Aggregate("avg", name_of(column)))

    def min(self, column):
        return self._one(Aggregate("min", name_of(column)))

    def max(self, column):
        return self._one(Aggregate("max", name_of(column)))

    def count_distinct(self, column) -> int:
        return self._one(Aggregate("count_distinct", name_of(column)))

    def plucked(self, column) -> DataFrame:
        """One column as a DataFrame. With distinct, each value once, where its first row stands in the order."""
        if self.clauses.unions:
            return self.frame().select(_last(column))
        if not self.clauses.distinct or not self.clauses.order_by:
            return self._with(select=names_of(column), raw_select=(), subselects=()).frame()
        return Compiled(self).distinct_values(name_of(column))

    def pluck(self, column) -> list:
        return [r[0] for r in self.plucked(column).collect()]

    def value(self, column):
        rows = self._with(select=names_of(column), raw_select=(), subselects=()).limit(1).frame().collect()
        return rows[0][0] if rows else None

    def paginate(self, page: int, per_page: int) -> Page:
        page_offset(page, per_page)
        query = self
        if not self.clauses.order_by:
            for key in self.model.primary_key:
                query = query.order_asc(f"{self.model.table}.{key}")
        return Page(query.page(page, per_page).frame().collect(), self.count(), page, per_page)

    def _keyset(self, after=None, inclusive: bool = False) -> Query:
        """The query in the order of its key, from ``after`` on. An order of its own must be by the key, in one direction."""
        c, keys = self.clauses, [f"{self.model.table}.{k}" for k in self.model.primary_key]
        if c.offset is not None or c.unions or c.group_by or c.having or c.windows or c.distinct:
            raise QueryError("batches by key go with filters and joins only")
        if not keys:
            raise QueryError(f"{self.model.table} has no primary key")
        if c.select is not None and not set(self.model.primary_key) <= {s.split(".")[-1] for s in c.select}:
            raise QueryError("batches by key need the key among the selected columns")
        order = [(kind, _last(name), descending) for kind, name, descending in c.order_by]
        descending = bool(order) and order[0][2]
        if order and order != [("column", k, descending) for k in self.model.primary_key]:
            raise QueryError("batches by key can be ordered by the key only, in one direction")
        query, beyond = self._with(order_by=()), "lt" if descending else "gt"
        if after is not None:
            options = []
            for i, key in enumerate(keys):  # (a, b) > (x, y) as a > x or (a = x and b > y)
                options.append(Group(False, (*(Condition(k, "eq", (v,)) for k, v in zip(keys[:i], after)), Condition(key, beyond, (after[i],)))))
            if inclusive:
                options.append(Group(False, tuple(Condition(k, "eq", (v,)) for k, v in zip(keys, after))))
            query = query._and(Group(True, tuple(options)))
        for key in keys:
            query = query.order_by(key, "desc" if descending else "asc")
        return query

    def cursor_page(self, per_page: int, cursor: str | None = None) -> Query:
        """The keyset query of a page: the rows after the cursor, in the order of the primary key."""
        if self.clauses.limit is not None:
            raise QueryError("a cursor page has its own limit")
        return self._keyset(*(self._cursor(cursor) or ())).limit(per_page)

    def _cursor(self, cursor: str | None) -> tuple[list, bool] | None:
        """The key that a cursor names, and whether the page starts at it. A bare key is one to start after."""
        if cursor is None:
            return None
        try:
            found = json.loads(base64.urlsafe_b64decode(cursor.encode() + b"=" * (-len(cursor) % 4)))
        except ValueError:
            found = None
        if isinstance(found, list) and len(found) == 2 and isinstance(found[0], list) and isinstance(found[1], bool):
            key, inclusive = found
        else:
            key, inclusive = found, False
        if not isinstance(key, list) or len(key) != len(self.model.primary_key) or not all(isinstance(v, (str, int, float)) for v in key):
            raise QueryError("the cursor is not one of this query")
        return key, inclusive

    def cursor_paginate(self, per_page: int, cursor: str | None = None) -> CursorPage:
        """A page of rows by key. The rows that a join makes of one key are on one page; a full page at the very end is
        followed by an empty one."""
        if self.clauses.limit is not None:
            raise QueryError("a cursor page has its own limit")
        for rows, after in self._batches(per_page, self._cursor(cursor)):
            if after is None:
                return CursorPage(rows, None)
            return CursorPage(rows, base64.urlsafe_b64encode(json.dumps(after, default=str).encode()).decode().rstrip("="))
        return CursorPage([], None)

    def chunks(self, size: int) -> Iterator[list[Row]]:
        """Batches of rows by key, ascending or as the query is ordered by its key. The rows that a join makes of one key
        stay in one batch, so a key with more rows than a batch holds is an error; limit() bounds all. See _Ahead for what
        is read when; batched() has the same batches as a DataFrame."""
        return (rows for rows, _ in self._batches(size, None))

    def batched(self, size: int, alias: str = "batch") -> DataFrame:
        """The rows of chunks() with the number of their batch, from 0, as a DataFrame: they are numbered in Spark, none
        comes to the driver. With a join it takes a walk over the runs to tell where a batch ends: such queries have chunks()."""
        if size < 1:
            raise QueryError("a batch has a row at least")
        if self.clauses.joins:
            raise QueryError("batches of a join are told by chunks() only")
        base = self._with(limit=None)._keyset()
        nth = W.row_number("_nth")
        for _, name, descending in base.clauses.order_by:
            nth = nth.order_by(name, descending)
        df = base._with(order_by=()).window(nth).frame()
        if self.clauses.limit is not None:
            df = df.where(F.col("_nth") <= self.clauses.limit)
        if alias in df.columns:
            raise QueryError(f"the rows have a column {alias}")
        return df.withColumn(alias, F.floor((F.col("_nth") - 1) / size).cast("bigint")).drop("_nth")

    def _batches(self, size: int, cursor: tuple | None) -> Iterator[tuple[list[Row], tuple | None]]:
        """Batches, each with the cursor that goes on after it, if rows may follow."""
        if size < 1:
            raise QueryError("a batch has a row at least")
        left, base = self.clauses.limit, self._with(limit=None)
        base._keyset()
        ahead = _Ahead(base)
        while left is None or left > 0:
            want = size if left is None else min(size, left)
            rows = ahead.read(want, cursor, left)
            if not rows:
                return
            full, last, inclusive = len(rows) == want, ahead.key(rows[-1]), False
            if full and self.clauses.joins and (left is None or left > want):
                whole = [r for r in rows if ahead.key(r) != last]
                if whole:
                    ahead.give_back(rows[len(whole) :])
                    rows, inclusive = whole, True
                elif ahead.more_of(last, size):
                    raise QueryError(f"more rows have the key {last} than a batch of {size} holds")
            left = None if left is None else left - len(rows)
            cursor = (last, inclusive) if full and (left is None or left > 0) else None
            yield rows, cursor
            if cursor is None:
                return

    def chunk(self, size: int, callback: Callable[[list[Row]], None]) -> None:
        for rows in self.chunks(size):
            callback(rows)

    # relations and changes

    def with_(self, *paths: str):
        from brindle.operators.relations import Eager

        return Eager(self).with_(*paths)

    def update_all(self):
        from brindle.operators.mutations import Update

        return Update(self)

    def delete(self):
        from brindle.operators.mutations import delete

        return delete(self)

    def delete_all(self):
        from brindle.operators.mutations import delete_all

        return delete_all(self)

    def soft_delete(self):
        from brindle.operators.mutations import soft_delete

        return soft_delete(self)

    def restore(self):
        from brindle.operators.mutations import restore

        return restore(self)

    def force_delete(self):
        from brindle.operators.mutations import force_delete

        return force_delete(self)

    def search(self, columns, text: str):
        from brindle.operators.fulltext import Search

        return Search(self, names_of(columns), text)

    def projection_outputs(self) -> list[str]:
        """The names of the columns that the query returns, without running it."""
        return Compiled(self, dry=True).frame().columns

    def preview(self) -> str:
        """The query as Spark has analysed it, without running it: one relational operator a line."""
        return Compiled(self, dry=True).frame()._jdf.queryExecution().analyzed().toString()

    def debug(self) -> dict:
        """The clauses by name, where they are set."""
        empty = Clauses()
        return {k: v for k, v in vars(self.clauses).items() if v != getattr(empty, k)} | {"table": self.model.table}

    def plan(self, mode: str = "formatted") -> str:
        """The physical plan as text."""
        df = self.frame()
        return df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), mode)


class _Ahead:
    """The rows of a query in the order of its key, for batches. The first batch is a job of its own. What follows it is
    sorted once, and the sort's partitions are read one after the other, so that small batches don't read the tables again
    and again; the driver holds one partition. A change made through the handle between two batches is seen by the next
    one, which then is a job of its own again."""

    #: Rows that a limit may leave to be taken without a sort of all.
    FEW = 1000

    def __init__(self, query: Query):
        self.query, self.changes, self.rows, self.held = query, None, None, []

    def key(self, row: Row) -> list:
        return [row[k] for k in self.query.model.primary_key]

    def read(self, n: int, cursor: tuple | None, left: int | None) -> list[Row]:
        """The next ``n`` rows, which are those from the cursor on."""
        query, changes = self.query._keyset(*(cursor or ())), self.query.db.changes
        if self.changes != changes:
            self.changes, self.rows, self.held = changes, None, []
            return query.limit(n).frame().collect()
        if self.rows is None:
            few = left is not None and left <= self.FEW
            self.rows = iter((query.limit(left) if few else query).frame().toLocalIterator())
        rows = [*self.held, *islice(self.rows, n - len(self.held))]
        self.held = []
        return rows

    def give_back(self, rows: list[Row]) -> None:
        """Rows that the next batch begins with."""
        if self.rows is not None:
            self.held = rows

    def more_of(self, key: list, n: int) -> bool:
        """Whether the key, to which the last ``n`` rows read belong, has more."""
        if self.rows is None:
            return len(self.query._with(order_by=())._by_key(key).limit(n + 1).frame().collect()) > n
        self.held = list(islice(self.rows, 1))
        return bool(self.held) and self.key(self.held[0]) == key


def _last(column) -> str:
    return name_of(column).split(".")[-1]


def query(model: Model, db: Database | None = None) -> Query:
    """A query over a model's live rows."""
    return Query(model, db or current())
