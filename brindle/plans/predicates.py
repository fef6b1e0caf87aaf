"""Conditions on rows. One table of operators serves every family of filter methods, so the families can't differ."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brindle.errors import QueryError
from brindle.functions import json_rules
from brindle.functions.coerce import literal


@dataclass(frozen=True)
class Scope:
    """What names mean inside a query: ``column(name)`` and ``kind(name)`` for its type, ``is_json(name)``; and ``expr(sql)`` for fragments."""

    column: Callable[[str], Column]
    kind: Callable[[str], T.DataType | None]
    is_json: Callable[[str], bool]
    expr: Callable[[str], Column] = F.expr


def _needs_value(value) -> None:
    if value is None:
        raise QueryError("NULL has no order: compare with = or <> instead")


def _compare(op: Callable[[Column, Column], Column]):
    def build(scope: Scope, name: str, value) -> Column:
        _needs_value(value)
        return op(scope.column(name), literal(value, scope.kind(name)))

    return build


def _eq(scope: Scope, name: str, value) -> Column:
    if value is None:
        return scope.column(name).isNull()
    if scope.is_json(name):
        return json_rules.equals(json_rules.parsed(scope.column(name)), json_rules.document(value))
    return scope.column(name) == literal(value, scope.kind(name))


def _ne(scope: Scope, name: str, value) -> Column:
    c = scope.column(name)
    if value is None:
        return c.isNotNull()
    if scope.is_json(name):
        return json_rules.differs(json_rules.parsed(c), json_rules.document(value))
    return c != literal(value, scope.kind(name))


def _in(scope: Scope, name: str, values: Sequence) -> Column:
    values = list(values)
    c, rest = scope.column(name), [literal(v, scope.kind(name)) for v in values if v is not None]
    found = c.isin(*rest) if rest else F.lit(False)
    return found | c.isNull() if None in values else found


def _not_in(scope: Scope, name: str, values: Sequence) -> Column:
    values = list(values)
    c, rest = scope.column(name), [literal(v, scope.kind(name)) for v in values if v is not None]
    if not values:
        return F.lit(True)
    out = ~c.isin(*rest) if rest else F.lit(True)
    return out & c.isNotNull()


def _between(scope: Scope, name: str, low, high) -> Column:
    _needs_value(low)
    _needs_value(high)
    return scope.column(name).between(literal(low, scope.kind(name)), literal(high, scope.kind(name)))


def _columns(op: Callable[[Column, Column], Column]):
    return lambda scope, name, other: op(scope.column(name), scope.column(other))


def _element(scope: Scope, name: str) -> T.DataType | None:
    kind = scope.kind(name)
    return kind.elementType if isinstance(kind, T.ArrayType) else None


def _same(value: Column) -> Callable[[Column], Column]:
    return lambda x: x.eqNullSafe(value)


def _array_contains(scope: Scope, name: str, values: Sequence) -> Column:
    c, kind = scope.column(name), _element(scope, name)
    held = [F.exists(c, _same(literal(v, kind))) for v in values]
    return c.isNotNull() & reduce(lambda a, b: a & b, held, F.lit(True))


def _array_contained_by(scope: Scope, name: str, values: Sequence) -> Column:
    c, kind, values = scope.column(name), _element(scope, name), list(values)
    listed = [literal(v, kind) for v in values]
    return c.isNotNull() & F.forall(c, lambda x: reduce(lambda a, b: a | b, [x.eqNullSafe(v) for v in listed], F.lit(False)))


def _array_overlaps(scope: Scope, name: str, values: Sequence) -> Column:
    c, kind = scope.column(name), _element(scope, name)
    listed = [literal(v, kind) for v in values]
    return c.isNotNull() & F.exists(c, lambda x: reduce(lambda a, b: a | b, [x.eqNullSafe(v) for v in listed], F.lit(False)))


def _json(rule: Callable[..., Column]):
    return lambda scope, name, value: rule(json_rules.parsed(scope.column(name)), json_rules.document(value))


#: Conditions by the last part of the method's name: where_<name>, or_where_<name>, and_where_<name>.
OPERATORS: dict[str, Callable[..., Column]] = {
    "eq": _eq,
    "not": _ne,
    "ne": _ne,
    "gt": _compare(lambda a, b: a > b),
    "gte": _compare(lambda a, b: a >= b),
    "lt": _compare(lambda a, b: a < b),
    "lte": _compare(lambda a, b: a <= b),
    "in": _in,
    "not_in": _not_in,
    "between": _between,
    "not_between": lambda s, n, low, high: ~_between(s, n, low, high),
    "like": lambda s, n, p: s.column(n).like(p),
    "not_like": lambda s, n, p: ~s.column(n).like(p),
    "contains": lambda s, n, v: s.column(n).contains(F.lit(str(v))),
    "starts_with": lambda s, n, v: s.column(n).startswith(F.lit(str(v))),
    "ends_with": lambda s, n, v: s.column(n).endswith(F.lit(str(v))),
    "null": lambda s, n: s.column(n).isNull(),
    "not_null": lambda s, n: s.column(n).isNotNull(),
    "column_eq": _columns(lambda a, b: a == b),
    "column_ne": _columns(lambda a, b: a != b),
    "column_gt": _columns(lambda a, b: a > b),
    "column_gte": _columns(lambda a, b: a >= b),
    "column_lt": _columns(lambda a, b: a < b),
    "column_lte": _columns(lambda a, b: a <= b),
    "json_contains": _json(json_rules.contains),
    "json_contained_by": _json(json_rules.contained_by),
    "json_key_exists": lambda s, n, k: s.column(n).isNotNull() & json_rules.key_exists(s.column(n), k),
    "json_key_not_exists": lambda s, n, k: s.column(n).isNotNull() & ~json_rules.key_exists(s.column(n), k),
    "json_path_exists": lambda s, n, p: s.column(n).isNotNull() & json_rules.path_exists(s.column(n), p),
    "json_path_not_exists": lambda s, n, p: s.column(n).isNotNull() & ~json_rules.path_exists(s.column(n), p),
    "array_contains": _array_contains,
    "array_contained_by": _array_contained_by,
    "array_overlaps": _array_overlaps,
}

#: Names of the conditions that a model's columns build.
CONDITIONS = {k: k for k in OPERATORS} | {"is_null": "null", "is_not_null": "not_null", "is_in": "in"}

#: Operators that every row may pass; see excludes_nothing.
_LISTS = {"not_in"}


@dataclass(frozen=True)
class Condition:
    name: str
    operator: str
    args: tuple = ()

    def build(self, scope: Scope) -> Column:
        return OPERATORS[self.operator](scope, self.name, *self.args)

    def excludes_nothing(self) -> bool:
        """True for a filter that holds on every row by its form: NOT IN an empty list."""
        return self.operator in _LISTS and not list(self.args[0])


@dataclass(frozen=True)
class Raw:
    """A trusted SQL fragment with ? for values."""

    sql: str
    params: tuple = ()

    def build(self, scope: Scope) -> Column:
        return scope.expr(bound(self.sql, self.params))

    def excludes_nothing(self) -> bool:
        return bool(re.fullmatch(r"\s*\(*\s*(true|1\s*=\s*1)\s*\)*\s*", self.sql, re.I))


@dataclass(frozen=True)
class Group:
    """Conditions joined by AND or OR. An empty group holds on every row."""

    any: bool
    members: tuple = field(default=())

    def build(self, scope: Scope) -> Column:
        built = [m.build(scope) for m in self.members]
        return reduce((lambda a, b: a | b) if self.any else (lambda a, b: a & b), built) if built else F.lit(True)

    def excludes_nothing(self) -> bool:
        test = any if self.any else all
        return not self.members or test(m.excludes_nothing() for m in self.members)


@dataclass(frozen=True)
class InQuery:
    """A column's value is among the rows of a query of one column. Kept out, by SQL's NULLs: a NULL among them leaves no row."""

    name: str
    query: object
    keep: bool = True

    def build(self, scope: Scope) -> Column:
        found = scope.column(self.name).isin(self.query.frame())
        return found if self.keep else ~found

    def excludes_nothing(self) -> bool:
        return False


@dataclass(frozen=True)
class Exists:
    """A query has rows; with ``foreign`` and ``local``, rows whose column ``foreign`` is the outer row's ``local``."""

    query: object
    keep: bool = True
    foreign: str | None = None
    local: str | None = None

    def build(self, scope: Scope) -> Column:
        frame = self.query.frame()
        if self.foreign:
            frame = frame.where(F.col(self.foreign) == scope.column(self.local).outer())
        return frame.exists() if self.keep else ~frame.exists()

    def excludes_nothing(self) -> bool:
        return False


@dataclass(frozen=True)
class Related:
    """A table, by its name, has a row whose column ``foreign`` is the outer row's ``local`` and that meets ``condition``, a column and its value."""

    db: object
    table: str
    foreign: str
    local: str
    condition: tuple = ()
    keep: bool = True

    def build(self, scope: Scope) -> Column:
        frame = self.db.table(self.table)
        if self.condition:
            column, value = self.condition
            frame = frame.where(F.col(column).isNull() if value is None else F.col(column) == literal(value, frame.schema[column].dataType))
        found = frame.where(F.col(self.foreign) == scope.column(self.local).outer()).exists()
        return found if self.keep else ~found

    def excludes_nothing(self) -> bool:
        return False


@dataclass(frozen=True)
class Built:
    """A condition that makes its column itself."""

    make: Callable[[Scope], Column]

    def build(self, scope: Scope) -> Column:
        return self.make(scope)

    def excludes_nothing(self) -> bool:
        return False


def pieces(sql: str) -> list[tuple[str, str]]:
    """A fragment as (kind, text) in order; kinds: code, quote, comment."""
    token = re.compile(r"(?P<quote>'(?:[^'\\]|\\.|'')*'|\"(?:[^\"\\]|\\.|\"\")*\"|`[^`]*`)|(?P<comment>--[^\n]*|/\*.*?(?:\*/|\Z))", re.S)
    out, at = [], 0
    for m in token.finditer(sql):
        out += [("code", sql[at : m.start()]), (m.lastgroup, m[0])]
        at = m.end()
    return [p for p in [*out, ("code", sql[at:])] if p[1]]


#: Words that begin or join statements: an expression may not hold one outside parentheses, unless it is a call.
REFUSED = frozenset("insert update delete drop alter create truncate grant revoke merge union intersect except into".split())
#: Words that a raw query may not hold outside parentheses, unless it is a call.
REFUSED_IN_QUERIES = frozenset("insert update delete drop alter create truncate returning merge replace upsert grant revoke call execute values".split())


def _outer_words(sql: str) -> list[tuple[str, bool]]:
    """The lower-case words outside quotes and parentheses, and whether each is a call; raises what no fragment may have."""
    depth, found = 0, []
    for kind, text in pieces(sql):
        if kind == "comment":
            raise QueryError("comments are not allowed in a fragment")
        if kind == "code":
            if ";" in text or text.count("'") or text.count('"'):
                raise QueryError("a fragment is one expression, with its quotes closed")
            for m in re.finditer(r"[A-Za-z_]\w*|[()]", text):
                depth += (m[0] == "(") - (m[0] == ")")
                if depth < 0:
                    raise QueryError("a fragment's parentheses must match")
                if depth == 0 and m[0] != ")":
                    found.append((m[0].lower(), text[m.end() :].lstrip().startswith("(")))
    if depth:
        raise QueryError("a fragment's parentheses must match")
    return found


def checked(sql: str) -> str:
    """The fragment, if it is an expression by its form: no comments, no statement ends, no statements or set operations at the top."""
    for word, called in _outer_words(sql):
        if word in REFUSED and not called:
            raise QueryError(f"{word.upper()} is not allowed in a fragment")
    return sql


def checked_query(sql: str, sets: bool = True) -> str:
    """The raw query, if it is one SELECT (or WITH ... SELECT) by its form; ``sets``: whether it may unite others."""
    words = _outer_words(sql)
    if not words or words[0][0] not in ("select", "with") or all(w != "select" for w, _ in words):
        raise QueryError("a raw query is a SELECT, or WITH and a SELECT")
    for word, called in words:
        if not called and (word in REFUSED_IN_QUERIES or (not sets and word in ("union", "intersect", "except"))):
            raise QueryError(f"{word.upper()} is not allowed in a raw query")
    return sql


def sql_literal(value) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return "TRUE" if value else "FALSE"
    if isinstance(value, (int, float)) or type(value).__name__ == "Decimal":
        return f"CAST({value!r} AS DOUBLE)" if isinstance(value, float) else str(value)
    if type(value).__name__ == "datetime":
        return f"TIMESTAMP_NTZ'{value.isoformat(sep=' ')}'"
    if type(value).__name__ == "date":
        return f"DATE'{value.isoformat()}'"
    return "'" + str(value).replace("\\", "\\\\").replace("'", "\\'") + "'"


def bound(sql: str, params: Sequence) -> str:
    """The checked fragment with a literal for each ? outside quotes; their numbers must agree."""
    values, out = list(params), []
    for kind, text in pieces(checked(sql)):
        if kind == "code":
            parts = text.split("?")
            if len(parts) - 1 > len(values):
                raise QueryError("fewer values than placeholders")
            for part in parts[:-1]:
                out += [part, sql_literal(values.pop(0))]
            out.append(parts[-1])
        else:
            out.append(text)
    if values:
        raise QueryError("more values than placeholders")
    return "".join(out)
