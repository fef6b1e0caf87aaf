"""Cached results of queries: the key is all that the query says, the tables are all that it reads."""

from __future__ import annotations

from dataclasses import fields, is_dataclass
from datetime import date, time
from decimal import Decimal
from uuid import UUID

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from brindle.errors import QueryError
from brindle.model import Model
from brindle.sources.database import Database


def content(x) -> str:
    """What a part of a query says, as text: equal for equal parts only. Functions and columns of Spark say nothing that
    could be compared, so a query with one has no key."""
    if x is None or isinstance(x, (bool, int, float, str, bytes, Decimal, date, time, UUID)):
        return f"{type(x).__name__} {x!r}"
    if isinstance(x, T.DataType):
        return x.json()
    if isinstance(x, Model):
        return f"model {x.table} {x.schema.json()} {x.primary_key} {x.soft_delete} {sorted(x.json)} {sorted(x.renamed.items())}"
    if isinstance(x, (tuple, list)):
        return f"[{', '.join(map(content, x))}]"
    if isinstance(x, (set, frozenset)):
        return f"{{{', '.join(sorted(map(content, x)))}}}"
    if isinstance(x, dict):
        return f"{{{', '.join(sorted(f'{content(k)}: {content(v)}' for k, v in x.items()))}}}"
    if isinstance(x, Database):
        return f"database {x.number}"
    if is_dataclass(x) and not isinstance(x, type):
        return f"{type(x).__name__}({', '.join(f'{f.name}={content(getattr(x, f.name))}' for f in fields(x) if f.compare and f.name != 'cache')})"
    raise QueryError(f"a query with {x!r} can't be cached: it has no content to tell it from others")


def key_of(query) -> str:
    return f"{query.clauses.cache[1]} {content(query)}"


def tables_of(query) -> set[str]:
    """Every table that the query reads: its own, those of joins, subqueries, unions and common tables, and those that raw SQL names."""
    found: set[str] = set()

    def walk(x) -> None:
        if isinstance(x, str):
            if "select" in x.lower():
                found.update(query.db.named(x))
        elif isinstance(x, Model):
            found.add(x.table)
        elif isinstance(x, (tuple, list)):
            for y in x:
                walk(y)
        elif is_dataclass(x) and not isinstance(x, type):
            if isinstance(getattr(x, "table", None), str):
                found.add(x.table)
            for f in fields(x):
                if f.name != "db":
                    walk(getattr(x, f.name))

    walk(query)
    return found


def remembered(query) -> DataFrame:
    """The query's frame, persisted until its time is over or a table it reads is changed through the database."""
    seconds, _, tags = query.clauses.cache
    key = key_of(query)
    found = query.db.cache.get(key)
    return found if found is not None else query.db.cache.set(key, query.frame(), seconds, tables_of(query), tags)


def evict(db) -> int:
    """Drop what is over; returns how many."""
    return db.cache.evict_expired()


def clear(db) -> None:
    db.cache.clear()
