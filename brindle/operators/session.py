"""Rows that know what was changed in them, and a unit of work that writes the changes of many at once."""

from __future__ import annotations

from dataclasses import dataclass, field

from brindle.errors import NotFound, QueryError
from brindle.model import Model
from brindle.operators.mutations import insert_or_update
from brindle.plans.predicates import Condition, Group
from brindle.query import Query
from brindle.sources.database import Database


class Tracked(dict):
    """A row by column, which remembers how it was read."""

    def __init__(self, model: Model, row: dict, stored: bool = True):
        super().__init__(row)
        self.model, self.was = model, dict(row) if stored else {}

    @property
    def key(self) -> tuple:
        return tuple(self.get(k) for k in self.model.primary_key)

    def changed(self) -> dict[str, tuple]:
        """Column to (value as read, value now)."""
        return {c: (self.was.get(c), v) for c, v in self.items() if c not in self.was or self.was[c] != v}

    def is_dirty(self, *columns: str) -> bool:
        found = self.changed()
        return any(c in found for c in columns) if columns else bool(found)

    def undo(self) -> None:
        self.clear()
        self.update(self.was)


@dataclass
class Session:
    """A unit of work: each row is one object however often it is found, and flush writes all changes in one transaction, with one
    upsert and one deletion a table."""

    db: Database
    rows: dict = field(default_factory=dict)
    gone: dict = field(default_factory=dict)

    def find(self, model: Model, key) -> Tracked | None:
        key = tuple(key) if isinstance(key, (tuple, list)) else (key,)
        at = (model.table, key)
        if at in self.gone:
            return None
        if at not in self.rows:
            row = Query(model, self.db).find(key)
            if row is None:
                return None
            self.rows[at] = Tracked(model, row.asDict())
        return self.rows[at]

    def find_or_fail(self, model: Model, key) -> Tracked:
        row = self.find(model, key)
        if row is None:
            raise NotFound(f"no {model.table} with key {key!r}")
        return row

    def add(self, model: Model, row: dict) -> Tracked:
        made = Tracked(model, row, stored=False)
        if None in made.key:
            raise QueryError(f"a new row of {model.table} needs its key")
        self.gone.pop((model.table, made.key), None)
        self.rows[model.table, made.key] = made
        return made

    def remove(self, row: Tracked) -> None:
        at = (row.model.table, row.key)
        self.rows.pop(at, None)
        self.gone[at] = row

    def dirty(self) -> list[Tracked]:
        return [r for r in self.rows.values() if r.is_dirty()]

    def flush(self) -> int:
        """Write what changed; returns the number of rows."""
        changed = self.dirty()
        with self.db.transaction():
            for table in sorted({r.model.table for r in changed}):
                listed = [r for r in changed if r.model.table == table]
                model = listed[0].model
                insert_or_update(self.db, model, [tuple(r.get(c) for c in model.names) for r in listed], *model.primary_key).execute()
            for table in sorted({r.model.table for r in self.gone.values()}):
                listed = [r for r in self.gone.values() if r.model.table == table]
                keys = tuple(Group(False, tuple(Condition(k, "eq", (r[k],)) for k in r.model.primary_key)) for r in listed)
                Query(listed[0].model, self.db).where_col(Group(True, keys)).delete().execute()
        n = len(changed) + len(self.gone)
        for r in changed:
            r.was = dict(r)
        self.gone.clear()
        return n

    def clear(self) -> None:
        self.rows.clear()
        self.gone.clear()
