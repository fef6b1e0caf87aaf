"""Single rows: thin wrappers around one-row changes, and a parent saved with its children."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Row
from pyspark.sql import functions as F

from brindle.errors import NotFound, QueryError
from brindle.functions.coerce import coerce
from brindle.functions.text import violations
from brindle.operators.mutations import insert_all
from brindle.query import Query


@dataclass(frozen=True)
class Rows:
    """Rows of a model in a database. ``rules`` are validated before a row is written (see functions.text.valid)."""

    db: object
    model: object
    rules: dict | None = None

    def _query(self) -> Query:
        return Query(self.model, self.db)

    def _key(self, row: dict) -> tuple:
        return tuple(row.get(k) for k in self.model.primary_key)

    def _checked(self, row: dict) -> dict:
        unknown = set(row) - set(self.model.names)
        if unknown:
            raise QueryError(f"{self.model.table} has no column {', '.join(sorted(unknown))}")
        made = {f.name: coerce(row.get(f.name), f.dataType) for f in self.model.schema.fields}
        if self.rules:
            one = self.db.spark.createDataFrame([tuple(made.values())], self.model.schema)
            broken = one.select(violations(self.rules)).first()[0]
            if broken:
                raise QueryError("; ".join(broken))
        return made

    def create(self, row: dict) -> dict:
        """Append a row; a single whole-number key that is missing is the largest one plus 1."""
        row = self._checked(row)
        if len(self.model.primary_key) == 1 and row[self.model.primary_key[0]] is None:
            key = self.model.primary_key[0]
            row[key] = (self.db.table(self.model.table).agg(F.max(key)).first()[0] or 0) + 1
        if self.exists(self._key(row)):
            raise QueryError(f"{self.model.table} has a row with key {self._key(row)}")
        insert_all(self.db, self.model, [tuple(row.values())]).execute()
        return row

    def exists(self, key) -> bool:
        return self._query().with_trashed()._by_key(key).exists()

    def update(self, row: dict) -> dict:
        """Write every column of a stored row."""
        row = self._checked(row)
        change = self._query().with_trashed()._by_key(self._key(row)).update_all()
        for name, value in row.items():
            change = change.set(name, value)
        if not change.execute():
            raise NotFound(f"no {self.model.table} with key {self._key(row)}")
        return row

    def save(self, row: dict) -> dict:
        """Update the row if its key is stored, else create it."""
        key = self._key(row)
        return self.update(row) if None not in key and self.exists(key) else self.create(row)

    def destroy(self, key) -> int:
        """Delete (or stamp) a row by key."""
        return self._query()._by_key(key).delete().execute()

    def reload(self, row: dict) -> Row:
        return self._query().with_trashed()._by_key(self._key(row)).first_or_fail()

    def save_with(self, row: dict, **children: list[dict]) -> dict:
        """Save a row and, by relation, its children, whose foreign key it sets. All is validated before anything is written."""
        plans = []
        for name, listed in children.items():
            relation = self.model.relation(name)
            if relation.kind not in ("has_many", "has_one", "morph_many", "morph_one"):
                raise QueryError(f"{name} has no children to save")
            plans.append((relation, Rows(self.db, relation.related), listed))
        for relation, rows, listed in plans:
            for child in listed:
                rows._checked(child)
        saved = self.save(row)
        for relation, rows, listed in plans:
            extra = {relation.foreign: saved[relation.local]} | ({relation.morph[0]: relation.morph[1]} if relation.morph else {})
            for child in listed:
                rows.save(child | extra)
        return saved
