"""Tables of a database made, altered and dropped, and migrations that do so step by step."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brindle.errors import QueryError
from brindle.model import Model
from brindle.sources.database import Database

#: Where a database notes the migrations that it has run.
MIGRATIONS = Model("schema_migrations", "name string, batch int", ("name",))


@dataclass(frozen=True)
class Schema:
    """Changes of a handle's tables. Like changes of rows they are new frames for the handle; ``Database.save`` writes them."""

    db: Database

    def create_table(self, model: Model) -> None:
        if self.db.has_table(model.table):
            raise QueryError(f"there is a table {model.table}")
        self.db.put(model.table, self.db.spark.createDataFrame([], model.schema))

    def create_table_if_not_exists(self, model: Model) -> bool:
        """Whether the table was made."""
        if self.db.has_table(model.table):
            return False
        self.create_table(model)
        return True

    def drop_table(self, name: str) -> None:
        if name not in self.db.tables:
            raise QueryError(f"{name} is no table that this handle made")
        self.db.drop(name)

    def drop_table_if_exists(self, name: str) -> bool:
        if name not in self.db.tables:
            return False
        self.db.drop(name)
        return True

    def rename_table(self, name: str, new: str) -> None:
        if self.db.has_table(new):
            raise QueryError(f"there is a table {new}")
        self.db.put(new, self.db.table(name))
        if name in self.db.tables:
            self.db.drop(name)

    def add_column(self, table: str, name: str, kind: str | T.DataType, default=None) -> None:
        """Add a column at the end; stored rows have the default."""
        df = self.db.table(table)
        if name in df.columns:
            raise QueryError(f"{table} has a column {name}")
        self.db.put(table, df.withColumn(name, (default if isinstance(default, Column) else F.lit(default)).cast(kind)))

    def drop_column(self, table: str, name: str) -> None:
        df = self._with(table, name)
        self.db.put(table, df.drop(name))

    def rename_column(self, table: str, name: str, new: str) -> None:
        df = self._with(table, name)
        if new in df.columns:
            raise QueryError(f"{table} has a column {new}")
        self.db.put(table, df.withColumnRenamed(name, new))

    def change_column(self, table: str, name: str, kind: str | T.DataType) -> None:
        """Read a column as another type; what can't be read so is an error when the table is read (ANSI casts)."""
        df = self._with(table, name)
        self.db.put(table, df.withColumn(name, F.col(name).cast(kind)))

    def _with(self, table: str, name: str):
        df = self.db.table(table)
        if name not in df.columns:
            raise QueryError(f"{table} has no column {name}")
        return df

    def sync(self, *models: Model) -> list[str]:
        """Make the tables and columns that models have and the database lacks; returns what was made. Nothing is dropped."""
        made = []
        for model in models:
            if self.create_table_if_not_exists(model):
                made.append(model.table)
                continue
            have = self.db.table(model.table).columns
            for f in model.schema.fields:
                stored = model.renamed.get(f.name, f.name)
                if stored not in have:
                    self.add_column(model.table, stored, f.dataType)
                    made.append(f"{model.table}.{stored}")
        return made


def foreign_keys(model: Model) -> list[tuple[str, str, str]]:
    """(column, table, its column) of every relation by which the model's rows belong to others."""
    return [(r.local, r.related.table, r.foreign) for r in model.relations.values() if r.kind == "belongs_to"]


def schema_sql(models: Sequence[Model]) -> str:
    """CREATE TABLE for every model, owners before what belongs to them where that is possible."""
    names, done, todo = {m.table for m in models}, [], sorted(models, key=lambda m: m.table)
    while todo:
        ready = [m for m in todo if all(t == m.table or t not in names or t in {d.table for d in done} for _, t, _ in foreign_keys(m))] or todo[:1]
        done += ready
        todo = [m for m in todo if m not in ready]
    return ";\n".join(Database.ddl(m) for m in done) + ";\n"


@dataclass(frozen=True)
class Migration:
    name: str
    up: Callable[[Schema], None]
    down: Callable[[Schema], None] | None = None


@dataclass(frozen=True)
class Migrator:
    """Migrations in the order of their names. Each is run once, whole or not at all, and noted in the table MIGRATIONS."""

    db: Database
    migrations: tuple[Migration, ...]

    def _noted(self) -> dict[str, int]:
        Schema(self.db).create_table_if_not_exists(MIGRATIONS)
        return {r["name"]: r["batch"] for r in self.db.table(MIGRATIONS.table).collect()}

    def status(self) -> list[tuple[str, bool]]:
        noted = self._noted()
        return [(m.name, m.name in noted) for m in sorted(self.migrations, key=lambda m: m.name)]

    def run(self) -> list[str]:
        """Run what has not been run; returns the names."""
        noted, ran = self._noted(), []
        batch = max(noted.values(), default=0) + 1
        for m in sorted(self.migrations, key=lambda m: m.name):
            if m.name not in noted:
                with self.db.transaction():
                    m.up(Schema(self.db))
                    self._note({**noted, **dict.fromkeys(ran, batch), m.name: batch})
                ran.append(m.name)
        return ran

    def rollback(self) -> list[str]:
        """Take back the last batch, latest first; returns the names."""
        noted = self._noted()
        last, back = max(noted.values(), default=0), []
        for m in sorted(self.migrations, key=lambda m: m.name, reverse=True):
            if noted.get(m.name) == last:
                if m.down is None:
                    raise QueryError(f"{m.name} can't be taken back")
                with self.db.transaction():
                    m.down(Schema(self.db))
                    noted.pop(m.name)
                    self._note(noted)
                back.append(m.name)
        return back

    def _note(self, noted: dict[str, int]) -> None:
        self.db.put(MIGRATIONS.table, self.db.spark.createDataFrame(sorted(noted.items()), MIGRATIONS.schema))


def seed(db: Database, *seeders: Callable[[Database], None]) -> int:
    """Run seeders in order, all or none; returns their number."""
    with db.transaction():
        for seeder in seeders:
            seeder(db)
    return len(seeders)
