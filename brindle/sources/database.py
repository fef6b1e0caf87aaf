"""A handle on a set of tables: scans, raw SQL, catalogue and sinks."""

from __future__ import annotations

import re
from collections import deque
from collections.abc import Callable, Sequence
from contextlib import contextmanager
from contextvars import ContextVar
from itertools import count

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brindle.errors import QueryError
from brindle.plans.predicates import pieces
from brindle.sources.result_cache import ResultCache

_numbers = count()
_current: ContextVar[Database | None] = ContextVar("database", default=None)


class Database:
    """Tables under a folder of Parquet (``root``/name.parquet), tables of the session's catalogue, and DataFrames
    that were put here by name, which come first.

    Parquet files have no row-level changes: a change is a new DataFrame for the whole table, which
    ``put`` makes the table's content for this handle; ``save`` writes it.
    """

    backend = "spark"

    def __init__(self, spark: SparkSession, root: str | None = None, tables: dict[str, DataFrame] | None = None):
        self.spark, self.root, self.tables = spark, root.rstrip("/") if root else None, dict(tables or {})
        self.number, self.cache, self._views = next(_numbers), ResultCache(), count()
        self.journal = None  # an operators.journal.Journal hears of every terminal
        self.rules = None  # operators.advice.Rules that every read must keep
        self.changes = 0  # how often a table may have changed through this handle
        self._files: set[str] | None = None
        self._held: deque[str] = deque()

    def table(self, name: str) -> DataFrame:
        if name in self.tables:
            return self.tables[name]
        if self.root is not None:
            return self.spark.read.parquet(f"{self.root}/{name}.parquet")
        return self.spark.table(name)

    def put(self, name: str, df: DataFrame) -> None:
        self.tables[name] = df
        self.forget(name)

    def forget(self, name: str) -> None:
        """Drop cached results that read the table."""
        self.changes += 1
        self.cache.invalidate_table(name)

    def drop(self, name: str) -> None:
        """Take a table that was put here away."""
        self.tables.pop(name, None)
        self.forget(name)

    # transactions: what a handle holds is a set of immutable frames, so a snapshot of it is all that a rollback needs

    @contextmanager
    def transaction(self):
        """Changes made inside hold together: an error takes back all of them. A transaction inside another is a savepoint."""
        before = dict(self.tables)
        try:
            yield self
        except BaseException:
            self.rollback(before)
            raise

    def rollback(self, before: dict[str, DataFrame]) -> None:
        for name in {*self.tables, *before}:
            if self.tables.get(name) is not before.get(name):
                self.forget(name)
        self.tables = before

    def atomically(self, work: Callable[[Database], object], retries: int = 0, on: type[Exception] | tuple = ()):
        """The result of ``work`` in a transaction, tried again up to ``retries`` times after errors of the kinds ``on``."""
        for left in range(retries, -1, -1):
            try:
                with self.transaction():
                    return work(self)
            except on or ():
                if not left:
                    raise
        raise AssertionError("unreachable")

    @contextmanager
    def test_transaction(self):
        """A transaction that is always taken back."""
        before = dict(self.tables)
        try:
            yield self
        finally:
            self.rollback(before)

    def save(self, name: str, path: str, mode: str = "error", partition_by: Sequence[str] = ()) -> None:
        self.changes += 1
        self.table(name).write.mode(mode).partitionBy(*partition_by).parquet(path)

    def ping(self) -> bool:
        return self.spark.range(1).count() == 1

    @contextmanager
    def pin_session(self):
        """This handle, whose statements all run in one Spark session in any case."""
        yield self

    @contextmanager
    def scope(self):
        """Queries that name no database use this one inside."""
        token = _current.set(self)
        try:
            yield self
        finally:
            _current.reset(token)

    # raw SQL

    def raw(self, sql: str, params: Sequence | dict | None = None, schema: str | T.StructType | None = None, more: dict[str, DataFrame] | None = None) -> DataFrame:
        """The rows of a statement. ``?`` or ``:name`` take params; a schema casts and orders the columns; ``more`` are
        frames that the statement may name beside this handle's tables."""
        df = self.spark.sql(self.local(sql, more), args=params or None)
        if schema is None:
            return df
        wanted = schema if isinstance(schema, T.StructType) else T.StructType.fromDDL(schema)
        missing = [f.name for f in wanted.fields if f.name not in df.columns]
        if missing:
            raise QueryError(f"the statement returns no {', '.join(missing)}")
        return df.select([df[f.name].cast(f.dataType).alias(f.name) for f in wanted.fields])

    def raw_json(self, sql: str, params: Sequence | dict | None = None) -> DataFrame:
        """The rows of a statement as JSON texts: one column, ``json``."""
        df = self.raw(sql, params)
        return df.select(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns])).alias("json"))

    def raw_models(self, model, sql: str, params: Sequence | dict | None = None) -> DataFrame:
        return self.raw(sql, params, model.schema)

    def execute(self, sql: str, params: Sequence | dict | None = None) -> int:
        """Run a statement that the session's catalogue supports; the affected rows if it tells them, else 0. Rows that a
        query returns are counted, not collected."""
        df = self.spark.sql(self.local(sql), args=params or None)
        if re.match(r"\s*(select|with|values|table|from)\b", sql, re.I):
            return df.count()
        self.changes += 1
        row = df.first() if df.columns else None
        return int(row[0]) if row and isinstance(row[0], int) else 0

    def named(self, sql: str, more: Sequence[str] = ()) -> list[str]:
        """The tables of this handle that a statement may name: its words outside quotes that are names of tables, in any case."""
        words = {w.lower() for kind, text in pieces(sql) if kind == "code" or text.startswith("`") for w in re.findall(r"(?<![.\w])[A-Za-z_]\w*", text)}
        return sorted(t for t in {*self.tables, *more, *self._stored()} if t.lower() in words)

    def local(self, sql: str, more: dict[str, DataFrame] | None = None) -> str:
        """The statement with a common table for each of this handle's tables that it names: they come before all that the
        session has under the same names, and leave nothing behind under those. Each stands for a view with a name of its own."""
        more = more or {}
        own = {w.lower() for w in re.findall(r"(?:\bwith(?:\s+recursive)?|,)\s+([A-Za-z_]\w*)\s*(?:\([^()]*\))?\s+as\s*\(", sql, re.I)}
        listed = [f"{name} AS (SELECT * FROM {self._view(more[name] if name in more else self.table(name))})" for name in self.named(sql, tuple(more)) if name.lower() not in own]
        if not listed:
            return sql
        made = ", ".join(listed)
        head = re.match(r"(\s*with\s+)(recursive\s+)?", sql, re.I)
        if head:
            return f"WITH {head[2] or ''}{made}, {sql[head.end() :]}"
        if re.match(r"\s*(create|replace)\b", sql, re.I):
            return re.sub(r"\bAS\s+(?=select\b|\()", lambda m: f"AS WITH {made} ", sql, count=1, flags=re.I)
        return f"WITH {made} {sql}" if re.match(r"\s*(\(|select|from|values|table|insert|delete|update|merge)", sql, re.I) else sql

    def local_fragment(self, sql: str, more: dict[str, DataFrame] | None = None) -> str:
        """An expression whose subqueries read this handle's tables."""
        if not re.search(r"\(\s*select\b", sql, re.I):
            return sql
        return "".join(re.sub(r"\((\s*)(?=select\b)", lambda m: "(" + self._prefix(sql, more), text, flags=re.I) if kind == "code" else text for kind, text in pieces(sql))

    def _prefix(self, sql: str, more: dict[str, DataFrame] | None) -> str:
        made = self.local("SELECT " + " ".join(self.named(sql, tuple(more or ()))), more)
        return made[: made.rindex("SELECT ")]

    def _view(self, df: DataFrame) -> str:
        """A view under a name of its own. A statement is analysed as it is given to Spark, so older views can go."""
        name = f"brindle_{self.number}_{next(self._views)}"
        df.createOrReplaceTempView(name)
        self._held.append(name)
        while len(self._held) > 200:
            self.spark.catalog.dropTempView(self._held.popleft())
        return name

    def _stored(self) -> set[str]:
        """Names of the tables in the folder, listed once."""
        if self._files is None:
            self._files = set()
            if self.root is not None:
                jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
                path = jvm.org.apache.hadoop.fs.Path(self.root)
                names = [f.getPath().getName() for f in path.getFileSystem(conf).listStatus(path)]
                self._files = {n[: -len(".parquet")] for n in names if n.endswith(".parquet")}
        return self._files

    def _exists(self, name: str) -> bool:
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}.parquet")
        return path.getFileSystem(conf).exists(path)

    # catalogue

    def table_names(self) -> list[str]:
        return sorted({*self.tables, *self._stored(), *(t.name for t in self.spark.catalog.listTables() if t.tableType != "TEMPORARY")})

    def views(self) -> list[str]:
        return sorted(t.name for t in self.spark.catalog.listTables() if t.tableType in ("VIEW", "TEMPORARY") and not t.name.startswith("brindle_"))

    def sequences(self) -> list[str]:
        """None: keys of new rows are the largest one plus 1 (operators.rows)."""
        return []

    def enum_types(self) -> list[str]:
        """None: columns of fixed values are strings, with the rule ``in`` (functions.text)."""
        return []

    def indexes(self, name: str) -> list[str]:
        """None: scans skip row groups by Parquet's statistics, and folders by partition columns."""
        self.table(name)
        return []

    def columns(self, name: str) -> list[tuple[str, str, bool]]:
        return [(f.name, f.dataType.simpleString(), f.nullable) for f in self.table(name).schema.fields]

    def has_table(self, name: str) -> bool:
        return name in self.tables or (self.root is not None and self._exists(name)) or self.spark.catalog.tableExists(name)

    def has_column(self, table: str, column: str) -> bool:
        return column in self.table(table).columns

    @staticmethod
    def ddl(model) -> str:
        """CREATE TABLE for a model."""
        rows = [f"  {f.name} {f.dataType.simpleString()}{'' if f.nullable else ' NOT NULL'}" for f in model.schema.fields]
        return f"CREATE TABLE {model.table} (\n" + ",\n".join(rows) + "\n) USING parquet"


def current() -> Database:
    found = _current.get()
    if found is None:
        raise QueryError("no database in scope")
    return found
