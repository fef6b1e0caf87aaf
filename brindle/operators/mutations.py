"""Bulk changes. A change is a new DataFrame for the whole table plus the rows it touches; nothing is written in place."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field, replace
from datetime import datetime, timezone
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brindle.errors import QueryError
from brindle.functions.coerce import WHOLE, literal
from brindle.plans.compile import Compiled, last
from brindle.plans.predicates import bound
from brindle.query import Alternatives, Filters, Query, name_of, names_of
from brindle.sources.lineage import cut


#: What a change does to a row: leaves it, changes or adds it, takes it away.
LEFT, TOUCHED, REMOVED = 0, 1, 2


@dataclass(frozen=True)
class Change:
    """A change of a table: ``marked`` has its rows afterwards and those taken away, with ``_did``, what was done to each.

    Lazy until it is executed. Then it is written to the checkpoint folder once, so that the rows told, the rows stored and
    the rows of later reads are the same, and plans don't grow with every change.
    """

    db: object
    table: str
    marked: DataFrame

    @property
    def frame(self) -> DataFrame:
        """The table after the change."""
        return self.marked.where(F.col("_did") != REMOVED).drop("_did")

    @property
    def touched(self) -> DataFrame:
        """The rows that it touches, as they are afterwards; for deletions, as they were."""
        return self.marked.where(F.col("_did") != LEFT).drop("_did")

    def _made(self) -> Change:
        done = replace(self, marked=cut(self.marked))
        self.db.put(self.table, done.frame)
        return done

    def execute(self) -> int:
        """Make the change the table's content for its database; returns the number of rows touched."""
        return self._made().touched.count()

    def execute_returning(self) -> list:
        """As execute, with the rows touched: as many as the caller chose to change."""
        return self._made().touched.collect()


def _guard(query: Query, what: str, scope_counts: bool = False) -> None:
    """A bulk change needs a filter that can leave a row out; joins and groups have no place in it."""
    c = query.clauses
    if c.error:
        raise c.error
    if c.joins or c.group_by or c.having or c.unions or c.windows or c.distinct:
        raise QueryError(f"{what} goes with filters only")
    filters = [*c.where, *c.or_where]
    if not filters and not (scope_counts and c.trashed == "only"):
        raise QueryError(f"{what} without a filter would touch the whole table: say so with its _all form")
    if filters and all(f.excludes_nothing() for f in c.where) and (not c.or_where or any(f.excludes_nothing() for f in c.or_where)) and not (scope_counts and c.trashed == "only"):
        raise QueryError(f"the filter of {what} excludes no row")


def _hits(query: Query) -> tuple[DataFrame, Column]:
    """The whole table under the query's name, and the condition of its filters (never NULL)."""
    compiled = Compiled(query)
    compiled._common_tables()
    df = compiled._scan()
    condition = compiled.condition()
    hit = F.lit(True) if condition is None else F.coalesce(condition, F.lit(False))
    c = query.clauses
    if c.limit is None and not c.offset:
        return df, hit
    keys = list(query.model.primary_key)
    if not keys:
        raise QueryError(f"{query.model.table} has no primary key to limit a change by")
    if not c.order_by:
        for key in keys:
            query = query.order_asc(key)
    chosen = query._with(select=tuple(keys), raw_select=()).frame().select(*[F.col(k).alias(f"_k_{k}") for k in keys], F.lit(True).alias("_chosen"))
    on = [F.col(f"{query.model.table}.{k}") == F.col(f"_k_{k}") for k in keys]
    return df.join(chosen, on, "left"), F.coalesce(F.col("_chosen"), F.lit(False))


def _removed(query: Query, what: str, guard: bool = True, scope_counts: bool = False) -> Change:
    if guard:
        _guard(query, what, scope_counts)
    df, hit = _hits(query)
    return Change(query.db, query.model.table, df.select(*query.model.names, F.when(hit, REMOVED).otherwise(LEFT).alias("_did")))


def _now() -> datetime:
    """The moment of a change: one value, whenever its rows are read."""
    return datetime.now(timezone.utc)


def _stamped(query: Query, value: datetime | None, among: Column) -> Change:
    df, hit = _hits(query)
    column, names = query.model.soft_delete, query.model.names
    marked = df.withColumn("_hit", hit & among)
    stamp = F.when(F.col("_hit"), literal(value, query.model.kind_of(column))).otherwise(F.col(column)).alias(column)
    return Change(query.db, query.model.table, marked.select(*[stamp if n == column else F.col(n) for n in names], F.when(F.col("_hit"), TOUCHED).otherwise(LEFT).alias("_did")))


def _needs_soft_delete(query: Query) -> None:
    if not query.model.soft_delete:
        raise QueryError(f"{query.model.table} has no soft delete")


def delete(query: Query) -> Change:
    """Delete the matching live rows; a model with soft delete stamps them."""
    if query.model.soft_delete:
        return soft_delete(query)
    return _removed(query, "delete")


def delete_all(query: Query) -> Change:
    if query.clauses.where or query.clauses.or_where:
        raise QueryError("delete_all takes no filters")
    if query.model.soft_delete:
        return _stamped(query, _now(), F.col(query.model.soft_delete).isNull())
    return _removed(query, "delete_all", guard=False)


def soft_delete(query: Query) -> Change:
    """Stamp live rows; trashed ones keep their stamp."""
    _needs_soft_delete(query)
    _guard(query, "soft_delete")
    return _stamped(query.with_trashed(), _now(), F.col(query.model.soft_delete).isNull())


def restore(query: Query) -> Change:
    """Take the stamp off trashed rows."""
    _needs_soft_delete(query)
    _guard(query, "restore", scope_counts=True)
    return _stamped(query.with_trashed(), None, F.col(query.model.soft_delete).isNotNull())


def force_delete(query: Query) -> Change:
    """Delete for good, trashed rows included."""
    return _removed(query.only_trashed() if query.clauses.trashed == "only" else query.with_trashed(), "force_delete", scope_counts=True)


@dataclass(frozen=True)
class Update(Filters, Alternatives):
    """Assignments to the rows of a query: update_all().set(...)...execute()."""

    query: Query
    assignments: tuple = field(default=())  # (column, function of the scope)

    def _and(self, condition) -> Update:
        return replace(self, query=self.query._and(condition))

    def _or(self, condition) -> Update:
        return replace(self, query=self.query._or(condition))

    def with_trashed(self) -> Update:
        return replace(self, query=self.query.with_trashed())

    def without_trashed(self) -> Update:
        return replace(self, query=self.query.without_trashed())

    def limit(self, n: int) -> Update:
        return replace(self, query=self.query.limit(n))

    def _kind(self, column: str) -> T.DataType:
        kind = self.query.model.kind_of(column)
        if kind is None:
            raise QueryError(f"{self.query.model.table} has no column {column}")
        return kind

    def _assign(self, column, make: Callable[[Column, T.DataType], Column]) -> Update:
        name = last(name_of(column))
        kind = self._kind(name)
        return replace(self, assignments=(*self.assignments, (name, lambda before: make(before, kind).cast(kind))))

    def set(self, column, value) -> Update:
        return self._assign(column, lambda _, kind: literal(value, kind))

    def set_value(self, column, expression: Column) -> Update:
        """Set a column to a Spark expression over the row."""
        return self._assign(column, lambda c, kind: expression)

    def set_trusted_raw(self, column, expression: str, *params) -> Update:
        sql = bound(expression, params)
        return self._assign(column, lambda c, kind: F.expr(sql))

    def increment(self, column, by: int = 1) -> Update:
        return self._assign(column, lambda c, kind: c + F.lit(by).cast(kind))

    def decrement(self, column, by: int = 1) -> Update:
        return self._assign(column, lambda c, kind: c - F.lit(by).cast(kind))

    def _scaled(self, column, by: float, divide: bool) -> Update:
        """Whole numbers scale exactly and round half away from zero; other types scale as they are."""
        if divide and by == 0:
            raise QueryError("division by zero")
        factor = Decimal(str(by))

        def scale(c: Column, kind: T.DataType) -> Column:
            if not isinstance(kind, (*WHOLE, T.DecimalType)):
                return c / F.lit(float(by)) if divide else c * F.lit(float(by))
            exact = F.lit(factor)
            places = kind.scale if isinstance(kind, T.DecimalType) else 0
            wide = c.cast("decimal(38,6)") if not isinstance(kind, T.DecimalType) else c
            return F.round(wide / exact if divide else wide * exact, places)

        return self._assign(column, scale)

    def multiply(self, column, by: float) -> Update:
        return self._scaled(column, by, False)

    def divide(self, column, by: float) -> Update:
        return self._scaled(column, by, True)

    def array_append(self, column, value) -> Update:
        return self._assign(column, lambda c, kind: F.array_append(F.coalesce(c, F.array().cast(kind)), literal(value, kind.elementType)))

    def array_remove(self, column, value) -> Update:
        return self._assign(column, lambda c, kind: F.filter(c, lambda x: ~x.eqNullSafe(literal(value, kind.elementType))))

    def json_set(self, column, path: str, value) -> Update:
        """Set one member of a document of objects, by a path of keys; the members beside it stay as they are.

        Objects on the way that are missing are made; a path through an array or a scalar leaves the document alone.
        """
        import json

        keys = [k for k in path.lstrip("$").split(".") if k]
        if not keys:
            raise QueryError("json_set needs a path")
        text = json.dumps(value, default=str)

        def put(doc: Column, rest: list[str]) -> Column:
            members = F.from_json(doc, "map<string,variant>")
            key, *below = rest
            quoted = lambda k: F.regexp_extract(F.to_json(F.struct(k.alias("k"))), r"^.\"k\":(.*).$", 1)
            others = F.transform(F.filter(F.map_entries(members), lambda e: e["key"] != F.lit(key)), lambda e: F.concat(quoted(e["key"]), F.lit(":"), F.to_json(e["value"])))
            inner = F.to_json(F.element_at(F.map_filter(members, lambda k, v: k == F.lit(key)), key)) if below else None
            new = put(F.coalesce(inner, F.lit("{}")), below) if below else F.lit(text)
            made = F.concat(F.lit("{"), F.array_join(F.concat(others, F.array(F.concat(F.lit(json.dumps(key) + ":"), new))), ","), F.lit("}"))
            return F.when(doc.rlike(r"^\s*\{"), made).otherwise(doc)

        return self._assign(column, lambda c, kind: put(F.coalesce(c, F.lit("{}")), keys))

    def coalesce(self, column, default) -> Update:
        return self._assign(column, lambda c, kind: F.coalesce(c, literal(default, kind)))

    def change(self) -> Change:
        """Assignments see the row as it was, except that one to a column changed before goes on from there."""
        query = self.query
        if query.clauses.error:
            raise query.clauses.error
        df, hit = _hits(query)
        names = query.model.names
        if not self.assignments:
            return Change(query.db, query.model.table, df.select(*names, F.lit(LEFT).alias("_did")))
        new: dict[str, Column] = {}
        for name, make in self.assignments:
            new[name] = make(new.get(name, F.col(name)))
        marked = df.withColumn("_hit", hit)
        out = [F.when(F.col("_hit"), new[n]).otherwise(F.col(n)).alias(n) if n in new else F.col(n) for n in names]
        return Change(query.db, query.model.table, marked.select(*out, F.when(F.col("_hit"), TOUCHED).otherwise(LEFT).alias("_did")))

    def execute(self) -> int:
        return self.change().execute()

    def execute_returning(self) -> list:
        return self.change().execute_returning()


# rows put in


def insert_all(db, model, rows: DataFrame | Sequence) -> Change:
    """Append rows."""
    new = rows if isinstance(rows, DataFrame) else db.spark.createDataFrame(rows, model.schema)
    new = new.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in model.schema.fields])
    return Change(db, model.table, db.table(model.table).select(*model.names, F.lit(LEFT).alias("_did")).unionByName(new.withColumn("_did", F.lit(TOUCHED))))


def insert_many(db, model, rows: DataFrame | Sequence) -> int:
    """Append rows; returns their number."""
    return insert_all(db, model, rows).execute()


@dataclass(frozen=True)
class Upsert:
    """Insert rows, or change stored ones that agree with them in the conflict columns.

    A NULL in a conflict column conflicts with nothing. Of new rows that conflict with each other the last given wins (with
    do_nothing: the first); rows of a DataFrame are given in the order of its partitions.
    """

    db: object
    model: object
    conflict: tuple[str, ...]
    columns: tuple[str, ...] | None = None

    def update_columns(self, *columns) -> Upsert:
        return replace(self, columns=names_of(columns))

    def update_all_except(self, *columns) -> Upsert:
        skip = {*names_of(columns), *self.conflict}
        return replace(self, columns=tuple(n for n in self.model.names if n not in skip))

    def do_nothing(self) -> Upsert:
        return replace(self, columns=())

    def insert(self, rows: DataFrame | Sequence) -> Change:
        if self.model.encrypted.intersection(self.conflict):
            raise QueryError("encrypted columns can't be conflict columns")
        names, keys = self.model.names, list(self.conflict)
        stored = self.db.table(self.model.table).select(*names)
        new = rows if isinstance(rows, DataFrame) else self.db.spark.createDataFrame(rows, self.model.schema)
        new = new.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in self.model.schema.fields], F.monotonically_increasing_id().alias("_at"))
        keyed = F.lit(True)
        for k in keys:
            keyed = keyed & F.col(k).isNotNull()
        rest = [n for n in names if n not in keys]
        changed = [n for n in (self.columns if self.columns is not None else rest) if n not in keys]
        pick = F.max_by if changed or self.columns is None else F.min_by
        one = new.where(keyed).groupBy(*keys).agg(pick(F.struct(*rest, F.lit(True).alias("_is")), "_at").alias("_new"))
        merged = stored.join(one, keys, "left")
        hit = F.col("_new").isNotNull()
        did = F.when(hit & F.lit(bool(changed)), TOUCHED).otherwise(LEFT).alias("_did")
        after = merged.select(*[F.when(hit, F.col(f"_new.{n}")).otherwise(F.col(n)).alias(n) if n in changed else F.col(n) for n in names], did)
        fresh = one.join(stored.select(*keys), keys, "left_anti").select(*[F.col(f"_new.{n}").alias(n) if n in rest else F.col(n) for n in names]).unionByName(new.where(~keyed).drop("_at"))
        return Change(self.db, self.model.table, after.unionByName(fresh.withColumn("_did", F.lit(TOUCHED))))


def on_conflict(db, model, *columns) -> Upsert:
    return Upsert(db, model, names_of(columns))


def insert_or_update(db, model, rows, *conflict) -> Change:
    return on_conflict(db, model, *conflict).insert(rows)
