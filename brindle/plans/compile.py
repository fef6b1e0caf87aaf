"""From clauses to a DataFrame.

Order: common tables, scan, joins, filters with the soft-delete scope, groups and HAVING, windows, projection,
distinct, unions, order, offset, limit. Nothing here runs a job, but for ranks over all rows, whose keys are ranged first:
Catalyst sees one declarative plan, so filters and columns reach the Parquet scan and a top-k stays a top-k.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brindle.errors import QueryError
from brindle.plans.predicates import Group, Raw, Scope, bound, checked_query
from brindle.plans.windows import ordering

#: Types that may meet in a column of a union.
FAMILIES = {
    "number": (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType),
    "text": (T.StringType, T.CharType, T.VarcharType),
    "time": (T.DateType, T.TimestampType, T.TimestampNTZType),
}


def family(kind: T.DataType) -> str:
    return next((name for name, kinds in FAMILIES.items() if isinstance(kind, kinds)), kind.typeName())


def last(name: str) -> str:
    return name.rsplit(".", 1)[-1]


def split_alias(item: str) -> tuple[str, str | None]:
    """``column AS alias`` as its two parts."""
    m = re.fullmatch(r"\s*([\w.]+)\s+(?:as\s+)?(\w+)\s*", item, re.I)
    return (m[1], m[2]) if m else (item.strip(), None)


class Compiled:
    def __init__(self, query, dry: bool = False):
        self.dry = dry
        self.query, self.model, self.db, self.clauses = query, query.model, query.db, query.clauses
        if self.clauses.error:
            raise self.clauses.error
        self.ctes: dict[str, DataFrame] = {}
        self.schemas: dict[str, T.StructType] = {self.model.table: self.model.schema}

    # names

    def resolve(self, name: str) -> Column:
        if "." in name or not self.clauses.joins or name not in self.model.names:
            return F.col(name)
        return F.col(f"{self.model.table}.{name}")

    def kind(self, name: str) -> T.DataType | None:
        table, _, column = name.rpartition(".")
        options = [self.schemas[table]] if table in self.schemas else list(self.schemas.values())
        return next((f.dataType for s in options for f in s.fields if f.name == column), None)

    def is_json(self, name: str) -> bool:
        table, _, column = name.rpartition(".")
        return column in self.model.json and table in ("", self.model.table)

    @property
    def scope(self) -> Scope:
        return Scope(self.resolve, self.kind, self.is_json, self.expr)

    def expr(self, sql: str) -> Column:
        """A fragment, whose subqueries read the tables of the query's database and its common tables."""
        return F.expr(self.db.local_fragment(sql, self.ctes))

    # parts

    def _table(self, name: str) -> DataFrame:
        return self.ctes[name] if name in self.ctes else self.db.table(name)

    def _common_tables(self) -> None:
        for cte in self.clauses.ctes:
            if cte.recursive:
                names = f"({', '.join(cte.columns)})" if cte.columns else ""
                step = f"{checked_query(cte.body)} UNION ALL {checked_query(cte.recursive)}"
                df = self.db.raw(f"WITH RECURSIVE {cte.name}{names} AS ({step}) SELECT * FROM {cte.name}", more=self.ctes)
            else:
                df = self.db.raw(checked_query(cte.body), more=self.ctes) if isinstance(cte.body, str) else cte.body.frame()
                df = df.toDF(*cte.columns) if cte.columns else df
            self.ctes[cte.name] = df

    def _scan(self) -> DataFrame:
        df = self._table(self.model.table)
        stored = [self.model.renamed.get(n, n) for n in self.model.names]
        missing = [n for n in stored if n not in df.columns]
        if missing:
            raise QueryError(f"{self.model.table} has no stored column {', '.join(missing)}")
        return df.select([df[s].alias(n) if s != n else df[s] for s, n in zip(stored, self.model.names)]).alias(self.model.table)

    def _joined(self, df: DataFrame) -> DataFrame:
        for join in self.clauses.joins:
            if isinstance(join.table, str):
                right = self._table(join.table)
            else:
                right = self._table(join.table.table)
                right = right.select([right[join.table.renamed.get(n, n)].alias(n) for n in join.table.names])
            self.schemas[join.alias] = right.schema
            names = {join.alias, *(j.alias for j in self.clauses.joins), self.model.table}
            on = [F.col(c) if "." in c and c.split(".")[0] in names else F.col(f"{self.model.table if i == 0 else join.alias}.{last(c)}") for i, c in enumerate((join.left, join.right))]
            df = df.join(right.alias(join.alias), on[0] == on[1], join.kind)
        return df

    def condition(self) -> Column | None:
        """All filters and the scope of soft deletion; None if there is no filter."""
        parts = [c.build(self.scope) for c in self.clauses.where]
        if self.clauses.or_where:
            parts.append(Group(True, self.clauses.or_where).build(self.scope))
        if self.model.soft_delete and self.clauses.trashed != "with":
            stamp = self.resolve(self.model.soft_delete)
            parts.append(stamp.isNull() if self.clauses.trashed == "without" else stamp.isNotNull())
        out = None
        for part in parts:
            out = part if out is None else out & part
        return out

    def rows(self) -> DataFrame:
        """Scan, joins and filters."""
        self._common_tables()
        df = self._joined(self._scan())
        condition = self.condition()
        return df if condition is None else df.where(condition)

    def _grouped(self, df: DataFrame) -> tuple[DataFrame, list[Column]]:
        c = self.clauses
        keys = [self.resolve(k).alias(last(k)) for k in c.group_by]
        made = [self.expr(raw) for raw in c.raw_select]
        hidden = []
        for i, h in enumerate(c.having):
            column = self.expr(bound(h.sql, h.params)) if isinstance(h, Raw) else h.compare(h.aggregate.build(self.resolve))
            hidden.append(column.alias(f"_having_{i}"))
        outputs = [split_alias(s) for s in c.select or ()]
        for name, _ in outputs:
            if last(name) not in {last(k) for k in c.group_by}:
                raise QueryError(f"{name} is neither grouped nor aggregated")
        base = df.groupBy(*keys).agg(*made, *hidden) if made or hidden else df.select(*keys).distinct()
        for i in range(len(hidden)):
            base = base.where(F.col(f"_having_{i}"))
        raw_names = base.columns[len(keys) : len(keys) + len(made)]
        shown = [F.col(last(n)).alias(a or last(n)) for n, a in outputs] + [F.col(f"`{n}`") for n in raw_names]
        return base, shown or [F.col(last(k)) for k in c.group_by]

    def _projected(self) -> DataFrame:
        c = self.clauses
        df = self.rows()
        if c.group_by or c.having:
            df, shown = self._grouped(df)
            resolve = lambda name: F.col(last(name))
        else:
            resolve = self.resolve
            shown = []
            for name, alias in (split_alias(s) for s in c.select or ()):
                if name.endswith(".*"):
                    shown.append(F.col(name))
                else:
                    shown.append(self.resolve(name).alias(alias) if alias else self.resolve(name))
            shown += [self.expr(raw) for raw in c.raw_select]
            shown += [sub.frame().scalar().alias(alias) for sub, alias in c.subselects]
            if not shown:
                shown = [F.col(f"{self.model.table}.{n}") for n in self.model.names]
        for window in c.windows:
            df, column, _ = window.add(df, resolve, self.dry)
            shown = [*shown, column]
        return df.select(*shown)

    def _checked_distinct(self, df: DataFrame) -> None:
        hidden = self.model.encrypted.intersection(df.columns)
        if hidden:
            raise QueryError(f"{', '.join(sorted(hidden))} is encrypted: equal values differ as stored")
        for kind, name, _ in self.clauses.order_by:
            if kind == "column" and last(name) not in df.columns:
                raise QueryError(f"a distinct query can't be ordered by {name}, which it doesn't select")

    def _united(self, df: DataFrame) -> DataFrame:
        for other, keep_all in self.clauses.unions:
            right = self.db.raw(bound_statement(checked_query(other[0]), other[1]), more=self.ctes) if isinstance(other, tuple) else other.frame()
            if len(right.columns) != len(df.columns):
                raise QueryError("the parts of a union have different numbers of columns")
            for a, b in zip(df.schema.fields, right.schema.fields):
                if family(a.dataType) != family(b.dataType) and not isinstance(b.dataType, T.NullType):
                    raise QueryError(f"{a.name} and {b.name} of a union have different types")
            if not keep_all and self.model.encrypted.intersection(df.columns):
                raise QueryError("encrypted columns don't go with a distinct union")
            df = df.union(right) if keep_all else df.union(right).distinct()
        return df

    def _ordered(self, df: DataFrame, by_output: bool) -> DataFrame:
        keys = []
        for kind, name, descending in self.clauses.order_by:
            grouped = self.clauses.group_by or self.clauses.having
            column = self.expr(name) if kind == "raw" else F.col(last(name)) if by_output or grouped or last(name) in df.columns and name not in self.model.names else self.resolve(name)
            keys.append(ordering(column, descending))
        return df.orderBy(*keys) if keys else df

    def _cut(self, df: DataFrame) -> DataFrame:
        if self.clauses.offset:
            df = df.offset(self.clauses.offset)
        return df if self.clauses.limit is None else df.limit(self.clauses.limit)

    # results

    def frame(self) -> DataFrame:
        df = self._projected()
        if self.clauses.distinct:
            self._checked_distinct(df)
            df = df.distinct()
        df = self._united(df)
        return self._cut(self._ordered(df, bool(self.clauses.unions or self.clauses.distinct)))

    def rows_to_aggregate(self) -> DataFrame:
        """What aggregates run over: the joined rows, or the finished query if it limits, merges or makes rows distinct."""
        c = self.clauses
        if c.limit is None and not c.offset and not c.unions and not c.distinct:
            return self.rows()
        return self.frame()

    def distinct_values(self, column: str) -> DataFrame:
        keys = [ordering(self.expr(n) if k == "raw" else self.resolve(n), d) for k, n, d in self.clauses.order_by]
        first = Window.partitionBy(self.resolve(column)).orderBy(*keys)
        df = self.rows().withColumn("_nth", F.row_number().over(first)).where("_nth = 1").orderBy(*keys)
        return self._cut(df).select(self.resolve(column).alias(last(column)))

    def check_model_columns(self) -> None:
        c = self.clauses
        if c.select is None and not c.raw_select and not c.subselects:
            return
        have = {alias or last(name) for name, alias in map(split_alias, c.select or ())}
        missing = [n for n in self.model.names if n not in have and f"{self.model.table}.*" not in (c.select or ())]
        if missing:
            raise QueryError(f"the projection lacks {', '.join(missing)}: read such rows with get_json, get_as or frame")


def bound_statement(sql: str, params) -> str:
    """A trusted statement with a literal for each ? outside quotes."""
    from brindle.plans.predicates import pieces, sql_literal

    values, out = list(params), []
    for kind, text in pieces(sql):
        for i, part in enumerate(text.split("?") if kind == "code" else [text]):
            if i:
                if not values:
                    raise QueryError("fewer values than placeholders")
                out.append(sql_literal(values.pop(0)))
            out.append(part)
    if values:
        raise QueryError("more values than placeholders")
    return "".join(out)
