"""Related rows, nested into their owners, and changes of many-to-many links."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brindle.errors import NotFound, QueryError
from brindle.model import Model, Relation
from brindle.query import Page, Query
from brindle.sources.lineage import cut


def tree_of(paths: tuple[str, ...]) -> dict:
    """Dotted paths merged to a tree."""
    tree: dict = {}
    for path in paths:
        at = tree
        for part in path.split("."):
            at = at.setdefault(part, {})
    return tree


def related_rows(db, relation: Relation, constrain: Callable[[Query], Query] = lambda q: q) -> DataFrame:
    """The related live rows with ``_owner``, the value of the owner's local column that they belong to.

    Through a pivot, a related row that is linked twice to an owner counts once.
    """
    model, query = relation.related, constrain(Query(relation.related, db))
    if relation.morph:
        query = query.where_eq(relation.morph[0], relation.morph[1])
    rows = query.frame()
    if relation.kind != "through":
        return rows.withColumn("_owner", F.col(relation.foreign))
    pivot = db.table(relation.pivot).select(F.col(relation.foreign).alias("_owner"), F.col(relation.pivot_related).alias("_to")).dropna().distinct()
    return rows.join(pivot, rows[relation.related_key or model.primary_key[0]] == pivot["_to"]).drop("_to")


def attach(db, owners: DataFrame, model: Model, tree: dict, few: bool = False) -> DataFrame:
    """owners with a column for each relation of the tree: an array of rows, in the order of their key, or one row or NULL.

    One plan of equi joins for all owners, however many: children are nested bottom-up, grouped by the owner's
    key (map-side first) and joined once. Where the owners are ``few`` (chosen by filters or a limit), only children with one of
    their keys are read on, at each level: a semi join, which Spark broadcasts if the keys are small. The children of one
    owner are one row, so they must fit into a task.
    """
    for name, below in tree.items():
        relation = model.relation(name)
        if relation.kind == "morph_to":
            owners = MorphTo(db, relation).attached(owners, name)
            continue
        child = relation.related
        rows = related_rows(db, relation).where(F.col("_owner").isNotNull())
        if few:
            keys = owners.select(F.col(relation.local).alias("_key")).distinct()
            rows = rows.join(keys, rows["_owner"] == keys["_key"], "left_semi")
        kept = [c for c in rows.columns if c == "_owner" or c not in child.hidden or c in {child.relation(b).local for b in below} or c in child.primary_key]
        rows = attach(db, rows.select(*kept).withColumnRenamed("_owner", f"_owner_of_{name}"), child, below, few).withColumnRenamed(f"_owner_of_{name}", "_owner")
        names = [c for c in rows.columns if not c.startswith("_owner") and c not in child.hidden]
        row = F.struct(*names)
        order = [F.col(k) for k in child.primary_key]
        if relation.many:
            sort = F.struct(*order, row.alias("_row")) if order else F.struct(row.alias("_row"))
            grouped = rows.groupBy("_owner").agg(F.transform(F.array_sort(F.collect_list(sort)), lambda x: x["_row"]).alias(name))
        else:
            grouped = rows.groupBy("_owner").agg(F.min_by(row, F.struct(*order) if order else F.struct(*names)).alias(name))
        owners = owners.join(grouped, owners[relation.local] == grouped["_owner"], "left").drop("_owner")
        if relation.many:
            owners = owners.withColumn(name, F.coalesce(name, F.array().cast(owners.schema[name].dataType)))
    return owners


@dataclass(frozen=True)
class MorphTo:
    """The other side of a polymorphic relation: rows that name their owner's table in one column and its key in another.

    The relation's ``morph`` holds the column of the type, ``local`` that of the key; ``models`` are the owners it may have. A NULL
    in either column is a row without an owner.
    """

    db: object
    relation: Relation

    def is_type(self, model: Model) -> Column:
        """Whether a row's owner is of a model."""
        return F.coalesce(F.col(self.relation.morph[0]) == F.lit(model.table), F.lit(False))

    def load_as(self, rows: DataFrame, model: Model, name: str = "owner") -> DataFrame:
        """rows with their owner of one model as a struct; NULL where the owner is of another, or is not stored."""
        key = self.relation.related_key or model.primary_key[0]
        found = Query(model, self.db).frame()
        owners = found.select(F.col(key).alias("_owner"), F.struct(*[c for c in found.columns if c not in model.hidden]).alias(name))
        return rows.join(owners, self.is_type(model) & (F.col(self.relation.local) == owners["_owner"]), "left").drop("_owner")

    def load(self, rows: DataFrame, model: Model, name: str = "owner") -> DataFrame:
        """As load_as, for rows whose owners are all of the model: others are an error."""
        other = rows.where(F.col(self.relation.morph[0]) != model.table).select(self.relation.morph[0]).first()
        if other:
            raise QueryError(f"a row's owner is of {other[0]}, not of {model.table}: load_as takes rows of several types")
        return self.load_as(rows, model, name)

    def attached(self, rows: DataFrame, name: str) -> DataFrame:
        """rows with a struct of an owner for each model of the relation, under the name of its table: at most one is not NULL."""
        for model in self.relation.models:
            rows = self.load_as(rows, model, f"_as_{model.table}")
        made = F.struct(*[F.col(f"_as_{m.table}").alias(m.table) for m in self.relation.models])
        return rows.withColumn(name, made).drop(*[f"_as_{m.table}" for m in self.relation.models])


@dataclass(frozen=True)
class Eager:
    """A query whose rows come with relations. Limits and pages count owners: they apply before the joins."""

    query: Query
    paths: tuple[str, ...] = field(default=())

    def with_(self, *paths: str) -> Eager:
        return replace(self, paths=self.paths + paths)

    with_many = with_

    def shape(self, f: Callable[[Query], Query]) -> Eager:
        return replace(self, query=f(self.query))

    def frame(self) -> DataFrame:
        c = self.query.clauses
        return attach(self.query.db, self.query.frame(), self.query.model, tree_of(self.paths), bool(c.where or c.or_where or c.limit is not None))

    def get(self) -> list:
        if self.query.db.rules:
            self.query.db.rules.check_paths(self.paths)
        return self.query._rows(self.frame(), "get with relations")

    def first(self):
        rows = self.shape(lambda q: q.limit(1)).get()
        return rows[0] if rows else None

    def first_or_fail(self):
        row = self.first()
        if row is None:
            raise NotFound(f"no {self.query.model.table}")
        return row

    def find(self, key):
        return replace(self, query=self.query._by_key(key)).first()

    def find_or_fail(self, key):
        row = self.find(key)
        if row is None:
            raise NotFound(f"no {self.query.model.table} with key {key!r}")
        return row

    def count(self) -> int:
        return self.query.count()

    def paginate(self, page: int, per_page: int) -> Page:
        plain = self.query
        if not plain.clauses.order_by:
            for k in plain.model.primary_key:
                plain = plain.order_asc(k)
        return Page(replace(self, query=plain.page(page, per_page)).get(), plain.count(), page, per_page)


@dataclass(frozen=True)
class Links:
    """Related rows of all owners of a relation, as DataFrames, and the links of a pivot table."""

    db: object
    model: Model
    name: str

    @property
    def relation(self) -> Relation:
        return self.model.relation(self.name)

    def load(self, owners: DataFrame, constrain: Callable[[Query], Query] = lambda q: q) -> DataFrame:
        """Related rows of the owners, with ``_owner``."""
        rows = related_rows(self.db, self.relation, constrain)
        keys = owners.select(F.col(self.relation.local).alias("_key")).distinct()
        return rows.join(keys, rows["_owner"] == keys["_key"], "left_semi")

    def counts(self, owners: DataFrame) -> DataFrame:
        """The owner's local key and ``n``, its number of related rows; 0 for none."""
        key = self.relation.local
        n = related_rows(self.db, self.relation).groupBy("_owner").agg(F.count(F.lit(1)).alias("n"))
        keys = owners.select(key)
        return keys.join(n, keys[key] == n["_owner"], "left").select(key, F.coalesce("n", F.lit(0)).cast("long").alias("n"))

    def existing(self, owners: DataFrame) -> DataFrame:
        """The owners with a related row."""
        rows = related_rows(self.db, self.relation).select("_owner")
        return owners.join(rows, owners[self.relation.local] == rows["_owner"], "left_semi")

    def _pivot(self) -> tuple[DataFrame, str, str]:
        r = self.relation
        if r.kind != "through":
            raise QueryError(f"{self.name} has no pivot table")
        return self.db.table(r.pivot), r.foreign, r.pivot_related

    def _pairs(self, owner, related: list) -> DataFrame:
        df, a, b = self._pivot()
        kinds = f"{a} {df.schema[a].dataType.simpleString()}, {b} {df.schema[b].dataType.simpleString()}"
        return self.db.spark.createDataFrame([(owner, x) for x in dict.fromkeys(related)], kinds)

    def attach(self, owner, *related) -> None:
        """Add links; those that are there stay single."""
        df, a, b = self._pivot()
        new = self._pairs(owner, list(related)).join(df.select(a, b), [a, b], "left_anti")
        self.db.put(self.relation.pivot, df.unionByName(new, allowMissingColumns=True))

    def detach(self, owner, *related) -> int:
        df, a, b = self._pivot()
        gone = (F.col(a) == owner) & F.col(b).isin(list(related))
        n = df.where(gone).count()
        self.db.put(self.relation.pivot, df.where(~F.coalesce(gone, F.lit(False))))
        return n

    def detach_all(self, owner) -> int:
        df, a, _ = self._pivot()
        n = df.where(F.col(a) == owner).count()
        self.db.put(self.relation.pivot, df.where(~F.coalesce(F.col(a) == owner, F.lit(False))))
        return n

    def sync(self, owner, *related) -> None:
        """Make the owner's links exactly these; links that stay keep their row."""
        df, a, b = self._pivot()
        stays = ~F.coalesce(F.col(a) == owner, F.lit(False)) | F.col(b).isin(list(related))
        self.db.put(self.relation.pivot, df.where(stays))
        self.attach(owner, *related)


def load_tree(query: Query, root, parent: str, max_depth: int) -> DataFrame:
    """The rows below a root over a self-reference, each once at its smallest ``depth`` (1 for children), down to
    ``max_depth``; live rows only, so a trashed row hides what is below it. Cycles end by themselves.

    Breadth first: a join a level, on keys only, each level written to the checkpoint folder so that plans
    don't nest; rows are fetched once at the end. It ends at the first empty level.
    """
    key = query.model.primary_key[0]
    live = cut(query.select(key, parent).frame())
    found = level = live.where(F.col(parent) == root).where(F.col(key) != root).select(F.col(key).alias("_id"), F.lit(1).alias("depth"))
    for depth in range(2, max_depth + 1):
        child = live.select(F.col(key).alias("_id"), F.col(parent).alias("_up")).where(F.col("_id") != root)
        step = level.select(F.col("_id").alias("_up")).distinct()
        level = cut(child.join(step, "_up").select("_id").distinct().join(found.select("_id"), "_id", "left_anti").select("_id", F.lit(depth).alias("depth")))
        if level.isEmpty():
            break
        found = found.union(level)
    rows = query.frame()
    return rows.join(found, rows[key] == found["_id"]).drop("_id")
