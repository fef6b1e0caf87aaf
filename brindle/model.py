"""Tables as typed models, and their columns."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import types as T

from brindle.errors import QueryError
from brindle.plans.predicates import CONDITIONS, Condition


@dataclass(frozen=True)
class Relation:
    """How rows of another model belong to a row.

    kind: ``has_many``, ``has_one``, ``belongs_to``, ``through`` (many-to-many over a pivot table), ``morph_many``,
    ``morph_one``, ``morph_to``. ``local`` is a column of the owner, ``foreign`` one of the related table (for ``through``: of
    the pivot, whose ``pivot_related`` names the related rows' ``related_key``). For ``morph_to``, ``local`` is the column that holds
    the owner's key, ``model`` a function that gives the models which owners may be of.
    """

    kind: str
    model: Callable[[], Model] | Callable[[], tuple[Model, ...]] | Model
    local: str
    foreign: str = ""
    pivot: str | None = None
    pivot_related: str | None = None
    related_key: str | None = None
    morph: tuple[str, str] | None = None  # discriminator column and its value (morph_to: None)

    @property
    def related(self) -> Model:
        return self.model if isinstance(self.model, Model) else self.model()

    @property
    def models(self) -> tuple[Model, ...]:
        return self.model()

    @property
    def many(self) -> bool:
        return self.kind in ("has_many", "through", "morph_many")


@dataclass(frozen=True)
class Attribute:
    """A column of a model; its methods make conditions."""

    model: Model
    name: str
    kind: T.DataType

    def __getattr__(self, name: str):
        if name in CONDITIONS:
            return lambda *args: Condition(f"{self.model.table}.{self.name}", CONDITIONS[name], args)
        raise AttributeError(name)


@dataclass(frozen=True, eq=False)
class Model:
    """A table: columns, primary key, soft-delete column and relations.

    ``renamed`` maps field names to the names that the stored table has for them.
    """

    table: str
    columns: str | T.StructType
    primary_key: tuple[str, ...] = ()
    soft_delete: str | None = None
    relations: dict[str, Relation] = field(default_factory=dict)
    json: frozenset[str] = frozenset()
    encrypted: frozenset[str] = frozenset()
    hidden: frozenset[str] = frozenset()
    renamed: dict[str, str] = field(default_factory=dict)
    created_at: str = "created_at"

    @property
    def schema(self) -> T.StructType:
        return self.columns if isinstance(self.columns, T.StructType) else T.StructType.fromDDL(self.columns)

    @property
    def names(self) -> list[str]:
        return self.schema.names

    def kind_of(self, name: str) -> T.DataType | None:
        return next((f.dataType for f in self.schema.fields if f.name == name), None)

    def __getitem__(self, name: str) -> Attribute:
        kind = self.kind_of(name)
        if kind is None:
            raise QueryError(f"{self.table} has no column {name}")
        return Attribute(self, name, kind)

    def relation(self, name: str) -> Relation:
        if name not in self.relations:
            raise QueryError(f"{self.table} has no relation {name}")
        return self.relations[name]
