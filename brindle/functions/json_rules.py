"""JSON text columns compared with constant documents: equality, containment, keys and paths.

All of it is built from JVM functions over VARIANT: a document is parsed once a row and each of its members read
once (see _bound), and the constant side becomes a tree of conditions. Numbers compare by value (1 = 1.0 = 1e0); 1, "1" and true are different.
Malformed text and NULL match nothing.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

NUMBERS = r"^(TINYINT|SMALLINT|INT|BIGINT|FLOAT|DOUBLE|DECIMAL)"


def parsed(text: Column) -> Column:
    return F.try_parse_json(text)


def _kind(v: Column) -> Column:
    return F.schema_of_variant(v)


def _items(v: Column) -> Column:
    return F.try_variant_get(v, "$", "array<variant>")


def _members(v: Column) -> Column:
    return F.try_variant_get(v, "$", "map<string,variant>")


def _bound(value: Column, rule: Callable[[Column], Column]) -> Column:
    """rule(value), where the value is made once a row, however often the rule names it: a filter shares no parts, so a
    column named twice is computed twice, and with nested rules that doubles at each level."""
    return F.exists(F.array(value), rule)


def _scalar(v: Column, value) -> Column:
    if value is None:
        return F.coalesce(F.is_variant_null(v), F.lit(False))
    if isinstance(value, bool):
        return F.coalesce((_kind(v) == "BOOLEAN") & (F.try_variant_get(v, "$", "boolean") == F.lit(value)), F.lit(False))
    if isinstance(value, str):
        return F.coalesce((_kind(v) == "STRING") & (F.try_variant_get(v, "$", "string") == F.lit(value)), F.lit(False))
    exact = value if isinstance(value, Decimal) else Decimal(str(value))
    same = F.try_variant_get(v, "$", "decimal(38,18)") == F.lit(exact).cast("decimal(38,18)") if abs(exact) < Decimal(10) ** 19 else F.try_variant_get(v, "$", "double") == F.lit(float(exact))
    return F.coalesce(_kind(v).rlike(NUMBERS) & same, F.lit(False))


def _all(conditions) -> Column:
    out = F.lit(True)
    for c in conditions:
        out = out & c
    return out


def _any(conditions) -> Column:
    out = F.lit(False)
    for c in conditions:
        out = out | c
    return out


def _member(m: Column, key: str, rule: Callable[[Column], Column]) -> Column:
    """rule on the member of that name; NULL, which holds no document, if there is none."""
    return _bound(F.try_element_at(m, F.lit(key)), rule)


def _holder(doc) -> Callable[[Column], Column]:
    return lambda x: _contains(x, doc, False)


def contains(v: Column, doc) -> Column:
    """v @> doc: objects hold the pairs, arrays hold each element somewhere; an array also holds a bare scalar at the top."""
    return _bound(v, lambda x: _contains(x, doc, True))


def _contains(v: Column, doc, top: bool) -> Column:
    if isinstance(doc, dict):
        return _bound(_members(v), lambda m: m.isNotNull() & _all(_member(m, k, _holder(d)) for k, d in doc.items()))
    if isinstance(doc, list):
        return _bound(_items(v), lambda items: items.isNotNull() & _all(F.coalesce(F.exists(items, _holder(d)), F.lit(False)) for d in doc))
    if top:
        return _scalar(v, doc) | F.coalesce(F.exists(_items(v), lambda x: _scalar(x, doc)), F.lit(False))
    return _scalar(v, doc)


def contained_by(v: Column, doc) -> Column:
    """v <@ doc."""
    return _bound(v, lambda x: _contained_by(x, doc, True))


def _contained_by(v: Column, doc, top: bool) -> Column:
    if isinstance(doc, dict):
        held = lambda m: F.forall(F.map_keys(m), lambda k: k.isin(list(doc))) if doc else F.size(m) == 0
        return _bound(_members(v), lambda m: m.isNotNull() & held(m) & _all(_member(m, k, _lacking_or_within(d)) for k, d in doc.items()))
    if isinstance(doc, list):
        inside = F.coalesce(F.forall(_items(v), lambda x: _any(_contained_by(x, d, False) for d in doc)), F.lit(False))
        return inside | _any(_scalar(v, d) for d in doc if not isinstance(d, (dict, list))) if top else inside
    return _scalar(v, doc)


def _lacking_or_within(doc) -> Callable[[Column], Column]:
    return lambda x: x.isNull() | _contained_by(x, doc, False)


def equals(v: Column, doc) -> Column:
    """The same document, whatever the order of its keys."""
    return _bound(v, lambda x: _equals(x, doc))


def differs(v: Column, doc) -> Column:
    """A document, but another one."""
    return _bound(v, lambda x: x.isNotNull() & ~_equals(x, doc))


def _equals(v: Column, doc) -> Column:
    if isinstance(doc, dict):
        return _bound(_members(v), lambda m: F.coalesce(F.size(m) == len(doc), F.lit(False)) & _all(_member(m, k, _equal_to(d)) for k, d in doc.items()))
    if isinstance(doc, list):
        return _bound(_items(v), lambda items: F.coalesce(F.size(items) == len(doc), F.lit(False)) & _all(_bound(F.try_element_at(items, F.lit(i + 1)), _equal_to(d)) for i, d in enumerate(doc)))
    return _scalar(v, doc)


def _equal_to(doc) -> Callable[[Column], Column]:
    return lambda x: _equals(x, doc)


def document(value):
    """A constant document: Python values as they are; text is taken as a JSON string value."""
    return json.loads(json.dumps(value, default=str), parse_float=Decimal)


def key_exists(text: Column, key: str) -> Column:
    """The document is an object with the key, whatever its value; NULL stays out of both forms."""
    return F.coalesce(F.array_contains(F.json_object_keys(text), key), F.lit(False))


def rooted(path: str) -> str:
    return path if path.startswith("$") else "$" + (path if path.startswith("[") else f".{path}")


def path_exists(text: Column, path: str) -> Column:
    """A member is there under the strict path, JSON null included."""
    return F.try_variant_get(parsed(text), rooted(path), "variant").isNotNull()
