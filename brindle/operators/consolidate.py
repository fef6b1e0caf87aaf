"""Flat joined rows regrouped to nested ones."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _present(columns: Sequence[str]):
    out = F.lit(False)
    for c in columns:
        out = out | F.col(c).isNotNull()
    return out


def consolidate_two(rows: DataFrame, parent: Sequence[str], child: Sequence[str], key: Sequence[str], order: Sequence[str], name: str = "children", present: Sequence[str] | None = None) -> DataFrame:
    """(parent, child) rows as one row a parent with an array of its children in ``order``. A child whose columns are all
    NULL (a left join without a match) is no child: its parent keeps an empty array."""
    child_row = F.struct(*[F.col(c) for c in order], F.struct(*child).alias("_row"))
    listed = F.transform(F.array_sort(F.collect_list(F.when(_present(present or child), child_row))), lambda x: x["_row"])
    rest = [c for c in parent if c not in key]
    return rows.groupBy(*key).agg(*[F.min_by(c, F.struct(*order)).alias(c) for c in rest], listed.alias(name)).select(*parent, name)


def consolidate_three(
    rows: DataFrame, parent: Sequence[str], child: Sequence[str], leaf: Sequence[str], parent_key: Sequence[str], child_key: Sequence[str], order: Sequence[str], names: tuple[str, str] = ("children", "leaves")
) -> DataFrame:
    """(parent, child, leaf) rows as parents with an array of children, each with an array of leaves."""
    both = [*parent_key, *child_key]
    inner = rows.groupBy(*both).agg(
        *[F.min_by(c, F.struct(*order)).alias(c) for c in [*parent, *child] if c not in both],
        F.transform(F.array_sort(F.collect_list(F.when(_present(leaf), F.struct(*[F.col(c) for c in order], F.struct(*leaf).alias("_row"))))), lambda x: x["_row"]).alias(names[1]),
    )
    return consolidate_two(inner, parent, [*child, names[1]], parent_key, child_key, names[0], child)
