"""Window columns: functions, frames and the rewriting of GROUPS frames."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brindle.errors import QueryError
from brindle.sources.lineage import cut

UNBOUNDED_PRECEDING, CURRENT_ROW, UNBOUNDED_FOLLOWING = "unbounded preceding", "current row", "unbounded following"


def preceding(n: int) -> int:
    return -n


def following(n: int) -> int:
    return n


_BOUNDS = {UNBOUNDED_PRECEDING: Window.unboundedPreceding, CURRENT_ROW: Window.currentRow, UNBOUNDED_FOLLOWING: Window.unboundedFollowing}


@dataclass(frozen=True)
class WindowColumn:
    """A function over a window, under an alias. ``make`` gets the resolver of names; ``says`` is the function and its arguments."""

    alias: str
    make: Callable[[Callable[[str], Column]], Column] = field(compare=False)
    says: tuple = ()
    partition: tuple[str, ...] = ()
    order: tuple[tuple[str, bool], ...] = ()
    frame_unit: str | None = None
    start: object = None
    end: object = None
    ranked: bool = False  # the function needs an order and takes no frame

    def partition_by(self, *columns: str) -> WindowColumn:
        return replace(self, partition=self.partition + columns)

    def order_by(self, column: str, descending: bool = False) -> WindowColumn:
        return replace(self, order=(*self.order, (column, descending)))

    def frame(self, unit: str, start=UNBOUNDED_PRECEDING, end=CURRENT_ROW) -> WindowColumn:
        if unit not in ("rows", "range", "groups"):
            raise QueryError(f"no frame unit {unit!r}")
        return replace(self, frame_unit=unit, start=start, end=end)

    def add(self, df: DataFrame, resolve: Callable[[str], Column], dry: bool = False) -> tuple[DataFrame, Column, list[str]]:
        """df (with helper columns, if any), the window column, and the helpers' names.

        A number or rank over all rows is dealt over tasks (see _spread), but for a dry run. Other functions over all rows
        meet in one task, as Spark has it: their frames reach across any border.

        Spark has no GROUPS frames: the peer group's number (dense_rank over the same window) becomes the
        order of a RANGE frame. Descending nulls come first and ascending ones last, as everywhere here.
        """
        if not dry and not self.partition and self.order and self.says and self.says[0] in ("row_number", "rank", "dense_rank"):
            return self._spread(df, resolve)
        keys = [resolve(c) for c in self.partition]
        order = [ordering(resolve(c), d) for c, d in self.order] or [F.lit(1)]
        spec = Window.partitionBy(*keys).orderBy(*order)
        if self.frame_unit is None or self.ranked:
            if not self.order and not self.ranked:
                spec = Window.partitionBy(*keys)
            return df, self.make(resolve).over(spec).alias(self.alias), []
        start, end = (_BOUNDS.get(b, b) for b in (self.start, self.end))
        if self.frame_unit == "rows":
            return df, self.make(resolve).over(spec.rowsBetween(start, end)).alias(self.alias), []
        if self.frame_unit == "range":
            return df, self.make(resolve).over(spec.rangeBetween(start, end)).alias(self.alias), []
        helper = f"_group_of_{self.alias}"
        numbered = df.withColumn(helper, F.dense_rank().over(spec))
        return numbered, self.make(resolve).over(Window.partitionBy(*keys).orderBy(helper).rangeBetween(start, end)).alias(self.alias), [helper]


    def _spread(self, df: DataFrame, resolve: Callable[[str], Column]) -> tuple[DataFrame, Column, list[str]]:
        """Ranks over all rows without a task that sees all: the distinct values of the order are counted, ranged and written
        once (keys only, to the checkpoint folder); each range is ranked for itself and starts after the rows of those
        before it; rows then look up their value's rank. Only the ranges' sums reach the driver."""
        names = [f"_order_{i}_of_{self.alias}" for i in range(len(self.order))]
        by = [ordering(F.col(n), d) for n, (_, d) in zip(names, self.order)]
        df = df.withColumns({n: resolve(c) for n, (c, _) in zip(names, self.order)})
        keys = cut(df.groupBy(*names).agg(F.count(F.lit(1)).alias("_n")).repartitionByRange(*by).withColumn("_range", F.spark_partition_id()))
        starts, rows, values = [], 0, 0
        for r in sorted(keys.groupBy("_range").agg(F.sum("_n"), F.count(F.lit(1))).collect()):
            starts.append((r[0], rows, values))
            rows, values = rows + r[1], values + r[2]
        starts = df.sparkSession.createDataFrame(starts, "_range int, _rows long, _values long")
        inside = Window.partitionBy("_range").orderBy(*by)
        before = F.coalesce(F.sum("_n").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        rank = F.col("_rows") + before + 1 if self.says[0] != "dense_rank" else F.col("_values") + F.row_number().over(inside)
        helper = f"_rank_of_{self.alias}"
        ranked = keys.join(F.broadcast(starts), "_range").select(*[F.col(n).alias(f"{n}_") for n in names], rank.alias(helper))
        on = [df[n].eqNullSafe(ranked[f"{n}_"]) for n in names]
        out = df.join(ranked, on).drop(*[f"{n}_" for n in names])
        column = F.col(helper)
        if self.says[0] == "row_number":
            column = column - 1 + F.row_number().over(Window.partitionBy(*names).orderBy(F.lit(1)))
        return out, column.cast("int").alias(self.alias), [*names, helper]


def ordering(column: Column, descending: bool) -> Column:
    return column.desc_nulls_first() if descending else column.asc_nulls_last()


def _plain(name: str):
    return lambda alias: WindowColumn(alias, lambda _: getattr(F, name)(), (name,), ranked=True)


row_number, rank, dense_rank, percent_rank, cume_dist = (_plain(n) for n in ("row_number", "rank", "dense_rank", "percent_rank", "cume_dist"))


def ntile(alias: str, buckets: int) -> WindowColumn:
    return WindowColumn(alias, lambda _: F.ntile(buckets), ("ntile", buckets), ranked=True)


def lag(alias: str, column: str, offset: int = 1, default=None) -> WindowColumn:
    return WindowColumn(alias, lambda r: F.lag(r(column), offset, default), ("lag", column, offset, default), ranked=True)


def lead(alias: str, column: str, offset: int = 1, default=None) -> WindowColumn:
    return WindowColumn(alias, lambda r: F.lead(r(column), offset, default), ("lead", column, offset, default), ranked=True)


def lag_with_raw_default(alias: str, column: str, offset: int, default: str) -> WindowColumn:
    return WindowColumn(alias, lambda _: F.expr(f"lag({column}, {offset}, {default})"), ("raw lag", column, offset, default), ranked=True)


def lead_with_raw_default(alias: str, column: str, offset: int, default: str) -> WindowColumn:
    return WindowColumn(alias, lambda _: F.expr(f"lead({column}, {offset}, {default})"), ("raw lead", column, offset, default), ranked=True)


def first_value(alias: str, column: str) -> WindowColumn:
    return WindowColumn(alias, lambda r: F.first_value(r(column)), ("first_value", column))


def last_value(alias: str, column: str) -> WindowColumn:
    return WindowColumn(alias, lambda r: F.last_value(r(column)), ("last_value", column))


def nth_value(alias: str, column: str, n: int) -> WindowColumn:
    return WindowColumn(alias, lambda r: F.nth_value(r(column), n), ("nth_value", column, n))


def aggregate(alias: str, name: str, column: str | None = None) -> WindowColumn:
    """sum, avg, count, min or max over a frame; a sum of no rows stays NULL."""
    if name not in ("sum", "avg", "count", "min", "max"):
        raise QueryError(f"no window aggregate {name!r}")
    return WindowColumn(alias, lambda r: getattr(F, name)(r(column) if column else F.lit(1)), (name, column))


def custom(alias: str, expression: str) -> WindowColumn:
    return WindowColumn(alias, lambda _: F.expr(expression), ("custom", expression))
