"""Mixing sources to target weights by entropy balancing."""

from __future__ import annotations

import math
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brindle.llm.shared import WORD, cut, ship


def words_in(text: Column) -> Column:
    """Number of words of a text; null has none."""
    return F.coalesce(F.regexp_count(text.cast("string"), F.lit(WORD)), F.lit(0)).cast("long")


def exact(terms: Column) -> Column:
    """A sum that is the same in any order, so that reruns agree."""
    return F.sum(terms.cast("decimal(38,8)")).cast("double")


def numbered(rows: DataFrame, key: str) -> DataFrame:
    """rows with ``nth``, their number from 0 in the order of a distinct key: a range partition each is numbered for itself, and
    starts after the rows of those before it. Only the partitions' row counts reach the driver."""
    ranged = cut(rows.repartitionByRange(key).withColumn("range", F.spark_partition_id()))
    counts = dict(ranged.groupBy("range").count().collect())
    starts, at = [], 0
    for number in sorted(counts):
        starts.append((number, at))
        at += counts[number]
    offsets = rows.sparkSession.createDataFrame(starts, "range int, offset long")
    inside = F.row_number().over(Window.partitionBy("range").orderBy(key)) - 1
    return ranged.withColumn("inside", inside).join(F.broadcast(offsets), "range").withColumn("nth", F.col("offset") + F.col("inside")).drop("range", "inside", "offset")


def source_targets(sizes: DataFrame, weights: Sequence[float], cap: float) -> DataFrame:
    """Targets of sources: ``sizes`` has key and total, in whose order of key the weights repeat.

    The sources share the sum of all totals by weight; a target stops at ``cap`` times its total and the
    excess goes to the others by weight until none is above. That is the water level L with
    sum(min(cap * total, L * weight)) = sum(total). It is found from below: the level that those leave who are full so far makes
    more of them full, until none is added; each round is one aggregation over the sources.
    """
    pick = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("nth") % len(weights) + 1).cast("int"))
    rows = numbered(sizes, "key").withColumn("weight", pick).withColumn("most", F.col("total") * float(cap))
    rows = cut(rows.select("key", "total", "weight", "most", (F.col("most") / F.col("weight")).alias("ratio")))
    whole, level, full = rows.agg(exact(F.col("total")), exact(F.col("weight"))).first(), 0.0, -1
    while whole[0]:
        is_full = F.col("ratio") < level
        found = rows.agg(F.count(F.when(is_full, 1)), exact(F.when(is_full, F.col("most")).otherwise(0.0)), exact(F.when(is_full, F.col("weight")).otherwise(0.0))).first()
        if found[0] == full:
            break
        full, level = found[0], (whole[0] - found[1]) / (whole[1] - found[2]) if whole[1] > found[2] else float("inf")
    return rows.select("key", "total", F.when(F.col("ratio") < level, F.col("most")).otherwise(F.col("weight") * level).alias("target"))


def tilts(histogram: DataFrame, targets: DataFrame, cap: float, tolerance: float, rounds: int) -> DataFrame:
    """Newton's method for the dual: key, target, lam, mean_size and whether every document is at the cap.

    The primal problem: of all document rates w with sum(w * size) = target in each source and 0 < w <= cap,
    take those of least relative entropy to 1. Its dual is convex, with one multiplier a source; the rates
    are w = min(cap, exp(lam * size / mean_size)). A round computes gradient and curvature of all sources in
    one distributed aggregation over the histogram of sizes, then takes a Newton step on the logarithm of
    the token sum, inside a bracket that shrinks each round (else the bracket's middle).
    """
    shape = histogram.where("size > 0").groupBy("key").agg((F.sum(F.col("size") * F.col("n")) / F.sum("n")).alias("mean_size"), F.min("size").alias("least"))
    state = targets.join(shape, "key", "left").withColumn("at_cap", F.col("target") >= F.col("total") * cap * (1 - 1e-12))
    x_least = F.col("least") / F.col("mean_size")
    up = F.col("target") > F.col("total")
    state = cut(
        state.withColumn("lo", F.when(up, 0.0).otherwise(F.coalesce(F.log(F.try_divide(F.col("target"), F.col("total"))) / x_least, F.lit(0.0))))
        .withColumn("hi", F.when(up, math.log(cap) / x_least).otherwise(0.0))
        .withColumn("lam", F.when(F.col("at_cap"), F.coalesce("hi", F.lit(0.0))).otherwise(0.0))
        .withColumn("done", F.col("at_cap") | F.col("mean_size").isNull() | (F.col("target") <= 0))
    )
    for turn in range(rounds + 1):
        left = state.where("NOT done").count()
        if not left:
            break
        if turn == rounds:
            raise ArithmeticError(f"{left} sources are not at their target after {rounds} rounds")
        x = F.col("size") / F.col("mean_size")
        free = F.exp(F.col("lam") * x)
        tokens = F.col("n") * F.col("size")
        sums = (
            histogram.where("size > 0")
            .join(state.where("NOT done").select("key", "lam", "mean_size"), "key")
            .groupBy("key")
            .agg(exact(tokens * F.least(free, F.lit(cap))).alias("got"), exact(F.when(free < cap, tokens * x * free).otherwise(0.0)).alias("slope"))
        )
        error = F.log(F.col("got")) - F.log(F.col("target"))
        step = F.col("lam") - error * F.try_divide(F.col("got"), F.col("slope"))
        moved = state.join(sums, "key", "left").withColumn("lo", F.when(error < 0, F.col("lam")).otherwise(F.col("lo"))).withColumn("hi", F.when(error > 0, F.col("lam")).otherwise(F.col("hi")))
        ok = F.abs(error) <= tolerance
        inside = (step > F.col("lo")) & (step < F.col("hi"))
        new = F.when(inside, step).otherwise((F.col("lo") + F.col("hi")) / 2)
        moved = moved.withColumn("lam", F.when(F.col("done") | ok, F.col("lam")).otherwise(new)).withColumn("done", F.col("done") | F.coalesce(ok, F.lit(False)))
        state = cut(moved.select(*state.columns))
    return state.select("key", "total", "target", "lam", "mean_size", "at_cap")


def _copies(key, cells: pd.DataFrame, cap: float) -> pd.DataFrame:
    """Whole copies for the cells (distinct sizes) of a source, largest size first: each cell gets as many copies as keep
    the running token sum next to its target, ``base`` for all its documents and one more for ``extra`` of them."""
    cells = cells.sort_values("size", ascending=False)
    wanted = got = 0.0
    base, extra = [], []
    for size, n, rate in zip(cells["size"].tolist(), cells["n"].tolist(), cells["rate"].tolist()):
        wanted += n * size * rate
        copies = min(n * math.floor(cap), max(0, round((wanted - got) / size))) if size else 0
        got += copies * size
        base.append(copies // n)
        extra.append(copies % n)
    return pd.DataFrame({"key": cells["key"], "size": cells["size"], "base": base, "extra": extra, "total": cells["total"], "target": cells["target"], "rate": cells["rate"]})


def entropy_mix(
    docs: DataFrame,
    weights: Sequence[float] = (5, 2, 1),
    cap: float = 3.0,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    tolerance: float = 1e-7,
    rounds: int = 60,
    rows_per_salt: int = 4096,
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """Copies of each document in a mix with target shares by source.

    Returns doc_id, source, size, source_size, target, rate, copies, taken; one row per row of ``docs``. The
    columns in ``keep`` come along in a struct ``kept``, which also tells rows of equal id and size apart.
    Sizes are words. Rates are exponentially tilted by document size as far as a source must shrink or
    grow (see tilts); rounding keeps each source's token sum within half of its smallest document of the target, where
    the source has enough short documents to make up for its long ones. No document gets more than ``cap`` copies.
    Reruns agree: extra copies go by a hash of the id. ArithmeticError, if a source is not at its target after ``rounds`` rounds.

    Skew: rates depend on (source, size) only, so sums run over that histogram, which grows with the
    number of distinct sizes, not with documents. A cell of the histogram that holds very many documents is split over
    salts of about ``rows_per_salt`` documents at most before documents are ranked in it.

    Defined cases: null text has size 0; sizes of 0 take nothing; texts count whole, however long; a null source is a
    source of its own and the last in order; sources without words have target 0; equal ids that repeat are documents of
    their own, and rows that are equal in all that is kept may change places; an empty table gives no rows; other
    columns, whatever their names, are ignored.
    """
    ship(docs.sparkSession)
    key = F.when(F.col(source_col).isNull(), F.lit("t")).otherwise(F.concat(F.lit("s"), F.col(source_col).cast("string")))  # 't' is after every 's...'
    carried = [F.struct(*keep).alias("kept")] if keep else []
    rows = cut(docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), key.alias("key"), words_in(F.col(text_col)).alias("size"), *carried))
    salts = rows.count() // rows_per_salt + 1
    histogram = cut(rows.groupBy("key", "size").agg(F.count(F.lit(1)).alias("n")))
    totals = histogram.groupBy("key").agg(F.sum(F.col("size") * F.col("n")).alias("total"))
    state = tilts(histogram, cut(source_targets(totals, weights, cap)), cap, tolerance, rounds)
    rate = F.when(F.col("target") <= 0, 0.0).when(F.col("at_cap"), F.lit(float(cap))).otherwise(F.least(F.exp(F.col("lam") * F.col("size") / F.col("mean_size")), F.lit(float(cap))))
    cells = histogram.join(state, "key").withColumn("rate", F.coalesce(rate, F.lit(0.0))).select("key", "size", "n", "rate", "total", "target")
    cells = cells.groupBy("key").applyInPandas(lambda k, pdf: _copies(k, pdf, cap), "key string, size long, base long, extra long, total long, target double, rate double")
    content = F.xxhash64(F.lit(19), *[F.col("kept")[c] for c in keep if "map<" not in docs.select(c).dtypes[0][1]])
    own = F.when(F.col("doc_id").isNull(), F.xxhash64(F.lit(11), content)).otherwise(F.xxhash64(F.lit(11), "doc_id")) if keep else F.xxhash64(F.lit(11), "doc_id")
    salted = rows.withColumn("salt", F.pmod(own, F.lit(salts)))
    parts = salted.groupBy("key", "size", "salt").agg(F.count(F.lit(1)).alias("m"))
    cell = Window.partitionBy("key", "size")
    upto = F.sum("m").over(cell.orderBy("salt").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    share = lambda n: F.expr("extra * {0} div whole".format(n))
    parts = parts.withColumn("upto", upto).withColumn("whole", F.sum("m").over(cell)).join(cells, ["key", "size"])
    parts = parts.withColumn("more", share("upto") - share("(upto - m)")).select("key", "size", "salt", "base", "more", "total", "target", "rate")
    at = ["key", "size", "salt"]
    ranked = salted.withColumn("rank", F.row_number().over(Window.partitionBy(*at).orderBy(F.xxhash64(F.lit(13), "doc_id"), "doc_id", *([content] if keep else []))))
    copies = F.when(F.col("size") == 0, F.lit(0)).otherwise(F.col("base") + F.when(F.col("rank") <= F.col("more"), 1).otherwise(0)).cast("long")
    return ranked.join(parts, at).select("doc_id", "source", "size", F.col("total").alias("source_size"), "target", "rate", copies.alias("copies"), (copies * F.col("size")).alias("taken"), *(["kept"] if keep else []))
