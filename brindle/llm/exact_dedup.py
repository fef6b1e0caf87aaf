"""Exact deduplication with a split for heavy hitters, on DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brindle.llm.shared import cut, text_of


def exact_dedup(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    normalise=lambda text: text,
    counters: int = 8192,
) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Of the rows whose normalised text (null: empty) is equal, the one with the largest id stays.

    * A frequent-items sketch (the Misra-Gries family; ``counters`` counters, mergeable, so it is built map-side)
      names the candidates: every digest with more than about a 3.5 / ``counters`` share of the rows is among them. Its
      counts are estimates: the candidates are counted exactly, and those that have more than a 1 / ``counters``
      share are heavy. There are fewer than ``counters`` of them (a row of some 100 bytes each), whatever the
      data: these winners are broadcast.
    * Rows with a heavy digest take their winner from the broadcast and are never shuffled by digest.
    * Every other digest has so small a share of the rows that an ordinary shuffle by digest is even.

    Defined cases: null text is empty text and equal to it; very long texts count whole, by their SHA-256; an id that
    repeats within a group gets the same verdict on each of its rows; null ids lose to any other id; an empty table
    gives no rows; other columns of ``docs``, whatever their names, are ignored.
    """
    text: Column = normalise(text_of(F.col(text_col)))
    rows = cut(docs.select(F.col(id_col).alias("doc_id"), F.sha2(text, 256).alias("text_sha256")))
    share = rows.count() / counters
    named = rows.agg(F.expr(f"approx_top_k(text_sha256, {counters}, {counters})").alias("top")).select(F.explode("top.item").alias("text_sha256"))
    verdict = [F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")]
    counted = rows.join(F.broadcast(named), "text_sha256", "left_semi").groupBy("text_sha256").agg(*verdict)
    winners = F.broadcast(cut(counted.where((F.col("group_size") > share) & (F.col("group_size") > 1))))
    heavy_rows = rows.join(winners, "text_sha256")
    group = Window.partitionBy("text_sha256")
    light_rows = rows.join(winners, "text_sha256", "left_anti").select(
        "text_sha256", "doc_id", F.max("doc_id").over(group).alias("keep_id"), F.count(F.lit(1)).over(group).alias("group_size")
    )
    return heavy_rows.unionByName(light_rows).select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


#: DuckDB SQL for exact_dedup over the table documents.
ORACLE_SQL = """
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))
"""
