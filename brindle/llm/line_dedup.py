"""Line deduplication that returns keep bitmaps, on DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brindle.llm.shared import BLANKS, cut, text_of

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Lines of one bitmap word.
BITS = 64


def lines_of(text: Column) -> Column:
    """The lines of a text; a null or empty one has a single empty line."""
    return F.split(text_of(text), "\n", -1)


def line_key(line: Column) -> Column:
    """The line without white space at its ends, A-Z in lower case."""
    return F.translate(F.btrim(line, F.lit(BLANKS)), UPPER, LOWER)


def keep_bitmaps(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 10, salts: int = 32) -> DataFrame:
    """Which lines of each document to drop: doc_id, text_hash, n_dropped, holes.

    A key of ``min_chars`` code points or more loses its lines in every document but the one with the
    smallest id that holds it. ``holes`` is the keep bitmap in compressed form: a map from the number of a
    64-line word to the bits of that word that are *not* kept; words without an entry are kept whole, and
    documents without a row here keep all. ``text_hash`` tells apart rows that share an id.

    Hashes of 128 bits are range-partitioned and sorted by (hash, document, position), so that the first
    occurrence is read off a stream. A key that a third of all lines share would be one range: the first
    round therefore ranges over (hash, one of ``salts`` parts of the documents) and drops all that is not
    first in its part; the second has at most ``salts`` documents for each hash and settles it.

    Defined cases: null and empty texts have one empty line, which is too short to drop; a null id counts
    as the largest id, and all rows with it as one document; rows that share an id count as one document; of equal keys in
    a document none goes before another, as they stay or go together; very long texts and lines count whole; an
    empty table gives no rows; other columns, whatever their names, are ignored.
    """
    text = text_of(F.col(text_col))
    lines = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("text_hash"), F.posexplode(lines_of(F.col(text_col))).alias("pos", "line"))
    key = line_key(F.col("line"))
    # Written once: ranging would else split and hash all texts again to find its bounds, and for each use.
    hashed = cut(
        lines.where(F.char_length(key) >= min_chars).select(
            F.xxhash64(key).alias("h1"), F.xxhash64(F.lit(7), key).alias("h2"), F.pmod(F.xxhash64(F.lit(3), "doc_id"), F.lit(salts)).cast("byte").alias("part"), "doc_id", "text_hash", "pos"
        )
    )

    def firsts(rows: DataFrame, *by: str) -> DataFrame:
        stream = Window.partitionBy(*by).orderBy(F.asc_nulls_last("doc_id"), "pos")
        first = F.first("doc_id").over(stream.rowsBetween(Window.unboundedPreceding, Window.currentRow))
        return rows.repartitionByRange(*by).withColumn("is_first", F.col("doc_id").eqNullSafe(first))

    by_part = firsts(hashed, "h1", "h2", "part")
    settled = firsts(by_part.where("is_first").drop("is_first"), "h1", "h2")
    at = ["doc_id", "text_hash", "pos"]
    dropped = by_part.where("NOT is_first").select(*at).unionByName(settled.where("NOT is_first").select(*at))
    words = dropped.groupBy("doc_id", "text_hash", F.expr(f"pos div {BITS}").cast("int").alias("word")).agg(F.bit_or(F.expr(f"shiftleft(1L, pos % {BITS})")).alias("bits"))
    return words.groupBy("doc_id", "text_hash").agg(F.sum(F.bit_count("bits")).cast("long").alias("n_dropped"), F.map_from_entries(F.collect_list(F.struct("word", "bits"))).alias("holes"))


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """Apply keep_bitmaps: doc_id, n_lines, n_dropped, kept_text, one row per row of ``docs``.

    Kept lines are joined by \\n; a document that loses every line has an empty text. The cases of
    keep_bitmaps hold; rows that repeat (id and text) repeat in the result.
    """
    text = text_of(F.col(text_col))
    texts = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("text_hash"))
    holes = keep_bitmaps(docs, id_col, text_col, **options).withColumnsRenamed({"doc_id": "hole_id", "text_hash": "hole_hash"})
    both = texts.join(holes, F.col("doc_id").eqNullSafe(F.col("hole_id")) & (F.col("text_hash") == F.col("hole_hash")), "left")
    dense = F.expr(f"transform(sequence(0, cast((n_lines - 1) div {BITS} as int)), w -> coalesce(try_element_at(holes, w), 0L))")
    opened = both.withColumn("n_lines", F.size(lines_of(F.col("text"))).cast("long")).withColumn("dense", F.when(F.col("holes").isNotNull(), dense))
    kept = F.expr(f"array_join(filter(split(text, '\\n', -1), (line, i) -> (shiftright(dense[i div {BITS}], i % {BITS}) & 1L) = 0L), '\\n')")
    return opened.select("doc_id", "n_lines", F.coalesce("n_dropped", F.lit(0).cast("long")).alias("n_dropped"), F.when(F.col("holes").isNull(), F.col("text")).otherwise(kept).alias("kept_text"))


#: DuckDB SQL for the digests of line_dedup over the table documents.
ORACLE_SQL = f"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (SELECT doc_id, unnest(lines) AS line, unnest(range(len(lines))) AS pos FROM d),
k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(11) || chr(12) || chr(13)), '{UPPER}', '{LOWER}') AS key FROM l),
f AS (SELECT key, min(doc_id) AS first_id FROM k WHERE length(key) >= 10 GROUP BY key),
m AS (SELECT k.doc_id, k.pos, k.line, f.first_id IS NOT NULL AND f.first_id < k.doc_id AS gone FROM k LEFT JOIN f USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""
