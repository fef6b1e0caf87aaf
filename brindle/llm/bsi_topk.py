"""Exact top-k by inner product on a bit-sliced index."""

from __future__ import annotations

import math
from fractions import Fraction

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brindle.llm.shared import cut, ship

#: Quantised components up to this magnitude stay in 64-bit numbers, with scores of up to 2**14 components; others are Python's.
NARROW = 2**24
#: Scores are 64-bit: beyond it they are shown as these.
LEAST, MOST = -(2**63), 2**63 - 1


def pack(bits: np.ndarray) -> np.ndarray:
    """Rows of booleans as bitmaps of 64-bit words."""
    packed = np.packbits(np.ascontiguousarray(bits), axis=-1, bitorder="little")
    return np.ascontiguousarray(np.pad(packed, [(0, 0)] * (packed.ndim - 1) + [(0, -packed.shape[-1] % 8)])).view("<u8")


class Slices:
    """A bit-sliced index: for each attribute (vector component), a bitmap over the rows for each of its bits.

    Components are kept with an offset that makes them at least 0, so all slices count positive. ``rows`` tells
    apart rows of one id.
    """

    def __init__(self, ids: np.ndarray, rows: np.ndarray, x: np.ndarray):
        order = np.lexsort((rows, ids))
        self.ids, self.rows, self.x = ids[order], rows[order], x[order]
        self.low = self.x.min(axis=0)
        shifted = self.x - self.low
        depth = max(1, int(shifted.max()).bit_length()) if shifted.size else 1
        self.planes = [pack((shifted >> b & 1).astype(bool).T) for b in range(depth)]  # [bit][component] -> bitmap
        self.valid = pack(np.ones((1, len(ids)), dtype=bool))[0]
        self.zero = np.zeros_like(self.valid)

    def scores(self, q: np.ndarray) -> list[np.ndarray]:
        """Slices of the inner products with q, lowest first, up to a constant that is the same for all rows.

        sum(q * x) is a sum of slices at weights of two: each bit of |q| moves an attribute's slices up. A
        component with q < 0 takes part as |q| * (top - x), that is with its slices inverted. Slices of one
        weight are added by full adders: three bitmaps give a sum of this weight and a carry of the next.
        """
        depth = len(self.planes)
        columns: list[list[np.ndarray]] = [[] for _ in range(depth)]
        for d, v in enumerate(q.tolist()):
            size, bit = abs(v), 0
            while size:
                if size & 1:
                    while len(columns) < bit + depth:
                        columns.append([])
                    for b in range(depth):
                        columns[bit + b].append(self.planes[b][d] if v > 0 else ~self.planes[b][d])
                size, bit = size >> 1, bit + 1
        out, w = [], 0
        while w < len(columns):
            column = columns[w]
            if w + 1 == len(columns) and len(column) > 1:
                columns.append([])
            while len(column) > 2:
                rest = []
                for i in range(0, len(column) - 2, 3):
                    a, b, c = column[i : i + 3]
                    half = a ^ b
                    rest.append(half ^ c)
                    carry = a & b
                    half &= c
                    carry |= half
                    columns[w + 1].append(carry)
                column = rest + column[len(column) - len(column) % 3 :]
            if len(column) == 2:
                columns[w + 1].append(column[0] & column[1])
                column = [column[0] ^ column[1]]
            out.append(column[0] if column else self.zero)
            w += 1
        return out

    def top(self, q: np.ndarray, k: int, own: int, row: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of the k rows with the highest inner product, ties to the smaller id; without the row ``row`` of id ``own``.

        From the most significant slice downward: rows that are surely among the first k, and rows that are
        equal so far. Those still equal at the end are the boundary: the smallest ids of them fill up.
        """
        slices = self.scores(q)
        sure, equal = self.zero.copy(), self.valid.copy()
        first, stop = np.searchsorted(self.ids, own, "left"), np.searchsorted(self.ids, own, "right")
        at = first + np.searchsorted(self.rows[first:stop], row)
        if at < stop and self.rows[at] == row:
            equal[at >> 6] &= ~np.uint64(1 << (int(at) & 63))
        for bits in reversed(slices):
            higher = equal & bits
            n = int(np.bitwise_count(sure | higher).sum())
            if n > k:
                equal = higher
            else:
                sure |= higher
                equal &= ~bits
                if n == k:
                    equal = self.zero
                    break
        chosen = self._rows(sure)
        boundary = self._rows(equal)[: max(0, k - len(chosen))]
        rows = np.concatenate((chosen, boundary))
        return self.ids[rows], self.x[rows] @ q

    def _rows(self, bitmap: np.ndarray) -> np.ndarray:
        return np.nonzero(np.unpackbits(bitmap.view(np.uint8), count=len(self.ids), bitorder="little"))[0]


def quantised(vectors: DataFrame, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """vec_id, dims, x of the vectors without nulls and non-finite components: x holds floor(scale * component), but is null where
    one of them is beyond NARROW; ``far`` holds the components of such vectors as they are."""
    v: Column = F.col(vector_col)
    ok = v.isNotNull() & F.col(id_col).isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    wide = F.exists(v, lambda x: F.abs(x.cast("double")) * scale > NARROW)
    x = F.when(~wide, F.transform(v, lambda x: F.floor(x.cast("double") * scale).cast("int"))).alias("x")
    return vectors.where(ok).select(F.col(id_col).cast("long").alias("vec_id"), F.size(v).alias("dims"), x, F.when(wide, v.cast("array<double>")).alias("far"))


def matrix(rows: pd.DataFrame, dims: int, scale: int) -> np.ndarray:
    """Quantised vectors as a matrix of 64-bit numbers, or of Python's where they come as ``far``."""
    if len(rows) and rows["x"].isna().iloc[0]:
        return np.array([[math.floor(Fraction(v) * scale) for v in row] for row in rows["far"]], dtype=object).reshape(len(rows), dims)
    return np.array(rows["x"].tolist(), dtype=np.int64).reshape(len(rows), dims)


def shown(score: int) -> tuple[int, str]:
    """A score as a 64-bit number, and a text that orders scores which that number can't tell apart (larger: later)."""
    if LEAST < score < MOST:
        return score, ""
    digits = str(abs(score))
    if score > 0:
        return min(score, MOST), f"{len(digits):04d}{digits}"
    return max(score, LEAST), f"{9999 - len(digits):04d}" + "".join(str(9 - int(d)) for d in digits)


def bsi_topk(
    vectors: DataFrame, query: Column, k: int = 5, scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding", block_rows: int = 65_536, block_queries: int = 512
) -> DataFrame:
    """The k rows of highest integer inner product for every row where ``query`` (over vec_id) holds: query_id, rank, vec_id, score.

    Rows are dealt by a hash of the id to blocks of about ``block_rows``, queries to blocks of at most about
    ``block_queries``, smaller ones where there would be less work than cores; every pair of blocks is a task that indexes its rows
    and answers its queries, and sends on at most k rows a query, of which the best k remain. Rows travel once for each
    block of queries and queries once for each block of rows; pairs of rows are never made. A query's own row is no
    candidate of it; another row of the same id is.

    Vectors with a component beyond 2**24 after scaling have blocks of their own, whose slices are as deep as they
    need: their scores are exact at any size.

    Defined cases: vectors that are null, or hold null, NaN or infinite components, take no part, nor do null
    ids; only vectors of the same length are compared, and empty ones score 0; equal scores go to the smaller id; an id
    that repeats is a candidate and a query once for each of its rows; scores beyond 64 bits are ranked by their
    exact value and shown as the nearest 64-bit number; fewer than k candidates give fewer rows; an empty table gives
    no rows; other columns are ignored.
    """
    ship(vectors.sparkSession)
    # Written once: the rows are read several times, and their numbers must stay.
    rows = cut(quantised(vectors, id_col, vector_col, scale).select("*", F.monotonically_increasing_id().alias("row")))
    stats = rows.agg(F.count("x").alias("n"), F.count("far").alias("n_wide"), F.count(F.when(query, 1)).alias("q")).first()
    n_rows, n_wide = max(1, math.ceil(stats["n"] / block_rows)), math.ceil(stats["n_wide"] / 1024)
    cores = vectors.sparkSession.sparkContext.defaultParallelism
    n_queries = max(1, math.ceil(stats["q"] / block_queries), min(math.ceil(stats["q"] / 128), math.ceil(cores / n_rows)))
    block = lambda salt, n: F.pmod(F.xxhash64(F.lit(salt), "vec_id", "row"), F.lit(max(1, n))).cast("int")
    dealt = F.when(F.col("far").isNull(), block(19, n_rows)).otherwise(n_rows + block(19, n_wide)).alias("rb")
    index = rows.select("*", dealt, F.explode(F.sequence(F.lit(0), F.lit(n_queries - 1))).alias("qb"))
    asked = rows.where(query).select("*", block(23, n_queries).alias("qb"), F.explode(F.sequence(F.lit(0), F.lit(n_rows + n_wide - 1))).alias("rb"))

    def answer(key: tuple, candidates: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        dims, found = key[0], []
        if len(candidates) and len(queries):
            slices = Slices(candidates["vec_id"].to_numpy(), candidates["row"].to_numpy(), matrix(candidates, dims, scale))
            for part in (queries[queries["far"].isna()], queries[queries["far"].notna()]):
                for query_id, row, q in zip(part["vec_id"].tolist(), part["row"].tolist(), matrix(part, dims, scale)):
                    ids, scores = slices.top(q, k, query_id, row)
                    found += [(query_id, row, i, *shown(int(s))) for i, s in zip(ids.tolist(), scores.tolist())]
        return pd.DataFrame(found, columns=["query_id", "row", "vec_id", "score", "beyond"])

    best = index.groupBy("dims", "rb", "qb").cogroup(asked.groupBy("dims", "rb", "qb")).applyInPandas(answer, "query_id long, row long, vec_id long, score long, beyond string")
    order = Window.partitionBy("query_id", "row").orderBy(F.desc("score"), F.desc("beyond"), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


#: DuckDB SQL for bsi_topk over the table embeddings, for components of equal number.
ORACLE_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
s AS (
  SELECT a.vec_id AS query_id, b.vec_id, CAST(list_sum(list_transform(list_zip(a.q, b.q), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id
)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM s QUALIFY rank <= 5
"""
