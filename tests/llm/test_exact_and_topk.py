"""Many heavy digests at once, and vectors whose components need more than 24 bits or whose rows repeat."""

import math
from collections import Counter
from fractions import Fraction

import numpy as np
from pyspark.sql import functions as F

from brindle.llm.bsi_topk import bsi_topk, shown
from brindle.llm.exact_dedup import exact_dedup

SCHEMA = "doc_id bigint, text string"
VECTORS = "vec_id bigint, embedding array<double>"


def test_heavy_and_light_digests(spark):
    rows = [(i, f"text {i % 150}" if i % 3 else ("hot" if i % 2 else f"rare {i}")) for i in range(3000)] + [(None, "hot"), (5, None), (6, ""), (5, None)]
    groups = Counter(t or "" for _, t in rows)
    best = {}
    for i, t in rows:
        best[t or ""] = max(best.get(t or "", -1), -1 if i is None else i)
    for counters in (8, 64, 8192):
        found = exact_dedup(spark.createDataFrame(rows, SCHEMA).repartition(5), counters=counters)
        sizes = Counter((r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in found.collect())
        assert sizes == Counter((i, best[t or ""], groups[t or ""], i == best[t or ""]) for i, t in rows)


def brute(rows, k=5):
    ok = [(n, i, [math.floor(Fraction(x) * 256) for x in v]) for n, (i, v) in enumerate(rows)]
    out = []
    for n, q, a in ok:
        if q % 50 == 0:
            scored = sorted((-sum(x * y for x, y in zip(a, b)), i) for m, i, b in ok if m != n and len(a) == len(b))[:k]
            out += [(q, r + 1, i, min(max(-s, -(2**63)), 2**63 - 1)) for r, (s, i) in enumerate(scored)]
    return sorted(out)


def test_any_finite_component(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.normal(0, 1, 3)]) for i in range(120)]
    rows += [(i, [float(x) for x in rng.normal(0, 1, 3) * 10.0 ** float(e)]) for i, e in zip(range(120, 160), rng.integers(4, 30, 40))]
    rows += [(200, [70_000.0, 1.0, -3.5]), (250, [1e308, -1e300, 5e-324]), (251, [1e300, 1e300, 1e300]), (252, [-1e300, 1e18, 0.0])]
    df = spark.createDataFrame(rows, VECTORS)
    for options in ({}, {"block_rows": 50, "block_queries": 2}):
        assert sorted(map(tuple, bsi_topk(df, F.col("vec_id") % 50 == 0, **options).collect())) == brute(rows)


def test_rows_that_share_an_id(spark):
    rows = [(0, [1.0, 2.0]), (0, [1.0, 2.0]), (0, [3.0, -1.0]), (50, [0.5, 0.5]), (50, [0.5, 0.5]), (7, [1.0, 1.0]), (8, [1.0, 1.0])]
    found = sorted(map(tuple, bsi_topk(spark.createDataFrame(rows, VECTORS), F.col("vec_id") % 50 == 0).collect()))
    assert found == brute(rows)


def test_order_of_scores_beyond_64_bits():
    scores = [-(10**40), -(10**39), -(2**63) - 1, -(2**63), -(2**63) + 1, -1, 0, 2**63 - 2, 2**63 - 1, 2**63, 10**39, 10**40]
    assert [shown(s) for s in scores] == sorted(shown(s) for s in scores)
