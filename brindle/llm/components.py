"""Connected components of a graph that is never brought to the driver."""

from __future__ import annotations

from math import ceil

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.llm.shared import cut, looked_up


def components(edges: DataFrame, a: str = "a", b: str = "b", per_task: int = 100_000) -> DataFrame:
    """node, comp for every node of the edges: comp is the smallest node of its component.

    Every round takes the smallest label among a node's own and its neighbours', then jumps to that label's
    label; rounds are about the logarithm of the longest path. Labels are checkpointed each round. A node with very many
    neighbours, and a label that very many nodes have, is looked up by broadcast (see looked_up); minima are taken
    map-side first. A task has about ``per_task`` edges.

    Defined cases: an edge that repeats counts once; an edge from a node to itself makes it a component; ties don't
    arise, as nodes differ; no edges give no rows; other columns are ignored.
    """
    both = edges.select(F.col(a).alias("node"), F.col(b).alias("other"))
    both = cut(both.unionByName(both.select(F.col("other").alias("node"), F.col("node").alias("other"))))
    parts = max(1, ceil(both.count() / per_task))  # a small graph is no work for many tasks, whose files would outweigh it
    small = lambda df: df.coalesce(parts)
    both = cut(small(both.distinct()))
    labels = cut(small(both.groupBy("node").agg(F.min("other").alias("least"), F.count(F.lit(1)).alias("degree")).select("node", F.least("node", "least").alias("comp"), "degree")))
    while True:
        theirs = labels.select(F.col("node").alias("other"), F.col("comp").alias("theirs"), "degree")
        near = small(looked_up(both, theirs, "other", "degree")).groupBy("node").agg(F.min("theirs").alias("theirs"))
        lower = cut(small(labels.join(near, "node", "left").select("node", F.least("comp", "theirs").alias("to"), F.col("comp").alias("was"), "degree")))
        jump = labels.select(F.col("node").alias("to"), F.col("comp").alias("beyond"))
        targets = cut(small(lower.groupBy("to").agg(F.count(F.lit(1)).alias("n")).join(jump, "to", "left").select("to", F.least("to", F.coalesce("beyond", "to")).alias("beyond"), "n")))
        new = cut(small(looked_up(lower, targets, "to", "n").select("node", F.col("beyond").alias("comp"), "was", "degree")))
        labels = new.select("node", "comp", "degree")
        if new.where(F.col("comp") != F.col("was")).isEmpty():
            return labels.select("node", "comp")
