"""Near-duplicate documents by Order MinHash, with verification by banded alignment."""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache
from hashlib import blake2b

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.llm.components import components
from brindle.llm.shared import cut, looked_up, ship, text_of

WORDS = re.compile(r"[^\W_]+")
GOLDEN = np.uint64(0x9E3779B97F4A7C15)
MIX = np.uint64(0xBF58476D1CE4E5B9)
FACTOR = np.uint64(0x100000001B3)
#: Texts of at most so many k-mers are candidates if they share one sketch: they may share few by chance.
SHORT = 16


def words_of(text: str) -> list[str]:
    """Lower-case runs of letters and digits; where there are none, what white space separates."""
    return WORDS.findall(text.lower()) or text.split()


@lru_cache(maxsize=200_000)
def _word_hash(word: str) -> int:
    return int.from_bytes(blake2b(word.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * MIX
    return x ^ (x >> np.uint64(31))


def labelled_kmers(words: list[str], k: int) -> np.ndarray:
    """Hashes of the k-word shingles in text order, each with the number of its occurrence mixed in, so that
    all are distinct. Fewer than k words make one shingle, none make none."""
    if not words:
        return np.zeros(0, dtype=np.uint64)
    h = np.fromiter(map(_word_hash, words), dtype=np.uint64, count=len(words))
    n = max(1, len(h) - k + 1)
    out = np.zeros(n, dtype=np.uint64)
    for i in range(min(k, len(h))):
        out = out * FACTOR + h[i : i + n]
    out = _mixed(out)
    order = np.argsort(out, kind="stable")
    same = out[order][1:] == out[order][:-1]
    if same.any():
        run = np.concatenate(([0], np.where(same, 0, np.arange(1, n))))
        occurrence = np.empty(n, dtype=np.uint64)
        occurrence[order] = np.arange(n) - np.maximum.accumulate(run)
        out = _mixed(out + occurrence * GOLDEN)
    return out


def order_minhash(kmers: np.ndarray, sketches: int, picks: int) -> np.ndarray:
    """Order MinHash: for each hash function, the ``picks`` k-mers of least hash, read in text order.

    Two texts agree in a sketch if their least k-mers are the same ones in the same order: likelier the
    smaller the edit distance is, and never by shuffled text alone.
    """
    seeds = _mixed(np.arange(1, sketches + 1, dtype=np.uint64) * GOLDEN)
    x = (kmers[None, :] ^ seeds[:, None]) * MIX
    x ^= x >> np.uint64(32)
    if len(kmers) > picks:
        at = np.sort(np.argpartition(x, picks - 1, axis=1)[:, :picks], axis=1)
    else:
        at = np.broadcast_to(np.arange(len(kmers)), (sketches, len(kmers)))
    out = seeds.copy()
    for j in range(at.shape[1]):
        out = _mixed(out * FACTOR + kmers[at[:, j]])
    return out.view(np.int64)


def aligned_similarity(a: np.ndarray, b: np.ndarray, least: float) -> float:
    """Similarity of two sequences of distinct k-mers: aligned / (len(a) + len(b) - aligned), 0 if below ``least``.

    aligned is the length of the longest common subsequence inside a diagonal band. Where the similarity
    is ``least`` or more, at most (1 - least) / least of the shorter sequence is out of place, so no such
    alignment leaves the band. As k-mers are distinct, the alignment is a longest increasing run of places.
    """
    n, m = len(a), len(b)
    _, ia, ib = np.intersect1d(a, b, return_indices=True)
    if not len(ia) or len(ia) < least * (n + m - len(ia)):
        return 0.0
    ib = ib[np.argsort(ia, kind="stable")]
    ia = np.sort(ia)
    band = int((1 - least) / least * min(n, m)) + 1
    ib = ib[np.abs(ia - ib) <= band]
    aligned = len(ib)
    if (np.diff(ib) <= 0).any():
        tails: list[int] = []
        for x in ib.tolist():
            k = bisect_left(tails, x)
            if k == len(tails):
                tails.append(x)
            else:
                tails[k] = x
        aligned = len(tails)
    similarity = aligned / (n + m - aligned)
    return similarity if similarity >= least - 1e-12 else 0.0


def _node(words: list[str]) -> bytes:
    return blake2b("\x1f".join(words).encode("utf-8", "surrogatepass"), digest_size=16).digest()


def _links(rows: pd.DataFrame, starts: np.ndarray, min_shared: int, similarity: float) -> pd.DataFrame:
    """Links between components, in groups of nodes that lie one after the other: a, b, at most one fewer than nodes a group.

    A pair of blocks ``lo`` and ``hi`` of a bucket is compared whole, but for pairs that are connected already. A
    pair that shares an earlier sketch is left to that bucket. The k-mers that a node shares with all others are
    counted over an index of the group, so that only pairs that may reach ``similarity`` are aligned.
    """
    nodes, lo, hi, own, sketch = (rows[c].to_numpy() for c in ("node", "lo", "hi", "own", "i"))
    comp = pd.factorize(rows["comp"])[0]
    keys = np.array(rows["keys"].tolist(), dtype=np.int64).reshape(len(rows), -1)
    kmers = [np.asarray(x) for x in rows["kmers"]]
    n = np.array([len(x) for x in kmers], dtype=np.int64)
    out = []
    for start, stop in zip(starts.tolist(), [*starts[1:].tolist(), len(rows)]):
        if (comp[start:stop] == comp[start]).all():
            continue
        left = start + np.nonzero(own[start:stop] == lo[start])[0]
        right = left if lo[start] == hi[start] else start + np.nonzero(own[start:stop] == hi[start])[0]
        if not len(left) or not len(right):
            continue
        root = {c: c for c in set(comp[start:stop].tolist())}

        def find(c: int) -> int:
            while root[c] != c:
                root[c] = c = root[root[c]]
            return c

        label = comp[start:stop].copy()
        postings = None
        for r in left.tolist():
            fits = (label[right - start] != label[r - start]) & (np.minimum(n[right], n[r]) >= np.maximum(n[right], n[r]) * (similarity - 1e-12))
            if left is right:
                fits &= right > r
            at = np.nonzero(fits)[0]
            if not len(at):
                continue
            equal = keys[right[at]] == keys[r]
            needed = np.where(np.minimum(n[right[at]], n[r]) <= SHORT, 1, min_shared)
            at = at[(equal.sum(axis=1) >= needed) & ~equal[:, : sketch[start]].any(axis=1)]
            if not len(at):
                continue
            if len(at) > 8:
                if postings is None:  # k-mers of the right side in order, with the place of their node
                    flat = np.concatenate([kmers[j] for j in right])
                    order = np.argsort(flat, kind="stable")
                    postings = flat[order], np.repeat(np.arange(len(right)), n[right])[order]
                first, last = (np.searchsorted(postings[0], kmers[r], side=side) for side in ("left", "right"))
                spans = last - first
                hits = postings[1][np.repeat(first - np.cumsum(spans) + spans, spans) + np.arange(spans.sum())]
                common = np.bincount(hits, minlength=len(right))[at]
                at = at[common >= (similarity - 1e-12) * (n[right[at]] + n[r] - common)]
            for j in right[at].tolist():
                x, y = find(int(comp[r])), find(int(comp[j]))
                if x != y and aligned_similarity(kmers[r], kmers[j], similarity):
                    root[max(x, y)] = min(x, y)
                    out.append((min(nodes[r], nodes[j]), max(nodes[r], nodes[j])))
                    label = np.array([find(c) for c in comp[start:stop].tolist()])
    return pd.DataFrame(out, columns=["a", "b"])


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    k: int = 5,
    similarity: float = 0.8,
    sketches: int = 24,
    picks: int = 3,
    min_shared: int = 3,
    block: int = 400_000,
    block_nodes: int = 1024,
) -> DataFrame:
    """Classes of near-duplicates: doc_id, class_id, class_size, n_words; one row per row of ``docs``.

    Two documents are linked if the banded alignment of their ``k``-word shingles (aligned_similarity) is
    ``similarity`` or more; a class is a connected component of links; class_id is its smallest doc_id.

    1. Texts with the same words collapse to one node; only distinct texts are compared.
    2. Each node has ``sketches`` Order MinHash values of ``picks`` k-mers. Linked texts of more than SHORT k-mers share
       one with a chance of about similarity ** picks (0.51) or more, and at least ``min_shared`` of 24 but for a chance of
       3e-5; pairs that share fewer are not candidates. For shorter texts the chance is 0.4 at least, and one shared value
       makes a candidate: a link is missed with a chance of 5e-6.
    3. In each bucket (nodes that share a value), every node is paired with the node that has the most company over all
       buckets: the original of a group of copies. Of these pairs each node keeps the one that it meets in most
       buckets. They are verified, and linked ones merge.
    4. Only buckets that still hold several components are looked at again, in pairs of blocks of about ``block`` k-mers
       (or one longer text) and ``block_nodes`` nodes at most, each of which a task compares whole: no pair of a bucket that could be a link is
       left out. Pairs stay inside the task; it returns links that connect components, fewer than it has nodes.
       A bucket of many texts that don't link is sent once for each of its blocks: the price of comparing all.

    K-mers are compared by 32 bits. Two in a text of n words are equal by chance with a chance of n * n / 2 ** 33 (1e-8 for 10
    words, 5% for 20,000), which moves its similarities by 1 / n at most: only a pair within 1 / n of ``similarity`` could be
    judged otherwise.

    Nothing of this reaches the driver but counts. A bucket or group of any size is dealt over tasks: it
    meets in minima and counts (map-side first), in joins that broadcast their bounded number of hot keys (looked_up), or in blocks.

    Defined cases: texts without words are a class of their own each, with class_id = doc_id; texts count whole, however
    long; repeated rows are one text, in one class; null ids never give a class_id if the class has another; of nodes with
    equal company the larger digest leads, which changes no class; an empty table gives no rows; other columns,
    whatever their names, are ignored.
    """
    ship(docs.sparkSession)
    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(F.col(text_col)).alias("text"))

    def sketch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for text in batch["text"]:
                words = words_of(text)
                kmers = labelled_kmers(words, k)
                rows.append((_node(words), len(words), len(kmers), order_minhash(kmers, sketches, picks) if words else np.zeros(0, np.int64)))
            out = pd.DataFrame(rows, columns=["node", "n_words", "n", "keys"])
            out.insert(0, "doc_id", batch["doc_id"].astype("Int64").array)
            yield out
        _word_hash.cache_clear()  # workers are used again, also for other work

    rows = cut(narrow.mapInPandas(sketch, "doc_id long, node binary, n_words int, n int, keys array<long>"))
    nodes = cut(rows.where("n > 0").groupBy("node").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("keys").alias("keys"), F.count(F.lit(1)).alias("docs")))
    entries = nodes.select("node", "n", F.posexplode("keys").alias("i", "key"))
    shared = entries.groupBy("i", "key").agg(F.count(F.lit(1)).alias("size"), F.sum("n").alias("kmers")).where("size > 1")
    buckets = cut(entries.join(shared, ["i", "key"]))

    def shingles(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            made = [(_node(w), (labelled_kmers(w, k) >> np.uint64(32)).astype(np.uint32).view(np.int32)) for w in map(words_of, batch["text"])]
            yield pd.DataFrame(made, columns=["node", "kmers"])
        _word_hash.cache_clear()

    # The k-mers of all nodes with company, made anew from their texts: once, for both rounds of comparing.
    needed = buckets.select("node").distinct().join(nodes.select("node", "rep"), "node")
    texts = narrow.join(needed.select("rep").distinct(), F.col("doc_id").eqNullSafe(F.col("rep")), "left_semi")
    made = cut(texts.mapInPandas(shingles, "node binary, kmers array<int>").join(needed.select("node"), "node", "left_semi").dropDuplicates(["node"]))

    def verified(pairs: DataFrame) -> DataFrame:
        """a, b, similarity of the pairs."""
        both = pairs.join(made.withColumnsRenamed({"node": "a", "kmers": "ka"}), "a").join(made.withColumnsRenamed({"node": "b", "kmers": "kb"}), "b")

        def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                yield batch[["a", "b"]].assign(similarity=[aligned_similarity(np.asarray(x), np.asarray(y), similarity) for x, y in zip(batch["ka"], batch["kb"])])

        return cut(both.select("a", "b", "ka", "kb").mapInPandas(compare, "a binary, b binary, similarity double"))

    pair = [F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b")]
    company = buckets.groupBy("node").agg(F.sum(F.col("size") - 1).alias("company"))
    ranked = buckets.join(company, "node")
    leaders = ranked.groupBy("i", "key").agg(F.max(F.struct("company", "node", "n")).alias("lead")).select("i", "key", F.col("lead.node").alias("other"), F.col("lead.n").alias("m"))
    fits = F.least("n", "m") >= F.greatest("n", "m") * (similarity - 1e-12)
    met = buckets.join(leaders, ["i", "key"]).where("node <> other").where(fits).groupBy("node", "other").agg(F.count(F.lit(1)).alias("met"), F.first(F.least("n", "m")).alias("least"))
    best = met.where((F.col("met") >= min_shared) | (F.col("least") <= SHORT)).groupBy("node").agg(F.max(F.struct("met", "other")).alias("best"))
    checked = verified(cut(best.select("node", F.col("best.other").alias("other")).select(*pair).distinct()))
    labels = components(checked.where("similarity > 0"))

    placed = buckets.join(labels, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    open_ = placed.groupBy("i", "key").agg((F.min("comp") != F.max("comp")).alias("several")).where("several").select("i", "key")
    rest = cut(placed.join(open_, ["i", "key"]))
    n_blocks = F.greatest(F.ceil(F.col("kmers") / block), F.ceil(F.col("size") / block_nodes)).cast("int")
    own = rest.withColumn("own", F.pmod(F.xxhash64("node"), n_blocks).cast("int"))
    dealt = own.withColumn("to", F.explode(F.sequence(F.lit(0), n_blocks - 1))).withColumns({"lo": F.least("own", "to"), "hi": F.greatest("own", "to")})

    def link(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Groups stream by in order; a group that a batch cuts waits for its rest."""
        held = None
        for batch in batches:
            held = batch if held is None else pd.concat((held, batch), ignore_index=True)
            marks = [held[c].to_numpy() for c in ("i", "key", "lo", "hi")]
            new = np.logical_or.reduce([m[1:] != m[:-1] for m in marks])
            starts = np.concatenate(([0], np.nonzero(new)[0] + 1))
            if len(starts) > 1:
                yield _links(held.iloc[: starts[-1]], starts[:-1], min_shared, similarity)
                held = held.iloc[starts[-1] :].reset_index(drop=True)
        if held is not None:
            yield _links(held, np.array([0]), min_shared, similarity)

    at = ["i", "key", "lo", "hi"]
    full = dealt.select(*at, "own", "node", "comp").join(nodes.select("node", "keys"), "node").join(made, "node")
    new = cut(full.repartition(*at).sortWithinPartitions(*at).mapInPandas(link, "a binary, b binary").distinct())
    if not new.isEmpty():
        labels = components(checked.where("similarity > 0").select("a", "b").unionByName(new))

    # From rows to nodes to components and back, by tables of one row a key.
    linked = cut(labels.join(nodes.select("node", "rep", "docs"), "node"))
    sizes = cut(linked.groupBy("comp").agg(F.min("rep").alias("class_id"), F.sum("docs").alias("class_size"), F.count(F.lit(1)).alias("members")))
    several = looked_up(linked.select("node", "comp"), sizes, "comp", "members").drop("comp")
    classes = cut(nodes.select("node", "rep", "docs").join(several, "node", "left").select("node", F.coalesce("class_size", "docs").alias("class_size"), F.when(F.col("class_size").isNull(), F.col("rep")).otherwise(F.col("class_id")).alias("class_id"), "docs"))
    found = looked_up(rows.where("n_words > 0").select("doc_id", "node", "n_words"), classes, "node", "docs").select("doc_id", "class_id", "class_size", "n_words")
    lone = rows.where("n_words = 0").select("doc_id", F.col("doc_id").alias("class_id"), F.lit(1).cast("long").alias("class_size"), "n_words")
    return found.unionByName(lone)
