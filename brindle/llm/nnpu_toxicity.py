"""Toxicity by non-negative positive-unlabelled learning."""

from __future__ import annotations

import re
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.llm.shared import cut, ship, text_of

LETTERS = re.compile(r"[^\W\d_]+")
#: Lengths of the word beginnings that are features beside whole words.
PREFIXES = (4, 5, 6)


def hashes(word: str) -> tuple[int, ...]:
    """Features of a lower-case word, as 32-bit hashes: the word, and its beginnings (marked by a star)."""
    return tuple(crc32(x.encode("utf-8", "surrogatepass")) for x in (word, *(word[:n] + "*" for n in PREFIXES if len(word) > n)))


def words_of(text: str) -> set[str]:
    """Distinct lower-case words of a whole text."""
    return set(LETTERS.findall(text.lower()))


def features(text: str) -> np.ndarray:
    """Sorted distinct features of a whole text."""
    return np.unique(np.fromiter((h for w in words_of(text) for h in hashes(w)), dtype=np.uint32))


def places(text: np.ndarray, names: np.ndarray) -> np.ndarray:
    """Where the features of a text are among the sorted names; those that aren't are left out."""
    at = np.searchsorted(names, text)
    return at[names[np.minimum(at, len(names) - 1)] == text] if len(names) else at[:0]


class Rows:
    """A sparse matrix of zeros and ones: a row for each text, a column for each of ``width`` features; ``hits`` has the ones of each row."""

    def __init__(self, hits: list[np.ndarray], width: int):
        self.n, self.width = len(hits), width
        self.row = np.repeat(np.arange(len(hits)), [len(h) for h in hits])
        self.column = np.concatenate([*hits, np.zeros(0, dtype=np.int64)]).astype(np.int64)

    def sums(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, weights=w[self.column], minlength=self.n)

    def back(self, g: np.ndarray) -> np.ndarray:
        return np.bincount(self.column, weights=g[self.row], minlength=self.width)


def loss(z: np.ndarray) -> np.ndarray:
    """The sigmoid loss."""
    return 1 / (1 + np.exp(np.clip(z, -30, 30)))


def risks(xp: Rows, xu: Rows, w: np.ndarray, prior: float) -> tuple[float, float]:
    """The risk on positives, prior * E_p[l(f)], and that on negatives, E_u[l(-f)] - prior * E_p[l(-f)], which is corrected
    for the positives among the unlabelled texts. w: a weight for each feature, and the bias."""
    fp, fu = xp.sums(w[:-1]) + w[-1], xu.sums(w[:-1]) + w[-1]
    return prior * loss(fp).mean(), loss(-fu).mean() - prior * loss(-fp).mean()


def direction(xp: Rows, xu: Rows, w: np.ndarray, prior: float, gamma: float) -> np.ndarray:
    """What to step against: the gradient of both risks, or -gamma times that of the negatives' while it is below zero."""

    def slope(x: Rows, sign: float) -> np.ndarray:
        """Gradient of the mean of l(sign * f)."""
        f = x.sums(w[:-1]) + w[-1]
        s = loss(sign * f)
        g = -sign * s * (1 - s) / max(1, len(f))
        return np.append(x.back(g), g.sum())

    part = slope(xu, -1) - prior * slope(xp, -1)
    return prior * slope(xp, 1) + part if risks(xp, xu, w, prior)[1] >= 0 else -gamma * part


def fit_nnpu(xp: Rows, xu: Rows, prior: float, steps: int = 600, rate: float = 0.05, decay: float = 1e-3, gamma: float = 1.0) -> tuple[np.ndarray, float]:
    """Weights and bias of a linear classifier by the non-negative risk estimator: risks, the second not below zero (see
    direction). Full batches and Adam, from zero: the result is a function of the input."""
    w, m, v = (np.zeros(xp.width + 1) for _ in range(3))
    w[-1] = np.log(prior / (1 - prior)) / 4
    for t in range(1, steps + 1):
        g = direction(xp, xu, w, prior, gamma)
        g[:-1] += decay * w[:-1] / max(1, len(w))
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w[:-1], float(w[-1])


def _first(ids: DataFrame, rows: int) -> DataFrame:
    """The ``rows`` ids that come first by a hash."""
    return ids.select("doc_id").orderBy(F.xxhash64(F.lit(17), "doc_id"), "doc_id").limit(rows)


def _counts(docs: DataFrame) -> DataFrame:
    """feature, n: how many of the texts have each feature, and under -1 the number of texts. Partitions count for
    themselves and send their counts by feature, not texts."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names, sums, run, held, rows = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), [], 0, 0

        def add() -> None:
            nonlocal names, sums, run, held
            both = np.concatenate([names, *run])
            names, at = np.unique(both, return_inverse=True)
            sums, run, held = np.bincount(at, weights=np.concatenate([sums, np.ones(len(both) - len(sums))]), minlength=len(names)).astype(np.int64), [], 0

        for batch in batches:
            for text in batch["text"]:
                run.append(features(text).astype(np.int64))
                held += len(run[-1])
                rows += 1
                if held >= 200_000:
                    add()
        add()
        yield pd.DataFrame({"feature": np.append(names, -1), "n": np.append(sums, rows)})

    return cut(docs.select("text").mapInPandas(count, "feature long, n long").groupBy("feature").agg(F.sum("n").alias("n")))


def _rows_of(counts: DataFrame) -> int:
    found = counts.where("feature = -1").first()
    return found["n"] if found else 0


def learn(docs: DataFrame, labels: DataFrame, max_positive: int, max_unlabelled: int, least: int, ratio: float, broadcast_rows: int) -> tuple[dict[int, float], float]:
    """Weights by feature, and the bias. docs: doc_id, text; labels: doc_id, toxic (1 or 0), not null.

    The class prior is the share of toxic rows among all labelled ones. The classifier is fitted on at most
    ``max_positive`` confirmed toxic documents and, as unlabelled texts, at most ``max_unlabelled`` documents
    of the labelled pool whose labels are not read: toxic ones are among them, in the share of the prior.
    Features are chosen by all confirmed toxic documents: ``least`` of them must have one, at any size, and ``ratio``
    times as large a share of them as of the unlabelled texts.

    Texts and their features stay in Spark. The driver gets the chosen features, and for each text of the sample those
    of them that it has. A chosen feature is in more than ratio / (max_unlabelled + 1) of the toxic texts, so their
    number is at most that of the features of an average toxic text times (max_unlabelled + 1) / ratio.
    """
    one = labels.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    counts = one.agg(F.count(F.lit(1)).alias("n"), F.sum("toxic").alias("k")).first()
    if not counts["n"] or not counts["k"]:
        return {}, -10.0
    prior = min(0.95, max(0.005, counts["k"] / counts["n"]))
    toxic = one.where("toxic = 1").select("doc_id")
    flags = lambda p, u: [F.lit(p).alias("p"), F.lit(u).alias("u")]
    picked = _first(toxic, max_positive).select("doc_id", *flags(1, 0)).unionByName(_first(one, max_unlabelled).select("doc_id", *flags(0, 1)))
    picked = F.broadcast(picked.groupBy("doc_id").agg(F.max("p").alias("p"), F.max("u").alias("u")))  # max_positive + max_unlabelled rows at most
    sample = cut(docs.join(picked, "doc_id"))
    ids = F.broadcast(toxic) if counts["k"] <= broadcast_rows else toxic
    support, elsewhere = _counts(docs.join(ids, "doc_id", "left_semi")), _counts(sample.where("u = 1"))
    positives, unlabelled = _rows_of(support), _rows_of(elsewhere)
    common = F.col("n") * max(1, unlabelled) >= ratio * positives * (F.coalesce("other", F.lit(0)) + 1)
    chosen = support.where(F.col("feature") >= 0).where(F.col("n") >= least).join(elsewhere.withColumnRenamed("n", "other"), "feature", "left").where(common)
    names = np.sort(chosen.select("feature").toPandas()["feature"].to_numpy()).astype(np.uint32)
    if not len(names):
        return {}, -10.0

    def held(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch[["doc_id", "p", "u"]].assign(at=[places(features(t), names).astype(np.int32).tobytes() for t in batch["text"]])

    rows = sample.mapInPandas(held, "doc_id long, p int, u int, at binary").toPandas().sort_values(["doc_id", "at"])
    listed = [np.frombuffer(x, dtype=np.int32) for x in rows["at"]]
    part = lambda c: Rows([x for x, yes in zip(listed, rows[c]) if yes], len(names))
    weights, bias = fit_nnpu(part("p"), part("u"), prior)
    return {f: w for f, w in zip(names.tolist(), weights.tolist()) if w}, bias


def nnpu_toxicity(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    toxic_col: str = "toxic",
    folds: int = 5,
    held_fold: int = 0,
    max_positive: int = 3000,
    max_unlabelled: int = 8000,
    least: int = 3,
    ratio: float = 3.0,
    broadcast_rows: int = 2_000_000,
) -> DataFrame:
    """Toxicity of every whole text: doc_id, held_out, score, predicted; one row per row of ``docs``.

    held_out: crc32(doc_id as text) mod ``folds`` is ``held_fold``; such rows take no part in learning. The
    model (learn, fit_nnpu) sees texts only: presence of words and word beginnings that toxic texts have
    ``ratio`` times as often. score is the sigmoid of the model's sum, predicted is score >= 0.5. The ids of toxic
    documents are broadcast while there are at most ``broadcast_rows``, else joined by a shuffle.

    Defined cases: null and empty texts have no features and get the score of the bias; texts count whole, however long,
    and a word in them counts once; equal texts have equal scores; labels that are null
    count as none; a document labelled twice is toxic if any label says so; a null id is in fold 0; without
    a toxic training label all scores are near 0; an empty table gives no rows; other columns are ignored.
    """
    ship(docs.sparkSession)
    held = lambda c: F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary")) % folds == held_fold
    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(F.col(text_col)).alias("text"), held(F.col(id_col)).alias("held_out"))
    known = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(toxic_col).cast("int").alias("toxic")).dropna()
    weights, bias = learn(narrow.where("NOT held_out").select("doc_id", "text"), known.where(~held(F.col("doc_id"))), max_positive, max_unlabelled, least, ratio, broadcast_rows)

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict[str, tuple] = {}  # the chosen features of a word; forgotten when there are very many words
        for batch in batches:
            sums = np.full(len(batch), bias)
            for i, text in enumerate(batch["text"]):
                words = words_of(text)
                if len(known) > 500_000:
                    known = {}
                for w in words:
                    if w not in known:
                        known[w] = tuple(h for h in hashes(w) if h in weights)
                sums[i] += sum(weights[h] for h in sorted({h for w in words for h in known[w]}))
            scores = 1 / (1 + np.exp(-np.clip(sums, -30, 30)))
            yield pd.DataFrame({"doc_id": batch["doc_id"].astype("Int64"), "held_out": batch["held_out"], "score": scores, "predicted": (scores >= 0.5).astype(np.int32)})

    return narrow.mapInPandas(score, "doc_id long, held_out boolean, score double, predicted int")
