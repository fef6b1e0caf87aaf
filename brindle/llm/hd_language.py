"""Language identification with hyperdimensional profiles."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brindle.llm.shared import cut, ship, text_of

#: Symbols of the alphabet: 0 is the gap between words; letters of ASCII have their own, others share by code point.
SYMBOLS = 1024


@lru_cache(maxsize=1)
def _symbols() -> np.ndarray:
    """Symbol by code point of the basic plane; 0 for what is no letter. Case is ignored."""
    found = np.zeros(0x10000, dtype=np.int64)
    for code in range(0x10000):
        low = chr(code).lower()
        if len(low) == 1 and unicodedata.category(low)[0] == "L":
            found[code] = 1 + ord(low) % (SYMBOLS - 1)
    return found


def letters(text: str) -> np.ndarray:
    """Symbols of a whole text, with a single gap between words and at both ends."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")
    table = _symbols()
    if len(codes) and codes.max() >= len(table):
        high = {int(c) for c in np.unique(codes[codes >= len(table)])}
        extra = {c: 1 + c % (SYMBOLS - 1) if unicodedata.category(chr(c))[0] == "L" else 0 for c in high}
        found = np.array([extra[c] if c in extra else table[c] for c in codes.tolist()], dtype=np.int64)
    else:
        found = table[codes]
    found = np.concatenate(([0], found, [0]))
    return found[np.concatenate(([True], (found[1:] != 0) | (found[:-1] != 0)))]


class Space:
    """Random letter vectors and the n-gram vectors bound from them, all of +1 and -1."""

    def __init__(self, dims: int, n: int, seed: int, most: int = 20_000):
        self.n, self.most = n, most
        self.atoms = np.random.default_rng(seed).integers(0, 2, (SYMBOLS, dims), dtype=np.int8) * 2 - 1
        self.rolled = [np.roll(self.atoms, n - 1 - k, axis=1) for k in range(n)]  # the letter k places before the last is permuted so many times
        self.forget()

    def forget(self) -> None:
        """Let go of the remembered n-gram vectors: workers are used again, also for other work."""
        self.codes, self.vectors = np.zeros(0, dtype=np.int64), np.zeros((0, self.atoms.shape[1]), dtype=np.int8)

    def bind(self, codes: np.ndarray) -> np.ndarray:
        """Vectors of n-grams: the product of their letters' permuted vectors."""
        out, rest = None, codes
        for k in range(self.n - 1, -1, -1):
            rest, letter = np.divmod(rest, SYMBOLS)
            out = self.rolled[k][letter] if out is None else out * self.rolled[k][letter]
        return out

    def grams(self, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distinct n-grams of a text as numbers, and their counts. A text shorter than n has one n-gram, filled up with gaps."""
        if len(symbols) < self.n:
            symbols = np.concatenate((symbols, np.zeros(self.n - len(symbols), dtype=np.int64)))
        code = np.zeros(len(symbols) - self.n + 1, dtype=np.int64)
        for k in range(self.n):
            code = code * SYMBOLS + symbols[k : k + len(code)]
        return np.unique(code, return_counts=True)

    def _known(self, codes: np.ndarray) -> np.ndarray:
        """Rows of self.vectors for sorted distinct codes; new ones are bound and remembered."""
        at = np.searchsorted(self.codes, codes)
        missing = codes[(at >= len(self.codes)) | (self.codes[np.minimum(at, len(self.codes) - 1)] != codes)] if len(self.codes) else codes
        if len(missing):
            if len(self.codes) + len(missing) > self.most:
                self.forget()
                missing = codes
            all_codes = np.concatenate((self.codes, missing))
            order = np.argsort(all_codes, kind="stable")
            self.vectors = np.concatenate((self.vectors, self.bind(missing)))[order]
            self.codes = all_codes[order]
        return np.searchsorted(self.codes, codes)

    def bundles(self, texts: list[np.ndarray]) -> np.ndarray:
        """A row for each text: the sum of its n-grams' vectors, scaled to length 1."""
        counted = [self.grams(x) for x in texts]
        codes = np.unique(np.concatenate([c for c, _ in counted]))
        where = self._known(codes)
        counts = np.zeros((len(texts), len(codes)), dtype=np.float32)
        for i, (c, n) in enumerate(counted):
            counts[i, np.searchsorted(codes, c)] = n
        sums = counts @ self.vectors[where].astype(np.float32)
        return sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-9)


def chunks(texts: pd.Series, rows: int = 64, chars: int = 400_000) -> Iterator[tuple[int, list[str]]]:
    """Runs of texts that stay small together."""
    run, size, start = [], 0, 0
    for i, text in enumerate(texts):
        if run and (len(run) >= rows or size + len(text) > chars):
            yield start, run
            run, size, start = [], 0, i
        run.append(text)
        size += len(text)
    if run:
        yield start, run


@lru_cache(maxsize=2)
def space(dims: int, n: int, seed: int) -> Space:
    return Space(dims, n, seed)


def _bundle_partition(batches: Iterator[pd.DataFrame], dims: int, n: int, seed: int) -> Iterator[pd.DataFrame]:
    own, sums = space(dims, n, seed), {}
    for batch in batches:
        langs = batch["lang"].to_numpy()
        for start, run in chunks(batch["text"]):
            symbols = [letters(t) for t in run]
            keep = [i for i, s in enumerate(symbols) if s.any()]
            if keep:
                for i, vector in zip(keep, own.bundles([symbols[i] for i in keep])):
                    lang = langs[start + i]
                    sums[lang] = sums.get(lang, 0) + vector.astype(np.float64)
    own.forget()
    for lang, vector in sums.items():
        yield pd.DataFrame({"lang": lang, "dim": np.arange(dims), "value": vector})


def learn(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", dims: int = 1024, n: int = 3, seed: int = 5, most: int = 2000) -> tuple[list[str], np.ndarray]:
    """Prototypes: for each language the bundle of the bundles of all its documents. Rows without a language or a letter are ignored.

    Every partition sends a vector for each language it holds; sums by (language, dimension) reach the
    driver: languages times ``dims`` numbers, however many documents there are. More than ``most`` values of the language
    column are an error: such a column holds no languages.
    """
    ship(docs.sparkSession)
    known = docs.where(F.col(lang_col).isNotNull()).select(F.col(lang_col).cast("string").alias("lang"), text_of(F.col(text_col)).alias("text"))
    parts = known.mapInPandas(lambda batches: _bundle_partition(batches, dims, n, seed), "lang string, dim int, value double")
    sums = parts.groupBy("lang", "dim").agg(F.round(F.sum("value"), 6).alias("value")).limit(most * dims + 1).toPandas()  # rounded: the order of summing doesn't show
    if len(sums) > most * dims:
        raise ValueError(f"{lang_col} has more than {most} values")
    if sums.empty:
        return [], np.zeros((0, dims))
    wide = sums.pivot(index="lang", columns="dim", values="value").sort_index()
    found = wide.to_numpy()
    return wide.index.tolist(), found / np.linalg.norm(found, axis=1, keepdims=True)


def hd_language(
    docs: DataFrame,
    train: Column | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    dims: int = 1024,
    n: int = 3,
    seed: int = 5,
    keep: tuple[str, ...] = (),
    keep_text: bool = False,
    tell_letters: bool = False,
) -> DataFrame:
    """Language of every whole text: doc_id, lang_pred, score; one row per row. The columns in ``keep`` come along in a
    struct ``kept``, so that their names can't clash. With ``keep_text`` the text comes along as ``text`` (null: empty), with
    ``tell_letters`` has_letter says whether it has one.

    Letters have random vectors of +1 and -1; an n-gram's vector is the product of its letters' vectors,
    each permuted by its place; a document's is the sum over its n-grams. The language is that of the
    prototype (learn, from the rows where ``train`` holds; all if None) with the largest cosine, once the
    mean of the prototypes, which all languages share, is taken out of them. score is the cosine with the
    winner's whole prototype, 0 to 1.

    Defined cases: a text that is null, empty or without a letter, and any text if nothing could be learned,
    is ``und`` with score 0; ties go to the first language in order; repeated rows repeat; an empty table
    gives no rows; texts count whole, however long (in parts of bounded size); other columns, whatever their names, are
    ignored unless kept.
    """
    ship(docs.sparkSession)
    langs, prototypes = learn(docs if train is None else docs.where(train), lang_col, text_col, dims, n, seed)
    centred = (prototypes - prototypes.mean(axis=0)) if len(langs) > 1 else prototypes
    centred = (centred / np.maximum(np.linalg.norm(centred, axis=1, keepdims=True), 1e-9)).T.astype(np.float32)
    plain = prototypes.T.astype(np.float32)

    def predict(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = space(dims, n, seed)
        for batch in batches:
            found, scores, has = np.array(["und"] * len(batch), dtype=object), np.zeros(len(batch)), np.zeros(len(batch), dtype=bool)
            for start, run in chunks(batch["text"]) if langs or tell_letters else ():
                symbols = [letters(t) for t in run]
                at = [i for i, s in enumerate(symbols) if s.any()]
                has[[start + i for i in at]] = True
                if at and langs:
                    vectors = own.bundles([symbols[i] for i in at])
                    best = (vectors @ centred).argmax(axis=1)
                    found[[start + i for i in at]] = [langs[b] for b in best]
                    scores[[start + i for i in at]] = np.clip((vectors @ plain)[np.arange(len(at)), best], 0, 1)
            out = (batch if keep_text else batch.drop(columns="text")).assign(lang_pred=found, score=scores)
            yield out.assign(has_letter=has) if tell_letters else out
        own.forget()

    inner = [f"kept_{i}" for i in range(len(keep))]
    narrow = docs.select(F.col(id_col).alias("doc_id"), *[F.col(c).alias(k) for c, k in zip(keep, inner)], text_of(F.col(text_col)).alias("text"))
    fields = narrow.schema.fields if keep_text else narrow.schema.fields[:-1]
    made = T.StructType([*fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), *([T.StructField("has_letter", T.BooleanType())] if tell_letters else [])])
    found = narrow.mapInPandas(predict, made)
    if not keep:
        return found
    return found.select(*[c for c in found.columns if c not in inner], F.struct(*[F.col(k).alias(c) for c, k in zip(keep, inner)]).alias("kept"))
