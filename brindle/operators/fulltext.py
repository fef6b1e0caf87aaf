"""Full-text search over text columns, on token arrays in the JVM."""

from __future__ import annotations

import re
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brindle.errors import QueryError
from brindle.functions import text as X
from brindle.query import Query

#: Weights of the columns in order (A, B, C, D); columns after the fourth weigh as the fourth.
WEIGHTS = (1.0, 0.4, 0.2, 0.1)
MODES = ("natural", "boolean", "phrase", "prefix", "proximity")
#: Fixed value: the furthest apart that a proximity search looks, in tokens.
FURTHEST = 64


def tokens(column: Column) -> Column:
    """Lower-case runs of letters, digits and underscores, in order."""
    return F.filter(F.split(F.lower(F.coalesce(column.cast("string"), F.lit(""))), r"[^\p{L}\p{N}_]+"), lambda t: t != "")


def terms_of(text: str) -> list[str]:
    return re.findall(r"\w+", text.lower())


def parse_boolean(text: str) -> tuple[list, list, list]:
    """(required, excluded, optional): each a list of phrases, which are lists of words; the last word may end in *."""
    required, excluded, optional = [], [], []
    for sign, phrase, word in re.findall(r'([+-]?)(?:"([^"]*)"|([^\s"]+))', text):
        words = terms_of(phrase or word)
        if not words:
            continue
        if word.endswith("*"):
            words[-1] += "*"
        {"+": required, "-": excluded}.get(sign, optional).append(words)
    return required, excluded, optional


def _has(found: Column, word: str) -> Column:
    return F.exists(found, lambda t: t.startswith(word[:-1])) if word.endswith("*") else F.array_contains(found, word)


def _phrase(found: Column, words: list[str]) -> Column:
    if len(words) == 1:
        return _has(found, words[0])
    joined = F.concat(F.lit(" "), F.array_join(found, " "), F.lit(" "))
    return joined.contains(" " + " ".join(words).rstrip("*") + ("" if words[-1].endswith("*") else " "))


def _all(conditions) -> Column:
    out = F.lit(True)
    for c in conditions:
        out = out & c
    return out


@dataclass(frozen=True)
class Search:
    """query.search(columns, text): the rows of the query that match.

    Modes: ``natural`` (every word), ``boolean`` (+required -excluded "phrases" optional; if nothing is required, an
    optional part must match), ``phrase``, ``prefix`` (every word begins a token), ``proximity`` (each two neighbouring
    words within ``distance`` tokens, either way round). A search without a word matches nothing.
    """

    query: Query
    columns: tuple[str, ...]
    text: str
    mode_name: str = "natural"
    distance: int = 10
    weights: tuple[float, ...] = WEIGHTS
    min_length: int = 1
    max_length: int | None = None
    stop_words: frozenset[str] = frozenset()
    least_rank: float | None = None
    tags: tuple[str, str] | None = None
    fragment: int | None = None
    limit_rows: int | None = None
    offset_rows: int | None = None

    def mode(self, name: str, distance: int | None = None) -> Search:
        if name not in MODES:
            raise QueryError(f"no search mode {name!r}")
        return replace(self, mode_name=name, distance=distance or self.distance)

    def weighted(self, *weights: float) -> Search:
        return replace(self, weights=weights)

    def terms_with(self, min_length: int = 1, stop_words=(), max_length: int | None = None) -> Search:
        return replace(self, min_length=min_length, max_length=max_length, stop_words=frozenset(w.lower() for w in stop_words))

    def keeps_term(self, word: str) -> bool:
        return self.min_length <= len(word) <= (self.max_length or len(word)) and word.lower() not in self.stop_words

    def min_rank(self, rank: float) -> Search:
        return replace(self, least_rank=rank)

    def highlight(self, start: str = "<b>", end: str = "</b>", fragment_words: int | None = None) -> Search:
        return replace(self, tags=(start, end), fragment=fragment_words)

    def limit(self, n: int) -> Search:
        return replace(self, limit_rows=n)

    def offset(self, n: int) -> Search:
        return replace(self, offset_rows=n)

    def with_trashed(self) -> Search:
        return replace(self, query=self.query.with_trashed())

    def only_trashed(self) -> Search:
        return replace(self, query=self.query.only_trashed())

    def words(self) -> list[str]:
        """The words that count, in order of first use; a minus takes them out in boolean mode."""
        if self.mode_name == "boolean":
            required, _, optional = parse_boolean(self.text)
            found = [w.rstrip("*") for p in required + optional for w in p]
        else:
            found = terms_of(self.text)
        return list(dict.fromkeys(w for w in found if self.keeps_term(w)))

    def _match(self, found: Column) -> Column:
        words = self.words()
        if self.mode_name == "boolean":
            required, excluded, optional = parse_boolean(self.text)
            if not required and not optional:
                return F.lit(False)
            some = F.lit(False)
            for p in optional:
                some = some | _phrase(found, p)
            return _all(_phrase(found, p) for p in required) & ~_any(_phrase(found, p) for p in excluded) & (F.lit(True) if required else some)
        if not words:
            return F.lit(False)
        if self.mode_name == "phrase":
            return _phrase(found, terms_of(self.text))
        if self.mode_name == "prefix":
            return _all(_has(found, w + "*") for w in words)
        if self.mode_name == "proximity":
            if len(words) == 1:
                return _has(found, words[0])
            return _all(self._near(found, a, b) for a, b in zip(words, words[1:]))
        return _all(_has(found, w) for w in words)

    def _near(self, found: Column, a: str, b: str) -> Column:
        """Two words, one beside the other in the search, at most ``distance`` tokens apart, either way round."""
        places = lambda w: F.filter(F.transform(found, lambda t, i: F.when(t == w, i)), lambda i: i.isNotNull())
        return F.exists(places(a), lambda i: F.exists(places(b), lambda j: F.abs(i - j) <= F.lit(min(self.distance, FURTHEST))))

    def _hit(self, word: str):
        return (lambda t: t.startswith(word)) if self.mode_name == "prefix" else (lambda t: t == word)

    def _rank(self) -> Column:
        """Weighted frequency: for each column and word, weight * tf / (tf + 1), summed."""
        total = F.lit(0.0)
        for i, _ in enumerate(self.columns):
            for w in self.words():
                tf = F.size(F.filter(F.col(f"_tokens_{i}"), self._hit(w))).cast("double")
                total = total + F.lit(float(self.weights[min(i, len(self.weights) - 1)])) * tf / (tf + 1)
        return total

    def _needed(self) -> list[str]:
        """Words that a match must hold, as the beginning of a token at least."""
        if self.mode_name == "boolean":
            return [w.rstrip("*") for p in parse_boolean(self.text)[0] for w in p]
        return terms_of(self.text) if self.mode_name == "phrase" else self.words()

    def _matching(self, tokens_too: bool = False) -> DataFrame:
        """Matching rows. Texts that lack a needed word even as a part are left out before anything is split; the others are
        split once, into ``_tokens_0`` and so on, which match and rank read. (A generator of one row holds them: the optimiser
        would copy a plain projection into every condition.)"""
        df = self.query.frame()
        for word in self._needed():
            held = F.lit(False)
            for c in self.columns:
                held = held | F.contains(F.lower(F.coalesce(F.col(c).cast("string"), F.lit(""))), F.lit(word))
            df = df.where(held)
        split = df.select("*", F.inline(F.array(F.struct(*[tokens(F.col(c)).alias(f"_tokens_{i}") for i, c in enumerate(self.columns)]))))
        names = [f"_tokens_{i}" for i in range(len(self.columns))]
        found = split.where(self._match(F.concat(*names) if len(names) > 1 else F.col(names[0])))
        return found if tokens_too else found.drop(*names)

    def _cut(self, df: DataFrame) -> DataFrame:
        df = df.offset(self.offset_rows) if self.offset_rows else df
        return df if self.limit_rows is None else df.limit(self.limit_rows)

    def frame(self) -> DataFrame:
        """Matching rows, in the order of the query."""
        return self._cut(self._matching())

    def ranked(self, rank: str = "search_rank") -> DataFrame:
        """Matching rows with their rank, highest first (then by key), and a marked copy of each column if asked."""
        df = self._matching(True).withColumn(rank, self._rank()).drop(*[f"_tokens_{i}" for i in range(len(self.columns))])
        if self.least_rank is not None:
            df = df.where(F.col(rank) >= self.least_rank)
        if self.tags:
            for c in self.columns:
                marked = X.highlight(F.col(c), self.words(), *self.tags) if self.fragment is None else X.snippet(F.col(c), self.words(), self.fragment, *self.tags)
                df = df.withColumn(f"{c}_highlight", marked)
        return self._cut(df.orderBy(F.col(rank).desc(), *self.query.model.primary_key))

    def get(self) -> list:
        return self.frame().collect()

    def get_ranked(self) -> list:
        return self.ranked().collect()

    def first(self):
        rows = self.limit(1).get()
        return rows[0] if rows else None

    def count(self) -> int:
        return self._matching().count()


def _any(conditions) -> Column:
    out = F.lit(False)
    for c in conditions:
        out = out | c
    return out
