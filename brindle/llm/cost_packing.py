"""Cost-balanced packing of whole documents into training sequences."""

from __future__ import annotations

import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain
from unicodedata import category, is_normalized

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.llm.shared import ship, text_of

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


#: Stands between parts that are encoded together; its bytes are found again in the ids.
MARK = "\ue000"
#: Characters that a part may end on and that make a token of their own after a letter or digit.
TAIL = "%*&$#!?.,;:|)]}"


@lru_cache(maxsize=10_000)
def ends_a_word(c: str) -> bool:
    """Whether a letter or digit stays a single one when it is composed and lowered. The dotted capital I doesn't: the
    mark that it leaves behind goes with the punctuation after it."""
    return c.isalnum() and (c.isascii() or (category(c)[0] in "LN" and len(c.lower()) == 1 and is_normalized("NFC", c + c.lower()) and category(c.lower())[0] in "LN"))


class WordEncoder:
    """Token ids of texts, by the ids of their space-separated parts.

    Exact for a byte-level tokenizer with word ends that never looks across a space: its pattern's tokens hold
    no white space, and its normaliser composes and lowers within parts. A part's end of punctuation is a token of its own
    after what ends_a_word, and the rest (in lower case, if ASCII), its core, is encoded once for all parts that share it. Ids of cores
    lie one after the other in a flat array, so a text's ids are gathered from it by array operations. All is
    forgotten when there are ``most`` parts. Texts with the mark of a special token, or with MARK, go to the
    tokenizer whole.
    """

    def __init__(self, path: str, most: int = 600_000):
        from tokenizers import Tokenizer

        self.tokenizer, self.most = Tokenizer.from_file(path), most
        self.mark = self.tokenizer.encode(MARK, add_special_tokens=False).ids
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=False)
        self.word_end = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.word_end[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self._forget()

    def _forget(self) -> None:
        self.parts: dict[str, int] = {}
        self.core_of, self.tail_of = array("i"), array("i")  # by part
        self.cores: dict[str, int] = {"": 0}
        self.start, self.size, self.flat = array("q", [0]), array("q", [0]), array("I", [0])  # by core; the ids

    def _encode(self, cores: list[str], joined: str, find_ends, skip: int) -> None:
        """Encode cores that are joined to one text; find_ends gives the ends of their ids, ``skip`` ids lie between."""
        ids = np.array(self.tokenizer.encode_batch_fast([joined], add_special_tokens=False)[0].ids, dtype=np.int64)
        ends = find_ends(ids)
        if len(ends) != len(cores):  # a letter that only one of the two alphabets knows: each core on its own
            each = [e.ids for e in self.tokenizer.encode_batch_fast(cores, add_special_tokens=False)]
            ids, ends, skip = np.array(list(chain.from_iterable(each)), dtype=np.int64), np.cumsum([len(x) for x in each]), 0
        starts = np.concatenate(([0], ends[:-1] + skip)) if len(ends) else ends
        self.cores.update(zip(cores, range(len(self.start), len(self.start) + len(cores))))
        self.start.frombytes((starts + len(self.flat)).astype(np.int64).tobytes())
        self.size.frombytes((ends - starts).astype(np.int64).tobytes())
        self.flat.frombytes(ids.astype(np.uint32).tobytes())

    def _marks(self, ids: np.ndarray) -> np.ndarray:
        n = len(ids) - len(self.mark) + 1
        return np.nonzero(np.logical_and.reduce([ids[k : n + k] == m for k, m in enumerate(self.mark)]))[0]

    def _learn(self, new: list[str]) -> None:
        cores, tails = [], []
        for part in new:
            core = part.rstrip(TAIL)
            if core and ends_a_word(core[-1]):
                tails.append(part[len(core) :])
            else:
                core = part
                tails.append("")
            cores.append(core.lower() if core.isascii() else core)
        need = [c for c in {*cores, *tails} if c not in self.cores]
        words = [c for c in need if c.isalpha() and (c.isascii() or (c == c.lower() and is_normalized("NFC", c)))]  # one token of the pattern each
        others = list(set(need).difference(words))
        for i in range(0, len(words), 50_000):
            some = words[i : i + 50_000]
            self._encode(some, " ".join(some), lambda ids: np.nonzero(self.word_end[ids])[0] + 1, 0)
        for i in range(0, len(others), 50_000):
            some = others[i : i + 50_000]
            self._encode(some, f" {MARK} ".join([*some, ""]), self._marks, len(self.mark))
        self.parts.update(zip(new, range(len(self.core_of), len(self.core_of) + len(new))))
        self.core_of.extend(map(self.cores.__getitem__, cores))
        self.tail_of.extend(map(self.cores.__getitem__, tails))

    def ids(self, texts: list[str]) -> list[np.ndarray]:
        plain = [[] if "<|" in t or MARK in t else t.replace("\n", " ").split(" ") for t in texts]
        if len(self.parts) > self.most:
            self._forget()
        if new := [w for w in set(chain.from_iterable(plain)) if w not in self.parts]:
            self._learn(new)
        at = np.fromiter(map(self.parts.__getitem__, chain.from_iterable(plain)), dtype=np.int64)
        cores = np.empty(2 * len(at), dtype=np.int64)
        cores[0::2], cores[1::2] = np.frombuffer(self.core_of, dtype=np.int32)[at] if len(at) else at, np.frombuffer(self.tail_of, dtype=np.int32)[at] if len(at) else at
        size = np.frombuffer(self.size, dtype=np.int64)[cores]
        upto = np.concatenate(([0], np.cumsum(size)))
        found = np.frombuffer(self.flat, dtype=np.uint32)[np.repeat(np.frombuffer(self.start, dtype=np.int64)[cores] - upto[:-1], size) + np.arange(upto[-1])]
        bounds = upto[2 * np.cumsum([len(p) for p in plain])]
        out = np.split(found, bounds[:-1])
        for i, text in enumerate(texts):
            if not plain[i]:
                out[i] = np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype=np.uint32)
        return out


@lru_cache(maxsize=2)
def encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


def capacities(tokens: int, size: int) -> tuple[int, list[int]]:
    """Full sequences that the tokens fill, and the powers of two that the rest is cut into."""
    full, rest = divmod(tokens, size)
    return full, [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]


class Packer:
    """Packs pieces of documents. Each group fills its sequences to the last token; what is left over of
    one group goes before the next, and only the last group of a partition has short sequences."""

    def __init__(self, size: int, linear: float, quadratic: float):
        self.size, self.linear, self.quadratic = size, linear, quadratic
        self.sequence = 0

    def pack(self, pieces: list[tuple], last: bool) -> tuple[list[tuple], list[tuple]]:
        """pieces: (document, start, length). Returns (document, start, length, sequence, offset) and the pieces left over."""
        size = self.size
        full, short = capacities(sum(p[2] for p in pieces), size)
        spaces = np.array([size] * full + (short if last else []), dtype=np.int64)
        if not len(spaces):
            return [], pieces
        left, cost = spaces.copy(), np.zeros(len(spaces))
        placed, rest, whole = [], [], 0

        def put(doc, start, length, k):
            placed.append((doc, start, length, self.sequence + k, int(spaces[k] - left[k])))
            left[k] -= length
            cost[k] += self.linear * length + self.quadratic * length * length

        for doc, start, length in pieces:  # what is longer than a sequence fills sequences of its own
            while length >= size and whole < full:
                put(doc, start, size, whole)
                start, length, whole = start + size, length - size, whole + 1
            if length:
                rest.append((doc, start, length))
        rest.sort(key=lambda p: (-p[2], p[1]))
        cut = []
        for doc, start, length in rest:  # longest first, to the cheapest sequence with room for all of it
            open_cost = np.where(left >= length, cost, np.inf)
            k = int(np.argmin(open_cost))
            if open_cost[k] < np.inf:
                put(doc, start, length, k)
            else:
                cut.append((doc, start, length))
        over = []
        order = iter(np.argsort(-left, kind="stable").tolist())
        k = next(order, None)
        for doc, start, length in cut:  # no room in one piece: fill what is open, widest first
            while length:
                while k is not None and left[k] == 0:
                    k = next(order, None)
                if k is None:
                    over.append((doc, start, length))
                    break
                part = int(min(length, left[k]))
                put(doc, start, part, k)
                start, length = start + part, length - part
        if not last and left.any():  # a smaller piece than the open room: cannot happen, as the room is at most the tokens
            raise AssertionError("sequences left open")
        self.sequence += len(spaces)
        return placed, over


def runs(texts: pd.Series, chars: int = 1_000_000) -> Iterator[tuple[int, list[str]]]:
    """Runs of texts of about so many characters together, with the place of the first."""
    start, run, size = 0, [], 0
    for i, text in enumerate(texts):
        run.append(text)
        size += len(text)
        if size >= chars:
            yield start, run
            start, run, size = i + 1, [], 0
    if run:
        yield start, run


def _pack_partition(batches: Iterator[pd.DataFrame], path: str, size: int, end_id: int, linear: float, quadratic: float, group_tokens: int) -> Iterator[pd.DataFrame]:
    words, packer = encoder(path), Packer(size, linear, quadratic)
    first = TaskContext.get().partitionId() << 40  # ids of sequences: the partition, then a count
    pieces, held = [], 0

    def rows(last: bool) -> pd.DataFrame:
        nonlocal pieces, held
        placed, pieces = packer.pack(pieces, last)
        held = sum(p[2] for p in pieces)
        return pd.DataFrame(
            [(d[0], s, n, zlib.crc32(d[1][s : s + n].tobytes()), len(d[1]), first + q, o) for d, s, n, q, o in placed],
            columns=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"],
        ).astype({"doc_id": "Int64"})

    for batch in batches:
        doc_ids = batch["doc_id"].astype("Int64").tolist()
        for start, run in runs(batch["text"]):
            for doc_id, ids in zip(doc_ids[start:], words.ids(run)):
                ids = np.append(ids, np.uint32(end_id)).astype("<u4")
                pieces.append(((doc_id, ids), 0, len(ids)))
                held += len(ids)
                if held >= group_tokens:
                    yield rows(False)
    words._forget()  # workers are used again, also for other work
    if pieces:
        yield rows(True)


def cost_packing(
    docs: DataFrame,
    tokenizer_path: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    size: int = 2048,
    end_id: int = 1,
    linear: float = 1.0,
    quadratic: float = 1 / 512,
    group_tokens: int = 524_288,
) -> DataFrame:
    """Pieces of documents in sequences of at most ``size`` tokens: the columns of SCHEMA.

    A document's tokens are its ids and ``end_id``. The cost of a sequence is estimated as the sum of
    linear * n + quadratic * n * n over its pieces (attention stays within a document). Within a group of
    about ``group_tokens`` tokens, documents in descending length go to the cheapest sequence with room for
    them; what fits nowhere whole is cut to fill the open room. Sequences are full, except for at most
    log2(size) of powers of two at the end of a partition, so there is no padding.

    Groups are made while a partition streams: no shuffle, and memory is bounded by a group and the
    longest document. A lost task repeats its partition alone; the ids of sequences hold its number.

    Defined cases: null and empty texts are a single ``end_id``; texts longer than a sequence fill sequences of their own;
    pieces of equal length go in the order of their start, then of their arrival, and to the first of equally cheap
    sequences; rows that repeat are documents of their own, as are null ids; an empty table gives no rows; other
    columns, whatever their names, are ignored.
    """
    ship(docs.sparkSession)
    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(F.col(text_col)).alias("text"))
    return narrow.mapInPandas(lambda batches: _pack_partition(batches, tokenizer_path, size, end_id, linear, quadratic, group_tokens), SCHEMA)
