"""Token counts by section: whole documents are encoded once, and tokens are given to sections by their offsets."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.llm.shared import ship, text_of

SCHEMA = "doc_id long, section int, start long, stop long, n_tokens long, n_crossing long, doc_tokens long"
RULES = ("start", "most")


@lru_cache(maxsize=2)
def encoding(path: str, pattern: str):
    """The byte-level BPE whose ranks are in the file, and the number of bytes of each token."""
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    size = np.zeros(max(ranks.values()) + 1, dtype=np.int64)
    for token, rank in ranks.items():
        size[rank] = len(token)
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}), size


def spans(text: str, path: str, pattern: str) -> tuple[np.ndarray, np.ndarray]:
    """First character and end (one after the last) of every token of a whole text. A token of some bytes of a
    character covers that character."""
    coder, size = encoding(path, pattern)
    tokens = coder.encode_to_numpy(text)
    stop = np.cumsum(size[tokens])
    start = stop - size[tokens]
    if text.isascii():
        return start, stop
    lead = (np.frombuffer(text.encode("utf-8"), dtype=np.uint8) & 0xC0) != 0x80
    char = np.cumsum(lead) - 1  # the character of each byte
    return char[start], char[stop - 1] + 1


def sections_of(text: str, separator: str = "\n") -> np.ndarray:
    """(start, stop) of the parts between separators; a text without one is a single section."""
    at, found = 0, []
    for part in text.split(separator):
        found.append((at, at + len(part)))
        at += len(part) + len(separator)
    return np.array(found, dtype=np.int64)


def attribute(start: np.ndarray, stop: np.ndarray, sections: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """Tokens given to each section, and how many of those reach beyond it.

    sections: ordered and disjoint spans. Each token goes to one section: under ``start`` to the section of
    its first character, under ``most`` to the one that holds most of its characters (ties: the earlier one).
    What lies in a gap counts for the section before the gap, or for the first one if there is none.
    """
    begin = sections[:, 0]
    owner = np.maximum(np.searchsorted(begin, start, side="right") - 1, 0)
    if rule == "most":
        last = np.maximum(np.searchsorted(begin, stop - 1, side="right") - 1, 0)
        for i in np.nonzero(last > owner)[0]:  # few tokens cross a boundary
            options = np.arange(owner[i], last[i] + 1)
            held = np.minimum(stop[i], sections[options, 1]) - np.maximum(start[i], sections[options, 0])
            owner[i] = options[int(np.argmax(held))]
    crossing = (start < sections[owner, 0]) | (stop > sections[owner, 1])
    n = len(sections)
    return np.bincount(owner, minlength=n), np.bincount(owner[crossing], minlength=n)


def token_attribution(
    docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", separator: str = "\n", rule: str = "most", out_rows: int = 50_000
) -> DataFrame:
    """Tokens of every section of every document: the columns of SCHEMA, one row per section.

    A document is encoded once and whole, so its sections' counts add up to ``doc_tokens``, the length of
    what a model would read; encoding the sections on their own would give other numbers. Offsets are in
    characters (code points). The join of token spans with section spans runs inside the document, by binary
    search over the ordered spans; see attribute for the rule on tokens that cross a boundary or lie in a gap.

    No shuffle; a task holds a batch of texts and at most about ``out_rows`` rows of results.

    Defined cases: null and empty texts have one section of no tokens; empty sections (repeated separators)
    are kept; very long texts are encoded whole, one at a time; repeated rows repeat; an empty table gives no rows;
    other columns, whatever their names, are ignored.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    ship(docs.sparkSession)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [x.split()[0] for x in SCHEMA.split(", ")]
        held: list[list[np.ndarray]] = []
        ids: list[pd.Series] = []
        size = 0

        def flush() -> pd.DataFrame:
            columns = [np.concatenate(c) for c in zip(*held)]
            out = pd.DataFrame(dict(zip(names[1:], columns)))
            out.insert(0, "doc_id", pd.array([i for i, n in ids for _ in range(n)], dtype="Int64"))
            return out

        for batch in batches:
            for doc_id, text in zip(batch["doc_id"].astype("Int64"), batch["text"]):
                sections = sections_of(text, separator)
                start, stop = spans(text, ranks_path, pattern) if text else (np.zeros(0, np.int64), np.zeros(0, np.int64))
                n, crossing = attribute(start, stop, sections, rule)
                k = len(sections)
                held.append([np.arange(k, dtype=np.int32), sections[:, 0], sections[:, 1], n, crossing, np.full(k, len(start))])
                ids.append((doc_id, k))
                size += k
                if size >= out_rows:
                    yield flush()
                    held, ids, size = [], [], 0
        if held:
            yield flush()

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(F.col(text_col)).alias("text")).mapInPandas(count, SCHEMA)
