"""Results kept for a while: by key, with the tables they read and tags to drop them by."""

from __future__ import annotations

import time
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame


@dataclass(frozen=True)
class Entry:
    frame: DataFrame
    tables: frozenset[str]
    tags: frozenset[str]
    until: float


class ResultCache:
    """Persisted DataFrames by key. The oldest entry goes when there are more than ``most``."""

    def __init__(self, most: int = 256):
        self.most, self.entries = most, {}
        self.hits = self.misses = self.evicted = 0

    def __len__(self) -> int:
        return len(self.entries)

    def _drop(self, keys: Iterable[str]) -> int:
        keys = list(keys)
        for key in keys:
            self.entries.pop(key).frame.unpersist()
        return len(keys)

    def get(self, key: str) -> DataFrame | None:
        self.evict_expired()
        found = self.entries.get(key)
        self.hits, self.misses = self.hits + (found is not None), self.misses + (found is None)
        return found.frame if found else None

    def set(self, key: str, frame: DataFrame, seconds: float, tables: Iterable[str] = (), tags: Iterable[str] = ()) -> DataFrame:
        self._drop([key] if key in self.entries else [])
        self.entries[key] = Entry(frame.persist(), frozenset(tables), frozenset(tags), time.monotonic() + seconds)
        self.evicted += self._drop(list(self.entries)[: max(0, len(self.entries) - self.most)])
        return frame

    def set_tagged(self, key: str, frame: DataFrame, seconds: float, *tags: str) -> DataFrame:
        return self.set(key, frame, seconds, tags=tags)

    def invalidate(self, key: str) -> int:
        return self._drop([key] if key in self.entries else [])

    def invalidate_table(self, name: str) -> int:
        return self._drop([k for k, e in self.entries.items() if name in e.tables])

    def invalidate_tag(self, tag: str) -> int:
        return self._drop([k for k, e in self.entries.items() if tag in e.tags])

    def invalidate_model(self, model) -> int:
        return self.invalidate_table(model.table)

    def evict_expired(self) -> int:
        """Drop what is over; returns how many."""
        now = time.monotonic()
        n = self._drop([k for k, e in self.entries.items() if e.until <= now])
        self.evicted += n
        return n

    def clear(self) -> None:
        self._drop(list(self.entries))

    def stats(self) -> dict:
        asked = self.hits + self.misses
        return {"entries": len(self), "hits": self.hits, "misses": self.misses, "evicted": self.evicted, "hit_rate": self.hits / asked if asked else 0.0}
