"""What a database's queries took: a journal of terminals with their time and rows, slow ones, and a summary by table."""

from __future__ import annotations

import time
from collections import deque
from collections.abc import Callable
from contextlib import contextmanager
from dataclasses import dataclass, field


@dataclass(frozen=True)
class Run:
    table: str
    what: str
    seconds: float
    rows: int | None
    error: str | None = None


@dataclass
class Journal:
    """The last ``most`` runs. ``sink`` hears of each; runs of ``slow`` seconds or more are counted as slow."""

    slow: float = 1.0
    most: int = 1000
    sink: Callable[[Run], None] | None = None
    runs: deque = field(default_factory=deque)
    counts: dict = field(default_factory=dict)

    def note(self, run: Run) -> None:
        self.runs.append(run)
        while len(self.runs) > self.most:
            self.runs.popleft()
        seen = self.counts.setdefault(run.table, {"runs": 0, "seconds": 0.0, "slow": 0, "errors": 0})
        seen["runs"] += 1
        seen["seconds"] += run.seconds
        seen["slow"] += run.seconds >= self.slow
        seen["errors"] += run.error is not None
        if self.sink:
            self.sink(run)

    @contextmanager
    def timing(self, table: str, what: str):
        """Note what runs inside; set rows[0] to tell its rows."""
        start, rows = time.perf_counter(), [None]
        try:
            yield rows
        except Exception as e:
            self.note(Run(table, what, time.perf_counter() - start, None, f"{type(e).__name__}: {e}"))
            raise
        self.note(Run(table, what, time.perf_counter() - start, rows[0]))

    def slow_runs(self) -> list[Run]:
        return sorted((r for r in self.runs if r.seconds >= self.slow), key=lambda r: -r.seconds)

    def report(self) -> list[tuple[str, dict]]:
        """Tables by the time that their queries took, longest first."""
        return sorted(self.counts.items(), key=lambda kv: -kv[1]["seconds"])
