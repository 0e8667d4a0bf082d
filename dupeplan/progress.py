"""Progress lines on standard error."""

from __future__ import annotations

import sys
import time
from collections.abc import Iterator
from contextlib import contextmanager
from typing import TextIO


class Progress:
    """Says which phase runs, how far it is (once a second at most) and what it came to."""

    def __init__(self, command: str, enabled: bool = True, stream: TextIO | None = None, every: float = 1.0):
        self.command, self.enabled, self.stream, self.every = command, enabled, stream, every
        self.counts: dict[str, int] = {}
        self.name, self.done, self.total, self.said = "", 0, 0, 0.0

    def note(self, message: str) -> None:
        if self.enabled:
            print(f"{self.command}: {message}", file=self.stream or sys.stderr, flush=True)

    @contextmanager
    def phase(self, name: str, total: int = 0) -> Iterator[None]:
        """A phase of ``total`` steps (0: not known)."""
        self.name, self.done, self.total, began = name, 0, total, time.monotonic()
        self.note(f"{name} ...")
        yield
        self.note(f"{name}: done in {time.monotonic() - began:.1f} s{self._counted()}")

    def advance(self, steps: int = 1, **counts: int) -> None:
        """Steps that are done, and what they add to the counts."""
        self.done += steps
        for k, n in counts.items():
            self.counts[k] = self.counts.get(k, 0) + n
        if time.monotonic() - self.said >= self.every:
            self.said = time.monotonic()
            self.note(f"{self.name}: {self.done}{f'/{self.total}' if self.total else ''}{self._counted()}")

    def _counted(self) -> str:
        return "".join(f", {n} {k.replace('_', ' ')}" for k, n in self.counts.items())


SILENT = Progress("", enabled=False)
