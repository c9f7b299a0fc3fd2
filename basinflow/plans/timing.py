"""Wall times of a run's stages."""

from __future__ import annotations

import time
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field


@dataclass
class StageTimer:
    """Adds up the time of named stages, and what each of them handled."""

    seconds: dict[str, float] = field(default_factory=dict)
    calls: dict[str, int] = field(default_factory=dict)
    items: dict[str, int] = field(default_factory=dict)

    @contextmanager
    def stage(self, name: str, items: int = 0) -> Iterator[None]:
        """Times a block as a part of a stage, also if it fails."""
        began = time.perf_counter()
        try:
            yield
        finally:
            self.seconds[name] = self.seconds.get(name, 0.0) + time.perf_counter() - began
            self.calls[name] = self.calls.get(name, 0) + 1
            self.count(name, items)

    def count(self, name: str, items: int) -> None:
        """Adds to the items a stage handled, known only afterwards."""
        self.items[name] = self.items.get(name, 0) + items

    @property
    def total(self) -> float:
        """Seconds of all stages."""
        return sum(self.seconds.values())

    def report(self) -> list[str]:
        """A line for each stage, the slowest first: seconds, share, calls and time per item."""
        lines = []
        for name, s in sorted(self.seconds.items(), key=lambda x: -x[1]):
            share = 100 * s / self.total if self.total else 0.0
            each = f", {1e6 * s / self.items[name]:.1f} us each of {self.items[name]}" if self.items.get(name) else ""
            lines.append(f"{name}: {s:.2f} s, {share:.0f} %, {self.calls[name]} calls{each}")
        return lines
