"""What a tile may cost, and which links it shows."""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Callable, Iterable
from dataclasses import dataclass
from enum import Enum

from tilewright.model.errors import TileTooLarge, TileTooWide


@dataclass(frozen=True)
class TilePolicy:
    """Limits per tile; ``None`` is no limit."""

    max_span: int | None = None
    max_records: int | None = 8192
    max_scan_bytes: int | None = 20_000_000

    def __post_init__(self):
        for name, value in vars(self).items():
            if value is not None and value < 0:
                raise ValueError(f"{name} must not be negative")

    def check_span(self, width: int) -> None:
        if self.max_span is not None and width > self.max_span:
            raise TileTooWide(f"a tile of {width} bp is wider than {self.max_span}")

    def check_scan(self, size: int) -> None:
        if self.max_scan_bytes is not None and size > self.max_scan_bytes:
            raise TileTooLarge(f"a scan of {size} bytes is larger than {self.max_scan_bytes}")


class LinkPolicy(Enum):
    """Which links a 1D tile shows: both anchors inside, either inside, or the span between them meets it."""

    BOTH = "both"
    EITHER = "either"
    HULL = "hull"


def stable_importance(key: str) -> float:
    """A number in [0, 1) fixed by the key: the first 32 bits of its md5."""
    return int(hashlib.md5(key.encode(), usedforsecurity=False).hexdigest()[:8], 16) / 2**32


def take_most_important(records: Iterable, cap: int | None, importance: Callable) -> list:
    """The ``cap`` most important records in their order; of equals the first ones. ``None`` takes all."""
    if cap is None:
        return list(records)
    if cap <= 0:
        return []
    best = heapq.nsmallest(cap, enumerate(records), key=lambda p: (-importance(p[1]), p[0]))
    return [r for _, r in sorted(best, key=lambda p: p[0])]


def drops(spans: list[int], bins: list[int], binsize: float, threshold: float = 0.5) -> list[bool]:
    """Which intervals give up their last bin so that bins do not run ahead of the coordinates they stand for.

    With the excess E(i), the bins' width minus the spans' up to interval i, floor(E/binsize - threshold) + 1 bins are
    too many so far. An interval drops one bin if more are due than were dropped before it. An interval without bins has
    none to drop.
    """
    out, excess, dropped = [], 0.0, 0
    for span, n in zip(spans, bins):
        excess += binsize * n - span
        out.append(n > 0 and int((excess / binsize - threshold) // 1) + 1 > dropped)
        dropped += out[-1]
    return out
